"""Schema migration by member names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.functions import semantics as S


def migrate(df: DataFrame, target: T.StructType, keys: list[str], positional: bool = False) -> DataFrame:
    """df with the members of target: those of the same name are copied, new ones get their type's default (the empty
    string, not null, for strings), others are dropped. With `positional` (unnamed members) as many as there are go by
    place. A member whose type changed is an error, and so is a key that is not the same."""
    have = df.schema
    for k in keys:
        if k not in target.names or target[k].dataType != have[k].dataType:
            raise ValueError(f"key {k!r} cannot change")
    columns = []
    record = [c for c in df.columns if c not in keys]
    place = 0
    for f in target.fields:
        source = f.name if f.name in have.names else None
        if positional and f.name not in keys:
            source = record[place] if place < len(record) else None
            place += 1
        if source is not None:
            if have[source].dataType != f.dataType:
                raise ValueError(f"{f.name!r} cannot change from {have[source].dataType.simpleString()} to {f.dataType.simpleString()}")
            columns.append(F.col(f"`{source}`").alias(f.name))
        else:
            default = "" if isinstance(f.dataType, T.StringType) else S.default_of(f.dataType)
            columns.append((F.lit(None).cast(f.dataType) if default is None else S.literal(default, f.dataType)).alias(f.name))
    return df.select(*columns)
