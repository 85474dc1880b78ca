"""What the operators share: words, shared storage for cut lineage, shipping of the package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, everywhere in this subpackage (bytes.split() splits at the same).
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"

_local_root: str | None = None
_shipped: set[str] = set()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where that is unset (tests)."""
    global _local_root
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if said:
        return said.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="keyloom-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return f"file://{_local_root}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes the rows to the shared folder as Parquet and reads them again.

    Unlike a local checkpoint it outlives any executor. The folder is not removed here; whoever owns
    spark.checkpoint.dir cleans it, as with checkpoint().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/keyloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, wherever the driver has it from."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="keyloom-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(path := os.path.join(folder, "keyloom_pkg.zip"), "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def words_sql(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text as an array; of a null or blank text an empty array."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def count_of(text: Column, char_class: str) -> Column:
    """How many characters of a text a regular expression for one character matches."""
    return (F.size(F.split(text, char_class)) - 1).cast("long")
