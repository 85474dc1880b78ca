"""Databases: named tables as immutable Parquet snapshots with a pointer to the current one.

A commit writes every changed table to a new folder, range-partitioned and sorted by key so that row-group statistics
prune key ranges, and then adds one small catalog file under the next number. Readers see the old catalog or the new one,
over all tables. A number is taken once: of two writers that read the same catalog the second to commit fails.
Files go through Hadoop's file system API, so any store that Spark writes to will do.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from keyloom.operators import migration, mutations
from keyloom.operators.blob import SCHEMA as BLOB_SCHEMA
from keyloom.operators.blob import BlobFile
from keyloom.operators.table import Table
from keyloom.plans.planner import Index
from keyloom.sources import connection

#: Names that begin so are the engine's own: hidden, and refused to callers.
INTERNAL = "__"
CATALOG = "_catalog-"
FILES = "__files"


class CommitConflict(RuntimeError):
    """Another writer has committed since the catalog was read."""


class Database:
    """One database under a folder, or (path None) in memory for as long as the object lives."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path.rstrip("/") if path else None
        self._open: dict[str, Table] = {}
        self._changed: set[str] = set()
        self._catalog: dict[str, dict] = self._read_catalog()

    @classmethod
    def from_connection(cls, spark: SparkSession, text: str) -> Database:
        said = connection.parse(text)
        if said.provider == "network":
            raise ValueError("no server to connect to: use Spark Connect for a remote session")
        return cls(spark, said.path if said.provider == "file" else None)

    # The store

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[int]:
        """The numbers of the catalogs, in order."""
        fs, p = self._fs(self.path)
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.removeprefix(CATALOG)) for n in names if n.startswith(CATALOG) and n.removeprefix(CATALOG).isdigit())

    def _read_file(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _read_catalog(self) -> dict[str, dict]:
        self.version = 0
        if self.path is None or not (versions := self._versions()):
            return {}
        self.version = versions[-1]
        return json.loads(self._read_file(f"{self.path}/{CATALOG}{self.version:012d}"))

    def _write_catalog(self) -> None:
        fs, new = self._fs(f"{self.path}/{uuid.uuid4().hex}.tmp")
        fs.mkdirs(new.getParent())
        stream = fs.create(new, True)
        try:
            stream.write(bytearray(json.dumps(self._catalog).encode()))
        finally:
            stream.close()
        jvm = self.spark._jvm.org.apache.hadoop.fs
        context = jvm.FileContext.getFileContext(new.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0)
        try:
            context.rename(new, self._fs(f"{self.path}/{CATALOG}{self.version + 1:012d}")[1], options)  # fails if the name is taken
        except Py4JJavaError as e:
            fs.delete(new, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise CommitConflict(f"version {self.version + 1} of {self.path} is another writer's: open the database anew") from None
            raise
        self.version += 1

    def vacuum(self, keep: int = 1) -> int:
        """Removes all but the last `keep` catalogs and the snapshots that only those name; readers of older ones must be
        gone, and no commit under way. How many snapshots went."""
        versions = self._versions()
        kept = [json.loads(self._read_file(f"{self.path}/{CATALOG}{v:012d}")) for v in versions[-max(1, keep) :]]
        named = {m["folder"] for c in kept for m in c.values() if m.get("folder")}
        for v in versions[: -max(1, keep)]:
            fs, p = self._fs(f"{self.path}/{CATALOG}{v:012d}")
            fs.delete(p, False)
        gone = 0
        fs, root = self._fs(self.path)
        for table in fs.listStatus(root) if fs.exists(root) else []:
            if table.isDirectory():
                for snapshot in fs.listStatus(table.getPath()):
                    name = f"{table.getPath().getName()}/{snapshot.getPath().getName()}"
                    if name not in named:
                        gone += bool(fs.delete(snapshot.getPath(), True))
        return gone

    # Tables

    @staticmethod
    def _name(name: str) -> str:
        if not name or name.startswith(INTERNAL) or "/" in name:
            raise ValueError(f"{name!r} is not a table name")
        return name

    def _load(self, name: str) -> Table:
        if name not in self._open:
            meta = self._catalog[name]
            schema = T.StructType.fromJson(meta["schema"])
            df = self.spark.read.schema(schema).parquet(f"{self.path}/{meta['folder']}") if meta.get("folder") else self.spark.createDataFrame([], schema)
            self._open[name] = Table(df, meta["keys"], [Index(i["name"], tuple(i["members"]), i["unique"]) for i in meta["indexes"]], name)
        return self._open[name]

    def open_table(self, name: str, keys: str | list[str] | None = None, schema: T.StructType | None = None) -> Table:
        """The table; made if it isn't there. With another schema than it has, the record is migrated by member names."""
        self._name(name)
        if name not in self._catalog:
            if keys is None or schema is None:
                raise KeyError(name)
            keys = [keys] if isinstance(keys, str) else list(keys)
            self._catalog[name] = {"keys": keys, "schema": schema.jsonValue(), "indexes": [], "folder": None}
            self._open[name] = Table(self.spark.createDataFrame([], schema), keys, name=name)
            self._changed.add(name)
        table = self._load(name)
        if keys is not None and ([keys] if isinstance(keys, str) else list(keys)) != table.keys:
            raise ValueError(f"{name!r} has the key {table.keys}")
        if schema is not None and [(f.name, f.dataType) for f in schema.fields] != [(f.name, f.dataType) for f in table.df.schema.fields]:
            table = table.with_df(migration.migrate(table.df, schema, table.keys))
            self.put(name, table)
        return self._load(name)

    def put(self, name: str, table: Table) -> Table:
        """Makes a changed table the one to commit."""
        self._name(name) if name != FILES else None
        self._open[name] = table
        self._catalog.setdefault(name, {"folder": None})
        self._catalog[name] |= {"keys": table.keys, "schema": table.df.schema.jsonValue(), "indexes": [asdict(i) for i in table.list_indexes()]}
        self._changed.add(name)
        return table

    def apply(self, name: str, ops: DataFrame) -> Table:
        """A mutation log on a table; all of it or, where a unique index would break, nothing."""
        return self.put(name, mutations.apply(self.open_table(name), ops))

    def tables(self) -> list[str]:
        return sorted(n for n in self._catalog if not n.startswith(INTERNAL))

    def exists(self, name: str) -> bool:
        return name in self._catalog and not name.startswith(INTERNAL)

    def descriptor(self, name: str) -> dict:
        t = self.open_table(name)
        return {"name": name, "keys": t.keys, "schema": t.df.schema.jsonValue(), "indexes": [asdict(i) for i in t.list_indexes()]}

    def rename(self, name: str, to: str) -> bool:
        """Nothing happens if the table is missing or the new name taken."""
        self._name(to)
        if not self.exists(name) or to in self._catalog:
            return False
        table = self._load(name)
        self._catalog[to] = self._catalog.pop(name)
        self._open[to] = Table(table.df, table.keys, table.list_indexes(), to)
        self._open.pop(name)
        if name in self._changed:
            self._changed.discard(name)
            self._changed.add(to)
        return True

    def drop(self, name: str) -> bool:
        if not self.exists(name):
            return False
        self._catalog.pop(name)
        self._open.pop(name, None)
        self._changed.discard(name)
        return True

    # Files

    def open_file(self, name: str) -> BlobFile:
        if FILES not in self._catalog:
            self.put(FILES, Table(self.spark.createDataFrame([], BLOB_SCHEMA), ["file", "block_no"], name=FILES))
        return BlobFile(self._load(FILES).df, name)

    def save_file(self, file: BlobFile) -> None:
        self.put(FILES, self._load(FILES).with_df(file.table()))

    # Commit

    def commit(self) -> None:
        """Writes what changed and adds the catalog. Without it nothing of it is seen after closing. CommitConflict if
        another writer has committed since this one read the catalog; then nothing is seen of this commit."""
        if self.path is None:
            self._changed.clear()
            return
        if (versions := self._versions()) and versions[-1] != self.version:
            raise CommitConflict(f"{self.path} is at version {versions[-1]}, this database was read at {self.version}: open it anew")
        for name in sorted(self._changed):
            table = self._open[name]
            folder = f"{name}/{uuid.uuid4().hex}"
            keys = [f"`{k}`" for k in table.keys]
            table.df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(f"{self.path}/{folder}")
            self._catalog[name]["folder"] = folder
            self._open.pop(name)
        self._changed.clear()
        self._write_catalog()

    def close(self) -> None:
        """Drops what was not committed."""
        self._open.clear()
        self._changed.clear()
        self._catalog = self._read_catalog()
