"""Virtual files: byte streams kept as rows (file, block_no, data) of 2 KB blocks. Missing blocks read as zeros."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 2048
SCHEMA = "file string, block_no long, data binary"


class BlobFile(io.RawIOBase):
    """A seekable file over a table of blocks. Reads fetch only the blocks they touch; writes are kept until flush()
    gives the table with them."""

    def __init__(self, blocks: DataFrame, name: str):
        super().__init__()
        self.blocks, self.name, self.at = blocks, name, 0
        self.changed: dict[int, bytes] = {}
        self.cut_to: int | None = None  # blocks from here on are gone
        last = self._own().orderBy(F.col("block_no").desc()).limit(1).select("block_no", F.length("data").alias("n")).collect()
        self.size = last[0]["block_no"] * BLOCK + last[0]["n"] if last else 0

    def _own(self) -> DataFrame:
        return self.blocks.where(F.col("file") == self.name)

    def readable(self) -> bool:
        return True

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        to = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence]
        if to < 0:
            raise ValueError("before the beginning")
        self.at = to
        return to

    def _load(self, first: int, last: int) -> dict[int, bytes]:
        wanted = self._own().where(F.col("block_no").between(first, last))
        if self.cut_to is not None:
            wanted = wanted.where(F.col("block_no") < self.cut_to)
        found = {r["block_no"]: bytes(r["data"]) for r in wanted.select("block_no", "data").collect()}
        return found | {b: d for b, d in self.changed.items() if first <= b <= last}

    def read(self, n: int = -1) -> bytes:
        end = self.size if n is None or n < 0 else min(self.size, self.at + n)
        if end <= self.at:
            return b""
        first, last = self.at // BLOCK, (end - 1) // BLOCK
        have = self._load(first, last)
        whole = b"".join(have.get(b, b"").ljust(BLOCK, b"\0") for b in range(first, last + 1))
        out = whole[self.at - first * BLOCK : end - first * BLOCK]
        self.at = end
        return out

    def write(self, data) -> int:
        data = bytes(data)
        if not data:
            return 0
        first, last = self.at // BLOCK, (self.at + len(data) - 1) // BLOCK
        edges = {b: d for x in {first, last} for b, d in self._load(x, x).items()}
        start = first * BLOCK
        head = edges.get(first, b"").ljust(BLOCK, b"\0")[: self.at - start]
        tail_at = self.at + len(data) - last * BLOCK
        body = head + data + edges.get(last, b"")[tail_at:]
        for i, b in enumerate(range(first, last + 1)):
            self.changed[b] = body[i * BLOCK : (i + 1) * BLOCK]
        self.at += len(data)
        self.size = max(self.size, self.at)
        return len(data)

    def truncate(self, size: int | None = None) -> int:
        """Sets the length; longer reads as zeros."""
        size = self.at if size is None else size
        blocks = -(-size // BLOCK)
        if size < self.size:
            edge = self._load(blocks - 1, blocks - 1).get(blocks - 1, b"") if blocks else b""
            self.changed = {b: d for b, d in self.changed.items() if b < blocks}
            self.cut_to = blocks if self.cut_to is None else min(self.cut_to, blocks)
            if blocks:
                self.changed[blocks - 1] = edge.ljust(BLOCK, b"\0")[: size - (blocks - 1) * BLOCK]
        elif size > self.size:
            edge = self._load(blocks - 1, blocks - 1).get(blocks - 1, b"")
            self.changed[blocks - 1] = edge.ljust(size - (blocks - 1) * BLOCK, b"\0")
        self.size = size
        return size

    def zero(self, count: int) -> None:
        """Writes zeros."""
        self.write(bytes(count))

    def table(self) -> DataFrame:
        """The table of blocks with what was written."""
        mine = F.col("file") == self.name
        gone = F.col("block_no").isin(list(self.changed))
        if self.cut_to is not None:
            gone = gone | (F.col("block_no") >= self.cut_to)
        kept = self.blocks.where(~(mine & gone))
        new = self.blocks.sparkSession.createDataFrame([(self.name, b, bytearray(d)) for b, d in sorted(self.changed.items())], SCHEMA)
        return kept.unionByName(new)


def assemble(blocks: DataFrame) -> DataFrame:
    """file, content of every file, gaps as zeros: whole files in one row each, for files that fit one."""
    hexed = F.sort_array(F.collect_list(F.struct("block_no", "data")))
    grouped = blocks.groupBy("file").agg(hexed.alias("b"))
    padded = F.transform(
        F.sequence(F.lit(0).cast("long"), F.element_at("b", -1)["block_no"]),
        lambda i: F.coalesce(F.get(F.filter("b", lambda x: x["block_no"] == i), F.lit(0))["data"], F.lit(b"")),
    )
    last = F.size(padded) - 1
    text = F.array_join(F.transform(padded, lambda d, i: F.when(i < last, F.rpad(F.hex(d), 2 * BLOCK, "0")).otherwise(F.hex(d))), "")
    return grouped.select("file", F.unhex(text).alias("content"))
