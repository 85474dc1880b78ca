"""Removal of byte strings that occur in an earlier document, by a distributed merge sort of sampled suffixes.

Two documents share a string of LENGTH bytes exactly if windows of theirs are equal. Every window is represented by its
smallest GRAM-byte string (by hash); neighbouring windows mostly have the same one, so a text becomes a list of
*stretches*: consecutive windows with one smallest gram, the stretch's anchor. Equal windows have equal anchors, so only
the suffixes that begin at anchors need sorting, about one in fourteen, and only those whose anchor occurs twice.

1. Documents are packed into runs of a few MB, written once.
2. Each run sends its sorted anchor hashes, as deltas; a task a hash range answers each run which of its anchors occur in
   more than one document.
3. Each run sorts the suffixes at those anchors (with the left part of the stretch behind them), collapses equal ones to
   their smallest document, and sends them front-coded, a range of anchor hashes to a task. A loser tree merges
   the runs: an entry's common prefix with the last one of its run came with it, so entries are told apart by the lengths
   of common prefixes where those differ and are compared only past the prefix known to be common.
4. In merged order equal stretches meet and those with one anchor are neighbours. For every window the smallest document
   that has it goes back to the runs that need it, and each run marks and removes bytes.

A stretch that very many documents share is one entry a run. Nothing is compared pair by pair.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import cut, ship

LENGTH = 50
GRAM = 24
#: Windows whose grams are hashed at a time.
BLOCK = 1 << 15
#: Bytes of text in a run, and sampled suffixes that a hash range is to hold.
RUN_BYTES = 4 << 20
RANGE_ROWS = 250_000
#: An id for order only: a null doc_id comes after all others and is smaller than none.
NO_ID = np.iinfo(np.int64).max
#: Bits of an anchor's hash that step 2 exchanges.
KEY_BITS = 40
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _pack(value) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(value, protocol=5))


def _unpack(blob: bytes):
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def gram_hashes(buf: bytes | memoryview) -> np.ndarray:
    """A hash of the GRAM bytes from every position on. The three words are read in place."""
    n = len(buf) - GRAM + 1
    words = [np.ndarray((n,), "<u8", buffer=buf, offset=o, strides=(1,)) for o in range(0, GRAM, 8)]
    h = words[0] * np.uint64(_MIX[0])
    for w, m in zip(words[1:], _MIX[1:], strict=True):
        h ^= h >> np.uint64(29)
        h += w
        h *= np.uint64(m)
    h ^= h >> np.uint64(32)
    h *= np.uint64(_MIX[0])
    h ^= h >> np.uint64(29)
    return h


class Stretches:
    """The stretches of a run's texts: key (the anchor's hash), start, n (windows), doc (index in the run).

    The texts are hashed in blocks that stay in the processor's cache. The grams' hashes themselves are kept on request.
    """

    def __init__(self, texts: list[bytes], length: int = LENGTH, keep_hashes: bool = False):
        self.buf = b"".join(texts)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
        begins = ends - np.array([len(t) for t in texts], np.int64) if texts else ends
        self.begins, self.ends, self.length = begins, ends, length
        total = max(0, len(self.buf) - length + 1)  # windows, those across documents included
        if not total:
            self.key = np.zeros(0, np.uint64)
            self.start = self.n = self.doc = np.zeros(0, np.int64)
            return
        span = length - GRAM + 1
        self.hashes = np.empty(total + span - 1 if keep_hashes else 0, np.uint64)
        keys, starts = [], []
        before = None
        view = memoryview(self.buf)
        for lo in range(0, total, BLOCK):
            hi = min(total, lo + BLOCK)
            low = gram_hashes(view[lo : hi + length - 1])
            if keep_hashes:
                self.hashes[lo : lo + len(low)] = low
            step = 1
            while step * 2 <= span:
                low = np.minimum(low[:-step], low[step:])
                step *= 2
            if step < span:
                low = np.minimum(low[: len(low) - (span - step)], low[span - step :])
            new = np.flatnonzero(low[1:] != low[:-1]) + 1
            if before is None or low[0] != before:
                new = np.concatenate(([0], new))
            keys.append(low[new])
            starts.append(new + lo)
            before = low[-1]
        key, start = np.concatenate(keys), np.concatenate(starts)
        end = np.append(start[1:], total)
        # Cut at the documents, and only windows that lie within one.
        ok = np.flatnonzero(ends - begins >= length)
        first = np.searchsorted(end, begins[ok], side="right")
        count = np.searchsorted(start, ends[ok] - length, side="right") - first
        doc = np.repeat(ok, count)
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(doc))
        self.key, self.doc = key[at], doc
        self.start = np.maximum(start[at], begins[doc])
        self.n = np.minimum(end[at], ends[doc] - length + 1) - self.start

    def anchors(self, which: np.ndarray) -> np.ndarray:
        """Where in its stretch the anchor is: the leftmost one of the last window."""
        span = self.length - GRAM + 1
        out = np.empty(len(which), np.int64)
        for i in range(0, len(which), 1 << 16):
            w = which[i : i + (1 << 16)]
            last = self.start[w] + self.n[w] - 1
            same = self.hashes[last[:, None] + np.arange(span)] == self.key[w][:, None]
            out[i : i + len(w)] = last + same.argmax(axis=1) - self.start[w]
        return out

    def bytes_of(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.start[i] + self.n[i] + self.length - 1]

    def content(self, which) -> np.ndarray:
        """XXH64 of the bytes of stretches."""
        from xxhash import xxh64_intdigest as xxh

        buf, s = self.buf, self.start[which]
        e = s + self.n[which] + self.length - 1
        return np.fromiter((xxh(buf[a:b]) for a, b in zip(s.tolist(), e.tolist(), strict=True)), np.uint64, len(s))

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct short keys in order, whether more than one document has each, and each stretch's place among them."""
        short = self.key >> np.uint64(64 - KEY_BITS)
        distinct, place = np.unique(short, return_inverse=True)
        low, high = np.full(len(distinct), len(self.ends), np.int64), np.full(len(distinct), -1, np.int64)
        np.minimum.at(low, place, self.doc)
        np.maximum.at(high, place, self.doc)
        return distinct, high > low, place


def range_of(short: np.ndarray, ranges: int) -> np.ndarray:
    return ((short >> np.uint64(KEY_BITS - 32)) * np.uint64(ranges)) >> np.uint64(32)


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix of two strings that agree in the first `known` bytes."""
    n = min(len(a), len(b)) - known
    differ = int.from_bytes(a[known : known + n]) ^ int.from_bytes(b[known : known + n])
    return known + n - (differ.bit_length() + 7) // 8


def front_code(entries: list[bytes]) -> tuple[bytes, list[int], list[int]]:
    """Sorted strings -> what each adds to its predecessor, the lengths of that, and the common prefixes."""
    tails, shared, before = [], [], b""
    for e in entries:
        p = common_prefix(before, e, 0)
        tails.append(e[p:])
        shared.append(p)
        before = e
    return b"".join(tails), list(map(len, tails)), shared


def front_decode(tails: bytes, lengths, shared) -> Iterator[bytes]:
    """The strings again, one at a time."""
    at, before = 0, b""
    for n, p in zip(lengths, shared, strict=True):
        before = before[:p] + tails[at : at + n]
        at += n
        yield before


def merge(runs: list[tuple[Iterable[bytes], list[int]]]) -> Iterator[tuple[bytes, int, int, int]]:
    """Merges sorted runs (strings, common prefixes with the predecessor) with a loser tree -> string, run, index in
    the run, common prefix with the string before it in the merged order. Of each run only the next string is held.

    Every string at a leaf knows its common prefix with the last winner. Of two, the one with the longer prefix is the
    smaller; only equal prefixes need a comparison, which starts behind them and gives the loser its prefix with the
    winner. The string that follows the winner in its run has its prefix with it from the front coding.
    """
    k = len(runs)
    if not k:
        return
    size = 1 << max(0, k - 1).bit_length()
    at = [0] * k
    following = [iter(strings) for strings, _ in runs]
    head: list[bytes | None] = [next(f, None) for f in following] + [None] * (size - k)
    known = [0] * size
    loser = [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        x, y = head[a], head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        win, lose = (b, a) if y < x or y == x and b < a else (a, b)
        known[lose] = common_prefix(x, y, known[a])
        return win, lose

    row = list(range(size))
    level = size
    while level > 1:
        level //= 2
        played = [play(row[2 * i], row[2 * i + 1]) for i in range(level)]
        loser[level : 2 * level] = [lose for _, lose in played]
        row = [win for win, _ in played]
    winner = row[0]
    while (x := head[winner]) is not None:
        i = at[winner]
        yield x, winner, i, known[winner]
        at[winner] = i = i + 1
        head[winner] = x = next(following[winner], None)
        if x is not None:
            known[winner] = p = runs[winner][1][i]
        else:
            p = 0
        # Up to the root. Most games are told by the known prefixes alone.
        node = (winner + size) >> 1
        while node:
            other = loser[node]
            y = head[other]
            if y is not None:
                q = known[other]
                if x is None or q > p:
                    loser[node], winner, x, p = winner, other, y, q
                elif q == p:
                    winner, loser[node] = play(winner, other)
                    x, p = head[winner], known[winner]
            node >>= 1


def _packed(docs: DataFrame, run_bytes: int) -> DataFrame:
    """Documents in runs: run_id (from the content), ids, and payload (the texts and ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        ids: list[int | None] = []
        texts: list[bytes] = []
        size, part = 0, 0

        def out():
            seed = xxhash.xxh3_64_intdigest(b"\0".join([repr(ids).encode(), str(part).encode(), b"".join(texts)]))
            row = [pa.array([seed - (1 << 63)], pa.int64()), pa.array([size], pa.int64()), pa.array([_pack((ids, texts))], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["run_id", "size", "payload"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                texts.append(t.as_py() or b"")
                size += len(texts[-1])
                if size >= run_bytes:
                    yield out()
                    ids, texts, size, part = [], [], 0, part + 1
        if ids:
            yield out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("t")).mapInArrow(run, "run_id long, size long, payload binary")


def _order(ids: list[int | None]) -> np.ndarray:
    """Ids for comparison: null as NO_ID."""
    return np.array([NO_ID if i is None else i for i in ids], np.int64)


def _split(values: np.ndarray, of_range: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Slices of sorted values by range."""
    if len(values):
        edges = np.flatnonzero(np.append(True, of_range[1:] != of_range[:-1]))
        for lo, hi in zip(edges, np.append(edges[1:], len(values)), strict=True):
            yield int(of_range[lo]), slice(int(lo), int(hi))


def _rows(batches, names: str, kinds) -> Iterator[pa.RecordBatch]:
    for row in batches:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names.split())


LONG, BIN = pa.int64(), pa.binary()


def repeated_bytes(docs: DataFrame, length: int = LENGTH, run_bytes: int = RUN_BYTES, keep_text: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that are left).

    A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller doc_id; strings
    are judged on the input and never cross documents. Texts are whole UTF-8 texts, null ones empty. A null doc_id is
    larger than any other; rows that repeat an id do not count against each other. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    assert length >= GRAM + 8
    runs = cut(_packed(docs, run_bytes), "runs")
    total = runs.agg(F.sum("size")).first()[0] or 0
    ranges = max(1, int(total * 2 / (length - GRAM + 2) / RANGE_ROWS))

    def send_keys(batches):
        for batch in batches:
            for run_id, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                distinct, several, _ = Stretches(_unpack(blob.as_py())[1], length).keys()
                yield from _rows(
                    ((r, run_id, _pack((distinct[s.start], _deltas(distinct[s]), np.packbits(several[s])))) for r, s in _split(distinct, range_of(distinct, ranges))),
                    "part run_id blob",
                    (LONG, LONG, BIN),
                )

    def answer_keys(table: pa.Table) -> pa.Table:
        ids, found = table.column("run_id").to_pylist(), []
        several = []
        for blob in table.column("blob"):
            first, deltas, flags = _unpack(blob.as_py())
            keys = np.concatenate(([0], np.cumsum(deltas, dtype=np.uint64))).astype(np.uint64) + np.uint64(first)
            found.append(keys)
            several.append(np.unpackbits(flags, count=len(keys)).astype(bool))
        every = np.sort(np.concatenate([*found, *[k[s] for k, s in zip(found, several, strict=True)]]))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        blobs = [_pack(np.packbits(twice[np.minimum(np.searchsorted(twice, k), len(twice) - 1)] == k if len(twice) else np.zeros(len(k), bool))) for k in found]
        return pa.table({"part": table.column("part"), "run_id": pa.array(ids, LONG), "blob": pa.array(blobs, BIN)})

    keys = runs.select("run_id", "payload").mapInArrow(send_keys, "part long, run_id long, blob binary")
    answers = keys.groupBy("part").applyInArrow(answer_keys, "part long, run_id long, blob binary")
    answers = answers.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("part", "blob"))).alias("answers"))

    def send_suffixes(batches):
        for batch in batches:
            for run_id, blob, said in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                ids, texts = _unpack(blob.as_py())
                s = Stretches(texts, length, keep_hashes=True)
                distinct, _, place = s.keys()
                twice = np.zeros(len(distinct), bool)
                said = {x["part"]: x["blob"] for x in said.as_py() or []}
                for r, part in _split(distinct, range_of(distinct, ranges)):
                    twice[part] = np.unpackbits(_unpack(said[r]), count=part.stop - part.start).astype(bool)
                which = np.flatnonzero(twice[place]) if len(place) else np.zeros(0, np.int64)
                ids = _order(ids)
                content = s.content(which)
                # One entry for equal stretches: that of the smallest document.
                order = np.lexsort((ids[s.doc[which]], content))
                which, content = which[order], content[order]
                keep = np.append(True, content[1:] != content[:-1]) if len(which) else np.zeros(0, bool)
                which, content = which[keep], content[keep]
                entries = []
                for i, a, c, key, doc in zip(which.tolist(), s.anchors(which).tolist(), content.tolist(), s.key[which].tolist(), ids[s.doc[which]].tolist(), strict=True):
                    text = s.bytes_of(i)
                    entries.append((key.to_bytes(8) + text[a:] + text[:a] + a.to_bytes(4), c, doc))
                entries.sort()
                short = np.array([int.from_bytes(e[0][:5]) for e in entries], np.uint64)
                yield from _rows(
                    ((r, run_id, _pack((*_small(front_code([e[0] for e in entries[p]])), np.array([e[1] for e in entries[p]], np.uint64), np.array([e[2] for e in entries[p]], np.int64)))) for r, p in _split(short, range_of(short, ranges))),
                    "part run_id blob",
                    (LONG, LONG, BIN),
                )

    def merge_suffixes(table: pa.Table) -> pa.Table:
        run_ids = table.column("run_id").to_pylist()
        runs_, content, owner = [], [], []
        for blob in table.column("blob"):
            tails, lengths, shared, c, ids = _unpack(blob.as_py())
            shared = shared.tolist()  # mostly under 256: numbers that Python has once
            runs_.append((front_decode(tails, lengths.tolist(), shared), shared))
            content.append(c)
            owner.append(ids)
        news: list[list[tuple[int, int, int | list[int]]]] = [[] for _ in run_ids]

        def settle(group: list[tuple[bytes, int, list[tuple[int, int]]]]) -> None:
            """Stretches with one anchor: (string, smallest document, places)."""
            key = int.from_bytes(group[0][0][:8])
            if len(group) == 1:
                _, least, places = group[0]
                for r, i in places:
                    if owner[r][i] > least:
                        news[r].append((key, int(content[r][i]), least))
                return
            # From the smallest document on: the first to name a window is its smallest.
            seen: dict[bytes, int] = {}
            for string, least, places in sorted(group, key=lambda g: g[1]):
                a = int.from_bytes(string[-4:])
                body = string[8:-4]
                text = body[len(body) - a :] + body[: len(body) - a]
                windows = [seen.setdefault(text[j : j + length], least) for j in range(len(text) - length + 1)]
                low = min(windows)
                said = low if low == max(windows) else windows
                for r, i in places:
                    if owner[r][i] > low:
                        news[r].append((key, int(content[r][i]), said))

        group: list[tuple[bytes, int, list[tuple[int, int]]]] = []
        for string, r, i, shared in merge(runs_):
            doc = int(owner[r][i])
            if group and shared == len(string) == len(group[-1][0]):
                last = group[-1]
                last[2].append((r, i))
                if doc < last[1]:
                    group[-1] = (last[0], doc, last[2])
                continue
            if group and shared < 8:
                settle(group)
                group = []
            group.append((string, doc, [(r, i)]))
        if group:
            settle(group)
        out = [(i, _pack(news_)) for i, news_ in zip(run_ids, news, strict=True) if news_]
        return pa.table({"run_id": pa.array([x[0] for x in out], LONG), "blob": pa.array([x[1] for x in out], BIN)})

    payload = runs.select("run_id", "payload")
    suffixes = payload.join(answers, "run_id", "left").mapInArrow(send_suffixes, "part long, run_id long, blob binary")
    news = suffixes.groupBy("part").applyInArrow(merge_suffixes, "run_id long, blob binary")
    news = news.groupBy("run_id").agg(F.collect_list("blob").alias("news"))

    def remove(batches):
        for batch in batches:
            for blob, said in zip(batch.column(1), batch.column(2), strict=True):
                ids, texts = _unpack(blob.as_py())
                s = Stretches(texts, length)
                own = _order(ids)
                told = [x for blob in said.as_py() or [] for x in _unpack(blob)]
                # The stretches that can repeat: several documents of this run have the anchor, or there is news of it.
                short, several, place = s.keys()
                several[np.searchsorted(short, np.array([x[0] >> (64 - KEY_BITS) for x in told], np.uint64))] = True
                which = np.flatnonzero(several[place]) if len(place) else np.zeros(0, np.int64)
                # The smallest document known for each of them, or for each of its windows: in this run, then elsewhere.
                content = s.content(which)
                distinct, place = np.unique(content, return_inverse=True)
                least = np.full(len(distinct), NO_ID, np.int64)
                np.minimum.at(least, place, own[s.doc[which]])
                by_window: dict[int, list[int]] = {}
                for _, c, low in told:
                    if isinstance(low, list):
                        by_window[c] = low
                    else:
                        at = np.searchsorted(distinct, np.uint64(c))
                        least[at] = min(least[at], low)
                gone = np.zeros(len(s.buf) + 1, np.int32)
                whole = which[least[place] < own[s.doc[which]]]
                np.add.at(gone, s.start[whole], 1)
                np.add.at(gone, s.start[whole] + s.n[whole] + length - 1, -1)
                for i, c in zip(which.tolist(), content.tolist(), strict=True):
                    if c in by_window:
                        hit = s.start[i] + np.flatnonzero(np.array(by_window[c], np.int64) < own[s.doc[i]])
                        np.add.at(gone, hit, 1)
                        np.add.at(gone, hit + length, -1)
                gone = np.cumsum(gone[:-1]) > 0
                edges = np.diff(gone.astype(np.int8), prepend=0)
                buf = np.frombuffer(s.buf, np.uint8)
                rows: dict[str, list] = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
                for i, lo, hi in zip(ids, s.begins.tolist(), s.ends.tolist(), strict=True):
                    g = gone[lo:hi]
                    left = buf[lo:hi][~g].tobytes()
                    rows["doc_id"].append(i)
                    rows["n_bytes"].append(hi - lo)
                    rows["n_removed"].append(hi - lo - len(left))
                    rows["n_spans"].append(int((edges[lo + 1 : hi] == 1).sum()) + bool(len(g) and g[0]))
                    rows["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                    rows["kept"].append(left if keep_text else None)
                kinds = (LONG, LONG, LONG, LONG, pa.string(), BIN)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], list(rows))

    out = payload.join(news, "run_id", "left").mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if keep_text else out.drop("kept")


def _deltas(keys: np.ndarray) -> np.ndarray:
    d = np.diff(keys)
    return d.astype(np.uint32) if not len(d) or d.max() < 1 << 32 else d


def _small(coded: tuple[bytes, list[int], list[int]]) -> tuple[bytes, np.ndarray, np.ndarray]:
    tails, lengths, shared = coded
    kind = np.uint8 if max([0, *lengths, *shared]) < 256 else np.uint32
    return tails, np.array(lengths, kind), np.array(shared, kind)
