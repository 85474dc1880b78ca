"""Token counts by prefix dynamic programming.

For byte-pair encoding the last token of a prefix's encoding follows from shorter prefixes: it is the one token t ending
there for which (last token of the shorter prefix, t) is a pair that encoding the two together leaves as it is. So one
pass over a word gives the exact count at each of its prefixes, and the counts answer every question about truncation
and budgets without encoding again. What holds of a prefix holds of it in every word that begins with it: a table of
prefixes gives the last token and the count, and a new word is worked out only from the longest prefix that is known.

White space never lies inside a token and takes no part in one, so a text is the sum of its white-space separated
pieces. The distinct pieces of a batch are found once, by dictionary encoding, and a worker remembers their counts: its
tables are bounded and start anew when they are full.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import SPACE, ship

#: Entries of each of a worker's tables: pieces, words, prefixes, pairs of tokens. Longer strings than KNOWN_CHARS are not entered.
CACHE = 400_000
KNOWN_CHARS = 64
#: Bytes of text whose distinct pieces are found at a time (a longer text is taken whole).
SLICE_BYTES = 8 << 20


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable Latin-1 ones for themselves, the others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class PrefixCounter:
    """Exact token counts of a text and of all its prefixes, for a tokenizers file of BPE with an end-of-word suffix,
    a lower-casing normaliser and a pattern that drops white space."""

    def __init__(self, spec: str):
        import regex

        said = json.loads(spec)
        model = said["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab = set(model["vocab"])
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        # How each token came about; where two merges make the same token, pairs are told by encoding them.
        self.made = {a + b: (i, a, b) for (a, b), i in self.ranks.items()}
        self.one_way = len(self.made) == len(self.ranks)
        pattern = next(p["pattern"]["Regex"] for p in said["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        special = [t["content"] for t in said["added_tokens"]]
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")")
        self.hint = min((t[:2].encode() for t in special), default=b"\0")
        self.alphabet = byte_alphabet()
        self.longest = max(len(t.removesuffix(self.end)) for t in self.vocab)
        self.inner_tokens = {t for t in self.vocab if not t.endswith(self.end)}
        self.end_tokens = {t.removesuffix(self.end) for t in self.vocab if t.endswith(self.end)}
        self.pairs: dict[tuple[str | None, str], bool] = {}
        self.prefixes_known: dict[str, tuple[str | None, int]] = {"": (None, 0)}  # last token, tokens
        self.words: dict[str, int] = {}
        self.pieces: dict[bytes, int] = {}

    def _merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE of a few symbols, to tell whether a pair of tokens holds."""
        while len(symbols) > 1:
            rank, i = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 60:
                break
            symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]
        return symbols

    def _symbols(self, token: str) -> list[str]:
        bare = token.removesuffix(self.end)
        symbols = list(bare)
        if token.endswith(self.end) and symbols:
            symbols[-1] += self.end
        return symbols

    def _holds(self, before: str | None, token: str) -> bool:
        """Encoding the two together gives the two (or, with nothing before, encoding the token gives it)."""
        key = (before, token)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            if before and self.one_way:
                known = self._keeps(before, token)
            else:
                parts = [*(self._symbols(before) if before else []), *self._symbols(token)]
                known = self._merge(parts) == ([before, token] if before else [token])
            self.pairs[key] = known
        return known

    def _keeps(self, left: str, right: str) -> bool:
        """No merge across the border of two tokens comes before the merges that made them. Their merges are undone from
        the latest on; what then touches the border must not have a merge earlier than the one undone."""
        made, ranks, limit = self.made, self.ranks, 1 << 60
        while True:
            if ranks.get((left, right), limit) < limit:
                return False
            x, y = made.get(left), made.get(right)
            if x is not None and (y is None or x[0] > y[0]):
                limit, left = x[0], x[2]
            elif y is not None:  # of two merges of one rank the left one comes first
                limit, right = y[0] + 1, y[1]
            else:
                return True

    def _states(self, word: str) -> list[tuple[str | None, int]]:
        """For the prefixes of 0, 1, ... characters, as beginnings of a longer word: the last token and the count."""
        known, inner, pairs, longest = self.prefixes_known, self.inner_tokens, self.pairs, self.longest
        short = len(word) <= KNOWN_CHARS
        k = len(word) if short else 0
        while word[:k] not in known:
            k -= 1
        found = [known[word[:i]] for i in range(k + 1)]
        if short and len(known) >= CACHE:
            known.clear()
            known.update((word[:i], x) for i, x in enumerate(found))
        for i in range(k + 1, len(word) + 1):
            for j in range(i - longest if i > longest else 0, i):
                token = word[j:i]
                if token in inner:
                    before, n = found[j]
                    if (holds := pairs.get((before, token))) is None:
                        holds = self._holds(before, token)
                    if holds:
                        break
            else:
                raise ValueError(f"no encoding of {word[:i]!r}")
            found.append((token, n + 1))
            if short:
                known[word[:i]] = found[i]
        return found

    def _ended(self, word: str, states: list[tuple[str | None, int]]) -> int:
        """The count of a word, from the states of its prefixes."""
        n = len(word)
        for j in range(max(0, n - self.longest), n):
            if word[j:] in self.end_tokens and self._holds(states[j][0], word[j:] + self.end):
                return states[j][1] + 1
        raise ValueError(f"no encoding of {word!r}")

    def word(self, word: str) -> int:
        """The count of one pre-token in the byte alphabet."""
        if (known := self.words.get(word)) is None:
            known = self._ended(word, self._states(word[:-1]))
            if len(word) <= KNOWN_CHARS:
                if len(self.words) >= CACHE:
                    self.words.clear()
                self.words[word] = known
        return known

    def word_prefixes(self, word: str) -> list[int]:
        """Counts of the prefixes of 0, 1, ... characters of one pre-token in the byte alphabet, each encoded as a word."""
        states, out = self._states(word[:-1]), [0]
        for i in range(1, len(word) + 1):
            for j in range(max(0, i - self.longest), i):
                if word[j:i] in self.end_tokens and self._holds(states[j][0], word[j:i] + self.end):
                    out.append(states[j][1] + 1)
                    break
            else:
                raise ValueError(f"no encoding of {word[:i]!r}")
        return out

    def _normal(self, text: str) -> str:
        text = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case without regard to the word's end
        return text.lower()

    def _bytes(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else "".join([self.alphabet[b] for b in word.encode()])

    def _plain(self, text: str) -> int:
        """The count of a text without special tokens."""
        return sum([self.word(self._bytes(w)) for w in self.pattern.findall(self._normal(text))])

    def piece(self, piece: bytes) -> int:
        """The count of a text without ASCII white space."""
        text = piece.decode("utf-8", "replace")
        if self.hint not in piece:
            return self._plain(text)
        return sum(1 if self.special.fullmatch(part) else self._plain(part) for part in self.special.split(text))

    def _known(self, piece: bytes) -> int:
        if (n := self.pieces.get(piece)) is None:
            n = self.piece(piece)
            if len(piece) <= KNOWN_CHARS:
                if len(self.pieces) >= CACHE:
                    self.pieces.clear()
                self.pieces[piece] = n
        return n

    def count(self, text: bytes | None) -> int:
        return sum(map(self._known, (text or b"").split()))

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The counts of a column of binary texts without nulls."""
        strings = pc.cast(texts, options=pc.CastOptions(target_type=pa.large_string(), allow_invalid_utf8=True))
        pieces = pc.ascii_split_whitespace(strings)
        coded = pieces.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
        each = np.fromiter(map(self._known, distinct), np.int64, len(distinct))
        sums = np.concatenate(([0], np.cumsum(each[np.asarray(coded.indices)])))
        ends = np.asarray(pieces.offsets, np.int64) - pieces.offsets[0].as_py()
        return sums[ends[1:]] - sums[ends[:-1]]

    def _plain_prefixes(self, text: str) -> tuple[list[int], int]:
        """Counts of text[:0], text[:1], ... for a text without special tokens, and where its last
        pre-token begins (the last that begins with a character of the text)."""
        if not unicodedata.is_normalized("NFC", text):
            # A prefix may end within what normalisation composes: pre-token by pre-token, each prefix of one anew.
            out, begin, done = [0], 0, 0
            for x in range(1, len(text) + 1):
                low = self._normal(text[begin:x])
                words = list(self.pattern.finditer(low))
                # The last character begins a pre-token, composes with nothing and is no part of a contraction.
                whole = unicodedata.normalize("NFC", text[begin : x - 1]) + text[x - 1] == unicodedata.normalize("NFC", text[begin:x])
                if len(words) > 1 and words[-1].start() == len(low) - 1 and len(self._normal(text[x - 1])) == 1 and whole and "'" not in text[max(0, x - 3) : x]:
                    done, begin, words = out[x - 1], x - 1, words[-1:]
                out.append(done + sum(self.word(self._bytes(w[0])) for w in words))
            return out, begin
        if text.isascii():
            low, at = text.lower(), list(range(len(text) + 1))
        else:
            chars = [self._normal(c) for c in text]
            low, at = "".join(chars), [0, *accumulate(map(len, chars))]
        bounds = set(at)
        out, done, ended, begin = [0] * (len(low) + 1), 0, 0, 0
        for m in self.pattern.finditer(low):
            out[ended : m.start() + 1] = [done] * (m.start() + 1 - ended)  # characters that belong to no token
            word = m[0]
            if word[0] == "'" and word[-1].isalpha():  # a contraction, two or three characters; cut short, it is none
                counts = [self._plain(word[:x]) for x in range(len(word) + 1)]
            else:
                counts = self.word_prefixes(self._bytes(word))
                if not word.isascii():
                    counts = [counts[b] for b in [0, *accumulate(len(c.encode()) for c in word)]]
            out[m.start() : m.end() + 1] = [done + n for n in counts]
            done, ended = done + counts[-1], m.end()
            begin = m.start() if m.start() in bounds else begin  # one character may become two
        out[ended:] = [done] * (len(low) + 1 - ended)
        return [out[x] for x in at], at.index(begin)

    def prefixes(self, text: str) -> list[int]:
        """The exact count of text[:p] for p = 0, 1, ..., len(text). A surrogate counts as the replacement character."""
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if not text.isascii() else text
        out, i = [0], 0
        for piece in _PIECES.findall(text):
            base = out[-1]
            if piece[0] in SPACE:
                out += [base] * len(piece)
                continue
            begin, done, word, before = 0, base, 0, base
            for m in self.special.finditer(piece):
                plain, last = self._plain_prefixes(piece[begin : m.start()])
                out += [done + n for n in plain[1:]]
                word, before = begin + last, done + plain[last]
                # Cut short, a special token is plain text that may go on with the pre-token before it.
                out += [before + self._plain(piece[word:x]) for x in range(m.start() + 1, m.end())]
                done += plain[-1] + 1
                out.append(done)
                begin = m.end()
            out += [done + n for n in self._plain_prefixes(piece[begin:])[0][1:]]
        return out


def longest_prefix(counts: list[int], budget: int) -> int:
    """The most characters whose token count is within the budget."""
    return max(p for p, n in enumerate(counts) if n <= budget)


_PIECES = re.compile(rf"[{SPACE}]+|[^{SPACE}]+")
_counters: dict[int, PrefixCounter] = {}


def _counter(spec: str) -> PrefixCounter:
    key = hash(spec)
    if key not in _counters:
        _counters.clear()
        _counters[key] = PrefixCounter(spec)
    return _counters[key]


def _spec(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())  # a vocabulary file: a few MB whatever the input


def slices(sizes: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes; a row is never split."""
    group = (np.cumsum(sizes) - sizes) // most
    edges = np.flatnonzero(np.diff(group, prepend=-1))
    yield from zip(edges.tolist(), [*edges[1:].tolist(), len(sizes)], strict=True)


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_bytes, n_tokens, over_limit.

    Null texts count as empty ones: 0 bytes, 0 tokens. Rows that repeat an id stay separate rows, other columns are
    ignored, and an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    spec = _spec(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(spec.value)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), b"")
            sizes = np.asarray(pc.binary_length(texts), np.int64)
            n = np.concatenate([np.zeros(0, np.int64), *[counter.counts(texts.slice(lo, hi - lo)) for lo, hi in slices(sizes)]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("t")).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def prefix_tables(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, counts: the token count of every prefix of the text, by code points from 0.

    A null or empty text has the one count 0. Rows that repeat an id stay separate rows, null ids are kept, other columns
    are ignored, and an empty table gives an empty result. Time and space grow with the text's length, but for a pre-token
    that is not in normal form C: each of its prefixes is counted anew.
    """
    ship(docs.sparkSession)
    spec = _spec(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(spec.value)
        for batch in batches:
            for i in range(batch.num_rows):  # a table is as long as its text: one row at a time
                counts = counter.prefixes((batch.column(1)[i].as_py() or b"").decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([counts], pa.list_(pa.int32()))], ["doc_id", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("t")).mapInArrow(run, f"doc_id {kind}, counts array<int>")


def truncate(docs: DataFrame, path: str, budget: int) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, text, n_tokens: the longest prefix of each text within the budget, read off the
    prefix table of its own row.

    Null texts come back empty with 0 tokens. Rows that repeat an id stay separate rows, each with its own text; null ids
    are kept, other columns are ignored, and an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    spec = _spec(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(spec.value)
        for batch in batches:
            texts = [(t.as_py() or b"").decode("utf-8", "replace") for t in batch.column(1)]
            kept = []
            for t in texts:
                counts = counter.prefixes(t)
                p = longest_prefix(counts, budget)
                kept.append((t[:p], counts[p]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["doc_id", "text", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("t")).mapInArrow(run, f"doc_id {kind}, text string, n_tokens bigint")
