"""Main text of web pages: markup structure, and a suffix array over each host's pages.

A page is read once into blocks of text, each with what the markup says of it: in an article (or main) element, dropped
(menus, adverts, forms, comments ...), or undecided. What is left of all pages of a host and kind (marked: with such an
element, or not) is concatenated as tokens; the suffix array, sorted by prefix doubling to as many tokens as a long
repeat has, puts suffixes that share that prefix side by side, and tells of every long run on how many pages it is.

* Without marks, blocks that runs of distinct pages cover for the most part go, and unique ones stay.
* Inside an article, articles quote each other, so two pages say little. A block goes if runs that half of the host's
  pages have cover it for the most part: share buttons, notices and authors' boxes that a template puts into articles.
  They are the smaller part of an article; where they would be the larger one, the pages are copies, and it stays.

Pages of a host are dealt in chunks of bounded size. Where a host has several, chunks exchange the hashes of their runs
with the number of pages, a range of hashes to a task, so that counts are those of the whole host however large it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import cut, ship

#: Tokens of a long repeat; the share of a block that repeats must cover for it to go.
RUN_TOKENS = 8
COVERED = 0.5
#: A run belongs to the template of a host's articles if so large a share of the pages, and so many pages, have it; a chunk
#: of TOLD_PAGES pages or more tells of runs that half that share of them have (pages are dealt by hash, so a run of half
#: the host's pages falls under that in a chunk with a probability under 1e-10), a smaller one of all.
TEMPLATE_SHARE, TEMPLATE_PAGES, TOLD_PAGES = 0.5, 3, 200
#: Characters of HTML in a chunk of a host, and hosts over that size that are broadcast.
CHUNK_CHARS = 6 << 20
BROADCAST_HOSTS = 100_000
#: In the place of a range of hashes: the number of a chunk's pages.
PAGES = -1
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

# HTML elements by their role, and the words in class, id and role attributes that name boilerplate.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html",
    "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "title", "tr", "ul",
}
DROPPED = {"head", "nav", "aside", "footer", "form", "button", "select", "option", "menu", "dialog", "svg", "canvas", "object", "audio", "video", "map", "search", "fieldset"}
BOILERPLATE = {
    "ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "dialog", "disclaimer", "disqus", "footer", "gdpr", "login", "masthead",
    "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "overlay", "pager", "pagination", "popup", "privacy", "promo",
    "promotion", "recommended", "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor",
    "sponsored", "subscribe", "toolbar", "widget",
}
#: What a start tag closes, if it is open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*)>?|[^<]+|<""", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z0-9]+")

DROP, OPEN, MAIN, ARTICLE = -1, 0, 1, 2


def _verdict(tag: str, attributes: str, inside: int) -> int:
    """What a start tag says of what it holds: DROP, MAIN, ARTICLE or OPEN (nothing)."""
    if tag in DROPPED or tag == "header" and inside < MAIN:
        return DROP
    role = ""
    if attributes.strip(" /"):
        for m in _NAMED.finditer(attributes):
            name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                return DROP
            if name in ("class", "id", "role"):
                if not BOILERPLATE.isdisjoint(_WORD.findall(value)):
                    return DROP
                role = value if name == "role" else role
    return ARTICLE if tag == "article" or role == "article" else MAIN if tag == "main" or role == "main" else OPEN


def blocks(html: str | None) -> list[tuple[int, str]]:
    """(DROP, OPEN, MAIN or ARTICLE, text) of each block of visible text, in page order."""
    out: list[tuple[int, str]] = []
    html = html or ""
    stack: list[tuple[str, int]] = []  # open elements and the verdict inside them
    parts: list[str] = []
    at, state = 0, OPEN

    def flush():
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((state, text))
            parts.clear()

    def close(tags: set[str], within: set[str] | None = None) -> bool:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return True
            if within and stack[i][0] in within:
                return False
        return False

    while m := _TOKEN.match(html, at):
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                parts.append(m[0])
            continue
        tag = tag.lower()
        if tag in BLOCK:
            flush()
        if m[1]:
            close({tag})
        elif tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        else:
            if tag in BLOCK and tag != "br":
                close({"p"}, BLOCK - {"p"})
            if tag in CLOSES:
                close(CLOSES[tag], {"ul", "ol", "dl", "table", "select"})
            if tag not in VOID and not m[3].endswith("/"):
                inside = stack[-1][1] if stack else OPEN
                verdict = _verdict(tag, m[3], inside)
                stack.append((tag, DROP if DROP in (inside, verdict) else max(inside, verdict)))
        state = stack[-1][1] if stack else OPEN
    flush()
    return out


def candidates(html: str | None) -> tuple[bool, list[str]]:
    """Whether a page has an article or main element, and the blocks that can be its main text: those of its articles, else
    of its main elements, else all that the markup does not drop."""
    found = blocks(html)
    best = max((state for state, _ in found), default=DROP)
    return best >= MAIN, [text for state, text in found if state == best > DROP]


class Runs:
    """The runs of `length` tokens in the token streams of pages: a number for each, and the pages that have it."""

    def __init__(self, streams: list[np.ndarray], length: int = RUN_TOKENS):
        self.length, self.sizes = length, np.array([len(p) for p in streams], np.int64)
        total = int(self.sizes.sum()) + len(streams)
        self.begins = np.cumsum(self.sizes + 1) - self.sizes - 1 if len(streams) else np.zeros(0, np.int64)
        self.page = np.repeat(np.arange(len(streams)), self.sizes + 1)
        text = np.empty(total, np.int64)
        top = max((int(p.max()) for p in streams if len(p)), default=0) + 1
        for i, (at, p) in enumerate(zip(self.begins.tolist(), streams, strict=True)):
            text[at : at + len(p)] = p
            text[at + len(p)] = top + i  # an end that nothing else equals
        # Prefix doubling: the rank of every suffix by its first 1, 2, 4 ... tokens.
        rank, known = text, 1
        while known < length:
            step = min(known, length - known)
            following = np.zeros(total, np.int64)
            following[: max(0, total - step)] = rank[step:] + 1
            _, rank = np.unique(rank * (following.max(initial=0) + 1) + following, return_inverse=True)
            known += step
        self.text = text
        self.order = np.argsort(rank, kind="stable")  # the suffix array, to that depth
        first = np.diff(rank[self.order], prepend=-1) != 0
        self.first = np.flatnonzero(first)
        # Pages come in order within a run: every change is another page.
        page = self.page[self.order]
        other = first | (np.diff(page, prepend=-1) != 0)
        self.pages = np.add.reduceat(other.astype(np.int64), self.first) if total else np.zeros(0, np.int64)

    def keys(self, which: np.ndarray, token_hashes: np.ndarray) -> np.ndarray:
        """Hashes of runs by their tokens' hashes, alike in all chunks."""
        h = np.zeros(len(which), np.uint64)
        for i in range(self.length):
            h = (h ^ token_hashes[self.text[self.order[self.first[which]] + i]]) * np.uint64(_MIX[i % len(_MIX)])
            h ^= h >> np.uint64(31)
        return h

    def cover(self, which: np.ndarray) -> list[np.ndarray]:
        """For each page, which tokens lie in one of the runs marked in `which`."""
        total = len(self.text)
        change = np.zeros(total + self.length, np.int32)
        begins = self.order[np.repeat(which, np.diff(np.append(self.first, total)))]
        np.add.at(change, begins, 1)
        np.add.at(change, begins + self.length, -1)
        covered = np.cumsum(change)[:total] > 0
        return [covered[b : b + n] for b, n in zip(self.begins.tolist(), self.sizes.tolist(), strict=True)]


def repeated(pages: list[list[int]], length: int = RUN_TOKENS) -> list[np.ndarray]:
    """For the token streams of pages, which tokens lie in a run of `length` or more that distinct pages share."""
    runs = Runs([np.array(p, np.int64) for p in pages], length)
    return runs.cover(runs.pages > 1)


def template_pages(pages: int) -> int:
    """On how many of a host's pages a run must be to belong to the template of its articles."""
    return max(TEMPLATE_PAGES, int(np.ceil(TEMPLATE_SHARE * pages)))


def keep_unique(blocks: list[str], cover: np.ndarray, marked: bool) -> tuple[str, int]:
    """The blocks of a page that repeated runs leave, and how many tokens the runs took."""
    kept, gone, at = [], 0, 0
    for text in blocks:
        n = text.count(" ") + 1
        if cover[at : at + n].mean() < COVERED:
            kept.append(text)
        else:
            gone += n
        at += n
    if marked and 2 * gone >= at:  # copies of an article, not a template
        return "\n".join(blocks), 0
    return "\n".join(kept), gone


def _tokens(texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
    """Pages' texts as numbers of their words, and the words."""
    ids: dict[str, int] = {}
    return [np.array([ids.setdefault(w, len(ids)) for w in t.split()], np.int64) for t in texts], list(ids)


def _hashes(words: list[str]) -> np.ndarray:
    from xxhash import xxh64_intdigest as xxh

    return np.fromiter((xxh(w) for w in words), np.uint64, len(words))


def chunk_texts(texts: list[str], marked: bool, pages: int, run_tokens: int = RUN_TOKENS, told: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[str, int]]:
    """Main text and number of tokens that repeated runs took, of pages of one host and kind, of which the host has `pages`.
    `told`: hashes of runs in order, and on how many of the host's pages they are."""
    streams, words = _tokens(texts)
    runs = Runs(streams, run_tokens)
    counts = runs.pages
    if told is not None and len(told[0]):
        keys = runs.keys(at := np.flatnonzero(_whole(runs)), _hashes(words))
        place = np.minimum(np.searchsorted(told[0], keys), len(told[0]) - 1)
        counts[at] = np.where(told[0][place] == keys, np.maximum(told[1][place], counts[at]), counts[at])
    covers = runs.cover(counts >= (template_pages(pages) if marked else 2))
    return [keep_unique(t.split("\n"), c, marked) if t else ("", 0) for t, c in zip(texts, covers, strict=True)]


def _whole(runs: Runs) -> np.ndarray:
    """Runs that end before their page does."""
    at = runs.order[runs.first]
    ends = (runs.begins + runs.sizes)[runs.page[at]] if len(at) else at
    return at + runs.length <= ends


def chunk_runs(texts: list[str], marked: bool, run_tokens: int = RUN_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """The runs that a chunk tells the other chunks of its host of: hashes in order, and on how many pages they are."""
    streams, words = _tokens(texts)
    runs = Runs(streams, run_tokens)
    enough = int(TEMPLATE_SHARE / 2 * len(texts)) if marked and len(texts) >= TOLD_PAGES else 1
    which = np.flatnonzero(_whole(runs) & (runs.pages >= enough))
    keys = runs.keys(which, _hashes(words))
    order = np.argsort(keys)
    return keys[order], runs.pages[which][order]


def main_texts(pages: DataFrame, run_tokens: int = RUN_TOKENS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """pages(page_id, url, html, ...) -> page_id, url, text, n_chars, n_repeated.

    The blocks of a page's article elements (of its main elements, if it has no article; of the whole page without what
    the markup drops, if it has neither), without those that repeated runs cover, references decoded, white space inside
    a block one space, blocks in page order joined by a line feed; n_repeated is the number of tokens in the blocks that
    the runs took. Null and empty pages have the empty text; pages without a host form one; every row counts as a page,
    repeats of an id too; other columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    ship(spark)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#@]*)", 1), F.lit("")))
    kind = pages.schema["page_id"].dataType.simpleString()

    def parsed(rows: DataFrame) -> DataFrame:
        """Columns page_id, url, html and numbers and strings -> marked and text in the place of html."""
        rest = rows.columns[3:]

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [candidates(h.as_py()) for h in batch.column(2)]
                columns = [pa.array([m for m, _ in found], pa.bool_()), pa.array(["\n".join(t) for _, t in found], pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns, *batch.columns[3:]], ["page_id", "url", "marked", "text", *rest])

        return rows.mapInArrow(read, f"page_id {kind}, url string, marked boolean, text string" + "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in rest))

    rows = pages.select("page_id", "url", "html", host.alias("host"), F.monotonically_increasing_id().alias("row"))
    sizes = rows.groupBy("host").agg(F.sum(F.length("html")).alias("chars")).where(F.col("chars") > chunk_chars)
    large = cut(sizes.select("host", F.ceil(F.col("chars") / chunk_chars).alias("parts")), "large-hosts")
    count = large.count()
    schema = f"page_id {kind}, url string, text string, n_chars long, n_repeated long"

    def result(chunk: pa.Table, found: list[tuple[str, int]]) -> pa.Table:
        texts = [t for t, _ in found]
        columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([n for _, n in found], pa.int64())]
        return pa.table([chunk.column("page_id"), chunk.column("url"), *columns], names=["page_id", "url", "text", "n_chars", "n_repeated"])

    def whole(chunk: pa.Table) -> pa.Table:
        return result(chunk, chunk_texts(chunk.column("text").to_pylist(), chunk.column("marked")[0].as_py(), chunk.num_rows, run_tokens))

    if not count:
        return parsed(rows.drop("row")).groupBy("host", "marked").applyInArrow(whole, schema)

    held = F.broadcast(large) if count <= BROADCAST_HOSTS else large
    small = parsed(rows.drop("row").join(held, "host", "left_anti").select("page_id", "url", "html", "host"))
    small = small.groupBy("host", "marked").applyInArrow(whole, schema)
    spread = F.pmod(F.xxhash64("page_id", "url", "row"), "parts")  # equal rows are told apart
    chunks = parsed(rows.join(held, "host").select("page_id", "url", "html", "host", "parts", spread.alias("part")))

    def send(chunk: pa.Table) -> pa.Table:
        first = {c: chunk.column(c)[0].as_py() for c in ("host", "marked", "part", "parts")}
        keys, counts = chunk_runs(chunk.column("text").to_pylist(), first["marked"], run_tokens)
        # As many ranges of hashes as chunks: the top bits, scaled.
        edges = np.searchsorted((keys >> np.uint64(32)) * np.uint64(first["parts"]) >> np.uint64(32), np.arange(first["parts"] + 1, dtype=np.uint64))
        told = [(r, pack_runs(keys[lo:hi], counts[lo:hi])) for r, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)) if hi > lo]
        told.append((PAGES, pack_runs(np.zeros(1, np.uint64), np.array([chunk.num_rows]))))
        return pa.table({
            "host": pa.array([first["host"]] * len(told), pa.string()), "marked": pa.array([first["marked"]] * len(told), pa.bool_()),
            "range": pa.array([r for r, _ in told], pa.int64()), "part": pa.array([first["part"]] * len(told), pa.int64()), "runs": pa.array([b for _, b in told], pa.binary()),
        })

    def answer(chunk: pa.Table) -> pa.Table:
        told = [unpack_runs(b.as_py()) for b in chunk.column("runs")]
        distinct, place = np.unique(np.concatenate([k for k, _ in told]), return_inverse=True)
        totals = np.bincount(place, weights=np.concatenate([n for _, n in told])).astype(np.int64)
        out, at = [], 0
        for keys, counts in told:
            total = totals[place[at : at + len(keys)]]
            at += len(keys)
            more = (total > counts) | (chunk.column("range")[0].as_py() == PAGES)
            out.append(pack_runs(keys[more], total[more]))
        return chunk.select(["host", "marked", "range", "part"]).append_column("runs", pa.array(out, pa.binary()))

    def judge(key: tuple, chunk: pa.Table, answers: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return result(chunk, [])
        told = [(r, *unpack_runs(b.as_py())) for r, b in zip(answers.column("range").to_pylist(), answers.column("runs"), strict=True)]
        pages_of_host = sum(int(n[0]) for r, _, n in told if r == PAGES)
        keys = np.concatenate([np.zeros(0, np.uint64), *[k for r, k, _ in told if r != PAGES]])
        totals = np.concatenate([np.zeros(0, np.int64), *[n for r, _, n in told if r != PAGES]])
        order = np.argsort(keys)
        found = chunk_texts(chunk.column("text").to_pylist(), chunk.column("marked")[0].as_py(), pages_of_host, run_tokens, (keys[order], totals[order]))
        return result(chunk, found)

    runs = chunks.groupBy("host", "marked", "part").applyInArrow(send, "host string, marked boolean, range long, part long, runs binary")
    answers = runs.groupBy("host", "marked", "range").applyInArrow(answer, "host string, marked boolean, range long, part long, runs binary")
    both = chunks.groupBy("host", "marked", "part").cogroup(answers.groupBy("host", "marked", "part"))
    return small.union(both.applyInArrow(judge, schema))


def pack_runs(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Hashes in order as differences, and small counts, compressed."""
    import zstandard

    body = np.diff(keys, prepend=np.zeros(1, np.uint64)).tobytes() + counts.astype(np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpack_runs(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint64)
    half = len(body) // 2
    return np.cumsum(body[:half], dtype=np.uint64), body[half:].astype(np.int64)
