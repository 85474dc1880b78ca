"""Line dedup by a segment-partition edit join. DataFrame operations only.

Equal lines form classes, and so do lines within TAU edits of each other, one edit for every EDIT_CHARS characters of the
shorter at most; of every class only the first line stays. If a line is cut into
TAU + 1 segments, TAU edits leave one segment whole, so the other line has it as a substring, and its length and the
number of edits left bound where. Lines are indexed by their segments, probed by the substrings of those lengths at
those places (the multi-match-aware selection: 12 a line for 2 edits), and joined by equality. Pairs are verified by the
edit distance, computed bit-parallel in a band of 2 TAU + 1 diagonals.

Equal lines are one line throughout: they are counted, never paired. The join condition also compares letter counts, as
an edit changes at most two of them by one: lines that share a long segment but differ elsewhere never leave the join,
however many share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.llm.common import SPACE, cut, let
from keyloom.llm.components import components

TAU = 2
#: Characters for each edit allowed: lines under 16 class by equality only, for an edit makes another word of them, lines
#: under 32 by one edit. Blank lines are left alone.
EDIT_CHARS = 16
#: The letters whose counts, modulo 16, are compared.
LETTERS = "etaoinshrdlucmgp"
#: Candidate lines are looked up by broadcast up to so many, by a shuffle beyond.
BROADCAST_ROWS = 1_000_000


def _lines(docs: DataFrame, shortest: int = 1) -> DataFrame:
    """The lines of `shortest` characters or more: _d, _t (hash of the text: rows that repeat an id with another text are other documents), _i, line, _h, _g (two hashes)."""
    split = docs.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_t"), F.posexplode(F.split("text", "\n")).alias("_i", "_line"))
    split = split.where(F.length("_line") >= shortest).withColumn("_line", F.trim("_line", F.lit(SPACE))).where(F.length("_line") >= shortest)
    return split.withColumns({"_h": F.xxhash64("_line"), "_g": F.xxhash64(F.lit("2"), F.col("_line"))})


def _letter_counts(line: Column) -> Column:
    """The counts of LETTERS modulo 16, four bits each."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(LETTERS):
        n = (F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))).cast("long").bitwiseAND(F.lit(15).cast("long"))
        out = out.bitwiseOR(F.shiftleft(n, 4 * i))
    return out


def _letters_apart(a: Column, b: Column) -> Column:
    """A lower bound of the sum of the differences of all letter counts."""
    total = F.lit(0).cast("long")
    for i in range(len(LETTERS)):
        x, y = (F.shiftrightunsigned(c, 4 * i).bitwiseAND(F.lit(15).cast("long")) for c in (a, b))
        d = F.abs(x - y)
        total = total + F.least(d, F.lit(16).cast("long") - d)
    return total


def _segment(length: Column, i: int, tau: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i (from 0): the last ones are one longer where the length doesn't divide."""
    parts = tau + 1
    base, longer = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    short = F.lit(parts).cast("int") - longer
    start = F.lit(i) * base + F.greatest(F.lit(0), F.lit(i) - short) + 1
    return start.cast("int"), (base + F.when(F.lit(i) >= short, 1).otherwise(0)).cast("int")


def _keys(line: Column, length: Column, tau: int) -> tuple[list[Column], list[Column]]:
    """Hashes of the tau + 1 segments that index a line, and of the other substrings that probe for lines as long or
    shorter. (Probing for lines as long at the segments' own places is the index itself.)"""
    index, probe = [], []
    for i in range(tau + 1):
        start, size = _segment(length, i, tau)
        index.append(F.xxhash64(F.lit(i), length, F.substring(line, start, size)))
    for shorter in range(tau + 1):
        other = (length - shorter).cast("int")
        for i in range(tau + 1):
            start, size = _segment(other, i, tau)
            for shift in range(max(-i, shorter - (tau - i)), min(i, shorter + tau - i) + 1):
                if shorter or shift:
                    probe.append(F.xxhash64(F.lit(i), other, F.substring(line, (start + shift).cast("int"), size)))
    return index, probe


def edit_distance(a: Column, b: Column, tau: int = TAU) -> Column:
    """The edit distance of two strings if it is tau or less, else more than tau; strings at least tau long whose
    lengths differ by tau at most.

    Column by column of the dynamic programme, in the 2 tau + 1 rows around the diagonal: bit k of a word stands for row
    j - tau + k of column j, and the vertical differences (positive, negative) of a column follow from those of the one
    before by a few operations on words. The distance is followed down the lowest diagonal to the last row, and along it.
    """
    width = 2 * tau + 1
    full = (1 << width) - 1

    def bit(x: Column, k: Column) -> Column:
        return F.call_function("shiftright", x, k).bitwiseAND(F.lit(1).cast("long"))

    def word(x: int) -> Column:
        return F.lit(x).cast("long")

    def negated(x: Column) -> Column:
        return F.bitwise_not(x).bitwiseAND(word(full))

    def over(chars):
        m = F.size(chars)

        def step(s, c):
            def matched(eq):
                d0 = eq.bitwiseAND(s["vp"]) + s["vp"]
                d0 = d0.bitwiseXOR(s["vp"]).bitwiseOR(eq).bitwiseOR(s["vn"]).bitwiseAND(word(full))

                def moved(zero):
                    hp = s["vn"].bitwiseOR(negated(zero.bitwiseOR(s["vp"])))
                    hn = zero.bitwiseAND(s["vp"])
                    down = F.shiftright(zero, 1)
                    last = m - 1 - s["j"] + tau  # the bit of the pattern's last row
                    along = bit(hp, last) - bit(hn, last)
                    return F.struct(
                        (s["j"] + 1).alias("j"),
                        hn.bitwiseOR(negated(down.bitwiseOR(hp))).alias("vp"),
                        down.bitwiseAND(hp).alias("vn"),
                        (s["d"] + F.when(s["j"] < m - tau, word(1) - F.shiftright(zero, width - 1)).otherwise(along)).alias("d"),
                    )

                return let(d0, moved)

            eq = word(0)
            for k in range(width):
                eq = eq.bitwiseOR(F.when(F.coalesce(F.get(chars, s["j"] + (k - tau)) == c, F.lit(False)), word(1 << k)).otherwise(word(0)))
            return let(eq, matched)

        start = F.struct(F.lit(0).alias("j"), word(full >> tau << tau).alias("vp"), word(0).alias("vn"), word(tau).alias("d"))
        return F.aggregate(F.split(b, ""), start, step, lambda s: s["d"])

    return let(F.split(a, ""), over)


def _near_lines(lines: DataFrame, tau: int) -> DataFrame:
    """_h of the lines that share an index key with another line: those that can have a partner at all.

    Most lines can't, and only hashes are needed to tell, so texts are neither shuffled nor looked at closely for them.
    Lines are counted once however often they occur. Numbers alone are aggregated, which needs no sorting.
    """
    index, probe = _keys(F.col("_line"), F.length("_line"), tau)
    keys = {f"_{i}": k for i, k in enumerate([*index, *probe])}
    keyed = lines.select("_h", "_g", *[k.alias(c) for c, k in keys.items()])
    # One row a line. Where two lines have one hash, neither has partners.
    single = keyed.groupBy("_h").agg(*[F.min(c).alias(c) for c in keys], F.min("_g").alias("_g0"), F.max("_g").alias("_g1")).where("_g0 = _g1")
    each = single.select("_h", F.posexplode(F.array(*keys)).alias("_p", "_k"))
    same = W.partitionBy("_k")
    met = each.select("_h", F.min("_h").over(same).alias("_lo"), F.max("_h").over(same).alias("_hi"), F.min("_p").over(same).alias("_first"))
    return met.where((F.col("_lo") != F.col("_hi")) & (F.col("_first") <= tau)).select("_h").distinct()


def _texts(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """_h, _line of wanted lines."""
    small = wanted.count() <= BROADCAST_ROWS
    found = lines.select("_h", "_line").join(F.broadcast(wanted) if small else wanted, "_h", "left_semi")
    return cut(found.groupBy("_h").agg(F.first("_line").alias("_line")), "line-texts")


def line_links(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """a, b (hashes, a < b): all pairs of different lines within tau edits, one edit for every EDIT_CHARS characters of the
    shorter at most. Null texts have no lines; an empty table has no pairs."""
    lines = _lines(docs, EDIT_CHARS)
    texts = _texts(lines, cut(_near_lines(lines, tau), "line-ids"))
    index, probe = _keys(F.col("_line"), F.length("_line"), tau)
    keyed = cut(texts.select("_h", _letter_counts(F.col("_line")).alias("_c"), F.array(*index).alias("_index"), F.array(*probe).alias("_probe")), "line-keys")
    left = keyed.select(F.col("_h").alias("_ha"), F.col("_c").alias("_ca"), F.explode("_index").alias("_ka"))
    right = keyed.select(F.col("_h").alias("_hb"), F.col("_c").alias("_cb"), F.explode(F.concat("_index", "_probe")).alias("_kb"))
    close = (F.col("_ha") != F.col("_hb")) & (_letters_apart(F.col("_ca"), F.col("_cb")) <= 2 * tau)
    joined = left.join(right, (F.col("_ka") == F.col("_kb")) & close)
    pairs = cut(joined.select(F.least("_ha", "_hb").alias("a"), F.greatest("_ha", "_hb").alias("b")).distinct(), "line-pairs")
    both = pairs.join(texts.select(F.col("_h").alias("a"), F.col("_line").alias("_la")), "a").join(texts.select(F.col("_h").alias("b"), F.col("_line").alias("_lb")), "b")
    shorter = F.least(F.length("_la"), F.length("_lb"))
    allowed = F.least(F.lit(tau), F.floor(shorter / EDIT_CHARS))
    near = F.greatest(F.length("_la"), F.length("_lb")) - shorter <= allowed
    return cut(both.where(F.when(near, edit_distance(F.col("_la"), F.col("_lb"), tau) <= allowed).otherwise(F.lit(False))).select("a", "b"), "line-links")


def repeated_lines(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """docs(doc_id, text, ...) -> _d, _t (document), _i (line, from 0), class_doc, class_line, class_size, n_links: every
    line of a class of two lines or more, with the class's first line, and to how many different texts its text links.

    Null texts have no lines, a null doc_id comes after all others, rows equal in id and text are one document each; an
    empty table gives an empty result.
    """
    links = line_links(docs, tau)
    linked = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    of_links = degree.join(linked.withColumnRenamed("node", "_h"), "_h", "left").select(F.col("_h").alias("_lh"), F.coalesce("component", "_h").alias("component"), "_n")
    of_links = cut(of_links, "line-linked")
    # The lines' numbers, once: texts are parsed for them no more.
    lines = cut(_lines(docs).select("_d", "_t", "_i", "_h", "_g"), "lines")
    # Equal lines are told by two hashes. Only lines that repeat or have links go on; they are counted without sorting.
    per_line = lines.groupBy("_h", "_g").agg(F.count(F.lit(1)).alias("_size"))
    per_line = per_line.join(of_links, F.col("_h") == F.col("_lh"), "left").where((F.col("_size") > 1) | F.col("_lh").isNotNull())
    # Linked lines are one class by their component; a line without links is its own.
    own = F.col("_lh").isNull()
    klass = F.struct(F.coalesce("component", "_h").alias("c"), F.when(own, F.col("_g")).otherwise(F.lit(0)).alias("g"), own.alias("own"))
    per_line = per_line.select("_h", "_g", klass.alias("_class"), F.coalesce("_n", F.lit(0)).alias("n_links"))
    # Joined as two numbers: lines of very many copies are a skewed side, which adaptive execution splits.
    found = cut(lines.join(per_line, ["_h", "_g"]).select("_d", "_t", "_i", "_class", "n_links"), "line-classes")
    first = F.min(F.struct(F.col("_d").isNull().alias("null"), "_d", "_i", "_t")).alias("_f")
    named = found.groupBy("_class").agg(first, F.count(F.lit(1)).alias("class_size")).where("class_size > 1")
    return found.join(named, "_class").select("_d", "_t", "_i", F.col("_f._d").alias("class_doc"), F.col("_f._i").alias("class_line"), F.col("_f._t").alias("_ft"), "class_size", "n_links")


def _first_of_class() -> Column:
    return F.col("_d").eqNullSafe(F.col("class_doc")) & (F.col("_i") == F.col("class_line")) & (F.col("_t") == F.col("_ft"))


def line_report(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_lines, n_removed, n_links, removed (line numbers from 0, in order), classes
    (line, class_doc, class_line, class_size of each line that has others in its class), for every document.

    A line is a run of text between line feeds, compared without white space around it; blank lines are left alone. A
    class is what links of tau edits or fewer reach (one edit for every EDIT_CHARS characters of the shorter line at most, so
    that short lines class with their equals only), and its first line is that of the smallest doc_id (null last) and
    then the smallest number. Null texts have no lines. Rows equal in id and text share one report line
    each; an empty table gives an empty result. Columns of other names are ignored.
    """
    found = repeated_lines(docs, tau)
    row = F.struct(F.col("_i").alias("line"), "class_doc", "class_line", "class_size")
    per_doc = found.groupBy("_d", "_t").agg(
        F.sort_array(F.collect_set(F.when(~_first_of_class(), F.col("_i")))).alias("removed"),
        F.sort_array(F.collect_set(row)).alias("classes"),
        F.sum("n_links").alias("n_links"),
    )
    rows = docs.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_t"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"))
    rows = rows.withColumnsRenamed({"_d": "_rd", "_t": "_rt"}).join(per_doc, F.col("_rd").eqNullSafe(F.col("_d")) & (F.col("_rt") == F.col("_t")), "left")
    none = F.array().cast("array<int>")
    removed = F.coalesce("removed", none)
    empty = F.array().cast(per_doc.schema["classes"].dataType)
    return rows.select(F.col("_rd").alias("doc_id"), "n_lines", F.size(removed).alias("n_removed"), F.coalesce("n_links", F.lit(0)).alias("n_links"), removed.alias("removed"), F.coalesce("classes", empty).alias("classes"))


def dedup_lines(docs: DataFrame, tau: int = TAU, broadcast_rows: int = 300_000) -> DataFrame:
    """docs with repeated lines removed from the text, and all their columns. A document that lost lines and has only blank
    ones left goes; one that lost nothing stays whatever it is. Null and empty texts stay, null ids are kept, rows that
    repeat an id with another text are told apart by the text; columns of any name are kept; an empty table stays empty."""
    found = repeated_lines(docs, tau).where(~_first_of_class())
    gone = found.groupBy("_d", "_t").agg(F.collect_set("_i").alias("_gone")).withColumnRenamed("_d", "_gd")
    gone = cut(gone, "line-gone")
    if gone.count() <= broadcast_rows:  # some 50 MB of line numbers at most
        gone = F.broadcast(gone)
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    joined = docs.alias("d").join(gone.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g._gd")) & (F.xxhash64(F.col("d.text")) == F.col("g._t")), "left")
    left = F.array_join(F.filter(F.split(F.col("d.text"), "\n"), lambda x, i: ~F.array_contains(F.col("g._gone"), i)), "\n")
    text = F.when(F.col("g._gone").isNull(), F.col("d.text")).otherwise(left).alias("text")
    out = joined.select(*[text if n == "text" else c for n, c in zip(docs.columns, columns, strict=True)], F.col("g._gone").isNull().alias("_whole"))
    return out.where(F.col("_whole") | (F.length(F.trim("text", F.lit(SPACE))) > 0)).drop("_whole")
