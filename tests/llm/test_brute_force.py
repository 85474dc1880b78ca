"""Operators against brute force on small tables."""

import collections
import hashlib
import itertools
import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from keyloom.llm import components, contamination, lines, mixing, pages, quality, rules, simhash, suffixes, tokens, toxicity

SPACE = " \t\n\x0b\x0c\r"
DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def classes(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, s, n, letters="abé"):
    s = list(s)
    for _ in range(n):
        at, kind = rng.randrange(len(s)), rng.randrange(3)
        if kind == 0:
            s.insert(at, rng.choice(letters))
        elif kind == 1:
            del s[at]
        else:
            s[at] = rng.choice(letters)
    return "".join(s)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {n: c for n, c in classes({x for p in links for x in p}, links).items() if n != c}
    assert got == want


# Line dedup


def test_edit_distance(spark):
    rng = random.Random(4)
    pairs = []
    while len(pairs) < 150:
        a = "".join(rng.choice("abé") for _ in range(rng.randint(33, 50)))
        b = changed(rng, a, rng.randrange(5))
        if abs(len(a) - len(b)) <= 2:
            pairs.append((a, b))
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lines.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(min(r["d"], 3) == min(edits(r["a"], r["b"]), 3) for r in rows)


def test_line_report(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcde fgé") for _ in range(n)).strip().ljust(n, "z") for n in (3, 9, 14, 15, 16, 17, 20, 25, 30, 31, 32, 33, 34, 40, 41, 47, 55)]
    texts = ["\n".join(rng.choice([changed(rng, rng.choice(base), rng.randrange(4)), rng.choice(base), "short", "", f" {rng.choice(base)} \r"]) for _ in range(rng.randrange(5))) for _ in range(60)]
    rows = [*enumerate(texts), (None, base[10]), (90, None), (7, base[11])]
    seen = [(i, j, line.strip(SPACE), t) for i, t in rows if t for j, line in enumerate(t.split("\n")) if line.strip(SPACE)]
    distinct = sorted({s[2] for s in seen})
    links = [(a, b) for a, b in itertools.combinations(distinct, 2) if abs(len(a) - len(b)) <= 2 and edits(a, b) <= min(2, min(len(a), len(b)) // 16)]
    of = classes(distinct, links)
    groups = collections.defaultdict(list)
    for i, j, line, _ in seen:
        groups[of[line]].append((i is None, i or 0, j))
    first = {c: min(g) for c, g in groups.items()}
    want = []
    for i, t in rows:
        mine = [(j, line.strip(SPACE)) for j, line in enumerate((t or "").split("\n")) if line.strip(SPACE)]
        gone = [j for j, line in mine if (i is None, i or 0, j) != first[of[line]] or (i, t) == (7, base[11])]
        want.append((i, gone))
    got = [(r["doc_id"], list(r["removed"])) for r in lines.line_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert [g for g in sorted(got, key=repr) if g[0] != 7] == [w for w in sorted(want, key=repr) if w[0] != 7]
    assert len(links) > 5


def test_short_lines_class_by_fewer_edits(spark):
    rows = [(1, "Menu\n\nShare this\nMenu"), (2, " Menu \n \nMenus\nx"), (3, "x\n" + "z" * 31 + "\n" + "z" * 31), (4, "z" * 30 + "y\n" + "q" * 32), (5, "q" * 31 + "r")]
    got = {r["doc_id"]: (r["removed"], r["n_links"]) for r in lines.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ([3], 0), 2: ([0], 0), 3: ([0, 2], 2), 4: ([0], 2), 5: ([0], 1)}


def test_documents_keep_what_is_left(spark):
    long = "\n".join(f"line {i} of a long text that is quoted in full by another one" + "abcdefghij"[i % 10] * 9 for i in range(40))
    rows = [(1, long), (2, long + "\nand one line of its own"), (3, "\n" + long + "\n \t\n"), (4, "Menu\n\nMenu"), (5, " \n"), (6, None)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: got[1], 2: "and one line of its own", 4: "Menu\n", 5: " \n", 6: None}


# Quality rules


def test_base_counts(spark):
    rng = random.Random(6)
    texts = ["", "a", "a b a b a", "a b c a b c", "x x x", "x x x x", "a\na\n \n\na b", None, "#* $% <a|b>&", "a b c d a b c e b c d"]
    texts += [" ".join(rng.choice("ab" if k % 2 else "abcdefgh") for _ in range(rng.randrange(60))) for k in range(40)]
    texts += [" ".join(f"w{(i * i) % 97}" for i in range(3000)), "\n".join(["same line here"] * 30 + ["other"])]
    got = {r["doc_id"]: r for r in rules.base_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = t.split()
        counts = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k for j in range(len(w) - 2) if counts[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        worded = [x for x in t.split("\n") if x.split()]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(worded) - len(set(worded)), len(covered))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t


def test_em_finds_the_junk(spark):
    names = ["x", "y", "z"]
    patterns = [((1, 1, 1), 700), ((1, 1, -1), 100), ((0, 1, 1), 60), ((1, 0, 1), 50), ((1, 1, 0), 40), ((0, 1, -1), 5)]
    df = spark.createDataFrame([(*p, n) for p, n in patterns], "v_x int, v_y int, v_z int, n long")
    model = rules.fit(df, names)
    scored = {tuple(r[:3]): r["q"] for r in df.withColumn("q", rules.posterior(model, names)).select("v_x", "v_y", "v_z", "q").collect()}
    assert all((q > 0.9) == (0 not in p) for p, q in scored.items()) and abs(model[0][0] - 800 / 955) < 0.05


@tables
def test_good_documents_are_kept(spark):
    from keyloom.llm.common import read

    got = rules.judge(read(spark, DATA, "documents")).join(read(spark, DATA, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id").where("not base_failed")
    table = {(r["label"], r["kept"]): r["count"] for r in got.groupBy("label", "kept").count().collect()}
    assert table.get((1, False), 0) == 0 and table.get((0, True), 0) <= 0.2 * table.get((0, False), 1)


# Decontamination


def test_containment(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(j, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 5, 6, 12, 30, 70])))) for j in range(30)] + [(99, None), (3, "W1 w2")]
    docs = []
    for i in range(80):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            x = (rng.choice(items)[1] or "").split()
            if x and rng.random() < 0.6:
                x[rng.randrange(len(x))] = "zz"
            at = rng.randrange(len(w) + 1)
            w[at:at] = x
        docs.append((i, " ".join(w)))
    want = []
    for (i, t), (j, item) in itertools.product(docs, items):
        w, v = t.lower().split(), (item or "").lower().split()
        if n := min(5, len(v)):
            a, b = ({tuple(x[k : k + n]) for k in range(len(x) - n + 1)} for x in (v, w))
            if len(a & b) >= 0.8 * len(a) - 1e-9:
                want.append((i, j, len(a), len(a & b)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(r)[:4] for r in contamination.contained(d, b).collect()) == sorted(want)
    hit = {w[0] for w in want}
    assert sorted(r["doc_id"] for r in contamination.decontaminate(d, b).collect()) == [i for i, _ in docs if i not in hit]


def test_blocks_of_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(contamination, "BLOCK_CHARS", 30)
    items = spark.createDataFrame([(j, f"a{j} b{j} c{j} d{j} e{j} f{j}") for j in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(f"a{j} b{j} c{j} d{j} e{j} f{j}" for j in range(9))), (2, "none")], "doc_id long, text string")
    assert contamination.contained(docs, items).count() == 9 and contamination.decontaminate(docs, items).count() == 1


def test_texts_are_sent_once_and_come_back_in_pieces(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "cast(null as string) as lang", "if(id % 7 = 0, 'x a b c d e y', if(id % 11 = 0, null, cast(unhex('66FF20C3') as string))) as Text", "id as n")
    items = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    out = contamination.decontaminate(docs, items)
    assert "as bytes" not in out._jdf.queryExecution().toString() and out.schema.simpleString() == docs.schema.simpleString()
    got = out.selectExpr("doc_id", "lang", "hex(Text) as t", "n").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(i, None, None if i % 11 == 0 else "66FF20C3", i) for i in range(3000) if i % 7]

    index = contamination.Index([(1, b"a b c d e")])
    for kind in (pa.string(), pa.large_string()):
        text = pa.array(["x a b c d e y", None, "\u00df"] * 1000, kind)
        parts = list(contamination.clean_rows([pa.record_batch([text.slice(1), pa.array(range(2999))], ["text", "i"])], index, 0))
        assert max(p.num_rows for p in parts) <= contamination.STEP and [i for p in parts for i in p.column(1).to_pylist()] == [i for i in range(2999) if i % 3 != 2]


# Pages


def test_page_structure():
    found = pages.blocks('<body><div class="cookie-notice">Hi<p>x</div><header><h1>Site</h1></header><main><h1>T &amp; x</h1><p class=ad>buy<p>one <b>two</b>\n three<ul><li>a<li>b</ul><section id="comments"><p>c</section><form>f</form><p>t < 3 &amp;&amp; a<b></main><script>var a="</p>";</script><aside>s</aside><p title="a>b">tail<!-- no -->')
    assert found == [(-1, "Hi"), (-1, "x"), (-1, "Site"), (1, "T & x"), (-1, "buy"), (1, "one two three"), (1, "a"), (1, "b"), (-1, "c"), (-1, "f"), (1, "t < 3 && a"), (-1, "s"), (0, "tail")]


def test_repeated_runs():
    rng = random.Random(1)
    for _ in range(40):
        streams = [[rng.randrange(3) for _ in range(rng.randrange(40))] for _ in range(4)]
        n = rng.choice([1, 2, 3, 5, 8])
        seen = collections.defaultdict(set)
        for i, p in enumerate(streams):
            for j in range(len(p) - n + 1):
                seen[tuple(p[j : j + n])].add(i)
        for p, got in zip(streams, pages.repeated(streams, n), strict=True):
            want = [any(len(seen[tuple(p[j : j + n])]) > 1 for j in range(max(0, k - n + 1), min(k, len(p) - n) + 1)) for k in range(len(p))]
            assert got.tolist() == want


def test_boilerplate_without_markup(spark):
    notice = "<p>This site keeps a record of every visit that you pay to it, please take note.</p>"
    rows = [(i, "http://h.example/x", f"<body>{notice}<p>{' '.join(f'p{i}w{k}' for k in range(30))}</p>") for i in range(4)]
    rows += [(9, "http://h.example/y", f"<article>{notice}</article>"), (10, "http://other.example/", f"<body>{notice}")]
    got = {r["page_id"]: r["text"] for r in pages.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].startswith(f"p{i}w0 ") and "site" not in got[i] for i in range(4))
    assert got[9].startswith("This site") and got[10].startswith("This site")  # an article's own words, and another host's only page


def brute_main_text(rows, chosen, length=8):
    """The rules of main_texts, run by run, for pages given as (id, host, marked, blocks)."""
    groups, out = collections.defaultdict(list), {}
    for r in rows:
        groups[r[1], r[2]].append(r)
    for (_, marked), group in groups.items():
        on = collections.defaultdict(set)
        for i, _, _, texts in group:
            w = " ".join(texts).split()
            for j in range(len(w) - length + 1):
                on[tuple(w[j : j + length])].add(i)
        need = max(3, -(-len(group) // 2)) if marked else 2
        for i, _, _, texts in group:
            w = " ".join(texts).split()
            cover = [chosen and any(len(on[tuple(w[j : j + length])]) >= need for j in range(max(0, k - length + 1), min(k, len(w) - length) + 1)) for k in range(len(w))]
            kept, gone, at = [], 0, 0
            for t in texts:
                n = len(t.split())
                if 2 * sum(cover[at : at + n]) >= n:
                    gone += n
                else:
                    kept.append(t)
                at += n
            out[i] = "\n".join(texts if marked and 2 * gone >= at else kept)
    return out


def host_pages(seed):
    """Pages of two hosts, marked and not, with a template's blocks, quotes of other pages and whole copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    share, box = {h: prose(14) for h in "ab"}, {h: prose(9) for h in "ab"}
    rows = []
    for i in range(90):
        h, marked = rng.choice("aab"), rng.random() < 0.6
        texts = [prose(rng.randint(1, 40)) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.8:
            texts.insert(rng.randrange(len(texts) + 1), share[h])
        if rng.random() < 0.3:
            texts.append(box[h])
        if rows and rng.random() < 0.2:
            texts.append(rng.choice(rng.choice(rows)[3]))
        if rows and rng.random() < 0.1:
            texts = list(rng.choice(rows)[3])
        rows.append((i, h, marked, texts))
    return rows


@pytest.mark.parametrize("chunk", [1 << 20, 700])
def test_main_texts_equal_brute_force(spark, chunk):
    rows = host_pages(3)
    html = [(i, f"http://{h}.example/{i}", "<nav>Home</nav>" + ("<article>" if m else "") + "".join(f"<p>{t}" for t in texts)) for i, h, m, texts in rows]
    found = pages.main_texts(spark.createDataFrame(html, "page_id long, url string, html string").repartition(3), chunk_chars=chunk)
    got = {r["page_id"]: r["text"] for r in found.collect()}
    assert got == brute_main_text(rows, True)
    # Without the suffix arrays' runs, marked pages and others come out otherwise.
    plain = brute_main_text(rows, False)
    assert {m for i, _, m, _ in rows if got[i] != plain[i]} == {True, False}
    # With chunks this small a run is told across them: within one alone too few pages have it.
    assert len({h for _, h, _, _ in rows}) == 2


# SimHash


def test_fingerprint():
    text = "The cat sat on THE mat and the cat sat"
    w = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(simhash.shingle_hashes(text.encode(), 3, 42)) & (1 << 64) - 1 == want
    assert simhash.fingerprint(simhash.shingle_hashes(b"two words", 3, 42)) & (1 << 64) - 1 == xxhash.xxh64_intdigest("two words", 42)
    assert simhash.fingerprint(simhash.shingle_hashes(None, 3, 42)) == 0


def test_spark_hash_is_the_same(spark):
    got = spark.sql("select xxhash64('the cat sat')").first()[0]
    assert got & (1 << 64) - 1 == xxhash.xxh64_intdigest("the cat sat", 42)


@pytest.mark.parametrize("most", [2, 3, 4, 5])
def test_links(spark, most):
    rng = random.Random(most)
    values = [rng.getrandbits(64) for _ in range(60)]
    for x in list(values):
        for _ in range(3):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 6)):
                y ^= 1 << b
            values.append(y)
    values = sorted({x - (1 << 64) if x >> 63 else x for x in values})
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in values], "fp long"), most).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(values, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= most}


def test_copies_are_found(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    docs, group = [], {}
    for g in range(40):
        w = [word() for _ in range(rng.randint(80, 300))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            v = list(w)
            for _ in range(len(v) // 100):
                v[rng.randrange(len(v))] = word()
            group[len(docs)] = g
            docs.append((len(docs), " ".join(v)))
    kept = [r["doc_id"] for r in simhash.drop_copies(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()]
    first = {g: min(i for i, x in group.items() if x == g) for g in set(group.values())}
    assert set(first.values()) <= set(kept)  # no group is lost
    assert len(kept) <= len(first) + 2  # and few copies are missed


def test_copies_inside_a_large_family_are_found(spark):
    rng = random.Random(12)
    base = [f"b{i}" for i in range(300)]
    docs = [[f"n{rng.getrandbits(40)}" if rng.random() < 0.05 else w for w in base] for _ in range(500)]
    for w in docs[:100]:  # a copy of some members, with two words changed
        docs.append(list(w))
        for at in rng.sample(range(300), 2):
            docs[-1][at] = f"n{rng.getrandbits(40)}"
    rng.shuffle(docs)
    prints = [simhash.word_fingerprints(" ".join(w).encode()) for w in docs]
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in docs]
    links = []
    for i, j in itertools.combinations(range(len(docs)), 2):
        if any(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in zip(prints[i], prints[j], strict=True)):
            both = len(shingles[i] & shingles[j])
            if both >= 0.8 * (len(shingles[i]) + len(shingles[j]) - both) - 1e-9:
                links.append((i, j))
    want = [n for n, c in classes(range(len(docs)), links).items() if n == c]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string").repartition(3)
    assert len(links) > 80 and sorted(r["doc_id"] for r in simhash.drop_copies(df).collect()) == want


def test_crowded_signatures_lose_no_link(spark):
    rng = random.Random(21)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(60):
        w = [f"n{rng.getrandbits(40)}" if rng.random() < 0.02 else x for x in base]
        for _ in range(2):
            w = list(w)
            w[rng.randrange(len(w))] = f"n{rng.getrandbits(40)}"
            texts.append(w)
    prints = [simhash.word_fingerprints(" ".join(w).encode()) for w in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    near = {
        (i, j)
        for i, j in itertools.combinations(range(len(texts)), 2)
        if any(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in zip(prints[i], prints[j], strict=True))
    }
    links = {(i, j) for i, j in near if 1.8 * len(sets[i] & sets[j]) >= 0.8 * (len(sets[i]) + len(sets[j])) - 1e-9}
    rows = spark.createDataFrame([(i, bytearray(" ".join(w).encode())) for i, w in enumerate(texts)], "t long, x binary")
    nodes = spark.createDataFrame([(i, None, p) for i, p in enumerate(prints)], "t long, c long, fps array<long>")
    plain, crowded = ({tuple(r) for r in simhash.candidate_links(rows, nodes, 5, 0.8, crowd=n).collect()} for n in (10**6, 2))
    assert plain == near
    assert links and links <= crowded <= near
    assert len(crowded) < len(near) / 2  # of a family only pairs that may be similar leave the join


# Classifiers


@tables
def test_quality_on_held_out_documents(spark):
    from keyloom.llm.common import read

    rows = quality.score(read(spark, DATA.replace("0.001", "0.01"), "documents"), read(spark, DATA.replace("0.001", "0.01"), "labels")).collect()
    got = {r["doc_id"]: r for r in rows}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [(got[r["doc_id"]]["score"], r["quality"]) for r in read(spark, DATA.replace("0.001", "0.01"), "labels").collect() if got[r["doc_id"]]["held_out"]]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert sum(s >= 0.3 for s in good) >= 0.97 * len(good)
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.95


@tables
def test_toxicity_on_held_out_documents(spark):
    from keyloom.llm.common import read

    d = DATA.replace("0.001", "0.1")
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    got = {r["doc_id"]: r for r in toxicity.severity(docs, labels).drop("text").collect()}
    held = [(got[r["doc_id"]], r["toxic"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    toxic, clean = [x["toxic"] for x, t in held if t], [x["toxic"] for x, t in held if not t]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean)
    assert all(0 <= r["severity"] <= 3 and 0 <= r["grade"] <= 3 for r in got.values())


def test_risk_and_prior():
    rng = np.random.default_rng(3)
    sp, su = rng.random(50), rng.random(80)
    on_good, on_bad = quality.risk(sp, su, 0.4)
    assert abs(on_good - 0.4 * sum(-math.log(x) for x in sp) / 50) < 1e-9
    assert abs(on_bad - (sum(-math.log(1 - x) for x in su) / 80 - 0.4 * sum(-math.log(1 - x) for x in sp) / 50)) < 1e-9
    # Good documents about 1, bad ones about -1: the share is found without seeing a bad label.
    make = lambda good, n: rng.normal(1 if good else -1, 0.5, (n, len(quality.FEATURES)))
    for share in (0.3, 0.8):
        n = 2000
        good = make(True, n)
        mixed = np.concatenate([make(True, int(share * n)), make(False, n - int(share * n))])
        edges = quality.cuts(mixed)
        assert abs(quality.class_prior(good, mixed, edges) - share) < 0.06
        model = quality.fit(good, mixed, share, edges, 300)
        assert (model.score(make(True, 500)) >= 0.5).mean() > 0.95 and (model.score(make(False, 500)) < 0.5).mean() > 0.95
        x = make(True, 3)
        by_hand = [1 / (1 + math.exp(-(model.weights[-1] + sum(model.weights[sum(len(e) for e in edges[:f]) + j] for f in range(len(edges)) for j in range(len(edges[f])) if row[f] >= edges[f][j])))) for row in x]
        assert np.allclose(model.score(x), by_hand)


def test_cumulative_link_likelihood():
    rng = np.random.default_rng(4)
    linear, grade = rng.normal(0, 2, 40), rng.integers(0, 4, 40)
    t = np.array([-0.5, 0.3, 1.7])
    loss, by_linear, by_t = toxicity.likelihood(linear, t, grade)
    sigma = lambda z: 1 / (1 + math.exp(-z))
    for i, (x, y) in enumerate(zip(linear, grade, strict=True)):
        p = (sigma(x - t[y - 1]) if y else 1) - (sigma(x - t[y]) if y < 3 else 0)
        assert abs(loss[i] + math.log(p)) < 1e-9
    h = 1e-5
    moved = lambda dx, dt: toxicity.likelihood(linear + dx, t + dt, grade)[0]
    assert np.allclose((moved(h, 0) - moved(-h, 0)) / (2 * h), by_linear, atol=1e-5)
    for k in range(3):
        d = np.eye(3)[k] * h
        assert np.allclose((moved(0, d) - moved(0, -d)) / (2 * h), by_t[:, k], atol=1e-5)


def test_thresholds_are_ordered():
    import numpy as np

    rows = [(np.array([i % 3]), np.array([1 + i % 2]), 10) for i in range(60)]
    model = toxicity.fit(rows, np.array([0, 1, 3] * 20))
    p = model.probabilities(np.array([-3.0, 0.0, 4.0]))
    assert (np.diff(p, axis=1) <= 0).all() and (np.diff(p, axis=0) >= 0).all() and (np.diff(model.thresholds) >= 0).all()


# Mixing


def test_mix(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(["w#" if rng.random() < 0.2 else "w"] * rng.choice([0, 1, 3, 10, 40])), rng.choice(["big"] * 8 + ["a", "b", None])) for i in range(400)]
    got = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)).collect()
    sizes = collections.Counter()
    for _, t, s in docs:
        sizes[s] += len(t.split())
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while True:  # share, cap, share again
        rest = total - sum(target.values())
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / w > 3 * sizes[s]]
        if not over:
            target |= {s: rest * weight[s] / w for s in open_}
            break
        for s in over:
            target[s] = 3 * sizes[s]
            open_.discard(s)
    longest = max(r["size"] for r in got)
    for s in names:
        mine = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6 and r["taken"] <= 3 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= longest / 2 + 1e-6
        order = sorted((r for r in mine if r["size"]), key=lambda r: r["sample_key"])
        assert [r["copies"] for r in order] == sorted((r["copies"] for r in order), reverse=True)  # a prefix by key
    again = mixing.mix(spark.createDataFrame(docs[::-1], "doc_id long, text string, source string")).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_heavier_documents_come_first(spark):
    rows = spark.range(20_000).select(mixing.uniform(F.col("id")).alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 < rows[0] < 0.001 and 0.999 < rows[1] <= 1 and abs(rows[2] - 0.5) < 0.01


# Suffixes


def test_repeated_bytes(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice(["the ", "of ", "and ", "é", "xy ", "a"]) for _ in range(rng.choice([3, 40, 200]))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(base)[rng.randrange(60) :][: rng.randint(20, 300)] for _ in range(rng.randrange(5)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "ab" * 500), (103, "ab" * 300), (104, "b" + "ab" * 100), (5, base[2]), (5, base[2]), (None, base[2]), (None, base[3])]
    rows += [(105, "x" * 49), (106, "x" * 51), (107, "y" * 3000), (108, "y" * 700 + base[4] + "y" * 90)]
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - 49):
            if i is not None:
                first[b[j : j + 50]] = min(i, first.get(b[j : j + 50], i))
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if first.get(b[j : j + 50], 10**9) < (10**8 if i is None else i):
                gone[j : j + 50] = b"\1" * 50
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((i, len(b), len(b) - len(left), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(left).hexdigest()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for size in (4000, 1 << 20):
        assert sorted(map(tuple, suffixes.repeated_bytes(df, run_bytes=size).collect()), key=repr) == sorted(want, key=repr)


def test_loser_tree():
    rng = random.Random(3)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(12))) for _ in range(7)]
    coded = []
    for r in runs:
        tails, lengths, shared = suffixes.front_code(r)
        assert list(suffixes.front_decode(tails, lengths, shared)) == r
        coded.append((r, shared))
    out = list(suffixes.merge(coded))
    assert [x[0] for x in out] == sorted(itertools.chain(*runs))
    for (a, *_), (b, _, _, shared) in itertools.pairwise(out):
        assert shared == len(os.path.commonprefix([a, b]))
    assert list(suffixes.merge([])) == []


# Tokens

ODD = ["", "  ", "İstanbul ΣΑΣ ς Σ", "éa ﬁ Ⅳ ½ ² 日本語", "don't I'LL we've 's ''s", "a<|endoftext|>b <|startoftext|><|endoftext|>c <|ENDOFTEXT|>", "x\x1c\x1d y\x85z w q　r", "😀👍🏽 a​b ‮", "\x00\x01 \x7f", "ǅ ŉ ß ẞ", "a" * 300, "!?" * 60, "1234567890", "<|", "تجربة नमस्ते ไทย", "'" * 10 + "s 'S 'Re", "﻿abc�"]


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    with open(path, encoding="utf-8") as f:
        counter = tokens.PrefixCounter(f.read())
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("aeiou thrs,.'1É") for _ in range(120)) for _ in range(30)]
    for t in texts:
        assert counter.count(t.encode()) == size(t), t
        assert counter.prefixes(t) == [size(t[:k]) for k in range(len(t) + 1)], t
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in tokens.truncate(df, path, 7).collect():
        t = texts[r["doc_id"]]
        best = max(k for k in range(len(t) + 1) if size(t[:k]) <= 7)
        assert r["text"] == t[:best] and r["n_tokens"] == size(t[:best])


def test_prefix_counts_of_mixed_pieces_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        counter = tokens.PrefixCounter(f.read())
    rng = random.Random(5)
    parts = ["a", "b", "é", "é", "İ", "Σ", "'", "'re", "'ll", "<|endoftext|>", "<|", "!", " ", " ", "\xa0", "1", "٣", "ß", "日本", "😂", "the", "\n", "Å", "́"]
    for _ in range(800):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        want = [len(library.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
        assert counter.prefixes(t) == want, t
        assert counter.count(t.encode()) == want[-1], t


def test_pairs_of_tokens_hold_as_encoding_them_says():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        counter = tokens.PrefixCounter(f.read())
    rng = random.Random(6)
    inner = sorted(counter.inner_tokens)
    all_tokens = sorted(counter.vocab)
    for _ in range(3000):
        a, b = rng.choice(inner), rng.choice(all_tokens)
        if counter._merge(counter._symbols(a)) == [a] and counter._merge(counter._symbols(b)) == [b]:
            assert counter._keeps(a, b) == (counter._merge([*counter._symbols(a), *counter._symbols(b)]) == [a, b]), (a, b)


def test_truncation_keeps_repeated_and_null_ids_apart(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(1, "one two three"), (1, "four"), (None, "five six seven"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, tokens.truncate(df, path, 2).collect()), key=repr)
    assert got == sorted([(1, "one two ", 2), (1, "four", 1), (None, "five six ", 2), (2, "", 0), (3, "", 0)], key=repr)
    assert tokens.truncate(df.limit(0), path, 2).count() == 0
    assert sorted((r["doc_id"], len(r["counts"])) for r in tokens.prefix_tables(df.where("doc_id > 1"), path).collect()) == [(2, 1), (3, 1)]
