"""Classifiers, rules, extraction, license scan, similarity join and the pipeline."""

import math
import os
import random
import re
import textwrap
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plinth.llm import (
    html_extract, jaccard_join, language_id, license_scan, quality_model, quality_rules, queries, token_store, tokenizing,
)
from plinth.llm.components import components

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def linked_components(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, x) in enumerate(sets):
        for j in range(i):
            y = sets[j][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least.get(find(i), d)) for i, (d, s) in enumerate(sets)]


def near_copies(seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    rows, n = [], 0
    for size, copies in ((60, 90), (200, 40), (12, 25), (6, 8)):
        base = rng.choices(words, k=size)
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):
                text[rng.randrange(size)] = rng.choice(words)
            rows.append((n, rng.choice([" ", "\n", "  "]).join(text)))
            n += 1
    passage = rng.choices(words, k=60)
    for _ in range(60):
        rows.append((n, " ".join(passage + rng.choices(words, k=rng.randint(0, 120)))))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "a b"), (n + 3, "A  b"), (n + 4, "a b c d"), (n + 5, "a b c d e"), (n + 6, " \t"),
             (n + 7, rows[0][1].upper()), (None, rows[60][1]), (None, "all alone here"), (0, rows[0][1])]
    return rows


def test_near_duplicates_against_brute_force(spark):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS class", "1 AS component_id").repartition(6)
    got = jaccard_join.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted(
        (str(d), n, str(c)) for d, n, c in linked_components(rows)
    )
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_leave_no_shuffle_files(spark, sf):
    def shuffled() -> dict:
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        found = [f for f in files.split("\n") if os.path.basename(f).startswith("shuffle_") and f.endswith(".data")]
        return {f: os.path.getsize(f) for f in found if os.path.exists(f)}

    before = shuffled()
    jaccard_join.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"))
    deadline = time.time() + 20
    while True:  # files are deleted in the background
        left = sum(size for f, size in shuffled().items() if f not in before)
        if left < 100_000 or time.time() > deadline:
            break
        time.sleep(0.2)
    assert left < 100_000, left


def test_near_duplicates_of_the_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op6_ngram_jaccard(spark, sf).collect()
    assert sorted(tuple(r) for r in got) == sorted(linked_components(rows))


@pytest.mark.parametrize("frequent", [2, 20, 10**9])
def test_similar_sets_share_an_entry(monkeypatch, frequent):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    rng = np.random.default_rng(frequent % 97)
    for n in (4, 5, 9, 30, 120, 400):
        for _ in range(20):
            base = rng.choice(10**9, n * 2, replace=False).astype(np.uint64)
            counts = dict(zip(base.tolist(), rng.integers(2, 60, n * 2).tolist()))
            x = base[:n]
            drop = rng.integers(0, n // 9 + 1)
            y = np.concatenate([x[drop:], base[n : n + rng.integers(0, drop + 1)]])
            common = len(np.intersect1d(x, y))
            if 100 * common < 80 * (len(x) + len(y) - common) or common == n == len(y):
                continue
            # Members of one set alone are known as such.
            shared = np.intersect1d(x, y)
            entries = [
                jaccard_join.signatures(shared, np.array([counts[m] for m in shared.tolist()]), len(s), 80) for s in (x, y)
            ]
            assert len(np.intersect1d(*entries)), (n, len(x), len(y), common)


def test_runs_of_members_survive():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        members = np.unique(rng.integers(0, 1 << 56, n).astype(np.uint64))
        assert jaccard_join._long(jaccard_join._short(members)).tolist() == members.tolist()


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    pairs += [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(45)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in got} and set(got) == {x for a, b in pairs if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language_held_out_accuracy(spark):
    found = queries.op4_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95


def test_language_of_odd_texts(spark):
    rows = [(1, "aaa bbb aaa " * 30, "x"), (2, "zzz yyy zzz " * 30, "y"), (3, None, "x"), (4, "", None), (5, "12 !?", "y"), (6, "zzz yyy " * 5000, None)]
    df = spark.createDataFrame(rows * 3, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(1))
    got = {r.doc_id: r for r in language_id.identify(df, language_id.fit(df)).collect()}
    assert (got[1].lang_pred, got[2].lang_pred, got[6].lang_pred) == ("x", "y", "y")
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 5))
    none = language_id.fit(df.limit(0))
    assert {r.lang_pred for r in language_id.identify(df, none).collect()} == {"und"}
    assert language_id.identify(df.limit(0), none).count() == 0


def test_pair_tables_equal_the_filters():
    rng = np.random.default_rng(1)
    windows = rng.integers(0, 256, (9, language_id.WINDOW)).astype(np.uint8)
    network = language_id.train(windows, np.arange(9) % 2, ["a", "b"], epochs=1)
    p = network.probabilities(windows, step=4)
    assert p.shape == (9, 2) and np.allclose(p.sum(1), 1) and np.allclose(p, network.probabilities(windows))


def test_quality_held_out_accuracy(spark):
    found = queries.op8_quality_model(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95


def test_quality_model_odd_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "word " * 20_000, "c"), (None, "x", "d")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_model.score(docs, quality_model.fit(docs, labels)).collect()
    assert len(got) == 4 and all(r.score == 0.5 and r.predicted == 1 for r in got)
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0), (None, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality_model.score(docs, quality_model.fit(docs, labels)).collect())
    assert quality_model.score(docs.limit(0), quality_model.fit(docs, labels)).count() == 0


def test_trees_by_hand():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 1] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    trees = quality_model.fit_trees(x, y, rounds=40, depth=3)
    assert ((trees.scores(x) >= 0.5) == y).mean() > 0.95
    raw = np.full(len(x), trees.base)
    for i, row in enumerate(x):
        for f, limit, leaf in zip(trees.feature, trees.limit, trees.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > limit[node])
            raw[i] += leaf[node - len(f)]
    assert np.allclose(trees.scores(x), 1 / (1 + np.exp(-raw)))


def test_statistics_of_the_rules():
    rng = random.Random(9)
    texts = ["", " ", "a b c d e f g h " * 3, "x\ny\nx\n \n\nx", "#|a <b>&"] + [
        " ".join(rng.choices("abc", k=rng.randint(0, 60))) + rng.choice(["", "\n", "\n a\n a"]) for _ in range(60)
    ]
    found = quality_rules.text_statistics(texts)
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        count = Counter(windows)
        hit = {k + j for k, x in enumerate(windows) if count[x] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)]
        assert [found[s][i] for s in quality_rules.STATISTICS[:5]] == want, t


@pytest.mark.parametrize("k, n, p", [(0, 10, 0.3), (3, 10, 0.3), (9, 10, 0.3), (10, 10, 0.3), (2, 400, 0.01), (30, 400, 0.1)])
def test_binomial_tail(k, n, p):
    exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert quality_rules.binomial_tail(k, n, p) == pytest.approx(exact, rel=1e-9)


def test_cutoffs_keep_their_promise():
    good, bad = np.zeros(66, int), np.zeros(66, int)
    good[:4], bad[20:60] = 1000, 10
    assert quality_rules.certified_cutoff(good, bad, 0.01, 0.001) == 19
    assert quality_rules.certified_cutoff(good // 100, bad, 0.01, 0.001) == 65  # too few labels: off
    bad[:] = 0
    assert quality_rules.certified_cutoff(good, bad, 0.01, 0.001) == 65  # separates nothing: off


def test_rules_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None), (3, " ".join(f"w{i}" for i in range(30_000)), "a"), (3, "x", "b"), (None, "y " * 50, "a")],
                                 "doc_id long, text string, lang string").withColumn("kept", F.lit("clash"))
    labels = spark.createDataFrame([(3, 1), (3, None), (9, 0), (None, 1)], "doc_id long, quality int")
    got = quality_rules.judge(docs, labels).collect()
    assert len(got) == 5 and [r.kept for r in got if r.n_words == 30_000] == [True]
    assert all(r.base_failed and not r.kept for r in got if r.n_words != 30_000)
    assert quality_rules.judge(docs.limit(0), labels).count() == 0


@pytest.fixture(scope="module")
def html_model():
    return html_extract.fit(html_extract.labelled_pages())


def test_pages_not_trained_on(html_model):
    pages = html_extract.labelled_pages(80, seed=123)
    assert sum(html_model.text(h) == "\n".join(b) for h, b in pages) >= 0.95 * len(pages)


def test_odd_pages(html_model):
    article = "<article><h1>Alpha beta gamma delta</h1><p>One two three four five six.<p>Seven &amp; eight &lt;nine&gt; ten.</article>"
    want = "Alpha beta gamma delta\nOne two three four five six.\nSeven & eight <nine> ten."
    menu = "<nav><ul><li><a href=a>Home</a><li><a href=b>About</a></ul></nav>"
    assert html_model.text(f"<html><body>{menu}{article}<footer>&copy; me</footer>") == want
    assert html_model.text(f"{menu}{article}<script>var x = '<p>no</p>'</script><!-- no --><style>p{{}}</style><foot") == want
    assert [html_model.text(x) for x in ("", "<html>", "<p", "</p></div>", "<script>only")] == [""] * 5
    assert html_model.text("<article>" + "<div>" * 3000 + "deep text of some length here" + "</div>" * 10).count("deep") <= 1


_LONG = "The quick brown fox jumps over the lazy dog near the river bank again and again today. " * 4
_LINES = [_LONG.strip(), "A short line between them.", (_LONG + "And so it ends.").strip()]


@pytest.mark.parametrize("page, want", [  # layouts that the generator of labelled pages does not make
    ("<p>{0}</p>", [0]), ("{menu}<p>{0}</p><p>{2}</p><div>Copyright 2020 Somebody</div>", [0, 2]),
    ("<html><body>{menu}<p>{0}</p><p>{2}</p><div>Copyright</div></body></html>", [0, 2]),
    ("<html><body><table><tr><td>{menu}</td><td><p>{0}</p><p>{2}</p></td></tr></table></body></html>", [0, 2]),
    ("<html><body><div><div><p>{0}</p><p>{1}</p><p>{2}</p></div></div></body></html>", [0, 1, 2]),
    ("<html><body bgcolor=white><hr><p>{0}<p>{2}<hr><address>&copy; 2001 Me</address>", [0, 2]),
])
def test_plain_layouts(html_model, page, want):
    menu = "<div><a href=/>Home</a> <a href=/a>About</a></div>"
    assert html_model.text(page.format(*_LINES, menu=menu)) == "\n".join(_LINES[i] for i in want)


def test_pages_of_the_table_lose_no_article(html_model):
    """Block by block: what an ``article`` or ``main`` element holds directly is kept, navigation and footers are not."""
    pages = [p for p in pq.read_table(f"{SF}/pages.parquet").column("html").to_pylist() if p]
    assert all(html_model.text(p) for p in pages)
    for html in pages:
        page, kept = html_extract.read_page(html), html_model.text(html).split("\n")
        for node, text in page.blocks:
            above = []
            while node >= 0:
                above.append(page.nodes[node].tag)
                node = page.nodes[node].parent
            if above[0] in ("p", "h1") and above[1] in ("article", "main"):
                assert text in kept
            if {"nav", "footer", "aside", "form"} & set(above):
                assert text not in kept


@pytest.mark.parametrize("html, want", [
    ("<html><head><title>x</title><article><p>Hello there</p></article>", ["Hello there"]),
    ("<head><title>a <b>x</b></title><meta name=a><noscript><p>no</p></noscript><template><p>no</p></template><p>Hi", ["Hi"]),
    ("<head><noscript><p>no</head><p>Hi", ["Hi"]), ("<head><style>p{}</style>Text<p>Hi", ["Text", "Hi"]),
    ("<head><title>x</title></head><p>Hi", ["Hi"]), ("<head><title>x</title><body><p>Hi", ["Hi"]),
    ("<div><select><option>a<option>b</div><p>After", ["After"]), ("<div><select><option>a</option></select><p>After</div>", ["After"]),
    ("<section><canvas><div>no</section><p>After", ["After"]), ("<div><map><area></div><p>After", ["After"]),
    ("<div><object><div>no</div><p>no</p></object>In</div><p>After", ["In", "After"]), ("<div><object><p>no</div><p>After", ["After"]),
    ("<ul><li>One<select><option>a<li>Two</ul><p>After", ["One", "Two", "After"]), ("<p>One<select><option>a<p>Two", ["One", "Two"]),
    ("<table><tr><td>A<select><option>x<td>B</table>", ["A", "B"]), ("<p>One<object>no<p>no</p></object> two", ["One two"]),
])
def test_unclosed_unseen_elements(html, want):
    assert [text for _, text in html_extract.read_page(html).blocks] == want


def test_sum_product_against_enumeration():
    parents, own = [-1, 0, 0, 1, 1], [0.3, -1.0, 0.7, 2.0, -0.4]
    pair = [0.5, -0.2, 0.1, 0.9]
    total, ones = 0.0, np.zeros(5)
    for bits in range(32):
        y = [bits >> i & 1 for i in range(5)]
        score = sum(o * s for o, s in zip(own, y)) + sum(pair[2 * y[parents[i]] + y[i]] for i in range(1, 5))
        total += math.exp(score)
        ones += math.exp(score) * np.array(y)
    assert np.allclose(html_extract.sum_product(parents, own, [pair] * 5)[0], ones / total)


def test_extract_keeps_rows(spark):
    df = spark.createDataFrame([(1, None, "u"), (2, "<article><p>Some words of text here.</p></article>", None)], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in html_extract.extract(df, model=html_extract.Model({"any": 1.0}, np.zeros((2, 4)))).collect()}
    assert got == {1: "", 2: "Some words of text here."}
    assert html_extract.extract(df.limit(0), model=html_extract.Model({}, np.zeros((2, 4)))).count() == 0


def test_license_scan(spark):
    mit = license_scan.TEXTS["MIT"]
    rows = [
        (1, "MIT License text\n\n" + mit), (2, "Copyright (c) 2020 Someone\nAll rights reserved.\n" + mit.replace('"', "'").upper().replace("SUBLICENSE", "sublicense")),
        (3, "words\nReleased under the MIT Licence!\nLicensed under CC BY-NC 4.0.\nreleased UNDER the mit license"), (4, None), (5, ""), (6, "nothing here"),
        (None, "SPDX-License-Identifier: Apache-2.0"), (7, "\n".join(["x y z"] * 20_000) + "\nLicensed under the Apache License, Version 2.0."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("clash"))
    got = sorted((str(r.doc_id), r.license, r.unit, r.n_found) for r in license_scan.scan(df).collect())
    assert got == sorted([
        ("1", "MIT", "paragraph", 1), ("2", "MIT", "text", 1), ("3", "MIT", "line", 2), ("3", "CC-BY-NC-4.0", "line", 1),
        ("None", "Apache-2.0", "text", 1), ("7", "Apache-2.0", "line", 1),
    ])
    assert license_scan.scan(df.limit(0)).count() == 0


def test_license_files_and_runs_of_paragraphs(spark):
    def filed(title, name, breaks=()):
        body = license_scan.TEXTS[name]
        for first in breaks:
            body = body.replace(first, "\n\n" + first)
        return f"{title}\n\nCopyright (c) 2020 Someone\n{body}\n"

    mit = filed("MIT License", "MIT", ["The above", "THE SOFTWARE IS"])
    bsd = filed('BSD 2-Clause "Simplified" License', "BSD-2-Clause", ["1. R", "2. R", "THIS SOFTWARE IS"])
    isc = filed("The ISC License", "ISC", ["THE SOFTWARE IS"])
    folder = os.path.join(os.path.dirname(license_scan.__file__), "licenses")
    files = {f.removesuffix(".txt"): open(os.path.join(folder, f), encoding="utf-8").read() for f in sorted(os.listdir(folder))}
    wrapped = {name: "\n".join(textwrap.fill(p, 72) + "\n" for p in text.split("\n\n")) for name, text in files.items()}
    assert set(license_scan.NAMES) - set(files) - set(license_scan.TEXTS) == {"AGPL-3.0", "CC-BY-4.0", "CC-BY-NC-4.0"}
    rows = [("mit", mit), ("bsd", bsd), ("isc", isc), ("readme", f"# Tool\n\nIt works.\n\n## License\n\n{mit}\n\nThe end."),
            ("twice", f"{isc}\n---\n{bsd}\n\n{isc}"), ("cut", mit[: len(mit) // 2])]
    rows.append(("untitled", files["GPL-2.0"].replace("GNU GENERAL PUBLIC LICENSE\n", "\n")))
    rows += [(name, "A heading of my own\n\n" + text + "\n\nEND OF TERMS AND CONDITIONS") for name, text in wrapped.items()]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((r.doc_id, r.license, r.unit, r.n_found) for r in license_scan.scan(df).collect())
    assert got == sorted([
        ("mit", "MIT", "text", 1), ("bsd", "BSD-2-Clause", "text", 1), ("isc", "ISC", "text", 1), ("readme", "MIT", "run", 1),
        ("twice", "ISC", "run", 2), ("twice", "BSD-2-Clause", "run", 1), ("untitled", "GPL-2.0", "text", 1), *[(name, name, "run", 1) for name in files],
    ])
    own = spark.createDataFrame([("House", "HOUSE RULES\n\nDo as\nyou like."), ("Empty", "")], "license string, text string")
    docs = spark.createDataFrame([(1, "x\n\nHouse rules.\n\nDo as you like!\ny"), (2, mit)], "doc_id long, text string")
    assert [tuple(r) for r in license_scan.scan(docs, known=own).collect()] == [(1, "House", "run", 1)]
    both = license_scan.scan(docs, known=own.unionAll(license_scan.known_table(spark))).collect()
    assert sorted(map(tuple, both)) == [(1, "House", "run", 1), (2, "MIT", "text", 1)]


def test_copyright_claims(spark):
    claims = ["Copyright © 2020 X", "Copyright (c) X 2020", "(c) Copyright 2020 X", "Copyright Acme, Inc. All rights reserved.",
              "Copyright (c) [year] [fullname]", "© Acme 2020", " * ©2020 Acme", "# (C) Acme", "Copyright 2020 X", "All rights reserved."]
    mit = textwrap.dedent(license_scan.TEXTS["MIT"])
    folder = os.path.join(os.path.dirname(license_scan.__file__), "licenses")
    rows = [(c, f"{c}\n{mit}") for c in claims] + [(f"in {c}", mit.replace("The above", f"{c}\nThe above")) for c in claims]
    rows.append(("c", "C is a language\n" + mit))
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((r.doc_id, r.license, r.unit, r.n_found) for r in license_scan.scan(df).collect())
    assert got == sorted([(key, "MIT", "paragraph" if key == "c" else "text", 1) for key, _ in rows])
    # Sentences of a license that begin with the word stay, at any width.
    texts = [("MIT", mit)] + [(f.removesuffix(".txt"), open(os.path.join(folder, f), encoding="utf-8").read()) for f in sorted(os.listdir(folder))]
    rows = [(f"{w} {name}", "\n".join(textwrap.fill(p, w) + "\n" for p in text.split("\n\n"))) for name, text in texts for w in range(50, 110, 3)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((r.doc_id, r.license, r.n_found) for r in license_scan.scan(df).where("unit IN ('text', 'paragraph')").collect())
    assert got == sorted((key, key.split(" ")[1], 1) for key, _ in rows)


def test_license_lines_against_plain_search(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    want = lines.where("line rlike '^(Licensed under CC BY-NC 4.0.|Released under the MIT License.|Licensed under the Apache License, Version 2.0.)$'"
                       " OR line = 'This work is licensed under the GNU General Public License, version 3.'").count()
    assert queries.op10_license_scan(spark, SF).agg(F.sum("n_found")).first()[0] == want


def test_pipeline_stages(spark, sf, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == before.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in seen["quality"][1].collect()}
    assert all((d in kept) == (q == 1) for d, q in labels.items())
    before, after = seen["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, _, c in linked_components(rows) if d == c)
    before, after = seen["decontamination"]
    assert after.count() < before.count()
    before, after = seen["packing"]
    assert {r.doc_id for r in before.collect()} == {r.doc_id for r in after.collect()}


def template_pages(n, own, paragraphs=1, seed=4):
    """Pages of one template (or of three of some paragraphs) and ``own`` words of their own."""
    rng = random.Random(seed)
    parts = [[f"p{k}w{i}" for i in range(240 // min(paragraphs, 3))] for k in range(paragraphs)]
    rows = []
    for i in range(n):
        chosen = sorted(rng.sample(range(paragraphs), min(paragraphs, 3)))
        rows.append((i, " ".join([w for k in chosen for w in parts[k]] + [f"own{i}x{j}" for j in range(own)])))
    return rows


@pytest.mark.parametrize("own, paragraphs", [(30, 1), (24, 1), (8, 6)])
def test_template_pages_link_as_brute_force_says(spark, own, paragraphs):
    rows = template_pages(260, own, paragraphs)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(df).collect()}
    sets = {i: {tuple(w[j:j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in sets}


def test_template_pages_are_not_compared_in_pairs(spark, monkeypatch):
    """No pair of pages that share the template only reaches the verification, the typical page's aside."""
    asked, common = [], jaccard_join._common

    def watched(pairs, sets):
        out = common(pairs, sets)
        asked.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "_common", watched)
    df = spark.createDataFrame(template_pages(1500, 30), "doc_id long, text string").repartition(4)
    assert jaccard_join.near_duplicates(df).where("component_id != doc_id").count() == 0
    assert asked[0] <= 1500 and sum(asked[1:]) == 0


def test_token_pieces_are_looked_up_once_a_batch():
    texts = ["a b  a\n\nb a", None, "", " \n", "Zoë's\tx y. Q a", '#$% "é" 12 foo!!bar\r\nx', "日本 語\n<s> [UNK]", "Q " * 50]
    batch = pa.array(texts)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encode = tokenizing.PieceEncoder(public_tokenizers.path(name))
        end = (1).to_bytes(encode.dtype.itemsize, "little")
        whole = encode.encode_all(batch, 1)
        assert whole.to_pylist() == [encode._whole(t or "") + end for t in texts]
        assert encode.encode_all(batch.slice(3, 4), 1).to_pylist() == whole.to_pylist()[3:7]
        assert encode.encode_all(batch.slice(0, 0), 1).to_pylist() == []
    gathered = list(token_store._gathered(pa.record_batch({"n": [i] * 2}) for i in range(6000)))
    assert [b.num_rows for b in gathered] == [5000, 5000, 2000]


def test_a_small_piece_table_is_an_encoder_of_its_own():
    small, large = (tokenizing.encoder("byte_bpe_50k.json", size) for size in (8, 4000))
    assert small is not large and small.spaced.half == 4
    text = "ab cd ef gh ij kl mn op ab cd\nef gh"
    assert small.encode(text) == large.encode(text)
