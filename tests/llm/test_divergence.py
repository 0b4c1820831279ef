"""The divergence audit against brute force, over several blocks of terms and sources."""

import random
import re
from collections import Counter, defaultdict

import pytest

from plinth.llm.divergence import audit

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def wanted(rows, min_docs, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found = TERM.findall(low)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        mine = [g for g in groups if g[0] == lang]

        def shares(names):
            n = Counter()
            for name in names:
                n.update({t: counts[name][t] for t in kept})
            total = sum(n.values()) + 5 * len(kept)
            return {t: 1 + 10**9 * (n[t] + 5) // total for t in kept}

        p, q = shares([(lang, source)]), shares(mine)
        pairs = []
        for other in mine:
            if other != (lang, source):
                r = shares([other])
                pairs.append((-sum(abs(p[t] - r[t]) for t in kept), other[1].encode()))
        terms = [(q[t] - p[t], t.encode()) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, items in (("pair", pairs), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(sorted(items))]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i % 6]}" for i in range(180)] + ["É", "日本", "x y", "İ", "ſ"]
    out = []
    for _ in range(700):
        lang = rng.choice(["en", "en", "fr", None, ""])
        source = rng.choice([f"s{i}" for i in range(9)] + ["hot"] * 9 + [None, "Ü"])
        some = rng.sample(words, 40) if rng.random() < 0.5 else words
        out.append((rng.choice([" ", ", ", "1", "_"]).join(rng.choices(some, k=rng.randint(0, 60))).title(), lang, source))
    out += [(None, "en", "silent"), ("", "one", "only"), ("rare words here", "two", "a"), (None, "two", "b"), ("THE END", None, None)]
    out += [out[0]] * 40 + [("long " * 30_000, "en", "hot")]
    return out


@pytest.mark.parametrize("blocks", [(4096, 64), (50, 4), (64, 1)])
def test_against_brute_force(spark, rows, blocks):
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "'x' AS term", "1 AS n").repartition(5)
    got = audit(df, min_docs=5, block_terms=blocks[0], block_sources=blocks[1])
    assert sorted(map(tuple, got.collect())) == wanted(rows, 5, 50)


def test_empty_table(spark):
    assert audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
