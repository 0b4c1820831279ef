"""Exact dedup by tries against brute force, with and without spilled subtrees."""

import hashlib
import random

import pytest

from plinth.llm.exact_dedup import PatriciaTrie, dedup


def test_trie_holds_every_string_and_spills_whole_subtrees():
    rng = random.Random(1)
    keys = [bytes(rng.choices(b"ab\x00\xff", k=rng.randint(0, 12))) for _ in range(600)] + [b"", b"x" * 100_000, b"x" * 99_999]
    trie = PatriciaTrie()
    for key in keys:
        trie.slot(key, lambda: [key])[0].append(1)
    held = dict(trie.terminals())
    assert set(held) == set(keys) and trie.strings == len(held)
    assert all(found[0] == key and len(found) == 1 + keys.count(key) for key, found in held.items())
    gone = {}
    while trie.strings > 1:
        before = trie.strings
        number, cut = trie.spill()
        assert cut and trie.strings == before - len(cut) >= 1
        gone.update({key: number for key, _ in cut})
    assert len(gone) + trie.strings == len(held)
    for key, number in gone.items():  # a string comes to the subtree that it left with, or to one spilled above it
        found, where = trie.slot(key, list)
        assert found is None and where in gone.values()


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def wanted(rows, last):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(low(text), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max if last else min)(known) if known else None
        kept = False
        for i in sorted(ids, key=lambda i: (i is None, i)):
            mine = i == keep and not kept
            kept |= mine
            out.append((i, keep, len(ids), mine, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    texts = ["", "a", "A", "Ab cD", "ab cd", "É", "é", "Straße", "long " * 60_000, "LONG " * 60_000, "\x00", "İ", "K"]
    texts += [("shared prefix " * rng.randint(1, 5)) + str(rng.randint(0, 200)) for _ in range(300)]
    out = [(i, rng.choice(texts)) for i in range(900)]
    out += [(1000 + i, "The Hot One" if i % 2 else "the hot ONE") for i in range(500)]
    out += [(None, "a"), (None, None), (None, "only null"), (None, "ONLY null"), (2000, None), (5, out[5][1]), (5, out[5][1])]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("memory", [128 << 20, 4_000])
@pytest.mark.parametrize("keep", ["first", "last"])
def test_owners(spark, rows, keep, memory):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS row", "1 AS size").repartition(6)
    got = dedup(df, keep=keep, memory_bytes=memory).collect()
    found = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in got), key=str)
    assert found == wanted(rows, keep == "last")


def test_empty_table(spark):
    out = dedup(spark.createDataFrame([], "doc_id long, text string"))
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "digest"] and out.count() == 0
