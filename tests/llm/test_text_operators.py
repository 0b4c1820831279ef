"""Line dedup, decontamination, packing and the token store against brute force."""

import hashlib
import random
import zlib
from types import SimpleNamespace

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plinth.llm import decontamination, line_dedup, oracle, packing, queries, token_store
from plinth.llm.tokenizing import PieceEncoder

ODD = [
    "", " ", "\n", "a  b", "a\n\nb", " a", "a ", "it's don't I'LL", "x\t y", "<|endoftext|> hi <|startoftext|>",
    "ΣΑΣ ς É ñ café  naïve ß", "a b c", "123 45a 6.7", "ab12 cd's", "Ñandú!!! ###a a### foo&&& 'll", "日本語 テスト",
    "a\x1cb c", "\U0001f600 hi", "foo.\n\nBar", "a \n b", "é à", "foo | bar", "ª º µm", "a" * 300,
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    common = [" ".join(rng.choices(words, k=12)) for _ in range(6)]
    rows = []
    for i in range(60):
        lines = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(rng.randint(0, 8))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(lines))
            lines.insert(at, rng.choice([" {} ", "{}", "\t{}\r"]).format(rng.choice(common).upper()))
        rows.append((i, "\n".join(lines), "clash"))
    rows += [(60, None, None), (61, "", "x"), (62, "\n\n", "x"), (5, rows[5][1], "clash"), (63, "one two\n" * 700 + common[0], "x")]
    rows += [(64 + i, t, "odd") for i, t in enumerate(ODD)] + [(None, common[1], "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, n_lines string").repartition(5)


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def test_line_dedup(docs):
    rows, df = docs
    holders = {}
    for d, t, _ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(float("inf") if d is None else d)
    want = []
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        me = float("inf") if d is None else d
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == me]
        want.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in line_dedup.dedup_lines(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(w[2] for w in want) > 20


def test_line_dedup_salts_do_not_matter(docs):
    _, df = docs
    one, many = (sorted(map(str, line_dedup.dedup_lines(df, salts=s).collect())) for s in (1, 64))
    assert one == many


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert line_dedup.dedup_lines(none).count() == 0
    assert packing.pack(none).count() == 0
    assert decontamination.contamination(none, items).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontamination.contamination(some, items).first().n_hit == 0


@pytest.mark.parametrize("name", sorted(oracle.statements()))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(oracle.statements()[name]).df()
    got = queries.registered()[name](spark, sf).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert sorted(map(str, got[columns].values.tolist())) == sorted(map(str, want[columns].values.tolist()))


@pytest.mark.parametrize("limit", [8 << 20, 300])
def test_decontamination_spans_and_several_automata(spark, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "MAX_PATTERN_BYTES", limit)
    item = "The quick brown fox jumps over the lazy dog near a river bank"
    rows = [(1, "Intro: THE quick, brown fox -- jumps over the lazy dog near a cliff."), (2, "no match here"), (3, None),
            (4, "Short item!"), (5, "x short   ITEM y short item"), (None, item)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' AS n_hit", "doc_id AS item_id")
    items = spark.createDataFrame([(7, item), (10, "short item"), (10, "short item"), (11, None), (12, "...")], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.contamination(df, items).collect()}
    assert got[1].item_ids == ["7"] and got[1].n_hit == 11
    text = rows[0][1]
    assert [text[s.start:s.end] for s in got[1].spans] == [text[7:-7]]
    assert (got[2].n_hit, got[3].n_words, got[4].n_hit, got[5].n_hit) == (0, 0, 2, 4)
    assert got[5].item_ids == ["10"] and got[None].n_hit == 13 and got[5].item_id == 5


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_library_ids(file):
    own = PieceEncoder(public_tokenizers.path(file), cache_pieces=50)
    for text in ODD + ["the The tHe cat. cat sat!! " * 3]:
        want = own.library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == want, text


def library_ids(file, rows):
    t = Tokenizer.from_file(public_tokenizers.path(file))
    t.encode_special_tokens = True
    return [(r[0], np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4")) for r in rows]


def test_packing(docs):
    rows, df = docs
    got = packing.pack(df, max_tokens=64, with_ids=True).collect()
    want = sorted((str(d), tuple(ids)) for d, ids in library_ids("byte_bpe_50k.json", rows))
    pieces = {}
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 64
        pieces.setdefault((str(r.doc_id), r.doc_tokens), []).append((r.start, tuple(r.ids)))
    # Documents of one id and length may interleave: compare the multiset of pieces.
    flat = sorted((d, s, p) for (d, _), ps in pieces.items() for s, p in ps)
    cut = sorted((d, s, ids[s : s + 64]) for d, ids in want for s in range(0, len(ids), 64))
    assert flat == cut
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    whole = packing.assemble(packing.pack(df, max_tokens=64, with_ids=True), 64).collect()
    assert sorted(by_sequence) == sorted(r.sequence_id for r in whole) == list(range(len(by_sequence)))
    assert all(len(r.ids) == r.padded_length for r in whole)
    assert sum(r.length for r in whole) == sum(len(i) for _, i in want)


def test_shortest_pack_first_places_all():
    rng = random.Random(1)
    for size in (1, 8, 100):
        histogram = {rng.randint(1, size): rng.randint(1, 10**6) for _ in range(12)}
        placed = {}
        for packs, lengths in packing.shortest_pack_first(histogram, size):
            assert sum(lengths) <= size and packs > 0
            for x in lengths:
                placed[x] = placed.get(x, 0) + packs
        assert placed == histogram


@pytest.mark.parametrize("n", [0, 1, 5, 1000, 40_000])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.pareto(1, n) * 3).astype(np.int64) % 5000
    counts = np.bincount(ids, minlength=7)
    frequencies = token_store.scaled_frequencies(counts)
    assert frequencies.sum() == (1 << token_store.SCALE_BITS) * (n > 0) and (frequencies[counts > 0] > 0).all()
    model = token_store.Model(frequencies)
    data = model.encode(ids, lanes=16, every=64)
    assert model.decode(data).tolist() == ids.tolist()
    parts = [model.decode(data, range(k, k + 1)) for k in range(-(-n // (16 * 64)))]
    assert np.concatenate([np.zeros(0, int), *parts]).tolist() == ids.tolist()


def test_token_store(spark, docs, tmp_path):
    rows, df = docs
    path = str(tmp_path / "store")
    token_store.write_tokens(df, path, block_ids=500)
    got = token_store.read_tokens(spark, path).orderBy("start").collect()
    want = library_ids("word_bpe_49k.json", rows)
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in got) == sorted((str(d), tuple(i)) for d, i in want)
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids)) and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        at += r.n_tokens


def test_a_damaged_block_fails(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b c"), (2, "d e")], "doc_id long, text string")
    token_store.write_tokens(df, str(tmp_path / "a"))
    blocks = spark.read.parquet(str(tmp_path / "a/blocks")).withColumn("checksum", F_lit_zero())
    blocks.write.parquet(str(tmp_path / "b/blocks"))
    spark.read.parquet(str(tmp_path / "a/frequencies")).write.parquet(str(tmp_path / "b/frequencies"))
    with pytest.raises(Exception, match="damaged"):
        token_store.read_tokens(spark, str(tmp_path / "b")).collect()


def F_lit_zero():
    from pyspark.sql import functions as F

    return F.lit(0).cast("long")


def test_kept_text_digest(spark, sf):
    row = queries.op1_line_dedup(spark, sf).where("n_dropped = 0").orderBy("doc_id").first()
    text = spark.read.parquet(f"{sf}/documents.parquet").where(f"doc_id = {row.doc_id}").first().text
    assert row.kept_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_automata_do_not_depend_on_addresses(monkeypatch):
    monkeypatch.setattr(decontamination, "id", lambda _: 1, raising=False)  # every list at one address
    for word in ("alpha", "beta"):
        shared = SimpleNamespace(value=decontamination._named([(f" {word} ", 1, [word])]))
        assert decontamination.scan_text("alpha beta", decontamination._built(shared))[2] == {word}
        assert decontamination._built(shared) is decontamination._built(shared)
