"""How far the term shares of each source of a language lie from the others', from count-level bitmaps.

Terms are runs of letters (A-Z lower-cased) and of characters beyond ASCII; a language keeps
those in at least ``min_docs`` of its documents.  A group (language, source) gives a kept term the
share ``p = 1 + floor(scale * (count + smoothing) / (N + smoothing * V))``, in whole numbers.

1. Map tasks count terms per group and send one row per group and term, not per occurrence.
2. The V kept terms of a language are dealt to blocks and numbered there, frequent ones first.
   For every (group, count) a block stores the bitset of its terms, in words of 64 terms.
   All terms of a bitset have one share, so shares are worked out per level, not per term.
3. A task gets one block of terms and two blocks of sources. For two groups, AND and popcount
   of the words of two levels give the joint cell, multiplied by ``f = abs(p - q)``.  Terms of
   count zero are not stored: their cells are what the stored levels leave over.
4. The sums of the blocks are added up per pair of sources, and ranked.

Defined results: null text, language and source are empty strings; a group without terms has all
its counts zero; a language without kept terms gives its pairs the value 0 and no terms; a single
source has no pairs; ties go by item in UTF-8 order; an empty table gives none; other columns are
ignored.  A source is compared with each other of its language, so the result has as many rows
as there are such pairs; no task holds more than two blocks of sources.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.shared import bounded_batches
from plinth.operators.attach import attach
from plinth.staging import stage

BLOCK_TERMS = 4096
BLOCK_SOURCES = 64
FLUSH_TERMS = 300_000  # counted terms a map task holds before it sends them on
_ONE_DOC = 1 << 40  # occurrences below, documents above, in one number

# Letters in lower case and bytes beyond ASCII stand; all others separate.
_TO_TERMS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_TERMS).split(b" ")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, docs); the null term counts the group's documents."""
    counts: dict[tuple[str, str], dict] = {}
    held = 0

    def flush() -> pa.RecordBatch:
        columns = [], [], [], []
        for group, found in counts.items():
            columns[0].extend([group[0]] * len(found))
            columns[1].extend([group[1]] * len(found))
            columns[2].extend(found)
            columns[3].extend(found.values())
        both = np.array(columns[3], np.int64)
        terms = pa.array(columns[2], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), terms,
             pa.array(both & (_ONE_DOC - 1)), pa.array(both >> 40)], ["lang", "source", "term", "n", "docs"]
        )

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            found = counts.setdefault((lang, source), {None: 0})
            before = len(found)
            found[None] += _ONE_DOC
            for term, n in Counter(terms_of(text)).items():
                if term:
                    found[term] = found.get(term, 0) + n + _ONE_DOC
            held += len(found) - before
            if held > FLUSH_TERMS:
                yield flush()
                counts, held = {}, 0
    if counts:
        yield flush()


def _share(n: Column, total: Column, scale: int, smoothing: int) -> Column:
    """``1 + floor(scale * (n + smoothing) / total)``, exact."""
    top = F.lit(scale).cast("decimal(12,0)") * (n + F.lit(smoothing)).cast("decimal(19,0)")
    return (F.lit(1) + F.call_function("div", top, total.cast("decimal(19,0)"))).cast("bigint")


def _joint(table: pd.DataFrame) -> tuple[list[str], list[str], np.ndarray]:
    """Names of the sources of two blocks and their sums over one block of terms.

    ``table`` holds per source a header (word -1, its name, zero's share and the number of terms) and
    per level of a word the bitset and the share.
    """
    heads = table[table["word"] < 0]
    blocks = np.unique(table["block"])
    sides = []
    for block in (blocks[0], blocks[-1]):
        mine = heads[heads["block"] == block].sort_values("number")
        sides.append((mine["source"].tolist(), mine["number"].to_numpy(), mine["p"].to_numpy(np.int64)))
    (names_a, numbers_a, zero_a), (names_b, numbers_b, zero_b) = sides
    out = np.zeros((len(names_a), len(names_b)), np.int64)
    left = np.full(out.shape, int(heads["terms"].iloc[0]), np.int64)  # terms of count zero in both

    levels = table[table["word"] >= 0].sort_values(["word", "number", "n"], kind="stable")
    words = levels["word"].to_numpy(np.int64)
    number, share = levels["number"].to_numpy(np.int64), levels["p"].to_numpy(np.int64)
    bits = levels["bits"].to_numpy(np.int64).view(np.uint64)
    size = np.bitwise_count(bits).astype(np.int64)
    is_a, is_b = np.isin(number, numbers_a), np.isin(number, numbers_b)

    def runs(values: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)

    edges = np.r_[runs(words), len(words)]
    for start, stop in zip(edges[:-1], edges[1:]):
        of_word = np.arange(start, stop)
        a, b = of_word[is_a[start:stop]], of_word[is_b[start:stop]]
        starts_b = runs(number[b])
        at_b = np.searchsorted(numbers_b, number[b][starts_b])
        p_b, bits_b, size_b = share[b], bits[b], size[b]
        if len(b):
            # Terms of b's levels, all taken as zero in a, until a's levels claim theirs.
            gap = size_b * np.abs(zero_a[:, None] - p_b)
            out[:, at_b] += np.add.reduceat(gap, starts_b, axis=1)
            left[:, at_b] -= np.add.reduceat(size_b, starts_b)
        cuts = np.r_[runs(number[a]), len(a)]
        for first, last in zip(cuts[:-1], cuts[1:]):
            rows = a[first:last]
            at_a = np.searchsorted(numbers_a, number[rows[0]])
            p_a, size_a = share[rows], size[rows]
            out[at_a] += (size_a[:, None] * np.abs(p_a[:, None] - zero_b)).sum(0)
            left[at_a] -= size_a.sum()
            if not len(b):
                continue
            cells = np.bitwise_count(bits[rows][:, None] & bits_b).astype(np.int64)
            shared = np.add.reduceat(cells, starts_b, axis=1)
            gain = (cells * (np.abs(p_a[:, None] - p_b) - np.abs(zero_a[at_a] - p_b))).sum(0)
            out[at_a, at_b] += np.add.reduceat(gain, starts_b)
            out[at_a, at_b] -= (shared * np.abs(p_a[:, None] - zero_b[at_b])).sum(0)
            left[at_a, at_b] += shared.sum(0)
    out += left * np.abs(zero_a[:, None] - zero_b)
    return names_a, names_b, out


def _pairs(table: pd.DataFrame) -> pd.DataFrame:
    names_a, names_b, sums = _joint(table)
    n_a, n_b = sums.shape
    a, b, value = np.repeat(names_a, n_b), np.tile(names_b, n_a), sums.ravel()
    if table["block"].nunique() == 1:
        other = np.repeat(np.arange(n_a), n_b) != np.tile(np.arange(n_b), n_a)
        a, b, value = a[other], b[other], value[other]
    else:
        a, b, value = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([value, value])
    return pd.DataFrame({"lang": table["lang"].iloc[0], "source": a, "item": b, "value": value})


def audit(
    docs: DataFrame, stratum: str = "lang", group: str = "source", text: str = "text", min_docs: int = 30,
    smoothing: int = 5, scale: int = 1_000_000_000, top_terms: int = 50, block_terms: int = BLOCK_TERMS,
    block_sources: int = BLOCK_SOURCES,
) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other source with the summed distance of all
    kept terms, part ``term`` the ``top_terms`` terms the source uses most above its language."""
    bounded_batches(docs.sparkSession)
    empty = F.lit("")
    rows = docs.select(
        F.coalesce(F.col(stratum).cast("string"), empty).alias("lang"),
        F.coalesce(F.col(group).cast("string"), empty).alias("source"),
        F.coalesce(F.col(text), empty).cast("binary").alias("text"),
    )
    counted = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    # All rows of a term meet once: its groups' counts, its documents and its language's count.
    of_term = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )
    everywhere = Window.partitionBy("lang", "term")
    kept = stage(
        of_term.withColumns({"lang_n": F.sum("n").over(everywhere), "lang_docs": F.sum("docs").over(everywhere)})
        .where(F.col("term").isNull() | (F.col("lang_docs") >= min_docs))
        .select("lang", "term", "source", "n", "lang_n"),
        "kept-terms",
    )
    counts = kept.where("term IS NOT NULL")

    words = counts.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"))
    langs = stage(
        kept.where("term IS NULL").groupBy("lang").agg(F.count("source").alias("sources")).join(
            words.groupBy("lang").agg(F.count("term").alias("v"), F.sum("lang_n").alias("lang_total")), "lang", "left"
        ).select(
            "lang", "sources", F.coalesce("v", F.lit(0)).alias("v"),
            (F.coalesce("lang_total", F.lit(0)) + smoothing * F.coalesce("v", F.lit(0))).alias("lang_total"),
            F.greatest(F.lit(1), F.ceil(F.col("v") / block_terms)).cast("int").alias("term_blocks"),
            F.ceil(F.col("sources") / block_sources).cast("int").alias("source_blocks"),
        ),
        "languages",
    )
    in_lang = Window.partitionBy("lang").orderBy("source")
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("term").alias("terms_here"))
    groups = attach(
        kept.where("term IS NULL").select("lang", "source").join(sizes, ["lang", "source"], "left")
        .withColumn("number", F.row_number().over(in_lang).cast("long") - 1),
        langs, ["lang"], "sources",
    )
    groups = stage(
        groups.select(
            "lang", "source", "number", F.floor(F.col("number") / block_sources).cast("int").alias("block"),
            (F.coalesce("size", F.lit(0)) + smoothing * F.col("v")).alias("total"), "lang_total",
            F.coalesce("terms_here", F.lit(0)).alias("terms_here"), "term_blocks", "source_blocks",
        ),
        "groups",
    )

    # Terms to blocks, and to words and bits of their block.
    term_rows = F.struct(F.col("lang_n").alias("n"), "term")
    placed = attach(words, langs.select("lang", "term_blocks", F.col("v")), ["lang"], "v").withColumn(
        "term_block", F.pmod(F.xxhash64("term"), "term_blocks").cast("int")
    )
    in_block = Window.partitionBy("lang", "term_block").orderBy(term_rows.desc())
    placed = placed.withColumn("place", F.row_number().over(in_block) - 1).select(
        "lang", "term", "term_block", (F.col("place") / 64).cast("int").alias("word"), (F.col("place") % 64).alias("bit")
    )
    placed = stage(placed, "term-places")
    per_block = placed.groupBy("lang", "term_block").agg(F.count("term").alias("terms"))

    grouped = attach(counts, groups, ["lang", "source"], "terms_here")
    shared = grouped.join(placed, ["lang", "term"]).groupBy("lang", "source", "term_block", "word", "n").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).alias("bits"),
        *[F.first(c).alias(c) for c in ("number", "block", "total", "source_blocks")],
    )
    none = F.lit(0).cast("bigint")  # not NULL, which would turn the bitsets of a pandas column into floats

    def cell(*columns) -> list:
        return ["lang", "term_block", "block", "number", *columns, "source_blocks"]

    levels = shared.withColumn("p", _share(F.col("n"), F.col("total"), scale, smoothing)).select(
        *cell(F.lit("").alias("source"), "word", "n", "bits", "p", none.alias("terms"))
    )
    heads = groups.withColumn("term_block", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)))
    heads = heads.join(per_block, ["lang", "term_block"], "left").select(*cell(
        "source", F.lit(-1).alias("word"), none.alias("n"), none.alias("bits"),
        F.when(F.col("total") > 0, _share(F.lit(0), F.col("total"), scale, smoothing)).otherwise(0).alias("p"),
        F.coalesce("terms", F.lit(0)).alias("terms"),
    ))
    bitmaps = stage(levels.unionByName(heads), "count-levels")
    met = bitmaps.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("source_blocks") - 1))).withColumns(
        {"low": F.least("block", "_other"), "high": F.greatest("block", "_other")}
    )
    sums = met.drop("_other", "source_blocks").groupBy("lang", "term_block", "low", "high").applyInPandas(
        _pairs, "lang string, source string, item string, value long"
    )
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))

    excess = (
        _share(F.col("n"), F.col("total"), scale, smoothing) - _share(F.col("lang_n"), F.col("lang_total"), scale, smoothing)
    )
    above = grouped.select("lang", "source", F.col("term").alias("item"), excess.alias("value")).where("value > 0")
    above = above.withColumn("part", F.lit("term"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).unionByName(
        above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    )
    return ranked.select("lang", "source", "part", "item", "value", "rank")
