"""Quality rules whose cutoffs carry a guarantee on false rejection.

Each rule rejects a document if a share (symbols, repeated lines, repeated words, capitals,
word length) exceeds a cutoff.  Cutoffs are chosen per stratum from all labelled documents:
a cutoff is certified if an exact binomial test refutes, at level
``delta / (rules * strata)``, that it rejects more than ``alpha / rules`` of the good
documents.  Cutoffs are tested from the loosest to the tightest and testing stops at the
first that fails, so the grid needs no further correction; rules and strata are corrected
for by Bonferroni.  Of the certified cutoffs the one that separates best is used; a rule
that separates nothing, or has too few labels to be certified, is off in that stratum.
The good documents of a stratum that pass the base rules together then lose more than ``alpha``
with probability ``delta`` at most; the base rules come first and carry no such promise.

Shares are compared on a grid of 64ths in whole numbers, so sums are exact and small:
what reaches one task per stratum is a histogram.

Defined results: null text has no words and fails the base rules; NULL strata are the
stratum ``und``; labels of one id are averaged, NULL ones left out; rows with equal id get
equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.shared import bounded_batches, texts_of
from plinth.staging import stage

GRID = 64
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
# Numerator and denominator of each rule's share.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "word_length": ("word_chars", "20 * n_words"),
}


def _repeat_words(words: list[list[bytes]], width: int = 8) -> np.ndarray:
    """For each text, the words that lie in a window of ``width`` words found twice or more in it.

    Windows are numbered by doubling: equal numbers mean equal words, without hashing.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = [x for w in words for x in w]
    out = np.zeros(len(words), np.int64)
    if len(flat) < width:
        return out
    doc = np.repeat(np.arange(len(words)), sizes)
    number = pd.factorize(flat)[0].astype(np.int64)
    step = 1
    while step < width:
        number = pd.factorize(number[:-step] * (number.max() + 1) + number[step:])[0].astype(np.int64)
        step *= 2
    inside = np.flatnonzero(doc[: len(number)] == doc[width - 1 :])
    group = pd.factorize(number[inside] * len(words) + doc[inside])[0]
    found = inside[np.bincount(group)[group] >= 2] if len(group) else inside
    edge = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + width, -1)
    return np.bincount(doc, np.cumsum(edge[:-1]) > 0, len(words)).astype(np.int64)


def text_statistics(texts: list[str]) -> dict[str, list[int]]:
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    words = [d.split() for d in data]
    lines = [[x for x in d.split(b"\n") if x.strip()] for d in data]
    return {
        "n_words": [len(w) for w in words],
        "word_chars": [len(t) - len(d) + len(d.translate(None, _SPACE)) for t, d in zip(texts, data)],
        "n_symbols": [len(d) - len(d.translate(None, SYMBOLS)) for d in data],
        "n_dup_lines": [len(x) - len(set(x)) for x in lines],
        "n_repeat_words": _repeat_words(words).tolist(),
        "n_lines": [len(x) for x in lines],
        "n_capitals": [len(d) - len(d.translate(None, _CAPITALS)) for d in data],
    }


def with_statistics(docs: DataFrame, columns: list[Column], text_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    source = docs.select(*columns, F.col(text_col).alias("_qr_text"))
    fields = [f for f in source.schema.fields if f.name != "_qr_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = text_statistics(texts_of(batch, "_qr_text"))
            yield pa.record_batch(
                {f.name: batch.column(f.name) for f in fields} | {k: pa.array(v, pa.int64()) for k, v in found.items()}
            )

    schema = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{s} long" for s in STATISTICS)]
    return source.mapInArrow(run, ", ".join(schema))


def _level(rule: str) -> Column:
    """The share in 64ths, rounded up: it exceeds a cutoff of j/64 where this exceeds j."""
    part, whole = (f"({x})" for x in RULES[rule])
    return F.expr(f"if({whole} = 0, 0L, least({GRID + 1}L, ({GRID} * {part} + {whole} - 1) div {whole}))").cast("int")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for n trials with chance p: the regularised incomplete beta function, by continued fraction."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta(b, a, 1 - x)
    return _beta(a, b, x)


def _beta(a: float, b: float, x: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1.0 / max(tiny, 1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 100_000):
        for even in (True, False):
            if even:
                term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            else:
                term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return min(1.0, front * total)


def certified_cutoff(good: np.ndarray, bad: np.ndarray, alpha: float, level: float) -> int:
    """The cutoff for histograms of good and bad documents by share; ``GRID + 1`` switches the rule off."""
    n, best, cutoff = int(good.sum()), 0.0, GRID + 1
    for j in range(GRID, -1, -1):
        rejected = int(good[j + 1 :].sum())
        if not n or binomial_tail(rejected, n, alpha) > level:
            break
        gain = bad[j + 1 :].sum() / max(1, bad.sum()) - 10 * rejected / n
        if gain > best:
            best, cutoff = gain, j
    return cutoff


def cutoffs(statistics: DataFrame, labels: DataFrame, id_col: str, label_col: str, alpha: float, delta: float) -> DataFrame:
    """(stratum, one cutoff for each rule) from ``statistics`` of all labelled documents that pass the base rules."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(
        (F.avg(label_col) >= 0.5).alias("_good")
    )
    levels = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), _level(r).alias("level")) for r in RULES])).alias("l")
    counts = stage(
        statistics.where("NOT base_failed").join(known, id_col).select("stratum", "_good", levels)
        .groupBy("stratum", "l.rule", "l.level")
        .agg(F.count_if("_good").alias("good"), F.count_if(~F.col("_good")).alias("bad")),
        "rule-counts",
    )
    strata = counts.select("stratum").distinct().count()

    def choose(table: pd.DataFrame) -> pd.DataFrame:
        row = {"stratum": table["stratum"].iloc[0]}
        for rule in RULES:
            own = table[table["rule"] == rule]
            good, bad = np.zeros(GRID + 2, np.int64), np.zeros(GRID + 2, np.int64)
            good[own["level"]], bad[own["level"]] = own["good"], own["bad"]
            row[f"cut_{rule}"] = certified_cutoff(good, bad, alpha / len(RULES), delta / (len(RULES) * strata))
        return pd.DataFrame([row])

    # A group is a histogram: at most rules * (GRID + 2) rows.
    return counts.groupBy("stratum").applyInPandas(choose, "stratum string, " + ", ".join(f"cut_{r} int" for r in RULES))


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
    label_col: str = "quality", alpha: float = 0.05, delta: float = 0.05,
) -> DataFrame:
    """Id, stratum, statistics, ``base_failed``, ``kept`` and the names of the rules that reject (``rejected_by``)."""
    columns = [F.col(id_col), F.coalesce(F.col(stratum_col).cast("string"), F.lit("und")).alias("stratum")]
    base = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    found = stage(with_statistics(docs, columns, text_col).withColumn("base_failed", base), "statistics")
    limits = cutoffs(found, labels, id_col, label_col, alpha, delta)
    rejects = [F.when(_level(r) > F.coalesce(F.col(f"cut_{r}"), F.lit(GRID + 1)), F.lit(r)) for r in RULES]
    return found.join(limits, "stratum", "left").withColumn(
        "rejected_by", F.array_compact(F.array(*rejects))
    ).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).select(
        id_col, "stratum", *STATISTICS, "base_failed", "kept", "rejected_by"
    )
