"""Hard negatives by a BOND vertical scan: branch and bound on decomposed vectors.

Vectors are whole numbers, ``floor(scale * x)``; a score is their inner product.

1. Rows are dealt to blocks of about ``block_rows`` and stored by dimension: a column of
   numbers per dimension with its least and greatest value.
2. An anchor reads a block's columns in the order of its own components, largest magnitude
   first.  What is still unread adds at least (at most) the sum, over the unread dimensions, of
   the smaller (larger) of the component times the column's ends; so every candidate has a lower and
   an upper bound.  Rows that cannot come in are struck from the candidate set, until the
   last column makes the scores of those left exact.
3. First pass: candidates have the anchor's label and must reach the least of the best
   ``positives``.  Second pass: candidates have another label and must reach, for one of the
   anchor's positives, its window of scores and the least of the best ``negatives`` in it.

Anchors against rows is the work asked for. It is done in cells of a group of anchors and a
shelf of blocks, both bounded, whatever the size of the table; bests found in one block
prune the next of the shelf, and a cell sends on only its bests.

Defined results: rows with a null id, label or vector, or with a null, NaN or infinite component
take no part; vectors of different lengths do not meet; rows that repeat an id are rows of their
own, and an anchor leaves out only its own row; ties go by smaller id; an anchor without
positives gives nothing; a positive with an empty window gives nothing; an empty table gives none; other columns are
ignored.  A scaled component of 2**28 or more fails the job, since scores could overflow.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.shared import bounded_batches
from plinth.operators.attach import attach
from plinth.staging import stage

BLOCK_ROWS = 8192
ANCHOR_ROWS = 1024
SHELF_BLOCKS = 16
_STEP = 8  # columns read between two prunings
_LARGEST = 1 << 28


def whole_vectors(df: DataFrame, anchor: Column, id_column: str, vector: str, label: str, scale: int) -> DataFrame:
    """(row, id, label, anchor, width, v): the rows that take part, numbered."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    fit = F.forall(x, lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False)))
    whole = F.transform(x, lambda c: F.when(
        F.abs(c) * scale < _LARGEST - 1, F.floor(c * scale).cast("int")
    ).otherwise(F.raise_error(F.lit(f"a component times {scale} is 2**28 or more")).cast("int")))
    named = F.col(id_column).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()
    return df.where(named & fit).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("bigint").alias("id"),
        F.col(label).cast("bigint").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.size(vector).alias("width"), whole.alias("v"),
    )


_BLOCK = (
    "width int, block int, row binary, id binary, label binary, low array<int>, high array<int>, columns array<binary>"
)


def _decompose(rows: pd.DataFrame) -> pd.DataFrame:
    """One block by dimension; rows in the order of ties."""
    rows = rows.sort_values(["id", "row"])
    table = np.array(rows["v"].tolist(), np.int32).reshape(len(rows), -1)
    out = {c: [rows[c].iloc[0]] for c in ("width", "block")}
    out |= {c: [rows[c].to_numpy(np.int64).tobytes()] for c in ("row", "id", "label")}
    out |= {"low": [table.min(axis=0)], "high": [table.max(axis=0)]}
    return pd.DataFrame(out | {"columns": [[c.tobytes() for c in np.ascontiguousarray(table.T)]]})


class Block:
    """A stored block, read back."""

    def __init__(self, stored) -> None:
        self.row, self.id, self.label = (np.frombuffer(getattr(stored, c), np.int64) for c in ("row", "id", "label"))
        self.low, self.high = (np.asarray(getattr(stored, c), np.int64) for c in ("low", "high"))
        self.columns = [np.frombuffer(c, np.int32).astype(np.int64) for c in stored.columns]

    def scan(self, anchor: np.ndarray, candidates: np.ndarray, prune) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the candidates that ``prune(lower, upper)`` keeps to the end."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.sort([anchor * self.low, anchor * self.high], axis=0)[:, order]
        # What the columns from each place on can add, at least and at most.
        least, most = (np.r_[np.cumsum(e[::-1])[::-1], 0] for e in ends)
        at, sums = candidates, np.zeros(len(candidates), np.int64)
        for start in range(0, len(order), _STEP):
            if not len(at):
                break
            for d in order[start:start + _STEP]:
                if anchor[d]:
                    sums += anchor[d] * (self.columns[d] if len(at) == len(self.id) else self.columns[d][at])
            read = min(start + _STEP, len(order))
            keep = prune(sums + least[read], sums + most[read])
            if not keep.all():
                at, sums = at[keep], sums[keep]
        return at, sums


def _kth(values: np.ndarray, k: int) -> int | None:
    return np.partition(values, len(values) - k)[-k] if len(values) >= k else None


class _Best:
    """The first ``k`` of what was offered, by score, id and row."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.score = self.id = self.row = np.zeros(0, np.int64)

    def offer(self, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        score, ids, rows = (np.r_[a, b] for a, b in ((self.score, score), (self.id, ids), (self.row, rows)))
        first = np.lexsort((rows, ids, -score))[: self.k]
        self.score, self.id, self.row = score[first], ids[first], rows[first]

    def reached_by(self, lower: np.ndarray, least: int | None = None) -> int | None:
        """A score that the first ``k`` reach, if ``lower`` are scores at least; never below ``least``."""
        bounds = [b for b in (least, _kth(self.score, self.k), _kth(lower, self.k)) if b is not None]
        return max(bounds) if bounds else None


def _positives(k: int):
    def run(anchors: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = [Block(b) for b in blocks.itertuples()]
        out = []
        for a in anchors.itertuples():
            vector, best = np.asarray(a.v, np.int64), _Best(k)

            def prune(lower, upper):
                floor = best.reached_by(lower)
                return np.ones(len(upper), bool) if floor is None else upper >= floor

            for block in blocks:
                mine = np.flatnonzero((block.label == a.label) & (block.row != a.row))
                at, score = block.scan(vector, mine, prune)
                best.offer(score, block.id[at], block.row[at])
            out.append(pd.DataFrame({"row": a.row, "positive_row": best.row, "positive_id": best.id, "score": best.score}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("row", "positive_row", "positive_id", "score")})

    return run


def _negatives(k: int, low: int, high: int):
    """``low`` and ``high`` are the window's ends in hundredths of the positive's score."""
    columns = ["row", "positive", "negative_row", "negative_id", "negative_score"]

    def run(anchors: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = [Block(b) for b in blocks.itertuples()]
        out = []
        for a in anchors.itertuples():
            vector = np.asarray(a.v, np.int64)
            windows = [(-(-low * s // 100), high * s // 100, _Best(k)) for s in np.asarray(a.scores, np.int64).tolist()]

            def prune(lower, upper):
                keep = np.zeros(len(lower), bool)
                for least, most, best in windows:
                    inside = lower[(lower >= least) & (upper <= most)]
                    keep |= (upper >= best.reached_by(inside, least)) & (lower <= most)
                return keep

            for block in blocks:
                at, score = block.scan(vector, np.flatnonzero(block.label != a.label), prune)
                for least, most, best in windows:
                    fits = (score >= least) & (score <= most)
                    best.offer(score[fits], block.id[at[fits]], block.row[at[fits]])
            for number, (_, _, best) in enumerate(windows):
                if len(best.row):
                    found = zip(columns, (a.row, number, best.row, best.id, best.score))
                    out.append(pd.DataFrame(dict(found)))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in columns})

    return run


def mine(
    df: DataFrame, anchor: Column, id_column: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS, shelf_blocks: int = SHELF_BLOCKS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For every row that ``anchor`` marks: its first ``positives`` other rows of its label and,
    for each, the first ``negatives`` rows of other labels whose score lies from ``low`` to ``high`` hundredths of the positive's.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    rows = stage(whole_vectors(df, anchor, id_column, vector, label, scale), "whole-vectors")
    cores = spark.sparkContext.defaultParallelism
    widths = rows.groupBy("width").agg(F.count("row").alias("rows"), F.sum(F.col("anchor").cast("long")).alias("anchors"))
    widths = widths.withColumns({
        "blocks": F.ceil(F.col("rows") / block_rows).cast("int"),
        "groups": F.greatest(F.ceil(F.col("anchors") / anchor_rows), F.lit(1)).cast("int"),
    })
    # Shelves are as long as leaves two cells a core, and bounded.
    length = F.greatest(F.lit(1), F.least(F.lit(shelf_blocks), F.floor(F.col("blocks") * F.col("groups") / (2 * cores))))
    widths = stage(widths.withColumn("shelves", F.ceil(F.col("blocks") / length).cast("int")), "widths")
    placed = attach(rows, widths.drop("anchors"), ["width"], "rows")

    own = F.xxhash64("row", F.lit("block"))
    dealt = placed.withColumn("block", F.pmod(own, "blocks").cast("int"))
    stored = dealt.select("width", "block", "row", "id", "label", "v").groupBy("width", "block").applyInPandas(
        _decompose, _BLOCK
    )
    stored = stage(attach(stored, widths.drop("anchors"), ["width"], "rows"), "blocks")
    shelved = stored.withColumn("shelf", F.pmod(F.col("block"), "shelves")).withColumn(
        "group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))
    ).select("width", "shelf", "group", "row", "id", "label", "low", "high", "columns")
    anchors = placed.where("anchor").withColumn("group", F.pmod(F.xxhash64("row"), "groups").cast("int"))

    def meet(anchors: DataFrame, work, schema: str) -> DataFrame:
        each = anchors.withColumn("shelf", F.explode(F.sequence(F.lit(0), F.col("shelves") - 1))).drop("shelves")
        cell = ["width", "shelf", "group"]
        return each.groupBy(cell).cogroup(shelved.groupBy(cell)).applyInPandas(work, schema)

    about = ["width", "group", "shelves", "row", "id", "label", "v"]
    near = meet(anchors.select(about), _positives(positives), "row long, positive_row long, positive_id long, score long")
    first = Window.partitionBy("row").orderBy(F.col("score").desc(), "positive_id", "positive_row")
    near = near.withColumn("positive", F.row_number().over(first) - 1).where(F.col("positive") < positives)
    listed = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("positive", "positive_id", "score"))).alias("near"))
    known = stage(
        anchors.select(about).join(listed, "row").withColumn("scores", F.col("near.score")), "positives"
    )
    found = meet(
        known.select(*about, "scores"), _negatives(negatives, low, high),
        "row long, positive int, negative_row long, negative_id long, negative_score long",
    )
    order = Window.partitionBy("row", "positive").orderBy(F.col("negative_score").desc(), "negative_id", "negative_row")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    pairs = known.select("row", F.col("id").alias("anchor_id"), F.inline("near"))
    return pairs.join(found, ["row", "positive"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score"
    )
