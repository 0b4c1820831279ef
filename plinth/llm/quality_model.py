"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from the whole text in the tasks.  The trees are grown in numpy on the
driver from the statistics of a bounded sample of labelled rows (``max_rows``, those with
the smallest hash of their id), flattened into arrays and applied tree by tree, all rows of a
batch moving down one level of the tree at a time.

Defined results: null text counts as empty and gets a score; labels of one id are averaged
and NULL labels and ids are left out; without labels of both kinds the score is the share
of label 1, or 0.5 with none; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.shared import bounded_batches, texts_of

# Bytes counted by kind; a share of all bytes is a statistic.
KINDS = (
    b"#*$%&", b"|<>", b"!?", b".,;:", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"@/\\_=+~^", bytes(range(128, 256)),
)
STATISTICS = len(KINDS) + 13


def statistics(text: str) -> list[float]:
    data = text.encode("utf-8", "surrogatepass")
    size = max(1, len(data))
    kinds = [(len(data) - len(data.translate(None, kind))) / size for kind in KINDS]
    words = data.split()
    n = max(1, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    letters = sum(map(len, words))
    return [
        *kinds,
        np.log1p(len(words)), np.log1p(len(lines)), letters / n, max(map(len, words), default=0),
        len(set(words)) / n, len(set(zip(words, words[1:]))) / n, repeats / n,
        len(set(lines)) / n_lines, n / n_lines, max(map(len, lines), default=0) / size,
        sum(x.endswith((b".", b"!", b"?")) for x in lines) / n_lines,
        sum(len(w) <= 3 for w in words) / n,
        sum(w[-1:] in b"!#*$%&|" for w in words) / n,
    ]


@dataclass
class Trees:
    """Complete binary trees of one depth, level by level: node ``i`` has the children ``2 i + 1`` and ``2 i + 2``."""

    feature: np.ndarray  # (trees, 2 ** depth - 1)
    limit: np.ndarray
    leaf: np.ndarray  # (trees, 2 ** depth)
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit_trees(
    x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0
) -> Trees:
    """Boosted trees for the logistic loss; every split is chosen from histograms of at most ``bins`` quantile bins."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share))) if len(y) else 0.0
    inner = 2**depth - 1
    if len(np.unique(y)) < 2:
        return Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)
    out, raw = [], np.full(len(y), base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        gradient, curvature = y - p, p * (1 - p)
        feature, limit = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best, where = np.full(width, 1e-6), np.full((width, 2), -1)
            for j, e in enumerate(edges):
                k = len(e) + 1
                cell = at * k + binned[:, j]
                g = np.bincount(cell, gradient, width * k).reshape(width, k)
                h = np.bincount(cell, curvature, width * k).reshape(width, k)
                left_g, left_h = np.cumsum(g, 1)[:, :-1], np.cumsum(h, 1)[:, :-1]
                all_g, all_h = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
                if gain.shape[1]:
                    cut = gain.argmax(1)
                    better = gain[np.arange(width), cut] > best
                    best[better], where[better] = gain[better, cut[better]], np.stack([np.full(width, j), cut], 1)[better]
            for i, (j, cut) in enumerate(where):
                if j >= 0:
                    feature[first + i], limit[first + i] = j, edges[j][cut]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > limit[node])
        at = node - inner
        g, h = np.bincount(at, gradient, inner + 1), np.bincount(at, curvature, inner + 1)
        leaf = rate * g / (h + ridge)
        raw += leaf[at]
        out.append((feature, limit, leaf))
    feature, limit, leaf = (np.array(t) for t in zip(*out))
    return Trees(feature, limit, leaf, base)


def _with_statistics(docs: DataFrame, extra: list[Column], text_col: str) -> DataFrame:
    """The columns ``extra`` and an array of statistics."""
    bounded_batches(docs.sparkSession)
    source = docs.select(*extra, F.col(text_col).alias("_qm_text"))
    fields = [f for f in source.schema.fields if f.name != "_qm_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [statistics(t) for t in texts_of(batch, "_qm_text")]
            yield pa.record_batch({
                **{f.name: batch.column(f.name) for f in fields},
                "_qm_statistics": pa.array(values, pa.list_(pa.float64())),
            })

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return source.mapInArrow(run, schema + ", _qm_statistics array<double>")


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", max_rows: int = 20_000,
) -> Trees:
    """Trees from at most ``max_rows`` labelled documents for which ``usable`` (an expression on the id) holds."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy(F.col(id_col).alias("_qm_id")).agg(F.avg(label_col).alias("_qm_label"))
    sample = known.orderBy(F.xxhash64("_qm_id"), "_qm_id").limit(max_rows)  # at most max_rows short rows
    labelled = docs.select(F.col(id_col).alias("_qm_id"), F.col(text_col).alias("_qm_t")).join(F.broadcast(sample), "_qm_id")
    rows = _with_statistics(labelled, [F.col("_qm_id"), F.col("_qm_label")], "_qm_t").collect()
    rows.sort(key=lambda r: (str(r["_qm_id"]), r["_qm_statistics"]))
    x = np.array([r["_qm_statistics"] for r in rows], float).reshape(-1, STATISTICS)
    return fit_trees(x, np.array([r["_qm_label"] >= 0.5 for r in rows], float))


def score(docs: DataFrame, trees: Trees, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of every row (all by default), with ``score`` from 0 to 1 and ``predicted``."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # rounds * 2 ** depth numbers
    bounded_batches(docs.sparkSession)
    own = text_col in names  # then it need not travel twice
    source = docs.select(*names, *([] if own else [F.col(text_col).alias("_qm_text")]))
    column = text_col if own else "_qm_text"
    carried = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields if f.name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in texts_of(batch, column)], float).reshape(-1, STATISTICS)
            value = shared.value.scores(x)
            yield pa.record_batch({
                **{c: batch.column(c) for c in names},
                "score": pa.array(value), "predicted": pa.array((value >= 0.5).astype(np.int32)),
            })

    return source.mapInArrow(run, carried + "score double, predicted int")
