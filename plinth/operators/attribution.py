"""Additive per-row attributions of a prediction, and what is reported from them.

An attribution frame has the key columns and ``attributions``: an array of
``(slot, raw_feature, feature_value, contribution)``, one element per model slot.
Contributions are in the space the model was fitted in (log price).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.functions.text import feature_label
from plinth.operators.features import FEATURES, INDEXED
from plinth.operators.trees import TreeModel
from plinth.staging import stage

# Tasks get the functions below by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_NODE_BYTES = 45  # of a node in a broadcast
_ROWS_AT_ONCE = 2048


def linear_attributions(
    df: DataFrame, keys: Sequence[str], values: Column, names: Sequence[str], weights: Sequence[float],
    means: Sequence[float],
) -> DataFrame:
    """``w * (x - mean)`` per slot of a linear model; ``values`` is an array column in slot order."""
    name, weight, mean = (F.array(*[F.lit(v) for v in column]) for column in (names, weights, means))

    def slot(x: Column, i: Column) -> Column:
        part = F.get(weight, i) * (x - F.get(mean, i))
        return F.struct(
            i.alias("slot"), F.get(name, i).alias("raw_feature"), x.alias("feature_value"), part.alias("contribution")
        )

    return df.select(*keys, F.transform(values, slot).alias("attributions"))


def expected_value(model: TreeModel) -> float:
    """Prediction when no feature is known: leaves weighed by their training rows."""
    weight = np.zeros(len(model.slot))
    weight[model.roots] = 1.0
    level = model.roots
    while len(level := level[~model.is_leaf[level]]):
        for side in (model.left, model.right):
            weight[side[level]] = weight[level] * model.rows[side[level]] / model.rows[level]
        level = np.concatenate([model.left[level], model.right[level]])
    return float(model.base + (weight * model.value)[model.is_leaf].sum())


def used_slots(model: TreeModel) -> list[int]:
    return sorted(set(model.slot[~model.is_leaf].tolist()))


class TreePaths:
    """A tree laid out for attribution.

    The players of a leaf are the distinct slots on its path; a row follows a player if it goes the
    leaf's way at all splits of the slot. ``steps`` leads from the root down: each node has the
    player that its parent's split adds or narrows.
    """

    def __init__(self, model: TreeModel, root: int, place: Mapping[int, int]) -> None:
        self.steps: list[tuple] = []  # node, parent, place of the slot, threshold, nominal, is left, player, is new
        self.root = root
        by_size: dict[int, list] = {}
        pending = [(root, (), ())]
        while pending:
            node, slots, shares = pending.pop()
            if model.left[node] == node:
                by_size.setdefault(len(slots), []).append((node, slots, shares))
                continue
            slot = place[int(model.slot[node])]
            new = slot not in slots
            player = len(slots) if new else slots.index(slot)
            for child, is_left in ((int(model.left[node]), True), (int(model.right[node]), False)):
                part = float(model.rows[child] / model.rows[node])
                so_far = (*shares, part) if new else (*shares[:player], shares[player] * part, *shares[player + 1:])
                self.steps.append((
                    child, node, slot, float(model.threshold[node]), bool(model.nominal[node]), is_left, player, new
                ))
                pending.append((child, (*slots, slot) if new else slots, so_far))
        # A node's parent comes before it: children are added as their parent is left.
        self.groups = [
            (k, [leaf[0] for leaf in leaves], np.array([leaf[1] for leaf in leaves]),
             np.array([leaf[2] for leaf in leaves]), model.value[[leaf[0] for leaf in leaves]])
            for k, leaves in sorted(by_size.items()) if k
        ]

    def tables(self, rows: int) -> list[np.ndarray | None]:
        """Of each group the values of all patterns, or None if ``rows`` have fewer."""
        out: list[np.ndarray | None] = []
        for k, nodes, _, shares, values in self.groups:
            known = None
            if 1 << k <= max(rows, 64):
                patterns = (np.arange(1 << k)[:, None] >> np.arange(k)) & 1
                known = leaf_shapley(values, shares, np.broadcast_to(patterns, (len(nodes), *patterns.shape)))
                known = np.ascontiguousarray(known.transpose(0, 2, 1))  # leaf, player, pattern
            out.append(known)
        return out

    def add_to(self, out: np.ndarray, columns: np.ndarray, tables: Sequence[np.ndarray | None]) -> None:
        """Add the tree's contributions to ``out``, both by used slot and row."""
        n, most = columns.shape[1], max((g[0] for g in self.groups), default=0)
        kind = np.uint8 if most <= 8 else np.uint16 if most <= 16 else np.int64
        codes = {self.root: np.zeros(n, kind)}
        for node, parent, slot, threshold, nominal, is_left, player, new in self.steps:
            passes = (columns[slot] == threshold) if nominal else (columns[slot] <= threshold)
            if new:
                bit = (passes if is_left else ~passes).astype(kind)
                codes[node] = codes[parent] | (bit << kind(player))
            else:
                fails = (~passes if is_left else passes).astype(kind)
                codes[node] = codes[parent] & ~(fails << kind(player))
        for (k, nodes, slots, shares, values), known in zip(self.groups, tables):
            for leaf, node in enumerate(nodes):
                which = codes[node]
                if known is not None:
                    of_leaf, which = known[leaf], which.astype(np.intp)
                else:  # only the patterns that occur
                    seen, which = np.unique(which, return_inverse=True)
                    patterns = (seen[None, :, None].astype(np.int64) >> np.arange(k)) & 1
                    of_leaf, which = leaf_shapley(values[leaf:leaf + 1], shares[leaf:leaf + 1], patterns)[0].T, which.reshape(-1)
                for player, slot in enumerate(slots[leaf].tolist()):
                    out[slot] += of_leaf[player].take(which)


@lru_cache
def _gauss(count: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(count)


def leaf_shapley(values: np.ndarray, shares: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Shapley values of leaves for 0/1 patterns of followed players: (leaves, patterns, players).

    With a set S of known players a leaf counts ``value * prod_S follows * prod_rest share`` (the path-dependent
    expectation). The weights of the sets are integrals of ``t^|S| (1 - t)^|rest|``, so player i gets
    ``value * (follows_i - share_i)`` times the integral over t of the product of ``follows_j t + share_j (1 - t)`` over
    the others: a polynomial, which Gauss-Legendre points integrate exactly. No set is enumerated.
    """
    k = shares.shape[1]
    points, weights = _gauss((k + 1) // 2)
    points, weights = (points + 1) / 2, weights / 2
    share, follow = shares[:, None, :], follows.astype(float)
    total = np.zeros(follow.shape)
    for t, weight in zip(points, weights):
        factor = follow * t + share * (1 - t)
        product = factor.prod(axis=2, keepdims=True)
        total += weight * np.divide(product, factor, out=np.zeros(factor.shape), where=factor > 0)
    return values[:, None, None] * (follow - share) * total


def contributions(trees: Sequence[TreePaths], x: np.ndarray) -> np.ndarray:
    """Contributions of the used slots for a batch ``x`` of the same slots."""
    out, columns = np.zeros(x.shape[::-1]), np.ascontiguousarray(x.T)
    for tree in trees:
        tables = tree.tables(min(len(x), _ROWS_AT_ONCE))
        for start in range(0, len(x), _ROWS_AT_ONCE):
            part = slice(start, start + _ROWS_AT_ONCE)
            tree.add_to(out[:, part], columns[:, part], tables)
    return out.T


def tree_blocks(model: TreeModel, max_bytes: int) -> list[tuple[int, int]]:
    """Ranges of trees whose nodes take at most ``max_bytes`` (or one tree)."""
    ends = [*model.roots[1:].tolist(), len(model.slot)]
    out, first = [], 0
    for tree, end in enumerate(ends):
        if tree > first and (end - model.roots[first]) * _NODE_BYTES > max_bytes:
            out.append((first, tree))
            first = tree
    return [*out, (first, len(ends))] if len(ends) else []


def tree_attributions(
    df: DataFrame, keys: Sequence[str], model: TreeModel, names: Sequence[str], values: Column | None = None,
    categories: Mapping[int, Sequence[str]] | None = None, max_bytes: int = 64 << 20,
) -> DataFrame:
    """Path-dependent tree Shapley values of every row; only the slots the trees use are listed.

    ``values`` is an array column in slot order (default: the ``features`` vector, or
    ``indexed`` if ``categories`` names its nominal slots). A nominal slot reports the category
    the row has, ``<slot name>_<category>``, with the value 1, as its one-hot slot would; a
    category unknown to the model reports 0. Rows stay where they are; each task works
    through its Arrow batches with the broadcast trees. Trees above ``max_bytes`` go in blocks, each
    adding to the staged sums of those before.
    """
    if values is None:
        values = vector_to_array(FEATURES if categories is None else INDEXED)
    slots = used_slots(model)
    labels = {i: list(categories[s]) for i, s in enumerate(slots) if s in (categories or {})}
    used = [names[s] for s in slots]
    is_used = F.expr("array(" + ",".join(str(i in set(slots)).lower() for i in range(len(names))) + ")")
    # The array is an argument of `filter`, so a vector is unpacked once per row, not once per slot.
    explained = df.select(
        *keys, F.filter(values, lambda x, i: F.get(is_used, i)).alias("feature_value"),
        F.array_repeat(F.lit(0.0), len(slots)).alias("contribution"),
    )

    def adding(block):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            nodes, place = block.value
            trees = [TreePaths(nodes, int(root), place) for root in nodes.roots]
            for batch in batches:
                x, before = (
                    np.array(batch[c].tolist(), dtype=float).reshape(len(batch), len(slots))
                    for c in ("feature_value", "contribution")
                )
                yield batch.assign(contribution=list(before + contributions(trees, x)))

        return run

    spark = df.sparkSession
    place = {slot: i for i, slot in enumerate(slots)}
    for number, (first, last) in enumerate(tree_blocks(model, max_bytes) if slots else []):
        if number:
            explained = stage(explained, "explained")
        block = spark.sparkContext.broadcast((model.part(first, last), place))
        explained = explained.mapInPandas(adding(block), explained.schema)

    named = [F.lit(n) for n in used]
    shown = [F.get("feature_value", F.lit(i)) for i in range(len(used))]
    for i, of_slot in labels.items():
        # One row per category the model knows; the row's number finds its name.
        known = spark.createDataFrame(pd.DataFrame({f"_number{i}": range(len(of_slot)), f"_label{i}": of_slot}))
        number = F.get("feature_value", F.lit(i)).cast("long")
        explained = explained.join(F.broadcast(known), number == F.col(f"_number{i}"), "left")
        named[i] = F.concat(F.lit(used[i] + "_"), F.coalesce(f"_label{i}", F.lit("unknown")))
        shown[i] = F.col(f"_number{i}").isNotNull().cast("double")
    columns = {"slot": F.array(*[F.lit(s) for s in slots]), "raw_feature": F.array(*named), "feature_value": F.array(*shown)}
    # One projection: the shown values read the array they replace.
    listed = explained.select(*keys, "contribution", *[c.alias(n) for n, c in columns.items()])
    zipped = F.arrays_zip("slot", "raw_feature", "feature_value", "contribution")
    return listed.select(*keys, zipped.alias("attributions"))


def explain(attributions: DataFrame, keys: Sequence[str], top_n: int = 8) -> DataFrame:
    """The ``top_n`` contributions of every row by size, best first.

    One-hot slots count only where they are active, near-zero contributions never. The
    choice is made inside each row's array, so nothing is shuffled.
    """

    def reported(a: Column) -> Column:
        inactive = F.startswith(a.raw_feature, F.lit("cat__")) & (F.abs(a.feature_value - 1.0) > 1e-8 + 1e-5)
        return ~inactive & (F.abs(a.contribution) > 1e-8)

    def sortable(a: Column) -> Column:
        return F.struct(
            (-F.abs(a.contribution)).alias("order"), a.slot.alias("slot"), a.raw_feature.alias("raw_feature"),
            a.contribution.alias("contribution"),
        )

    best = F.slice(F.array_sort(F.transform(F.filter("attributions", reported), sortable)), 1, top_n)
    rows = attributions.select(*keys, F.posexplode(best).alias("position", "a"))
    value = F.col("a.contribution")
    return rows.select(
        *keys, (F.col("position") + 1).alias("rank"), feature_label(F.col("a.raw_feature")).alias("feature"),
        F.col("a.raw_feature").alias("raw_feature"), value.alias("shap_value_log_price"),
        F.when(value > 0, "increases").otherwise("decreases").alias("impact"), F.abs(value).alias("magnitude"),
        F.lit(True).alias("is_active"),
    )


def global_importance(attributions: DataFrame, top_n: int = 20) -> DataFrame:
    """Mean absolute contribution per slot over all rows, largest first. Slots no tree uses are not listed.

    A category of a nominal slot counts 0 in the rows that have another one, as its one-hot slot would if inactive.
    """
    cells = attributions.select(F.inline("attributions"))
    sums = cells.groupBy("slot", "raw_feature").agg(
        F.sum(F.abs("contribution")).alias("total"), F.count("contribution").alias("cells")
    )
    # Every row has every slot once. One line per slot or category is left here.
    rows = F.sum("cells").over(Window.partitionBy("slot"))
    mean = sums.withColumn("mean_abs_shap", F.try_divide("total", rows))
    top = mean.orderBy(F.col("mean_abs_shap").desc(), F.col("slot").desc()).limit(top_n)
    return top.select(feature_label(F.col("raw_feature")).alias("feature"), "raw_feature", "mean_abs_shap")
