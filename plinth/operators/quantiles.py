"""Exact interpolated quantiles for any number of rows and any key skew, in one plan.

1. A bounded-size sketch (``percentile_approx``) brackets the wanted ranks of a group.
2. The values are counted, where everything between two brackets collapses to one
   row per group already in the map-side combine, so only the few values inside a
   bracket are shuffled. This count is spread by value, not by group.
3. A group with more than ``sort_rows`` values left in its brackets is refined: its values are dealt to
   sub-ranges, and sub-ranges without a wanted rank collapse, until few enough are left.
   Only then is a group sorted, in one task, by running counts.

The result is exact: the ranks come from counts. A rank outside its bracket is found again with all
values of its group in the bracket; the error bound of the sketch rules that out, but nothing relies on it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.numeric import to_number
from plinth.operators.attach import BROADCAST_BYTES, attach
from plinth.staging import stage

# Sketch accuracy: in a large group a bracket holds about 4/ACCURACY of the values.
ACCURACY = 10_000
# Bracket half-width for groups too small for the sketch's own error to be the measure.
WIDE = 0.01
# Values of a group that one task may sort.
SORT_ROWS = 100_000
# Sub-ranges a large bracket is cut into at a time.
RANGES = 256


def long_values(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """One row ``(*by, *carry, column_name, value)`` per non-missing numeric cell."""
    kept = [F.col(c) for c in (*by, *carry)]
    present = [F.col(c).isNotNull() for c in by]
    if len(columns) == 1:
        long = df.select(*kept, F.lit(columns[0]).alias("column_name"), to_number(df, columns[0]).alias("value"))
    else:
        cells = F.array(*[
            F.struct(F.lit(c).alias("column_name"), to_number(df, c).alias("value")) for c in columns
        ])
        long = df.select(*kept, F.inline(cells))
    for condition in (*present, F.col("value").isNotNull()):
        long = long.filter(condition)
    return long


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    extra: Mapping[str, Column] | None = None,
    carry: Sequence[str] = (),
    accuracy: int = ACCURACY,
    sort_rows: int = SORT_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
    wide: bool = False,
) -> DataFrame:
    """Linear-interpolated quantiles per group and column, missing values ignored.

    Returns ``(*by, column_name, n, q, *extra)`` with ``q`` aligned to ``probs`` (ascending).
    ``extra`` holds further numbers aggregated over ``value`` and the ``carry`` columns; they
    ride along in the first scan.  Rows with a NULL group key are left out.  ``df`` is
    scanned twice, so stage it first if it is expensive.  ``wide``, for frames that are cheap to
    scan, takes three scans, of which only values inside a bracket become rows of their own.
    """
    if wide and (by or extra or carry):
        raise ValueError("wide quantiles take neither groups nor further numbers")
    probs = sorted(probs)
    extra = dict(extra or {})
    keys = [*by, "column_name"]
    long = long_values(df, columns, by, carry)
    around = _around(probs, 2 / accuracy) + _around(probs, WIDE)
    if wide:
        sketch = _wide_sketch(df, columns, around, accuracy)
    else:
        sketch = long.groupBy(*keys).agg(
            F.count("value").alias("n"),
            F.percentile_approx("value", around, accuracy).alias("ends"),
            *[c.alias(name) for name, c in extra.items()],
        )
    sketch = sketch.withColumn("ends", _bracket_ends(len(probs), accuracy))
    slim = long.select(*keys, "value")
    # So many rows leave at most ``sort_rows`` in the brackets of a group, by the error bound of the sketch.
    harmless = max(sort_rows, sort_rows * accuracy // (8 * len(probs))) if accuracy >= 1000 else sort_rows
    if by:
        sketch = stage(sketch, "sketch")
        brackets = sketch.select(*keys, "n", "ends", F.col("n").alias("weight"))

        def bracketed(chosen: DataFrame) -> DataFrame:
            return attach(slim, chosen, keys, "weight", broadcast_bytes=broadcast_bytes)

        large = sketch.agg(F.max("n")).first()[0] or 0
        found = stage(_pick_ranks(bracketed(brackets), keys, probs, large > harmless, sort_rows), "ranks")
        lost = found.filter(_lost(probs)).select(*keys)
        if not lost.isEmpty():
            again = brackets.join(lost, keys, "left_semi").withColumn("ends", _everything(len(probs)))
            wide = _pick_ranks(bracketed(stage(again, "brackets")), keys, probs, True, sort_rows)
            found = found.filter(~_lost(probs)).unionByName(stage(wide, "ranks"))
        exact = _interpolated(found, keys, probs)
        return exact.join(sketch.drop("ends", "n"), keys).select(*keys, "n", "q", *extra)

    # One row per column of the schema travels as literals: a join on one column's name would have no key.
    known = {r.column_name: r for r in sketch.collect()}

    def told(field: str) -> Column:
        value = F.lit(None)
        for name, row in known.items():
            value = F.when(F.col("column_name") == name, F.lit(row[field])).otherwise(value)
        return value.cast(sketch.schema[field].dataType)

    def ranks_of(rows: DataFrame, ends: Column, refine: bool) -> DataFrame:
        return stage(_pick_ranks(rows.withColumns({"n": told("n"), "ends": ends}), keys, probs, refine, sort_rows), "ranks")

    large = max((r.n for r in known.values()), default=0)
    if wide and known:
        counted = _wide_counts(df, known, len(probs))
        found = stage(_ranks(counted, keys, probs, large > harmless, sort_rows), "ranks")
    else:
        found = ranks_of(slim, told("ends"), large > harmless)
    lost = [r.column_name for r in found.filter(_lost(probs)).collect()]
    if lost:
        wide = ranks_of(slim.filter(F.col("column_name").isin(lost)), _everything(len(probs)), True)
        found = found.filter(~_lost(probs)).unionByName(wide)
    return _interpolated(found, keys, probs).withColumns({c: told(c) for c in extra}).select(*keys, "n", "q", *extra)


def _around(probs: list[float], width: float) -> list[float]:
    return [end for p in probs for end in (max(p - width, 0.0), min(p + width, 1.0))]


def _bracket_ends(n_probs: int, accuracy: int) -> Column:
    """Tight brackets for large groups, wide ones for small, everything for tiny ones.

    A bracket of half-width w covers the two ranks an interpolation needs once
    w * n exceeds the sketch error n / accuracy by two ranks.
    """
    size = F.lit(2 * n_probs)
    return (
        F.when(F.col("n") >= 4 * accuracy, F.slice("ends", 1, size))
        .when(F.col("n") * (WIDE - 1 / accuracy) >= 4, F.slice("ends", size + 1, size))
        .otherwise(_everything(n_probs))
    )


def _everything(n_probs: int) -> Column:
    return F.array(*[F.lit(float(end)) for _ in range(n_probs) for end in ("-inf", "inf")])


def _wanted(probs: Sequence[float]) -> dict[str, Column]:
    """The ranks, from 0, between which each quantile lies."""
    last = (F.col("n") - 1).cast("double")
    both = (("low", F.floor), ("high", F.ceil))
    return {f"{end}{i}": f(last * F.lit(float(p))) for i, p in enumerate(probs) for end, f in both}


def _lost(probs: Sequence[float]) -> Column:
    """Whether a rank was found among collapsed values."""
    ends = [F.col(name).collapsed for name in _wanted(probs)]
    out = ends[0]
    for other in ends[1:]:
        out = out | other
    return out


def _wide_sketch(df: DataFrame, columns: Sequence[str], around: list[float], accuracy: int) -> DataFrame:
    """(column_name, n, ends) of the columns with any value, by one aggregate without groups."""
    numbers = df.select(*[to_number(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    one = numbers.agg(*[
        f.alias(f"{name}{i}") for i in range(len(columns)) for name, f in (
            ("n", F.count(f"v{i}")), ("ends", F.percentile_approx(f"v{i}", around, accuracy))
        )
    ])
    each = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n"), F.col(f"ends{i}").alias("ends"))
        for i, c in enumerate(columns)
    ])
    return one.select(F.inline(each)).filter("n > 0")


def _wide_counts(df: DataFrame, known: Mapping, n_probs: int) -> DataFrame:
    """(column_name, n, spot, copies) as ``_pick_ranks`` counts them; what lies in a gap is counted column by column."""
    numbers = df.select(*[to_number(df, c).alias(f"v{i}") for i, c in enumerate(known)])
    ends = [r.ends for r in known.values()]
    inside, bounds = [], []
    for i in range(len(known)):
        value = F.col(f"v{i}")
        lows, highs = ends[i][::2], ends[i][1::2]
        within = F.lit(False)
        for low, high in zip(lows, highs):
            within = within | value.between(low, high)
        inside.append(F.struct(F.lit(i).alias("number"), F.when(within, value).alias("value")))
        bounds += [F.count(F.when(value < low, 1)).alias(f"below{i}_{b}") for b, low in enumerate(lows)]
        bounds += [F.count(F.when(value <= high, 1)).alias(f"upto{i}_{b}") for b, high in enumerate(highs)]
    places = numbers.agg(*bounds).first()
    names = F.array(*[F.lit(c) for c in known])
    sizes = F.array(*[F.lit(r.n) for r in known.values()])
    counted = numbers.select(F.inline(F.array(*inside))).filter("value IS NOT NULL").groupBy("number", "value").agg(
        F.count(F.lit(1)).alias("copies")
    ).select(
        names[F.col("number")].alias("column_name"), sizes[F.col("number")].alias("n"),
        F.struct("value", F.lit(False).alias("collapsed")).alias("spot"), "copies",
    )
    collapsed = []
    for i, (name, r) in enumerate(known.items()):
        # The gaps before each bracket and behind all, by the place that ``_pick_ranks`` gives them.
        behind, edge = 0, float("-inf")
        for b in range(n_probs):
            collapsed.append((name, r.n, (edge, True), places[f"below{i}_{b}"] - behind))
            behind, edge = max(behind, places[f"upto{i}_{b}"]), ends[i][2 * b + 1]
        collapsed.append((name, r.n, (float("inf"), True), r.n - behind))
    collapsed = [x for x in collapsed if x[3] > 0]
    if not collapsed:
        return counted
    schema = "column_name string, n long, spot struct<value: double, collapsed: boolean>, copies long"
    return counted.unionByName(df.sparkSession.createDataFrame(collapsed, schema))


def _pick_ranks(rows: DataFrame, keys: list[str], probs: list[float], refine: bool, sort_rows: int) -> DataFrame:
    """(keys, n, low0, high0, ...): the places of the wanted ranks."""
    # A value inside a bracket keeps its own place; a value in the gap before bracket i
    # takes the place right after bracket i-1 and is marked as collapsed; so do those before and behind all.
    value = F.col("value")

    def place(v: Column, collapsed: bool) -> Column:
        return F.struct(v.alias("value"), F.lit(collapsed).alias("collapsed"))

    spot = F.when(value < F.get("ends", F.lit(0)), place(F.lit(float("-inf")), True))
    for i in range(len(probs)):
        if i:
            spot = spot.when(value < F.get("ends", F.lit(2 * i)), place(F.get("ends", F.lit(2 * i - 1)), True))
        spot = spot.when(value <= F.get("ends", F.lit(2 * i + 1)), place(value, False))
    spot = spot.otherwise(place(F.lit(float("inf")), True))
    counted = rows.groupBy(*keys, "n", spot.alias("spot")).agg(F.count(F.lit(1)).alias("copies"))
    return _ranks(counted, keys, probs, refine, sort_rows)


def _ranks(counted: DataFrame, keys: list[str], probs: list[float], refine: bool, sort_rows: int) -> DataFrame:
    if refine:
        counted = _refined(stage(counted, "counted"), keys, probs, sort_rows)
    upto = Window.partitionBy(*keys).orderBy("spot").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("upto", F.sum("copies").over(upto))
    picks = [F.min(F.when(F.col("upto") > rank, F.col("spot"))).alias(name) for name, rank in _wanted(probs).items()]
    return ranked.groupBy(*keys, "n").agg(*picks)


def _refined(counted: DataFrame, keys: list[str], probs: list[float], sort_rows: int) -> DataFrame:
    """``counted`` with at most ``sort_rows`` places a group, the same ones around the wanted ranks."""
    spot = F.col("spot")
    # Two ranks a quantile and what lies between them are left in any case.
    sort_rows = max(sort_rows, 4 * len(probs) + 1)
    while True:
        sizes = counted.groupBy(*keys).agg(F.count("spot").alias("spots")).filter(F.col("spots") > sort_rows)
        sizes = stage(sizes, "large-brackets")
        if sizes.isEmpty():
            return counted
        cuts = [i / RANGES for i in range(1, RANGES)]
        large = attach(counted, sizes.withColumn("large", F.lit(True)), keys, "spots", how="left")
        inside = large.filter("large")
        steps = inside.groupBy(*keys).agg(F.percentile_approx(spot.value, cuts, 10 * RANGES).alias("steps"))
        weights = stage(steps.join(sizes, keys), "sub-ranges")
        dealt = attach(inside, weights, keys, "spots").withColumn(
            "part", F.size(F.filter("steps", lambda cut: cut < spot.value))
        )
        dealt = stage(dealt.select(*keys, "n", "spot", "copies", "part"), "dealt")
        # At most RANGES rows a group.
        parts = dealt.groupBy(*keys, "n", "part").agg(
            F.sum("copies").alias("part_copies"), F.count("spot").alias("places"), F.max("spot").alias("last")
        )
        so_far = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        parts = parts.withColumn("upto", F.sum("part_copies").over(so_far))
        holds = F.lit(False)
        for rank in _wanted(probs).values():
            holds = holds | ((F.col("upto") > rank) & (F.col("upto") - F.col("part_copies") <= rank))
        parts = parts.withColumn("holds", holds).withColumn("gap", F.sum(F.col("holds").cast("int")).over(so_far))
        parts = stage(parts, "parts")
        closed = parts.filter("NOT holds").groupBy(*keys, "n", "gap").agg(
            F.max("last").alias("last"), F.sum("part_copies").alias("copies")
        ).select(
            *keys, "n", F.struct(F.col("last.value").alias("value"), F.lit(True).alias("collapsed")).alias("spot"), "copies"
        )
        open_parts = parts.filter("holds").select(*keys, "part", "places")
        kept = attach(dealt, open_parts, [*keys, "part"], "places").select(*keys, "n", "spot", "copies")
        small = large.filter("large IS NULL").select(*keys, "n", "spot", "copies")
        counted = stage(small.unionByName(closed).unionByName(kept), "counted")


def _interpolated(found: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    last = (F.col("n") - 1).cast("double")
    values = [
        _between(F.col(f"low{i}").value, F.col(f"high{i}").value, last * F.lit(float(p))) for i, p in enumerate(probs)
    ]
    return found.select(*keys, "n", F.array(*values).alias("q"))


def _between(low: Column, high: Column, at: Column) -> Column:
    share = at - F.floor(at)
    step = high - low
    nearer = F.when(share < 0.5, low + step * share).otherwise(high - step * (1.0 - share))
    return F.when(low == high, low).otherwise(nearer)
