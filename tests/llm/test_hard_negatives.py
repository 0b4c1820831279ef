"""Hard negatives against brute force, over blocks, shelves and groups of anchors."""

import random
from math import floor, isfinite

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plinth.llm.hard_negatives import Block, _decompose, mine


def wanted(rows, k=5, m=10):
    fit = [
        (number, i, [floor(256 * x) for x in v], label) for number, (i, v, label) in enumerate(rows)
        if i is not None and label is not None and v is not None and all(x is not None and isfinite(x) for x in v)
    ]
    out = []
    for number, i, v, label in fit:
        if i % 10:
            continue
        scored = [
            (-sum(a * b for a, b in zip(v, w)), j, other == label)
            for n, j, w, other in fit if n != number and len(w) == len(v)
        ]
        near = sorted((s, j) for s, j, same in scored if same)[:k]
        for s, j in near:
            window = sorted((t, o) for t, o, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s)[:m]
            out += [(i, j, rank + 1, o, -s, -t) for rank, (t, o) in enumerate(window)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(11)] for _ in range(4)]
    out = []
    for i in range(400):
        label = rng.randrange(4)
        v = [float(np.float32(c * rng.choice([1, 1, -0.3]) + rng.gauss(0, 0.4))) for c in centres[label]]
        out.append((i, v, rng.randrange(4) if rng.random() < 0.3 else label))
    out += [(1000 + i, [0.5] * 11, i % 3) for i in range(60)]  # one vector again and again
    out += [(2000, None, 1), (2010, [1.0] * 11, None), (None, [1.0] * 11, 1), (2020, [1.0, None] + [0.0] * 9, 1)]
    out += [(2030, [float("nan")] * 11, 1), (2040, [float("inf")] + [0.0] * 10, 1), (2050, [0.0] * 11, 2), (2060, [0.0] * 11, 2)]
    out += [(3000 + i, [0.1 * i, -0.2], i % 2) for i in range(30)] + [(4000, [], 1), (4001, [], 1), (4002, [], 2)]
    out += [(20, out[20][1], out[20][2]), (-10, out[3][1], out[3][2])]
    return out


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 37, "anchor_rows": 9, "shelf_blocks": 3}])
def test_against_brute_force(spark, rows, sizes):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS row", "'x' AS id")
    got = mine(df.repartition(5), F.col("vec_id") % 10 == 0, **sizes)
    assert sorted(map(tuple, got.collect())) == wanted(rows)


def test_scan_prunes_and_stays_exact():
    rng = np.random.default_rng(0)
    table = rng.integers(-100, 100, (500, 12)) * np.array([9, 8, 7, 6, 1, 1, 1, 1, 1, 1, 1, 1])
    rows = pd.DataFrame({"width": 12, "block": 0, "row": range(500), "id": range(500), "label": 0, "v": list(table)})
    block = Block(next(_decompose(rows).itertuples()))
    anchor, left = table[3], []

    def prune(lower, upper):
        left.append(len(lower))
        if len(left) == 1:  # no row struck yet
            assert (lower <= table @ anchor).all() and (table @ anchor <= upper).all()
        return upper >= np.sort(lower)[-4]

    at, score = block.scan(anchor, np.arange(500), prune)
    assert (score == table[at] @ anchor).all()
    assert set(np.argsort(-(table @ anchor), kind="stable")[:4]) <= set(at)
    assert left[0] == 500 and left[-1] < 100


def test_overflow_fails_and_empty_table(spark):
    big = spark.createDataFrame([(0, [3e38], 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="2\\*\\*28"):
        mine(big, F.col("vec_id") % 10 == 0).collect()
    assert mine(big.limit(0), F.col("vec_id") % 10 == 0).count() == 0
