"""Hard negatives against scoring every row with every anchor, over trees of several levels, and odd tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=hn.EVERY):
    held = {}
    for i, e, y in rows:
        if i is None or e is None or y is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        y = (y + 1) % 10 if i % 7 == 0 else y
        v = [math.floor(256 * float(np.float32(x))) for x in e]
        held[i] = min(held.get(i, (y, v)), (y, v))
    dot = lambda a, b: sum(x * z for x, z in zip(a, b, strict=False))
    out = []
    for a, (label, v) in held.items():
        if a % every:
            continue
        scored = sorted((-dot(v, w), i, y == label) for i, (y, w) in held.items() if i != a)
        for p, i, same in [s for s in scored if s[2]][:5]:
            found = [(n, j) for n, j, s in scored if not s and 80 * -p <= 100 * -n <= 100 * -p][:5]
            out += [(a, i, k, j, -p, -n) for k, (n, j) in enumerate(found, 1)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def clusters(n, dim=6, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim)) * 3
    which = rng.integers(0, 12, n)
    x = centres[which] + rng.normal(size=(n, dim)) * 0.1
    return [(i, [float(v) for v in x[i]], int(rng.integers(0, 4))) for i in range(n)]


@pytest.fixture
def small_leaves(monkeypatch):
    monkeypatch.setattr(hn, "LEAF", 16)
    monkeypatch.setattr(hn, "ANCHOR_LEAF", 4)


def test_deep_trees_lose_nothing_and_prune(spark, small_leaves):
    rows = clusters(1500)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(hn.mine(df, every=10)) == brute(rows, 10)
    # The trees' own pairs: anchor groups meet few of the cells that a window can't reach.
    used = hn.usable(df)
    cells = hn.fit_cells(np.array([r[1] for r in rows]) * 256, 5)
    routed = hn._routed(used, cells, 6)
    tree = hn.tree_of(routed, cells, 6)
    a = routed.where("vec_id % 10 = 0").withColumns({"his": F.array(F.lit(hn.HIGHEST)), "los": F.array(F.lit(3 * 256 * 256 * 12).cast("long"))})
    leaves = hn._packed(a, cells, 6, 3, 4)
    pairs = hn.node_pairs(leaves, tree, 3, False)
    assert pairs.count() == pairs.distinct().count() < 0.5 * leaves.count() * tree.leaves.select("grp", "cell").distinct().count()


def test_ties_copies_and_negative_scores(spark, small_leaves):
    rows = [(i, [0.5, -0.25] if i % 2 else [0.5, 0.25], i % 3) for i in range(260)] + [(1000 + i, [-0.5, 0.0], i % 2) for i in range(20)] + [(2000, [0.0, 0.0], 7), (2001, [0.0, 0.0], 7), (2010, [0.0, 0.0], 8)]
    assert got(hn.mine(spark.createDataFrame(rows, SCHEMA), every=10)) == brute(rows, 10)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, [1.0, 1.0], 1), (0, [1.0, 0.5], 1), (1, [1.0, None], 1), (2, [nan, 1.0], 1), (3, [inf, 1.0], 2), (4, None, 2), (5, [1.0, 1.0], None), (6, [1.0], 1), (8, [], 2), (9, [1.0, 0.4], 2), (10, [1.0, 0.3], 1), (11, [0.9, 0.3], 2), (100, [-1.0, 0.2], 1), (200, [1.0, 1.0], 3)]
    rows += [(10, [1.0, 0.3], 1), (9, [0.1, 0.1], 5), (7, [1.0, 0.2], 9)]
    want = brute(rows)
    assert want and got(hn.mine(spark.createDataFrame(rows, SCHEMA))) == want


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**21 + i % 5), float(3 + i), -(2.0**20) * (i % 3 - 1)], i % 2) for i in range(40)]
    assert max(abs(x) for r in rows for x in r[1]) ** 2 * 256**2 * 3 > 2**53
    assert got(hn.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), every=8)) == brute(rows, 8)


def test_clashing_columns_empty_tables_and_no_anchor(spark):
    rows = clusters(60, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    extra = df.withColumns({c: F.lit(1) for c in ("vec", "cell", "grp", "score", "__row", "rank")})
    assert got(hn.mine(extra, every=5)) == brute(rows, 5)
    assert hn.mine(df.limit(0)).count() == 0 and hn.mine(df.where("vec_id % 100 <> 0")).count() == 0
    assert hn.mine(df.where("vec_id = 0")).count() == 0
