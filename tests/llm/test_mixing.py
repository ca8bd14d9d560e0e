import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.llm import mixing

SCHEMA = "doc_id long, text string, source string, rank int, words string, copy int, n_blocks int, part string, passes int, draws int, last int, block int, target double, id string, u long"
MORE = (1, "x", 2, 7, "all", 9, 1, 1, 1, 0.5, "id", 3)


def make(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "a", "b", "B", "é", None, "tiny"] if i else ["tiny"])
        if source == "tiny" and i > 20:
            source = "a"
        rows.append((i, " ".join(["w"] * rng.randrange(0, 60)), source, *MORE))
    rows += [(n, None, "a", *MORE), (n + 1, "", "empty", *MORE), (5, "again five", "a", *MORE), (5, "again five", "a", *MORE), (None, "no id here", "b", *MORE), (None, None, None, *MORE)]
    return spark.createDataFrame(rows, SCHEMA), rows


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        target = {s: 3 * sizes[s] for s in capped} | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_plan_meets_targets_and_reruns_agree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 100)
    monkeypatch.setattr(mixing, "SHARD_WORDS", 1500)
    df, rows = make(spark)
    out = mixing.mix_plan(df).collect()
    assert len(out) == len(rows) and sorted(df.columns) == sorted(c for c in out[0].asDict() if not c.startswith("__"))
    sizes = Counter()
    for _, t, s, *_ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken, biggest = brute_targets(sizes), Counter(), defaultdict(int)
    for r in out:
        assert r["__size"] == len((r.text or "").split()) and r["__source_size"] == sizes[r.source]
        assert math.isclose(r["__target"], want[r.source], abs_tol=1e-9)
        copies = [d.copy for d in r["__draws"]]
        assert len(set(copies)) == len(copies) <= 3
        taken[r.source] += r["__size"] * len(copies)
        biggest[r.source] = max(biggest[r.source], r["__size"])
    assert math.isclose(sum(want.values()), sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(1, biggest[s]), s
    key = lambda r: (r.doc_id is None, r.doc_id, r.text or "", str(r["__draws"]))
    again = mixing.mix_plan(df.repartition(7)).collect()
    assert sorted(map(str, sorted(out, key=key))) == sorted(map(str, sorted(again, key=key)))


def test_mix_repeats_rows_as_planned(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 100)
    monkeypatch.setattr(mixing, "SHARD_WORDS", 1500)
    df, _ = make(spark)
    planned = Counter()
    for r in mixing.mix_plan(df).collect():
        planned[(r.doc_id, r.text)] += len(r["__draws"])
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert got == Counter({k: v for k, v in planned.items() if v})


def test_quotas_are_exact_and_hypergeometric(spark):
    blocks = spark.createDataFrame([(1, 300), (2, 40), (3, 1)], "rank int, n long")
    rows = [r for seed in range(12) for r in mixing.quotas(blocks, 3, seed).withColumn("seed", F.lit(seed)).collect()]
    by_source, by_shard = Counter(), Counter()
    for r in rows:
        by_source[r.seed, r["rank"]] += r.quota
        by_shard[r.seed, r.shard] += r.quota
    assert all(by_source[s, k] == n for s in range(12) for k, n in ((1, 300), (2, 40), (3, 1)))
    assert {42, 43} >= set(by_shard.values()) and len(by_shard) == 12 * 8
    twos = [next((r.quota for r in rows if r.seed == s and r.shard == h and r["rank"] == 2), 0) for s in range(12) for h in range(8)]
    mean = sum(twos) / len(twos)
    variance = sum((x - mean) ** 2 for x in twos) / len(twos)
    assert mean == 5 and 2.4 < variance < 6.6  # hypergeometric: 5 * (300 / 341) * (1 - 43 / 341), about 3.9


@pytest.mark.parametrize("good,bad,need", [(0, 5, 3), (5, 0, 3), (5, 7, 0), (5, 7, 12), (3, 4, 2), (6, 6, 9), (30000, 20000, 777)])
def test_single_draw_follows_the_distribution(spark, good, bad, need):
    n = 2000
    sql = mixing._draw_sql(f"{good}L", f"{bad}L", f"{need}L", f"((id + 0.5D) / {n})")
    got = Counter(r[0] for r in spark.range(n).selectExpr(f"{sql} as x").collect())
    lo, hi = max(0, need - bad), min(good, need)
    assert min(got) >= lo and max(got) <= hi
    log = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    for x, k in got.items():
        p = math.exp(log(good, x) + log(bad, need - x) - log(good + bad, need))
        assert abs(k / n - p) <= 2 / n


def test_empty_table_and_no_words(spark):
    assert mixing.mix_plan(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    none = mixing.mix_plan(spark.createDataFrame([(1, "", "a", *MORE), (2, None, None, *MORE)], SCHEMA)).collect()
    assert [(r["__size"], r["__target"]) for r in none] == [(0, 0.0), (0, 0.0)]


def test_clashing_names_come_back(spark):
    df = spark.createDataFrame([(i, "w " * (i % 7), "a", i, 2, 3) for i in range(50)], "doc_id long, text string, source string, __size int, __u int, __draws int")
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and all(r["__size"] == r.doc_id for r in mixed.collect())
