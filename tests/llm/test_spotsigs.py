import hashlib
import random

import pytest

from corvane.llm import spotsigs as s


def rows_of(seed, n=90):
    rng = random.Random(seed)
    words = ["the", "river", "Éa", "of", "is", "mill", "house", "und", "der", "Bach", "stone", "1984"]
    rows = [(i * 3, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 80)))) for i in range(n)]
    rows += [(1, None), (4, ""), (7, "   "), (10, "x"), (13, "!!! ???"), (16, "the of the"), (19, "long stone of the house " * 20000), (22, rows[3][1]), (25, rows[3][1])]
    rng.shuffle(rows)
    return rows


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        a, b, c = s.signatures(t), s.signatures(e), s.signatures(n)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), s.digest_of(a), s.digest_of(b), len(a & b) / len(a | b), len(a & c) / len(a | c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 9])
def test_comparison_matches_brute_force(spark, parts):
    rows = rows_of(3) + [(None, "nobody knows the name of it")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(parts)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = s.compare_with_next(df).drop("length_partition").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    equal = {}
    texts = dict(rows)
    for r in got:
        assert equal.setdefault(texts[r.doc_id] or "", r.fingerprint) == r.fingerprint


def test_one_and_no_documents(spark):
    one = spark.createDataFrame([(1, "the river of the mill and the stone")], "doc_id long, text string")
    assert [(r.near_next, r.n_chars) for r in s.compare_with_next(one).collect()] == [(1.0, 35)]
    assert s.compare_with_next(one.limit(0)).collect() == []
    assert s.near_pairs(one.limit(0)).collect() == []


def test_anchors_start_chains():
    sigs = s.signatures("The river ran to a mill, of stone.")
    hashed = lambda *chains: {s.xxhash.xxh64_digest(c) for c in chains}
    assert sigs == hashed(b"the river ran", b"to mill stone", b"a mill stone")
    assert s.signatures("river ran") == hashed(b"\nriver ran") and s.signatures("") == hashed(b"\n") == s.signatures(" ?")


@pytest.mark.parametrize("similarity", [0.5, 0.8])
def test_pairs_match_brute_force(spark, similarity):
    rng = random.Random(8)
    base = [" ".join(rng.choice(["the", "of", "is"]) + f" w{rng.randrange(400)} v{rng.randrange(50)}" for _ in range(25)) for _ in range(12)]
    rows = []
    for i in range(120):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = "new"
        rows.append((i, " ".join(words[: rng.choice([75, 75, 66, 45])])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {s.digest_of(x): x for x in (s.signatures(t) for _, t in rows)}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    got = {(r.a, r.b): r.jaccard for r in s.near_pairs(df, similarity).collect()}
    assert got == {k: v for k, v in want.items() if v >= similarity} and len(got) > 20
    for (a, b), v in want.items():
        assert s.jaccard(sets[a], sets[b], similarity) == (v if v >= similarity else 0)
        if v >= similarity:
            assert abs(s.length_partition(len(sets[a]), similarity) - s.length_partition(len(sets[b]), similarity)) <= 1
