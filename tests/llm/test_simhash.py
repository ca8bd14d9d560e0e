import random

import pytest
import xxhash
from pyspark.sql import functions as F

from corvane.llm import simhash


def brute_fp(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(rows, bits=3):
    fps = {f for _, f in rows}
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= bits:
                parent[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return {(i, f): least.get(find(f)) for i, f in rows}


def test_groups_match_brute_force(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice(["Alpha", "beta", "ÇÉ", "d e", "zeta", "x"]) for _ in range(80)) for _ in range(6)]
    rows = []
    for i in range(120):
        words = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice(["new", "NEW", ""])
        rows.append((i * 3 + 1, " ".join(words), "s"))
    rows += [(500, None, "s"), (501, "", None), (502, " \t\n", "s"), (503, "One two", "s"), (504, "one\ttwo", "s"), (505, "word " * 60000, "s"), (505, "word " * 60000, "s"), (None, "one two", "s"), (None, "all alone here", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    want = brute_groups([(i, brute_fp(t)) for i, t, _ in rows])
    got = simhash.simhash_groups(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert want[(r.doc_id, int(r.fingerprint, 16))] == r.component_id and len(r.fingerprint) == 16
    kept = simhash.near_dedup(df).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({c for c in want.values() if c is not None})
    assert [r.text for r in kept if r.doc_id is None] == ["all alone here"]


@pytest.mark.parametrize("bits", [1, 2, 3])
@pytest.mark.parametrize("hot", [3, 10**6])
def test_links_join_the_same_groups_as_all_pairs(spark, monkeypatch, bits, hot):
    monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
    rng = random.Random(bits)
    fps = set()
    for _ in range(5):
        x = rng.getrandbits(64)
        for _ in range(25):
            y = x
            for _ in range(rng.randint(0, 5)):
                y ^= 1 << rng.choice([rng.randrange(64), rng.randrange(8), 32 + rng.randrange(6)])
            fps.add(y)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    pairs = [(a.a, a.b) for a in simhash.links(spark.createDataFrame(signed, "fp long"), bits).collect()]
    assert all((a % 2**64 ^ b % 2**64).bit_count() <= bits for a, b in pairs)
    want = brute_groups([(i, f) for i, f in enumerate(sorted(fps))], bits)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a % 2**64)] = find(b % 2**64)
    same = {}
    for (_, f), c in want.items():
        assert same.setdefault(find(f), c) == c
    assert len(set(same.values())) == len(same)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_groups(df).collect() == [] and simhash.near_dedup(df).collect() == []


def test_fingerprint_is_sparks_own_hash(spark):
    df = spark.createDataFrame([("One TWO three",)], "text string")
    h = df.select(F.xxhash64(F.lit("one two three"))).first()[0] % 2**64
    assert int.from_bytes(simhash.fingerprint(b"One TWO three"), "big") == h


def test_links_are_counted_whole_or_not_at_all(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_BUCKET", 4)
    rng = random.Random(4)
    base = " ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(400)).split()
    rows = [(i, " ".join(w if rng.random() > 0.004 else "zz" for w in base)) for i in range(60)] + [(100, "one two three four"), (101, None)]
    got = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fps = {int(r.fingerprint, 16) for r in got}
    exact = {f: sum(0 < (f ^ g).bit_count() <= 3 for g in fps) for f in fps}
    assert all(r.n_links is None or r.n_links == exact[int(r.fingerprint, 16)] for r in got)
    assert any(r.n_links is None for r in got) and {r.doc_id: r.n_links for r in got}[100] == 0


def test_clashing_names_come_back(spark):
    df = spark.createDataFrame([(1, "a b c", 1, 2, 3), (2, "a b c", 4, 5, 6)], "doc_id long, text string, __row int, __fp int, __keep int")
    assert [tuple(r) for r in simhash.near_dedup(df).collect()] == [(1, "a b c", 1, 2, 3)] and simhash.near_dedup(df).columns == df.columns
