"""Operators whose point is scale, at small sizes: one automaton for many terms, a total order, pairs by blocks, splits of large files."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.operators import analytics, automaton, ordering, postings, search
from corvane.operators.taxonomy import classified, term_hits
from corvane.plans.driver_views import DRIVER_TAXONOMY, table
from corvane.sources.reference import Label, Taxonomy


def test_automaton_gives_what_patterns_give(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    own = lambda many: sorted(map(tuple, term_hits(docs, DRIVER_TAXONOMY, "doc_id", "text", many).collect()))
    assert own(True) == own(False) != []
    odd = Taxonomy([Label("A", "", ["c++", "été", "a b", "_x"], ["+-", "ß"]), Label("B", "", ["c"], []), Label("N", "", [], [])], [Label("S", "", ["ab", "a"], ["bc"])], [Label("F", "", ["été"], [], "S"), Label("G", "", [], ["x"], "S")])
    texts = ["C++ code", "c++d", "xc++", "c++", "c ++", "ÉTÉ!", "étés", "a b", "a  b", "_x", "y_x", "_xy", "straße", "+-", "abc", "ab", "ab été x", "日c本", "(c)", "", None, "c" * 50_000 + " ab"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, t string")
    get = lambda many: [tuple(r) for r in classified(df, odd, "t", None, many=many).orderBy("k").collect()]
    assert get(True) == get(False)


def test_many_terms_in_one_walk(spark):
    r = random.Random(4)
    terms = sorted({"".join(r.choice("abcdefgh") for _ in range(r.randint(4, 9))) for _ in range(50_000)})
    labels = [Label(f"L{k}", "", terms[k::500], []) for k in range(500)]
    texts = [" ".join(r.choice(terms) if r.random() < 0.02 else r.choice(("the", "of", "hgfedcbaabcdefgh" * 3)) for _ in range(200)) for _ in range(40)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, t string")
    place = {t: k % 500 for k, t in enumerate(terms)}
    want = [sorted({f"L{place[w]}" for w in x.split() if w in place}) for x in texts]
    assert [r.pred_mineral_ids for r in classified(df, Taxonomy(labels, [], []), "t", None).orderBy("k").collect()] == want and any(want)


def test_automaton_of_nothing(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string")
    assert [r[0] for r in df.select(automaton.hits(F.col("t"), [("x", [], [""])])).collect()] == [[], []]


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_total_order_by_ranges(spark, tmp_path, n):
    df = spark.range(n).select((F.col("id") * 7919 % 31).alias("n"), F.concat(F.lit("o"), "id").alias("org"))
    got = ordering.ranked_table(df.repartition(7), [F.desc("n"), "org"], str(tmp_path / "r"))
    want = df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "org")).cast("long"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def by_hand(rows):
    act, filed = {}, set()
    for orgs, minerals, stages in rows:
        for o in orgs:
            act.setdefault(o, set()).update((m, s) for m in minerals for s in stages)
        filed |= {(a, b) for a in orgs for b in orgs if a < b}
    return sorted((a, b, sorted(act[a] & act[b])) for a in act for b in act if a < b and act[a] & act[b] and (a, b) not in filed)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_pairs_by_blocks_and_bitmaps(spark, monkeypatch, block):
    monkeypatch.setattr(analytics, "BLOCK", block)
    r = random.Random(block)
    pick = lambda xs, n: r.sample(xs, r.randint(0, n))
    # One cell that nearly all organisations have, and more cells than a bitmap's word holds.
    rows = [(pick([f"o{k}" for k in range(25)], 3), pick([f"m{k}" for k in range(15)], 4), pick([f"s{k}" for k in range(9)], 3)) for _ in range(60)] + [([f"o{k}"], ["hot"], ["s0"]) for k in range(25) if k % 7]
    df = spark.createDataFrame(rows, "orgs array<string>, mineral_ids array<string>, stage_ids array<string>")
    want = by_hand(rows)
    assert [(x.org_a, x.org_b, [tuple(c) for c in x.shared]) for x in analytics.collaboration_pairs(df).collect()] == want
    assert sorted(map(tuple, analytics.collaborations(df).collect())) == sorted((a, b, *c) for a, b, cs in want for c in cs)


def test_no_cell_no_pair(spark):
    df = spark.createDataFrame([(["a", None], ["m"], []), (["b"], None, ["s"]), (None, ["m"], ["s"])], "orgs array<string>, mineral_ids array<string>, stage_ids array<string>")
    assert analytics.collaborations(df).count() == 0 and analytics.collaboration_pairs(df).count() == 0


@pytest.mark.parametrize("size", [1, 7, 4096])
def test_search_by_blocks_stops_early(spark, tmp_path, size):
    r = random.Random(size)
    words = [f"w{k}" for k in range(12)] + ["rare", "Title"]
    rows = [(f"d{k:03d}", " ".join(r.choices(words, k=3)) if k % 40 == 0 else "plain", " ".join(r.choices(words[:12], k=6)), [r.choice(words)], "W1 x") for k in range(300)]
    records = spark.createDataFrame(rows, "doc_id string, title string, abstract string, applicants array<string>, tax_text string")
    indexed = search.indexed(records)
    index = postings.write_index(indexed, str(tmp_path / "i"), size)
    for q, limit in (("w1", 5), ("w1 w2 w2 rare", 10), ("rare", 400), ("nobody", 3), ("w3 title", 1), ("w1 w1", 50)):
        found = index.top(q, limit)
        want = [(x.doc_id, x.score) for x in search.hits(indexed, q).orderBy(F.desc("score"), "doc_id").limit(limit).collect()]
        assert found.hits == want
        if size == 7 and q == "w1 w2 w2 rare":
            assert 0 < found.blocks_read < found.blocks
    assert index.top("?!", 3).hits == [] and index.hits("w1", 2).columns == ["doc_id", "score", "rank"]


def test_organisations_digests_without_a_list_of_ids(spark, tmp_path, monkeypatch):
    r = random.Random(9)
    rows = [(f"A{r.randint(0, 400)}" if k % 50 else None, r.sample(["a", "b", "c", "d"], r.randint(0, 3)), "", 0, k) for k in range(900)] + [("same", ["a"], "", 0, k) for k in range(250)]
    records = spark.createDataFrame(rows, "doc_id string, orgs array<string>, file string, tier int, line int").repartition(7)
    names = {"x": "a", "y": "b", "z": "a", "none": "nobody"}
    asked = spark.createDataFrame(list(names.items()), "name string, org string")
    monkeypatch.setattr(analytics, "PIECE_IDS", 7)
    out = analytics.org_digests(records, asked, str(tmp_path / "orgs"))
    got = {x.name: tuple(x)[1:] for x in out.collect()}
    # No step gathers an organisation's ids in a row; only its partners are listed.
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    for name, org in names.items():
        want = analytics.org_profile(records, org, ["tier", "file", "line"]).select("org", "record_count", F.md5(F.array_join(F.array_sort("record_ids"), ",")), "co_orgs").first()
        assert got[name] == tuple(want)
    assert got["none"][1] == 0 and got["x"][1] > 400
