from pyspark.sql import functions as F

from corvane.streaming import alerts as a

RECORD = "doc_id string, source_url string, title string, abstract string, kind string, mineral_ids array<string>, stage_ids array<string>, at int"


def records(spark, *rows):
    return spark.createDataFrame([(i, None, t, x, "patent", m, ["S"], k) for k, (i, t, x, m) in enumerate(rows)], RECORD)


R1, R2, R3 = ("r1", "lithium cell", "of brine", ["LI"]), ("r2", "cobalt", None, ["CO"]), ("r3", "more lithium", "", ["LI"])


def test_each_record_fires_once_for_each_subscription(spark, tmp_path):
    table = a.AlertTable(spark, str(tmp_path))
    assert table.subscribe(mineral="LI") == "sub-001"
    fired = lambda n, *rows: sorted((r.sub_id, r.record_id) for r in table.check(records(spark, *rows), n, ["at"]).collect())
    assert fired(0, R1, R2) == [("sub-001", "r1")]
    assert fired(1, R1, R2) == []
    # A later subscription hears of what is there, unless it was seeded with it.
    assert table.subscribe(q="LITHIUM brine") == "sub-002" and table.subscribe(mineral="CO", corpus=records(spark, R1, R2)) == "sub-003"
    assert fired(2, R1, R2, R3) == [("sub-001", "r3"), ("sub-002", "r1")]
    # r2 was offered to the first subscription and did not match; it stays seen though its labels change.
    assert fired(3, ("r2", "now lithium", "brine", ["LI"])) == []
    # A replayed batch says what it said.
    assert fired(2, R1, R2, R3) == [("sub-001", "r3"), ("sub-002", "r1")]
    assert table.alerts().count() == 3


def test_first_record_of_a_key_decides(spark, tmp_path):
    table = a.AlertTable(spark, str(tmp_path))
    table.subscribe(mineral="LI")
    assert table.check(records(spark, ("x", "t", "", ["CO"]), ("x", "t", "", ["LI"])), 0, ["at"]).collect() == []
    assert table.check(records(spark, ("", "no key", "", ["LI"])), 1, ["at"]).collect() == []


def test_wildcards(spark, tmp_path):
    table = a.AlertTable(spark, str(tmp_path))
    for given in ({}, {"q": "?!"}, {"kind": "rd"}, {"stage": "S", "kind": "patent"}, {"q": "lithium cobalt"}):
        table.subscribe(**given)
    assert sorted(r.sub_id for r in table.check(records(spark, R1), 0, ["at"]).collect()) == ["sub-001", "sub-002", "sub-004"]


def test_legacy_state(spark):
    subs = spark.createDataFrame([("s1", "", "", "", ""), ("s2", "", "", "", "")], a.SUBSCRIPTION)
    seen = a.folded(subs, spark.createDataFrame([("s1", "k")], a.SEEN), spark.createDataFrame([("k",), ("m",)], "record_key string"))
    assert sorted(map(tuple, seen.collect())) == [("s1", "k"), ("s1", "m"), ("s2", "k"), ("s2", "m")]


def test_any_number_of_subscriptions(spark, monkeypatch):
    subs = spark.createDataFrame([(f"s{i}", "LI" if i % 2 else "", "", "", "brine" if i % 3 == 0 else "") for i in range(25)], a.SUBSCRIPTION)
    seen = spark.createDataFrame([("s1", "r1"), ("s4", "r3")], a.SEEN)
    said = []
    for most in (10_000, 4):
        monkeypatch.setattr(a, "BROADCAST_SUBSCRIPTIONS", most)
        fired, new = a.check(records(spark, R1, R2, R3), subs, seen, ["at"])
        said.append((sorted(map(tuple, fired.collect())), sorted(map(tuple, new.collect()))))
    assert said[0] == said[1] and len(said[0][1]) == 25 * 3 - 2


def test_reverse_index_meets_what_matching_one_by_one_meets(spark):
    """100,000 subscriptions of which few match; no nested loop, and no task that has them all."""
    n = 100_000
    k = F.col("id")
    subs = spark.range(n).select(
        F.concat(F.lit("s"), k).alias("sub_id"), F.when(k % 5 == 0, F.concat(F.lit("M"), k % 1000)).otherwise("").alias("mineral"), F.when(k % 7 == 0, "S").otherwise(F.when(k % 3 == 0, F.lit(None)).otherwise("")).alias("stage"),
        F.when(k % 11 == 0, "patent").otherwise(F.when(k % 11 == 1, "rd").otherwise("")).alias("kind"), F.concat(F.lit("word"), k, F.lit(" Common")).alias("q"),
    )
    rows = [(f"r{i}", f"word{i} common, word{i + 1}", None, [f"M{i % 1000}"]) for i in range(0, 400, 3)]
    want = set()
    for i in range(0, 400, 3):
        for s in (i, i + 1):
            if (s % 5 or f"M{s % 1000}" == f"M{i % 1000}") and s % 11 != 1:
                want.add((f"s{s}", f"r{i}"))
    fired, _ = a.check(records(spark, *rows), subs, spark.createDataFrame([], a.SEEN), ["at"])
    plan = fired._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {(r.sub_id, r.record_id) for r in fired.collect()} == want
    wanting = a.conditions(subs)
    index = a.reverse_index(wanting, a.offered_values(records(spark, *rows), wanting, ["at"]).select("record_key", "value"))
    # Those whose words no record has aren't entered, and the others stand under their rare word and not under the common one.
    assert index.count() < 300 and index.where("value = 't=common'").count() == 0


def test_state_grows_with_records_and_subscriptions(spark, tmp_path):
    table = a.AlertTable(spark, str(tmp_path))
    corpus = records(spark, *[(f"r{i}", "t", "", ["LI"]) for i in range(50)])
    for _ in range(20):
        table.subscribe(mineral="CO", corpus=corpus)
    assert spark.read.parquet(f"{tmp_path}/seeds").count() == 50
    for batch in range(3):
        table.check(corpus, batch, ["at"])
    # Offered again and again, a key is written once, and again only for a subscription that is new.
    assert spark.read.parquet(f"{tmp_path}/seen").count() == 50
    table.subscribe(mineral="LI")
    assert table.check(corpus, 3, ["at"]).count() == 50 and table.check(corpus, 4, ["at"]).count() == 0
    assert spark.read.parquet(f"{tmp_path}/seen").count() == 100 and table.seen().count() == 21 * 50


def test_seeds_follow_a_corpus_that_changes(spark, tmp_path):
    table = a.AlertTable(spark, str(tmp_path))
    corpus = lambda *ids: records(spark, *[(i, "t", "", ["LI"]) for i in ids])
    for ids in (("a", "b"), ("b", "c"), ("b", "c"), ("a",)):
        table.subscribe(mineral="LI", corpus=corpus(*ids))
    want = {("sub-001", "c"), ("sub-001", "d"), ("sub-002", "a"), ("sub-002", "d"), ("sub-003", "a"), ("sub-003", "d"), ("sub-004", "b"), ("sub-004", "c"), ("sub-004", "d")}
    assert {tuple(r)[:2] for r in table.check(corpus("a", "b", "c", "d"), 0, ["at"]).collect()} == want


def test_legacy_keys_fold_without_the_product(spark, tmp_path):
    table = a.AlertTable(spark, str(tmp_path))
    for _ in range(3):
        table.subscribe(mineral="LI")
    table.fold(spark.createDataFrame([("r1",), ("r1",), ("zz",)], "record_key string"))
    assert spark.read.parquet(f"{tmp_path}/legacy").count() == 2
    assert table.check(records(spark, R1), 0, ["at"]).count() == 0
    table.subscribe(mineral="LI")
    assert [tuple(r)[:2] for r in table.check(records(spark, R1), 1, ["at"]).collect()] == [("sub-004", "r1")]


def test_two_callers_get_two_subscriptions(spark, tmp_path):
    one, other = a.AlertTable(spark, str(tmp_path)), a.AlertTable(spark, str(tmp_path))
    taken = one._reserved()
    assert (taken, other.subscribe(mineral="LI"), one._reserved()) == (1, "sub-002", 3)
