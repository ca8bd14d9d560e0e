import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import analytics, corpus, dedupe, graph, quality, resolve, search, sinks
from corvane.operators.taxonomy import classified
from corvane.plans.engine import Engine
from corvane.sources.reference import alias_rows, baseline_rows, holdout_rows, taxonomy_of

TAXONOMY = {
    "version": "1",
    "minerals": [
        {"id": "LI", "name": "Lithium", "symbols": ["Li"], "lexicon": ["lithium", "brine"]},
        {"id": "CO", "name": "Cobalt", "symbols": ["Co"], "lexicon": ["cobalt"]},
        {"id": "REE", "name": "Rare Earths", "members": ["Nd"], "lexicon": ["ndx", "rare earth"]},
        {"id": "GRA", "name": "Graphite", "lexicon": ["graphite"]},
        {"id": "NI", "name": "Nickel", "lexicon": ["nickel"]},
    ],
    "value_chain_stages": [{"id": s, "name": s.title()} for s in ("exploration", "mining", "beneficiation", "extraction_refining", "materials", "recycling")],
    "process_families": [{"id": "flotation", "stage": "beneficiation", "name": "F", "subdomains": ["x"]}, {"id": "hydrometallurgy", "stage": "extraction_refining", "name": "H", "subdomains": ["x"]}, {"id": "open_pit", "stage": "mining", "name": "O", "subdomains": ["x"]}],
}
ALIASES = {"Acme Metals": ["ACME METALS LTD.", "Acme (Metals)"], "Beta Labs": ["Beta-Labs"]}
GOLDEN = [
    {"fixture_id": "G1", "source_id": "a", "source_url": "http://1", "fetched_at": "2025-01-01", "kind": "patent", "appl_no": "IN201811000001", "title": "Leaching lithium from brine", "abstract": "Solvent extraction of Li", "applicants": ["Acme Metals Ltd", "Beta Labs"], "filing_date": "2018-01-01", "mineral_ids": ["LI"], "stage_ids": ["extraction_refining"], "process_family_ids": ["hydrometallurgy"]},
    {"fixture_id": "G2", "source_id": "a", "source_url": "http://2", "fetched_at": "2025-01-01", "kind": "rd", "title": "Cobalt flotation", "abstract": "", "applicants": ["Gamma"], "mineral_ids": ["CO"], "stage_ids": ["beneficiation"]},
    {"fixture_id": "G3", "source_id": "a", "source_url": "http://3", "fetched_at": "2025-01-01", "kind": "publication", "title": "Lithium by leaching", "abstract": None, "applicants": ["Delta Works", ""], "mineral_ids": ["LI"], "stage_ids": ["extraction_refining"]},
]
HARVESTED = [
    {"source_id": "b", "source_url": "http://9", "kind": "patent", "appl_no": "IN 201811000001 B1", "title": "The same again"},
    {"source_id": "b", "source_url": "http://8", "kind": "patent", "appl_no": "IN201811000007A", "title": "Recycling spent cobalt cathode", "abstract": "black mass", "applicants": ["Gamma", "Beta Labs"]},
    {"source_id": "c", "source_url": "http://7", "kind": "patent", "appl_no": "IN201811000007B", "title": "Later copy"},
    {"source_id": "c", "source_url": "http://6", "kind": "rd", "title": "Said to be nothing of lithium", "mineral_ids": [], "stage_ids": None},
]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("engine")
    for name, doc in (("taxonomy", TAXONOMY), ("aliases", {"aliases": ALIASES, "top20": ["Acme Metals"]}), ("golden", GOLDEN)):
        (d / f"{name}.json").write_text(json.dumps(doc, indent=1))
    (d / "raw_a.jsonl").write_text("\n".join(map(json.dumps, HARVESTED[:2])) + "\n\n")
    (d / "raw_b.jsonl").write_text("\n".join(map(json.dumps, HARVESTED[2:])))
    return Engine.load(spark, str(d / "taxonomy.json"), str(d / "aliases.json"), [str(d / "golden.json")], str(d / "raw*.jsonl")).cache()


def test_corpus_keeps_golden_and_first(engine):
    rows = {r.doc_id: r for r in engine.records.collect()}
    assert len(rows) == 5 and {"G1", "G2", "G3", "IN201811000007A"} < set(rows)
    assert rows["G1"].orgs == ["Acme Metals", "Beta Labs"] and rows["G1"].tax_text == "Lithium Extraction_Refining"
    new = rows["IN201811000007A"]
    assert new.mineral_ids == ["CO"] and new.stage_ids == ["materials", "recycling"] and new.orgs == ["Beta Labs", "gamma"]
    other = next(r for i, r in rows.items() if i.startswith("c-"))
    assert other.mineral_ids == [] and other.stage_ids == [] and other.orgs == []
    assert rows["G3"].orgs == ["delta works"] and engine.health()["records"] == 5


def test_classifier(spark):
    texts = ["Nd magnets and ndx", "ndxx only", "lithiumion", "li-ion, brines", "flotation of cobalt", "open pit mine", "LEACHING", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, title string")
    got = [(r.pred_mineral_ids, r.pred_stage_ids, r.pred_process_family_ids) for r in classified(df, taxonomy_of(TAXONOMY), abstract=None).orderBy("i").collect()]
    assert got == [
        (["REE"], ["materials"], []),
        ([], [], []),
        (["LI"], [], []),
        (["LI"], [], []),
        (["CO"], ["beneficiation"], ["flotation"]),
        ([], ["mining"], []),
        ([], ["extraction_refining"], ["hydrometallurgy"]),
        ([], [], []),
    ]


def test_search(engine):
    n, found = engine.search("lithium the LITHIUM")
    # Twice each: title 3, taxonomy 2 and, in the first, "lithium" is no word of the abstract.
    assert n == 3 and [(r.doc_id, r.score) for r in found.collect()][:2] == [("G1", 10.0), ("G3", 10.0)]
    assert [r.doc_id for r in engine.search("cobalt", kind="rd")[1].collect()] == ["G2"]
    assert engine.search("?!", stage="extraction_refining")[0] == 2 and engine.search("zzz qqq")[0] == 0
    assert [r.doc_id for r in engine.search("", limit=-3)[1].collect()] == ["G1", "G2"]
    posts = search.scores_from_postings(search.postings(engine.records), "lithium the LITHIUM")
    assert {(r.doc_id, r.score) for r in posts.collect()} == {(r.doc_id, r.score) for r in search.hits(engine.records, "lithium the LITHIUM").collect()}


def test_records_orgs_dashboards(engine):
    assert engine.record("G2")["orgs"] == ["gamma"]
    with pytest.raises(KeyError):
        engine.record("none")
    profile = engine.org("Beta-Labs").first()
    assert (profile.org, profile.record_count, profile.record_ids, profile.co_orgs) == ("Beta Labs", 2, ["G1", "IN201811000007A"], ["Acme Metals", "gamma"])
    s = engine.summary()
    assert tuple(s["totals"].first()) == (5, 2, 2, 1)
    assert [(r.org, r.n) for r in s["top_orgs"].collect()] == [("Beta Labs", 2), ("gamma", 2), ("Acme Metals", 1), ("delta works", 1)]
    assert engine.same_org("acme metals ltd", "Acme-Metals") and not engine.same_org("Acme", "Acme Metals")


def test_matrix_and_whitespace(engine):
    cells = {(r.mineral, r.stage): (r.patents, r.research) for r in engine.matrix().collect()}
    assert len(cells) == 2 * 4 and cells["LI", "extraction_refining"] == (1, 1) and cells["CO", "recycling"] == (1, 0) and cells["LI", "recycling"] == (0, 0)
    ranked = [(r.mineral, r.stage, r.gap, r.neglected) for r in engine.whitespace(20).collect()]
    assert ranked[0] == ("CO", "beneficiation", 1, False) and ranked[1][3] and ranked[-1][2] == -1
    assert {(r.mineral, r.stage): r.n for r in engine.heatmap().collect()}["LI", "extraction_refining"] == 2
    wide = analytics.heatmap_wide(engine.records, ["recycling", "materials"]).orderBy("mineral").collect()
    assert [tuple(r) for r in wide] == [("CO", 1, 1), ("LI", 0, 0)]
    odd = engine.records.sparkSession.createDataFrame([("x", ["A", "A"], ["S"])], "kind string, mineral_ids array<string>, stage_ids array<string>")
    assert analytics.matrix(odd).first().patents == 2
    half = engine.spark.createDataFrame([("rd", ["A"], []), ("patent", None, ["S"]), ("patent", ["B"], ["T"])], odd.schema)
    want = {("A", "S"): (0, 0), ("A", "T"): (0, 0), ("B", "S"): (0, 0), ("B", "T"): (1, 0)}
    assert {(r.mineral, r.stage): (r.patents, r.research) for r in analytics.matrix(half).collect()} == want
    named = engine.spark.createDataFrame([("B",), ("Z",)], "mineral string")
    assert {(r.mineral, r.stage): r.patents for r in analytics.matrix(half, minerals=named).collect()} == {("B", "S"): 0, ("B", "T"): 1, ("Z", "S"): 0, ("Z", "T"): 0}
    assert analytics.matrix(half.limit(0)).collect() == []


def test_collaborations(engine):
    got = [(r.org_a, r.org_b, [tuple(c) for c in r.shared]) for r in engine.collaborations().collect()]
    cell = ("LI", "extraction_refining")
    assert got == [("Acme Metals", "delta works", [cell]), ("Beta Labs", "delta works", [cell])]


def test_graph(engine):
    nodes, edges = engine.graph()
    kinds = {r.type: r["count"] for r in nodes.groupBy("type").count().collect()}
    assert kinds == {"record": 5, "org": 4, "mineral": 2, "stage": 4, "family": 1}
    by = {r.type: r["count"] for r in edges.groupBy("type").count().collect()}
    assert by["cofiled_with"] == 2 and by["applicant_of"] == 6
    assert graph.reconcile(nodes, edges, 5).first().consistent and not graph.reconcile(nodes, edges, 4).first().consistent
    lost = nodes.where("id <> 'org:gamma'")
    assert graph.dangling(lost, edges).count() == 3 and not graph.reconcile(lost, edges, 5, 5).first().consistent


def test_resolve(spark):
    aliases = alias_rows(spark, ALIASES)
    assert resolve.merge_rate(aliases).first().rate == 1.0
    with pytest.raises(ValueError):
        resolve.alias_index(alias_rows(spark, {"A": ["x."], "B": ["X"]}))
    names = spark.createDataFrame([("beta (labs)",), ("",), (None,), ("Other, Inc.",)], "name string")
    assert [r.org for r in resolve.resolved(names, resolve.alias_index(aliases)).collect()] == ["Beta Labs", "unknown", "unknown", "other inc"]


def test_keep_first_needs_an_order(spark):
    rows = spark.createDataFrame([("a", None, 3), ("a", None, 1), ("b", "x", 2)], "k string, u string, at int")
    assert sorted((r.k, r.at, r.n_duplicates) for r in dedupe.with_duplicate_counts(rows, ["k", "u"], ["at"]).collect()) == [("a", 1, 1), ("b", 2, 0)]


def test_holdout(spark):
    d = {"test_ids": ["a", "b"], "labels": {"a": {"mineral_ids": ["LI"], "stage_ids": ["s"]}, "b": {"mineral_ids": ["CO", "LI"], "stage_ids": []}}}
    pred = spark.createDataFrame([("a", ["LI"], ["s"]), ("b", ["LI"], ["t"]), ("c", [], [])], "fixture_id string, pred_mineral_ids array<string>, pred_stage_ids array<string>")
    records = spark.createDataFrame([(["NI"], ["s"])], "mineral_ids array<string>, stage_ids array<string>")
    out = {r.task: r for r in quality.evaluate_holdout(pred, holdout_rows(spark, d), records).collect()}
    assert (out["mineral"].n, out["mineral"].subset_accuracy, out["mineral"].macro_f1, out["mineral"].labels_scored, out["mineral"].labels_unexercised) == (2, 0.5, 0.5, 2, 1)
    # A stage that is only predicted is no label of the universe.
    assert (out["stage"].subset_accuracy, out["stage"].macro_f1, out["stage"].labels_scored) == (0.5, 1.0, 1) and out["stage"].gate == "PROVISIONAL"
    with pytest.raises(ValueError):
        quality.evaluate_holdout(pred.where("fixture_id <> 'a'"), holdout_rows(spark, d), records)


@pytest.mark.parametrize("now,status", [({"q": 0.88}, "failure"), ({"q": 0.885}, "ok"), ({"q": 0.95}, "improvement"), ({"t_ms_avg": 121.0}, "failure"), ({"t_ms_avg": 120.0}, "ok"), ({"t_ms_avg": 80.0}, "improvement"), ({"new": 1.0}, "new")])
def test_drift(spark, now, status):
    baseline = baseline_rows(spark, {"metrics": {"q": {"value": 0.9}, "t_ms_avg": {"value": 100, "kind": "speed"}}})
    report = quality.drift(spark.createDataFrame(list(now.items()), "metric string, value double"), baseline)
    rows = {r.metric: r.status for r in report.collect()}
    assert rows[next(iter(now))] == status and sorted(rows.values()).count("missing") == 2 - len(set(now) & {"q", "t_ms_avg"})
    assert not quality.drift_ok(report)
    assert {r.metric: r.kind for r in quality.recorded_baseline(spark.createDataFrame([("a_ms_avg", 1.0), ("b", 1.0)], "metric string, value double")).collect()} == {"a_ms_avg": "speed", "b": "quality"}


def test_validation(spark, engine):
    assert quality.taxonomy_faults(engine.taxonomy) == []
    bad = json.loads(json.dumps(TAXONOMY))
    bad["minerals"].pop()
    bad["value_chain_stages"].pop()
    bad["process_families"][0] |= {"stage": "nowhere", "subdomains": []}
    assert len(quality.taxonomy_faults(taxonomy_of(bad))) == 4
    report = quality.fixture_report(engine.records).first()
    assert (report.patents, report.others, report.ids, report.ok) == (2, 3, 3, False)
    assert [r[0] for r in spark.createDataFrame([("data/a",), ("data/ipo_cache/x",), ("x.tgz",), ("a.tgz.manifest.json",), ("b.verify/c",), ("data/ipo_cached",)], "p string").select(quality.backed_up(F.col("p"))).collect()] == [True, False, False, False, False, True]


def test_manifest(spark, tmp_path):
    (tmp_path / "a").write_text("one")
    (tmp_path / "b").write_text("two")
    read = lambda: quality.manifest(spark.read.format("binaryFile").load(str(tmp_path) + "/*"))
    kept = spark.createDataFrame(read().collect())
    assert quality.manifest_difference(kept, read()).collect() == []
    (tmp_path / "a").write_text("changed")
    (tmp_path / "b").unlink()
    (tmp_path / "c").write_text("new")
    got = {r.path.rsplit("/", 1)[1]: r.status for r in quality.manifest_difference(kept, read()).collect()}
    assert got == {"a": "changed", "b": "missing", "c": "new"}


def test_sinks(engine, tmp_path):
    nodes, edges = engine.graph()
    counts = json.loads(sinks.write_graph(nodes, edges, str(tmp_path / "g")))
    assert counts == {"nodes": 16, "edges": edges.count(), "dangling": 0}
    assert json.loads(sinks.metrics_json(engine.summary()["totals"]))[0]["total"] == 5
    rows = engine.records.withColumns({"journal_no": F.lit("1-2026"), "journal_part": F.when(F.col("kind") == "rd", "I").otherwise("II")})
    sinks.write_archive(rows, str(tmp_path / "arch"))
    sinks.write_archive(rows.where("kind = 'rd'").limit(1), str(tmp_path / "arch"))
    back = engine.spark.read.json(str(tmp_path / "arch"))
    assert {(r.journal_part, r["count"]) for r in back.groupBy("journal_part").count().collect()} == {("I", 1), ("II", 3)}


def test_display_text_of_unknown_ids(spark):
    df = spark.createDataFrame([(["LI", "ZZ"],)], "ids array<string>")
    assert df.select(corpus.display_text(F.col("ids"), {"LI": "Lithium"})).first()[0] == "Lithium ZZ"


def test_jobs(engine, tmp_path):
    from corvane.plans import jobs

    d = {"locked": True, "test_ids": ["G1", "G3"], "labels": {"G1": {"mineral_ids": ["LI"], "stage_ids": ["extraction_refining"]}, "G3": {"mineral_ids": ["LI"], "stage_ids": ["recycling"]}}}
    (tmp_path / "holdout.json").write_text(json.dumps(d))
    scores = {r.task: r for r in jobs.evaluate(engine, str(tmp_path / "holdout.json")).collect()}
    assert scores["mineral"].subset_accuracy == 1.0 and scores["stage"].subset_accuracy == 0.5
    now = {r.metric: r.value for r in jobs.measure(engine, str(tmp_path / "holdout.json"), 1).collect()}
    assert now["org_merge_rate"] == 1.0 and now["mineral_macro_f1"] == 1.0 and now["search_ms_avg"] > 0
    baseline = {"tolerance": {"quality_pp": 2.0, "speed_pct": 1e9}, "metrics": {m: {"value": v, "kind": "speed" if m == "search_ms_avg" else "quality"} for m, v in now.items()}}
    (tmp_path / "baseline.json").write_text(json.dumps(baseline))
    assert jobs.check_drift(engine, str(tmp_path / "holdout.json"), str(tmp_path / "baseline.json"))[0]
    said = []
    assert not jobs.in_order([("a", lambda: None), ("b", lambda: 1 / 0), ("c", lambda: None)], said.append) and [x.split(":")[0] for x in said] == ["a", "b"]
    (tmp_path / "root/data/ipo_cache").mkdir(parents=True)
    (tmp_path / "root/data/x").write_text("x")
    (tmp_path / "root/data/ipo_cache/y").write_text("y")
    assert [r.path for r in jobs.backup_manifest(engine.spark, str(tmp_path / "root")).collect()] == ["data/x"]


def test_backup_and_restore(spark, tmp_path):
    from corvane.plans import jobs

    root, archive, dest = (str(tmp_path / x) for x in ("root", "archive", "dest"))
    (tmp_path / "root/data/x.verify").mkdir(parents=True)
    files = {"data/a": b"one\x00\xff", "b.json": b"", "data/c d": b"x" * 100_000}
    for path, content in (files | {"data/x.verify/y": b"y", "old.tgz": b"z"}).items():
        (tmp_path / "root" / path).write_bytes(content)
    assert jobs.backup(spark, root, archive) == 3 and jobs.verify_backup(spark, archive, root).collect() == []
    assert jobs.restore(spark, archive, dest) == 3
    assert {str(p.relative_to(dest)): p.read_bytes() for p in (tmp_path / "dest").rglob("*") if p.is_file() and not p.name.endswith(".crc")} == files
    assert jobs.verify_backup(spark, archive, dest).collect() == []
    (tmp_path / "root/data/a").write_bytes(b"two")
    assert [tuple(r) for r in jobs.verify_backup(spark, archive, root).collect()] == [("data/a", "changed")]
    held = spark.read.parquet(archive)
    held.withColumn("content", F.when(F.col("path") == "b.json", F.encode(F.lit("!"), "utf-8")).otherwise(F.col("content"))).write.parquet(archive + "-bad")
    assert [tuple(r) for r in jobs.verify_backup(spark, archive + "-bad").collect()] == [("b.json", "changed")]
    held.withColumn("path", F.concat(F.lit("../"), "path")).write.parquet(archive + "-out")
    with pytest.raises(ValueError):
        jobs.restore(spark, archive + "-out", dest)


def test_baseline_is_recorded(engine, tmp_path):
    from corvane.plans import jobs

    (tmp_path / "holdout.json").write_text(json.dumps({"test_ids": ["G1"], "labels": {"G1": {"mineral_ids": ["LI"], "stage_ids": ["extraction_refining"]}}}))
    path = tmp_path / "baseline.json"
    path.write_text(json.dumps({"tolerance": {"quality_pp": 1.0, "speed_pct": 1e9}, "metrics": {"gone": {"value": 1}, "org_merge_rate": {"value": 0, "kind": "speed"}}}))
    jobs.record_baseline(engine, str(tmp_path / "holdout.json"), str(path), "2026-01-02", 1)
    doc = json.loads(path.read_text())
    assert doc["tolerance"]["quality_pp"] == 1.0 and "gone" not in doc["metrics"] and list(doc["metrics"]) == sorted(doc["metrics"])
    assert doc["metrics"]["org_merge_rate"] == {"value": 1.0, "kind": "speed", "recorded": "2026-01-02"}
    assert doc["metrics"]["search_ms_avg"]["kind"] == "speed" and doc["metrics"]["mineral_macro_f1"]["kind"] == "quality"
    assert jobs.check_drift(engine, str(tmp_path / "holdout.json"), str(path), 1)[0]


def test_golden_queries(engine, tmp_path):
    from corvane.plans import jobs

    rows = engine.records.select("doc_id", "title", "kind").collect()
    queries = []
    for r in rows:
        best = engine.search(r.title, kind=r.kind, limit=1)[1].first()
        queries.append({"q": r.title, "kind": r.kind, "expected_top": best.doc_id})
    path = tmp_path / "golden.json"
    path.write_text(json.dumps({"queries": queries}))
    assert jobs.check_golden(engine, str(path)) == []
    path.write_text(json.dumps({"queries": [queries[0] | {"expected_top": "other"}, {"q": "zzzz", "stage": None, "expected_top": "none"}]}))
    assert jobs.check_golden(engine, str(path)) == [(rows[0].title, "other", queries[0]["expected_top"]), ("zzzz", "none", None)]


def test_export_job(spark, tmp_path):
    from corvane.plans import jobs

    kind = "publication_number string, country_code string, kind_code string, publication_date long, title_localized array<struct<text:string,language:string>>, abstract_localized array<struct<text:string,language:string>>, assignee_harmonized array<struct<name:string>>, inventor_harmonized array<struct<name:string>>, ipc array<struct<code:string>>"
    one = lambda n, country, title: (n, country, "A", 20200101, [(title, "en")], [], [("x",)], [], [("C22B",)])
    rows = spark.createDataFrame([one("1", "IN", "Lithium cell"), one("2", "IN", "A chair"), one("3", "US", "Lithium"), one("4", "IN", "Cobalt and lithium")], kind)
    report = jobs.export_patents(rows, str(tmp_path / "out")).first()
    assert (report.in_publications, report.li, report.co, report.any_pilot) == (2, 2, 1, 2)
    assert sorted(r.publication_number for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "4"]


def test_journal_job(spark, tmp_path):
    from corvane.plans import jobs

    block = "x (12) PATENT APPLICATION PUBLICATION (21) Application No.202611000001 A\n(54) Title of the invention : COBALT CELL (51) x"
    (tmp_path / "a.txt").write_text(block)
    texts = {("1/2026", "Part I"): str(tmp_path / "a.txt"), ("2/2026", "Part I"): str(tmp_path / "missing.txt")}
    run = lambda: jobs.harvest_journal(spark, texts, str(tmp_path / "archive"), str(tmp_path / "store"))
    added, failed = run()
    assert added == 1 and set(failed) == {("2/2026", "Part I")}
    assert run()[0] == 0


def test_constraints(engine):
    rows = engine.records.unionByName(engine.records.limit(1))
    got = {r.rule: r.n for r in quality.constraint_report(rows).collect()}
    assert got == {"source_id_missing": 0, "source_url_missing": 0, "title_missing": 0, "kind_unknown": 0, "source_pair_repeated": 1}
