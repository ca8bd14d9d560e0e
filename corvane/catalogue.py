"""Every query of the engine over the driver's whole tables, with its DuckDB counterpart where SQL can say it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as t
from corvane.operators import analytics, automaton, buckets, dedupe, export, graph, ordering, postings, quality, resolve, search
from corvane.operators.taxonomy import classified, term_hits
from corvane.plans import jobs
from corvane.plans.driver_views import DRIVER_TAXONOMY, customer_records, kind_of_status, star_records, table, text_records
from corvane.sources.journal import with_candidate_reason
from corvane.sources.readers import matches
from corvane.streaming import alerts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


KIND = "CASE o_orderstatus WHEN 'F' THEN 'patent' WHEN 'O' THEN 'rd' WHEN 'P' THEN 'publication' END"
STAR = f"""lines AS (SELECT l_orderkey, p_type, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
rec AS (SELECT o_orderkey, {KIND} AS kind, o_orderpriority AS stage, strftime(o_orderdate, '%Y-%m-%d') AS filing_date FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lines)),
mineral AS (SELECT DISTINCT l_orderkey AS o_orderkey, p_type AS mineral FROM lines),
org AS (SELECT DISTINCT l_orderkey AS o_orderkey, s_name AS org FROM lines)"""
CELLS = """cell AS (SELECT mineral, stage, kind FROM rec JOIN mineral USING (o_orderkey)),
grid AS (SELECT * FROM (SELECT DISTINCT mineral FROM mineral) CROSS JOIN (SELECT DISTINCT stage FROM rec)),
counted AS (SELECT mineral, stage, count(*) FILTER (kind NOT IN ('rd', 'publication')) AS patents, count(*) FILTER (kind IN ('rd', 'publication')) AS research, count(*) AS n FROM cell GROUP BY ALL),
m AS (SELECT mineral, stage, coalesce(patents, 0)::BIGINT AS patents, coalesce(research, 0)::BIGINT AS research, coalesce(n, 0)::BIGINT AS n FROM grid LEFT JOIN counted USING (mineral, stage))"""
RANKED = f"""WITH {STAR}, {CELLS} SELECT mineral, stage, patents, research, research - patents AS gap, research + patents = 0 AS neglected,
row_number() OVER (ORDER BY research - patents DESC, patents + research, mineral, stage)::BIGINT AS rank FROM m"""


# Dashboards and the matrix ---------------------------------------------------


@query(f"WITH {STAR} SELECT count(*)::BIGINT AS total, count(*) FILTER (kind = 'patent')::BIGINT AS patent, count(*) FILTER (kind = 'rd')::BIGINT AS rd, count(*) FILTER (kind = 'publication')::BIGINT AS publication FROM rec")
def kind_totals(spark, sf):
    return analytics.totals(star_records(spark, sf))


@query(f"WITH {STAR} SELECT mineral, count(*)::BIGINT AS n FROM mineral GROUP BY mineral")
def count_by_facet(spark, sf):
    return analytics.count_by(star_records(spark, sf), "mineral_ids", "mineral")


@query(f"WITH {STAR} SELECT stage, count(*)::BIGINT AS n FROM rec GROUP BY stage")
def count_by_stage(spark, sf):
    return analytics.count_by(star_records(spark, sf), "stage_ids", "stage")


@query(f"WITH {STAR}, c AS (SELECT org, count(*)::BIGINT AS n FROM org GROUP BY org) SELECT org, n, row_number() OVER (ORDER BY n DESC, org)::BIGINT AS rank FROM c")
def top_orgs(spark, sf):
    counted = analytics.count_by(star_records(spark, sf), "orgs", "org")
    return ordering.ranked_table(counted, [F.desc("n"), "org"], _scratch(spark, "orgs"))


@query(f"WITH {STAR} SELECT DISTINCT mineral FROM mineral")
def mineral_axis(spark, sf):
    return analytics.axis(star_records(spark, sf), "mineral_ids", "mineral")


@query(f"WITH {STAR}, {CELLS} SELECT mineral, stage, n FROM m")
def heatmap_grid(spark, sf):
    return analytics.heatmap(star_records(spark, sf))


@query(f"WITH {STAR}, {CELLS} SELECT mineral, stage, patents, research FROM m")
def gap_matrix(spark, sf):
    return analytics.matrix(star_records(spark, sf))


@query(RANKED)
def whitespace_rank(spark, sf):
    return analytics.whitespace(analytics.matrix(star_records(spark, sf)))


@query(f"SELECT * FROM ({RANKED}) WHERE rank <= 10")
def whitespace_top10(spark, sf):
    return analytics.whitespace(analytics.matrix(star_records(spark, sf))).orderBy("rank").limit(10)


# Organisations ----------------------------------------------------------------


@query(f"""WITH {STAR}, who AS (SELECT o_orderkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
o AS (SELECT o_orderkey, n_name AS org FROM who UNION ALL SELECT o_orderkey, r_name FROM who),
act AS (SELECT DISTINCT org, mineral, stage FROM o JOIN mineral USING (o_orderkey) JOIN rec USING (o_orderkey)),
filed AS (SELECT DISTINCT least(n_name, r_name) AS org_a, greatest(n_name, r_name) AS org_b FROM who SEMI JOIN rec USING (o_orderkey))
SELECT a.org AS org_a, b.org AS org_b, a.mineral, a.stage FROM act a JOIN act b ON a.mineral = b.mineral AND a.stage = b.stage AND a.org < b.org
ANTI JOIN filed f ON f.org_a = a.org AND f.org_b = b.org""")
def collaborations(spark, sf):
    return analytics.collaborations(customer_records(spark, sf))


@query(f"""WITH {STAR}, one AS (SELECT min(s_name) AS name FROM supplier), own AS (SELECT o_orderkey FROM org, one WHERE org = name)
SELECT any_value(name) AS org, (SELECT count(*) FROM own)::BIGINT AS record_count, (SELECT string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FROM own) AS record_ids,
(SELECT string_agg(org, ',' ORDER BY org) FROM (SELECT DISTINCT org FROM org SEMI JOIN own USING (o_orderkey) WHERE org <> (SELECT name FROM one))) AS co_orgs FROM one""")
def org_profile(spark, sf):
    name = table(spark, sf, "supplier").agg(F.min("s_name")).first()[0]
    out = analytics.org_profile(star_records(spark, sf), name, ["o_orderkey"])
    return out.select("org", "record_count", F.array_join("record_ids", ",").alias("record_ids"), F.array_join("co_orgs", ",").alias("co_orgs"))


@query(f"""WITH {STAR}, one AS (SELECT min(s_name) AS name FROM supplier), own AS (SELECT o_orderkey FROM org, one WHERE org = name)
SELECT 'record' AS part, o_orderkey::VARCHAR AS key, row_number() OVER (ORDER BY o_orderkey)::BIGINT AS n FROM own UNION ALL SELECT 'partner', org, count(*)::BIGINT FROM org SEMI JOIN own USING (o_orderkey) WHERE org <> (SELECT name FROM one) GROUP BY org""")
def org_profile_rows(spark, sf):
    """The same profile in rows: the records with their place in the corpus, and the partners with their records."""
    records, name = star_records(spark, sf), table(spark, sf, "supplier").agg(F.min("s_name")).first()[0]
    own = ordering.ranked_table(analytics.org_records(records, name, ["o_orderkey"]), ["o_orderkey"], _scratch(spark, "org"), "n")
    partners = analytics.org_partners(records, name)
    return own.select(F.lit("record").alias("part"), F.col("doc_id").alias("key"), "n").unionByName(partners.select(F.lit("partner").alias("part"), F.col("org").alias("key"), "n"))


@query(r"""WITH t AS (SELECT c_custkey AS k FROM customer), r AS (SELECT k, k % 40 AS part, (202600000000 + k % 900)::VARCHAR AS appl_no FROM t)
SELECT 'archived' AS part, appl_no, count(*)::BIGINT AS n FROM r GROUP BY appl_no UNION ALL SELECT 'stored', 'p' || part || '/' || appl_no, 1 FROM (SELECT DISTINCT part, appl_no FROM r WHERE k % 900 % 3 <> 0)""")
def journal_job(spark, sf):
    """Forty journal parts read by one job, twice: all records archived, and the candidates of each part stored once."""
    base, k = _scratch(spark, "journal"), F.col("c_custkey")
    title = F.when(k % 900 % 3 == 0, "A CHAIR").otherwise("LITHIUM CELL")
    block = F.concat(F.lit("(12) PATENT APPLICATION PUBLICATION (21) Application No."), (k % 900 + 202600000000).cast("string"), F.lit(" A\n(54) Title of the invention : "), title, F.lit("\n\n"))
    table(spark, sf, "customer").select(block.alias("value"), (k % 40).alias("part")).write.partitionBy("part").text(f"{base}/in")
    texts = {("1/2026", f"p{n}"): f"{base}/in/part={n}" for n in range(40)} | {("1/2026", "lost"): f"{base}/in/part=lost"}
    for _ in range(2):
        added, failed = jobs.harvest_journal(spark, texts, f"{base}/archive", f"{base}/store")
    if added or list(failed) != [("1/2026", "lost")]:
        raise ValueError(f"the second harvest stored {added} and failed in {failed}")
    archived, stored = spark.read.json(f"{base}/archive"), spark.read.json(f"{base}/store")
    found = stored.select(F.concat_ws("/", "journal_part", "appl_no").alias("appl_no")).groupBy("appl_no").agg(F.count("*").alias("n"))
    return archived.groupBy("appl_no").agg(F.count("*").alias("n")).select(F.lit("archived").alias("part"), "appl_no", "n").unionByName(found.select(F.lit("stored").alias("part"), "appl_no", "n"))


ALIASES = {"ASIA PACIFIC": ["ASIA", "Asia (Pacific)"], "Old World": ["EUROPE", "Europe & Co.", "MIDDLE EAST"], "Brand-11": ["BRAND#11"]}
ALIAS_VALUES = ", ".join(f"('{c}', '{v}')" for c, vs in ALIASES.items() for v in [c, *vs])
FORM = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[.,()\"''&/\\-]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"""WITH alias(canonical, variant) AS (VALUES {ALIAS_VALUES}), idx AS (SELECT DISTINCT {FORM.format('variant')} AS norm, canonical FROM alias),
names AS (SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT s_name FROM supplier UNION ALL SELECT '  ')
SELECT name, coalesce(canonical, nullif({FORM.format('name')}, ''), 'unknown') AS org FROM names LEFT JOIN idx ON {FORM.format('name')} = norm""")
def org_resolve(spark, sf):
    from corvane.sources.reference import alias_rows

    each = [table(spark, sf, a).select(F.col(c).alias("name")) for a, c in (("region", "r_name"), ("nation", "n_name"), ("supplier", "s_name"))]
    names = each[0].unionAll(each[1]).unionAll(each[2]).unionAll(spark.createDataFrame([("  ",)], "name string"))
    return resolve.resolved(names, resolve.alias_index(alias_rows(spark, ALIASES)))


@query(f"""WITH alias AS (SELECT s_name AS canonical, n_name AS variant FROM supplier JOIN nation ON s_nationkey = n_nationkey), i AS (SELECT DISTINCT {FORM.format('variant')} AS norm, canonical FROM alias)
SELECT norm, count(*)::BIGINT AS n, string_agg(canonical, ', ' ORDER BY canonical) AS canonicals FROM i GROUP BY norm HAVING count(*) > 1""")
def alias_collision(spark, sf):
    """Suppliers that all claim their nation's name."""
    nation = F.broadcast(table(spark, sf, "nation"))
    aliases = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("canonical"), F.col("n_name").alias("variant"))
    return resolve.collisions(aliases)


# Graph --------------------------------------------------------------------------

EDGES = f"""WITH {STAR}, e AS (SELECT 'rec:' || o_orderkey AS src, 'org:' || org AS dst, 'applicant_of' AS type FROM org
UNION ALL SELECT 'rec:' || o_orderkey, 'min:' || mineral, 'classified_as' FROM mineral
UNION ALL SELECT 'rec:' || o_orderkey, 'stg:' || stage, 'classified_as' FROM rec
UNION ALL SELECT 'org:' || a.org, 'org:' || b.org, 'cofiled_with' FROM org a JOIN org b ON a.o_orderkey = b.o_orderkey AND a.org < b.org),
n AS (SELECT 'rec:' || o_orderkey AS id, 'record' AS type, kind, 'order ' || o_orderkey AS title, NULL::VARCHAR AS name FROM rec
UNION ALL SELECT 'org:' || org, 'org', NULL, NULL, org FROM (SELECT DISTINCT org FROM org)
UNION ALL SELECT 'min:' || mineral, 'mineral', NULL, NULL, mineral FROM (SELECT DISTINCT mineral FROM mineral)
UNION ALL SELECT 'stg:' || stage, 'stage', NULL, NULL, stage FROM (SELECT DISTINCT stage FROM rec))"""


def keyed_star(spark, sf):
    return star_records(spark, sf).withColumn("rec_key", F.col("doc_id"))


@query(f"{EDGES} SELECT * FROM n")
def graph_nodes(spark, sf):
    return graph.nodes(keyed_star(spark, sf), ["o_orderkey"])


@query(f"{EDGES} SELECT * FROM e")
def graph_edges(spark, sf):
    return graph.edges(keyed_star(spark, sf))


@query(f"WITH {STAR} SELECT a.org AS org_a, b.org AS org_b FROM org a JOIN org b ON a.o_orderkey = b.o_orderkey AND a.org < b.org")
def cofiled_edges(spark, sf):
    return graph.cofiled(star_records(spark, sf))


@query(f"""{EDGES} SELECT (SELECT count(*) FROM n WHERE type = 'record')::BIGINT AS record_nodes, (SELECT count(*) FROM rec)::BIGINT AS expected_records, (SELECT count(*) FROM n)::BIGINT AS node_count,
(SELECT count(*) FROM e)::BIGINT AS edge_count, (SELECT count(*) FROM e WHERE src NOT IN (SELECT id FROM n) OR dst NOT IN (SELECT id FROM n))::BIGINT AS dangling_edges,
(SELECT count(*) FROM n WHERE type = 'record') = (SELECT count(*) FROM rec) AND NOT EXISTS (FROM e WHERE src NOT IN (SELECT id FROM n) OR dst NOT IN (SELECT id FROM n)) AS consistent""")
def graph_reconcile(spark, sf):
    records = keyed_star(spark, sf)
    # The graph is made once, as a job that writes it would, and counted as it was written.
    path = f"{_shared(spark)}/graph-{uuid.uuid4().hex}"
    graph.nodes(records, ["o_orderkey"]).write.parquet(f"{path}/nodes")
    graph.edges(records).write.parquet(f"{path}/edges")
    return graph.reconcile(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").count())


@query(f"WITH {STAR} SELECT o_orderkey::VARCHAR AS doc_id, org, 'applicant' AS role FROM org")
def record_org_links(spark, sf):
    return graph.record_org_links(star_records(spark, sf))


# Search --------------------------------------------------------------------------

TOK = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'))"
SEARCH_CTE = f"""WITH d AS (SELECT lpad(doc_id::VARCHAR, 9, '0') AS doc_id, split_part(text, chr(10), 1) AS title, text AS abstract, lang, source, CASE lang WHEN 'en' THEN 'patent' WHEN 'fr' THEN 'publication' ELSE 'rd' END AS kind FROM documents),
f AS (SELECT doc_id, title, kind, lang, source, {TOK.format('title')} AS a, {TOK.format("source || ' ' || lang")} AS b, {TOK.format('source')} AS c, {TOK.format('abstract')} AS e FROM d)"""


def score_sql(tokens: list[str]) -> str:
    return " + ".join(f"{w} * list_contains({c}, '{x}')::INT" for x in tokens for c, w in (("a", 3), ("b", 2), ("c", 2), ("e", 1)))


def ranked_sql(tokens: list[str], where: str = "TRUE") -> str:
    score = f"({score_sql(tokens)})::DOUBLE" if tokens else "0.0::DOUBLE"
    return f"{SEARCH_CTE}, s AS (SELECT doc_id, title, kind, {score} AS score FROM f WHERE {where}) SELECT doc_id, title, kind, score, row_number() OVER (ORDER BY score DESC, doc_id)::BIGINT AS rank FROM s" + (" WHERE score > 0" if tokens else "")


def searched(spark, sf, q, limit=None, **facets):
    index = search.indexed(text_records(spark, sf))
    if limit:
        return search.ranked(search.search(index, q, limit=limit, **facets).select("doc_id", "title", "kind", "score"))
    found = search.hits(index, q, **facets).select("doc_id", "title", "kind", "score")
    return ordering.ranked_table(found, [F.desc("score"), "doc_id"], _scratch(spark, "hits"))


@query(ranked_sql(["the", "trash", "la", "src3", "the"]))
def search_ranked(spark, sf):
    return searched(spark, sf, "The trash, la src3 the")


@query(f"SELECT * FROM ({ranked_sql(['the', 'la'])}) WHERE rank <= 10")
def search_top10(spark, sf):
    return searched(spark, sf, "the la", limit=10)


@query(f"SELECT * FROM ({ranked_sql(['the', 'la', 'src3'])}) WHERE rank <= 10")
def search_index_top10(spark, sf):
    """The best records by a written index, whose blocks are read no further than the hits need."""
    records = text_records(spark, sf)
    index = postings.write_index(search.indexed(records), _scratch(spark, "index"))
    return records.select("doc_id", "title", "kind").join(F.broadcast(index.hits("the la src3")), "doc_id")


@query(ranked_sql(["de", "la", "les"], "lang = 'fr' AND source = 'src1' AND kind = 'publication'"))
def search_faceted(spark, sf):
    return searched(spark, sf, "De la, les", mineral="fr", stage="src1", kind="publication")


@query(ranked_sql([], "lang = 'de'"))
def search_empty_query(spark, sf):
    return searched(spark, sf, " ?! ", mineral="de")


@query(f"{SEARCH_CTE} SELECT doc_id, ({score_sql(['the', 'trash', 'la'])})::DOUBLE AS score FROM f WHERE {score_sql(['the', 'trash', 'la'])} > 0")
def search_postings(spark, sf):
    return search.scores_from_postings(search.postings(search.indexed(text_records(spark, sf))), "the trash la")


@query(f"{SEARCH_CTE} SELECT doc_id, len(e)::BIGINT AS n_tokens FROM f")
def token_sets(spark, sf):
    return text_records(spark, sf).select("doc_id", F.size(t.token_set(F.col("abstract"))).cast("long").alias("n_tokens"))


@query("SELECT o_orderkey::VARCHAR AS doc_id, o_totalprice FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def record_lookup(spark, sf):
    orders = table(spark, sf, "orders")
    first = orders.agg(F.min("o_orderkey").cast("string")).first()[0]
    return search.lookup(orders.select(F.col("o_orderkey").cast("string").alias("doc_id"), "o_totalprice"), first)


@query(f"""WITH {STAR} SELECT o_orderkey::VARCHAR AS doc_id, 'order ' || o_orderkey AS title, kind, (SELECT string_agg(mineral, '|' ORDER BY mineral) FROM mineral m WHERE m.o_orderkey = rec.o_orderkey) AS minerals,
stage AS stages, (SELECT string_agg(org, '|' ORDER BY org) FROM org WHERE org.o_orderkey = rec.o_orderkey) AS orgs, filing_date FROM rec""")
def record_detail(spark, sf):
    return star_records(spark, sf).select("doc_id", "title", "kind", F.array_join("mineral_ids", "|").alias("minerals"), F.array_join("stage_ids", "|").alias("stages"), F.array_join("orgs", "|").alias("orgs"), "filing_date")


# Classification --------------------------------------------------------------------


def hit_sql(words: list[str], parts: list[str]) -> str:
    tests = [rf"regexp_matches(x, '(^|[^\p{{L}}\p{{N}}_]){w}([^\p{{L}}\p{{N}}_]|$)')" for w in words] + [f"contains(x, '{p}')" for p in parts]
    return "(" + (" OR ".join(tests) or "FALSE") + ")"


LABEL_SQL = "WITH d AS (SELECT doc_id, lower(text) AS x FROM documents), s AS (SELECT doc_id, x, " + ", ".join(f"{hit_sql(label.words, label.parts)} AS {label.id}" for label in [*DRIVER_TAXONOMY.minerals, *DRIVER_TAXONOMY.stages]) + " FROM d)"
FAMILY_SQL = {f.id: f"({f.parent} AND {hit_sql(f.words, f.parts)})" for f in DRIVER_TAXONOMY.families}


def list_sql(tests: dict[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in tests.items()) + "], lambda z: z IS NOT NULL), '|')"


@query(f"{LABEL_SQL} SELECT doc_id, {list_sql({x.id: x.id for x in DRIVER_TAXONOMY.minerals})} AS minerals, {list_sql({x.id: x.id for x in DRIVER_TAXONOMY.stages})} AS stages, {list_sql(FAMILY_SQL)} AS families FROM s")
def lexicon_classify(spark, sf):
    out = classified(table(spark, sf, "documents"), DRIVER_TAXONOMY, "text", None)
    return out.select("doc_id", *[F.array_join(f"pred_{c}_ids", "|").alias(n) for c, n in (("mineral", "minerals"), ("stage", "stages"), ("process_family", "families"))])


@query(f"{LABEL_SQL} " + " UNION ALL ".join([f"SELECT '{lv}' AS level, '{x.id}' AS label, count(*) FILTER ({FAMILY_SQL.get(x.id, x.id)})::BIGINT AS n FROM s" for lv, xs in (("mineral", DRIVER_TAXONOMY.minerals), ("stage", DRIVER_TAXONOMY.stages), ("family", [f for f in DRIVER_TAXONOMY.families if f.id != "F4"])) for x in xs]))
def family_gate(spark, sf):
    return term_hits(table(spark, sf, "documents"), DRIVER_TAXONOMY, "doc_id", "text").groupBy("level", "label").agg(F.count("*").alias("n"))


@query(r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS term FROM benchmark),
d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents) SELECT term, count(*)::BIGINT AS n_docs FROM d SEMI JOIN w USING (term) GROUP BY term""")
def term_documents(spark, sf):
    """In how many documents each word of the benchmark stands, all words in one walk of each text."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("w")).distinct()
    # The benchmark is reference data, as a taxonomy is.
    terms = [(r["w"], [r["w"]], []) for r in words.orderBy("w").collect()]
    found = table(spark, sf, "documents").select("doc_id", F.explode(automaton.hits(F.lower("text"), terms)).alias("term"))
    return found.groupBy("term").agg(F.countDistinct("doc_id").alias("n_docs"))


RUDE = "idiot|scum|trash|moron|stupid"
SCORED = f"""WITH d AS (SELECT doc_id, quality = 1 AS gq, toxic = 1 AS gt, ends_with(text, '.') AS pq, regexp_matches(text, '{RUDE}') AS pt FROM documents JOIN labels USING (doc_id)),
c AS (SELECT 'quality' AS label, count(*) FILTER (gq AND pq) AS tp, count(*) FILTER (pq AND NOT gq) AS fp, count(*) FILTER (gq AND NOT pq) AS fn FROM d
UNION ALL SELECT 'toxic', count(*) FILTER (gt AND pt), count(*) FILTER (pt AND NOT gt), count(*) FILTER (gt AND NOT pt) FROM d UNION ALL SELECT 'never', 0, 0, 0)"""


def scored_documents(spark, sf):
    flag = lambda test, name: F.when(test, F.lit(name))
    some = lambda *xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    both = table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "labels"), "doc_id")
    return both.select("doc_id", some(flag(F.col("quality") == 1, "quality"), flag(F.col("toxic") == 1, "toxic")).alias("gold"), some(flag(F.endswith("text", F.lit(".")), "quality"), flag(F.col("text").rlike(RUDE), "toxic")).alias("pred"))


def label_list(spark):
    return spark.createDataFrame([("quality",), ("toxic",), ("never",)], "label string")


@query(f"{SCORED} SELECT label, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, CASE WHEN tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1 FROM c")
def holdout_label_scores(spark, sf):
    return quality.label_scores(scored_documents(spark, sf), "gold", "pred", label_list(spark))


@query(f"""{SCORED} SELECT (SELECT count(*) FROM d)::BIGINT AS n, (SELECT round(avg((gq = pq AND gt = pt)::INT::DOUBLE), 4) FROM d) AS subset_accuracy,
(SELECT round(avg(2.0::DOUBLE * tp / (2 * tp + fp + fn)), 4) FROM c WHERE tp + fp + fn > 0) AS macro_f1, (SELECT count(*) FROM c WHERE tp + fp + fn > 0)::BIGINT AS labels_scored,
(SELECT count(*) FROM c WHERE tp + fp + fn = 0)::BIGINT AS labels_unexercised""")
def holdout_metrics(spark, sf):
    return quality.task_scores(scored_documents(spark, sf), "gold", "pred", label_list(spark))


KEYWORDS, PREFIXES = r"(?i)trash|scum|idiot|licensed under|\d{3}", ("src1", "src5", "zz")


@query(f"""WITH d AS (SELECT doc_id, list_sort(list_distinct([lower(z) FOR z IN regexp_extract_all(split_part(text, chr(10), 1) || ' ' || text, '{KEYWORDS}')])) AS k, [p FOR p IN ['src1', 'src5', 'zz'] IF starts_with(source, p)] AS c FROM documents)
SELECT doc_id, array_to_string(k, '|') AS keywords, array_to_string(c, '|') AS ipc FROM d WHERE len(k) > 0 OR len(c) > 0""")
def candidate_rule(spark, sf):
    records = table(spark, sf, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("abstract"), F.array("source").alias("ipc_codes"))
    out = with_candidate_reason(records, KEYWORDS, PREFIXES).where("candidate_reason is not null")
    return out.select("doc_id", F.array_join("candidate_reason.keywords", "|").alias("keywords"), F.array_join("candidate_reason.ipc", "|").alias("ipc"))


# Text rules and identities -----------------------------------------------------------


@query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest, length(trim(regexp_replace(text, '\s+', ' ', 'g')))::BIGINT AS n FROM documents")
def clean_text(spark, sf):
    c = t.clean_text(F.col("text"))
    return table(spark, sf, "documents").withColumn("c", c).select("doc_id", F.sha2("c", 256).alias("digest"), F.length("c").cast("long").alias("n"))


@query(r"SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS raw, len(regexp_extract_all(html, '(?s)<li><a href=\"([^\"]*)\">(.*?)</a>'))::BIGINT AS links FROM pages")
def page_fields(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("raw"), F.size(matches(F.col("html"), r'(?s)<li><a href="([^"]*)">(.*?)</a>', ["u", "t"])).cast("long").alias("links"))


@query(r"""WITH m AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?s)<li><a href="([^"]*)">(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?s)<li><a href="([^"]*)">(.*?)</a>', 2)) AS title, unnest(range(len(regexp_extract_all(html, '(?s)<li><a href="([^"]*)">(.*?)</a>', 1))))::INT AS line FROM pages)
SELECT page_id, line, href, title FROM m""")
def listing_cards(spark, sf):
    found = table(spark, sf, "pages").select("page_id", F.posexplode(matches(F.col("html"), r'(?s)<li><a href="([^"]*)">(.*?)</a>', ["href", "title"])).alias("line", "m"))
    return found.select("page_id", "line", "m.href", "m.title")


@query(r"""WITH d AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, ' %d/%m/%Y') END AS raw FROM orders)
SELECT o_orderkey, regexp_replace(trim(raw), '^(\d{4})-?(\d{2})-?(\d{2})$', '\1-\2-\3') AS filed FROM d""")
def norm_date(spark, sf):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", " dd/MM/yyyy"))
    return table(spark, sf, "orders").select("o_orderkey", t.norm_date(raw).alias("filed"))


NUMBER_SQL = "CASE o_orderkey % 4 WHEN 0 THEN 'in ' || (201800000 + o_orderkey) || ' A' WHEN 1 THEN 'IN' || (201800000 + o_orderkey) || 'b1' WHEN 2 THEN 'x' || (o_orderkey % 1000) || 'A' ELSE ' ' END"


def order_number():
    k = F.col("o_orderkey")
    return F.when(k % 4 == 0, F.concat(F.lit("in "), k + 201800000, F.lit(" A"))).when(k % 4 == 1, F.concat(F.lit("IN"), k + 201800000, F.lit("b1"))).when(k % 4 == 2, F.concat(F.lit("x"), k % 1000, F.lit("A"))).otherwise(" ")


KEY_SQL = r"""nullif(CASE WHEN length(regexp_extract({0}, '^(.*\d)[A-Z]\d?$', 1)) >= 8 THEN regexp_extract({0}, '^(.*\d)[A-Z]\d?$', 1) ELSE {0} END, '')""".format("regexp_replace(upper(raw), '[^A-Z0-9]', '', 'g')")


@query(f"WITH d AS (SELECT o_orderkey, {NUMBER_SQL} AS raw FROM orders) SELECT o_orderkey, {KEY_SQL} AS patent_key FROM d")
def patent_key(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", t.patent_key(order_number()).alias("patent_key"))


@query(f"WITH d AS (SELECT o_orderkey, trim({NUMBER_SQL}) AS raw, o_orderpriority AS source_id, o_orderkey::VARCHAR AS source_url FROM orders) SELECT o_orderkey, coalesce(nullif(raw, ''), source_id || '-' || substr(sha1(source_id || '|' || source_url), 1, 10)) AS record_id FROM d")
def record_id(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", t.record_id(order_number(), F.col("o_orderpriority"), F.col("o_orderkey").cast("string")).alias("record_id"))


# Deduplication, completeness, increments ------------------------------------------------


@query("SELECT doc_id, n_duplicates FROM (SELECT doc_id, row_number() OVER w AS k, (count(*) OVER (PARTITION BY source, text) - 1)::BIGINT AS n_duplicates FROM documents WINDOW w AS (PARTITION BY source, text ORDER BY doc_id)) WHERE k = 1")
def dedupe_first(spark, sf):
    return dedupe.with_duplicate_counts(table(spark, sf, "documents"), ["source", "text"], ["doc_id"]).select("doc_id", "n_duplicates")


@query(f"""WITH d AS (SELECT o_orderkey, {KIND} AS kind, {NUMBER_SQL} AS raw, o_orderpriority AS source_id, (o_custkey)::VARCHAR AS source_url, o_orderstatus = 'P' AS gold FROM orders),
i AS (SELECT *, CASE WHEN kind = 'patent' AND {KEY_SQL} IS NOT NULL THEN 'patent|' || {KEY_SQL} ELSE 'url|' || source_id || '|' || source_url END AS id FROM d),
h AS (SELECT o_orderkey, row_number() OVER (PARTITION BY id ORDER BY o_orderkey) AS k FROM i WHERE NOT gold AND id NOT IN (SELECT id FROM i WHERE gold))
SELECT o_orderkey FROM d WHERE gold UNION ALL SELECT o_orderkey FROM h WHERE k = 1""")
def identity_dedupe(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", kind_of_status().alias("kind"), order_number().alias("appl_no"), F.col("o_orderpriority").alias("source_id"), F.col("o_custkey").cast("string").alias("source_url"), (F.col("o_orderstatus") == "P").alias("gold"))
    return dedupe.merged(rows.where("gold"), rows.where("not gold"), ["o_orderkey"]).select("o_orderkey")


@query(ORACLES["identity_dedupe"])
def corpus_incremental(spark, sf):
    """The same corpus, whose harvested part lands in three parts, the last records first."""
    rows = table(spark, sf, "orders").select("o_orderkey", kind_of_status().alias("kind"), order_number().alias("appl_no"), F.col("o_orderpriority").alias("source_id"), F.col("o_custkey").cast("string").alias("source_url"), (F.col("o_orderstatus") == "P").alias("gold"))
    corpus = buckets.IncrementalCorpus(spark, _scratch(spark, "corpus"), ["o_orderkey"], 16)
    for part in (2, 0, 1):
        corpus.add(rows.where("not gold").where(F.col("o_orderkey") % 3 == part))
    return corpus.corpus(rows.where("gold")).select("o_orderkey")


@query("SELECT c_mktsegment, count(*)::BIGINT AS n, sum((c_name <> '')::INT + (c_acctbal > 0)::INT + (c_nationkey % 2 = 0)::INT)::DOUBLE / (count(*) * 3) AS completeness FROM customer GROUP BY c_mktsegment")
def completeness(spark, sf):
    rows = table(spark, sf, "customer").select("c_mktsegment", "c_name", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("string")).alias("balance"), F.when(F.col("c_nationkey") % 2 == 0, F.array("c_nationkey")).otherwise(F.expr("cast(array() as array<int>)")).alias("nations"))
    return quality.completeness(rows, ["c_name", "balance", "nations"], ["c_mktsegment"])


@query("""WITH d AS (SELECT source, lang, doc_id, text, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS k, CASE WHEN lang = 'en' THEN 5 ELSE 3 END AS need, CASE WHEN lang = 'en' THEN 4 ELSE 3 END AS have FROM documents),
s AS (SELECT source, grouping(source) AS whole, count(*) AS parsed, sum(have)::DOUBLE / sum(need) AS c, count(*) FILTER (k = 1) AS deduped FROM d GROUP BY ROLLUP (source))
SELECT CASE WHEN whole = 1 THEN 'total' ELSE source END AS source_id, parsed::BIGINT AS parsed, round(c, 4) AS completeness, deduped::BIGINT AS deduped, (parsed - deduped)::BIGINT AS duplicates FROM s""")
def pipeline_stats(spark, sf):
    records = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("source_id"), F.col("text").alias("source_url"), F.lit("t").alias("title"), F.when(F.col("lang") == "en", "patent").otherwise("rd").alias("kind"), F.array("lang").alias("applicants"), F.lit(None).cast("string").alias("filing_date"), F.lit("2024").alias("fetched_at")
    )
    return quality.pipeline_stats(records, dedupe.keep_first(records, ["source_id", "source_url"], ["doc_id"]))


@query(f"""WITH d AS (SELECT o_orderpriority AS s, o_custkey::VARCHAR AS u, CASE WHEN o_orderkey % 5 > 0 THEN 'x' END AS t, o_orderstatus AS st FROM orders)
SELECT 'source_id_missing' AS rule, count(*) FILTER (s IS NULL)::BIGINT AS n FROM d UNION ALL SELECT 'source_url_missing', count(*) FILTER (u IS NULL) FROM d UNION ALL SELECT 'title_missing', count(*) FILTER (t IS NULL) FROM d
UNION ALL SELECT 'kind_unknown', count(*) FILTER (st NOT IN ('F', 'O', 'P')) FROM d UNION ALL SELECT 'source_pair_repeated', count(*) - count(DISTINCT s || '|' || u) FROM d""")
def record_constraints(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("source_id"), F.col("o_custkey").cast("string").alias("source_url"), F.when(F.col("o_orderkey") % 5 > 0, "x").alias("title"), kind_of_status().alias("kind"))
    return quality.constraint_report(rows)


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01')")
def incremental_anti(spark, sf):
    orders = table(spark, sf, "orders")
    return dedupe.not_stored(orders, orders.where("o_orderdate < timestamp_ntz'1997-01-01 00:00:00'"), ["o_custkey"]).select("o_orderkey")


NOW, WAS = [("a", 0.88), ("b", 0.95), ("c_ms_avg", 130.0), ("d_ms_avg", 90.0), ("e", 1.0), ("h", 0.9), ("z_ms_avg", 5.0)], [("a", 0.9, "quality"), ("b", 0.9, "quality"), ("c_ms_avg", 100.0, "speed"), ("d_ms_avg", 100.0, "speed"), ("f", 0.5, "quality"), ("h", 0.9, "odd"), ("z_ms_avg", 0.0, "speed")]
VALUES = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" for x in r) + ")" for r in rows)


@query(f"""WITH n(metric, now) AS (VALUES {VALUES(NOW)}, ('rows', (SELECT count(*) FROM documents)::DOUBLE)), w(metric, was, kind) AS (VALUES {VALUES(WAS)}, ('rows', (SELECT count(*) FROM documents)::DOUBLE, 'quality')),
j AS (SELECT metric, kind, was, now, (was - now) * 100.0::DOUBLE AS drop, CASE WHEN was > 0 THEN (now - was) / was * 100.0::DOUBLE END AS rise FROM n FULL JOIN w USING (metric))
SELECT metric, kind, was, now, CASE kind WHEN 'quality' THEN drop WHEN 'speed' THEN rise END AS change, CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'missing'
WHEN kind = 'quality' THEN CASE WHEN drop > 2.0 THEN 'failure' WHEN now > was THEN 'improvement' ELSE 'ok' END
WHEN kind = 'speed' THEN CASE WHEN was <= 0 THEN 'skipped' WHEN rise > 20.0 THEN 'failure' WHEN now < was THEN 'improvement' ELSE 'ok' END ELSE 'failure' END AS status FROM j""")
def drift_report(spark, sf):
    rows = table(spark, sf, "documents").agg(F.lit("rows").alias("metric"), F.count("*").cast("double").alias("value"))
    current = spark.createDataFrame(NOW, "metric string, value double").unionByName(rows)
    baseline = spark.createDataFrame(WAS, "metric string, value double, kind string").unionByName(rows.withColumn("kind", F.lit("quality")))
    return quality.drift(current, baseline)


@query("SELECT avg((trim(coalesce(split_part(text, chr(10), 1), '')) <> '')::INT::DOUBLE) AS title_share, avg((trim(coalesce(split_part(text, chr(10), 2), '')) <> '')::INT::DOUBLE) AS abstract_share FROM documents")
def sample_quality(spark, sf):
    lines = F.split("text", "\n", -1)
    return quality.sample_quality(table(spark, sf, "documents").select(F.get(lines, F.lit(0)).alias("title"), F.get(lines, F.lit(1)).alias("abstract")))


# Export SQL -------------------------------------------------------------------------------


VOLUME = {"a": "trash|scum", "b": "li[ck]", "c": "the"}


@query("SELECT count(*)::BIGINT AS in_publications, " + ", ".join(f"count(*) FILTER (regexp_matches(lower(text), '{p}'))::BIGINT AS {n}" for n, p in VOLUME.items()) + f", count(*) FILTER (regexp_matches(lower(text), '{'|'.join(VOLUME.values())}'))::BIGINT AS any_pilot FROM documents WHERE starts_with(source, 'src1')")
def volume_countif(spark, sf):
    return export.volume(table(spark, sf, "documents").select(F.col("source").alias("publication_number"), F.col("text").alias("title")), "src1", VOLUME)


@query("""WITH f AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'assistant') AS said, arg_min(text, turn) AS first FROM conversations GROUP BY conv_id)
SELECT conv_id, said AS assistant, coalesce(said, first, '') AS preferred FROM f""")
def nested_first_text(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.col("role").alias("language"), "text"))).alias("turns"))
    return turns.select("conv_id", t.first_text(F.col("turns"), "assistant").alias("assistant"), t.preferred_text(F.col("turns"), "assistant", language_field="language").alias("preferred"))


# Alerts ---------------------------------------------------------------------------------------

SUBS = [("sub-001", "en", "", "", ""), ("sub-002", "", "src3", "patent", ""), ("sub-003", "", "", "", "the trash"), ("sub-004", "fr", "", "rd", ""), ("sub-005", "", "", "", "?!")]
SUB_VALUES = ", ".join("('" + "', '".join(s) + "')" for s in SUBS)
TITLED = "SELECT doc_id, lang, source, text, split_part(text, chr(10), 1) AS title, CASE lang WHEN 'en' THEN 'patent' WHEN 'fr' THEN 'publication' ELSE 'rd' END AS kind, row_number() OVER (PARTITION BY source || ':' || sha1(text) ORDER BY doc_id) AS k, source || ':' || sha1(text) AS key FROM documents"
ALERTS = f"""WITH s(sub_id, mineral, stage, skind, q) AS (VALUES {SUB_VALUES}), d AS ({TITLED})
SELECT sub_id, key AS record_id, title FROM d, s WHERE k = 1 AND (mineral = '' OR mineral = lang) AND (stage = '' OR stage = source) AND (skind = '' OR skind = kind)
AND (q = '' OR list_has_all(regexp_extract_all(lower(title || ' ' || text), '[a-z0-9]+'), regexp_extract_all(lower(q), '[a-z0-9]+')))"""


def alert_records(spark, sf):
    """Documents keyed by source and text, so that copies are one record."""
    return text_records(spark, sf).withColumn("source_url", F.concat_ws(":", F.col("tax_text"), F.sha1("abstract"))).withColumns({"ordinal": F.col("doc_id"), "doc_id": F.lit("")})


def subscriptions(spark):
    return spark.createDataFrame(SUBS, alerts.SUBSCRIPTION)


@query(ALERTS)
def alerts_batch(spark, sf):
    fired, _ = alerts.check(alert_records(spark, sf), subscriptions(spark), spark.createDataFrame([], alerts.SEEN), ["ordinal"], _scratch(spark, "values"))
    return fired


@query(f"{ALERTS} AND NOT (sub_id = 'sub-001' AND key IN (SELECT source || ':' || sha1(text) FROM documents WHERE source IN ('src0', 'src1')))")
def alerts_seeded(spark, sf):
    records = alert_records(spark, sf)
    seen = alerts.seeded("sub-001", records.where(F.array_contains("stage_ids", "src0") | F.array_contains("stage_ids", "src1")))
    fired, _ = alerts.check(records, subscriptions(spark), seen, ["ordinal"], _scratch(spark, "values"))
    return fired


@query(ALERTS)
def alerts_stream(spark, sf):
    """The same through a stream: a file source, state in tables, two runs of which the second has nothing new."""
    base = f"{_shared(spark)}/alerts-{uuid.uuid4().hex}"
    store = alerts.AlertTable(spark, base)
    subscriptions(spark).write.mode("overwrite").parquet(f"{base}/subscriptions/batch=0")
    documents = table(spark, sf, "documents")
    records = alert_records_of(spark.readStream.schema(documents.schema).parquet(f"{sf}/documents.parquet*"))
    for _ in range(2):
        store.stream(records, ["ordinal"]).awaitTermination()
    return store.alerts()


def alert_records_of(documents: DataFrame) -> DataFrame:
    kind = F.when(F.col("lang") == "en", "patent").when(F.col("lang") == "fr", "publication").otherwise("rd")
    return documents.select(
        F.lit("").alias("doc_id"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("ordinal"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("abstract"), kind.alias("kind"),
        F.array("lang").alias("mineral_ids"), F.array("source").alias("stage_ids"), F.concat_ws(":", F.col("source"), F.sha1("text")).alias("source_url"),
    )


@query()
def manifest_hash(spark, sf):
    """SHA-256 of every file of the tables, as a backup's manifest has it. Files have no SQL."""
    return jobs.backup_manifest(spark, sf)


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def _shared(spark: SparkSession) -> str:
    """The shared folder of the cluster; on one machine a temporary one where none is named."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return named.rstrip("/") if named else "file://" + tempfile.mkdtemp(prefix="corvane-")


from corvane import catalogue_formats, catalogue_jobs  # noqa: E402, F401  their queries join these
