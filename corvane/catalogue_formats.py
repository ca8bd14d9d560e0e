"""Queries that render the driver's tables into landed formats, reference data and stores, and read them back by the engine's operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.catalogue import _shared, query
from corvane.functions import ipc
from corvane.functions import text as t
from corvane.operators import analytics, buckets, corpus, export, graph, quality, resolve, search, sinks
from corvane.plans.driver_views import DRIVER_TAXONOMY, customer_records, kind_of_status, star_records, table
from corvane.plans.engine import Engine
from corvane.schemas import conform
from corvane.sources import journal, landed, readers
from corvane.sources.reference import Label, Taxonomy, alias_rows, baseline_rows, holdout_rows, tolerances
from corvane.streaming import alerts

ORDERS = "o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_orderpriority AS p, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice AS price FROM orders)"
FETCHED = "2025-01-02"


def orders(spark, sf) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"), day.alias("day"), F.col("o_totalprice").alias("price"))


def text(*parts) -> Column:
    """Strings and columns in a row; a string is itself."""
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


def pages_of(rows: DataFrame, key: str, block: Column, head: str = "", tail: str = "", gap: str = "\n") -> DataFrame:
    """(file, value): the blocks of rows(k) with one key in a row, in the order of k."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("k", block.alias("block")))), lambda x: x["block"])
    return rows.groupBy(F.col(key).cast("string").alias("file")).agg(F.concat(F.lit(head), F.array_join(listed, gap), F.lit(tail)).alias("value"))


def joined(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, "|") for c in columns})


def scratch(spark, name: str) -> str:
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


# Landed formats -----------------------------------------------------------------------


@query(f"""WITH {ORDERS}, r AS (SELECT *, 'IN' || (201800000 + k) || CASE WHEN k % 2 = 0 THEN 'A' ELSE 'B1' END AS number FROM o WHERE k % 50 <> 0)
SELECT number AS appl_no, CASE WHEN k % 7 = 0 THEN '' ELSE 'Order & ' || k || ' <x>' END AS title, p AS abstract, 'Customer ' || c AS applicants, CASE WHEN k % 3 = 0 THEN '' ELSE 'Person ' || (k % 9) END AS inventors,
'C22B 3/' || (k % 100) AS ipc_codes, CASE WHEN k % 5 = 0 THEN '' ELSE day END AS filing_date, 'https://patents.google.com/patent/' || number AS source_url, CASE WHEN k % 2 = 0 THEN 'Published' ELSE 'Granted' END AS legal_status,
'patent' AS kind, 'google_patents' AS source_id, '{FETCHED}' AS fetched_at FROM r""")
def read_patent_export(spark, sf):
    k, some = F.col("k"), lambda test, x: F.when(test, x)
    number = F.when(k % 50 == 0, "  ").otherwise(text(" in", k + 201800000, F.when(k % 2 == 0, " A").otherwise("B1 ")))
    number = F.when(k % 50 == 0, number).otherwise(F.regexp_replace(F.upper(number), r"(\d) A", "$1A"))
    rows = orders(spark, sf).select(
        k, number.alias("publication_number"), F.lit("IN").alias("country_code"),
        F.when(k % 7 == 0, F.array().cast("array<struct<text:string,language:string>>")).otherwise(F.array(F.struct(text("Order &amp;  ", k, " &lt;x&gt;").alias("text"), F.lit("en").alias("language")))).alias("title_localized"),
        F.array(F.struct(text(" ", F.col("p"), "  ").alias("text"), F.lit("en").alias("language"))).alias("abstract_localized"),
        F.array(*[F.struct(text("Customer ", F.col("c")).alias("name"))] * 2).alias("assignee"),
        some(k % 3 != 0, F.array(F.struct(text("Person  ", k % 9).alias("name")))).alias("inventor"),
        F.array(F.struct(text("C22B 3/", k % 100).alias("code")), F.struct(F.lit("").alias("code"))).alias("ipc"),
        some(k % 5 != 0, F.replace("day", F.lit("-"), F.lit("")).cast("long")).alias("filing_date"), F.lit(" Granted ").alias("legal_status"),
    )
    lines = rows.select("k", F.to_json(F.struct(*rows.columns[1:])).alias("raw"))
    read = lines.select(F.lit("orders").alias("file"), F.col("k").alias("line"), F.from_json("raw", readers.PATENT_EXPORT).alias("r")).select("file", "line", "r.*")
    out = readers.finish(readers.patent_export_records(read), "google_patents", "patent", fetched_at=FETCHED)
    return joined(out, "applicants", "inventors", "ipc_codes").select("appl_no", "title", "abstract", "applicants", "inventors", "ipc_codes", "filing_date", "source_url", "legal_status", "kind", "source_id", "fetched_at")


@query(f"""WITH {ORDERS} SELECT c::VARCHAR AS file, (row_number() OVER (PARTITION BY c ORDER BY k) - 1)::INT AS line, 'WO' || k AS appl_no, 'Order & ' || k AS title, CASE WHEN k % 4 = 0 THEN '' ELSE p END AS abstract,
CASE WHEN k % 6 = 0 THEN '' ELSE 'Customer ' || c END AS applicants, CASE WHEN k % 3 = 0 THEN '' ELSE 'C22B3/04' END AS ipc_codes, day AS filing_date, s AS legal_status, 'https://patentscope.wipo.int/search/en/detail.jsf?docId=WO' || k AS source_url FROM o""")
def read_patentscope(spark, sf):
    k = F.col("k")
    span = lambda name, c: text(f'<span class="{name}">', c, "</span>")
    block = text(
        '<div class="biblio" data-docid="WO', k, '">', span("title", text("Order  &amp; ", k)), F.when(k % 4 == 0, "").otherwise(span("abstract", text("\n ", F.col("p")))), span("applicant", F.when(k % 6 == 0, " ").otherwise(text("Customer ", F.col("c")))),
        span("ipc", F.when(k % 3 == 0, "none").otherwise("C22B3/04")), "\n", span("filing-date", F.replace("day", F.lit("-"), F.lit(""))), span("status", F.col("s")), "</div>",
    )
    out = readers.finish(readers.biblio_records(pages_of(orders(spark, sf), "c", block, "<html>\n", "")), "patentscope", "patent", fetched_at=FETCHED)
    return joined(out, "applicants", "ipc_codes").select("file", F.col("line").cast("int").alias("line"), "appl_no", "title", "abstract", "applicants", "ipc_codes", "filing_date", "legal_status", "source_url")


INSTITUTES = list(readers.LISTINGS.items())


LISTINGS_SQL = f"""WITH {ORDERS}, i(n, id, name) AS (VALUES {", ".join(f"({n}, '{s}', '{o}')" for n, (s, o) in enumerate(INSTITUTES))})
SELECT id AS source_id, name AS applicants, 'rd' AS kind, 'http://lab.example/' || k AS source_url, 'Plan "' || k || '"' AS title, p AS abstract, day AS filing_date FROM o JOIN i ON k % 4 = n"""


def cards(spark, sf, n: int) -> tuple[DataFrame, Column]:
    """A quarter of the orders, and the card of each on an institution's pages."""
    card = text('<div class="project"> <a href="http://lab.example/', F.col("k"), '">Plan &quot;', F.col("k"), '&quot;</a>\n<span class="date"> ', F.col("day"), '</span> <p class="desc">', F.col("p"), "\n</p> </div>")
    return orders(spark, sf).where(F.col("k") % 4 == n), card


def card_pages(spark, sf, n: int) -> DataFrame:
    """The cards as pages, one for each customer."""
    rows, card = cards(spark, sf, n)
    return pages_of(rows, "c", card)


def card_file(spark, sf, n: int, name: str) -> str:
    """A folder of files that the cards stand in one after another, as those of pages would, without a shuffle that made pages first."""
    rows, card = cards(spark, sf, n)
    return landed_file(spark, rows.select(card.alias("value")), name)


def landed_file(spark, pages: DataFrame, name: str) -> str:
    """A folder of files that pages(value) stand in one after another."""
    pages.select("value").write.text(path := scratch(spark, name))
    return path


@query(LISTINGS_SQL)
def landed_listings(spark, sf):
    """Cards of large files that are read by splits of 50,000 bytes, each institution as a format."""
    out = None
    for n, (source, _) in enumerate(INSTITUTES):
        part = landed.read(spark, source, card_file(spark, sf, n, source), 50_000, fetched_at=FETCHED)
        out = part if out is None else out.unionByName(part)
    return joined(out, "applicants").select("source_id", "applicants", "kind", "source_url", "title", "abstract", "filing_date")


@query(LISTINGS_SQL)
def landed_stream(spark, sf):
    """The same as streams: one batch job for each institution, all at once, run twice, of which the second has nothing to read."""
    places = {source: (card_file(spark, sf, n, source), scratch(spark, "stream")) for n, (source, _) in enumerate(INSTITUTES)}
    for _ in range(2):
        running = []
        for source, (path, base) in places.items():
            rows = joined(landed.stream(spark, source, path, 50_000, fetched_at=FETCHED), "applicants").select("source_id", "applicants", "kind", "source_url", "title", "abstract", "filing_date")
            running.append(rows.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
        for one in running:
            one.awaitTermination()
    out = None
    for _, base in places.values():
        part = spark.read.schema(rows.schema).parquet(f"{base}/out")
        out = part if out is None else out.unionByName(part)
    return out


@query(LISTINGS_SQL)
def read_listings(spark, sf):
    out = None
    for n, (source, organisation) in enumerate(INSTITUTES):
        part = readers.finish(readers.card_records(card_pages(spark, sf, n), organisation), source, "rd", fetched_at=FETCHED)
        out = part if out is None else out.unionByName(part)
    return joined(out, "applicants").select("source_id", "applicants", "kind", "source_url", "title", "abstract", "filing_date")


@query(f"""WITH {ORDERS} SELECT CASE WHEN k % 3 = 0 THEN 'W' || k ELSE 'http://doi.example/' || k END AS source_url, CASE WHEN k % 5 = 0 THEN '' ELSE 'Study ' || k END AS title, CASE WHEN k % 4 = 0 THEN '' ELSE 'Institute ' || (k % 7) || '|Institute x' END AS applicants,
day AS filing_date, 'publication' AS kind FROM o""")
def read_works(spark, sf):
    k = F.col("k")
    place = lambda *names: F.array(*[F.struct(n.alias("display_name")) for n in names])
    own = F.array(F.struct(place(text("Institute ", k % 7), F.lit("Institute x")).alias("institutions")), F.struct(place(F.lit("Institute  x")).alias("institutions")))
    work = F.struct(
        text("W", k).alias("id"), F.when(k % 5 != 0, text("Study ", k)).alias("title"), F.col("day").alias("publication_date"), F.when(k % 3 != 0, F.struct(text("http://doi.example/", k).alias("landing_page_url"))).alias("primary_location"),
        F.when(k % 4 != 0, own).otherwise(F.array().cast("array<struct<institutions:array<struct<display_name:string>>>>")).alias("authorships"),
    )
    pages = pages_of(orders(spark, sf), "c", F.to_json(work), '{"results": [', "]}", ", ")
    return joined(readers.finish(readers.work_records(pages), "openalex", "publication", fetched_at=FETCHED), "applicants").select("source_url", "title", "applicants", "filing_date", "kind")


JOURNALS = "j AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS m, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer), v AS (SELECT *, (k % 52 + 1) || '/' || (2000 + k % 30) AS no FROM j WHERE k % 10 <> 0)"


def listing_pages(spark, sf):
    k, m = F.col("k"), F.col("m")
    form = lambda label, name: text('<form method="post" action="/IPOJournal/Journal/ViewJournal"><input type="hidden" name="FileName" value="', name, '" /><button type="submit"> ', label, "</button></form>")
    number = F.when(k % 10 == 0, "total").otherwise(text(" ", k % 52 + 1, "/", k % 30 + 2000))
    row = text("<tr><td>", k, "</td><td>", number, "</td><td> 18/09/2026</td><td>x</td><td>\n", form("Part <b>I</b>", text("a&amp;", k)), F.when(k % 3 == 0, "").otherwise(form(text("Part II ", m), text("b", k))), form("Part II - Designs", text("c", k)), "</td></tr>")
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("m"))
    return pages_of(rows, "n", row, "<table><tr><th>No.</th></tr>\n", "</table>")


@query(f"""WITH {JOURNALS} SELECT r::INT AS row, no AS journal_no, '18/09/2026' AS published, 'Part I' || CASE WHEN k % 3 = 0 THEN '' ELSE '|Part II ' || m END || '|Part II - Designs' AS labels,
'a&' || k || CASE WHEN k % 3 = 0 THEN '' ELSE '|b' || k END || '|c' || k AS files FROM v""")
def journal_listing(spark, sf):
    out = journal.journals(listing_pages(spark, sf))
    return out.select("row", "journal_no", "published", F.array_join("parts.label", "|").alias("labels"), F.array_join("parts.file_name", "|").alias("files"))


@query(f"""WITH {JOURNALS} SELECT no AS journal_no, 'Part I' AS label, 'a&' || k AS file_name, replace(no, '/', '-') || '_Part-I' AS slug FROM v WHERE k % 30 >= 20
UNION ALL SELECT no, 'Part II ' || m, 'b' || k, replace(no, '/', '-') || '_Part-II-' || m FROM v WHERE k % 30 >= 20 AND k % 3 <> 0""")
def journal_parts(spark, sf):
    return journal.application_parts(journal.select_journals(journal.journals(listing_pages(spark, sf)), since=2020))


@query(f"WITH {JOURNALS}, f AS (SELECT 'a&' || k AS f FROM v UNION SELECT 'b' || k FROM v WHERE k % 3 <> 0 UNION SELECT 'c' || k FROM v) SELECT f AS file_name FROM f")
def journal_allowed_files(spark, sf):
    return journal.allowed_files(journal.journals(listing_pages(spark, sf)))


def journal_texts(spark, sf):
    """Orders as blocks of journal parts, a part for each customer, with page feet, run-together columns, torn codes, and lines torn between a field's code, label, colon and value."""
    k = F.col("k")
    day = F.concat_ws("/", F.substring("day", 9, 2), F.substring("day", 6, 2), F.substring("day", 1, 4))
    torn = lambda rest, gap="": F.when(k % 11 == rest, "\n").otherwise(gap)  # noqa: E731  each place in one of eleven records
    block = text(
        "(12)", torn(0, " "), "PATENT APPLICATION PUBLICATION (21)", torn(1, " "), "Application No.", torn(2), k + 202600000000, F.when(k % 3 == 0, text(torn(3, " "), "B")).otherwise(""), "\n(19) INDIA\n(22) Date of filing of Application", torn(4, " "), ":", torn(5), day,
        " (43)", torn(4, " "), "Publication Date :", torn(5, " "), "18/09/2026\n(54)", torn(6, " "), "Title of the invention", torn(7, " "), ":", torn(8, " "),
        F.when(k % 5 == 0, "RECOVERY OF LITHIUM").otherwise("A CHAIR"), "\nNUMBER ", k, F.when(k % 2 == 0, "\n \t\n").otherwise("\n"), "(51) International\n:C22B\n", k % 90 + 1, "/12, 1)", text("Late ", k % 4), "\n:C01D15/08\n:H01M0010052500\n(71)Name of Applicant :\n1)Customer ", F.col("c"),
        " Ltd\nAddress of Applicant :12, Some Road, 9)not a name\nB09B 3/00,\n(72)Name of Inventor :\n1)First ", k % 7, "\n:01/01/1900 2)Second   Person\n(57)", torn(9, " "), "Abstract", torn(10, " "), ":\nA method of ", F.col("p"),
        ".\n", F.when(k % 4 == 0, "").otherwise(text("No. of", torn(6, " "), "Pages : ", k % 60, F.when(k % 8 == 1, "").otherwise(text(torn(7, " "), "No. of Claims : ", k % 20)))), "\nThe Patent Office Journal No.", torn(8, " "), "38/2026 Dated", torn(9, " "), "18/09/2026", torn(10, " "), "101\n\f",
    )
    parts = pages_of(orders(spark, sf), "c", block, "front (12) none\n", "(12) PATENT APPLICATION PUBLICATION without a number", "")
    return parts.withColumns({"journal_no": F.lit("38/2026"), "journal_part": F.lit("Part I")})


JOURNAL_SQL = f"""WITH {ORDERS}, r AS (SELECT c::VARCHAR AS file, row_number() OVER (PARTITION BY c ORDER BY k)::INT AS line, (202600000000 + k)::VARCHAR AS appl_no, CASE WHEN k % 3 = 0 THEN 'B' ELSE 'A' END AS kind_code,
CASE WHEN k % 5 = 0 THEN 'RECOVERY OF LITHIUM' ELSE 'A CHAIR' END || ' NUMBER ' || k AS title, 'A method of ' || p || '.' AS abstract, 'Customer ' || c || ' Ltd' AS applicants, 'First ' || (k % 7) || '|Second Person' AS inventors,
'C22B ' || (k % 90 + 1) || '/12|C01D 15/08|H01M 10/0525|B09B 3/00' AS ipc_codes, day AS filing_date, '2026-09-18' AS publication_date, CASE WHEN k % 4 = 0 OR k % 8 = 1 THEN NULL ELSE (k % 60)::INT END AS pages, CASE WHEN k % 4 = 0 OR k % 8 = 1 THEN NULL ELSE (k % 20)::INT END AS claims,
'https://search.ipindia.gov.in/IPOJournal/Journal/Patent#38/2026/Part-I/' || (202600000000 + k) AS source_url, k FROM o)"""


@query(f"{JOURNAL_SQL} SELECT * EXCLUDE (k) FROM r")
def journal_records(spark, sf):
    out = journal.journal_records(journal_texts(spark, sf))
    # Codes end at the applicants' section; the torn line of an address there is no code of the record's.
    out = out.withColumn("ipc_codes", F.filter("ipc_codes", lambda x: x.isNotNull()))
    return joined(out, "applicants", "inventors", "ipc_codes").select("file", F.col("line").cast("int").alias("line"), "appl_no", "kind_code", "title", "abstract", "applicants", "inventors", "ipc_codes", "filing_date", "publication_date", "pages", "claims", "source_url")


@query(f"{JOURNAL_SQL} SELECT * EXCLUDE (k, file, line) FROM r")
def landed_journal(spark, sf):
    """The same texts one after another in large files, read by splits of 50,000 bytes that records, marks and page feet are torn by."""
    path = landed_file(spark, journal_texts(spark, sf), "journal")
    out = landed.read(spark, "journal", path, 50_000, journal_no="38/2026", journal_part="Part I")
    return joined(out, "applicants", "inventors", "ipc_codes").select("appl_no", "kind_code", "title", "abstract", "applicants", "inventors", "ipc_codes", "filing_date", "publication_date", "pages", "claims", "source_url")


@query(f"{JOURNAL_SQL} SELECT appl_no, CASE WHEN k % 5 = 0 THEN 'lithium' ELSE '' END AS keywords, 'C01D|C22B|H01M' AS ipc FROM r WHERE k % 8 <> 0")
def journal_candidates(spark, sf):
    """Parsed records are written once, as the archive has them, and the recall rule reads that."""
    journal.journal_records(journal_texts(spark, sf)).write.parquet(path := scratch(spark, "journal"))
    found = journal.candidates(spark.read.parquet(path))
    stored = found.where(F.col("appl_no").cast("long") % 8 == 0)
    return journal.new_candidates(found, stored).select("appl_no", F.array_join("candidate_reason.keywords", "|").alias("keywords"), F.array_join("candidate_reason.ipc", "|").alias("ipc"))


# Text rules ------------------------------------------------------------------------------


@query("""SELECT p_partkey, 'H01M ' || (p_partkey % 9000 + 1) || '/' || CASE WHEN p_size % 10 = 0 THEN lpad((p_size // 10)::VARCHAR, 1, '0') || '0' ELSE p_size::VARCHAR || CASE WHEN p_size < 10 THEN '0' ELSE '' END END AS long_code,
'C01D ' || (p_partkey % 400 + 1) || '/' || lpad((p_size % 100)::VARCHAR, 2, '0') AS compact_code, p_partkey % 2 = 0 AS only_codes FROM part""")
def ipc_codes(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_size")
    long = text(":H01M", F.lpad((k % 9000 + 1).cast("string"), 4, "0"), F.rpad(n.cast("string"), 6, "0"))
    compact = text(":C01D", k % 400 + 1, "/", F.lpad((n % 100).cast("string"), 2, "0"))
    line = text(" C22B 3/04, ", F.when(k % 2 == 0, "").otherwise("1)Name"))
    rows = table(spark, sf, "part").select("p_partkey", ipc.ipc_codes(text("A61K\n", compact, " 7/00 ", long)).alias("codes"), ipc.only_codes(line).alias("only_codes"))
    return rows.where((F.size("codes") == 3) & (F.get("codes", F.lit(0)) == "A61K")).select("p_partkey", F.get("codes", F.lit(2)).alias("long_code"), F.get("codes", F.lit(1)).alias("compact_code"), "only_codes")


@query(r"""SELECT c_custkey, upper('in' || c_custkey || 'b') AS number, lower(c_mktsegment) || ' ' || c_custkey || ' co' AS form, '12-2026_Part-' || c_custkey AS slug, c_mktsegment || ' x' AS stripped,
CASE WHEN c_custkey % 2 = 0 THEN '2026-09-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') ELSE '' END AS iso, lower(c_mktsegment) || '|' || c_custkey AS tokens, c_nationkey || '|b' AS listed, CASE WHEN c_custkey % 3 = 0 THEN 'fig' ELSE '' END AS word FROM customer""")
def text_rules(spark, sf):
    k, m = F.col("c_custkey"), F.col("c_mktsegment")
    day = text(F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.when(k % 2 == 0, "/").otherwise("-"), "09/2026")
    said = F.lower(F.when(k % 3 == 0, "the fig, ripe").otherwise("figs and configured"))
    return table(spark, sf, "customer").select(
        "c_custkey", t.application_number(text(" in ", k, " b")).alias("number"), t.org_form(text(m, "-", k, ", & Co.")).alias("form"), t.file_slug(F.lit("12/2026"), text(" Part (", k, ")")).alias("slug"), t.strip_tags(text("<td>", m, "<br/>&#120;</td>")).alias("stripped"),
        t.day_first_date(day).alias("iso"), F.array_join(t.tokens(text(m, " -- ", k)), "|").alias("tokens"), F.array_join(t.clean_list(F.array(text(" ", F.col("c_nationkey")), F.lit(" b "), F.lit(""), F.lit("b"))), "|").alias("listed"),
        F.regexp_extract(said, f"({t.whole_word('fig')})", 1).alias("word"),
    )


@query("SELECT o_orderkey, printf('%.2f', o_totalprice * 100000000 / (1024.0 * 1024 * 1024)::DOUBLE) || ' GB' AS size FROM orders")
def human_size(spark, sf):
    size = F.col("o_totalprice") * 100000000
    return table(spark, sf, "orders").select("o_orderkey", t.human_size(size).alias("size"))


# Reference data and quality ---------------------------------------------------------------------


def gold_rows(spark, sf):
    k, p = F.col("k"), F.col("p")
    other = F.when(k % 4 == 0, "1-URGENT").otherwise(p)
    return orders(spark, sf).select(k.cast("string").alias("fixture_id"), F.array(p).alias("mineral_ids"), F.array("s").alias("stage_ids"), F.array(other).alias("pred_mineral_ids"), F.when(k % 7 == 0, F.array(F.lit("F"), F.lit("O"))).otherwise(F.array("s")).alias("pred_stage_ids"))


@query(f"""WITH {ORDERS}, r AS (SELECT 'mineral' AS task, k, [p] AS g, [CASE WHEN k % 4 = 0 THEN '1-URGENT' ELSE p END] AS q FROM o UNION ALL SELECT 'stage', k, [s], CASE WHEN k % 7 = 0 THEN ['F', 'O'] ELSE [s] END FROM o),
u AS (SELECT DISTINCT task, unnest(g) AS label FROM r), l AS (SELECT task, label, count(*) FILTER (list_contains(g, label) AND list_contains(q, label)) AS tp, count(*) FILTER (list_contains(g, label) <> list_contains(q, label)) AS bad FROM u JOIN r USING (task) GROUP BY ALL),
m AS (SELECT task, round(avg(2.0::DOUBLE * tp / (2 * tp + bad)), 4) AS macro_f1, count(*) AS labels_scored FROM l GROUP BY task),
a AS (SELECT task, count(*)::BIGINT AS n, round(avg((list_sort(g) = list_sort(q))::INT::DOUBLE), 4) AS subset_accuracy FROM r GROUP BY task)
SELECT task, n, subset_accuracy, macro_f1, labels_scored::BIGINT AS labels_scored, 0::BIGINT AS labels_unexercised, CASE WHEN n < 100 THEN 'PROVISIONAL' WHEN (SELECT bool_and(subset_accuracy >= 0.85 AND macro_f1 >= 0.75) FROM a JOIN m USING (task)) THEN 'PASS' ELSE 'FAIL' END AS gate, n < 100 AS provisional FROM a JOIN m USING (task)""")
def holdout_evaluation(spark, sf):
    rows = gold_rows(spark, sf)
    return quality.evaluate_holdout(rows.select("fixture_id", "pred_mineral_ids", "pred_stage_ids"), rows.select(F.col("fixture_id").alias("id"), "mineral_ids", "stage_ids"), rows.select("mineral_ids", "stage_ids"))


@query("SELECT count(*)::BIGINT AS variants, count(*)::BIGINT AS merged, 1.0::DOUBLE AS rate FROM (SELECT DISTINCT upper(s_name) || '.' AS v FROM supplier WHERE upper(s_name) || '.' <> s_name)")
def merge_rate(spark, sf):
    names = table(spark, sf, "supplier").select(F.col("s_name").alias("canonical"))
    return resolve.merge_rate(names.withColumn("variant", text(F.upper("canonical"), ".")).unionByName(names.withColumn("variant", F.col("canonical"))))


@query("SELECT lower(regexp_replace(s_name, '[.,()\"''&/\\\\-]', ' ', 'g')) AS norm, s_name AS canonical FROM supplier")
def merge_report(spark, sf):
    return resolve.merge_report(table(spark, sf, "supplier").select(F.col("s_name").alias("canonical"), F.col("s_name").alias("variant")))


@query("""SELECT k::VARCHAR AS path, CASE WHEN k % 5 = 0 THEN 'missing' WHEN k % 5 = 1 THEN 'changed' ELSE 'new' END AS status FROM (SELECT o_orderkey AS k FROM orders) WHERE k % 5 < 3""")
def manifest_difference(spark, sf):
    rows = orders(spark, sf).select(F.col("k"), F.col("k").cast("string").alias("path"), F.sha2(F.col("p"), 256).alias("sha256"))
    was = rows.where("k % 5 <> 2").select("path", "sha256")
    now = rows.where("k % 5 <> 0").select("path", F.when(F.col("k") % 5 == 1, F.sha2(F.lit("other"), 256)).otherwise(F.col("sha256")).alias("sha256"))
    return quality.manifest_difference(was, now)


PATHS = ("data/x{0}", "data/ipo_cache/{0}", "a{0}.tgz", "a{0}.tgz.manifest.json", "b.verify/{0}", "data/ipo_cached{0}", "dir{0}.verify")


@query("SELECT o_orderkey, o_orderkey % 7 IN (0, 5) AS kept, o_totalprice >= 2000 AND o_orderkey % 10 >= 8 AND o_orderkey % 9 >= 6 AS good, o_orderkey % 100 >= 85 AND o_orderkey % 99 >= 75 AS passes FROM orders")
def gates(spark, sf):
    k = F.col("k")
    path = F.lit("")
    for i, p in enumerate(PATHS):
        path = F.when(k % 7 == i, text(*p.split("{0}")[:1], k, p.split("{0}")[1])).otherwise(path)
    verdict = quality.verdict(F.col("price"), (k % 10) / 10, (k % 9) / 10)
    return orders(spark, sf).select(k.alias("o_orderkey"), quality.backed_up(path).alias("kept"), (verdict == "PASS").alias("good"), quality.passes((k % 100) / 100, (k % 99) / 100).alias("passes"))


@query("""SELECT n_name || CASE WHEN n_nationkey % 2 = 0 THEN '_ms_avg' ELSE '' END AS metric, n_nationkey::DOUBLE AS value, CASE WHEN n_nationkey % 2 = 0 THEN 'speed' ELSE 'quality' END AS kind, 1.5::DOUBLE AS pp, 20.0::DOUBLE AS pct FROM nation""")
def baseline_round_trip(spark, sf):
    """Metrics recorded as a baseline, its document read back with its tolerances."""
    now = table(spark, sf, "nation").select(F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, "_ms_avg").otherwise("")).alias("metric"), F.col("n_nationkey").cast("double").alias("value"))
    doc = {"tolerance": {"quality_pp": 1.5}, "metrics": {r["metric"]: {"value": r["value"], "kind": r["kind"]} for r in quality.recorded_baseline(now).collect()}}
    pp, pct = tolerances(doc)
    return baseline_rows(spark, doc).withColumns({"pp": F.lit(pp), "pct": F.lit(pct)})


@query(f"""WITH {ORDERS} SELECT count(*) FILTER (s = 'F')::BIGINT AS patents, count(*) FILTER (s <> 'F')::BIGINT AS others, count(*)::BIGINT AS n, count(DISTINCT k)::BIGINT AS ids, count(*) FILTER (k % 50 = 0)::BIGINT AS unsourced,
count(*) FILTER (s = 'F') >= 8 AND count(*) FILTER (s <> 'F') >= 4 AND count(*) FILTER (k % 50 = 0) = 0 AS ok FROM o""")
def fixture_report(spark, sf):
    rows = orders(spark, sf).select(F.when(F.col("s") == "F", "patent").otherwise("rd").alias("kind"), F.when(F.col("k") % 50 == 0, "ftp://x").otherwise("http://x").alias("source_url"), F.lit(FETCHED).alias("fetched_at"), F.col("p").alias("title"), F.col("k").alias("fixture_id"))
    return quality.fixture_report(rows)


@query("""WITH s AS (SELECT r_name FROM region WHERE r_regionkey < 4), f AS (SELECT n_name, n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT 'family ' || n_name || ' has an unknown stage ' || r_name AS fault FROM f WHERE r_name NOT IN (SELECT r_name FROM s) UNION ALL SELECT 'family ' || n_name || ' has no subdomains' FROM f WHERE n_nationkey % 3 = 0
UNION ALL SELECT (SELECT count(*) FROM s) || ' stages, not 6' UNION ALL SELECT 'pilot minerals are missing: [''CO'', ''NI'']'""")
def taxonomy_faults(spark, sf):
    regions = {r["r_regionkey"]: r["r_name"] for r in table(spark, sf, "region").collect()}
    nations = table(spark, sf, "nation").orderBy("n_nationkey").collect()
    families = [Label(n["n_name"], parent=regions[n["n_regionkey"]]) for n in nations]
    own = Taxonomy([Label(m) for m in ("LI", "REE", "GRA")], [Label(r) for k, r in regions.items() if k < 4], families, subdomains={n["n_name"]: ["x"] for n in nations if n["n_nationkey"] % 3})
    return spark.createDataFrame([(f,) for f in quality.taxonomy_faults(own)], "fault string")


@query(f"WITH {ORDERS}, r AS (SELECT p AS source_id, round(sum(CASE WHEN k % 9 = 0 THEN 2 ELSE 3 END)::DOUBLE / sum(3), 4) AS completeness FROM o WHERE s <> 'F' GROUP BY p) SELECT * FROM r WHERE completeness < 0.963")
def incomplete_sources(spark, sf):
    rows = orders(spark, sf).where("s <> 'F'").select(F.col("p").alias("source_id"), F.col("k").cast("string").alias("source_url"), F.when(F.col("k") % 9 == 0, "").otherwise("t").alias("title"), F.lit("rd").alias("kind"), F.array("s").alias("applicants"), F.lit("").alias("filing_date"), F.lit(FETCHED).alias("fetched_at"))
    return quality.incomplete_sources(quality.pipeline_stats(rows, rows), 0.963).select("source_id", "completeness")


# The corpus, the graph, collaborations ---------------------------------------------------------------


@query("""WITH d AS (SELECT doc_id, lower(text || ' ') AS x, source, lang FROM documents) SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END AS stages, CASE lang WHEN 'en' THEN 'first' ELSE 'M9' END || CASE WHEN doc_id % 3 = 0 THEN ' ' || lang ELSE '' END AS tax_text,
CASE WHEN doc_id % 4 = 0 THEN '' ELSE coalesce(lower(nullif(source, '')), 'unknown') END AS orgs FROM d""")
def corpus_enriched(spark, sf):
    """Records whose labels are given: what is said stays, an empty list too; names are looked up, ids without one stand for themselves."""
    k = F.col("doc_id")
    empty = F.array().cast("array<string>")
    rows = table(spark, sf, "documents").select(
        k.cast("string").alias("doc_id"), F.lit(0).alias("tier"), F.lit("f").alias("file"), k.alias("line"), F.lit("").alias("title"), F.col("text").alias("abstract"), F.when(k % 4 == 0, F.array(F.lit(""))).otherwise(F.array(F.upper("source"), F.col("source"))).alias("applicants"),
        F.array(F.when(F.col("lang") == "en", "M1").otherwise("M9")).alias("mineral_ids"), F.when(k % 3 == 0, F.array("lang")).otherwise(empty).alias("stage_ids"), empty.alias("process_family_ids"),
    )
    out = corpus.enriched(rows, DRIVER_TAXONOMY, resolve.alias_index(alias_rows(spark, {"nobody": ["no body"]})))
    return out.select("doc_id", F.array_join("stage_ids", "|").alias("stages"), "tax_text", F.array_join("orgs", "|").alias("orgs"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'f' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'a' || o_orderkey ELSE 'u' || o_orderkey END AS rec_key FROM orders""")
def record_keys(spark, sf):
    k = F.col("k")
    rows = orders(spark, sf).select(k.alias("o_orderkey"), F.when(k % 3 == 0, text("f", k)).otherwise("").alias("fixture_id"), F.when(k % 3 < 2, text("a", k)).alias("appl_no"), text("u", k).alias("source_url"))
    return graph.with_record_key(rows).select("o_orderkey", "rec_key")


STAR = """lines AS (SELECT l_orderkey, p_type, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
rec AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'patent' WHEN 'O' THEN 'rd' WHEN 'P' THEN 'publication' END AS kind, o_orderpriority AS stage FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lines)),
mineral AS (SELECT DISTINCT l_orderkey AS o_orderkey, p_type AS mineral FROM lines)"""


@query(f"""WITH {STAR}, who AS (SELECT o_orderkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey SEMI JOIN rec USING (o_orderkey)),
o AS (SELECT o_orderkey, n_name AS org FROM who UNION ALL SELECT o_orderkey, r_name FROM who), act AS (SELECT DISTINCT org, mineral, stage FROM o JOIN mineral USING (o_orderkey) JOIN rec USING (o_orderkey)),
filed AS (SELECT DISTINCT least(n_name, r_name) AS a, greatest(n_name, r_name) AS b FROM who)
SELECT a.org AS org_a, b.org AS org_b, string_agg(a.mineral || '/' || a.stage, '|' ORDER BY a.mineral, a.stage) AS shared FROM act a JOIN act b ON a.mineral = b.mineral AND a.stage = b.stage AND a.org < b.org ANTI JOIN filed f ON f.a = a.org AND f.b = b.org GROUP BY ALL""")
def collaboration_pairs(spark, sf):
    out = analytics.collaboration_pairs(customer_records(spark, sf))
    return out.select("org_a", "org_b", F.array_join(F.transform("shared", lambda x: F.concat_ws("/", x["mineral"], x["stage"])), "|").alias("shared"))


# Alerts' state, stores ----------------------------------------------------------------------------------


@query("""WITH s(sub_id) AS (VALUES ('sub-001'), ('sub-002')) SELECT sub_id, 'c' || c_custkey AS record_key FROM customer, s WHERE c_custkey % 2 = 0 UNION SELECT 'sub-001', 'c' || c_custkey FROM customer WHERE c_custkey % 3 = 0""")
def folded_state(spark, sf):
    """Seeds of one subscription and legacy keys of all, kept as intervals and listed in full."""
    keys = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), text("c", F.col("c_custkey")).alias("doc_id"), F.lit("").alias("source_url"))
    store = alerts.AlertTable(spark, scratch(spark, "alerts"))
    store.subscribe("LI", corpus=keys.where("k % 3 = 0"))
    store.subscribe(q="x")
    legacy = keys.where("k % 2 = 0").select(F.col("doc_id").alias("record_key"))
    store.fold(legacy.unionByName(legacy))
    return store.seen()


def stored_rows(spark, sf):
    k = F.col("k")
    rows = orders(spark, sf).select(F.col("p").alias("source_id"), text("http://x/", k % 5000).alias("source_url"), kind_of(F.col("s")).alias("kind"), text("Title ", k, ' "é"').alias("title"), F.array(text("c", F.col("c"))).alias("applicants"), F.lit("f").alias("file"), k.alias("line"), F.lit("7/2026").alias("journal_no"), F.col("s").alias("journal_part"))
    return conform(rows)


def kind_of(status: Column) -> Column:
    return F.when(status == "F", "patent").when(status == "O", "rd").when(status == "P", "publication")


STORED = "r AS (SELECT o_orderpriority AS source_id, 'http://x/' || (o_orderkey % 5000) AS source_url, 'Title ' || o_orderkey || ' \"é\"' AS title, 'c' || o_custkey AS applicants, o_orderkey AS k, o_orderstatus AS part FROM orders)"


@query(f"WITH {STORED} SELECT source_id, source_url, title, applicants FROM r")
def store_round_trip(spark, sf):
    sinks.write_store(stored_rows(spark, sf), path := scratch(spark, "store"))
    return joined(readers.records_jsonl(spark, f"{path}/part-*"), "applicants").select("source_id", "source_url", "title", "applicants")


@query(f"WITH {STORED} SELECT source_url, title FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY k) AS n FROM r) WHERE n = 1")
def candidate_store(spark, sf):
    """Candidates appended twice: the first of each address, once."""
    path, rows = scratch(spark, "candidates"), stored_rows(spark, sf)
    for _ in range(2):
        sinks.append_candidates(rows, readers.records_jsonl(spark, f"{path}/part-*"), path)
    return readers.records_jsonl(spark, f"{path}/part-*").select("source_url", "title")


@query(f"WITH {STORED} SELECT source_url, title FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY k) AS n FROM r) WHERE n = 1")
def candidate_buckets(spark, sf):
    """Candidates by address in hash buckets, added in two halves and once more."""
    store, rows = buckets.BucketStore(spark, scratch(spark, "buckets"), "source_url", ["file", "line"], 16), stored_rows(spark, sf).select("source_url", "title", "file", "line")
    for part in (rows.where("line % 2 = 1"), rows.where("line % 2 = 0"), rows):
        store.add(part)
    return store.rows().select("source_url", "title")


@query(f"WITH {STORED} SELECT part AS journal_part, count(*)::BIGINT AS n FROM r WHERE part <> 'F' OR k % 2 = 0 GROUP BY part")
def archive_round_trip(spark, sf):
    """A part that is written again replaces itself alone."""
    path, rows = scratch(spark, "archive"), stored_rows(spark, sf)
    sinks.write_archive(rows, path)
    sinks.write_archive(rows.where("journal_part = 'F' and line % 2 = 0"), path)
    return spark.read.json(path).groupBy("journal_part").agg(F.count("*").alias("n"))


#: Words for titles and abstracts: those that an export of critical minerals takes, and some that it passes over.
TAKEN = ("Lithium", "spodumene", "BRINE", "rare earth", "neodymium", "Praseodymium", "dysprosium", "monazite", "graphite", "graphene", "cobalt", "Nickel", "laterite")
PASSED = ("lepidolite", "petalite", "rare-earth", "cerium", "copper", "chair")
SAID = f"[{', '.join(repr(w) for w in TAKEN + PASSED)}]"


@query(f"""WITH w AS (SELECT *, {SAID} AS words, strftime(o_orderdate, '%Y%m%d') AS day FROM orders), s AS (SELECT *, words[o_orderkey % {len(TAKEN + PASSED)} + 1] AS word FROM w)
SELECT o_orderkey AS doc_id, day AS publication_date, CASE WHEN o_orderkey % 3 = 0 THEN 'A ' || word ELSE 'Title ' || o_orderkey END AS title, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'of ' || word || 's' END AS abstract, 'Customer ' || o_custkey AS assignees
FROM s WHERE o_orderkey % 2 = 0 AND o_orderkey % {len(TAKEN + PASSED)} < {len(TAKEN)} AND day::INT >= 19950101""")
def export_selection(spark, sf):
    """Every term of the export's filter, in titles and abstracts, in any case, beside words that it passes over."""
    k = F.col("k")
    item = lambda c, lang: F.struct(c.alias("text"), (F.lit(lang) if isinstance(lang, str) else lang).alias("language"))
    word = F.element_at(F.array(*map(F.lit, TAKEN + PASSED)), (k % len(TAKEN + PASSED) + 1).cast("int"))
    rows = orders(spark, sf).select(
        k.cast("string").alias("publication_number"), F.when(k % 2 == 0, "IN").otherwise("US").alias("country_code"), F.replace("day", F.lit("-"), F.lit("")).cast("long").alias("publication_date"),
        F.array(item(F.lit("Kobalt, cobalt"), "de"), item(F.when(k % 3 == 0, text("A ", word)).otherwise(text("Title ", k)), "en")).alias("title_localized"), F.array(item(text("of ", word, "s"), F.when(k % 3 == 0, "de").otherwise("en"))).alias("abstract_localized"),
        F.array(F.struct(text("Customer ", F.col("c")).alias("name"))).alias("assignee_harmonized"), F.array(F.struct(F.lit("x").alias("name"))).alias("inventor_harmonized"), F.array(F.struct(F.lit("C22B").alias("code"))).alias("ipc"),
    )
    out = joined(export.export(rows, since=19950101), "assignees")
    return out.select(F.col("publication_number").cast("long").alias("doc_id"), F.col("publication_date").cast("string").alias("publication_date"), "title", "abstract", "assignees")


# The facade -------------------------------------------------------------------------------------------------


def engine_of(spark, sf) -> Engine:
    """The facade over orders as records, the priority as their applicant."""
    empty = F.array().cast("array<string>")
    rows = star_records(spark, sf).select(
        "doc_id", "title", F.lit("abstract").alias("abstract"), "kind", "mineral_ids", "stage_ids", empty.alias("process_family_ids"), F.array(F.get("stage_ids", F.lit(0))).alias("applicants"), F.array(F.lower(F.get("stage_ids", F.lit(0)))).alias("orgs"),
        "filing_date", F.lit("x").alias("legal_status"), F.lit("orders").alias("source_id"), F.col("doc_id").alias("source_url"), F.lit("").alias("tax_text"), F.lit(0).alias("tier"), F.lit("f").alias("file"), F.col("o_orderkey").alias("line"), F.lit(None).cast("string").alias("fixture_id"), F.lit(None).cast("string").alias("appl_no"),
    )
    return Engine(spark, DRIVER_TAXONOMY, alias_rows(spark, {"nobody": ["no body"]}), rows)


ENGINE = f"WITH {STAR}, m AS (SELECT o_orderkey AS k, mineral FROM mineral), e AS (SELECT o_orderkey AS k, kind, stage, (SELECT min(mineral) FROM mineral x WHERE x.o_orderkey = rec.o_orderkey) AS mineral FROM rec), em AS (SELECT k, kind, stage, m.mineral FROM e JOIN m USING (k))"


@query(f"""{ENGINE} SELECT 'health' AS part, 'records' AS key, count(*)::BIGINT AS n FROM e UNION ALL SELECT 'totals', 'total', count(*) FROM e UNION ALL SELECT 'totals', x, (SELECT count(*) FROM e WHERE kind = x) FROM (VALUES ('patent'), ('rd'), ('publication')) v(x)
UNION ALL SELECT 'by_mineral', mineral, count(*) FROM m GROUP BY mineral UNION ALL SELECT 'by_stage', stage, count(*) FROM e GROUP BY stage UNION ALL SELECT 'top_orgs', lower(stage), count(*) FROM e GROUP BY stage
UNION ALL SELECT 'heatmap', x.mineral || '/' || s.stage, (SELECT count(*) FROM em WHERE em.mineral = x.mineral AND em.stage = s.stage) FROM (SELECT DISTINCT mineral FROM m) x, (SELECT DISTINCT stage FROM e) s
UNION ALL SELECT 'graph', 'nodes', (SELECT count(*) + count(DISTINCT stage) * 2 FROM e) + (SELECT count(DISTINCT mineral) FROM m) UNION ALL SELECT 'graph', 'edges', (SELECT 2 * count(*) FROM e) + (SELECT count(*) FROM m)""")
def engine_dashboard(spark, sf):
    """health, summary, heatmap and graph of the facade, as (part, key, n)."""
    engine = engine_of(spark, sf).cache()
    s = engine.summary()
    wide = s["totals"]
    parts = [wide.select(F.lit("totals").alias("part"), F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("n")) for c in wide.columns])).alias("x")).select("part", "x.*")]
    parts += [s[name].select(F.lit(name).alias("part"), F.col(column).alias("key"), "n") for name, column in (("by_mineral", "mineral"), ("by_stage", "stage"), ("top_orgs", "org"))]
    parts += [engine.heatmap().select(F.lit("heatmap").alias("part"), F.concat_ws("/", "mineral", "stage").alias("key"), "n")]
    nodes, edges = engine.graph()
    counts = [("health", "records", engine.health()["records"]), ("graph", "nodes", nodes.count()), ("graph", "edges", edges.count())]
    out = spark.createDataFrame(counts, "part string, key string, n long")
    for p in parts:
        out = out.unionByName(p)
    return out


@query(f"""{ENGINE}, h AS (SELECT k::VARCHAR AS doc_id, (3 + CASE WHEN stage LIKE '%URGENT%' THEN 2 ELSE 0 END)::DOUBLE AS score FROM e WHERE kind = 'rd'), t AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM h)
SELECT doc_id, score, rank::BIGINT AS rank, (SELECT count(*) FROM h)::BIGINT AS n FROM t WHERE rank <= 10""")
def engine_search(spark, sf):
    n, best = engine_of(spark, sf).search("Order, urgent!", kind="rd")
    return search.ranked(best.select("doc_id", "score")).withColumn("n", F.lit(n).cast("long"))


@query(f"""{ENGINE}, least AS (SELECT min(k) AS k FROM e) SELECT 'record' AS part, (SELECT k::VARCHAR || '/' || kind || '/' || mineral || '/' || stage FROM e WHERE k = (SELECT k FROM least)) AS value
UNION ALL SELECT 'org', lower('1-URGENT') || '/' || (SELECT count(*) FROM e WHERE stage = '1-URGENT') UNION ALL SELECT 'same', 'true/false'""")
def engine_lookups(spark, sf):
    engine = engine_of(spark, sf)
    first = engine.records.agg(F.min("line")).first()[0]
    r = engine.record(str(first))
    # The facade resolves a name by the alias table, else by its normal form; orgs here keep their hyphen.
    profile = analytics.org_profile(engine.records, "1-urgent", ["tier", "file", "line"]).first()
    rows = [("record", "/".join([r["doc_id"], r["kind"], r["mineral_ids"][0], r["stage_ids"][0]])), ("org", f"{profile['org']}/{profile['record_count']}"), ("same", f"{engine.same_org('No Body', 'nobody')}/{engine.same_org('x', 'y')}".lower())]
    return spark.createDataFrame(rows, "part string, value string")


@query(f"""{ENGINE}, g AS (SELECT x.mineral, s.stage, (SELECT count(*) FROM em WHERE em.mineral = x.mineral AND em.stage = s.stage AND kind IN ('rd', 'publication')) AS research, (SELECT count(*) FROM em WHERE em.mineral = x.mineral AND em.stage = s.stage AND kind NOT IN ('rd', 'publication')) AS patents
FROM (SELECT DISTINCT mineral FROM m) x, (SELECT DISTINCT stage FROM e) s), w AS (SELECT *, row_number() OVER (ORDER BY research - patents DESC, patents + research, mineral, stage)::BIGINT AS rank FROM g) SELECT mineral, stage, research - patents AS gap, rank FROM w WHERE rank <= 7""")
def engine_whitespace(spark, sf):
    return engine_of(spark, sf).whitespace(7).select("mineral", "stage", "gap", "rank")


@query(f"{ENGINE} SELECT 'sub-001' AS sub_id, k::VARCHAR AS record_id FROM e WHERE kind = 'publication' AND k % 2 = 0")
def engine_alerts(spark, sf):
    """A subscription that has seen half of the corpus is told of the other half, once."""
    engine, base = engine_of(spark, sf), scratch(spark, "alerts")
    store, whole = alerts.AlertTable(spark, base), engine.records
    engine.records = whole.where("line % 2 = 1")
    engine.subscribe(store, kind="publication")
    engine.records = whole
    for batch in range(2):
        engine.check_alerts(store, batch)
    return store.alerts().select("sub_id", "record_id")


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS minerals, n_regionkey::VARCHAR AS stages FROM nation")
def holdout_document(spark, sf):
    """A hold-out document made of the nations, read as its rows."""
    rows = table(spark, sf, "nation").collect()
    doc = {"test_ids": [str(r["n_nationkey"]) for r in rows], "labels": {str(r["n_nationkey"]): {"mineral_ids": [r["n_name"]], "stage_ids": [str(r["n_regionkey"])]} for r in rows}}
    out = holdout_rows(spark, doc)
    return out.select("id", F.array_join("mineral_ids", "|").alias("minerals"), F.array_join("stage_ids", "|").alias("stages"))
