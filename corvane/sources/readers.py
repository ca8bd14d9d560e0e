"""One reader for each kind of landed file: (spark, path) to a frame of cleaned records.

A reader keeps where a record stood, as file and line, because keep-first rules
need an order that no scan has by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import ipc
from corvane.functions import text as t
from corvane.schemas import RECORD, REQUIRED, conform

PATENT_EXPORT = (
    "publication_number string, country_code string, title_localized array<struct<text:string,language:string>>, abstract_localized array<struct<text:string,language:string>>, "
    "assignee array<struct<name:string>>, inventor array<struct<name:string>>, ipc array<struct<code:string>>, publication_date long, filing_date long, legal_status string"
)
WORKS = (
    "results array<struct<id:string,title:string,abstract:string,publication_date:string,primary_location:struct<landing_page_url:string>,"
    "authorships:array<struct<institutions:array<struct<display_name:string>>>>>>"
)
# The markup of bibliographic blocks and of project cards.
BIBLIO = r'(?s)<div class="biblio" data-docid="([^"]+)">(.*?)</div>\s*(?=<div|\z)'
# A part of a card runs to where its end first stands: as any text may follow, a later end never matches where the first does not.
CARD = r'(?s)<div class="project">\s*<a href="([^"]+)">' + "".join(
    rf'([^<]*+(?:<(?!{end[1:]})[^<]*+)*+){end}' for end in (r'</a>\s*<span class="date">', r'</span>\s*<p class="desc">', r"</p>\s*</div>")
)

#: Institutions whose listing pages are read alike: source and the organisation that stands for the applicant.
LISTINGS = {"csir_nml": "CSIR-NML", "csir_immt": "CSIR-IMMT", "jnarddc": "JNARDDC", "dst_serb": "DST-SERB"}


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): files read whole, each a row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, raw): the lines of files that are not blank. Large files are read in splits, as any text is.

    line grows with the place in a file but doesn't count from one: it is the
    split's first byte, and the line's number within the split after it.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    # A running number of each task, whose lowest 33 bits count its rows in order.
    line = F.col("block") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return lines.select("file", line.alias("line"), F.col("value").alias("raw")).where(F.trim("raw") != "")


def matches(c: Column, pattern: str, groups: list[str]) -> Column:
    """Every match of a pattern as a struct of its groups, in order."""
    return F.arrays_zip(*[F.regexp_extract_all(c, F.lit(pattern), F.lit(k)).alias(name) for k, name in enumerate(groups, 1)])


def exploded(pages: DataFrame, items: Column, name: str) -> DataFrame:
    """(file, line, name): the items of pages(file, value), numbered within a page or, where pages have a line of their own, from that on."""
    found = pages.select("file", (F.col("line") if "line" in pages.columns else F.lit(0)).alias("__from"), F.posexplode(items).alias("__place", name))
    return found.select("file", (F.col("__from") + F.col("__place")).alias("line"), name)


def inner_span(block: Column, css_class: str) -> Column:
    """The cleaned content of the first span of a class, empty where there is none."""
    return t.clean_text(F.regexp_extract(block, rf'(?s)<span class="{css_class}">(.*?)</span>', 1))


def finish(df: DataFrame, source_id: str, kind: str, source_url_hint: str = "", fetched_at: str | None = None, clean: tuple[str, ...] = ()) -> DataFrame:
    """Records cleaned and given the defaults of their source: its id, kind, the hint for a missing address, and today's date. Lists named in clean are so already."""
    have = set(df.columns)
    text = [c for c in ("title", "abstract", "source_url", "legal_status") if c in have]
    lists = [c for c in ("applicants", "inventors", "ipc_codes") if c in have and c not in clean]
    today = F.lit(fetched_at) if fetched_at else F.date_format(F.current_date(), "yyyy-MM-dd")
    none = F.lit(None).cast("string")
    df = df.withColumns({c: t.clean_text(F.col(c)) for c in text} | {c: t.clean_list(F.col(c)) for c in lists})
    df = df.withColumns(
        {
            "source_id": F.coalesce(F.col("source_id") if "source_id" in have else none, F.lit(source_id)),
            "kind": F.coalesce(F.col("kind") if "kind" in have else none, F.lit(kind)),
            "source_url": F.coalesce(F.nullif(F.col("source_url") if "source_url" in have else none, F.lit("")), F.lit(source_url_hint)),
            "fetched_at": F.coalesce(F.nullif(t.norm_date(F.col("fetched_at")), F.lit("")) if "fetched_at" in have else none, today),
        }
    )
    if "appl_no" in have:
        df = df.withColumn("appl_no", t.application_number(F.col("appl_no")))
    if "filing_date" in have:
        df = df.withColumn("filing_date", F.when(F.coalesce(F.col("filing_date"), F.lit("")) != "", t.norm_date(F.col("filing_date"))).otherwise(F.col("filing_date")))
    df = conform(df)
    for c in ("title", "abstract"):
        df = df.withColumn(c, F.coalesce(c, F.lit("")))
    for c in ("applicants", "inventors", "ipc_codes"):
        df = df.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return df


def patent_export_records(rows: DataFrame) -> DataFrame:
    """Rows of the patent export as uncleaned records; rows without a publication number go."""
    number = t.clean_text(F.col("publication_number"))
    return rows.withColumn("number", number).where("number <> ''").select(
        "file",
        "line",
        F.concat(F.lit("https://patents.google.com/patent/"), "number").alias("source_url"),
        F.col("number").alias("appl_no"),
        t.first_text(F.col("title_localized")).alias("title"),
        t.first_text(F.col("abstract_localized")).alias("abstract"),
        F.transform("assignee", lambda x: x["name"]).alias("applicants"),
        F.transform("inventor", lambda x: x["name"]).alias("inventors"),
        F.transform(F.filter("ipc", lambda x: F.coalesce(x["code"], F.lit("")) != ""), lambda x: x["code"]).alias("ipc_codes"),
        F.when(F.coalesce("filing_date", F.lit(0)) != 0, F.col("filing_date").cast("string")).otherwise("").alias("filing_date"),
        F.when(F.endswith("number", F.lit("A")), F.lit("Published")).otherwise(F.col("legal_status")).alias("legal_status"),
    )


def google_patents(spark: SparkSession, path: str, **given) -> DataFrame:
    """JSON lines of the patent export; blank lines go."""
    rows = json_lines(spark, path).select("file", "line", F.from_json("raw", PATENT_EXPORT).alias("r")).select("file", "line", "r.*")
    return finish(patent_export_records(rows), "google_patents", "patent", **given)


def biblio_records(pages: DataFrame) -> DataFrame:
    """Bibliographic blocks of pages(file, value) as uncleaned records."""
    found = exploded(pages, matches(F.col("value"), BIBLIO, ["docid", "block"]), "m").select("file", "line", "m.*")
    span = lambda name: inner_span(F.col("block"), name)
    return found.select(
        "file",
        "line",
        F.concat(F.lit("https://patentscope.wipo.int/search/en/detail.jsf?docId="), "docid").alias("source_url"),
        F.col("docid").alias("appl_no"),
        span("title").alias("title"),
        span("abstract").alias("abstract"),
        F.array(span("applicant")).alias("applicants"),
        F.array(span("inventor")).alias("inventors"),
        F.filter(F.array(span("ipc")), lambda c: c.rlike(ipc.PUBLISHED)).alias("ipc_codes"),
        span("filing-date").alias("filing_date"),
        span("status").alias("legal_status"),
    )


def patentscope(spark: SparkSession, path: str, **given) -> DataFrame:
    """HTML of bibliographic blocks, a record each."""
    return finish(biblio_records(whole_files(spark, path)), "patentscope", "patent", **given)


def card_records(pages: DataFrame, organisation: str | None) -> DataFrame:
    """Project cards of pages(file, value); the institution is the only applicant."""
    found = exploded(pages, matches(F.col("value"), CARD, ["u", "t", "d", "p"]), "m")
    who = F.array(F.lit(organisation)) if organisation else F.array().cast("array<string>")
    # References of a date are decoded here and by finish, at once: white space is squeezed after both, as no reference holds any.
    return found.select(
        "file", "line", F.col("m.u").alias("source_url"), F.col("m.t").alias("title"), F.col("m.p").alias("abstract"), t.decode_references(F.col("m.d")).alias("filing_date"), who.alias("applicants")
    )


def listing(source_id: str) -> Callable[..., DataFrame]:
    def read(spark: SparkSession, path: str, **given) -> DataFrame:
        return finish(card_records(whole_files(spark, path), LISTINGS[source_id]), source_id, "rd", clean=("applicants",), **given)

    read.__doc__ = f"Project cards of {LISTINGS[source_id]}."
    return read


def work_records(pages: DataFrame) -> DataFrame:
    """Works of JSON responses in pages(file, value) as uncleaned records; institutions of all authorships are the applicants."""
    docs = pages.withColumn("value", F.from_json("value", WORKS))
    works = exploded(docs, F.col("value.results"), "w")
    return works.select(
        "file",
        "line",
        F.coalesce(F.nullif(F.col("w.primary_location.landing_page_url"), F.lit("")), "w.id").alias("source_url"),
        F.col("w.title").alias("title"),
        F.col("w.abstract").alias("abstract"),
        F.flatten(F.transform("w.authorships", lambda a: F.coalesce(F.transform(a["institutions"], lambda i: i["display_name"]), F.array().cast("array<string>")))).alias("applicants"),
        t.clean_text(F.col("w.publication_date")).alias("filing_date"),
    )


def openalex(spark: SparkSession, path: str, **given) -> DataFrame:
    """Works of a JSON response."""
    return finish(work_records(whole_files(spark, path)), "openalex", "publication", **given)


#: Readers in the order in which their records count for keep-first rules.
READERS: dict[str, Callable[..., DataFrame]] = {"google_patents": google_patents, "patentscope": patentscope} | {s: listing(s) for s in LISTINGS} | {"openalex": openalex}
SOURCE_KIND = {"google_patents": "patent", "patentscope": "patent"} | dict.fromkeys(LISTINGS, "rd") | {"openalex": "publication"}


def reader(source_id: str) -> Callable[..., DataFrame]:
    """The reader of a source; KeyError for one that is not known."""
    if source_id not in READERS:
        raise KeyError(f"unknown source: {source_id}")
    return READERS[source_id]


def required_fields(source_id: str) -> tuple[str, ...]:
    return REQUIRED[SOURCE_KIND[source_id]]


def records_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON arrays, with file and line."""
    docs = whole_files(spark, path).select("file", F.from_json("value", f"array<{RECORD.simpleString()}>").alias("d"))
    return conform(docs.select("file", F.posexplode("d").alias("line", "r")).select("file", "line", "r.*"))


def records_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines, blank lines left out, with file and line. Paths may be globs; none found gives no rows."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    if not found:
        return spark.createDataFrame([], RECORD).withColumns({"file": F.lit(""), "line": F.lit(0).cast("long")})
    return conform(json_lines(spark, path).select("file", "line", F.from_json("raw", RECORD).alias("r")).select("file", "line", "r.*"))
