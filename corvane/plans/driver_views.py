"""The driver's tables seen as records, so that every operator runs on them whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.reference import Label, Taxonomy

KIND_OF_STATUS = {"F": "patent", "O": "rd", "P": "publication"}

#: A taxonomy of words that the driver's prose has: whole words and substrings of varied frequency, one family under each stage.
DRIVER_TAXONOMY = Taxonomy(
    minerals=[Label("M1", "first", ["co"], []), Label("M2", "second", ["y"], ["ce"]), Label("M3", "third", ["la"], []), Label("M4", "fourth", [], ["und"])],
    stages=[Label("S1", "with", ["with"], []), Label("S2", "from", ["from"], ["les"]), Label("S3", "li", [], ["li"])],
    families=[Label("F1", "", ["the"], [], "S1"), Label("F2", "", [], ["ent"], "S2"), Label("F3", "", ["un"], ["ing"], "S3"), Label("F4", "", [], [], "S1")],
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each order: status as kind, its parts' types as minerals, priority as stage, its suppliers as organisations."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    each = lines.select("l_orderkey", "l_partkey", "l_suppkey").join(part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).join(supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    labels = each.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_type")).alias("mineral_ids"), F.array_sort(F.collect_set("s_name")).alias("orgs"))
    return orders.join(labels, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").cast("string").alias("doc_id"),
        "o_orderkey",
        kind_of_status().alias("kind"),
        "mineral_ids",
        F.array("o_orderpriority").alias("stage_ids"),
        F.expr("cast(array() as array<string>)").alias("process_family_ids"),
        "orgs",
        F.concat(F.lit("order "), "o_orderkey").alias("title"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("filing_date"),
    )


def kind_of_status():
    kind = F.lit(None).cast("string")
    for status, name in KIND_OF_STATUS.items():
        kind = F.when(F.col("o_orderstatus") == status, name).otherwise(kind)
    return kind


def customer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each order: its customer's nation and region as organisations, its parts' types and priority as labels."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    home = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(home), F.col("c_nationkey") == F.col("n_nationkey"))
    who = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    records = star_records(spark, sf_dir).drop("orgs")
    return records.join(who.select("o_orderkey", F.array("n_name", "r_name").alias("orgs")), "o_orderkey")


def text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each document: its first line as title, its text as abstract, source and language as applicants."""
    return table(spark, sf_dir, "documents").select(
        F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("doc_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("abstract"),
        F.array("source", "lang").alias("applicants"),
        F.when(F.col("lang") == "en", "patent").when(F.col("lang") == "fr", "publication").otherwise("rd").alias("kind"),
        F.array("lang").alias("mineral_ids"),
        F.array("source").alias("stage_ids"),
        F.col("source").alias("tax_text"),
        F.lit("").alias("source_url"),
    )
