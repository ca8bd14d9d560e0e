"""The searchable corpus: golden records and harvested ones, labelled and resolved."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import record_id
from corvane.operators.dedupe import merged
from corvane.operators.resolve import with_orgs
from corvane.operators.taxonomy import classified
from corvane.sources.reference import Taxonomy
from corvane.sources.readers import records_json, records_jsonl

LABELS = ("mineral_ids", "stage_ids", "process_family_ids")


def display_text(ids, names: dict[str, str]):
    """Display names of ids, space-joined; an id without a name stands for itself."""
    known = F.create_map(*map(F.lit, chain(*names.items()))) if names else None
    shown = F.transform(ids, lambda i: F.coalesce(F.try_element_at(known, i), i)) if names else ids
    return F.array_join(shown, " ")


def enriched(records: DataFrame, taxonomy: Taxonomy, index: DataFrame) -> DataFrame:
    """records(doc_id, tier, file, line, ...) with labels, orgs and tax_text.

    Labels are predicted for records that lack minerals or stages, and fill only
    what is null: an empty list was said by someone and stays.
    """
    empty = F.expr("cast(array() as array<string>)")
    out = classified(records, taxonomy)
    lacks = (F.coalesce(F.size("mineral_ids"), F.lit(0)) <= 0) | (F.coalesce(F.size("stage_ids"), F.lit(0)) <= 0)
    out = out.withColumn("__lacks", lacks).withColumns({c: F.when(F.col("__lacks"), F.coalesce(c, f"pred_{c}")).otherwise(F.col(c)) for c in LABELS})
    out = out.drop("__lacks", *[f"pred_{c}" for c in LABELS])
    # Where a record stood tells rows apart, and the same in every evaluation.
    out = out.withColumn("__row", F.concat_ws(":", "tier", "file", "line"))
    out = with_orgs(out, index, "__row").drop("__row")
    ids = F.concat(F.coalesce("mineral_ids", empty), F.coalesce("stage_ids", empty))
    return out.withColumn("tax_text", display_text(ids, taxonomy.names))


def golden_records(spark: SparkSession, paths: list[str], taxonomy: Taxonomy, index: DataFrame) -> DataFrame:
    """The hand-checked records of JSON arrays, in order of file and line."""
    rows = None
    for tier, path in enumerate(paths):
        part = records_json(spark, path).withColumn("tier", F.lit(tier))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("doc_id", F.coalesce(F.nullif("fixture_id", F.lit("")), "appl_no"))
    return enriched(rows, taxonomy, index)


def harvested_records(spark: SparkSession, path: str, taxonomy: Taxonomy, index: DataFrame) -> DataFrame:
    """The records of JSON-lines files, of a glob, after the golden ones in order."""
    rows = records_jsonl(spark, path).withColumn("tier", F.lit(1_000))
    rows = rows.withColumn("doc_id", record_id(F.col("appl_no"), F.col("source_id"), F.col("source_url")))
    return enriched(rows, taxonomy, index)


def corpus(golden: DataFrame, harvested: DataFrame | None = None, include_harvested: bool = True) -> DataFrame:
    """Golden records and, unless left out, what harvested ones add to them."""
    return merged(golden, harvested, ["file", "line"]) if harvested is not None and include_harvested else golden
