"""Organisation names: exact lookup of a normal form among listed aliases, never by likeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import org_form

UNKNOWN = "unknown"
#: An alias table is a dimension; one of more rows is refused, so that it may be broadcast.
MAX_ALIASES = 1_000_000


def alias_index(aliases: DataFrame) -> DataFrame:
    """(norm, canonical) of an alias table; ValueError where one form has two canonical names."""
    index = aliases.select(org_form(F.col("variant")).alias("norm"), "canonical").distinct()
    clash = collisions(aliases).limit(1).collect()
    if clash:
        raise ValueError(f"variant collision: {clash[0]['norm']!r} maps to {clash[0]['canonicals']}")
    return index


def collisions(aliases: DataFrame) -> DataFrame:
    """(norm, n, canonicals) of the forms that several canonical names claim."""
    index = aliases.select(org_form(F.col("variant")).alias("norm"), "canonical").distinct()
    return index.groupBy("norm").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("canonical")), ", ").alias("canonicals")).where("n > 1")


def resolved(names: DataFrame, index: DataFrame, name: str = "name", to: str = "org") -> DataFrame:
    """names with the canonical name of each: its alias's, else its own normal form, else UNKNOWN."""
    known = index.select(F.col("norm").alias("__norm"), F.col("canonical").alias("__canonical"))
    if index.limit(MAX_ALIASES + 1).count() <= MAX_ALIASES:
        known = F.broadcast(known)
    form = org_form(F.col(name))
    out = names.withColumn("__form", form).join(known, F.col("__form") == F.col("__norm"), "left")
    return out.withColumn(to, F.coalesce("__canonical", F.nullif("__form", F.lit("")), F.lit(UNKNOWN))).drop("__form", "__norm", "__canonical")


def with_orgs(records: DataFrame, index: DataFrame, key: str, applicants: str = "applicants", to: str = "orgs") -> DataFrame:
    """records with the sorted distinct canonical names of their applicants; empty names count for nothing. key tells rows apart."""
    each = records.select(key, F.explode(applicants).alias("name")).where(F.coalesce("name", F.lit("")) != "")
    orgs = resolved(each, index).groupBy(key).agg(F.array_sort(F.collect_set("org")).alias(to))
    return records.drop(to).join(orgs, key, "left").withColumn(to, F.coalesce(to, F.expr("cast(array() as array<string>)")))


def merge_rate(aliases: DataFrame) -> DataFrame:
    """(variants, merged, rate): of the listed variants, those that resolve to their canonical name."""
    index = alias_index(aliases)
    out = resolved(aliases.where("variant <> canonical"), index, "variant")
    return out.agg(F.count("*").alias("variants"), F.count_if(F.col("org") == F.col("canonical")).alias("merged"), F.avg((F.col("org") == F.col("canonical")).cast("int")).alias("rate"))


def merge_report(aliases: DataFrame) -> DataFrame:
    """(norm, canonical) of every listed alias."""
    return alias_index(aliases)
