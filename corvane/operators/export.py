"""Selections and counts over patent exports with nested, localised fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import first_text

# Terms of the export's filter, and patterns of the volume check.
TERMS = ("lithium", "spodumene", "brine", "rare earth", "neodymium", "praseodymium", "dysprosium", "monazite", "graphite", "graphene", "cobalt", "nickel", "laterite")
PILOT = {
    "li": r"lithium|spodumene|lepidolite|petalite",
    "ree": r"rare[ -]earth|neodymium|praseodymium|dysprosium|lanthanum|cerium|monazite|samarium|terbium",
    "gra": r"graphite|graphene",
    "co": r"cobalt",
    "ni": r"nickel|laterite",
}


def export(rows: DataFrame, country: str = "IN", since: int = 20100101, terms: tuple[str, ...] = TERMS, language: str = "en") -> DataFrame:
    """Publications of a country from a date on whose title or abstract has a term, flattened."""
    title, abstract = first_text(F.col("title_localized"), language), first_text(F.col("abstract_localized"), language)
    pattern = "|".join(terms)
    names = lambda c, f: F.transform(c, lambda x: x[f])
    out = rows.where((F.col("country_code") == country) & (F.col("publication_date") >= since)).withColumns({"title": title, "abstract": abstract})
    out = out.where(F.coalesce(F.lower("title").rlike(pattern), F.lit(False)) | F.coalesce(F.lower("abstract").rlike(pattern), F.lit(False)))
    keep = [c for c in ("publication_number", "application_number", "country_code", "kind_code", "publication_date", "filing_date") if c in rows.columns]
    return out.select(*keep, "title", "abstract", names("assignee_harmonized", "name").alias("assignees"), names("inventor_harmonized", "name").alias("inventors"), names("ipc", "code").alias("ipc_codes"))


def volume(rows: DataFrame, prefix: str = "IN-", patterns: dict[str, str] | None = None) -> DataFrame:
    """One row: publications whose number starts so, and how many titles match each pattern and any."""
    patterns = PILOT if patterns is None else patterns
    t = F.lower("title")
    every = "|".join(patterns.values())
    return rows.where(F.startswith("publication_number", F.lit(prefix))).agg(
        F.count("*").alias("in_publications"), *[F.count_if(t.rlike(p)).alias(n) for n, p in patterns.items()], F.count_if(t.rlike(every)).alias("any_pilot")
    )


def identity_probe(rows: DataFrame, country: str = "IN", limit: int = 8) -> DataFrame:
    """A few granted publications, to see whether they carry application numbers."""
    return rows.where((F.col("country_code") == country) & F.startswith("kind_code", F.lit("B"))).select("publication_number", "application_number", "kind_code").limit(limit)
