"""Schemas and constants that operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, L = T.StringType(), T.ArrayType(T.StringType())

#: A record as it is stored: one technology record of any source.
RECORD = T.StructType(
    [
        T.StructField(n, k)
        for n, k in {
            "fixture_id": S, "source_id": S, "source_url": S, "fetched_at": S, "kind": S, "appl_no": S, "title": S, "abstract": S,
            "applicants": L, "inventors": L, "ipc_codes": L, "filing_date": S, "legal_status": S,
            "mineral_ids": L, "stage_ids": L, "process_family_ids": L,
            "kind_code": S, "publication_date": S, "journal_no": S, "journal_part": S, "pages": T.IntegerType(), "claims": T.IntegerType(),
            "candidate_reason": T.StructType([T.StructField("keywords", L), T.StructField("ipc", L)]),
        }.items()
    ]
)

SOURCES = "source_id string, name string, kind string, base_url string"
TAXONOMY_VERSIONS = "version string, released_at timestamp, payload string"
ORGANISATIONS = "org_id string, canonical_name string, kind string"
RECORD_ORG_LINKS = "doc_id string, org string, role string"

KINDS = ("patent", "rd", "publication")
RESEARCH_KINDS = ("rd", "publication")

# What a record of each kind must have.
REQUIRED = {
    "patent": ("title", "applicants", "filing_date", "source_url", "fetched_at"),
    "rd": ("title", "source_url", "fetched_at"),
    "publication": ("title", "source_url", "fetched_at"),
}

# What a query token counts for in each field.
WEIGHTS = {"title": 3.0, "applicants": 2.0, "tax": 2.0, "abstract": 1.0}

# Thresholds.
COMPLETE_ENOUGH = 0.95
GATE_ACCURACY, GATE_MACRO_F1, GATE_ROWS = 0.85, 0.75, 100
QUALITY_PP, SPEED_PCT = 2.0, 20.0
VOLUME_TARGET, TITLE_SHARE, ABSTRACT_SHARE = 2000, 0.8, 0.6


def conform(df: DataFrame, schema: T.StructType = RECORD) -> DataFrame:
    """df with the schema's columns added as nulls where it lacks them, in order, and its own others after them."""
    have = set(df.columns)
    named = [F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return df.select(*named, *[c for c in df.columns if c not in set(schema.fieldNames())])
