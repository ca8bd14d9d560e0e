"""Writers of records, candidates, archives and graphs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from corvane.operators.dedupe import keep_first, not_stored
from corvane.operators.graph import dangling


def write_store(records: DataFrame, path: str) -> None:
    """Records as JSON lines, in place of what is there."""
    records.drop("file", "line", "tier").write.mode("overwrite").json(path)


def append_candidates(found: DataFrame, stored: DataFrame | None, path: str) -> None:
    """Candidates whose address is not stored yet, as more JSON lines; of equal addresses the first by file and line."""
    fresh = not_stored(found, stored, ["source_url"]) if stored is not None else found
    keep_first(fresh, ["source_url"], ["file", "line"]).drop("file", "line").write.mode("append").json(path)


def write_archive(records: DataFrame, path: str) -> None:
    """Everything parsed, a folder for each journal part; a part that is written again replaces itself alone."""
    records.drop("file", "line").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("journal_no", "journal_part").json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> str:
    """Nodes and edges as Parquet; returns their counts as JSON. Counts come from the writing itself, and edges without an end from what was written, so that neither is made again."""
    counts = {}
    for name, df in (("nodes", nodes), ("edges", edges)):
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/{name}")
        counts[name] = seen.get["n"]
    read = nodes.sparkSession.read
    return json.dumps(counts | {"dangling": dangling(read.parquet(f"{path}/nodes"), read.parquet(f"{path}/edges")).count()})


def metrics_json(report: DataFrame) -> str:
    """A report of a few rows as JSON."""
    return json.dumps([json.loads(r[0]) for r in report.select(F.to_json(F.struct("*"))).collect()])
