"""The knowledge graph as two frames: nodes, and edges of a directed multigraph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.dedupe import keep_first

#: Node prefix, type and record column of each classification.
FACETS = (("min", "mineral", "mineral_ids"), ("stg", "stage", "stage_ids"), ("fam", "family", "process_family_ids"))


def with_record_key(records: DataFrame) -> DataFrame:
    """records with rec_key: fixture id, else application number, else address."""
    return records.withColumn("rec_key", F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("fixture_id", "appl_no", "source_url")]))


def _pairs(orgs: Column) -> Column:
    """Each pair of a list of names, as structs (org_a, org_b) with org_a before org_b."""
    names = F.array_sort(F.array_distinct(orgs))
    return F.flatten(F.transform(names, lambda a, i: F.transform(F.slice(names, i + 2, F.size(names)), lambda b: F.struct(a.alias("org_a"), b.alias("org_b")))))


def _of(items: Column, make, kind: str) -> Column:
    """A struct for each item of a list; none for a null list."""
    return F.coalesce(F.transform(items, make), F.expr(f"cast(array() as array<{kind}>)"))


EDGE = "struct<src:string,dst:string,type:string>"
NODE = "struct<id:string,type:string,name:string>"


def edges(records: DataFrame) -> DataFrame:
    """(src, dst, type) of records(rec_key, orgs, labels): applicants, classifications, and co-filing pairs of each record, in one pass."""
    rec = F.concat(F.lit("rec:"), "rec_key")

    def facet(column: str, prefix: str, kind: str) -> Column:
        return _of(F.col(column), lambda x: F.struct(rec.alias("src"), F.concat(F.lit(f"{prefix}:"), x).alias("dst"), F.lit(kind).alias("type")), EDGE)

    org = lambda x: F.concat(F.lit("org:"), x)
    filed = _of(_pairs(F.col("orgs")), lambda p: F.struct(org(p["org_a"]).alias("src"), org(p["org_b"]).alias("dst"), F.lit("cofiled_with").alias("type")), EDGE)
    every = F.concat(facet("orgs", "org", "applicant_of"), *[facet(column, prefix, "classified_as") for prefix, _, column in FACETS], filed)
    return records.select(F.explode(every).alias("e")).select("e.*")


def cofiled(records: DataFrame) -> DataFrame:
    """(org_a, org_b), org_a before org_b: each pair of organisations of one record, for each record."""
    return records.where(F.size("orgs") > 1).select(F.explode(_pairs(F.col("orgs"))).alias("p")).select("p.*")


def nodes(records: DataFrame, order: list[str]) -> DataFrame:
    """(id, type, kind, title, name): a record node for each key, whose last record in an order describes it, and one node for each org and label."""
    last = keep_first(records, ["rec_key"], [F.col(c).desc() for c in order])
    none = F.lit(None).cast("string")
    out = last.select(F.concat(F.lit("rec:"), "rec_key").alias("id"), F.lit("record").alias("type"), "kind", F.coalesce("title", F.lit("")).alias("title"), none.alias("name"))

    def facet(column: str, prefix: str, kind: str) -> Column:
        return _of(F.col(column), lambda x: F.struct(F.concat(F.lit(f"{prefix}:"), x).alias("id"), F.lit(kind).alias("type"), x.alias("name")), NODE)

    each = F.concat(*[facet(column, prefix, kind) for prefix, kind, column in (("org", "org", "orgs"), *FACETS)])
    named = records.select(F.explode(each).alias("n")).where("n.name is not null").select("n.*").distinct()
    return out.unionByName(named.select("id", "type", none.alias("kind"), none.alias("title"), "name"))


def dangling(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """Edges an end of which is no node."""
    ends = edges_.select("src").union(edges_.select("dst")).withColumnRenamed("src", "id").distinct()
    # Ends repeat far more than nodes; those without a node are few, and edges are read once more only to name theirs.
    lost = ends.join(nodes_.select("id"), "id", "left_anti")
    src, dst = lost.withColumnRenamed("id", "__src"), lost.withColumnRenamed("id", "__dst")
    met = edges_.join(src, F.col("src") == F.col("__src"), "left").join(dst, F.col("dst") == F.col("__dst"), "left")
    return met.where("__src is not null or __dst is not null").drop("__src", "__dst")


def reconcile(nodes_: DataFrame, edges_: DataFrame, n_records: int, expected: int | None = None) -> DataFrame:
    """One row of counts, consistent where record nodes are as many as expected and no edge dangles."""
    counts = nodes_.agg(F.count_if(F.col("type") == "record").alias("record_nodes"), F.count("*").alias("node_count"))
    lost = dangling(nodes_, edges_).agg(F.count("*").alias("dangling_edges"))
    whole = counts.crossJoin(edges_.agg(F.count("*").alias("edge_count"))).crossJoin(lost)
    good = (F.col("record_nodes") == n_records) & (F.col("dangling_edges") == 0)
    if expected is not None:
        good &= F.col("record_nodes") == expected
    return whole.select("record_nodes", F.lit(n_records).cast("long").alias("expected_records"), "node_count", "edge_count", "dangling_edges", good.alias("consistent"))


def record_org_links(records: DataFrame, role: str = "applicant") -> DataFrame:
    """(doc_id, org, role) of the declared link table."""
    return records.select("doc_id", F.explode("orgs").alias("org"), F.lit(role).alias("role")).distinct()
