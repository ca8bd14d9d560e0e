"""Ranked, faceted search: scored in place for small corpora, over postings for large ones."""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import query_tokens, token_set
from corvane.schemas import WEIGHTS

HIT = ("doc_id", "title", "kind", "mineral_ids", "stage_ids", "applicants")


def indexed(records: DataFrame) -> DataFrame:
    """records with the token set of each field that scores, to be cached or written once."""
    text = {"title": F.col("title"), "applicants": F.array_join("applicants", " "), "tax": F.col("tax_text"), "abstract": F.col("abstract")}
    return records.withColumns({f"tok_{f}": token_set(text[f]) for f in WEIGHTS})


def faceted(df: DataFrame, mineral: str | None = None, stage: str | None = None, kind: str | None = None) -> DataFrame:
    """Exact filters, before any score; an empty one filters nothing."""
    if mineral:
        df = df.where(F.array_contains("mineral_ids", mineral))
    if stage:
        df = df.where(F.array_contains("stage_ids", stage))
    return df.where(F.col("kind") == kind) if kind else df


def score(tokens: list[str]) -> Column:
    """For each token of the query, repeats counted, the weights of the fields that have it."""
    times = Counter(tokens)
    if not times:
        return F.lit(0.0)
    worth = F.create_map(*map(F.lit, chain(*((t, float(n)) for t, n in times.items()))))
    wanted = F.array(*map(F.lit, times))

    def field(f: str) -> Column:
        # The token set is named once for each field, so that a plan that inlines it makes it once.
        return F.aggregate(F.array_intersect(f"tok_{f}", wanted), F.lit(0.0), lambda a, x: a + F.element_at(worth, x)) * F.lit(WEIGHTS[f])

    return reduce(lambda a, b: a + b, map(field, WEIGHTS))


def hits(index: DataFrame, q: str, mineral: str | None = None, stage: str | None = None, kind: str | None = None) -> DataFrame:
    """Scored records of indexed() that the facets keep: those with any token of the query or, for a query without tokens, all."""
    tokens = query_tokens(q)
    out = faceted(index, mineral, stage, kind).withColumn("score", score(tokens))
    return out.where("score > 0") if tokens else out


def search(index: DataFrame, q: str, mineral: str | None = None, stage: str | None = None, kind: str | None = None, limit: int = 10) -> DataFrame:
    """The best hits, by falling score and then doc_id. A negative limit leaves out as many from the end."""
    found = hits(index, q, mineral, stage, kind)
    if limit < 0:
        limit = max(0, found.count() + limit)
    return found.orderBy(F.desc("score"), "doc_id").limit(limit).select(*[c for c in HIT if c in found.columns], "score")


def postings(index: DataFrame) -> DataFrame:
    """(token, doc_id, weight): what each token is worth in each record, fields added up; write it partitioned by token ranges."""
    each = F.flatten(F.array(*[F.transform(f"tok_{f}", _weighed(w)) for f, w in WEIGHTS.items()]))
    return index.select("doc_id", F.explode(each).alias("p")).groupBy(F.col("p.token").alias("token"), "doc_id").agg(F.sum("p.w").alias("weight"))


def _weighed(w: float):
    return lambda x: F.struct(x.alias("token"), F.lit(w).alias("w"))


def scores_from_postings(posts: DataFrame, q: str) -> DataFrame:
    """(doc_id, score) of records with any token of the query. The token filter reaches the scan of written postings."""
    times = Counter(query_tokens(q))
    n = F.lit(0)
    for token, k in times.items():
        n = F.when(F.col("token") == token, k).otherwise(n)
    return posts.where(F.col("token").isin(list(times))).groupBy("doc_id").agg(F.sum(F.col("weight") * n).alias("score"))


def ranked(found: DataFrame) -> DataFrame:
    """found with rank, for results whose order must travel as a column. One partition: for bounded results."""
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("long"))


def lookup(records: DataFrame, doc_id: str) -> DataFrame:
    return records.where(F.col("doc_id") == doc_id)
