"""A written index of blocks with their largest weight, and a search that stops where no unread block can matter."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import query_tokens
from corvane.operators import search
from corvane.operators.ordering import ranked_table

#: Records of a range, whose postings of one token are a block, and ranges read first; each further step reads twice as many.
RANGE, FIRST_RANGES = 4096, 4


def write_index(index: DataFrame, path: str, size: int = RANGE) -> Index:
    """The index of search.indexed() records under a path: documents numbered by id, and each token's postings in blocks by ranges of those numbers.

    A block holds at most a range's records, so no token's postings are gathered
    whole. Blocks are sorted by token, whose filter then reaches the files'
    statistics; what tells whether a block matters stands in columns of its own.
    """
    docs = ranked_table(index.select("doc_id", *[c for c in index.columns if c.startswith("tok_")]), ["doc_id"], f"{path}/docs", "number")
    posts = search.postings(docs.withColumn("doc_id", F.col("number")))
    ranged = posts.withColumn("range", F.expr(f"(doc_id - 1) div {int(size)}"))
    blocks = ranged.groupBy("token", "range").agg(F.max("weight").alias("top"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(F.col("doc_id").alias("number"), "weight"))).alias("rows"))
    order = ["token", "range"]
    blocks.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/blocks")
    docs.select("doc_id", "number").repartitionByRange("number").sortWithinPartitions("number").write.mode("overwrite").parquet(f"{path}/numbers")
    return Index(index.sparkSession, path)


@dataclass
class Found:
    """Hits in order, and how much of the index they took."""

    hits: list[tuple[str, float]]
    blocks_read: int
    blocks: int


class Index:
    """An index that was written by write_index."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _blocks(self) -> DataFrame:
        return self.spark.read.schema("token string, range long, top double, n long, rows array<struct<number:long,weight:double>>").parquet(f"{self.path}/blocks")

    def top(self, q: str, limit: int = 10, first: int = FIRST_RANGES) -> Found:
        """The best records of a query with tokens, by falling score and then id, as search.search() has them without facets.

        A range's bound is the sum of its blocks' largest weights. Ranges are
        read from the largest bound on, and none is read whose bound is below the
        last hit's score, or equal to it where all its records come after that
        hit. Only the hits, limit of them, come to the driver.
        """
        times = Counter(query_tokens(q))
        if not times or limit <= 0:
            return Found([], 0, 0)
        worth = F.lit(0)
        for token, k in times.items():
            worth = F.when(F.col("token") == token, k).otherwise(worth)
        own = self._blocks().where(F.col("token").isin(list(times)))
        # Heads alone are read here, not the postings.
        bounds = own.groupBy("range").agg(F.sum(F.col("top") * worth).alias("bound"), F.count("*").alias("blocks")).cache()
        try:
            total = bounds.agg(F.sum("blocks")).first()[0] or 0
            hits: list[tuple[float, int, int]] = []
            left, read, size = bounds, 0, first
            while True:
                wave = left.orderBy(F.desc("bound"), "range").limit(size).collect()
                if not wave:
                    break
                read += sum(r["blocks"] for r in wave)
                rows = own.where(F.col("range").isin([r["range"] for r in wave])).select("range", F.explode("rows").alias("p"), worth.alias("k"))
                scored = rows.groupBy("range", F.col("p.number").alias("number")).agg(F.sum(F.col("p.weight") * F.col("k")).alias("score"))
                best = scored.orderBy(F.desc("score"), "number").limit(limit).collect()
                hits = sorted([*hits, *((-r["score"], r["number"], r["range"]) for r in best)])[:limit]
                last, size = wave[-1], size * 2
                left = left.where((F.col("bound") < last["bound"]) | ((F.col("bound") == last["bound"]) & (F.col("range") > last["range"])))
                if len(hits) == limit:
                    score, _, at = hits[-1]
                    left = left.where((F.col("bound") > -score) | ((F.col("bound") == -score) & (F.col("range") < at)))
        finally:
            bounds.unpersist()
        names = dict(self.spark.read.parquet(f"{self.path}/numbers").where(F.col("number").isin([n for _, n, _ in hits])).select("number", "doc_id").collect()) if hits else {}
        return Found([(names[n], -s) for s, n, _ in hits], read, total)

    def hits(self, q: str, limit: int = 10) -> DataFrame:
        """(doc_id, score, rank) of top()."""
        found = self.top(q, limit).hits
        return self.spark.createDataFrame([(d, s, k) for k, (d, s) in enumerate(found, 1)], "doc_id string, score double, rank long")
