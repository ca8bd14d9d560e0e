"""Exact dedup against a dictionary of texts, with collisions forced, splits counted and odd tables."""

import hashlib

from pyspark.sql import functions as F

from corvane.llm import exact_dedup
from corvane.llm.common import LOWER, UPPER

ROWS = [(1, "Same text"), (2, "same TEXT"), (9, "same text"), (4, "Straße ÄÖ"), (5, "straße ÄÖ"), (6, "straße äö"), (7, None), (8, ""), (10, "alone"), (11, "x" * 300_000), (12, "X" * 300_000)]


def brute(rows):
    low = {ord(a): b for a, b in zip(UPPER, LOWER, strict=True)}
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(low), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = ids.count(keep)
        for i in sorted(ids, key=lambda i: (i is not None, i)):
            out.append((i, keep, len(ids), i == keep and left == ids.count(keep), hashlib.sha256(t.encode()).hexdigest()))
            left -= i == keep
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_groups(spark):
    assert got(exact_dedup.exact_groups(frame(spark, ROWS))) == brute(ROWS)


def test_chains_of_colliding_keys_are_parted_by_bytes(spark):
    rows = [(i, f"Text {i % 37}" if i % 2 else f"TEXT {i % 37}") for i in range(400)]
    for bits in (1, 3):
        docs = frame(spark, rows)
        assert got(exact_dedup.exact_groups(docs, key_bits=bits)) == brute(rows)
        _, entries = exact_dedup.index_entries(docs, key_bits=bits)
        assert entries.select("key").distinct().count() <= 2**bits < entries.count() == 37


def test_overfull_buckets_split_and_hot_keys_have_pages(spark):
    rows = [(i, f"text {i // 2}") for i in range(2000)] + [(10_000 + i, "Hot") for i in range(3000)]
    docs = frame(spark, rows)
    keys = docs.withColumn("key", F.xxhash64("text")).groupBy("key").agg((F.count("*") * 80).alias("load"))
    held = exact_dedup.directory(keys, 4000)
    slot = F.shiftrightunsigned("key", 64 - exact_dedup.MAX_DEPTH).cast("int")
    buckets = keys.withColumn("slot", slot).join(held, "slot").groupBy("bucket").agg(F.sum("load").alias("load"), F.count("*").alias("n"), F.min("depth").alias("least"), F.max("depth").alias("most"), F.min("slot").alias("first"), F.max("slot").alias("last")).collect()
    assert len(buckets) > 30 and all(b["load"] <= 4000 or b["n"] == 1 for b in buckets) and all(b["least"] == b["most"] for b in buckets)
    # Key ranges: no bucket begins before another's end, and one step less would be overfull.
    ranges = sorted((b["bucket"], b["bucket"] + (1 << (exact_dedup.MAX_DEPTH - b["most"]))) for b in buckets)
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    _, entries = exact_dedup.index_entries(docs, bucket_bytes=4000)
    assert entries.where("text = 'hot'").count() > 10 and entries.where("text <> 'hot'").groupBy("key").count().where("count > 1").count() == 0
    assert got(exact_dedup.exact_groups(docs, bucket_bytes=4000)) == brute(rows)


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a"), (None, "A"), (None, "b"), (3, "b"), (5, "c"), (5, "c"), (5, "C"), (5, "d"), (None, None), (2, None)]
    assert got(exact_dedup.exact_groups(frame(spark, rows))) == brute(rows)
    stays = exact_dedup.exact_dedup(frame(spark, rows)).select("doc_id", F.lower("text")).collect()
    assert sorted(map(tuple, stays), key=str) == sorted([(None, "a"), (3, "b"), (5, "c"), (5, "d"), (2, None)], key=str)


def test_clashing_columns_and_empty_table(spark):
    docs = frame(spark, ROWS).select("doc_id", "text", F.lit(1).alias("key"), F.lit("z").alias("__sha"), F.lit(2).alias("group_size"), F.array(F.lit(1)).alias("kept"))
    assert got(exact_dedup.exact_groups(docs)) == brute(ROWS)
    out = exact_dedup.exact_dedup(docs)
    assert out.columns == docs.columns and {r[0] for r in out.select("doc_id").collect()} == {9, 5, 6, 8, 10, 12}
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0 and exact_dedup.exact_dedup(docs.limit(0)).count() == 0
