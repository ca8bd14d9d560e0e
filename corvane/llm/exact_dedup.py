"""Exact duplicates by an extendible-hash index on shared files, in DataFrame and SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import LOWER, UPPER, aside, ascii_lower, cut, small, written

#: Bytes of texts that a bucket holds before it splits, and what a row counts besides its text.
BUCKET_BYTES, ROW_BYTES = 1 << 20, 64
#: Bits of a key that the directory may use: it has 2 ** MAX_DEPTH entries at most.
MAX_DEPTH = 20


def normalised(text: Column) -> Column:
    """A text with A-Z in lower case and nothing else changed; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    # In a text of ASCII alone lower() does the same, and much faster.
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(ascii_lower(text))


def _keyed(docs: DataFrame, id_col: str, text_col: str, key_bits: int) -> DataFrame:
    """(doc_id, text, key): the normalised text and the top key_bits of its 64-bit hash."""
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    return rows.withColumn("key", F.xxhash64("text").bitwiseAND(F.lit(-1 << (64 - key_bits))))


def directory(keys: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(slot, bucket, depth): the directory for keys(key, load), slot being the top MAX_DEPTH bits of a key.

    It begins as one bucket of depth 0. While a bucket of several slots is
    overfull, it splits by the next bit of its keys, which doubles the directory
    whenever the bucket was at its full depth. A bucket's keys are a range, and
    bucket is its first slot; one that can't split further stays overfull. Slots
    without keys have no row. A bucket holds no more than the one it was split
    from, so all doublings are made at once: a slot's depth is the number of its
    prefixes that are overfull.
    """
    slot = F.shiftrightunsigned("key", 64 - MAX_DEPTH).cast("int")
    slots = keys.groupBy(slot.alias("slot")).agg(F.sum("load").alias("load"))
    each = slots.select("slot", "load", F.explode(F.sequence(F.lit(0), F.lit(MAX_DEPTH - 1))).alias("at")).withColumn("prefix", F.expr(f"shiftright(slot, {MAX_DEPTH} - at)"))
    full = each.groupBy("at", "prefix").agg(F.sum("load").alias("full"), F.count("*").alias("n"), F.collect_list("slot").alias("slots"))
    depths = full.where((F.col("full") > bucket_bytes) & (F.col("n") > 1)).select(F.explode("slots").alias("slot")).groupBy("slot").agg(F.count("*").cast("int").alias("depth"))
    out = slots.select("slot").join(depths, "slot", "left").select("slot", F.coalesce("depth", F.lit(0)).alias("depth"))
    return out.select("slot", F.expr(f"shiftleft(shiftright(slot, {MAX_DEPTH} - depth), {MAX_DEPTH} - depth)").alias("bucket"), "depth")


def index_entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows, entries): every row as (doc_id, key, sha, n_bytes), and the index of the texts whose key repeats.

    An entry is one distinct text of a key: (bucket, page, key, sha, text,
    group_size, keep_id, keep_rows), written to shared files. Entries of one key
    are its chain. Rows go to the owner of their bucket, a key range, which
    compares whole texts by their bytes. A key whose rows fill more than a
    bucket, as no split can part them, has so many pages, each with its owner;
    a text then has an entry in each.
    """
    keyed = _keyed(docs, id_col, text_col, key_bits)
    rows = cut(keyed.select("doc_id", "key", F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")))
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("n_bytes") + ROW_BYTES).alias("load")).where("n > 1")
    keys = cut(keys.select("key", "load"))
    slot = F.shiftrightunsigned("key", 64 - MAX_DEPTH).cast("int")
    places = written(directory(keys, bucket_bytes), "directory")
    placed = keys.withColumn("slot", slot).join(small(places), "slot").select("key", "bucket", F.ceil(F.col("load") / bucket_bytes).alias("pages"))
    page = F.when(F.col("pages") > 1, F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.monotonically_increasing_id().cast("string"))), F.col("pages"))).otherwise(0)
    owned = keyed.join(small(cut(placed)), "key").select("bucket", page.alias("page"), "key", "text", "doc_id").repartition("bucket", "page")
    each = owned.groupBy("bucket", "page", "key", "text", "doc_id").agg(F.count("*").alias("n"))
    chained = each.groupBy("bucket", "page", "key", "text").agg(F.sum("n").alias("group_size"), F.max(F.struct("doc_id", "n")).alias("keep"))
    chained = chained.select("bucket", "page", "key", F.unhex(F.sha2("text", 256)).alias("sha"), "text", "group_size", F.col("keep.doc_id").alias("keep_id"), F.col("keep.n").alias("keep_rows"))
    return rows, written(chained.sortWithinPartitions("bucket", "key"), "buckets")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row (doc_id, keep_id, group_size, kept, text_sha256) for each row of docs.

    Texts are equal when they are identical after lower-casing A-Z; a null text
    is empty, and empty texts are equal. Of equal texts the row with the largest
    doc_id stays. A null id is smaller than any: a row without one stays only
    where its group has no other, and keep_id is null there. Of rows that repeat
    both id and text one is kept; rows that share an id but not the text have
    nothing to do with each other. Texts of any length are compared whole, by
    their bytes; key_bits (up to 64) shortens the hash, for tests of collisions.
    Other columns are not read; an empty table gives no rows.
    """
    rows, entries = index_entries(docs, id_col, text_col, key_bits, bucket_bytes)
    # The pages of a key meet, and again texts are compared.
    best = F.max(F.struct("keep_id", "keep_rows"))
    whole = entries.groupBy("key", "sha", "text").agg(F.sum("group_size").alias("group_size"), best.alias("keep"), F.sum(F.when(F.col("keep_rows") > 1, 1).otherwise(0)).alias("repeats"))
    chain = cut(whole.select("key", "sha", F.col("keep.keep_id").alias("keep_id"), "group_size", (F.col("keep.keep_rows") > 1).alias("repeated")).withColumn("indexed", F.lit(True)))
    _one_text_each(chain)
    out = rows.join(small(chain), ["key", "sha"], "left")
    keep_id = F.when(F.col("indexed"), F.col("keep_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "sha", "repeated")
    out = out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    again = F.col("kept") & F.coalesce("repeated", F.lit(False))
    if chain.where("repeated").take(1):
        place = F.row_number().over(Window.partitionBy("sha").orderBy("doc_id"))
        out = out.where(~again).unionByName(out.where(again).withColumn("kept", place == 1))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def _one_text_each(chain: DataFrame) -> None:
    """Rows find their entry by key and SHA-256; two different texts with both equal would be mixed up."""
    both = chain.groupBy("key", "sha").count().where("count > 1").limit(1).collect()
    if both:
        raise ValueError(f"two different texts share the SHA-256 {both[0]['sha'].hex()}")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of docs, with its columns, that exact_groups keeps. Columns may have any names.

    Of rows that repeat both id and text, the first by a hash of its columns' JSON stays.
    """
    docs, back, names = aside(docs)
    id_col, text_col = names[id_col], names[text_col]
    groups = exact_groups(docs, id_col, text_col, bucket_bytes=bucket_bytes)
    kept = groups.where("kept").select(F.col("doc_id").alias("__id"), F.unhex("text_sha256").alias("__kept"), (F.col("group_size") > 1).alias("__several"))
    keyed = docs.withColumn("__sha", F.unhex(F.sha2(normalised(F.col(text_col)), 256)))
    found = keyed.join(kept, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__kept")))
    order = Window.partitionBy("__sha", id_col).orderBy(F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))))
    several = found.where("__several").withColumn("__row", F.row_number().over(order)).where("__row = 1").drop("__row")
    return found.where(~F.col("__several")).unionByName(several).select(*back)


#: The same rows by a window over whole texts.
ORACLE_SQL = f"""WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)"""
