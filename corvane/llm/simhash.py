"""SimHash near-duplicate groups by multi-index hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import aside, cut, small
from corvane.llm.graph import connected_components

SEED, SHINGLE, MAX_BITS = 42, 3, 3
LOW = 0xFFFFFFFF
#: Table entries of one segment value beyond which its links are found through shared ball points.
HOT_BUCKET = 2000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> bytes:
    """The 8 bytes of a text's fingerprint, most significant first.

    A-Z are lower-cased, words are runs between the ASCII white-space bytes and
    shingles are space-joined, repeats included. A bit is set if it is set in
    over half of the shingles' XXH64 values. Fewer words than a shingle hash as
    one sequence; no words give zero. Bits are summed in slices, so that a very
    long text needs no more memory than its words.
    """
    words = text.lower().split()
    if not words:
        return bytes(8)
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(grams), 16384):
        part = b"".join([digest(g, SEED) for g in grams[at : at + 16384]])
        counts += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(grams)).tobytes()


@F.pandas_udf(T.LongType())
def fingerprint_of(text: pd.Series) -> pd.Series:
    """The fingerprint of a text as a signed long; a null text counts as empty."""
    return pd.Series(np.frombuffer(b"".join(fingerprint((x or "").encode()) for x in text), ">i8").astype(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of each row of docs."""
    return docs.select(F.col(id_col).alias("doc_id"), fingerprint_of(text_col).alias("fp"))


def _one(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def _segments(fp: str, balls: bool) -> Column:
    """Keys of a fingerprint's two 32-bit segments, (which << 32 | value); balls: with every clear bit set in turn as well.

    Of two values that differ in one bit exactly one has it clear, so setting
    clear bits alone meets each such pair once.
    """

    def of(which: int) -> list[Column]:
        value = F.shiftrightunsigned(F.col(fp), 32 * (1 - which)).bitwiseAND(F.lit(LOW))
        mark = F.lit(which << 32).cast("long")
        clear = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.getbit(value, i) == 0)
        own = F.array(value.bitwiseOR(mark))
        return [own, F.transform(clear, lambda i: value.bitwiseOR(_one(i)).bitwiseOR(mark))] if balls else [own]

    return F.concat(*of(0), *of(1))


def crowded_keys(fps: DataFrame) -> DataFrame:
    """(key): segment values that more than HOT_BUCKET fingerprints share."""
    return cut(fps.select("fp", F.explode(_segments("fp", False)).alias("key")).groupBy("key").count().where(F.col("count") > HOT_BUCKET).select("key"))


def _beside(fps: DataFrame, crowded: DataFrame) -> DataFrame:
    """(fp, key): fingerprints a segment of which differs in one bit from a crowded value."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(31)), _one)
    keys = F.transform(_segments("fp", False), lambda k: F.transform(flips, lambda bit: k.bitwiseXOR(bit)))
    return fps.select("fp", F.explode(F.flatten(keys)).alias("key")).join(small(crowded), "key")


def links(fps: DataFrame, max_bits: int = MAX_BITS, crowded: DataFrame | None = None) -> DataFrame:
    """(a, b): the links that join each group of distinct fingerprints fps(fp), every end with max_bits (3 at most) or fewer differing bits.

    Multi-index hashing: of two fingerprints at 3 or fewer bits, one of the two
    32-bit segments differs in one bit at most. Each fingerprint stands in a
    table under both its segments; each probes it with its segments and their
    Hamming balls of radius one, and whole distances are verified in the join's
    condition. All links are returned, but for the values of a segment that more
    than HOT_BUCKET fingerprints share; there, see _hot_links, a set of links
    with the same components is, as all of them grow with the group's square.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with balls of radius one find 3 bits at most")
    entries = fps.select("fp", F.explode(_segments("fp", False)).alias("key"))
    crowded = crowded_keys(fps) if crowded is None else crowded
    probes = fps.select(F.col("fp").alias("a"), F.explode(_segments("fp", True)).alias("key"))
    if any_hot := bool(crowded.take(1)):
        plain_entries, plain_probes = entries.join(crowded, "key", "left_anti"), probes.join(crowded, "key", "left_anti")
    else:
        plain_entries, plain_probes = entries, probes
    near = plain_probes.join(plain_entries.withColumnRenamed("fp", "b"), "key")
    near = near.where((F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits) & (F.col("a") != F.col("b"))).select("a", "b")
    return near.unionByName(_hot_links(entries.join(crowded, "key"), fps, crowded, max_bits)) if any_hot else near


def _hot_links(entries: DataFrame, fps: DataFrame, crowded: DataFrame, max_bits: int) -> DataFrame:
    """Links that join, within each crowded segment value, what lies within max_bits, in time linear in its fingerprints.

    Members share the value of one segment (or, as guests, differ from it in one
    bit); the other 32 bits may differ in r = max_bits (r - 1 for guests). Two
    values within r bits have a point between them that is floor(r / 2) bits or
    less from one (inner) and ceil(r / 2) or less from the other. So each member
    emits the points of its ball of the larger radius, and each guest those it
    can reach within r. At a point with an inner member, everything there is
    within r bits of that member and is linked to the smallest such member: no
    link is false, and the ends of any true one meet at a point of theirs.
    """
    if not max_bits:
        return entries.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    inner, reach = max_bits // 2, -(-max_bits // 2)
    other = F.when(F.shiftright("key", 32) == 0, F.col("fp").bitwiseAND(F.lit(LOW))).otherwise(F.shiftrightunsigned("fp", 32))

    def ball(value: Column, radius: int) -> Column:
        points = [F.array(value)]
        if radius >= 1:
            points.append(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: value.bitwiseXOR(_one(i))))
        if radius >= 2:
            two = lambda i: F.transform(F.sequence(i + 1, F.lit(31)), lambda j: value.bitwiseXOR(_one(i)).bitwiseXOR(_one(j)))
            points.append(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(30)), two)))
        return F.concat(*points)

    members = entries.select("key", "fp", other.alias("value")).select("key", "fp", "value", F.explode(ball(F.col("value"), reach)).alias("point"))
    members = members.select("key", "fp", "point", (F.bit_count(F.col("value").bitwiseXOR(F.col("point"))) <= inner).alias("inner"))
    guests = _beside(fps, crowded).select("key", "fp", F.explode(ball(other, max_bits - 1 - inner)).alias("point"), F.lit(False).alias("inner"))
    rows = members.unionByName(guests)
    centres = rows.where("inner").groupBy("key", "point").agg(F.min("fp").alias("a"))
    return rows.join(centres, ["key", "point"]).where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row (doc_id, fingerprint, component_id, n_links) for each row of docs.

    fingerprint is 16 lower-case hex digits; component_id the smallest doc_id
    reachable through links (null ids aside; null if no member has one); n_links
    counts the other fingerprints at max_bits or fewer, and is null where a
    segment is crowded or beside a crowded one, as links then join the group
    without being all of its pairs. Texts of any length are read whole; an empty
    or null one has fingerprint zero, linked like any other. Equal fingerprints
    are one node, so copies are never paired. Repeated rows stay, each with the
    same answer; other columns of docs are not read; an empty table gives none.
    """
    fps = cut(fingerprints(docs, id_col, text_col))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    crowded = crowded_keys(nodes)
    pairs = cut(links(nodes.select("fp"), max_bits, crowded).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    groups = connected_components(pairs, "a", "b").withColumnsRenamed({"node": "fp", "component": "group"})
    degrees = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    if crowded.take(1):
        members = nodes.select("fp", F.explode(_segments("fp", False)).alias("key")).join(small(crowded), "key").select("fp")
        partly = members.unionByName(_beside(nodes, crowded).select("fp")).distinct().withColumn("partly", F.lit(True))
        degrees = degrees.join(partly, "fp", "left").select("fp", F.when(F.col("partly").isNull(), F.col("n_links")).alias("n_links"), F.lit(True).alias("linked"))
    else:
        degrees = degrees.withColumn("linked", F.lit(True))
    # Only nodes with a link have anything to join, and they are few.
    linked = nodes.join(groups, "fp").join(degrees, "fp")
    linked = linked.join(linked.groupBy("group").agg(F.min("least").alias("first")), "group").select("fp", "first", "n_links", "linked")
    # A document that shares its fingerprint with none and has no link is its own group, so it meets no other table.
    shared = nodes.join(linked, "fp", "left").where((F.col("copies") > 1) | F.col("linked").isNotNull())
    shared = shared.select("fp", F.lit(True).alias("known"), F.when(F.col("linked").isNull(), F.col("least")).otherwise(F.col("first")).alias("component_id"), F.when(F.col("linked").isNull(), 0).otherwise(F.col("n_links")).alias("n_links"))
    out = fps.join(small(cut(shared)), "fp", "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id"))
    n_links = F.when(F.col("known"), F.col("n_links")).otherwise(0).cast("long")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"), n_links.alias("n_links"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs, with its columns, of which one document of each group stays: the one with the smallest id.

    Of rows that repeat an id the first by text stays (a null text first).
    Rows without an id never stand for a group; they stay, one for each equal
    fingerprint, only where their group has no row with an id. Columns may have
    any names; texts of any length are read whole; an empty table stays empty.
    """
    docs, back, names = aside(docs)
    id_col, text_col = names[id_col], names[text_col]
    groups = cut(simhash_groups(docs, id_col, text_col, max_bits))
    keep = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__keep")).distinct()
    named = docs.join(keep, F.col(id_col) == F.col("__keep"), "left_semi")
    order = Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_first())
    named = named.withColumn("__row", F.row_number().over(order)).where("__row = 1").drop("__row")
    orphans = groups.where(F.col("component_id").isNull()).select(F.conv("fingerprint", 16, -10).cast("long").alias("__keep")).distinct()
    if not orphans.take(1):
        return named.select(*back)
    bare = docs.where(F.col(id_col).isNull()).withColumn("__fp", fingerprint_of(text_col)).join(orphans, F.col("__fp") == F.col("__keep"), "left_semi")
    order = Window.partitionBy("__fp").orderBy(F.col(text_col).asc_nulls_first())
    return named.unionByName(bare.withColumn("__row", F.row_number().over(order)).where("__row = 1").drop("__row", "__fp")).select(*back)
