"""Dashboard counts, the research-versus-patents matrix, and collaboration suggestions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.graph import cofiled
from corvane.schemas import KINDS, RESEARCH_KINDS


#: Organisations of a block: two blocks of a cell meet at a time, so that no key makes more than about BLOCK ** 2 pairs.
BLOCK = 1000
#: Ids of a piece of a digest's text.
PIECE_IDS = 100
#: Cells of a word of a bitmap. A word is never negative.
WORD_BITS = 62


def totals(records: DataFrame) -> DataFrame:
    """One row: all records, and those of each kind."""
    return records.agg(F.count("*").alias("total"), *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])


def count_by(records: DataFrame, column: str, name: str) -> DataFrame:
    """(name, n): records of each value of a list column. Records with several values count for each."""
    return records.select(F.explode(column).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def top_orgs(records: DataFrame) -> DataFrame:
    """(org, n) by falling count and then name, all of them."""
    return count_by(records, "orgs", "org").orderBy(F.desc("n"), "org")


def axis(records: DataFrame, column: str, name: str) -> DataFrame:
    """The distinct values of a list column."""
    return records.select(F.explode(column).alias(name)).where(F.col(name).isNotNull()).distinct()


def cells(records: DataFrame) -> DataFrame:
    """(mineral, stage, kind) for each pair of labels of each record; a label that a record repeats counts as often."""
    return records.select("kind", "stage_ids", F.explode("mineral_ids").alias("mineral")).select("mineral", F.explode("stage_ids").alias("stage"), "kind")


def _counted(records: DataFrame, **measures: Column) -> DataFrame:
    """(mineral, stage, measures) in one pass over the records; a label without the other kind has a row with a null."""
    outer = records.select("kind", "stage_ids", F.explode_outer("mineral_ids").alias("mineral")).select("mineral", F.explode_outer("stage_ids").alias("stage"), "kind")
    return outer.groupBy("mineral", "stage").agg(*[m.alias(n) for n, m in measures.items()])


def _completed(counted: DataFrame, minerals: DataFrame | None, stages: DataFrame | None, names: list[str]) -> DataFrame:
    """The counts over all pairs of two label axes, zeros included. Axes are taxonomy labels, so their product is bounded by the taxonomy, not by the records."""
    # Observed axes come from the counted cells, whose shuffle the three uses share, so that the records are read once.
    minerals = minerals if minerals is not None else counted.select("mineral").where("mineral is not null").distinct()
    stages = stages if stages is not None else counted.select("stage").where("stage is not null").groupBy().agg(F.collect_set("stage").alias("s")).select(F.explode("s").alias("stage"))
    # A row for each mineral with the list of stages: a grid without a product of unbounded sides.
    listed = stages.groupBy().agg(F.collect_set("stage").alias("stages"))
    grid = minerals.select("mineral", F.lit(0).alias("all")).join(F.broadcast(listed.withColumn("all", F.lit(0))), "all").select("mineral", F.explode("stages").alias("stage"))
    out = grid.join(counted, ["mineral", "stage"], "left")
    return out.select("mineral", "stage", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])


def heatmap(records: DataFrame, minerals: DataFrame | None = None, stages: DataFrame | None = None) -> DataFrame:
    """(mineral, stage, n) over the whole grid of the axes, zeros included."""
    return _completed(_counted(records, n=F.count("*")), minerals, stages, ["n"])


def heatmap_wide(records: DataFrame, stages: list[str]) -> DataFrame:
    """A row for each mineral, a column for each stage."""
    return cells(records).groupBy("mineral").pivot("stage", stages).count().na.fill(0)


def matrix(records: DataFrame, minerals: DataFrame | None = None, stages: DataFrame | None = None) -> DataFrame:
    """(mineral, stage, patents, research) over the grid: research kinds count as research and all others as patents."""
    research = F.coalesce(F.col("kind").isin(*RESEARCH_KINDS), F.lit(False))
    return _completed(_counted(records, patents=F.count_if(~research), research=F.count_if(research)), minerals, stages, ["patents", "research"])


def whitespace(cells_: DataFrame) -> DataFrame:
    """matrix() with gap, neglected and rank: by falling gap, then rising total, mineral and stage. The grid is bounded by the taxonomy."""
    out = cells_.withColumns({"gap": F.col("research") - F.col("patents"), "neglected": (F.col("research") + F.col("patents")) == 0})
    order = Window.orderBy(F.desc("gap"), F.col("patents") + F.col("research"), "mineral", "stage")
    return out.withColumn("rank", F.row_number().over(order).cast("long"))


def activity(records: DataFrame) -> DataFrame:
    """(org, mineral, stage), each once: where an organisation is active."""
    return records.select(F.explode("orgs").alias("org"), "mineral_ids", "stage_ids").select("org", F.explode("mineral_ids").alias("mineral"), "stage_ids").select("org", "mineral", F.explode("stage_ids").alias("stage")).distinct()


def _numbered(own: DataFrame) -> DataFrame:
    """(mineral, stage, cell): the cells of activity() in order, from 0. They are pairs of taxonomy labels, bounded as those are."""
    place = F.row_number().over(Window.orderBy("mineral", "stage"))
    return own.select("mineral", "stage").where("mineral is not null and stage is not null").distinct().withColumn("cell", place - 1)


def _bitmaps(numbered: DataFrame) -> DataFrame:
    """(org, bits): the cells of each organisation as words of WORD_BITS."""
    word = F.expr(f"cell div {WORD_BITS}").cast("int")
    words = numbered.groupBy("org", word.alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cell % {WORD_BITS})")).alias("bits"))
    held = words.groupBy("org").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"), F.max("word").alias("last"))
    return held.select("org", F.transform(F.sequence(F.lit(0), F.col("last")), lambda w: F.coalesce(F.try_element_at("held", w), F.lit(0).cast("long"))).alias("bits"))


def _lowest(bits: Column) -> Column:
    """The lowest cell of a bitmap; null where it is empty."""
    at = F.array_position(F.transform(bits, lambda x: x != 0), True)
    word = F.try_element_at(bits, at.cast("int"))
    return F.when(at > 0, (at - 1) * WORD_BITS + F.bit_count(F.bitwise_not(word).bitwiseAND(word - 1)))


def _cells_of(bits: Column) -> Column:
    """The cells of a bitmap, in order."""
    own = lambda x, w: F.transform(F.filter(F.sequence(F.lit(0), F.lit(WORD_BITS - 1)), lambda b: F.getbit(x, b) == 1), lambda b: w * WORD_BITS + b)
    return F.flatten(F.transform(bits, own))


def _partners(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((org_a, org_b, bits), cells): each pair of organisations, org_a before org_b, that share a cell and never filed together, once, with the bitmap of the cells they share.

    Organisations of a cell are dealt out to blocks by the cell's own count, and
    a pair of blocks meets under a key of its own, each pair of blocks once. A
    pair of organisations is made in the first cell that both have and nowhere
    else, so that no pairs need to be made alike, and those that filed together
    go before any cell is listed.
    """
    own = activity(records)
    cells = _numbered(own)
    numbered = own.where("org is not null").join(cells, ["mineral", "stage"]).select("org", "cell")
    sized = numbered.join(numbered.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "cell")
    placed = sized.join(_bitmaps(numbered), "org").withColumn("block", F.pmod(F.xxhash64("org"), F.col("blocks")))
    left = placed.select("cell", F.col("org").alias("a"), F.col("bits").alias("a_bits"), F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"))
    right = placed.select("cell", F.col("org").alias("b"), F.col("bits").alias("b_bits"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("block"))).alias("i"), F.col("block").alias("j"))
    both = F.zip_with("a_bits", "b_bits", lambda x, y: F.coalesce(x.bitwiseAND(y), F.lit(0).cast("long")))
    met = left.join(right, ["cell", "i", "j"]).where("i < j or a < b").withColumn("bits", both).where(_lowest(F.col("bits")) == F.col("cell"))
    pairs = met.select(F.least("a", "b").alias("org_a"), F.greatest("a", "b").alias("org_b"), "bits")
    return pairs.join(cofiled(records).distinct(), ["org_a", "org_b"], "left_anti"), cells


def collaborations(records: DataFrame) -> DataFrame:
    """(org_a, org_b, mineral, stage), org_a before org_b: cells in which two organisations are active that never filed together. No product of all organisations is made."""
    pairs, cells = _partners(records)
    each = pairs.select("org_a", "org_b", F.explode(_cells_of(F.col("bits"))).alias("cell"))
    return each.join(cells, "cell").select("org_a", "org_b", "mineral", "stage")


def collaboration_pairs(records: DataFrame) -> DataFrame:
    """(org_a, org_b, shared): the pairs with their sorted shared cells, in order."""
    pairs, cells = _partners(records)
    # The cells' names are one row, as many as the taxonomy has pairs of labels.
    names = cells.groupBy().agg(F.array_sort(F.collect_list(F.struct("cell", "mineral", "stage"))).alias("names")).withColumn("all", F.lit(0))
    named = pairs.withColumn("all", F.lit(0)).join(F.broadcast(names), "all")
    cell = lambda c: F.struct(F.get("names", c)["mineral"].alias("mineral"), F.get("names", c)["stage"].alias("stage"))
    return named.select("org_a", "org_b", F.transform(_cells_of(F.col("bits")), cell).alias("shared")).orderBy("org_a", "org_b")


def org_profile(records: DataFrame, org: str, order: list[str]) -> DataFrame:
    """One row: how many records an organisation has, their ids in corpus order, and the organisations it filed with."""
    own = records.where(F.array_contains("orgs", org))
    listed = own.agg(F.count("*").alias("record_count"), F.transform(F.array_sort(F.collect_list(F.struct(*order, "doc_id"))), lambda x: x["doc_id"]).alias("record_ids"))
    others = own.select(F.explode("orgs").alias("o")).where(F.col("o") != org).agg(F.array_sort(F.collect_set("o")).alias("co_orgs"))
    return listed.crossJoin(others).select(F.lit(org).alias("org"), "*")


def org_records(records: DataFrame, org: str, order: list[str]) -> DataFrame:
    """The records of an organisation in rows, with the columns of an order and doc_id: for one that has more than a row of org_profile() ought to hold. ordering.ranked_table() numbers them."""
    return records.where(F.array_contains("orgs", org)).select(*order, "doc_id")


def org_partners(records: DataFrame, org: str) -> DataFrame:
    """(org, n): the organisations that one filed with, and on how many records."""
    own = records.where(F.array_contains("orgs", org)).select(F.explode(F.array_distinct("orgs")).alias("org"))
    return own.where(F.col("org") != org).groupBy("org").agg(F.count("*").alias("n"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(org, first, last, n, ids): runs of sorted (org, doc_id), their ids joined by commas."""
    for batch in batches:
        out = []
        for org, run in groupby(zip(*(c.to_pylist() for c in batch.columns), strict=True), lambda r: r[0]):
            ids = [r[1] for r in run]
            for part in (ids[k : k + PIECE_IDS] for k in range(0, len(ids), PIECE_IDS)):
                said = [x for x in part if x is not None]
                out.append((org, part[0], part[-1], len(part), ",".join(said) if said else None))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], ["org", "first", "last", "n", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(org, record_count, ids) of sorted pieces, whose text streams by."""
    rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("org", "n", "ids")), strict=True))
    for org, run in groupby(rows, lambda r: r[0]):
        md5, count, gap = hashlib.md5(), 0, b""
        for _, n, ids in run:
            count += n
            if ids is not None:
                md5.update(gap + ids.encode())
                gap = b","
        yield pa.RecordBatch.from_pydict({"org": [org], "record_count": pa.array([count], pa.int64()), "ids": [md5.hexdigest()]})


def org_digests(records: DataFrame, asked: DataFrame, path: str) -> DataFrame:
    """(name, org, record_count, ids, co_orgs) for asked(name, org): org_profile() of several organisations in one pass, ids being the MD5 of the sorted record ids, joined by commas.

    The records asked for are written under a path. Ranges of ids are sorted
    apart; an MD5 goes from front to back, so that one task has an
    organisation's sorted text, of which it holds no more than a batch.
    """
    wanted = F.array(*[F.lit(r["org"]) for r in asked.select("org").distinct().collect()])
    each = records.select("doc_id", "orgs", F.explode(F.array_intersect("orgs", wanted)).alias("org"))
    each.write.mode("overwrite").parquet(path)
    each = records.sparkSession.read.schema(each.schema).parquet(path)
    pieces = each.select("org", "doc_id").orderBy("org", "doc_id").mapInArrow(_pieces, "org string, first string, last string, n long, ids string")
    # Pieces that begin with the same id are told apart by their last.
    digests = pieces.repartition("org").sortWithinPartitions("org", "first", "last").mapInArrow(_digests, "org string, record_count long, ids string")
    others = each.select("org", F.explode("orgs").alias("o")).where("o <> org").groupBy("org").agg(F.array_sort(F.collect_set("o")).alias("co_orgs"))
    out = asked.join(digests, "org", "left").join(others, "org", "left")
    return out.select("name", "org", F.coalesce("record_count", F.lit(0)).alias("record_count"), F.coalesce("ids", F.md5(F.lit(""))).alias("ids"), F.coalesce("co_orgs", F.expr("cast(array() as array<string>)")).alias("co_orgs"))
