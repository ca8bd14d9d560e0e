"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame and SQL functions only.

The plan, from the bottom up:

1. Every document falls, by a keyed hash, into one of its source's blocks. As
   the hash is uniform, a block is a random, disjoint part of its source.
2. A source's target is met by whole passes over its blocks and, for the rest,
   by its blocks in a keyed order up to the target; the block in which the
   target falls is drawn up to it, document by document in keyed order.
3. The drawn blocks of all sources are dealt out to 2^levels output shards. A
   tree splits each node's block quotas in two by multivariate-hypergeometric
   draws, as if its blocks had been shuffled and cut in half; quotas stay exact.
4. A shard takes its quota of each source's draws in keyed order, and its
   documents are shuffled locally by a keyed hash.

What is gathered grows with sources and blocks alone; there are at most
MAX_BLOCKS blocks and one more for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import aside, cut, small, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
SEED = 1
#: Words of a block, at least; beyond MAX_BLOCKS of them blocks become longer.
BLOCK_WORDS, MAX_BLOCKS = 20_000, 65_536
#: Words of an output shard, roughly.
SHARD_WORDS = 4_000_000

def hash32(*parts: Column) -> Column:
    """A uniform number below 2^32 from md5, the same in other SQL engines."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, words) with rank, weight and target of each source.

    Sources in code-point order, null last, weigh ``weights`` in turn. Targets
    share the sum of all words by weight; none exceeds max_repeat times its
    source's words, and the excess is shared again by weight until none does.
    The sources at that limit are those with the least limit for their weight,
    so one pass in that order finds them.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    rows = sources.withColumn("rank", rank)
    n = len(weights)
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % n + 1))
    rows = rows.withColumn("limit", (F.col("words") * max_repeat).cast("double")).withColumn("ratio", F.col("limit") / F.col("weight"))
    order = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rest = F.sum("words").over(whole).cast("double") - F.coalesce(F.sum("limit").over(order), F.lit(0.0))
    heft = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(order), F.lit(0.0))
    rows = rows.withColumn("level", rest / heft).withColumn("full", F.col("ratio") <= F.col("level"))
    level = F.min(F.when(~F.col("full"), F.struct("ratio", "rank", "level"))).over(whole)["level"]
    return rows.withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(level * F.col("weight"))).drop("limit", "ratio", "level", "full")


def _draw_sql(good: str, bad: str, need: str, u: str) -> str:
    """SQL for how many of ``need`` draws without replacement from good + bad are good, by inversion.

    The distribution is walked from its mode upwards and then downwards, twelve
    standard deviations or to its ends, with probabilities relative to the
    mode's, so that no number overflows however many blocks there are.
    """
    base = f"""named_struct('g', {good}, 'b', {bad}, 'n', {need}, 'lo', greatest(0L, {need} - {bad}), 'hi', least({good}, {need}),
        'm', greatest(greatest(0L, {need} - {bad}), least(least({good}, {need}), cast(floor(({need} + 1D) * ({good} + 1D) / ({good} + {bad} + 2D)) as bigint))),
        'w', cast(ceil(12 * sqrt({need} * 1D * {good} * {bad} / (({good} + {bad} + 1D) * ({good} + {bad} + 1D)))) as bigint) + 12L)"""
    step = """transform(array(a.p), p -> transform(array(
            case when j = 0 then p.m when j <= least(p.hi - p.m, p.w) then p.m + j when j = least(p.hi - p.m, p.w) + 1 then p.m - 1 else a.x - 1 end), x ->
        named_struct('x', x, 'q', case when j = 0 then 1D
            when j <= least(p.hi - p.m, p.w) then a.q * (p.g - x + 1D) * (p.n - x + 1D) / (x * 1D * (p.b - p.n + x))
            else if(j = least(p.hi - p.m, p.w) + 1, 1D, a.q) * (x + 1D) * (p.b - p.n + x + 1D) / ((p.g - x) * 1D * (p.n - x)) end)))[0][0]"""
    steps = "sequence(0L, least({p}.hi - {p}.m, {p}.w) + least({p}.m - {p}.lo, {p}.w))"
    total = f"""aggregate({steps.format(p='p0')}, named_struct('p', p0, 'x', 0L, 'q', 1D, 'cum', 0D),
        (a, j) -> transform(array({step}), s -> named_struct('p', a.p, 'x', s.x, 'q', s.q, 'cum', a.cum + s.q))[0])"""
    pick = f"""aggregate({steps.format(p='t.p')}, named_struct('p', t.p, 'x', 0L, 'q', 1D, 'cum', 0D, 'aim', {u} * t.cum, 'got', cast(null as bigint)),
        (a, j) -> transform(array({step}), s -> named_struct('p', a.p, 'x', s.x, 'q', s.q, 'cum', a.cum + s.q, 'aim', a.aim,
            'got', coalesce(a.got, if(a.cum + s.q >= a.aim, s.x, cast(null as bigint)))))[0], a -> coalesce(a.got, t.p.m))"""
    return f"transform(transform(array({base}), p0 -> {total}), t -> {pick})[0]"


def quotas(blocks: DataFrame, levels: int, seed: int = SEED) -> DataFrame:
    """(shard, rank, quota) for blocks(rank, n): each source's n drawn blocks over 2^levels shards, exact in sum.

    Shards differ by one block at most.
    """
    node = blocks.groupBy().agg(F.sort_array(F.collect_list(F.struct("rank", "n"))).alias("k")).select(F.lit(0).cast("long").alias("shard"), "k").where(F.size("k") > 0)
    draw = _draw_sql("k[i].n", "(acc.rest - k[i].n)", "acc.need", f"(cast(conv(substring(md5(concat_ws(':', {seed}, 'split', depth, shard, k[i].rank)), 1, 8), 16, 10) as double) + 0.5D) / 4294967296D")
    for depth in range(levels):
        # A node's odd block goes left or right by its own hash.
        half = f"""aggregate(k, 0L, (s, x) -> s + x.n) div 2 + if(aggregate(k, 0L, (s, x) -> s + x.n) % 2 = 1, cast(conv(substring(md5(concat_ws(':', {seed}, 'odd', {depth}, shard)), 1, 8), 16, 10) as bigint) % 2, 0L)"""
        left = f"""aggregate(sequence(0, size(k) - 1), named_struct('took', cast(array() as array<bigint>), 'rest', aggregate(k, 0L, (s, x) -> s + x.n), 'need', {half}),
            (acc, i) -> transform(array({draw.replace('depth', str(depth))}), x -> named_struct('took', array_append(acc.took, x), 'rest', acc.rest - k[i].n, 'need', acc.need - x))[0], acc -> acc.took)"""
        node = node.withColumn("took", F.expr(left))
        node = node.select("shard", F.explode(F.expr("array(named_struct('side', 0L, 'k', transform(k, (x, i) -> named_struct('rank', x.rank, 'n', took[i]))), named_struct('side', 1L, 'k', transform(k, (x, i) -> named_struct('rank', x.rank, 'n', x.n - took[i]))))")).alias("c"))
        node = cut(node.select((F.col("shard") * 2 + F.col("c.side")).alias("shard"), F.col("c.k").alias("k")))
    return node.select("shard", F.explode("k").alias("k")).select("shard", F.col("k.rank").alias("rank"), F.col("k.n").alias("quota")).where("quota > 0")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """The rows of docs with __size, __source_size, __target and __draws: one (copy, shard, position) for each time the mix takes the row.

    A source's words are those of its documents; null is a source of its own. A
    null text has no words. Each source's taken words miss its target by less
    than one document. Rows that repeat an id are hashed alike, and rows without
    an id by their text; empty tables give no rows. Runs with one seed agree.
    Columns that begin with two underscores are the plan's own, see mix for docs
    that have such.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    rows = docs.withColumn("__size", word_count(F.col(text_col))).withColumn("__u", hash32(F.lit(seed), key))
    narrow = cut(rows.select(F.col(source_col).alias("source"), "__u", F.col(id_col).cast("string").alias("id"), F.col("__size").alias("size")))
    sources = targets(narrow.groupBy("source").agg(F.sum("size").alias("words")), weights, max_repeat)
    per_block = F.greatest(F.lit(float(BLOCK_WORDS)), F.sum("words").over(Window.partitionBy()) / F.lit(float(MAX_BLOCKS)))
    sources = sources.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("words") / per_block)).cast("long"))
    sources = sources.withColumn("passes", F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0).cast("long"))
    sources = cut(sources.withColumn("rest", F.col("target") - F.col("passes") * F.col("words")))

    block_of = F.shiftright(F.col("__u") * F.col("n_blocks"), 32).alias("block")
    sized = narrow.join(small(sources.withColumnRenamed("source", "__s")), F.col("source").eqNullSafe(F.col("__s"))).select("rank", "rest", "passes", block_of, "__u", "id", "size")
    blocks = sized.groupBy("rank", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("passes").alias("passes"))
    turn = F.md5(F.concat_ws(":", F.lit(seed), F.lit("block"), "rank", "block"))
    order = Window.partitionBy("rank").orderBy(turn, "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
    left = F.col("rest") - F.col("before")
    blocks = cut(blocks.withColumn("part", F.when(left >= F.col("words"), "all").when(left > 0, "some").otherwise("none")).withColumn("left", left).drop("before", "rest"))

    # The block of each source in which its target falls is drawn document by document.
    edge = blocks.where("part = 'some'").select(F.col("rank").alias("r"), F.col("block").alias("b"), "left")
    inside = sized.join(small(edge), (F.col("rank") == F.col("r")) & (F.col("block") == F.col("b")))
    # Documents with one place in the order are taken together.
    places = inside.groupBy("rank", "__u", F.coalesce("id", F.lit("")).alias("id"), "left").agg(F.sum("size").alias("size"))
    in_turn = Window.partitionBy("rank").orderBy("__u", "id").rowsBetween(Window.unboundedPreceding, -1)
    places = places.withColumn("before", F.coalesce(F.sum("size").over(in_turn), F.lit(0)))
    # Half of a document or more before the target: nearest to it.
    last = places.where(F.col("before") * 2 + F.col("size") <= F.col("left") * 2).groupBy("rank").agg(F.max(F.struct("__u", "id")).alias("last"))
    last = cut(last)

    # Which of a source's passes holds which block, dealt out to the shards by quota.
    times = F.col("passes") + F.when(F.col("part") == "none", 0).otherwise(1)
    draws = blocks.where(times > 0).select("rank", "block", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)).alias("copy"))
    draw_turn = F.md5(F.concat_ws(":", F.lit(seed), F.lit("draw"), "rank", "block", "copy"))
    draws = cut(draws.withColumn("turn", F.row_number().over(Window.partitionBy("rank").orderBy(draw_turn, "block", "copy")).cast("long")))
    total = narrow.agg(F.sum("size")).first()[0] or 0
    # A shard has a block at least, of which there are MAX_BLOCKS and a few; beyond that many shards, shards grow.
    levels = min((int(total) // SHARD_WORDS).bit_length(), max(0, draws.count().bit_length() - 1))
    dealt = quotas(draws.groupBy("rank").agg(F.count("*").alias("n")), levels, seed)
    ahead = F.coalesce(F.sum("quota").over(Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seats = dealt.withColumn("ahead", ahead).select("rank", "shard", F.explode(F.sequence(F.col("ahead") + 1, F.col("ahead") + F.col("quota"))).alias("turn"))
    placed = draws.join(seats, ["rank", "turn"]).groupBy("rank", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("draws"))
    plan = blocks.select("rank", "block", "part", "passes").join(placed, ["rank", "block"], "left").join(last, "rank", "left")
    plan = cut(plan.select(*[F.col(c).alias(f"__{c}") for c in ("rank", "block", "part", "passes", "draws", "last")])).withColumnsRenamed({"__rank": "__r", "__block": "__b"})

    named = sources.select(F.col("source").alias("__s"), F.col("rank").alias("__rank"), F.col("n_blocks").alias("__n_blocks"), F.col("words").alias("__source_size"), F.col("target").alias("__target"))
    out = rows.join(small(named), F.col(source_col).eqNullSafe(F.col("__s")))
    out = out.withColumn("__block", F.shiftright(F.col("__u") * F.col("__n_blocks"), 32))
    out = out.join(small(plan), (F.col("__rank") == F.col("__r")) & (F.col("__block") == F.col("__b")))
    place = F.struct("__u", F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"))
    extra = (F.col("__part") == "all") | ((F.col("__part") == "some") & F.coalesce(place <= F.col("__last"), F.lit(False)))
    none = F.expr("cast(array() as array<struct<copy:bigint,shard:bigint>>)")
    taken = F.filter(F.coalesce("__draws", none), lambda d: (d["copy"] < F.col("__passes")) | extra)
    position = lambda d: hash32(F.lit(seed), F.lit("place"), key, d["copy"])
    draws_of = F.transform(taken, lambda d: F.struct(d["copy"].alias("copy"), d["shard"].alias("shard"), position(d).alias("position")))
    return out.select(*docs.columns, "__size", "__source_size", "__target", draws_of.alias("__draws"))


def mix(docs: DataFrame, n_partitions: int | None = None, **options) -> DataFrame:
    """The mix itself: the rows of docs, with its columns, each as often as it is taken, whole shards together and shuffled locally.

    Columns may have any names. A null or empty text has no words, and is taken
    with its block as others are; repeated rows are taken alike; null is a
    source of its own; an empty table gives no rows. Texts are not read but for
    their words, so their length is free.
    """
    docs, back, names = aside(docs)
    plan = mix_plan(docs, **{k: names[options.get(k, d)] for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}, **{k: v for k, v in options.items() if not k.endswith("_col")})
    rows = plan.select(*docs.columns, F.explode("__draws").alias("__d"))
    rows = rows.repartitionByRange(n_partitions, "__d.shard", "__d.position") if n_partitions else rows.repartitionByRange("__d.shard", "__d.position")
    return rows.sortWithinPartitions("__d.shard", "__d.position").select(*back)


#: The same plan up to each document's taken words, for DuckDB; shards and positions aside.
ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 8))::BIGINT AS u
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS words FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM s0),
s2 AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, (words * {MAX_REPEAT})::DOUBLE AS lim FROM s1),
s3 AS (SELECT *, lim / weight AS ratio FROM s2),
s4 AS (SELECT *, (sum(words) OVER ())::DOUBLE AS total, (sum(weight) OVER ())::DOUBLE AS heft,
    coalesce(sum(lim) OVER w, 0.0::DOUBLE) AS lim_before, coalesce(sum(weight) OVER w, 0.0::DOUBLE) AS weight_before
  FROM s3 WINDOW w AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s5 AS (SELECT *, (total - lim_before) / (heft - weight_before) AS level FROM s4),
s6 AS (SELECT *, CASE WHEN ratio <= level THEN lim ELSE weight * (SELECT arg_min(level, ratio) FROM s5 WHERE ratio > level) END AS target FROM s5),
s7 AS (SELECT *, greatest(1, ceil(words / greatest({BLOCK_WORDS}.0::DOUBLE, total / {MAX_BLOCKS}.0::DOUBLE)))::BIGINT AS n_blocks,
    CASE WHEN words > 0 THEN floor(target / words)::BIGINT ELSE 0 END AS passes FROM s6),
s8 AS (SELECT *, target - passes * words AS rest FROM s7),
p AS (SELECT d.*, s8.rank, s8.words AS source_size, s8.target, s8.rest, s8.passes, (u * n_blocks) >> 32 AS block FROM d JOIN s8 ON d.source IS NOT DISTINCT FROM s8.source),
b AS (SELECT rank, block, sum(size)::BIGINT AS words, any_value(rest) AS rest FROM p GROUP BY rank, block),
b1 AS (SELECT *, rest - coalesce(sum(words) OVER (PARTITION BY rank ORDER BY md5('{SEED}:block:' || rank || ':' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS remains FROM b),
q AS (SELECT p.*, b1.remains, b1.words AS block_words FROM p JOIN b1 USING (rank, block)),
e AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY rank ORDER BY u, coalesce(doc_id::VARCHAR, '') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM q WHERE remains > 0 AND remains < block_words),
z AS (SELECT rank, max(u) AS last FROM e WHERE before * 2 + size <= remains * 2 GROUP BY rank)
SELECT doc_id, size, source_size, target,
  (size * (passes + CASE WHEN remains >= block_words THEN 1 WHEN remains > 0 AND u <= coalesce(last, -1) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM q LEFT JOIN z USING (rank)
"""
