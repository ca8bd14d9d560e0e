"""Source divergence audit: which terms set a source apart, and how far sources of a language are from each other."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import LOWER, UPPER, cut, give_back, slices, small, utf8, written

#: Documents that a term of a language must occur in, the scale of shares, and the ranks reported of a group's terms.
LEAST_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Rows of a digit that are sorted rather than split by a further digit.
LEAF = 4096
#: Distinct terms that a task holds before it hands their counts on, and pairs of sources that it looks at at once.
HELD, PAIRS = 400_000, 400_000

#: ASCII letters in lower case and all bytes of longer characters stay; all else parts terms.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, n_docs) of (lang, source, text), added up within a task as far as HELD terms go."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in held.items():
            terms = pa.array(list(counts), pa.binary()).cast(pa.string())
            n = len(terms)
            same = [pa.array([x], pa.string()).take(pa.array(np.zeros(n, np.int32))) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*same, terms, pa.array(list(counts.values()), pa.int64()), pa.array([docs[t] for t in counts], pa.int64())], ["lang", "source", "term", "n", "n_docs"])
        held.clear()

    for batch in batches:
        for part in slices(batch, 1024, 8 << 20, text=2):
            for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), utf8(part.column(2)), strict=True):
                terms = text.translate(_BYTES).split()
                counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
                counts.update(terms)
                docs.update(set(terms))
            if sum(len(c) for c, _ in held.values()) > HELD:
                yield from flush()
    yield from flush()
    give_back()


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, n_lang, first): occurrences of each kept term in each source that has it, and in its language; first marks one row of each term."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = rows.mapInArrow(_count_terms, "lang string, source string, term string, n long, n_docs long")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    by = Window.partitionBy("lang", "term")
    counted = counted.withColumns({"n_lang": F.sum("n").over(by), "in_docs": F.sum("n_docs").over(by), "first": F.row_number().over(by.orderBy("source")) == 1})
    return counted.where(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "n_lang", "first")


def _share(n: str, total: str) -> Column:
    """1 + floor(SCALE * (n + 1) / total), exactly; 1 where there is nothing to share."""
    plain, wide = f"{SCALE}L * ({n} + 1) div {total}", f"cast({SCALE} as decimal(10,0)) * cast({n} + 1 as decimal(20,0)) div cast({total} as decimal(20,0))"
    return F.expr(f"case when {total} = 0 then 1L when {n} < 9000000000 then 1 + {plain} else 1 + {wide} end")


def _apart(p: str, q: str) -> Column:
    """floor((p - q)^2 / q). Shares are at most SCALE + 1, so that the square fits in a long."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def group_shares(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, sid, n_terms, total, lang_total, base) of every group that occurs; base is the share of a term that the group lacks."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_words"))
    langs = kept.groupBy("lang").agg(F.count_if("first").alias("n_terms"), F.sum(F.when(F.col("first"), F.col("n_lang"))).alias("lang_words"))
    out = groups.join(sums, ["lang", "source"], "left").join(small(langs), "lang", "left").na.fill(0, ["n_words", "n_terms", "lang_words"])
    out = out.select("lang", "source", "n_terms", (F.col("n_words") + F.col("n_terms")).alias("total"), (F.col("lang_words") + F.col("n_terms")).alias("lang_total"))
    return out.withColumns({"base": _share("0L", "total"), "sid": F.row_number().over(Window.partitionBy("lang").orderBy("source"))})


def _digit(at: int, value: str, item: str) -> Column:
    """The 16 bits of a row's sort key at a place: falling bits of its value, then rising bytes of its item, two by two."""
    if at < 4:
        return (F.lit(0xFFFF) - F.shiftrightunsigned(value, 48 - 16 * at).bitwiseAND(F.lit(0xFFFF).cast("long"))).cast("int")
    return F.conv(F.rpad(F.hex(F.substring(F.col(item).cast("binary"), 2 * (at - 4) + 1, 2)), 4, "0"), 16, 10).cast("int")


def radix_top(rows: DataFrame, keys: list[str], value: str, item: str, k: int, leaf: int = LEAF) -> DataFrame:
    """rows, with rank, of the k best of each group: by falling value (a long, 0 or more), then by item in UTF-8 order.

    Radix select: at each place of the sort key, a histogram of 16-bit digits,
    counted where the rows are, tells in which digit a group's kth row lies. Rows
    of better digits are in; those of worse ones are out; that digit alone is
    looked at again, one place further: first the value's bits, then, as rows of
    one value are tied, the item's bytes. No group is ever sorted; a digit with
    no more than leaf rows is left to the last step, which ranks what remains.
    Rows that repeat value and item stand next to each other, in any order.
    """
    most = rows.agg(F.max(value), F.max(F.octet_length(item))).first()
    if most[0] is None:
        return rows.withColumn("rank", F.lit(0)).limit(0)
    places, at = 4 + -(-most[1] // 2), (64 - int(most[0]).bit_length()) // 16
    left, inside = rows.withColumn("__need", F.lit(k).cast("long")), None
    while True:
        left = left.withColumn("__digit", _digit(min(at, places - 1), value, item))
        counts = left.groupBy(*keys, "__digit").agg(F.count("*").alias("__n"), F.max("__need").alias("__need"))
        upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__digit"))
        edge = counts.withColumn("__upto", upto).where("__upto >= __need and __upto - __n < __need")
        open_ = (F.col("__n") > F.lit(leaf)) & (F.col("__upto") > F.col("__need")) & F.lit(at < places - 1)
        edge = cut(edge.select(*keys, F.col("__digit").alias("__edge"), (F.col("__need") - F.col("__upto") + F.col("__n")).alias("__rest"), open_.alias("__open")))
        met = left.join(small(edge), keys, "left")
        # A group without an edge has fewer rows than it needs: all are in.
        is_in = F.col("__edge").isNull() | (F.col("__digit") < F.col("__edge")) | ((F.col("__digit") == F.col("__edge")) & ~F.col("__open"))
        some = met.where(is_in).select(*rows.columns)
        inside = some if inside is None else inside.unionByName(some)
        if not edge.where("__open").take(1):
            break
        left = cut(met.where("__open and __digit = __edge").select(*rows.columns, F.col("__rest").alias("__need")))
        at += 1
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), item))
    return inside.withColumn("rank", place).where(F.col("rank") <= k)


def telling_terms(kept: DataFrame, groups: DataFrame, top: int = TOP, leaf: int = LEAF) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a source has more of than its language, by how far."""
    rows = kept.join(small(groups.select("lang", "source", "total", "lang_total")), ["lang", "source"])
    rows = rows.withColumns({"p": _share("n", "total"), "q": _share("n_lang", "lang_total")}).where("p > q")
    rows = written(rows.select("lang", "source", F.col("term").alias("item"), _apart("p", "q").alias("value")), "telling")
    return radix_top(rows, ["lang", "source"], "value", "item", top, leaf)


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, value) of rows (lang, term, sid, p, base) in order of lang and term: what pairs of sources that share a term differ from their parts alone."""
    rest: pa.Table | None = None

    def sums(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        term, lang = (rows.column(c).combine_chunks().dictionary_encode() for c in ("term", "lang"))
        lang_id, names = lang.indices.to_numpy().astype(np.int64), lang.dictionary
        term_id = term.indices.to_numpy()
        new = np.flatnonzero(np.r_[True, (lang_id[1:] != lang_id[:-1]) | (term_id[1:] != term_id[:-1])])
        sizes = np.diff(np.r_[new, len(term_id)])
        begin, size = np.repeat(new, sizes), np.repeat(sizes, sizes)
        sid, p, base = (rows.column(c).to_numpy().astype(np.int64) for c in ("sid", "p", "base"))
        # Each row meets the rows of its term, so many rows at a time that their pairs stay few.
        cost, at = np.cumsum(size), 0
        while at < len(size):
            to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + PAIRS, side="right")))
            n = size[at:to]
            i = np.repeat(np.arange(at, to), n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[at:to], n)
            i, j = i[i != j], j[i != j]
            at = to
            if not len(i):
                continue
            apart = lambda x, y: (x - y) ** 2 // y
            value = apart(p[i], p[j]) - apart(p[i], base[j]) - apart(base[i], p[j]) + apart(base[i], base[j])
            order = np.lexsort((sid[j], sid[i], lang_id[i]))
            i, j, value = i[order], j[order], value[order]
            starts = np.flatnonzero(np.r_[True, (lang_id[i[1:]] != lang_id[i[:-1]]) | (sid[i[1:]] != sid[i[:-1]]) | (sid[j[1:]] != sid[j[:-1]])])
            i, j = i[starts], j[starts]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(lang_id[i])), pa.array(sid[i].astype(np.int32)), pa.array(sid[j].astype(np.int32)), pa.array(np.add.reduceat(value, starts))], ["lang", "a", "b", "value"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        last = (rows.column("lang")[-1].as_py(), rows.column("term")[-1].as_py())
        same = pc.and_(pc.equal(rows.column("lang"), last[0]), pc.equal(rows.column("term"), last[1]))
        whole = rows.num_rows - int(pc.sum(same).as_py())
        rest = rows.slice(whole)
        if whole:
            yield from sums(rows.slice(0, whole).combine_chunks())
    if rest is not None and rest.num_rows:
        yield from sums(rest.combine_chunks())


def source_pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): every other source of the language, farthest first.

    The value sums (p - q)^2 / q over all kept terms, but only terms that occur
    are looked at. A term that neither source has gives the same everywhere: the
    two bases' value, times the number of terms. Where one has it, the pair is
    corrected by that source's share against the other's base, once for each
    distinct share. Only where both have it their shares meet.
    """
    groups = small(groups)
    rows = kept.join(groups, ["lang", "source"]).select("lang", "term", "sid", _share("n", "total").alias("p"), "base")
    wide = "decimal(38,0)"
    ends = lambda side: groups.select("lang", F.col("sid").alias(side), F.col("base").alias(f"{side}_base"), *(["n_terms"] if side == "a" else []))
    bases = ends("a").join(small(ends("b")), "lang").where("a <> b").select("lang", "a", "b", (F.col("n_terms").cast(wide) * _apart("a_base", "b_base")).cast(wide).alias("value"))
    shares = rows.groupBy("lang", "sid", "p", "base").agg(F.count("*").cast("decimal(18,0)").alias("n"))
    met = shares.join(small(ends("b")), "lang").where("sid <> b")
    there = F.struct(F.col("sid").alias("a"), F.col("b"), (F.col("n") * (_apart("p", "b_base") - _apart("base", "b_base"))).cast(wide).alias("value"))
    back = F.struct(F.col("b").alias("a"), F.col("sid").alias("b"), (F.col("n") * (_apart("b_base", "p") - _apart("b_base", "base"))).cast(wide).alias("value"))
    ones = met.select("lang", F.explode(F.array(there, back)).alias("x")).select("lang", "x.a", "x.b", "x.value")
    both = rows.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_pair_sums, "lang string, a int, b int, value long")
    every = bases.unionByName(ones).unionByName(both.withColumn("value", F.col("value").cast(wide)))
    every = every.groupBy("lang", "a", "b").agg(F.sum("value").cast("long").alias("value"))
    named = lambda side, name: small(groups.select("lang", F.col("sid").alias(side), F.col("source").alias(name)))
    every = every.join(named("a", "source"), ["lang", "a"]).join(named("b", "item"), ["lang", "b"])
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return every.select("lang", "source", "item", "value", place.alias("rank"))


def audit(docs: DataFrame, top: int = TOP, leaf: int = LEAF, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs(lang, source, text).

    Null lang, source or text counts as empty, and the empty name is a name like
    any other. Terms are runs of ASCII letters and characters beyond ASCII, A-Z
    in lower case; a language keeps those in at least least_docs of its
    documents (repeated rows are documents of their own). Part `pair` has every
    ordered pair of a language's sources, 0 where the language keeps no term;
    part `term` the top terms that a source uses more than its language. All
    arithmetic is of integers. Ties go by the item's UTF-8 bytes. Texts of any
    length are read whole; other columns aren't read; an empty table gives no rows.
    """
    kept = written(term_counts(docs, least_docs), "terms")
    groups = cut(group_shares(docs, kept))
    pairs = source_pairs(kept, groups).withColumn("part", F.lit("pair"))
    terms = telling_terms(kept, groups, top, leaf).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).unionByName(terms.select(columns))


#: The same over the dense grid of groups and terms.
ORACLE_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
tok AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM tok GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST_DOCS}),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT lang, source, term, count(*) AS c FROM tok GROUP BY ALL),
g AS (SELECT lang, source, term, coalesce(c, 0)::HUGEINT AS c FROM grp JOIN kept USING (lang) LEFT JOIN cnt USING (lang, source, term)),
tot AS (SELECT lang, source, sum(c)::HUGEINT + count(*) AS n FROM g GROUP BY ALL),
p AS (SELECT lang, source, term, c, 1 + ({SCALE}::HUGEINT * (c + 1)) // n AS p FROM g JOIN tot USING (lang, source)),
l AS (SELECT lang, term, sum(c)::HUGEINT AS c FROM g GROUP BY ALL), ltot AS (SELECT lang, sum(c)::HUGEINT + count(*) AS n FROM l GROUP BY lang),
q AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (c + 1)) // n AS q FROM l JOIN ltot USING (lang)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM (SELECT * FROM pair UNION ALL SELECT * FROM term) QUALIFY part = 'pair' OR rank <= {TOP}"""
