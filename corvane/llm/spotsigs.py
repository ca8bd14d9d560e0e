"""SpotSigs fingerprints: chains of content words after common-word anchors, compared by pruned Jaccard."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import texts, written

# Common words of English, German, French and Spanish. They anchor chains and never stand in one.
ANCHORS = frozenset(
    """a an and are as at be been but by can do for from had has have he her his i if in is it its my no not of on or our she so that
    the their them there they this to up was we were what when which who will with would you your
    aber als am auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist kann mit nach nicht
    noch nur oder sich sie sind so um und von vor war wenn wie wird zu zum zur über
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que
    qui sa se ses son sont sur un une vous été
    al como con cuando del desde donde el ella en entre era eran es esta este fue han hay la las lo los más me mi muy no o para pero
    por porque que se ser si sin sobre son su sus también un una y ya""".encode().split()
)
CHAIN, DISTANCE = 2, 1
#: Set lengths of one partition differ by less than this share, so that sets alike enough stand in one or the next.
SIMILARITY = 0.8
# ASCII letters are lower-cased and other ASCII characters but digits part words.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def signatures(text: str) -> frozenset[bytes]:
    """The spot signatures of a whole text, as 8-byte hashes.

    Each anchor starts a chain of CHAIN content words, DISTANCE apart, among
    those that follow it. A text without any such chain has the chains of all
    its words in place of them; one with fewer words than a chain has its words
    as one signature, and one without words has the signature of none.
    """
    words = text.encode().translate(TABLE).split()
    content, anchored = [], []
    for w in words:
        if w in ANCHORS:
            anchored.append((w, len(content)))
        else:
            content.append(w)
    reach = CHAIN * DISTANCE
    last = len(content) - reach
    digest = xxhash.xxh64_digest
    found = frozenset([digest(b" ".join((a, *content[i + DISTANCE - 1 : i + reach : DISTANCE]))) for a, i in anchored if i <= last])
    if found:
        return found
    if len(words) < CHAIN:
        return frozenset([digest(b"\n" + b" ".join(words))])
    return frozenset([digest(b"\n" + b" ".join(words[i : i + CHAIN])) for i in range(len(words) - CHAIN + 1)])


def digest_of(found: frozenset[bytes]) -> str:
    """A set's fingerprint: 32 hex digits that equal sets share."""
    return hashlib.blake2b(b"".join(sorted(found)), digest_size=16).hexdigest()


def length_partition(n: int, similarity: float = SIMILARITY) -> int:
    """Sets of a Jaccard of ``similarity`` or more have lengths in one partition or in neighbouring ones."""
    return math.floor(math.log(n) / -math.log(similarity) + 1e-9) if n else -1


def jaccard(a: frozenset, b: frozenset, at_least: float = 0.0) -> float:
    """The sets' Jaccard similarity, or 0 where lengths alone show that it is below ``at_least``."""
    small, large = sorted((len(a), len(b)))
    if small < at_least * large or not large:
        return 0.0
    both = len(a & b)
    value = both / (small + large - both)
    return value if value >= at_least else 0.0


def edited_text(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many (or all) of the following one's."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


ROW = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, length_partition int"


def _compare(text: str, own: frozenset[bytes], following: str, other: frozenset[bytes]) -> tuple:
    edited = edited_text(text, following)
    changed = own if edited == text else signatures(edited)
    return len(text), hashlib.sha256(edited.encode()).hexdigest(), digest_of(own), digest_of(changed), jaccard(own, changed), jaccard(own, other), length_partition(len(own))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its fingerprint, and how like it are its edited text's and the next document's.

    Documents stand in ascending order of id (nulls first, rows that repeat an
    id by text), and the first follows the last; a null text is empty. Texts are
    shuffled once, by ranges of id, and each task holds two documents at a time:
    all but a range's last document meet their next one there, and the last and
    first of each range, two rows a task, meet in a second step.
    """
    names = [x.split()[0] for x in ROW.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32()]
    id_type = docs.schema[id_col].dataType.simpleString()

    def batch(ids: list, id_kind: pa.DataType, rows: list[tuple], part: int, first: str | None, last: str | None) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        pad = [None] * (len(ids) - len(rows))
        arrays = [pa.array([*c, *pad], k) for c, k in zip(columns, kinds, strict=True)]
        edge = lambda t: pa.array([None] * len(rows) + [t] * len(pad), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(ids, id_kind), *arrays, pa.array([part] * len(ids), pa.int32()), edge(first), edge(last)], names=["doc_id", *names, "part", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, first, kind = None, None, None
        for b in batches:
            kind = b.column(0).type
            ids, rows = [], []
            for i, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                found = held[2] if held and held[1] == text else signatures(text)
                if held:
                    ids.append(held[0])
                    rows.append(_compare(held[1], held[2], text, found))
                else:
                    first = text
                held = (i, text, found)
            yield batch(ids, kind, rows, part, None, None)
        if held:
            yield batch([held[0]], kind, [], part, first, held[1])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartitionByRange("id").sortWithinPartitions("id", F.col("text").asc_nulls_first())
    done = written(rows.mapInArrow(run, f"doc_id {id_type}, {ROW}, part int, first string, last string"), "spotsigs")
    edges = done.where("n_chars is null").select("doc_id", "part", "first", "last")
    # One row for each task of the sort.
    whole, onward = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy("part")
    edges = edges.withColumn("next", F.coalesce(F.lead("first").over(onward), F.first("first").over(whole))).select("doc_id", "last", "next")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_compare(t, signatures(t), n, signatures(n)) for t, n in zip(texts(b.column(1)), texts(b.column(2)), strict=True)]
            out = batch(b.column(0).to_pylist(), b.column(0).type, rows, 0, None, None)
            yield out.select(["doc_id", *names])

    return done.where("n_chars is not null").select("doc_id", *names).unionByName(edges.mapInArrow(finish, f"doc_id {id_type}, {ROW}"))


def signature_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, sigs array<long>) of each row of docs, sigs sorted."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [signatures(t) for t in texts(b.column(1))]
            sigs = [sorted(int.from_bytes(s, "big", signed=True) for s in f) for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(digest_of, found), pa.string()), pa.array(sigs, pa.list_(pa.int64()))], names=["doc_id", "fingerprint", "sigs"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, fingerprint string, sigs array<long>")


def near_pairs(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, jaccard): distinct fingerprints whose sets have that Jaccard similarity or more.

    Equal sets are one fingerprint, see signature_sets for who has it. Sets are
    partitioned by length; signatures are ranked by how many sets hold them, and
    each set is entered under its rarest ones only: two sets alike enough share
    one of the first n - ceil(similarity * n) + 1. Pairs meet by equality of
    partition and signature, lengths prune, and whole sets are compared.
    """
    sets = written(signature_sets(docs, id_col, text_col).groupBy("fingerprint").agg(F.first("sigs").alias("sigs")), "sets")
    counts = sets.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("n"))
    ranked = sets.select("fingerprint", F.size("sigs").alias("size"), F.explode("sigs").alias("sig")).join(counts, "sig")
    place = F.row_number().over(Window.partitionBy("fingerprint").orderBy("n", "sig"))
    prefix = ranked.withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1)
    part = F.floor(F.ln("size") / -math.log(similarity) + 1e-9).cast("int")
    left = prefix.select(F.col("fingerprint").alias("a"), F.col("size").alias("size_a"), "sig", part.alias("part"))
    right = prefix.select(F.col("fingerprint").alias("b"), F.col("size").alias("size_b"), "sig", F.explode(F.array(part, part + 1)).alias("part"))
    # a is the longer set, b stands in its partition or the one below.
    longer = (F.col("size_a") > F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("a") < F.col("b")))
    met = left.join(right, ["part", "sig"]).where(longer & (F.col("size_b") >= F.col("size_a") * similarity - 1e-9)).select("a", "b").distinct()
    a, b = sets.select(F.col("fingerprint").alias("a"), F.col("sigs").alias("sa")), sets.select(F.col("fingerprint").alias("b"), F.col("sigs").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    value: Column = both / (F.size("sa") + F.size("sb") - both)
    return met.join(a, "a").join(b, "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), value.alias("jaccard")).where(F.col("jaccard") >= similarity)
