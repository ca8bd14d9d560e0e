"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut, give_back, slices, utf8

#: Labelled rows that the index is built from, at most: those with the least keyed hash of their id. This bounds index, broadcast and driver.
MAX_EXAMPLES = 8000
#: Terms of the vocabulary: all whose presence tells about the label (chi-square) in enough examples; MAX_EXAMPLES bounds their number.
MIN_CHI2, MIN_TOXIC_DOCS, MIN_CLEAN_DOCS = 11.0, 5, 25
#: Beside whole words, their first characters are terms, which inflected forms share.
PREFIXES = (4, 5, 6, 7)
NEIGHBOURS, BLOCK = 25, 64
#: Blocks that a search meets before it has a floor; dot products below TINY are none, and cosines are compared to DIGITS.
FIRST_BLOCKS, TINY, DIGITS = 8, 1e-12, 12
#: A vote weighs 1 / (distance + SOFT); PRIOR_VOTES stand for the base rate.
SOFT, PRIOR_VOTES = 0.05, 0.5
#: How strongly calibration holds to leaving shares as they are.
PULL = 5.0
EVIDENCE = 3
#: Texts that are searched together, and their bytes unless one text alone has more.
BATCH, BATCH_BYTES = 256, 4 << 20
#: ASCII letters are lower-cased and other ASCII characters part words; the rest of Unicode stands in words.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The text and the word's number of every word of a column of texts without nulls, and the distinct words."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = data[int(offsets[0]) : int(offsets[-1])].to_pybytes().translate(TABLE) if data else b""
    # Bytes are replaced one by one, so offsets hold and what was UTF-8 is.
    plain = pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(raw)])
    parts = pc.ascii_split_whitespace(plain)
    coded = parts.values.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(column)), np.diff(parts.offsets.to_numpy().astype(np.int64)))
    some = pc.not_equal(coded.dictionary, "").to_numpy(False)[code] if len(code) else np.zeros(0, bool)
    return text[some], code[some], coded.dictionary


def terms_of(words: pa.Array) -> list[pa.Array]:
    """The terms of each of some words, lower-cased: itself, and its first characters or null where it has no more than those."""
    whole = pc.utf8_lower(words.cast(pa.string()))
    size = pc.utf8_length(whole)
    starts = [pc.binary_join_element_wise(pc.utf8_slice_codeunits(whole, 0, n), "*", "") for n in PREFIXES]
    return [whole, *(pc.if_else(pc.greater(size, n), s, None) for n, s in zip(PREFIXES, starts, strict=True))]


def presence(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The text and the term's number of each distinct term of each text, and the terms."""
    text, code, words = words_of(column)
    coded = pa.concat_arrays(terms_of(words)).dictionary_encode()
    number = pc.fill_null(coded.indices, -1).to_numpy(False).astype(np.int64).reshape(1 + len(PREFIXES), -1)
    n = len(coded.dictionary)
    pairs = np.unique(text * len(words) + code)
    found = number[:, pairs % max(1, len(words))]
    keys = np.unique(((pairs // max(1, len(words))) * n + found)[found >= 0])
    return keys // max(1, n), keys % max(1, n), coded.dictionary


def term_counts(column: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) in order, over whole texts; the term after the last is all words without a term, counted together."""
    text, code, words = words_of(column)
    found = [pc.fill_null(pc.index_in(t, value_set=terms), -1).to_numpy(False).astype(np.int64) for t in terms_of(words)]
    none = np.all([f < 0 for f in found], axis=0)
    n = len(terms) + 1
    keys = [(text * n + f[code])[f[code] >= 0] for f in found] + [(text * n + n - 1)[none[code]]]
    keys, counts = np.unique(np.concatenate(keys), return_counts=True)
    return keys // n, keys % n, counts


@dataclass
class Index:
    """Examples in blocks of BLOCK; of each block the terms it has, its examples' weights for them, and for each term the largest weight."""

    terms: list[np.ndarray]
    weights: list[np.ndarray]  # of each block: [its terms, examples]
    largest: np.ndarray  # [term, block]
    labels: np.ndarray
    ids: list

    @staticmethod
    def build(vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[int], ids: list, n_terms: int) -> Index:
        """Examples with the same heaviest terms are laid side by side, so that few blocks have large bounds; else their order stays."""
        order = sorted(range(len(vectors)), key=lambda i: (tuple(vectors[i][0][np.argsort(-vectors[i][1], kind="stable")][:4].tolist()), i))
        index = Index([], [], np.zeros((n_terms, max(1, -(-len(order) // BLOCK)))), np.array([labels[i] for i in order], np.int64), [ids[i] for i in order])
        for b in range(0, len(order), BLOCK):
            own = [vectors[i] for i in order[b : b + BLOCK]]
            terms = np.unique(np.concatenate([t for t, _ in own])).astype(np.int64)
            held = np.zeros((len(terms), len(own)))
            for k, (t, w) in enumerate(own):
                held[np.searchsorted(terms, t), k] = w
            index.terms.append(terms)
            index.weights.append(held)
            index.largest[terms, b // BLOCK] = held.max(axis=1, initial=0)
        return index

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """nearest_all of one query, given by its terms and their weights."""
        query = np.zeros((1, len(self.largest)))
        query[0, terms] = weights
        return self.nearest_all(query, [[skip] if skip >= 0 else []], k)[0]

    def nearest_all(self, queries: np.ndarray, skip: list[list[int]], k: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each row of queries[query, term] places and cosines of the k examples with the largest cosine above zero, ties by place; skip has the places that each leaves out.

        A block's bound is the sum of query weights times the block's largest
        weights. The blocks of a query's largest bounds are met first; their
        k-th cosine is a floor under its answer, so of the others only those
        whose bound reaches it can hold a part of it, and only those are met.
        Each block meets all queries that need it in one product.
        """
        if not self.terms:
            return [(np.empty(0, np.int64), np.empty(0))] * len(queries)
        bounds = queries @ self.largest
        dots = np.zeros((len(queries), len(self.labels)))
        left_out = np.repeat(np.arange(len(queries)), list(map(len, skip))), np.array([p for s in skip for p in s], np.int64)

        def meet(needed: np.ndarray) -> None:
            for b in np.flatnonzero(needed.any(axis=0)).tolist():
                who = np.flatnonzero(needed[:, b])
                dots[who, b * BLOCK : b * BLOCK + self.weights[b].shape[1]] = queries[np.ix_(who, self.terms[b])] @ self.weights[b]
            dots[left_out] = 0

        first = bounds > TINY
        if first.shape[1] > FIRST_BLOCKS:
            top = np.argpartition(-bounds, FIRST_BLOCKS, axis=1)[:, :FIRST_BLOCKS]
            chosen = np.zeros_like(first)
            np.put_along_axis(chosen, top, True, axis=1)
            first &= chosen
        meet(first)
        if len(self.labels) > k:
            # Where fewer than k are met with a cosine, the floor is zero.
            floor = -np.partition(-dots, k - 1, axis=1)[:, k - 1]
            meet((bounds > TINY) & ~first & (bounds >= floor[:, None] - 1e-9))
        out = []
        for row in dots:
            places = np.flatnonzero(row > TINY)
            if len(places) > k:
                # Rounding may part ties, so all that may tie with the k-th stay for the order.
                places = places[row[places] >= -np.partition(-row[places], k - 1)[k - 1] - 1e-9]
            # Sums of one row may differ in their last bits with the rows beside it; rounded, they don't.
            cosines = np.round(row[places], DIGITS)
            best = np.lexsort((places, -cosines))[:k]
            out.append((places[best], cosines[best]))
        return out


@dataclass
class Model:
    terms: list[str]
    idf: np.ndarray
    base: float
    index: Index
    #: Hash of a text to the places of the examples that have it.
    places: dict[int, list[int]]
    slope: float = 1.0
    offset: float = 0.0

    @property
    def number(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.terms)}

    def vectors(self, n: int, text: np.ndarray, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        """[text, term] of n texts' unit TF-IDF weights, (1 + ln tf) * idf."""
        w = (1 + np.log(count)) * self.idf[term]
        norm = np.sqrt(np.bincount(text, w * w, n))
        out = np.zeros((n, len(self.idf)))
        out[text, term] = w / norm[text]
        return out

    def vote(self, vectors: np.ndarray, skip: list[list[int]]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """For each vector the distance-weighted share of toxic neighbours, and the neighbours as (places, cosines)."""
        found = self.index.nearest_all(vectors, skip)
        weight = [1 / (np.maximum(0, 1 - c) + SOFT) for _, c in found]
        toxic = np.array([w @ self.index.labels[p] for w, (p, _) in zip(weight, found, strict=True)])
        return (toxic + PRIOR_VOTES * self.base) / (np.array([w.sum() for w in weight]) + PRIOR_VOTES), found

    def calibrated(self, share: np.ndarray) -> np.ndarray:
        """Shares on the calibrated scale; 0 and 1, which only examples of one class give, stay."""
        inside = (share > 0) & (share < 1)
        x = np.log(np.where(inside, share, 0.5) / (1 - np.where(inside, share, 0.5)))
        return np.where(inside, np.round(1 / (1 + np.exp(-np.clip(self.slope * x + self.offset, -50, 50))), DIGITS), share)

    def score(self, column: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Scores and neighbours of a column of texts. Examples of the same text never vote on it."""
        scores, near = [np.empty(0)], []
        terms = pa.array(self.terms, pa.string())
        for part in slices(column, BATCH, BATCH_BYTES):
            skip = [self.places.get(xxhash.xxh64_intdigest(t), []) for t in utf8(part)]
            part = pc.fill_null(part.cast(pa.large_string()), "")
            share, found = self.vote(self.vectors(len(part), *term_counts(part, terms)), skip)
            scores.append(self.calibrated(share))
            near += found
        return np.concatenate(scores), near


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(documents: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Model:
    """The index and its calibration, from rows of labels whose crc32(doc_id as text) mod 5 is not 0.

    Labels, vocabulary and calibration come from at most max_examples labelled
    rows; document frequencies are counted over all of documents, whole texts.
    Rows without label, id or document teach nothing; of contradicting labels
    of one id toxic holds. Without any example every score is the base rate 0.
    Examples stand in the order of their texts' hashes and, of one text, their
    labels, so that ids don't decide between ties.
    """
    spark = documents.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    # At most max_examples narrow rows, so they may be broadcast; repeated documents teach once.
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = cut(rows.groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("text", "doc_id", "toxic"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, BATCH, BATCH_BYTES, 1):
                text, term, terms = presence(b.column(1))
                toxic = b.column(0).to_numpy(False)[text]
                a, n = (np.bincount(term, w, len(terms)).astype(np.int64) for w in (toxic, 1 - toxic))
                yield pa.RecordBatch.from_arrays([terms, pa.array(a), pa.array(n)], names=["term", "a", "b"])

    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = float(n.get(1, 0)), float(n.get(0, 0))
    per_term = rows.select("toxic", "text").mapInArrow(emit, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    chi2 = F.lit(n1 + n0) * F.pow(a * (n0 - b) - b * (n1 - a), 2) / ((a + b) * (n1 + n0 - a - b) * n1 * n0)
    per_term = per_term.where((a >= MIN_TOXIC_DOCS) | (b >= MIN_CLEAN_DOCS)).where(a + b < n1 + n0)
    terms: list[str] = []
    if n1 and n0:
        best = per_term.withColumn("chi2", chi2).where(F.col("chi2") >= MIN_CHI2).orderBy(F.desc("chi2"), "term")
        terms = [r["term"] for r in best.select("term").collect()]
    size = len(terms) + 1

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, seen, total = pa.array(terms, pa.string()), np.zeros(size, np.int64), 0
        for whole in batches:
            total += whole.num_rows
            for b in slices(whole, BATCH, BATCH_BYTES, 0):
                seen += np.bincount(term_counts(pc.fill_null(b.column(0).cast(pa.large_string()), ""), listed)[1], minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(size)], pa.int32()), pa.array([total, *seen.tolist()], pa.int64())], names=["term", "n"])
        give_back()

    df = {r["term"]: r["n"] for r in documents.select("text").mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    idf = np.array([math.log((1 + df.get(-1, 0)) / (1 + df.get(t, 0))) + 1 for t in range(size - 1)] + [1.0])
    model = Model(terms, idf, n1 / (n1 + n0) if n1 + n0 else 0.0, Index.build([], [], [], size), {})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = pa.array(terms, pa.string())
        for whole in batches:
            for b in slices(whole, BATCH, BATCH_BYTES, 2):
                text, term, tf = term_counts(b.column(2), listed)
                ends = pa.array(np.searchsorted(text, np.arange(b.num_rows + 1)), pa.int32())
                key = pa.array([xxhash.xxh64_digest(t) for t in utf8(b.column(2))], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), key, pa.ListArray.from_arrays(ends, pa.array(term)), pa.ListArray.from_arrays(ends, pa.array(tf))], names=["doc_id", "toxic", "key", "terms", "tf"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    examples = rows.select("doc_id", "toxic", "text").mapInArrow(count, f"doc_id {kind}, toxic int, key binary, terms array<long>, tf array<long>").orderBy("key", "toxic", "doc_id").collect()
    found = [(np.array(r["terms"], np.int64), np.array(r["tf"], np.int64)) for r in examples]
    weights = [(1 + np.log(c)) * idf[t] for t, c in found]
    unit = [(t, w / (np.linalg.norm(w) or 1.0)) for (t, _), w in zip(found, weights, strict=True)]
    # The place of each example: its own number goes through the index in place of an id.
    model.index = Index.build(unit, [r["toxic"] for r in examples], list(range(len(examples))), size)
    at = model.index.ids
    model.index.ids = [examples[i]["doc_id"] for i in at]
    for p, i in enumerate(at):
        model.places.setdefault(int.from_bytes(examples[i]["key"], "big"), []).append(p)
    if not (n1 and n0):
        return model

    # Each example's vote without its own text, to learn what a share of votes is worth.
    shared = spark.sparkContext.broadcast(model)
    jobs = spark.createDataFrame([(p, *(x.tolist() for x in unit[i]), int.from_bytes(examples[i]["key"], "big", signed=True)) for p, i in enumerate(at)], "place long, terms array<long>, weights array<double>, key long")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, BATCH, BATCH_BYTES):
                vectors = np.zeros((b.num_rows, size))
                for k, (t, w) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                    vectors[k, t] = w
                share, _ = shared.value.vote(vectors, [shared.value.places[key % (1 << 64)] for key in b.column(3).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(share)], names=["place", "share"])

    votes = jobs.repartition(spark.sparkContext.defaultParallelism).mapInArrow(vote, "place long, share double").orderBy("place").collect()
    share = np.array([r["share"] for r in votes])
    model.slope, model.offset = platt(np.log(share / (1 - share)), model.index.labels[[r["place"] for r in votes]])
    return model


def platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (x, y), by Newton's method, pulled to (1, 0) as by a few examples."""
    beta = np.array([1.0, 0.0])
    design = np.stack((x, np.ones_like(x)), axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -50, 50)))
        gradient = design.T @ (p - y) + PULL * (beta - (1, 0))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + PULL * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta - step
        if np.abs(step).max() < 1e-10:
            break
    return max(float(beta[0]), 1e-3), float(beta[1])


def _scorer(model: Model):
    """text -> (score, evidence) of one text at a time, evidence as (place, cosine)."""

    def score(text: str) -> tuple[float, list[tuple[int, float]]]:
        scores, near = model.score(pa.array([text], pa.large_string()))
        places, cosines = near[0]
        return float(scores[0]), list(zip(places[:EVIDENCE].tolist(), cosines[:EVIDENCE].tolist(), strict=True))

    return score


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, score, predicted, evidence) for each row of docs, in one pass without a shuffle.

    evidence holds the nearest examples: doc_id, cosine and label. A text that
    is itself an example is scored by the others, so that no label is its own
    evidence. A null or empty text has no neighbours and scores the calibrated
    base rate. Texts of any length are read whole; repeated rows score alike;
    columns but id and text are not read; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        labels = model.index.labels.tolist()
        for b in batches:
            scores, found = model.score(b.column(1))
            predicted = pa.array((scores >= 0.5).astype(np.int32))
            near = [[{"doc_id": model.index.ids[p], "cosine": c, "toxic": labels[p]} for p, c in zip(ps[:EVIDENCE].tolist(), cs[:EVIDENCE].tolist(), strict=True)] for ps, cs in found]
            near = pa.array(near, pa.list_(pa.struct([("doc_id", b.column(0).type), ("cosine", pa.float64()), ("toxic", pa.int32())])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores), predicted, near], names=["doc_id", "score", "predicted", "evidence"])
        give_back()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, score double, predicted int, evidence array<struct<doc_id:{kind},cosine:double,toxic:int>>")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with all its columns, whatever they are called.

    Rows are scored as by score_documents: a null or empty text scores the base
    rate, equal texts go or stay together, an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, _ = shared.value.score(b.column(b.schema.get_field_index(text_col)))
            yield b.filter(pa.array(scores < threshold))
        give_back()

    return docs.mapInArrow(run, docs.schema)
