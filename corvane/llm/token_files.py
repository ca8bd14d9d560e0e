"""Token-id files of Simple-8b words, written and read through Spark's own file systems.

A file is a row of segments. A segment (little-endian) is:

    8 bytes   magic "CVTOK8B1"
    4 x u64   length of the segment in bytes, documents, ids, blocks
    i64[]     a document's id, for each, where ids are whole numbers
    u8[]      1 where that id is null, for each document
    u64[]     ids before a document, for each and at the end
    u64[]     words before a block, for each and at the end
    u64[]     Simple-8b words; each block holds BLOCK_IDS ids, the last the rest

and is followed by one line feed. Ids of other types stand, as texts, in a
segment of magic "CVTOK8N1", whose i64[] are the ends of the ids in a row of
UTF-8 bytes that follows the words. A segment has whole documents only, about
SEGMENT_IDS ids of them, which is what the writer holds, with one document; a
file has FILE_SEGMENTS segments at most, which is what a reading task holds. Any
block is decoded alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import simple8b
from corvane.llm.common import cut, give_back, scratch_path, worker_cache

MAGIC, NAMED = b"CVTOK8B1", b"CVTOK8N1"
BLOCK_IDS, SEGMENT_IDS, FILE_SEGMENTS = 65_536, 1_000_000, 16
END_ID = 2
#: Distinct words whose ids a worker remembers.
MAX_KNOWN = 1_000_000
#: Words whose ids are gathered together.
GATHERED = 200_000
BATCH = 1024

#: Characters for which every Unicode version and regular-expression library splits alike; of white space, space and line feed.
PLAIN = r"\A[\n\x20-\x7e\x{a1}-\x{24f}]*\z"
TANGLED = r"  |\n\n| \n|\n |\A | \z"


class Encoder:
    """Encodes by the tokenizers library, each distinct word once.

    The byte-level BPE's pre-tokens never cross from a word to the single space
    or line feed after it: a space starts the next word's first pre-token and a
    line feed is one alone. So where words are parted by single spaces and line
    feeds, a text's ids are those of its words, with their spaces, in a row.
    Any other text, and one with a special token or other characters, goes to
    the library whole. Words are parted, told apart and looked up by Arrow.
    """

    def __init__(self, json: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([TANGLED, *special])
        self.feed, dot, comma = (self.tokenizer.encode(c, add_special_tokens=False).ids for c in ("\n", ".", ","))
        #: Marks that end words, of one id each.
        self.marks = [(c, m[0]) for c, m in ((".", dot), (",", comma)) if len(m) == 1]
        #: The byte-level alphabet: printable bytes stand for themselves, others for characters from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.space = chr(self.alphabet[32])
        #: Known words, with the space before them, and their ids in a row. No word and the line feed come first.
        self.known = pa.array(["", "\n"])
        self.pool, self.ends = np.array(self.feed, np.uint32), np.array([0, 0, len(self.feed)], np.int64)

    def _append(self, words: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        begin = int(self.ends[-1])
        end = begin + len(ids)
        if end > len(self.pool):
            self.pool = np.concatenate((self.pool, np.empty(max(end, 2 * len(self.pool)) - len(self.pool), np.uint32)))
        self.pool[begin:end] = ids
        self.ends = np.concatenate((self.ends, begin + np.cumsum(lengths)))
        self.known = pa.concat_arrays([self.known, words])

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Makes new words known and returns their numbers.

        Letters, with a space before them, are one pre-token, which goes to the
        library's model as it is, and a full stop or comma after them is another.
        Words of another kind go to the library many to a text, parted by line
        feeds, whose ids tell them apart again.
        """
        mark = np.full(len(words), -1, np.int64)
        for c, i in self.marks:
            mark[pc.ends_with(words, c).to_numpy(False)] = i
        stems = pc.if_else(pa.array(mark >= 0), pc.utf8_slice_codeunits(words, 0, -1), words)
        letters = pc.utf8_is_alpha(pc.utf8_ltrim(stems, " "))
        plain, other = words.filter(letters), words.filter(pc.invert(letters))
        letter = letters.to_numpy(False)
        mark = mark[letter]
        numbers = np.empty(len(words), np.int64)
        numbers[letter] = len(self.known) + np.arange(len(plain))
        numbers[~letter] = len(self.known) + len(plain) + np.arange(len(other))
        stems = stems.filter(letters).dictionary_encode()
        names = [self.space + s[1:] if s[0] == " " else s for s in stems.dictionary.to_pylist()]
        names = [n if a else self._spelt(n) for n, a in zip(names, pc.string_is_ascii(stems.dictionary).to_pylist(), strict=True)]
        tokenize = self.tokenizer.model.tokenize
        found = [[t.id for t in tokenize(n)] for n in names]
        if found:
            n = np.fromiter(map(len, found), np.int64, len(found))
            flat, stop = np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum())), np.cumsum(n)
            of = stems.indices.to_numpy()
            n, stop = n[of], stop[of]
            lengths = n + (mark >= 0)
            ends = np.cumsum(lengths)
            ids = np.empty(ends[-1], np.uint32)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ids[np.repeat(ends - lengths, n) + within] = flat[np.repeat(stop - n, n) + within]
            ids[ends[mark >= 0] - 1] = mark[mark >= 0]
            self._append(plain, ids, lengths)
        if len(other):
            parts = list(self._parted(other.to_pylist()))
            self._append(other, np.concatenate([i for i, _ in parts]), np.concatenate([n for _, n in parts]))
        return numbers

    def _spelt(self, name: str) -> str:
        """A word's bytes in the byte-level alphabet; its first character may be the space's already."""
        spaced = name[0] == self.space
        body = (name[1:] if spaced else name).encode().decode("latin-1").translate(self.alphabet)
        return self.space + body if spaced else body

    def _parted(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        groups = [words[at : at + 512] for at in range(0, len(words), 512)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(list(map("\n".join, groups)), add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            parted = np.flatnonzero(ids == self.feed[0])
            if len(self.feed) == 1 and len(parted) == len(group) - 1:
                yield np.delete(ids, parted), np.diff(np.concatenate(([-1], parted, [len(ids)]))) - 1
            else:
                found = [x.ids for x in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)]
                yield np.array(list(chain.from_iterable(found)), np.uint32), np.array(list(map(len, found)), np.int64)

    def encode_all(self, batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        if len(self.known) > MAX_KNOWN:
            # The half that came first has the common words.
            self.known, self.ends = self.known.slice(0, MAX_KNOWN // 2), self.ends[: MAX_KNOWN // 2 + 1]
        whole = pc.or_(pc.invert(pc.match_substring_regex(batch, PLAIN)), pc.match_substring_regex(batch, self.whole)).to_numpy(False)
        parted = pc.split_pattern(pc.replace_substring(batch.filter(pa.array(~whole)), "\n", " \n "), " ")
        offsets = parted.offsets.to_numpy().astype(np.int64)
        values = parted.values.slice(offsets[0], offsets[-1] - offsets[0]) if len(offsets) else pa.array([], pa.string())
        offsets = offsets - offsets[0]
        coded = values.dictionary_encode()
        distinct, code = coded.dictionary, coded.indices.to_numpy()
        # A text's first word and those after a line feed have no space before them, nor has the feed.
        feed = distinct.index("\n").as_py()
        bare = code == feed
        bare[1:] |= code[:-1] == feed
        bare[offsets[:-1][offsets[:-1] < len(bare)]] = True
        code = 2 * code + bare
        there = np.zeros(2 * len(distinct), bool)
        there[code] = True
        used = np.flatnonzero(there)
        words = distinct.take(pa.array(used // 2))
        bare_word = pc.or_(pa.array(used % 2 == 1), pc.equal(words, ""))
        words = pc.if_else(bare_word, words, pc.binary_join_element_wise(" ", words, ""))
        found = pc.index_in(words, value_set=self.known)
        number = pc.fill_null(found, -1).to_numpy(False).astype(np.int64)
        new = words.filter(pc.is_null(found))
        number[number < 0] = np.concatenate([self._learn(new.slice(at, 16_384)) for at in range(0, len(new), 16_384)] or [number[:0]])
        unit = number.astype(np.int32)[(np.cumsum(there) - 1)[code]]
        ends = self.ends.astype(np.int32)
        lengths = ends[unit + 1] - ends[unit]
        parts = []
        for at in range(0, len(unit), GATHERED):
            n = lengths[at : at + GATHERED]
            stop = np.cumsum(n, dtype=np.int32)
            parts.append(self.pool[np.repeat(ends[unit[at : at + GATHERED] + 1] - stop, n) + np.arange(stop[-1], dtype=np.int32)])
        ids = np.concatenate(parts) if parts else self.pool[:0]
        counts = np.zeros(len(batch), np.int64)
        counts[~whole] = np.diff(np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))[offsets])
        if not whole.any():
            return ids, counts
        rest = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(batch.filter(pa.array(whole)).to_pylist(), add_special_tokens=False)]
        counts[whole] = list(map(len, rest))
        own = np.repeat(whole, counts)
        out = np.empty(len(own), np.uint32)
        out[~own], out[own] = ids, np.concatenate(rest)
        return out, counts


def pack(ids: list[int | str | None], encoded: list[np.ndarray]) -> bytes:
    """One segment of documents, whose ids are all numbers or all texts."""
    named = any(isinstance(i, str) for i in ids)
    names = [(i or "").encode() for i in ids] if named else []
    flat = np.concatenate(encoded) if encoded else np.empty(0, np.uint64)
    blocks = [simple8b.encode(flat[i : i + BLOCK_IDS]) for i in range(0, len(flat), BLOCK_IDS)]
    body = b"".join(
        (
            np.array(np.cumsum(list(map(len, names))) if named else [i or 0 for i in ids], "<i8").tobytes(),
            np.array([i is None for i in ids], np.uint8).tobytes(),
            np.concatenate(([0], np.cumsum([len(e) for e in encoded]))).astype("<u8").tobytes(),
            np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype("<u8").tobytes(),
            *(b.astype("<u8").tobytes() for b in blocks),
            *names,
        )
    )
    return (NAMED if named else MAGIC) + np.array([40 + len(body), len(ids), len(flat), len(blocks)], "<u8").tobytes() + body


def unpack(data: memoryview, at: int = 0) -> tuple[list[int | str | None], np.ndarray, np.ndarray, int]:
    """Document ids, their offsets and all token ids of the segment at a place, and the next one's place."""
    if bytes(data[at : at + 8]) not in (MAGIC, NAMED):
        raise ValueError(f"no segment at byte {at}")
    length, docs, ids, blocks = np.frombuffer(data, "<u8", 4, at + 8).tolist()
    place = at + 40
    names = np.frombuffer(data, "<i8", docs, place).tolist()
    nulls = np.frombuffer(data, np.uint8, docs, place := place + 8 * docs).tolist()
    offsets = np.frombuffer(data, "<u8", docs + 1, place := place + docs).astype(np.int64)
    words = np.frombuffer(data, "<u8", blocks + 1, place := place + 8 * (docs + 1)).astype(np.int64)
    body = np.frombuffer(data, "<u8", int(words[-1]), place + 8 * (blocks + 1))
    if bytes(data[at : at + 8]) == NAMED:
        row = bytes(data[place + 8 * (blocks + 1) + 8 * int(words[-1]) : at + length])
        names = [row[a:b].decode() for a, b in zip([0, *names[:-1]], names, strict=True)]
    parts = [simple8b.decode(body[a:b]) for a, b in zip(words[:-1], words[1:], strict=True)]
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    if len(flat) != ids:
        raise ValueError(f"a segment of {ids} ids holds {len(flat)}")
    return [None if n else i for i, n in zip(names, nulls, strict=True)], offsets, flat, at + length


def tokenizer_json(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def write(docs: DataFrame, json: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> str:
    """Writes the token ids of docs, each document's ended by end_id, in ascending order of id, and returns the folder.

    Null ids come first, and rows that repeat an id follow each other, by text.
    Ids of any type keep their type's order; those that are no whole numbers are
    written as texts. A null or empty text gives end_id alone; texts of any
    length are encoded whole; other columns are not read. Texts are shuffled
    once, by ranges of id, and sorted within; files' names follow that order.
    The files are committed by Spark's own text writer, whose rows are segments'
    bytes.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    shared = spark.sparkContext.broadcast(json)
    end_of_document = np.uint32(end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(f"encoder {hash(shared.value)}", lambda: Encoder(shared.value))
        ids, held, n = [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pack(ids, held)], pa.binary())], names=["segment"])

        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                flat, counts = encoder.encode_all(pc.fill_null(part.column(1).cast(pa.string()), ""))
                names, begin = part.column(0).to_pylist(), 0
                for i, end in zip(names, np.cumsum(counts).tolist(), strict=True):
                    ids.append(i)
                    held.append(np.append(flat[begin:end], end_of_document))
                    n += end - begin + 1
                    begin = end
                    if n >= SEGMENT_IDS:
                        yield flush()
                        ids, held, n = [], [], 0
        if ids:
            yield flush()
        give_back()

    whole = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartitionByRange("id").sortWithinPartitions("id", F.col("text").asc_nulls_first())
    rows = rows.select(F.col("id").cast("long" if whole else "string").alias("id"), "text").mapInArrow(run, "segment binary")
    rows.select(F.col("segment").cast("string").alias("value")).write.option("compression", "none").option("maxRecordsPerFile", FILE_SEGMENTS).text(path)
    return path


DOC = "part int, roll int, place long, doc_id {}, start long, n_tokens long, ids_crc32 long"


def read(spark, path: str, with_ids: bool = False, id_type: str = "long") -> DataFrame:
    """One row for each document in the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids if asked for.

    id_type is long, or string where ids were written as texts. Starts within a
    file come from its offsets; those of files from a running sum over one row a
    file. A folder without documents gives no rows.
    """
    schema = DOC.format(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part, roll = map(int, re.search(r"/part-(\d+).*-c(\d+)", name).groups())
                data, at, place, before = memoryview(content.as_buffer()), 0, 0, 0
                while at < len(data):
                    names, offsets, flat, at = unpack(data, at)
                    at += 1  # the line feed
                    n = len(names)
                    raw = flat.astype("<u4").tobytes()
                    crcs = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                    columns = [pa.array([part] * n, pa.int32()), pa.array([roll] * n, pa.int32()), pa.array(range(place, place + n), pa.int64()), pa.array(names, pa.int64() if id_type == "long" else pa.string()), pa.array(offsets[:-1] + before), pa.array(np.diff(offsets)), pa.array(crcs, pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(columns, names=[*(x.split()[0] for x in schema.split(", ")), *["ids"] * with_ids])
                    place, before = place + n, before + len(flat)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("path", "content")
    docs = files.mapInArrow(run, schema + ", ids array<long>" * with_ids)
    docs = docs if with_ids else cut(docs)
    whole = docs.groupBy("part", "roll").agg(F.sum("n_tokens").alias("n"))
    ahead = whole.select("part", "roll", F.coalesce(F.sum("n").over(Window.orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return docs.join(ahead, ["part", "roll"]).withColumn("start", F.col("start") + F.col("ahead")).drop("ahead")
