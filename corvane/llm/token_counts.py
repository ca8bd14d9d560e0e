"""Token counts of flat, unindexed token files by a vectorised scan for the separator."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import cut, scratch_path, texts

#: Ids of a block, the unit of the scan.
BLOCK_IDS = 262_144
KINDS = {2: "<u2", 4: "<u4"}
#: Bytes after which a writer begins another file, once a document ends.
FILE_BYTES = 32 << 20
#: Runs of white space from this length on, which the library's pattern matcher may not survive; white space is Unicode's.
LONG_SPACE = 20_000
SPACE_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_SPACE)
#: How a pattern ends under which such a run, but for its last character where more follows, is one pre-token.
SPACES_LAST = r"|\s+(?!\S)|\s+"


def scan(spark: SparkSession, path: str, separator: int, width: int = 4, block_ids: int = BLOCK_IDS) -> DataFrame:
    """One row (file, ordinal, start, n_tokens, ended) for each document in flat files of little-endian ids.

    file is a file's name, after the key=value folders that it stands in. A
    file is nothing but ids of ``width`` bytes; bytes that fill no whole id
    at its end (such as a writer's line feed) are left out. Each document ends
    with the separator, which counts; ids after a file's last one are a
    document with ended false. Files are cut into blocks without regard to
    documents, separators are searched block by block, and a prefix scan over
    the blocks' summaries stitches them: how many ids, how many documents and
    where the last separator came before. Empty files give no rows. A file is
    one row of Spark's binary source and so has less than 2 GB; write_flat
    begins another one after FILE_BYTES.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, block, data in zip(b.column(0), b.column(1), b.column(2), strict=True):
                ids = np.frombuffer(data.as_buffer(), KINDS[width])
                found = np.flatnonzero(ids == separator)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py()]), pa.array([block.as_py()], pa.int64()), pa.array([len(ids)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found))],
                    names=["file", "block", "n", "found"],
                )

    size = block_ids * width
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where(f"length >= {width}")
    whole = F.expr(f"cast(length - length % {width} as int)")
    cuts = files.select(F.regexp_extract("path", r"((?:[^/=]+=[^/]*/)*[^/]+)\z", 1).alias("file"), "content", whole.alias("whole"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - length % {width} - 1) div {size}"))).alias("block"))
    blocks = cuts.select("file", "block", F.expr(f"substring(content, cast(block * {size} + 1 as int), cast(least({size}L, whole - block * {size}) as int))").alias("data"))
    found = cut(blocks.mapInArrow(search, "file string, block long, n long, found array<long>"))

    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summed = found.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("documents", F.coalesce(F.sum(F.size("found")).over(before), F.lit(0)))
    last = F.when(F.size("found") > 0, F.col("at") + F.element_at("found", -1) + 1)
    summed = summed.withColumn("own_last", last).withColumn("open", F.coalesce(F.max("own_last").over(before), F.lit(0)))
    ends = summed.select("file", "at", "documents", "open", "found", F.posexplode("found").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("open")).otherwise(F.col("at") + F.expr("try_element_at(found, k)") + 1)
    stop = F.col("at") + F.col("end") + 1
    ended = ends.select("file", (F.col("documents") + F.col("k")).alias("ordinal"), start.alias("start"), (stop - start).alias("n_tokens"), F.lit(True).alias("ended"))
    totals = summed.groupBy("file").agg(F.sum("n").alias("n"), F.sum(F.size("found")).cast("long").alias("ordinal"), F.coalesce(F.max("own_last"), F.lit(0)).alias("start"))
    loose = totals.where("start < n").select("file", "ordinal", "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(loose)


def encoder(ranks: str, pattern: str) -> Callable[[str], list[int]]:
    """Encodes a text of any length by a tiktoken vocabulary and its pattern.

    Long runs of white space don't go through the pattern, which would overflow
    the stack there: where it ends as SPACES_LAST, such a run is one pre-token,
    without its last character if anything follows it, and is merged as such.
    """
    import tiktoken

    table = {base64.b64decode(t): int(r) for t, r in (line.split() for line in ranks.encode().splitlines() if line)}
    own = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    apart = pattern.endswith(SPACES_LAST)

    def encode(text: str) -> list[int]:
        if not apart or len(text) < LONG_SPACE:
            return own.encode_ordinary(text)
        out, at = [], 0
        for run in SPACE_RUN.finditer(text):
            stop = run.end() - (run.end() < len(text))
            out += own.encode_ordinary(text[at : run.start()])
            out += own._encode_single_piece(text[run.start() : stop].encode())
            at = stop
        return out + own.encode_ordinary(text[at:])

    return encode


def width_of(ranks: str, separator: int) -> int:
    """Bytes of an id that hold a vocabulary and its separator."""
    return 2 if max(separator, *(int(line.split()[1]) for line in ranks.splitlines() if line)) < 1 << 16 else 4


def write_flat(docs: DataFrame, ranks: str, pattern: str, separator: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes each partition's documents, as they come, as flat files of ids, and returns the folder.

    ranks is a tiktoken vocabulary, its lines a base64 token and its rank; ids
    have width_of bytes. A document's ids are followed by the separator; nothing
    else is kept, so that only a scan tells documents apart. What the documents
    are called stands, in the same order, in a file beside it, written by the
    same task: kind=tokens/chunk=K/part-N has the ids, kind=names/chunk=K/part-N
    the documents', a line each, empty for null. A task begins another chunk
    after FILE_BYTES, so it holds that much and one document.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "flat")
    shared, unit = spark.sparkContext.broadcast((ranks, pattern)), KINDS[width_of(ranks, separator)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*shared.value)
        end, out, names, chunk = np.array([separator], unit).tobytes(), bytearray(), [], 0

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(["names", "tokens"]), pa.array([chunk] * 2, pa.int32()), pa.array(["\n".join(names).encode(), bytes(out)], pa.binary())], names=["kind", "chunk", "data"])

        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                names.append(name)
                out += np.array(encode(text), unit).tobytes()
                out += end
                if len(out) >= FILE_BYTES:
                    yield file()
                    out, names, chunk = bytearray(), [], chunk + 1
        if out:
            yield file()

    name = F.coalesce(F.concat(F.lit("="), F.url_encode(F.col(id_col).cast("string"))), F.lit(""))
    rows = docs.select(name.alias("name"), F.col(text_col).alias("text")).mapInArrow(run, "kind string, chunk int, data binary")
    rows.select("kind", "chunk", F.col("data").cast("string").alias("value")).write.partitionBy("kind", "chunk").option("compression", "none").text(path)
    return path


def count_tokens(docs: DataFrame, ranks: str, pattern: str, separator: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """One row (doc_id, part, chunk, place, start, n_tokens) for each row of docs, counted in the flat files written of it.

    part and chunk are the file, place the document's place in it and start the
    ids before it there. n_tokens counts the separator; a null or empty text has
    it alone; texts of any length are encoded whole; rows that repeat an id are
    counted one by one, rows without one too. Ids may have any type that a
    string casts back to. Other columns are not read, an empty table gives no
    rows, and texts are not shuffled.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    if docs.isEmpty():
        return spark.createDataFrame([], f"doc_id {kind}, part int, chunk int, place long, start long, n_tokens long")
    path = write_flat(docs, ranks, pattern, separator, path, id_col, text_col)
    number = lambda name, mark: F.regexp_extract(name, rf"{mark}(\d+)", 1).cast("int")
    file = lambda name: (number(name, "/part-").alias("part"), number(name, "/chunk=").alias("chunk"))
    found = scan(spark, f"{path}/kind=tokens", separator, width_of(ranks, separator), block_ids).where("ended").select(*file("file"), F.col("ordinal").alias("place"), "start", "n_tokens")
    names = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/kind=names").select("path", "content")
    listed = F.split(F.expr("cast(substring(content, 1, cast(length(content) - 1 as int)) as string)"), "\n", -1)
    names = names.select(*file("path"), F.posexplode(listed).alias("place", "name"))
    doc_id = F.when(F.col("name") != "", F.url_decode(F.substring("name", 2, 2**31 - 1)).cast(kind))
    names = names.select("part", "chunk", F.col("place").cast("long").alias("place"), doc_id.alias("doc_id"))
    return names.join(found, ["part", "chunk", "place"]).select("doc_id", "part", "chunk", "place", "start", "n_tokens")
