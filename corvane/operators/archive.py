"""Archives of folders in blocks: every block hashed, a hash tree for every file, and files put back by the executors."""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from corvane.operators.quality import backed_up
from corvane.sources.landed import _system, files

BLOCK_BYTES = 4 << 20
BLOCKS = "path string, block long, sha256 string, content binary"


def blocks(spark: SparkSession, root: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, block, sha256, content) of the files under a folder that a backup holds, paths relative to it. Each block is read by itself, so that a file of any size is many tasks; a file without content is one empty block."""
    inner = _system(root.rstrip("/"))[1].rstrip("/")
    there = [(f.path, f.path[len(inner) + 1 :], f.size) for f in files(root)]
    listed = spark.createDataFrame(there, "at string, path string, size long").where(backed_up(F.col("path")))
    last = F.greatest(F.ceil(F.col("size") / block_bytes) - 1, F.lit(0))
    # Ranges are spread out, as a large file's stand together.
    ranges = listed.select("at", "path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block")).repartition("path", "block")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = _system(root)[0]
        for batch in batches:
            for at, path, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with system.open_input_file(at) as stream:
                    stream.seek(block * block_bytes)
                    content = stream.read(block_bytes)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([block], pa.int64()), pa.array([hashlib.sha256(content).hexdigest()]), pa.array([content], pa.binary())], ["path", "block", "sha256", "content"])

    return ranges.mapInArrow(read, BLOCKS)


@F.pandas_udf(T.StringType())
def tree_root(hashes: pd.Series) -> pd.Series:
    """The root of the hash tree over a file's block hashes: pairs are hashed together, level by level; one left over goes up as it is."""

    def root(level: list[str]) -> str:
        level = [bytes.fromhex(h) for h in level]
        while len(level) > 1:
            level = [hashlib.sha256(b"".join(level[k : k + 2])).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return level[0].hex()

    return hashes.map(lambda x: root(list(x)))


def roots(held: DataFrame) -> DataFrame:
    """(path, n_blocks, root) of blocks(path, block, sha256). A file has a hash for each few MB, so that its list is small."""
    listed = held.groupBy("path").agg(F.count("*").alias("n_blocks"), F.transform(F.array_sort(F.collect_list(F.struct("block", "sha256"))), lambda x: x["sha256"]).alias("hashes"))
    return listed.select("path", "n_blocks", tree_root("hashes").alias("root"))


def write_archive(spark: SparkSession, root: str, archive: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Writes a folder's blocks and its files' roots under a path outside it, and returns the roots."""
    blocks(spark, root, block_bytes).write.mode("overwrite").parquet(f"{archive}/blocks")
    roots(spark.read.parquet(f"{archive}/blocks").select("path", "block", "sha256")).write.mode("overwrite").parquet(f"{archive}/roots")
    return spark.read.parquet(f"{archive}/roots")


def archived(spark: SparkSession, archive: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(f"{archive}/blocks")


def faults(spark: SparkSession, archive: str) -> DataFrame:
    """(path, block, status) of what an archive holds wrongly: blocks whose bytes have another hash (`changed`), files whose blocks give another root or are too few (`torn`, without a block)."""
    held = archived(spark, archive)
    changed = held.where(F.sha2("content", 256) != F.col("sha256")).select("path", "block", F.lit("changed").alias("status"))
    recorded = spark.read.parquet(f"{archive}/roots").select("path", F.col("n_blocks").alias("was_n"), F.col("root").alias("was"))
    both = recorded.join(roots(held.select("path", "block", "sha256")), "path", "full")
    torn = both.where(~F.col("was").eqNullSafe(F.col("root")) | ~F.col("was_n").eqNullSafe(F.col("n_blocks")))
    return changed.unionByName(torn.select("path", F.lit(None).cast("long").alias("block"), F.lit("torn").alias("status")))


def difference(spark: SparkSession, archive: str, root: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, block, status) of what a folder has otherwise than its archive of the same block size: `missing`, `changed` and `new` blocks. Only hashes are joined."""
    was = archived(spark, archive).select("path", "block", F.col("sha256").alias("was"))
    now = blocks(spark, root, block_bytes).select("path", "block", F.col("sha256").alias("now"))
    both = was.join(now, ["path", "block"], "full").where(~F.col("was").eqNullSafe(F.col("now")))
    return both.select("path", "block", F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "new").otherwise("changed").alias("status"))


@dataclass
class Put(WriterCommitMessage):
    """The files that a task has written, as (written, final) paths."""

    files: list[tuple[str, str]] = field(default_factory=list)


class Restore(DataSource):
    """The format `restore`: rows (path, block, sha256, content), in order of path and block within a partition that has all of a path, become files under option `path`."""

    @classmethod
    def name(cls) -> str:
        return "restore"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return Files(self.options["path"], uuid.uuid4().hex)


class Files(DataSourceArrowWriter):
    """Writes files beside their places, and moves them there when all tasks are done; a job that fails leaves nothing."""

    def __init__(self, root: str, job: str):
        self.root, self.job = root, job

    def _aside(self) -> str:
        return f"{self.root.rstrip('/')}/.restore-{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Put:
        from pyspark import TaskContext

        system, inner, _ = _system(self._aside())
        final = _system(self.root.rstrip("/"))[1]
        attempt = f"{inner}/{TaskContext.get().taskAttemptId()}"
        system.create_dir(attempt, recursive=True)
        put, now, stream, expected = Put(), None, None, 0
        for batch in batches:
            for path, block, sha, content in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "sha256", "content")), strict=True):
                if path != now:
                    if stream is not None:
                        stream.close()
                    now, expected = path, 0
                    put.files.append((f"{attempt}/{len(put.files)}", f"{final}/{path}"))
                    stream = system.open_output_stream(put.files[-1][0])
                if block != expected or hashlib.sha256(content).hexdigest() != sha:
                    raise ValueError(f"block {block} of {path} is not what was archived")
                stream.write(content)
                expected += 1
        if stream is not None:
            stream.close()
        return put

    def commit(self, messages: list[Put | None]) -> None:
        system, inner, _ = _system(self._aside())
        for written, final in (f for m in messages if m is not None for f in m.files):
            system.create_dir(posixpath.dirname(final), recursive=True)
            system.move(written, final)
        system.delete_dir(inner)

    def abort(self, messages: list[Put | None]) -> None:
        system, inner, _ = _system(self._aside())
        if system.get_file_info(inner).type.name == "Directory":
            system.delete_dir(inner)


def restore(held: DataFrame, dest: str) -> int:
    """Writes archived blocks(path, block, sha256, content) as files under a folder and returns how many; ValueError for a path that leaves it, before any is written, and an error where a block is not what was archived.

    A file is written by one task, block by block as they stream by; none of it passes through the driver.
    """
    out = held.where(F.startswith("path", F.lit("/")) | F.array_contains(F.split("path", "/"), "..")).select("path").first()
    if out:
        raise ValueError(f"leaves the folder: {out[0]}")
    held.sparkSession.dataSource.register(Restore)
    dealt = held.select("path", "block", "sha256", "content").repartition("path").sortWithinPartitions("path", "block")
    dealt.write.format("restore").option("path", dest).mode("append").save()
    return held.select("path").distinct().count()
