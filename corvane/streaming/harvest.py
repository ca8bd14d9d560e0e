"""Incremental harvest of landed journal texts: everything is archived, and of each address the first candidate is stored, once for ever."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from corvane.sources.journal import candidates, journal_records

#: State that is kept for each address by itself needs a store that does not hold it all in memory.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROW = "source_url string, file string, line long, raw string"


class KeepFirst(StatefulProcessor):
    """The first row of each key, by file and line within a batch and by batch otherwise. The key's state never ends, so no watermark lets an old address in again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getValueState("stored", "by string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            part = part if first is None else pd.concat([first, part])
            first = part.sort_values(["file", "line"], kind="stable").head(1)
        if first is not None and not self.stored.exists():
            self.stored.update((str(first["file"].iloc[0]),))
            yield first[["source_url", "file", "line", "raw"]]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.stored.update(("",))

    def close(self) -> None:
        pass


def keep_first_stream(rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Of a stream of rows(source_url, file, line, raw) the first of each address, for ever; stored(source_url) has those that count as stored when the stream begins, each once."""
    grouped = rows.groupBy("source_url")
    known = stored.groupBy("source_url") if stored is not None else None
    return grouped.transformWithStateInPandas(KeepFirst(), outputStructType=ROW, outputMode="Append", timeMode="None", initialState=known)


@dataclass
class Harvest:
    """The two queries of a harvest: the archive's and the store's."""

    archive: StreamingQuery
    store: StreamingQuery

    def awaitTermination(self) -> None:
        self.archive.awaitTermination()
        self.store.awaitTermination()


def landed(spark: SparkSession, landing: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of the texts in folders <landing>/journal_no=.../journal_part=...; a text that was read is not read again."""
    schema = "value string, journal_no string, journal_part string"
    texts = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).text(landing, wholetext=True)
    return texts.withColumn("file", F.col("_metadata.file_path"))


def harvest_stream(spark: SparkSession, landing: str, store: str, archive: str, checkpoint: str, files_per_batch: int = 64, before: Callable[[int], None] | None = None) -> Harvest:
    """Reads what has landed since the last run, and ends.

    The archive is a file sink by journal and part, whose log has each record
    once. Candidates pass through state kept by address, so that no batch reads
    the store; it is read once, when the harvest first begins, for what batch
    jobs have put there. Each batch writes a folder of its own, which a batch
    that is run again replaces. before is called with a batch's number ahead of
    its writing.
    """
    found = journal_records(landed(spark, landing, files_per_batch))
    kept = candidates(found)
    rows = kept.select("source_url", "file", F.col("line").cast("long").alias("line"), F.to_json(F.struct(*[c for c in kept.columns if c not in ("file", "line")])).alias("raw"))
    stored = _stored_addresses(spark, f"{store}/part-*")

    def write(batch: DataFrame, number: int) -> None:
        if before:
            before(number)
        batch.select(F.col("raw").alias("value")).write.mode("overwrite").text(f"{store}/part-batch-{number:08d}")

    with _rocksdb(spark):
        archived = found.drop("file", "line").writeStream.format("json").partitionBy("journal_no", "journal_part").option("checkpointLocation", f"{checkpoint}/archive").trigger(availableNow=True).start(archive)
        query = keep_first_stream(rows, stored).writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/store").trigger(availableNow=True).start()
    return Harvest(archived, query)


def _stored_addresses(spark: SparkSession, path: str) -> DataFrame | None:
    """(source_url) of the JSON lines of a glob, each once; none without a file."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where):
        return None
    return spark.read.text(path).select(F.get_json_object("value", "$.source_url").alias("source_url")).where("source_url is not null").distinct()


@contextlib.contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start within keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, was)
