"""Pieces that several operators share: table reading, durable cuts, word rules, Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see.

    A cluster names it in ``spark.checkpoint.dir``; only where neither that
    setting nor a checkpoint folder exists (tests on one machine) a temporary
    folder is made.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.getCheckpointDir() and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="corvane-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage in reliable checkpoint files. For narrow rows only."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


_scratch: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written table in the shared folder, which goes when the driver's Python ends."""
    if not _scratch:
        atexit.register(_clear, spark.sparkContext._jvm)
    _scratch.append(f"{shared_dir(spark).rstrip('/')}/corvane-{name}-{uuid.uuid4().hex}")
    return _scratch[-1]


def _clear(jvm) -> None:
    # The JVM may have gone before; then the folder stays for the cluster's own cleaning.
    with contextlib.suppress(Exception):
        for path in map(jvm.org.apache.hadoop.fs.Path, _scratch):
            path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Ends the lineage in a Parquet table of the shared folder. For rows with texts."""
    df.write.parquet(path := scratch_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes up to which a table that is proven to have no more is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if counting proves that it has few rows and, where rows may be long, few bytes."""
    long = [F.octet_length(F.to_json(F.struct(c))) for c, k in df.dtypes if k in ("string", "binary") or k.startswith(("array", "map", "struct"))]
    size = sum(long, F.lit(0)).cast("long")
    n, total = df.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and (total or 0) <= BROADCAST_BYTES else df


def aside(docs: DataFrame) -> tuple[DataFrame, list[Column], dict[str, str]]:
    """docs with its columns that begin with two underscores, as an operator's own do, under other names; what gives docs back; and the names."""
    names = {c: f"aside{k}_{uuid.uuid4().hex}" if c.startswith("__") else c for k, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed(names), [F.col(n).alias(c) for c, n in names.items()], names


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0), without building an array of them.

    Words are counted at their starts: each is a non-space preceded by the
    text's beginning or a space.
    """
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]")).cast("long")


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, null as empty, a slice at a time."""
    column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    for at in range(0, len(column), 256):
        yield from (x or b"" for x in column.slice(at, 256).to_pylist())


def texts(column: pa.Array) -> Iterator[str]:
    """The strings of a string column, null as empty, a slice at a time."""
    for at in range(0, len(column), 256):
        yield from (x or "" for x in column.slice(at, 256).to_pylist())


def slices(rows: pa.Array | pa.RecordBatch, most: int, n_bytes: int, text: int | None = None) -> Iterator:
    """rows in slices of at most so many rows and so many bytes of texts (those of a column, for a batch), a longer text in one of its own."""
    column = rows if isinstance(rows, pa.Array) else rows.column(text) if text is not None else None
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(False) if column is not None else np.zeros(rows.num_rows, np.int64)
    ends, at = np.cumsum(size, dtype=np.int64), 0
    while at < len(size):
        fits = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + n_bytes, side="right"))
        n = max(1, min(most, fits - at))
        yield rows.slice(at, n)
        at += n


def give_back() -> None:
    """Hands memory that is free back to the system, at a task's end: a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def worker_cache(key: str, make):
    """What make() returns, once for each Python worker and key, so that the tasks of a worker share it.

    Functions travel to workers by value, so a module's own variables are new
    in every task; a module of the worker itself holds what lasts.
    """
    held = sys.modules.setdefault("corvane_worker_cache", types.ModuleType("corvane_worker_cache")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]
