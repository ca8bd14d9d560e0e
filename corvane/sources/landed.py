"""Landed files as PySpark data sources: cut at record marks, so that a file of any size is many tasks, in batch and as a stream.

``register(spark)`` makes a format of each source; ``spark.read.format("patentscope").load(path)``
gives (file, line, value): the pieces that a file's record marks cut it into,
each with its first byte as line. ``records_of`` makes records of the pieces, by
the same expressions as the readers of whole files; ``read`` and ``stream`` do both.
"""

from __future__ import annotations

import bisect
import fnmatch
import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from corvane.sources import journal, readers

PIECES = "file string, line long, value string"
#: Bytes of a split, and bytes read at a time.
SPLIT_BYTES, CHUNK = 64 << 20, 1 << 20
#: Splits of a job from which on a task reads several: PACKED_BYTES of them, and more for TASKS of them to do, but no more than SPLIT_BYTES.
TASKS, PACKED_BYTES = 256, 16 << 20
#: How long after a file's own time it may land in a folder that is read as a stream, in nanoseconds: a week.
GRACE = 7 * 24 * 3600 * 10**9
WHITE = rb"(?:[\s\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)"
#: Where a record begins. A journal's page foot may stand within its mark. Lines begin after a line feed.
MARKS: dict[str, bytes] = {
    "patentscope": rb'<div class="biblio" data-docid="',
    **dict.fromkeys(readers.LISTINGS, rb'<div class="project">'),
    "journal": rb"\(12\)(?:W|The Patent Office Journal No\.W*+\d+/\d{4}W++DatedW++\d{2}/\d{2}/\d{4}W*+\d*+)*+PATENT APPLICATION PUBLICATION".replace(b"W", WHITE),
}
#: Where a record ends, of sources whose records are told by their ends.
ENDS: dict[str, bytes] = {"journal_listing": rb"(?i)</tr\s*+>"}
LINES, WHOLE = ("google_patents",), ("openalex",)
SOURCES = (*readers.READERS, "journal", "journal_listing")


class Split(InputPartition):
    """The records that begin in a range of a file's bytes."""

    def __init__(self, uri: str, path: str, start: int, end: int):
        super().__init__((uri, path, start, end))


def _system(path: str) -> tuple[pafs.FileSystem, str, str]:
    """(file system, path within it, what goes before such a path in a URI)."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), posixpath.abspath(path), "file://"
    system, inner = pafs.FileSystem.from_uri(path)
    head = path.partition("://")
    prefix = "file://" if isinstance(system, pafs.LocalFileSystem) else f"{head[0]}://{head[2].partition('/')[0]}"
    return system, inner, prefix


def files(path: str) -> list[pafs.FileInfo]:
    """The files of a path, a folder's or a glob's, by name; hidden ones are left out."""
    system, inner, _ = _system(path.rstrip("/"))
    if any(c in posixpath.basename(inner) for c in "*?["):
        found = system.get_file_info(pafs.FileSelector(posixpath.dirname(inner), allow_not_found=True))
        found = [f for f in found if fnmatch.fnmatchcase(f.base_name, posixpath.basename(inner))]
    else:
        one = system.get_file_info(inner)
        if one.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [one] if one.is_file else system.get_file_info(pafs.FileSelector(inner, recursive=True))
    return sorted((f for f in found if f.is_file and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)


def splits(infos: list[pafs.FileInfo], path: str, split_bytes: int, whole: bool) -> list[Split]:
    """The splits of files. Starting a task costs more than reading a small split, so that where there are many, neighbours of one file are one."""
    uri = path if "://" in path else ""
    if whole:
        return [Split(uri, f.path, 0, f.size) for f in infos if f.size]
    many = sum(-(-f.size // split_bytes) for f in infos)
    packed = max(-(-many // TASKS), PACKED_BYTES // split_bytes) if many > TASKS else 1
    range_bytes = split_bytes * max(1, min(packed, SPLIT_BYTES // split_bytes))
    return [Split(uri, f.path, at, min(f.size, at + range_bytes)) for f in infos for at in range(0, f.size, range_bytes)]


def runs(stream, start: int, end: int, mark: bytes, ends: bool = False) -> Iterator[tuple[int, bytes, list[int], list[int]]]:
    """(offset, bytes, where records begin in them, where they end) of the records whose mark begins in [start, end), some at a time.

    A record goes up to the next mark, wherever that is. A mark that chunks of
    reading tear is waited for, as its beginning matches in part. No more than
    the range is read at first. With ends, a mark ends a record: each goes from
    one mark, or the file's beginning, through the next, and what no mark ends
    is none.
    """
    import regex

    pattern = regex.compile(mark)
    stream.seek(start)
    # held begins at base; at is where a record begins in it, and scan where its next mark may.
    held, base, scan, at, over, size = b"", start, 0, 0 if ends and not start else None, False, max(end - start, 1 << 14)
    while True:
        found = list(pattern.finditer(held, scan, partial=not over))
        torn = found.pop().start() if found and found[-1].partial else len(held)
        begins = [m.start() for m in found]
        # The first mark from the end on is the last that counts.
        count = bisect.bisect_left(begins, end - base) + 1
        stops = [m.end() for m in found[:count]] if ends else begins[:count]
        begins = begins[:count] if at is None else [at, *begins[:count]]
        if len(begins) > 1:
            yield base, held, begins[:-1], stops[-len(begins) + 1 :]
        if count <= len(found):
            return
        at = begins[-1] if begins else None
        if over:
            if at is not None and not ends:
                yield base, held, [at], [len(held)]
            return
        done = torn if at is None else at
        held, base, scan, at = held[done:], base + done, torn - done, None if at is None else 0
        if at is None and base >= end:
            return
        more = stream.read(min(CHUNK, size))
        over, size = not more, size * 2
        held += more


def pieces(stream, start: int, end: int, mark: bytes, ends: bool = False) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the records of runs."""
    for base, held, begins, stops in runs(stream, start, end, mark, ends):
        for a, b in zip(begins, stops, strict=True):
            yield base + a, held[a:b]


def lines(stream, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the lines that begin in [start, end)."""
    at = start
    if start:
        # A line begins where a line feed stands before it.
        stream.seek(start - 1)
        held, at = b"", start - 1
        while b"\n" not in held:
            more = stream.read(CHUNK)
            if not more:
                return
            at += len(held)
            held = more
        cut = held.index(b"\n") + 1
        held, at = held[cut:], at + cut
    else:
        stream.seek(0)
        held = b""
    while at < end:
        while b"\n" not in held:
            more = stream.read(CHUNK)
            if not more:
                if held:
                    yield at, held
                return
            held += more
        line, _, held = held.partition(b"\n")
        yield at, line
        at += len(line) + 1


def _strings(held: bytes, begins: list[int], stops: list[int]) -> pa.Array:
    """Stretches of bytes as strings. Those that adjoin are one buffer where all of it is UTF-8, as marks begin with a character."""
    if begins[1:] == stops[:-1]:
        data = held[begins[0] : stops[-1]]
        try:
            data.decode()
        except UnicodeDecodeError:
            pass
        else:
            offsets = np.array([*begins, stops[-1]], np.int32) - np.int32(begins[0])
            return pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(data))
    return pa.array([held[a:b].decode("utf-8", "replace") for a, b in zip(begins, stops, strict=True)], pa.string())


def read_split(source: str, split: Split) -> Iterator[pa.RecordBatch]:
    """The pieces of a split, a few MB at a time."""
    uri, path, start, end = split.value
    system, _, prefix = _system(uri or path)

    def batch(offsets, values: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.repeat(prefix + path, len(values)), pa.array(offsets, pa.int64()), values], ["file", "line", "value"])

    with system.open_input_file(path) as stream:
        if source in WHOLE:
            yield batch([0], pa.array([stream.read().decode("utf-8", "replace")], pa.string()))
        elif source in LINES:
            rows: list[tuple[int, str]] = []
            size = 0
            for offset, raw in lines(stream, start, end):
                rows.append((offset, raw.decode("utf-8", "replace")))
                size += len(raw)
                if size > 4 << 20 or len(rows) >= 10_000:
                    yield batch([r[0] for r in rows], pa.array([r[1] for r in rows], pa.string()))
                    rows, size = [], 0
            if rows:
                yield batch([r[0] for r in rows], pa.array([r[1] for r in rows], pa.string()))
        else:
            for base, held, begins, stops in runs(stream, start, end, ENDS.get(source) or MARKS[source], source in ENDS):
                yield batch(np.array(begins, np.int64) + base, _strings(held, begins, stops))


class Landed(DataSource):
    """The format `landed`, whose option `source` says which; each source is a format of its own name as well."""

    source = ""

    @classmethod
    def name(cls) -> str:
        return cls.source or "landed"

    def _options(self) -> tuple[str, str, int]:
        source = self.source or self.options.get("source", "")
        if source not in SOURCES:
            raise KeyError(f"unknown source: {source}")
        return source, self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES))

    def schema(self) -> str:
        self._options()
        return PIECES

    def reader(self, schema) -> DataSourceReader:
        return Batch(*self._options())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Stream(*self._options())


class Batch(DataSourceReader):
    def __init__(self, source: str, path: str, split_bytes: int):
        self.source, self.path, self.split_bytes = source, path, split_bytes

    def partitions(self) -> list[Split]:
        return splits(files(self.path), self.path, self.split_bytes, self.source in WHOLE) or [Split("", "", 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return read_split(self.source, partition) if partition.value[1] else iter(())


class Stream(DataSourceStreamReader):
    """Files as they land, each once.

    An offset has the time of the newest file, and the names of the files that
    are no more than GRACE older: what is older than that counts as read, so
    that offsets don't grow with all that ever landed.
    """

    def __init__(self, source: str, path: str, split_bytes: int):
        self.source, self.path, self.split_bytes = source, path, split_bytes

    def initialOffset(self) -> dict:
        return {"at": 0, "names": {}}

    def latestOffset(self) -> dict:
        there = files(self.path)
        at = max((f.mtime_ns or 0 for f in there), default=0)
        return {"at": at, "names": {f.path: True for f in there if (f.mtime_ns or 0) >= at - GRACE}}

    @staticmethod
    def _read(f: pafs.FileInfo, offset: dict) -> bool:
        return f.path in offset["names"] or (f.mtime_ns or 0) < offset["at"] - GRACE

    def partitions(self, start: dict, end: dict) -> list[Split]:
        new = [f for f in files(self.path) if self._read(f, end) and not self._read(f, start)]
        return splits(new, self.path, self.split_bytes, self.source in WHOLE)

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return read_split(self.source, partition)

    def commit(self, end: dict) -> None:
        pass


def _format(source_id: str) -> type[Landed]:
    return type(f"Landed_{source_id}", (Landed,), {"source": source_id, "__doc__": f"The format `{source_id}`."})


#: Every format by its name.
FORMATS: dict[str, type[Landed]] = {"landed": Landed} | {s: _format(s) for s in SOURCES}


def register(spark: SparkSession) -> None:
    for source in FORMATS.values():
        spark.dataSource.register(source)


def records_of(found: DataFrame, source: str, journal_no: str = "", journal_part: str = "", **given) -> DataFrame:
    """Records of a source's pieces(file, line, value). line is where a record stands in its file, in bytes.

    A bibliographic block that other text parts from the next one has no end of
    its own: in a whole file it runs on to the end of a later block, here it ends
    with its piece and is no record.
    """
    if source == "journal":
        return journal.journal_records(found.withColumns({"journal_no": F.lit(journal_no), "journal_part": F.lit(journal_part)}))
    if source == "journal_listing":
        return journal.journals(found)
    if source == "google_patents":
        rows = found.where(F.trim("value") != "").select("file", "line", F.from_json("value", readers.PATENT_EXPORT).alias("r")).select("file", "line", "r.*")
        return readers.finish(readers.patent_export_records(rows), source, "patent", **given)
    if source == "patentscope":
        return readers.finish(readers.biblio_records(found), source, "patent", **given)
    if source == "openalex":
        return readers.finish(readers.work_records(found), source, "publication", **given)
    if source not in readers.LISTINGS:
        raise KeyError(f"unknown source: {source}")
    return readers.finish(readers.card_records(found, readers.LISTINGS[source]), source, "rd", clean=("applicants",), **given)


def read(spark: SparkSession, source: str, path: str, split_bytes: int = SPLIT_BYTES, **given) -> DataFrame:
    """The records of landed files, as the source's reader gives them, but of any size of file."""
    if source not in SOURCES:
        raise KeyError(f"unknown source: {source}")
    register(spark)
    return records_of(spark.read.format(source).option("split_bytes", split_bytes).load(path), source, **given)


def stream(spark: SparkSession, source: str, path: str, split_bytes: int = SPLIT_BYTES, **given) -> DataFrame:
    """The same of files as they land, as a stream."""
    if source not in SOURCES:
        raise KeyError(f"unknown source: {source}")
    register(spark)
    return records_of(spark.readStream.format(source).option("split_bytes", split_bytes).load(path), source, **given)
