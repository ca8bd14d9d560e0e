"""Batch jobs: compositions that a scheduler runs, each a function of a session and paths."""

from __future__ import annotations

import datetime
import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corvane.operators import archive as blocks
from corvane.operators import export, quality, sinks
from corvane.operators.dedupe import keep_first
from corvane.operators.resolve import merge_rate
from corvane.operators.taxonomy import classified
from corvane.plans.engine import ORDER, Engine, parsed
from corvane.sources import journal
from corvane.sources.landed import _system
from corvane.sources.readers import READERS, records_jsonl, whole_files
from corvane.sources.reference import baseline_rows, driver_json, golden_queries, holdout_rows, recorded, tolerances

SCHEME = "^[a-z0-9]+:/*"
PROBE_QUERY = "lithium extraction recycling"


def harvest(spark: SparkSession, paths: dict[str, str], out: str | None = None, check: bool = False, fetched_at: str | None = None) -> DataFrame:
    """Ingests landed files, writes the store, and returns the statistics; with check, ValueError where a source is not complete enough, and the store stays as it was.

    Files are read once: the job that writes counts as well. What it writes takes
    the store's place when it has passed the check. Without a store to write, the
    same job ends in nothing.
    """
    records, stats = quality.observed_stats(parsed(spark, paths, fetched_at), [s for s in READERS if s in paths], lambda df: keep_first(df, ["source_id", "source_url"], ORDER))
    if out is None:
        records.write.format("noop").mode("overwrite").save()
    else:
        aside = f"{out.rstrip('/')}.{uuid.uuid4().hex}"
        sinks.write_store(records, aside)
    found = stats()
    low = [r["source_id"] for r in quality.incomplete_sources(found).collect()] if check else []
    if out is not None:
        system, target = _path(spark, out)
        if low:
            system.delete(_path(spark, aside)[1], True)
        else:
            system.delete(target, True)
            system.rename(_path(spark, aside)[1], target)
    if low:
        raise ValueError(f"incomplete: {', '.join(sorted(low))}")
    return found


def _path(spark: SparkSession, name: str):
    """(file system, path) of a name."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def journal_plan(spark: SparkSession, listing: str, numbers: list[str] | None = None, since: int | None = None, latest: int | None = 1, all_parts: bool = False) -> DataFrame:
    """(journal_no, published, label, file_name, slug): what a harvest of a listing page would read; all_parts takes those without applications as well."""
    chosen = journal.select_journals(journal.list_journals(spark, listing), numbers, since, latest)
    parts = journal.all_parts(chosen) if all_parts else journal.application_parts(chosen)
    return parts.join(F.broadcast(chosen.select("journal_no", "published").distinct()), "journal_no").select("journal_no", "published", "label", "file_name", "slug")


def export_patents(rows: DataFrame, out: str, **options) -> DataFrame:
    """Writes the selected publications as Parquet and returns the counts of the volume check over what was written."""
    sinks.write_parquet(export.export(rows, **options), out)
    country = options.get("country", "IN")
    written = rows.sparkSession.read.parquet(out)
    return export.volume(written.withColumn("publication_number", F.concat(F.lit(f"{country}-"), "publication_number")), f"{country}-")


def harvest_journal(spark: SparkSession, texts: dict[tuple[str, str], str], archive: str, store: str) -> tuple[int, dict[tuple[str, str], str]]:
    """Reads journal parts, archives all their records, and appends new candidates. Returns how many, and the parts that failed, which stop no other.

    All parts are one job. Only where that fails they are taken one by one, to
    tell which of them it was.
    """
    there, failed = {}, {}
    for part, path in texts.items():
        system, where = _path(spark, path)
        if system.exists(where):
            there[part] = path
        else:
            failed[part] = f"no such file: {path}"
    try:
        return _harvested(spark, there, archive, store), failed
    except Exception as error:
        if len(there) == 1:
            return 0, failed | {part: str(error) for part in there}
    added = 0
    for part, path in there.items():
        try:
            added += _harvested(spark, {part: path}, archive, store)
        except Exception as error:
            failed[part] = str(error)
    return added, failed


def _harvested(spark: SparkSession, texts: dict[tuple[str, str], str], archive: str, store: str) -> int:
    """Archives the records of journal parts and stores their new candidates, whose number is returned."""
    if not texts:
        return 0
    parts = None
    for (number, part), path in texts.items():
        one = whole_files(spark, path).withColumns({"journal_no": F.lit(number), "journal_part": F.lit(part)})
        parts = one if parts is None else parts.unionByName(one)
    found = journal.journal_records(parts).cache()
    try:
        sinks.write_archive(found, archive)
        fresh = journal.new_candidates(journal.candidates(found), records_jsonl(spark, f"{store}/part-*"))
        seen = Observation()
        sinks.append_candidates(keep_first(fresh, ["source_url"], ["file", "line"]).observe(seen, F.count(F.lit(1)).alias("n")), None, store)
        return seen.get["n"]
    finally:
        found.unpersist()


def evaluate(engine: Engine, holdout_path: str) -> DataFrame:
    """Hold-out scores of the golden records' predictions."""
    holdout = holdout_rows(engine.spark, driver_json(engine.spark, holdout_path))
    golden = engine.records.where(F.coalesce("fixture_id", F.lit("")) != "")
    return quality.evaluate_holdout(classified(golden, engine.taxonomy), holdout, golden)


def measure(engine: Engine, holdout_path: str, searches: int = 50) -> DataFrame:
    """(metric, value) of what the baseline tracks: hold-out scores, merge rate, and the mean time of a search."""
    out = [(f"{r['task']}_{m}", float(r[m])) for r in evaluate(engine, holdout_path).collect() for m in ("subset_accuracy", "macro_f1")]
    out.append(("org_merge_rate", float(merge_rate(engine.aliases).first()["rate"] or 0.0)))
    began = time.perf_counter()
    for _ in range(searches):
        engine.search(PROBE_QUERY)[1].collect()
    out.append(("search_ms_avg", (time.perf_counter() - began) / searches * 1000))
    return engine.spark.createDataFrame(out, "metric string, value double")


def check_drift(engine: Engine, holdout_path: str, baseline_path: str, searches: int = 50) -> tuple[bool, DataFrame]:
    """Whether nothing drifted from the recorded baseline, and the report."""
    doc = driver_json(engine.spark, baseline_path)
    report = quality.drift(measure(engine, holdout_path, searches), baseline_rows(engine.spark, doc), *tolerances(doc)).orderBy("metric")
    return quality.drift_ok(report), report


def record_baseline(engine: Engine, holdout_path: str, baseline_path: str, today: str | None = None, searches: int = 50) -> dict:
    """Measures and puts the figures in place of the baseline's; its other entries stay, and so do the kinds of metrics that it has."""
    doc = recorded(driver_json(engine.spark, baseline_path), quality.recorded_baseline(measure(engine, holdout_path, searches)), today or datetime.date.today().isoformat())
    _write_text(engine.spark, baseline_path, json.dumps(doc, indent=2) + "\n")
    return doc


def check_golden(engine: Engine, queries_path: str) -> list[tuple[str, str, str | None]]:
    """(query, expected, found) of the golden queries whose best hit is another record; the corpus ought to be the golden one alone."""
    out = []
    for query, expected in golden_queries(driver_json(engine.spark, queries_path)):
        best = engine.search(**query, limit=1)[1].select("doc_id").first()
        if best is None or best[0] != expected:
            out.append((query["q"], expected, best and best[0]))
    return out


def dump_graph(engine: Engine, path: str) -> str:
    return sinks.write_graph(*engine.graph(), path)


def backup_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256) of the files under a folder that a backup holds, paths relative to it.

    A file streams by its hash, so that it may be of any size. Of a store that
    pyarrow does not know, files are read whole, and none may exceed 2 GB.
    """
    system, base = _path(spark, root)
    # A view's path is that of the store behind it.
    store = system.resolvePath(base).toString().rstrip("/")
    store = _without_scheme(store) if store.startswith("file:") else store
    try:
        inner, chunk_bytes = _system(store)[1].rstrip("/"), blocks.BLOCK_BYTES
    except (pa.ArrowInvalid, OSError):
        return _files(spark, root).select("path", "sha256")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = _system(store)[0]
        for path in (p for batch in batches for p in batch.column(0).to_pylist()):
            sha = hashlib.sha256()
            with there.open_input_stream(f"{inner}/{path}") as stream:
                while chunk := stream.read(chunk_bytes):
                    sha.update(chunk)
            yield pa.RecordBatch.from_pydict({"path": [path], "sha256": [sha.hexdigest()]})

    return _held(spark, root).select("path").repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(hashed, "path string, sha256 string")


def _files(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256, content) of what a backup holds."""
    return _held(spark, root).select("path", F.sha2("content", 256).alias("sha256"), "content")


def _held(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of what a backup holds; content is only read where it is asked for. Hidden files (a leading dot or underscore) are none of Spark's, nor of a backup."""
    system, base = _path(spark, root)
    start = len(_without_scheme(system.makeQualified(base).toString().rstrip("/"))) + 1
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.substring(F.regexp_replace("path", SCHEME, "/"), start + 1, 1 << 20)
    # A scan passes over files without content, so those come from the listing.
    listed, empty = system.listFiles(base, True), []
    while listed.hasNext():
        one = listed.next()
        name = _without_scheme(one.getPath().toString())[start:]
        if not one.getLen() and not any(x.startswith((".", "_")) for x in name.split("/")):
            empty.append((name, bytearray()))
    rows = files.select(path.alias("path"), "content").unionByName(spark.createDataFrame(empty, "path string, content binary"))
    return rows.where(quality.backed_up(F.col("path")))


def _without_scheme(path: str) -> str:
    return re.sub(SCHEME, "/", path)


def backup(spark: SparkSession, root: str, archive: str) -> int:
    """Writes the files under a folder that a backup holds as Parquet rows (path, sha256, content), in place of an earlier archive. Returns how many.

    The archive lies outside the folder. Files are hashed and written where they
    are read; each is one row, so none may exceed 2 GB.
    """
    _files(spark, root).write.mode("overwrite").parquet(archive)
    return spark.read.parquet(archive).count()


def verify_backup(spark: SparkSession, archive: str, root: str | None = None) -> DataFrame:
    """(path, status) of files whose archived bytes differ from their recorded hash; with a folder, of its files that differ from the archive as well."""
    held = spark.read.parquet(archive)
    wrong = quality.manifest_difference(held.select("path", "sha256"), quality.manifest(held))
    return wrong if root is None else wrong.unionByName(quality.manifest_difference(held.select("path", "sha256"), backup_manifest(spark, root))).distinct()


def restore(spark: SparkSession, archive: str, dest: str) -> int:
    """Writes an archive's files under a folder, by the executors, and returns how many; ValueError for a path that leaves it, before any is written."""
    return blocks.restore(spark.read.parquet(archive).withColumn("block", F.lit(0).cast("long")), dest)


def _write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(content)
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    _write_bytes(spark, path, text.encode())


def in_order(steps: list[tuple[str, Callable[[], object]]], log: Callable[[str], None] = print) -> bool:
    """Runs steps one after another, stops at the first that fails, and says so."""
    for name, step in steps:
        try:
            step()
        except Exception as error:
            log(f"{name}: failed: {error}")
            return False
        log(f"{name}: ok")
    return True
