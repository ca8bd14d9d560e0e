"""Archives in blocks: any size of file, the changed block named, files put back by the executors."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import archive
from corvane.plans import jobs


def made(folder):
    r = random.Random(2)
    sizes = {"a.bin": 0, "b.bin": 1, "d/c.bin": 99, "d/e/f.bin": 100, "d/e/g h é.bin": 101, "big.bin": 12_345}
    for name, size in sizes.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(r.randbytes(size))
    (folder / "_hidden").write_text("x")
    return sizes


def contents(folder, names):
    return {n: (folder / n).read_bytes() for n in names}


def root_of(data, size):
    level = [hashlib.sha256(data[k : k + size]).digest() for k in range(0, max(len(data), 1), size)]
    while len(level) > 1:
        level = [hashlib.sha256(level[k] + level[k + 1]).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0].hex()


def test_round_trip_and_roots(spark, tmp_path):
    sizes = made(tmp_path / "in")
    roots = archive.write_archive(spark, str(tmp_path / "in"), str(tmp_path / "arc"), 100).collect()
    data = contents(tmp_path / "in", sizes)
    assert {r.path: (r.n_blocks, r.root) for r in roots} == {n: (max(1, -(-len(d) // 100)), root_of(d, 100)) for n, d in data.items()}
    assert archive.faults(spark, str(tmp_path / "arc")).count() == 0 and archive.difference(spark, str(tmp_path / "arc"), str(tmp_path / "in"), 100).count() == 0
    assert archive.restore(archive.archived(spark, str(tmp_path / "arc")), str(tmp_path / "out")) == len(sizes)
    assert contents(tmp_path / "out", sizes) == data and not [x for x in os.listdir(tmp_path / "out") if x.startswith(".")]


def test_the_changed_block_is_named(spark, tmp_path):
    sizes = made(tmp_path / "in")
    archive.write_archive(spark, str(tmp_path / "in"), str(tmp_path / "arc"), 100)
    raw = bytearray((tmp_path / "in/big.bin").read_bytes())
    raw[7_777] ^= 1
    (tmp_path / "in/big.bin").write_bytes(raw)
    (tmp_path / "in/b.bin").unlink()
    (tmp_path / "in/new.bin").write_bytes(b"n")
    got = {tuple(r) for r in archive.difference(spark, str(tmp_path / "arc"), str(tmp_path / "in"), 100).collect()}
    assert got == {("big.bin", 77, "changed"), ("b.bin", 0, "missing"), ("new.bin", 0, "new")} and len(sizes) == 6
    # An archive that was tampered with or has lost a block says so, and is not restored.
    held = archive.archived(spark, str(tmp_path / "arc"))
    bad = held.where("path <> 'd/c.bin' and not (path = 'big.bin' and block = 3)").withColumn("content", F.when(F.expr("path = 'd/e/g h é.bin' and block = 1"), F.lit(b"?")).otherwise(F.col("content")))
    bad.write.parquet(str(tmp_path / "bad/blocks"))
    spark.read.parquet(str(tmp_path / "arc/roots")).write.parquet(str(tmp_path / "bad/roots"))
    wrong = {tuple(r) for r in archive.faults(spark, str(tmp_path / "bad")).collect()}
    assert wrong == {("d/e/g h é.bin", 1, "changed"), ("big.bin", None, "torn"), ("d/c.bin", None, "torn")}
    with pytest.raises(Exception, match="not what was archived"):
        archive.restore(archive.archived(spark, str(tmp_path / "bad")), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists() or os.listdir(tmp_path / "none") == []


def test_paths_that_leave_the_folder(spark, tmp_path):
    for path in ("../x", "/etc/x", "a/../../x"):
        with pytest.raises(ValueError, match="leaves the folder"):
            archive.restore(spark.createDataFrame([(path, 0, hashlib.sha256(b"").hexdigest(), bytearray())], archive.BLOCKS), str(tmp_path / "out"))
    assert archive.restore(spark.createDataFrame([], archive.BLOCKS), str(tmp_path / "out")) == 0


def test_manifest_of_files_of_any_size(spark, tmp_path):
    sizes = made(tmp_path / "data")
    want = {n: hashlib.sha256(d).hexdigest() for n, d in contents(tmp_path / "data", sizes).items()}
    got = lambda: {r.path: r.sha256 for r in jobs.backup_manifest(spark, str(tmp_path / "data")).collect()}
    # What a row can't hold, for the limit of 2 GB.
    limit = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(limit, 1_000)
    try:
        assert got() == want and len(want) == 6
    finally:
        spark.conf.unset(limit)
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.away.link./in", f"file://{tmp_path}")
    assert {r.path: r.sha256 for r in jobs.backup_manifest(spark, "viewfs://away/in/data").collect()} == want
