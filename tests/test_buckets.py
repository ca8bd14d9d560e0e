"""Stores in hash buckets: equal to a rebuild in any order of arrival, untouched buckets left alone, two writers at once."""

import itertools
import os
import threading

import pytest
from pyspark.sql import functions as F

from corvane.operators import buckets, dedupe
from corvane.operators.buckets import BucketStore, IncrementalCorpus

RECORD = "kind string, appl_no string, source_id string, source_url string, tier int, file string, line long"
ROWS = [("patent", f"IN2018{k % 40:08d}{'AB'[k % 2]}", "s", f"u{k}", k % 3, "f", k) for k in range(90)] + [("rd", None, "lab", f"u{k % 7}", 1, "g", k) for k in range(20)]
GOLDEN = [("patent", "IN201800000003", "gold", "g", 0, "a", 0), ("rd", "", "lab", "u2", 0, "a", 1)]


def rows_of(df):
    return sorted(map(str, df.select(*[c.split()[0] for c in RECORD.split(", ")]).collect()))


def test_corpus_in_any_order_of_arrival(spark, tmp_path):
    whole, golden = spark.createDataFrame(ROWS, RECORD), spark.createDataFrame(GOLDEN, RECORD)
    want = rows_of(dedupe.merged(golden, whole, ["tier", "file", "line"]))
    parts = [ROWS[:30], ROWS[30:95], ROWS[95:]]
    for n, order in enumerate(itertools.islice(itertools.permutations(parts), 0, 6, 2)):
        corpus = IncrementalCorpus(spark, str(tmp_path / str(n)), ["tier", "file", "line"], 8)
        for part in order:
            corpus.add(spark.createDataFrame(part, RECORD))
        corpus.add(spark.createDataFrame(order[0], RECORD))
        assert rows_of(IncrementalCorpus(spark, str(tmp_path / str(n)), ["tier", "file", "line"]).corpus(golden)) == want


def test_untouched_buckets_stay(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), "k", ["n"], 16)
    with pytest.raises(FileNotFoundError):
        store.rows()
    store.add(spark.range(500).select(F.col("id").cast("string").alias("k"), F.lit(5).alias("n"), F.lit("old").alias("v")))
    before = store._entry(store._last())["at"]
    touched = store.add(spark.createDataFrame([("7", 1, "new"), ("8", 9, "later"), (None, 0, "no key")], "k string, n int, v string"))
    after = store._entry(store._last())["at"]
    assert 1 <= len(touched) <= 2 and {int(b) for b in after if after[b] != before[b]} == set(touched)
    got = {r.k: r.v for r in store.rows().collect()}
    assert len(got) == 500 and got["7"] == "new" and got["8"] == "old"
    assert store.add(store.rows().limit(0)) == [] and store.rows().count() == 500
    assert not [f for f in os.listdir(tmp_path / "data") if f.startswith("fresh")]
    assert store.vacuum() == len(touched) and store.vacuum() == 0 and store.rows().count() == 500


def test_a_lost_writer_holds_nobody_up(spark, tmp_path, monkeypatch):
    store = BucketStore(spark, str(tmp_path), "k", ["n"], 2)
    rows = spark.createDataFrame([("a", 1)], "k string, n int")
    os.makedirs(tmp_path / "_log")
    (tmp_path / "_log/_00000000000000000001").touch()
    with pytest.raises(RuntimeError, match="faster"):
        store.add(rows, retries=1)
    monkeypatch.setattr(buckets, "TAKEN_FOR", -1)
    store.add(rows)
    assert store.rows().count() == 1


def test_two_writers_at_once(spark, tmp_path):
    failed = []

    def write(n):
        try:
            store = BucketStore(spark, str(tmp_path), "k", ["n"], 4)
            for part in range(2):
                store.add(spark.range(40).select(F.concat(F.lit("k"), F.col("id") + 20 * (n + part)).alias("k"), F.lit(n).alias("n")))
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = BucketStore(spark, str(tmp_path), "k", ["n"]).rows().collect()
    assert not failed and sorted(r.k for r in rows) == sorted(f"k{k}" for k in range(100))
    assert all(r.n == max(0, (int(r.k[1:]) - 40) // 20) for r in rows)
