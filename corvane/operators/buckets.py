"""A table of first winners by key, in hash buckets: what is added rewrites the buckets that it touches and no others."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.dedupe import identity, keep_first, not_stored

#: Buckets of a new store, and seconds after which a writer that took a number and made no entry counts as lost.
BUCKETS, TAKEN_FOR = 64, 60


class BucketStore:
    """Rows under a folder, one for each key: the first in an order, whenever it came.

    A commit writes the buckets it touches to a folder of its own, and then a log
    entry under the next number, which says where each bucket lies now. Only one
    writer can create an entry. One that comes second looks at what the other
    has changed: if their buckets differ it takes the number after that, else it
    makes its buckets anew. Readers follow the last entry, so they see all of a
    commit or none of it.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.order = spark, path.rstrip("/"), key, order
        self.buckets = self._entry(self._last())["n"] if self._last() else buckets

    def _fs(self, name: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _last(self) -> int:
        """The number of the last log entry; 0 without any."""
        system, where = self._fs("_log")
        if not system.exists(where):
            return 0
        return max((int(s.getPath().getName()) for s in system.listStatus(where) if s.getPath().getName().isdigit() and s.getLen()), default=0)

    def _entry(self, number: int) -> dict:
        if not number:
            return {"n": self.buckets, "at": {}, "schema": None}
        return json.loads(self.spark.read.text(f"{self.path}/_log/{number:020d}", wholetext=True).first()[0])

    def _committed(self, number: int, entry: dict) -> bool:
        """Whether this writer made the entry of a number. It is written aside and renamed, which no file that is there lets happen."""
        system, aside = self._fs(f"_log/.{uuid.uuid4().hex}")
        stream = system.create(aside, False)
        stream.write(json.dumps(entry).encode())
        stream.close()
        _, where = self._fs(f"_log/{number:020d}")
        # A mark that only one can create comes before the entry itself.
        _, mark = self._fs(f"_log/_{number:020d}")
        try:
            system.create(mark, False).close()
        except Exception:
            if not system.exists(mark):
                raise
            # A writer that was lost between its mark and its entry holds the number no longer than this.
            lost = not system.exists(where) and time.time() - system.getFileStatus(mark).getModificationTime() / 1000 > TAKEN_FOR
            if not lost:
                system.delete(aside, False)
                return False
        return not system.exists(where) and system.rename(aside, where)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _read(self, entry: dict, only: list[int] | None = None) -> DataFrame | None:
        """The rows of buckets, or of all, as an entry has them; none where there are none."""
        folders = [f"{self.path}/data/commit={c}/bucket={b}" for b, c in sorted(entry["at"].items()) if only is None or int(b) in only]
        return self.spark.read.schema(entry["schema"]).parquet(*folders) if folders else None

    def rows(self) -> DataFrame:
        """All winners; an error before anything was added."""
        entry = self._entry(self._last())
        if entry["schema"] is None:
            raise FileNotFoundError(f"nothing was added to {self.path}")
        found = self._read(entry)
        return found if found is not None else self.spark.createDataFrame([], entry["schema"])

    def add(self, rows: DataFrame, retries: int = 20) -> list[int]:
        """Puts rows to those there are and returns the numbers of the buckets that were rewritten. Rows without a key go; of equal keys the first in the order stays, whichever came first."""
        commit = uuid.uuid4().hex
        fresh = f"{self.path}/data/fresh-{commit}"
        rows.where(F.col(self.key).isNotNull()).withColumn("bucket", self.bucket()).write.partitionBy("bucket").parquet(fresh)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        new = self.spark.read.schema(f"{schema}, bucket int").parquet(fresh)
        # As many as there are buckets at most.
        touched = sorted(r[0] for r in new.select("bucket").distinct().collect())
        # Of each bucket, what it was made from and where it was written.
        made: dict[str, tuple[str, str]] = {}
        for k in range(retries):
            number = self._last()
            entry = self._entry(number)
            # What another commit has changed since is made again, and only that.
            stale = [b for b in touched if str(b) not in made or made[str(b)][0] != entry["at"].get(str(b), "")]
            if stale:
                held = self._read(entry, stale)
                part = new.where(F.col("bucket").isin(stale))
                both = part if held is None else part.unionByName(held.withColumn("bucket", self.bucket()))
                keep_first(both, [self.key], self.order).write.partitionBy("bucket").parquet(f"{self.path}/data/commit={commit}-{k}")
                made |= {str(b): (entry["at"].get(str(b), ""), f"{commit}-{k}") for b in stale}
            at = entry["at"] | {b: folder for b, (_, folder) in made.items()}
            if self._committed(number + 1, {"n": self.buckets, "at": at, "schema": schema}):
                system, where = self._fs(f"data/fresh-{commit}")
                system.delete(where, True)
                return touched
            time.sleep(min(5, 0.1 * 2**k))
        raise RuntimeError(f"another writer was faster {retries} times")


    def vacuum(self) -> int:
        """Deletes folders of buckets that the last entry does not name, and returns how many. No writer or reader may be at work."""
        at = {(c, int(b)) for b, c in self._entry(self._last())["at"].items()}
        system, where = self._fs("data")
        gone = 0
        for commit in system.listStatus(where) if system.exists(where) else ():
            for bucket in system.listStatus(commit.getPath()):
                names = commit.getPath().getName(), bucket.getPath().getName()
                if names[1].startswith("bucket=") and (names[0].removeprefix("commit="), int(names[1].removeprefix("bucket="))) not in at:
                    gone += system.delete(bucket.getPath(), True)
        return gone


class IncrementalCorpus:
    """The harvested part of a corpus: of each identity the first record in the readers' order, kept as landings come in, in any order."""

    def __init__(self, spark: SparkSession, path: str, order: list[str], buckets: int = BUCKETS):
        self.store = BucketStore(spark, path, "__identity", order, buckets)

    def add(self, harvested: DataFrame) -> list[int]:
        return self.store.add(harvested.withColumn("__identity", identity()))

    def corpus(self, golden: DataFrame) -> DataFrame:
        """Golden records and what the harvested ones add to them, as dedupe.merged() makes it of everything at once."""
        known = golden.select(identity().alias("__identity"))
        fresh = not_stored(self.store.rows(), known, ["__identity"]).drop("__identity")
        return golden.unionByName(fresh, allowMissingColumns=True)
