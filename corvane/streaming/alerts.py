"""Fire-once alerts: each record reaches each subscription at most once, for ever.

What a subscription is offered becomes seen whether or not it matches, and of
records with one key the first in order decides. Matching goes by a reverse
index of the subscriptions, and state is coded by intervals: as every record is
offered to all subscriptions of its time alike, the last batch that offered a
key and the batch that a subscription began with tell whether it has seen it.
Neither makes the product of records and subscriptions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.functions.text import token_set, tokens
from corvane.operators.dedupe import keep_first

SUBSCRIPTION = "sub_id string, mineral string, stage string, kind string, q string"
SEEN = "sub_id string, record_key string"
#: Subscriptions of a share, and shares of records, where all pairs are listed.
BROADCAST_SUBSCRIPTIONS, SALTS = 10_000, 32
#: The value that every record has, as subscriptions without any condition ask for.
ANYTHING = "*"


def record_key(doc_id: str = "doc_id", source_url: str = "source_url") -> Column:
    return F.coalesce(F.nullif(F.col(doc_id), F.lit("")), F.nullif(F.col(source_url), F.lit("")))


def _marked(mark: str, values: Column) -> Column:
    """Values of a field under its mark, so that fields don't meet; what is null or empty goes."""
    return F.transform(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != ""), lambda x: F.concat(F.lit(mark), x))


def record_values(records: DataFrame, order: list[str]) -> DataFrame:
    """(record_key, title, values): the first record of each key, with all that a condition can ask for: its minerals, stages and kind, and the tokens of title and abstract."""
    rows = records.select(record_key().alias("record_key"), F.coalesce("title", F.lit("")).alias("title"), "abstract", "kind", "mineral_ids", "stage_ids", *[F.col(c).alias(f"__{k}") for k, c in enumerate(order)])
    first = keep_first(rows.where(F.col("record_key").isNotNull()), ["record_key"], [f"__{k}" for k in range(len(order))])
    words = tokens(F.concat_ws(" ", "title", F.coalesce("abstract", F.lit(""))))
    values = F.array_distinct(F.concat(_marked("m=", F.col("mineral_ids")), _marked("s=", F.col("stage_ids")), _marked("k=", F.array("kind")), F.transform(words, lambda x: F.concat(F.lit("t="), x))))
    return first.select("record_key", "title", values.alias("values"))


def conditions(subs: DataFrame) -> DataFrame:
    """subs with wanted, the values that a record must have: the mineral, stage and kind, and all tokens of the query; what is empty asks nothing."""
    wanted = F.concat(*[_marked(m, F.array(c)) for m, c in (("m=", "mineral"), ("s=", "stage"), ("k=", "kind"))], _marked("t=", token_set(F.col("q"))))
    return subs.withColumn("wanted", F.array_distinct(wanted))


OFFERED = "record_key string, value string, title string"


def offered_values(records: DataFrame, wanting: DataFrame, order: list[str]) -> DataFrame:
    """(record_key, value, title): for each record of record_values() a row of ANYTHING, with its title, and one for each of its values that any of conditions(subs) asks for."""
    first = record_values(records, order).select("record_key", "title", F.explode(F.concat("values", F.array(F.lit(ANYTHING)))).alias("value"))
    asked = wanting.select(F.explode("wanted").alias("value")).distinct().withColumn("asked", F.lit(True))
    kept = first.join(asked, "value", "left").where(F.col("asked").isNotNull() | (F.col("value") == ANYTHING))
    return kept.select("record_key", "value", F.when(F.col("value") == ANYTHING, F.col("title")).alias("title"))


def _written(offered: DataFrame, path: str) -> DataFrame:
    offered.write.mode("overwrite").parquet(path)
    return offered.sparkSession.read.schema(OFFERED).parquet(path)


def reverse_index(subs: DataFrame, hits: DataFrame) -> DataFrame:
    """(value, sub_id, wanted): conditions(subs) that records with hits(record_key, value) may meet, each under the rarest value it asks for.

    A subscription that asks for a value which no record has can't be met and is
    left out, and so is one that asks for nothing.
    """
    known = hits.groupBy("value").agg(F.count("*").alias("n"))
    asked = subs.select("sub_id", "wanted", F.explode("wanted").alias("value"))
    rarest = asked.join(known, "value").groupBy("sub_id").agg(F.min_by("value", F.struct("n", "value")).alias("value"), F.count("*").alias("found"), F.first("wanted").alias("wanted"))
    return rarest.where(F.col("found") == F.size("wanted")).select("value", "sub_id", "wanted")


def matched(offered: DataFrame, wanting: DataFrame) -> DataFrame:
    """(sub_id, record_key, title): which conditions(subs) the records of offered_values() meet.

    A record looks up its own values in the reverse index; of a subscription
    found so, the wanted values are counted among the record's. Only joins by
    equal values: a subscription that matches nothing costs its entry alone.
    """
    hits, titles = offered.where(F.col("value") != ANYTHING).select("record_key", "value"), offered.where(F.col("value") == ANYTHING)
    index = reverse_index(wanting, hits)
    found = hits.join(index, "value").select("record_key", "sub_id", "wanted")
    own = hits.groupBy("record_key").agg(F.collect_set("value").alias("own"))
    met = found.join(own, "record_key").where(F.size(F.array_intersect("wanted", "own")) == F.size("wanted")).select("record_key", "sub_id")
    # As an empty query asks nothing, subscriptions to anything are met by all records alike.
    everywhere = pairs(titles.select("record_key", "title"), wanting.where(F.size("wanted") == 0).select("sub_id"))
    return met.join(titles, "record_key").select("sub_id", "record_key", "title").unionByName(everywhere.select("sub_id", "record_key", "title"))


def pairs(keys: DataFrame, subs: DataFrame) -> DataFrame:
    """Every key with every subscription, for state that is to be listed in full: subscriptions in shares, each met by shares of the keys, so that no task has them all."""
    shares = max(1, -(-subs.count() // BROADCAST_SUBSCRIPTIONS))
    dealt = subs.withColumns({"__share": F.pmod(F.xxhash64("sub_id"), F.lit(shares)), "__salt": F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))})
    spread = keys.withColumns({"__share": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))), "__salt": F.pmod(F.xxhash64("record_key"), F.lit(SALTS)).cast("int")})
    return spread.join(dealt, ["__share", "__salt"]).drop("__share", "__salt")


def check(records: DataFrame, subs: DataFrame, seen: DataFrame, order: list[str], scratch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(fired, newly seen) of one batch, against state listed in full, seen(sub_id, record_key): what was offered before is left out, all else becomes seen and what matches fires.

    The second is the product by its nature, and made only if it is asked for;
    AlertTable keeps the same state without it. With a scratch folder, what the
    records offer is made once and written there.
    """
    wanting, known = conditions(subs), seen.select("sub_id", "record_key")
    offered = offered_values(records, wanting, order)
    offered = _written(offered, scratch) if scratch else offered
    fired = matched(offered, wanting).join(known, ["sub_id", "record_key"], "left_anti")
    keys = offered.where(F.col("value") == ANYTHING).select("record_key")
    new = pairs(keys, subs.select("sub_id")).join(known, ["sub_id", "record_key"], "left_anti")
    return fired.select("sub_id", F.col("record_key").alias("record_id"), "title"), new.select("sub_id", "record_key")


def subscribe(subs: DataFrame, mineral: str = "", stage: str = "", kind: str = "", q: str = "") -> tuple[str, DataFrame]:
    """The id of a new subscription, numbered after those there are, and all subscriptions with it."""
    sub_id = f"sub-{subs.count() + 1:03d}"
    row = subs.sparkSession.createDataFrame([(sub_id, mineral, stage, kind, q)], SUBSCRIPTION)
    return sub_id, subs.select(*row.columns).unionByName(row)


def seeded(sub_id: str, corpus: DataFrame) -> DataFrame:
    """What a new subscription has seen: the corpus as it is, so that its history isn't replayed."""
    return corpus.select(F.lit(sub_id).alias("sub_id"), record_key().alias("record_key")).where("record_key is not null").distinct()


def folded(subs: DataFrame, seen: DataFrame, legacy: DataFrame) -> DataFrame:
    """State listed in full, with keys that were once seen by all subscriptions together, legacy(record_key), put to each."""
    each = pairs(legacy.select("record_key").distinct(), subs.select("sub_id")).select("sub_id", "record_key")
    return seen.select("sub_id", "record_key").unionByName(each).distinct()


class AlertTable:
    """Alerts over a stream: subscriptions and state as tables under a folder, appended batch by batch.

    subscriptions has, besides what is asked, `start`, the batch a subscription
    began with, and `seed`, the number of the corpus it was seeded with. seen has
    (record_key, batch): a key is seen by subscriptions that began no later than
    its last batch. seeds has (record_key, present, seed): the changes from one
    seeding corpus to the next. legacy has (record_key, upto): seen by all
    subscriptions up to a number. So state grows with records and subscriptions,
    and never with their product.

    Each batch writes its state and its alerts to folders of its own number and
    replaces them when the batch is replayed, so a restart neither loses nor
    repeats an alert.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        """(file system, path) of something in the folder."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _read(self, name: str, schema: str) -> DataFrame:
        system, where = self._at(name)
        if not system.exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _subscribed(self) -> DataFrame:
        rows = self._read("subscriptions", f"{SUBSCRIPTION}, start long, seed long, batch long")
        return rows.withColumn("start", F.coalesce("start", F.lit(0).cast("long"))).withColumnRenamed("batch", "number")

    def subscriptions(self) -> DataFrame:
        return self._subscribed().select(*[c.split()[0] for c in SUBSCRIPTION.split(", ")])

    def keys(self, before: int | None = None) -> DataFrame:
        """(record_key, last): offered keys with the last batch that was recorded, of those before a batch."""
        rows = self._read("seen", "record_key string, batch long")
        rows = rows if before is None else rows.where(F.col("batch") < before)
        return rows.groupBy("record_key").agg(F.max("batch").alias("last"))

    def _seeds(self) -> DataFrame:
        return self._read("seeds", "record_key string, present boolean, seed long")

    def seen(self) -> DataFrame:
        """(sub_id, record_key): the state listed in full, which is the product; for a look at small tables."""
        subs = self._subscribed()
        offered = pairs(self.keys(), subs.select("sub_id", "start")).where("last >= start").select("sub_id", "record_key")
        legacy = pairs(self._legacy(), subs.select("sub_id", "number")).where("upto >= number").select("sub_id", "record_key")
        known = pairs(self._seeds(), subs.where("seed is not null").select("sub_id", F.col("seed").alias("until"))).where("seed <= until")
        return offered.unionByName(legacy).unionByName(_held(known)).distinct()

    def _legacy(self) -> DataFrame:
        return self._read("legacy", "record_key string, upto long").groupBy("record_key").agg(F.max("upto").alias("upto"))

    def alerts(self) -> DataFrame:
        return self._read("alerts", "sub_id string, record_id string, title string, batch long").drop("batch")

    def _reserved(self) -> int:
        """The number of a new subscription: the first of which no other caller has made the mark, as only one can create a file."""
        n = self._subscribed().count()
        while True:
            n += 1
            system, where = self._at(f"_ids/{n}")
            try:
                system.create(where, False).close()
                return n
            except Exception as error:
                if not system.exists(where):
                    raise error

    def subscribe(self, mineral: str = "", stage: str = "", kind: str = "", q: str = "", corpus: DataFrame | None = None) -> str:
        n, last = self._reserved(), self._read("seen", "record_key string, batch long").agg(F.max("batch")).first()[0]
        start = 0 if last is None else last + 1
        seed = self._seed(corpus) if corpus is not None else None
        row = self.spark.createDataFrame([(f"sub-{n:03d}", mineral, stage, kind, q, start, seed)], f"{SUBSCRIPTION}, start long, seed long")
        row.write.mode("overwrite").parquet(f"{self.path}/subscriptions/batch={n}")
        return f"sub-{n:03d}"

    def _seed(self, corpus: DataFrame) -> int:
        """The number of a corpus, of which only what differs from the one before is written."""
        used = [df.agg(F.max("seed")).first()[0] or 0 for df in (self._seeds(), self._subscribed())]
        seed = max(used) + 1
        now = corpus.select(record_key().alias("record_key")).where("record_key is not null").distinct().withColumn("now", F.lit(True))
        was = self._seeds().groupBy("record_key").agg(F.max_by("present", "seed").alias("was"))
        both = now.join(was, "record_key", "full").select("record_key", F.coalesce("now", F.lit(False)).alias("present"), F.coalesce("was", F.lit(False)).alias("was"))
        both.where("present <> was").select("record_key", "present").write.mode("overwrite").parquet(f"{self.path}/seeds/seed={seed}")
        return seed

    def fold(self, legacy: DataFrame) -> None:
        """Takes over keys that were seen by all subscriptions together, legacy(record_key): those there are now have seen them, later ones have not."""
        upto = self._subscribed().agg(F.max("number")).first()[0]
        if upto is not None:
            legacy.select("record_key").where("record_key is not null").distinct().withColumn("upto", F.lit(upto).cast("long")).write.mode("append").parquet(f"{self.path}/legacy")

    def check(self, records: DataFrame, batch: int, order: list[str]) -> DataFrame:
        """Runs one batch and returns its alerts."""
        subs = self._subscribed().where(F.col("start") <= batch)
        wanting = conditions(subs)
        offered = _written(offered_values(records, wanting, order), f"{self.path}/_offered/batch={batch}")
        keys = self.keys(batch)
        met = matched(offered, wanting).join(subs.select("sub_id", "start", "number", F.col("seed").alias("until")), "sub_id").join(keys, "record_key", "left").join(self._legacy(), "record_key", "left")
        met = met.where("(last is null or last < start) and (upto is null or upto < number)")
        # Only what matches is looked up among the seeds.
        known = _held(met.where("until is not null").select("sub_id", "record_key", "until").join(self._seeds(), "record_key").where("seed <= until"))
        fired = met.join(known, ["sub_id", "record_key"], "left_anti")
        # Alerts first: a batch whose state is missing is replayed whole.
        fired.select("sub_id", F.col("record_key").alias("record_id"), "title").write.mode("overwrite").parquet(f"{self.path}/alerts/batch={batch}")
        newest = subs.agg(F.max("start")).first()[0]
        fresh = offered.where(F.col("value") == ANYTHING).select("record_key").join(keys, "record_key", "left").where(F.col("last").isNull() | (F.col("last") < F.lit(newest if newest is not None else batch)))
        fresh.select("record_key").write.mode("overwrite").parquet(f"{self.path}/seen/batch={batch}")
        system, where = self._at(f"_offered/batch={batch}")
        system.delete(where, True)
        return self.spark.read.schema("sub_id string, record_id string, title string").parquet(f"{self.path}/alerts/batch={batch}")

    def stream(self, records: DataFrame, order: list[str], then: Callable[[DataFrame, int], None] | None = None, checkpoint: str | None = None) -> StreamingQuery:
        """Checks a stream of records, all that is there now and batch by batch."""

        def run(batch: DataFrame, number: int) -> None:
            fired = self.check(batch, number, order)
            if then:
                then(fired, number)

        return records.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint or f"{self.path}/checkpoint").trigger(availableNow=True).start()


def _held(rows: DataFrame) -> DataFrame:
    """(sub_id, record_key) of rows(sub_id, record_key, present, seed) whose last change put the key into the corpus."""
    return rows.groupBy("sub_id", "record_key").agg(F.max_by("present", "seed").alias("present")).where("present").select("sub_id", "record_key")
