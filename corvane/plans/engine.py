"""The engine: everything that can be asked of a corpus, as one facade."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import analytics, corpus, graph, quality, search
from corvane.operators.dedupe import with_duplicate_counts
from corvane.operators.resolve import alias_index, resolved
from corvane.sources.readers import READERS
from corvane.sources.reference import Taxonomy, read_aliases, read_taxonomy
from corvane.streaming.alerts import AlertTable

DETAIL = ("doc_id", "title", "abstract", "kind", "mineral_ids", "stage_ids", "process_family_ids", "applicants", "orgs", "filing_date", "legal_status", "source_id", "source_url")
ORDER = ["tier", "file", "line"]


def parsed(spark: SparkSession, paths: dict[str, str], fetched_at: str | None = None) -> DataFrame:
    """All records of landed files by source, in the readers' order by tier."""
    out = None
    for tier, (source, read) in enumerate(READERS.items()):
        if source in paths:
            part = read(spark, paths[source], fetched_at=fetched_at).withColumn("tier", F.lit(tier))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    return out


def ingest(spark: SparkSession, paths: dict[str, str], fetched_at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, stats) of landed files by source: all records, keep-first by source and address in the readers' order."""
    out = parsed(spark, paths, fetched_at)
    kept = with_duplicate_counts(out, ["source_id", "source_url"], ORDER)
    return kept.drop("n_duplicates"), quality.pipeline_stats(out, kept)


class Engine:
    """Queries over a corpus of records. cache() keeps the indexed corpus; load again to see new harvests."""

    def __init__(self, spark: SparkSession, taxonomy: Taxonomy, aliases: DataFrame, records: DataFrame):
        self.spark, self.taxonomy, self.aliases = spark, taxonomy, aliases
        self.index = alias_index(aliases)
        self.records = search.indexed(records)

    @classmethod
    def load(cls, spark: SparkSession, taxonomy_path: str, aliases_path: str, golden_paths: list[str], harvested: str | None = None, include_harvested: bool = True) -> Engine:
        taxonomy = read_taxonomy(spark, taxonomy_path)
        aliases, _ = read_aliases(spark, aliases_path)
        index = alias_index(aliases)
        golden = corpus.golden_records(spark, golden_paths, taxonomy, index)
        more = corpus.harvested_records(spark, harvested, taxonomy, index) if harvested and include_harvested else None
        return cls(spark, taxonomy, aliases, corpus.corpus(golden, more, include_harvested))

    def cache(self) -> Engine:
        self.records = self.records.cache()
        return self

    def health(self) -> dict:
        return {"status": "ok", "records": self.records.count()}

    def search(self, q: str = "", mineral: str | None = None, stage: str | None = None, kind: str | None = None, limit: int = 10) -> tuple[int, DataFrame]:
        """How many records match, and the best of them."""
        return search.hits(self.records, q, mineral, stage, kind).count(), search.search(self.records, q, mineral, stage, kind, limit)

    def record(self, doc_id: str) -> dict:
        """A record by its id, the last of several; KeyError without one."""
        found = search.lookup(self.records, doc_id).orderBy(*[F.col(c).desc() for c in ORDER]).select(*DETAIL).limit(1).collect()
        if not found:
            raise KeyError(f"unknown record: {doc_id}")
        return found[0].asDict()

    def summary(self) -> dict[str, DataFrame]:
        r = self.records
        return {"totals": analytics.totals(r), "by_mineral": analytics.count_by(r, "mineral_ids", "mineral"), "by_stage": analytics.count_by(r, "stage_ids", "stage"), "top_orgs": analytics.top_orgs(r)}

    def heatmap(self) -> DataFrame:
        return analytics.heatmap(self.records)

    def org(self, name: str) -> DataFrame:
        """The profile of the organisation that a name resolves to."""
        one = self.spark.createDataFrame([(name,)], "name string")
        return analytics.org_profile(self.records, resolved(one, self.index).first()["org"], ORDER)

    def org_digests(self, names: list[str], path: str) -> DataFrame:
        """The profiles of the organisations that names resolve to, with a digest of their record ids, however many those are. Their records are written under a path."""
        asked = resolved(self.spark.createDataFrame([(n,) for n in names], "name string"), self.index).select("name", "org")
        return analytics.org_digests(self.records, asked, path)

    def matrix(self) -> DataFrame:
        return analytics.matrix(self.records)

    def whitespace(self, top: int = 10) -> DataFrame:
        return analytics.whitespace(self.matrix()).orderBy("rank").limit(top)

    def collaborations(self) -> DataFrame:
        return analytics.collaboration_pairs(self.records)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        keyed = graph.with_record_key(self.records)
        return graph.nodes(keyed, ORDER), graph.edges(keyed)

    def subscribe(self, alerts: AlertTable, mineral: str = "", stage: str = "", kind: str = "", q: str = "", replay: bool = False) -> str:
        """A new subscription, which has seen the corpus as it is unless its history is to be replayed."""
        return alerts.subscribe(mineral, stage, kind, q, None if replay else self.records)

    def check_alerts(self, alerts: AlertTable, batch: int) -> DataFrame:
        """What the corpus has that subscriptions have not seen."""
        return alerts.check(self.records, batch, ORDER)

    def same_org(self, a: str, b: str) -> bool:
        """Whether two names resolve to one organisation."""
        rows = resolved(self.spark.createDataFrame([(a,), (b,)], "name string"), self.index).select("org").distinct()
        return rows.count() == 1


