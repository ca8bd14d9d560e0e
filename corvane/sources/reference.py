"""Reference data: taxonomy, keyword tables, aliases, hold-out labels and metric baselines.

They are dimensions of bounded size, read on the driver and compiled into plans.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# The two keyword tables must equal those that records were labelled by, as labels depend on every term.
# Keywords of each value-chain stage, as (whole words, substrings).
STAGE_KEYWORDS: dict[str, tuple[list[str], list[str]]] = {
    "exploration": (["mapping", "targeting", "drilling", "assay", "survey"], ["prospect", "remote sensing", "sentinel", "aeromag", "radiomet", "hyperspectral", "geophys", "geochem"]),
    "mining": (["mining", "mine", "mines", "pit", "pits"], ["underground", "stoping", "backfill", "evaporation"]),
    "beneficiation": ([], ["beneficiation", "flotation", "crushing", "grinding", "comminution", "magnetic separation", "gravity separation", "dense media"]),
    "extraction_refining": (
        ["hpal", "sx", "dle", "resin"],
        ["extraction", "leach", "hydrometallurg", "pyrometallurg", "roast", "smelt", "calcin", "solvent extraction", "ion exchange", "ion-exchange", "adsorb", "electrowinning", "precipitat", "crystalli", "bioleach"],
    ),
    "materials": (["lfp", "nmc", "nca"], ["cathode", "anode", "magnet", "ndfeb", "alloy", "electrolyte", "spheronis", "spheroniz"]),
    "recycling": (["scrap"], ["recycl", "black mass", "spent"]),
}
# Keywords of each process family, as (whole words, substrings).
FAMILY_KEYWORDS: dict[str, tuple[list[str], list[str]]] = {
    "remote_sensing": ([], ["remote sensing", "sentinel", "spectral"]),
    "geophysics": ([], ["aeromag", "radiomet", "electromagnetic"]),
    "geochemistry": ([], ["geochem", "assay"]),
    "solution_mining": (["sweep"], ["brine pumping", "evaporation pond", "dle"]),
    "flotation": ([], ["flotation"]),
    "crushing_grinding": ([], ["crushing", "grinding", "comminution"]),
    "hydrometallurgy": (["hpal"], ["hydrometallurg", "leach", "bioleach"]),
    "pyrometallurgy": ([], ["pyrometallurg", "roast", "smelt", "calcin"]),
    "solvent_extraction": (["sx"], ["solvent extraction", "extractant"]),
    "ion_exchange": (["dle", "resin"], ["ion exchange", "ion-exchange", "adsorb"]),
    "electrowinning": ([], ["electrowinning", "precipitat", "crystalli"]),
    "cathode": (["lfp", "nmc", "nca"], ["cathode"]),
    "anode": ([], ["anode", "spheronis", "spheroniz"]),
    "magnet": ([], ["magnet", "ndfeb"]),
    "mech_recycling": ([], ["dismantling", "shredding", "black mass"]),
    "hydro_recycling": ([], ["black mass", "battery_sx"]),
    "direct_recycling": ([], ["direct recycling", "cathode_healing", "cathode healing"]),
}
PILOT_MINERALS = ("LI", "REE", "GRA", "CO", "NI")
N_STAGES = 6
#: A lexicon term of so few characters counts as a whole word only.
SHORT_TERM = 3


@dataclass
class Label:
    """A label, its display name, the terms that give it, and the label that must be given first."""

    id: str
    name: str = ""
    words: list[str] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    parent: str | None = None


@dataclass
class Taxonomy:
    minerals: list[Label]
    stages: list[Label]
    families: list[Label]
    version: str = ""
    subdomains: dict[str, list[str]] = field(default_factory=dict)

    @property
    def names(self) -> dict[str, str]:
        """Display names of minerals and stages."""
        return {x.id: x.name for x in [*self.minerals, *self.stages]}


def driver_json(spark: SparkSession, path: str):
    """A JSON file of bounded size, read through Spark's file systems onto the driver."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def taxonomy_of(d: dict, stage_keywords=STAGE_KEYWORDS, family_keywords=FAMILY_KEYWORDS) -> Taxonomy:
    """A taxonomy document with its keyword tables.

    A mineral's symbols and members are whole words, and so are lexicon terms of
    SHORT_TERM characters or fewer; other lexicon terms match anywhere. Labels
    without keywords are kept and never given.
    """
    minerals = []
    for m in d["minerals"]:
        lexicon = [x.lower() for x in m.get("lexicon", [])]
        words = [x for x in lexicon if len(x) <= SHORT_TERM] + [x.lower() for x in m.get("symbols", []) + m.get("members", [])]
        minerals.append(Label(m["id"], m["name"], sorted(set(words)), sorted({x for x in lexicon if len(x) > SHORT_TERM})))
    stages = [Label(s["id"], s["name"], *map(list, stage_keywords.get(s["id"], ([], [])))) for s in d["value_chain_stages"]]
    families = [Label(f["id"], f.get("name", ""), *map(list, family_keywords.get(f["id"], ([], []))), parent=f["stage"]) for f in d["process_families"]]
    return Taxonomy(minerals, stages, families, d.get("version", ""), {f["id"]: f.get("subdomains") or [] for f in d["process_families"]})


def read_taxonomy(spark: SparkSession, path: str) -> Taxonomy:
    return taxonomy_of(driver_json(spark, path))


def alias_rows(spark: SparkSession, aliases: dict[str, list[str]]) -> DataFrame:
    """(canonical, variant): each canonical name is a variant of itself."""
    rows = [(c, v) for c, vs in aliases.items() for v in [c, *vs]]
    return spark.createDataFrame(rows, "canonical string, variant string")


def read_aliases(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The alias table, and the names that must stay apart."""
    d = driver_json(spark, path)
    return alias_rows(spark, d["aliases"]), list(d.get("top20", []))


def holdout_rows(spark: SparkSession, d: dict) -> DataFrame:
    """(id, mineral_ids, stage_ids) of the hold-out's test ids."""
    rows = [(i, d["labels"][i]["mineral_ids"], d["labels"][i]["stage_ids"]) for i in d["test_ids"]]
    return spark.createDataFrame(rows, "id string, mineral_ids array<string>, stage_ids array<string>")


def baseline_rows(spark: SparkSession, d: dict) -> DataFrame:
    """(metric, value, kind) of a baseline document."""
    rows = [(n, float(m["value"]), m.get("kind", "quality")) for n, m in d.get("metrics", {}).items()]
    return spark.createDataFrame(rows, "metric string, value double, kind string")


def golden_queries(d: dict) -> list[tuple[dict, str]]:
    """(arguments of a search, id of its best hit) of each golden query."""
    return [({"q": x["q"], **{f: x[f] for f in ("mineral", "stage", "kind") if x.get(f)}}, x["expected_top"]) for x in d["queries"]]


def recorded(d: dict, metrics: DataFrame, today: str) -> dict:
    """A baseline document with metrics(metric, value, kind) in place of its own, by name; a metric that it has keeps its kind."""
    kinds = {n: m.get("kind", "quality") for n, m in d.get("metrics", {}).items()}
    rows = sorted(metrics.select("metric", "value", "kind").collect())
    return d | {"metrics": {r["metric"]: {"value": r["value"], "kind": kinds.get(r["metric"], r["kind"]), "recorded": today} for r in rows}}


def tolerances(d: dict) -> tuple[float, float]:
    tol = d.get("tolerance", {})
    return float(tol.get("quality_pp", 2.0)), float(tol.get("speed_pct", 20.0))
