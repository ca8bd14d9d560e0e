"""Completeness, hold-out scores, drift against baselines, and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from corvane.functions.text import filled
from corvane.schemas import ABSTRACT_SHARE, COMPLETE_ENOUGH, GATE_ACCURACY, GATE_MACRO_F1, GATE_ROWS, KINDS, QUALITY_PP, REQUIRED, SPEED_PCT, TITLE_SHARE, VOLUME_TARGET
from corvane.sources.reference import N_STAGES, PILOT_MINERALS, Taxonomy


def present_count(df: DataFrame, fields: list[str] | tuple[str, ...]) -> Column:
    kinds = dict(df.dtypes)
    return reduce(lambda a, b: a + b, [filled(F.col(c), kinds[c]).cast("int") for c in fields])


def completeness(df: DataFrame, fields: list[str] | tuple[str, ...], by: list[str] | None = None) -> DataFrame:
    """Share of required values that are present; 0 where there are no records."""
    share = F.coalesce(F.sum(present_count(df, fields)) / (F.count("*") * len(fields)), F.lit(0.0))
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), share.alias("completeness"))


def pipeline_stats(records: DataFrame, deduped: DataFrame) -> DataFrame:
    """(source_id, parsed, completeness, deduped, duplicates): a row for each source and one for all, whose source_id is 'total'."""
    need = F.lit(0)
    have = F.lit(0)
    for kind, fields in REQUIRED.items():
        need = F.when(F.col("kind") == kind, len(fields)).otherwise(need)
        have = F.when(F.col("kind") == kind, present_count(records, fields)).otherwise(have)
    share = F.round(F.coalesce(F.sum(have) / F.sum(need), F.lit(0.0)), 4)
    by_source = records.rollup("source_id").agg(F.count("*").alias("parsed"), share.alias("completeness"), F.grouping("source_id").alias("whole"))
    kept = deduped.rollup("source_id").agg(F.count("*").alias("deduped"), F.grouping("source_id").alias("whole"))
    out = by_source.join(kept, (by_source["whole"] == kept["whole"]) & by_source["source_id"].eqNullSafe(kept["source_id"]), "left")
    name = F.when(by_source["whole"] == 1, "total").otherwise(by_source["source_id"])
    n = F.coalesce(kept["deduped"], F.lit(0))
    return out.select(name.alias("source_id"), "parsed", "completeness", n.alias("deduped"), (F.col("parsed") - n).alias("duplicates"))


def observed_stats(records: DataFrame, sources: list[str], dedupe) -> tuple[DataFrame, object]:
    """(deduped, stats): dedupe(records), and a function that gives the rows of pipeline_stats() of known sources as a frame, once an action has run on deduped. The action's own job counts them."""
    before, after = Observation(), Observation()
    need, have = F.lit(0), F.lit(0)
    for kind, fields in REQUIRED.items():
        need = F.when(F.col("kind") == kind, len(fields)).otherwise(need)
        have = F.when(F.col("kind") == kind, present_count(records, fields)).otherwise(have)
    own = [F.col("source_id").eqNullSafe(F.lit(s)) for s in sources]
    of = lambda c: [F.sum(F.when(test, c)) for test in own]
    measures = [x.alias(f"{name}{k}") for name, c in (("n", F.lit(1)), ("need", need), ("have", have)) for k, x in enumerate([*of(c), F.sum(c)])]
    kept = dedupe(records.observe(before, *measures))
    kept = kept.observe(after, *[x.alias(f"n{k}") for k, x in enumerate([*of(F.lit(1)), F.count(F.lit(1))])])

    def stats() -> DataFrame:
        b, a = before.get, after.get
        rows = []
        for k, source in enumerate([*sources, "total"]):
            if b[f"n{k}"]:
                share = round((b[f"have{k}"] or 0) / b[f"need{k}"], 4) if b[f"need{k}"] else 0.0
                rows.append((source, b[f"n{k}"], share, a[f"n{k}"] or 0, b[f"n{k}"] - (a[f"n{k}"] or 0)))
        return records.sparkSession.createDataFrame(rows, "source_id string, parsed long, completeness double, deduped long, duplicates long")

    return kept, stats


def incomplete_sources(stats: DataFrame, least: float = COMPLETE_ENOUGH) -> DataFrame:
    """Sources that fail the completeness gate."""
    return stats.where((F.col("source_id") != "total") & (F.col("completeness") < least))


def label_scores(scored: DataFrame, gold: str, pred: str, labels: DataFrame | None = None) -> DataFrame:
    """(label, tp, fp, fn, f1) of rows with a gold and a predicted list; f1 is null for a label that neither has.

    Counts come from each row's own labels, so no row meets the label universe.
    """
    g, p = F.array_distinct(gold), F.array_distinct(pred)
    each = F.concat(
        F.transform(F.array_intersect(g, p), lambda x: F.struct(x.alias("label"), F.lit("tp").alias("what"))),
        F.transform(F.array_except(p, g), lambda x: F.struct(x.alias("label"), F.lit("fp").alias("what"))),
        F.transform(F.array_except(g, p), lambda x: F.struct(x.alias("label"), F.lit("fn").alias("what"))),
    )
    hits = scored.select(F.explode(each).alias("x")).select("x.*")
    out = hits.groupBy("label").agg(*[F.count_if(F.col("what") == w).alias(w) for w in ("tp", "fp", "fn")])
    if labels is not None:
        out = labels.select("label").distinct().join(out, "label", "left").na.fill(0, ["tp", "fp", "fn"])
    # 2PR / (P + R) is 2tp / (2tp + fp + fn), and 0 without a true positive.
    return out.withColumn("f1", F.when(F.col("tp") + F.col("fp") + F.col("fn") > 0, 2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))))


def task_scores(scored: DataFrame, gold: str, pred: str, labels: DataFrame | None = None) -> DataFrame:
    """One row: n, subset accuracy, macro F1 over the labels that are exercised, and how many are and are not. Null accuracy for no rows."""
    same = F.array_sort(F.array_distinct(gold)) == F.array_sort(F.array_distinct(pred))
    rows = scored.agg(F.count("*").alias("n"), F.round(F.avg(same.cast("int")), 4).alias("subset_accuracy"))
    per = label_scores(scored, gold, pred, labels)
    macro = per.agg(F.round(F.coalesce(F.avg("f1"), F.lit(0.0)), 4).alias("macro_f1"), F.count("f1").alias("labels_scored"), F.count_if(F.col("f1").isNull()).alias("labels_unexercised"))
    return rows.crossJoin(macro)


def label_universe(frames: list[DataFrame], column: str) -> DataFrame:
    """(label): the labels that any of some frames has in a list column."""
    each = [f.select(F.explode(column).alias("label")) for f in frames]
    return reduce(DataFrame.unionAll, each).distinct()


def evaluate_holdout(predicted: DataFrame, holdout: DataFrame, records: DataFrame, id_col: str = "fixture_id") -> DataFrame:
    """A row for each task, mineral and stage, with the gate: PROVISIONAL below GATE_ROWS rows, else PASS or FAIL.

    ValueError if a test id has no record.
    """
    gold = holdout.select("id", F.col("mineral_ids").alias("gold_mineral_ids"), F.col("stage_ids").alias("gold_stage_ids"))
    missing = gold.join(predicted, gold["id"] == predicted[id_col], "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"no record for test id {missing[0]['id']}")
    scored = gold.join(predicted.select(F.col(id_col).alias("id"), "pred_mineral_ids", "pred_stage_ids"), "id")
    out = None
    for task in ("mineral", "stage"):
        labels = label_universe([records, holdout], f"{task}_ids")
        row = task_scores(scored, f"gold_{task}_ids", f"pred_{task}_ids", labels).select(F.lit(task).alias("task"), "*")
        out = row if out is None else out.unionByName(row)
    good = out.agg(F.min(passes(F.col("subset_accuracy"), F.col("macro_f1"))).alias("good"), F.max("n").alias("rows"))
    gate = F.when(F.col("rows") < GATE_ROWS, "PROVISIONAL").when(F.col("good"), "PASS").otherwise("FAIL")
    return out.crossJoin(good).withColumns({"gate": gate, "provisional": F.col("rows") < GATE_ROWS}).drop("good", "rows")


def passes(accuracy: Column, macro_f1: Column) -> Column:
    return (accuracy >= GATE_ACCURACY) & (macro_f1 >= GATE_MACRO_F1)


def drift(current: DataFrame, baseline: DataFrame, quality_pp: float = QUALITY_PP, speed_pct: float = SPEED_PCT) -> DataFrame:
    """(metric, kind, was, now, change, status) of metrics measured and recorded.

    A quality metric fails when it drops by more than quality_pp points, a speed
    metric when it rises by more than speed_pct percent (one recorded at 0 or
    less is passed over, 'skipped'), any other kind always. Metrics of one side
    alone are 'new' or 'missing'. Double arithmetic, strict comparisons.
    """
    c, b = current.select("metric", F.col("value").alias("now")), baseline.select("metric", F.col("value").alias("was"), "kind")
    both = c.join(b, "metric", "full_outer")
    drop = (F.col("was") - F.col("now")) * 100.0
    rise = F.when(F.col("was") > 0, (F.col("now") - F.col("was")) / F.col("was") * 100.0)
    kind = F.coalesce("kind", F.lit("quality"))
    status = (
        F.when(F.col("was").isNull(), "new")
        .when(F.col("now").isNull(), "missing")
        .when(kind == "quality", F.when(drop > quality_pp, "failure").when(F.col("now") > F.col("was"), "improvement").otherwise("ok"))
        .when(kind == "speed", F.when(F.col("was") <= 0, "skipped").when(rise > speed_pct, "failure").when(F.col("now") < F.col("was"), "improvement").otherwise("ok"))
        .otherwise("failure")
    )
    change = F.when(kind == "quality", drop).when(kind == "speed", rise)
    return both.select("metric", F.when(F.col("was").isNotNull(), kind).alias("kind"), "was", "now", change.alias("change"), status.alias("status"))


def drift_ok(report: DataFrame) -> bool:
    return report.where(F.col("status").isin("failure", "missing")).isEmpty()


def recorded_baseline(current: DataFrame) -> DataFrame:
    """Metrics as a new baseline; those that end in _ms_avg are speeds."""
    return current.select("metric", "value", F.when(F.endswith("metric", F.lit("_ms_avg")), "speed").otherwise("quality").alias("kind"))


def sample_quality(df: DataFrame) -> DataFrame:
    """One row: shares of rows whose title and abstract are not blank; 0 for no rows."""
    has = lambda c: F.coalesce(F.avg((F.trim(F.coalesce(c, F.lit(""))) != "").cast("int")), F.lit(0.0))
    return df.agg(has("title").alias("title_share"), has("abstract").alias("abstract_share"))


def verdict(pilot: Column, title_share: Column, abstract_share: Column) -> Column:
    good = (pilot >= VOLUME_TARGET) & (title_share >= TITLE_SHARE) & (abstract_share >= ABSTRACT_SHARE)
    return F.when(good, "PASS").otherwise("FAIL")


def taxonomy_faults(taxonomy: Taxonomy) -> list[str]:
    """What is wrong with a taxonomy; nothing for a good one."""
    stages = {s.id for s in taxonomy.stages}
    out = [f"family {f.id} has an unknown stage {f.parent}" for f in taxonomy.families if f.parent not in stages]
    out += [f"family {f.id} has no subdomains" for f in taxonomy.families if not taxonomy.subdomains.get(f.id)]
    lost = set(PILOT_MINERALS) - {m.id for m in taxonomy.minerals}
    out += [f"pilot minerals are missing: {sorted(lost)}"] if lost else []
    return out + ([f"{len(stages)} stages, not {N_STAGES}"] if len(stages) != N_STAGES else [])


def fixture_report(golden: DataFrame) -> DataFrame:
    """One row: how many patents and others, distinct ids, rows without provenance, and whether that will do."""
    patent = F.col("kind") == "patent"
    bad = ~F.startswith(F.coalesce("source_url", F.lit("")), F.lit("http")) | (F.coalesce("fetched_at", F.lit("")) == "") | (F.coalesce("title", F.lit("")) == "")
    out = golden.agg(F.count_if(patent).alias("patents"), F.count_if(~patent).alias("others"), F.count("*").alias("n"), F.countDistinct("fixture_id").alias("ids"), F.count_if(bad).alias("unsourced"))
    return out.withColumn("ok", (F.col("patents") >= 8) & (F.col("others") >= 4) & (F.col("ids") == F.col("n")) & (F.col("unsourced") == 0))


def manifest(files: DataFrame) -> DataFrame:
    """(path, sha256) of a binaryFile scan."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def manifest_difference(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """(path, status): files that are missing, changed or new against a recorded manifest."""
    r, f = recorded.select("path", F.col("sha256").alias("was")), found.select("path", F.col("sha256").alias("now"))
    status = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("was") != F.col("now"), "changed")
    return r.join(f, "path", "full_outer").select("path", status.alias("status")).where("status is not null")


def backed_up(path: Column) -> Column:
    """Whether a relative path belongs in a backup: no cache, no archive or its manifest, nothing under a scratch folder."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return ~(p.rlike(r"^data/ipo_cache(/|\z)") | p.rlike(r"(^|/)[^/]*\.verify(/|\z)") | p.rlike(r"\.tgz(\.manifest\.json)?\z"))


def constraint_report(records: DataFrame) -> DataFrame:
    """(rule, n): rows that break what the record table declares: source and address present and unique together, a known kind, a title."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    counts = records.agg(
        F.count_if(blank("source_id")).alias("source_id_missing"), F.count_if(blank("source_url")).alias("source_url_missing"), F.count_if(blank("title")).alias("title_missing"),
        F.count_if(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))).alias("kind_unknown"),
    )
    pairs = records.groupBy("source_id", "source_url").agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("source_pair_repeated"))
    wide = counts.crossJoin(pairs)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).cast("long").alias("n")) for c in wide.columns])).alias("x")).select("x.*")
