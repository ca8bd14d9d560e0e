"""Multi-label classification: by compiled term patterns where terms are few, by one automaton of all terms where they are many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import terms_pattern
from corvane.operators import automaton
from corvane.sources.reference import Label, Taxonomy

EMPTY = "cast(array() as array<string>)"
#: Terms up to which each label is one pattern, evaluated in the plan; the time of patterns grows with them, an automaton's does not.
PATTERN_TERMS = 1000


def given(text: Column, labels: list[Label], parents: Column | None = None) -> Column:
    """The sorted ids of labels whose terms a lower-cased text has, each label one pattern; with parents, only under a parent that was given."""
    hits = []
    for label in labels:
        pattern = terms_pattern(label.words, label.parts)
        if pattern:
            hit = text.rlike(pattern)
            hits.append(F.when(hit & F.array_contains(parents, label.parent) if parents is not None else hit, F.lit(label.id)))
    return F.array_sort(F.filter(F.array(*hits), lambda x: x.isNotNull())) if hits else F.expr(EMPTY)


def n_terms(taxonomy: Taxonomy) -> int:
    return sum(len(x.words) + len(x.parts) for level in (taxonomy.minerals, taxonomy.stages, taxonomy.families) for x in level)


def classified(df: DataFrame, taxonomy: Taxonomy, title: str = "title", abstract: str | None = "abstract", prefix: str = "pred_", many: bool | None = None) -> DataFrame:
    """df with the predicted mineral, stage and family ids, one projection without join or shuffle.

    many chooses the automaton, which gives the same labels; unless it is said,
    taxonomies of more than PATTERN_TERMS terms take it.
    """
    parts = [F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit("")) if abstract else F.lit("")]
    df = df.withColumn("__text", F.lower(F.concat_ws(" ", *parts)))
    levels = {f"{prefix}mineral_ids": taxonomy.minerals, f"{prefix}stage_ids": taxonomy.stages, f"{prefix}process_family_ids": taxonomy.families}
    if many if many is not None else n_terms(taxonomy) > PATTERN_TERMS:
        every = [(f"{k}:{x.id}", x.words, x.parts) for k, level in enumerate(levels.values()) for x in level]
        df = df.withColumn("__hits", automaton.hits(F.col("__text"), every))
        own = lambda k: F.array_sort(F.transform(F.filter("__hits", lambda x: F.startswith(x, F.lit(f"{k}:"))), lambda x: F.substring(x, 3, 1 << 20)))
        df = df.withColumns({name: own(k) for k, name in enumerate(levels)})
        # A family stays only under a stage that was given.
        under = F.array(*[F.struct(F.lit(x.id).alias("id"), F.lit(x.parent).alias("parent")) for x in taxonomy.families])
        if taxonomy.families:
            allowed = F.transform(F.filter(under, lambda x: F.array_contains(F.col(f"{prefix}stage_ids"), x["parent"])), lambda x: x["id"])
            df = df.withColumn(f"{prefix}process_family_ids", F.array_intersect(f"{prefix}process_family_ids", allowed))
        return df.drop("__text", "__hits")
    names = list(levels)
    df = df.withColumns({names[0]: given(F.col("__text"), taxonomy.minerals), names[1]: given(F.col("__text"), taxonomy.stages)})
    return df.withColumn(names[2], given(F.col("__text"), taxonomy.families, F.col(names[1]))).drop("__text")


def term_hits(docs: DataFrame, taxonomy: Taxonomy, id_col: str, text: str, many: bool | None = None) -> DataFrame:
    """(id, level, label): the same labels in rows, for joins and counts."""
    found = classified(docs, taxonomy, text, None, many=many)
    levels = [("mineral", "pred_mineral_ids"), ("stage", "pred_stage_ids"), ("family", "pred_process_family_ids")]
    each = F.flatten(F.array(*[F.transform(F.col(c), _tag(level)) for level, c in levels]))
    return found.select(id_col, F.explode(each).alias("x")).select(id_col, "x.level", "x.label")


def _tag(level: str):
    return lambda x: F.struct(F.lit(level).alias("level"), x.alias("label"))
