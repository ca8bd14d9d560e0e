"""Keep-first rules, whose order is a column: dropDuplicates leaves open which row survives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import patent_key


def keep_first(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """Of rows with equal keys (null equals null) the first in an order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def with_duplicate_counts(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """keep_first, with n_duplicates: how many other rows each stands for."""
    by = Window.partitionBy(*keys)
    return df.withColumns({"__place": F.row_number().over(by.orderBy(*order)), "n_duplicates": F.count("*").over(by) - 1}).where("__place = 1").drop("__place")


def identity(kind: str = "kind", appl_no: str = "appl_no", source_id: str = "source_id", source_url: str = "source_url") -> Column:
    """What makes two records the same thing: a patent's number across sources, else source and address."""
    key = patent_key(F.col(appl_no))
    return F.when((F.col(kind) == "patent") & key.isNotNull(), F.concat(F.lit("patent|"), key)).otherwise(F.concat_ws("|", F.lit("url"), F.coalesce(source_id, F.lit("")), F.coalesce(source_url, F.lit(""))))


def merged(golden: DataFrame, harvested: DataFrame, order: list[str]) -> DataFrame:
    """All golden records, and of the harvested ones whose identity no golden record has the first of each in an order."""
    extra = harvested.withColumn("__identity", identity())
    known = golden.select(identity().alias("__identity")).distinct()
    fresh = keep_first(extra.join(known, "__identity", "left_anti"), ["__identity"], order).drop("__identity")
    return golden.unionByName(fresh, allowMissingColumns=True)


def not_stored(found: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not stored."""
    return found.join(stored.select(*keys).distinct(), keys, "left_anti")
