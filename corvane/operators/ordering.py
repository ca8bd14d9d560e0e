"""A total order without a task that has all rows: ranges sorted apart, and their places added up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_table(df: DataFrame, order: list[str | Column], path: str, name: str = "rank") -> DataFrame:
    """df written under a path in an order, and read with each row's place in it, from 1.

    Rows are dealt out by ranges of the order and sorted there, a file for each
    range. A row's place is its place in its file, which Parquet knows, after the
    rows of the files before. Only the files' counts meet in one task, and there
    are as many as partitions. Rows that the order does not tell apart have
    different places, in any order.
    """
    # Ranges take a look at all rows before they deal them out, so the rows are made once and written as they come.
    df.write.mode("overwrite").parquet(f"{path}/rows")
    made = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
    made.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/sorted")
    at = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("index"))
    rows = df.sparkSession.read.schema(df.schema).parquet(f"{path}/sorted").select("*", at.alias("__at"))
    # Files are numbered by their task, whose order is that of the ranges.
    counts = rows.groupBy(F.col("__at.file").alias("__file")).agg(F.count("*").alias("n"))
    before = counts.select("__file", (F.sum("n").over(Window.orderBy("__file")) - F.col("n")).alias("__before"))
    placed = rows.join(F.broadcast(before), F.col("__at.file") == F.col("__file"))
    return placed.withColumn(name, F.col("__before") + F.col("__at.index") + 1).select(*df.columns, name)
