"""Small helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate_once(df: DataFrame, keep: list[str], *exprs: Column) -> DataFrame:
    """``select(keep, exprs)`` whose results later filters use as they are.

    A filter on a projected column is otherwise pushed below the projection with its expression copied
    into it; for wide text or JSON expressions that doubles the work and outgrows code generation.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*exprs))))


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over several tasks a core, ahead of work on texts that costs far more than moving them.

    A join that adaptive execution coalesces, or a file with one row group, otherwise leaves them in a few uneven tasks.
    """
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def count_rows(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """Rows by their keys to so many tasks; as the session deals them, if None."""
    return df if tasks is None else df.repartition(tasks, *keys)
