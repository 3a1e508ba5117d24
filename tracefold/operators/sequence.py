"""Ordered computations over groups of any size.

A window over a whole group puts that group into one task. Here a group is cut into blocks that follow
its order; windows run inside a block, and what a block passes on — its last value, its total — travels
through one summary row per block. A group holding a third of all rows is then as parallel as the rest,
and the results are those of the plain window.

Where rows have ordinals, a run of ordinals is a block. Otherwise ``range_blocks`` cuts all groups at
quantiles that Spark samples, so blocks hold about as many rows each, however the rows are spread over
groups and time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.session import cut_lineage

_BLOCK, _TAIL, _CARRY, _LOCAL = "_block", "_tail", "_carry", "_local"
#: Column that ``range_blocks`` adds.
RANGE = "_range"


def range_blocks(df: DataFrame, keys: list[str], order: list[str], blocks: int | None = None) -> DataFrame:
    """Rows with the number of their range of (keys, order) as ``RANGE``; ranges follow the order and are of like size.

    Rows are written once, since sampled bounds may differ from one reading to the next. Rows with equal keys and order
    share a block, so the order should tell rows apart.
    """
    by = [F.col(c) for c in (*keys, *order)]
    ranged = df.repartitionByRange(blocks, *by) if blocks else df.repartitionByRange(*by)
    return cut_lineage(ranged.withColumn(RANGE, F.spark_partition_id()), "range-blocks")


def ordinal_block(position: Column, size: int = 4096) -> Column:
    return F.floor(position / size)


def first_rows(df: DataFrame, keys: list, order: list, n: int = 1, rank: str | None = None) -> DataFrame:
    """First ``n`` rows of each group. The rank filter is applied before the shuffle as well as after it."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def _with_carry(df: DataFrame, keys: list[str], summary: DataFrame, carries: dict[str, Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(*keys, _BLOCK, *[carry.over(w).alias(name) for name, carry in carries.items()])
    return df.join(carried, [*keys, _BLOCK], "left")


def previous_values(df: DataFrame, keys: list[str], order: list[str], block: Column, values: dict[str, Column]) -> DataFrame:
    """Last non-null value of the group strictly before each row, for several values in one pass.

    The input is read twice, for the rows and for the block summaries. Callers that chain passes write the
    rows between them (``session.cut_lineage``), or the readings multiply.
    """
    rows = df.withColumn(_BLOCK, block).withColumns({f"_v_{n}": v for n, v in values.items()})
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tails = [F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.struct(*order))).alias(f"_t_{n}") for n in values]
    summary = rows.groupBy(*keys, _BLOCK).agg(*tails)
    local = rows.withColumns({f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(inside) for n in values})
    joined = _with_carry(local, keys, summary, {f"_c_{n}": F.last(f"_t_{n}", ignorenulls=True) for n in values})
    done = joined.withColumns({n: F.coalesce(f"_l_{n}", f"_c_{n}") for n in values})
    return done.drop(_BLOCK, *[f"_{kind}_{n}" for n in values for kind in "vlc"])


def previous_value(
    df: DataFrame, keys: list[str], order: list[str], block: Column, value: Column, out: str
) -> DataFrame:
    """``previous_values`` for one value."""
    return previous_values(df, keys, order, block, {out: value})


def running_total(
    df: DataFrame, keys: list[str], order: list[str], block: Column, value: Column, out: str, inclusive: bool = True
) -> DataFrame:
    """Sum of ``value`` over the group up to each row."""
    rows = df.withColumn(_BLOCK, block).withColumn("_value", F.coalesce(value.cast("long"), F.lit(0)))
    end = 0 if inclusive else -1
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    summary = rows.groupBy(*keys, _BLOCK).agg(F.sum("_value").alias(_TAIL))
    local = rows.withColumn(_LOCAL, F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    joined = _with_carry(local, keys, summary, {_CARRY: F.sum(_TAIL)})
    total = F.col(_LOCAL) + F.coalesce(F.col(_CARRY), F.lit(0))
    return joined.withColumn(out, total).drop(_BLOCK, _LOCAL, _CARRY, "_value")
