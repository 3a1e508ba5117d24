"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows are held in cells. How many rows each cell sends to each shard is drawn first, exactly: the matrix has the cells'
counts as row sums and the shards' sizes as column sums, with the law that a uniform permutation of all rows would
give it. Each cell then permutes its rows and deals them by the matrix, and each shard permutes what it got. Shard sizes
differ by one row at most, whatever the seed. Everything that touches rows is DataFrame functions; the driver sees one
count per cell.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tracefold.llm.common import staged

CELL_ROWS = 100_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good items among ``draws`` from good + bad, by inversion outward from the mode; sizes are not limited."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    log_choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    peak = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    left = rng.random() - peak
    up = down = mode
    p_up = p_down = peak
    while left > 0:
        moved = False
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            moved = p_up > 0
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            moved = moved or p_down > 0
            if left <= 0:
                return down
        if not moved:
            break  # what rounding has left over
    return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows to send from each cell to each shard: a multivariate hypergeometric draw for each cell in turn."""
    rng, open_places, matrix = random.Random(seed), list(sizes), []
    for count in counts:
        row, rest, draws = [], sum(open_places), count
        for places in open_places:
            rest -= places
            taken = hypergeometric(rng, places, rest, draws) if draws else 0
            row.append(taken)
            draws -= taken
        matrix.append(row)
        open_places = [a - b for a, b in zip(open_places, row, strict=True)]
    return matrix


def _draw(seed: int, salt: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(salt), F.col("_row"))


def _deal(rows: DataFrame, seed: int, shards: int, cells: int) -> DataFrame:
    """(columns, _row) to (columns, shard, slot)."""
    spark = rows.sparkSession
    celled = rows.withColumn("_cell", F.pmod(_draw(seed, 1), F.lit(cells)).cast("int"))
    found = {r["_cell"]: r["n"] for r in celled.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = [found.get(c, 0) for c in range(cells)]
    total = sum(counts)
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    bounds = []
    for row in communication_matrix(counts, sizes, seed):
        edge, edges = 0, []
        for n in row:
            edge += n
            edges.append(edge)
        bounds.append(edges)
    dealt_to = F.explode(F.from_json(F.lit(json.dumps([{"c": c, "e": e} for c, e in enumerate(bounds)])), "array<struct<c:int,e:array<bigint>>>"))
    matrix = spark.range(1).select(dealt_to.alias("m")).select(F.col("m.c").alias("_cell"), F.col("m.e").alias("_edges"))

    inside = Window.partitionBy("_cell").orderBy(_draw(seed, 2), "_row")
    placed = celled.withColumn("_rank", F.row_number().over(inside) - 1).join(matrix, "_cell")
    shard = F.size(F.filter("_edges", lambda e: e <= F.col("_rank")))
    # The second permutation: a row's random block inside the shard, and its random place inside the block.
    blocks = max(1, -(-total // (shards * CELL_ROWS)))
    moved = placed.select(
        *rows.columns, shard.cast("int").alias("shard"), F.pmod(_draw(seed, 3), F.lit(blocks)).cast("int").alias("_block")
    )
    moved = staged(moved, "shards")
    ahead = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    begins = moved.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n")).withColumn("_begin", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    order = Window.partitionBy("shard", "_block").orderBy(_draw(seed, 4), "_row")
    slotted = moved.withColumn("_at", F.row_number().over(order) - 1).join(begins.drop("_n"), ["shard", "_block"])
    return slotted.withColumn("slot", (F.col("_begin") + F.col("_at")).cast("long"))


def shard_rows(df: DataFrame, shards: int = 40, seed: int = 7, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard), uniformly at random.

    Shard counts are at most one apart. Rows are told apart by their place in the first stage, so null, equal and
    repeated ids or texts are spread like any other rows; an empty table gives an empty result. Columns named
    shard or slot are replaced. The same stage and seed give the same result.
    """
    clean = df.drop("shard", "slot")
    rows = staged(clean.withColumn("_row", F.monotonically_increasing_id()), "shard-rows")
    total = rows.count()
    cells = max(8, -(-total // cell_rows))
    result = _deal(rows, seed, shards, cells).select(*clean.columns, "shard", "slot")
    return result


def shard_digest(docs: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """What ``shard_rows`` does with documents: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes plus 16; a null text has none, and its crc is that of no bytes.
    """
    body = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    slim = docs.select("doc_id", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    return shard_rows(slim, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard")
    )
