"""Exact top-k search by inner product over an impact-ordered index, score at a time.

The index is cut into blocks of rows. In a block each component's values are quantised into levels, and the rows of
a level are one posting segment. For a query, a component's impact on a row is its share of the score above the least
share that the component gives any row of the block; so impacts are never negative. Segments are processed in
descending order of their quantised impact, for all components together. A row's score is then at most what its
processed segments allow, plus for each of its unprocessed components the impact that is still to come. The k-th
best exact score so far is the bar: rows that cannot reach it are out, by proof. Processing stops when few rows are
left, and these are scored exactly.

Queries meet blocks by an equi-join on the block's number, in chunks of queries; the bar of a query is carried from
block to block within a task only, so tasks are independent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracefold.llm.common import staged

BLOCK_ROWS = 4096
CHUNK = 256  # queries that travel together
LEVELS = 12
ROUND = 32  # segments between two looks at the bar
FEW = 512  # rows that are cheaper to score than to rule out
HIT_SCHEMA = "query_id long, vec_id long, score long"
_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x); null vectors and ids, and vectors with a null or non-finite component, go.

    Rows that repeat an id count once, with the least of their vectors.
    """
    v = F.col(vector_col)
    sound = v.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = vectors.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    return whole.groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(rows: list[list[int]], width: int) -> np.ndarray:
    """Rows of one length; shorter ones are filled with zeros, which add nothing to a score."""
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row[:width]
    return out


def exact_scores(values: np.ndarray, query: np.ndarray) -> np.ndarray:
    """int64 inner products; exact, or an error where a score leaves that range."""
    if values.size and query.size and float(np.abs(values).max()) * float(np.abs(query).max()) * values.shape[1] >= 2.0**62:
        return np.array([sum(int(a) * int(b) for a, b in zip(row, query, strict=True)) for row in values.tolist()], np.int64)
    return values @ query


class ImpactIndex:
    """Posting segments of one block of rows."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, levels: int = LEVELS) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.values, self.width = ids[order], values[order], values.shape[1]
        self.low, self.high = (values.min(0), values.max(0)) if len(ids) else (np.zeros(self.width, np.int64),) * 2
        segments, component, top, bottom = [], [], [], []
        for d in range(self.width):
            span = int(self.high[d] - self.low[d]) + 1
            step = -(-span // levels)
            level = (self.values[:, d] - self.low[d]) // step
            by_level = np.argsort(level, kind="stable")
            found, begins = np.unique(level[by_level], return_index=True)
            for n, rows in zip(found, np.split(by_level, begins[1:]), strict=True):
                segments.append(rows)
                component.append(d)
                bottom.append(int(self.low[d] + n * step))
                top.append(min(int(self.low[d] + (n + 1) * step - 1), int(self.high[d])))
        self.segments = segments
        self.component, self.top, self.bottom = np.array(component, np.int64), np.array(top, np.float64), np.array(bottom, np.float64)

    def search(self, query: np.ndarray, own: int | None, k: int, bar: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores, segments processed) of every row that may be among the k best; ``bar`` is a proven k-th score."""
        n = len(self.ids)
        if not n:
            return self.ids, np.zeros(0, np.int64), 0
        weight = query.astype(np.float64)
        # Base: the least that each component gives; impacts count from there.
        base = float(np.where(weight > 0, weight * self.low, weight * self.high).sum())
        w = weight[self.component]
        impact = np.where(w > 0, w * (self.top - self.low[self.component]), w * (self.bottom - self.high[self.component]))
        order = np.argsort(-impact, kind="stable")
        slack = 1e-9 * float(np.abs(weight).sum() * max(1.0, np.abs(self.values).max()) + 1)
        met = np.zeros(n, np.complex128)  # of each row the impacts so far, and in the imaginary part how many they are
        steps = impact + 1j
        excluded = np.searchsorted(self.ids, own) if own is not None else n
        excluded = excluded if excluded < n and self.ids[excluded] == own else -1
        done, candidates = 0, None
        while True:
            for s in order[done : done + ROUND]:
                met[self.segments[s]] += steps[s]
            done = min(done + ROUND, len(order))
            rest = impact[order[done]] if done < len(order) else 0.0
            # What a row may still gain: at most the next impact, for each component not met.
            reach = met.real + (self.width - met.imag) * rest + (base + slack)
            if excluded >= 0:
                reach[excluded] = -np.inf
            if n > k:
                lead = np.argpartition(-reach, k - 1)[:k]
                scores = exact_scores(self.values[lead], query)
                bar = max(bar, float(scores.min()) if excluded < 0 or excluded not in lead else -np.inf)
            candidates = np.flatnonzero(reach >= bar)
            if len(candidates) <= max(FEW, 4 * k) or done == len(order):
                break
        if excluded >= 0:
            candidates = candidates[candidates != excluded]
        scores = exact_scores(self.values[candidates], query)
        return self.ids[candidates], scores, done


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A block's or chunk's rows as one row: ids and values as bytes."""
    rows = table.sort_by("vec_id")
    vectors = rows.column("v").to_pylist()
    width = max(map(len, vectors))
    data = matrix(vectors, width)
    return pa.table({
        "part": pa.array([key[0].as_py()], pa.int64()), "width": pa.array([width], pa.int64()),
        "ids": pa.array([rows.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()), "data": pa.array([data.astype("<i8").tobytes()], pa.binary()),
    })


def _unpack(ids: bytes, data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(data, "<i8").reshape(-1, width) if width else np.zeros((len(ids) // 8, 0), np.int64)


def _search(k: int, levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, index = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                part, width, ids, data, q_width, q_ids, q_data = (c[row].as_py() for c in batch.columns)
                if part != block:
                    block, index = part, ImpactIndex(*_unpack(ids, data, width), levels)
                out_q, out_v, out_s = [], [], []
                for query_id, query in zip(*_unpack(q_ids, q_data, q_width), strict=True):
                    fitted = np.zeros(width, np.int64)
                    fitted[: min(width, q_width)] = query[:width]
                    found, scores, _ = index.search(fitted, int(query_id), k)
                    top = best(found, scores, k)
                    out_q.append(np.full(len(top), query_id))
                    out_v.append(found[top])
                    out_s.append(scores[top])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (out_q, out_v, out_s)], schema=_HITS)

    return run


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024,
    block_rows: int = BLOCK_ROWS, levels: int = LEVELS,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows of ``vectors`` by integer inner product.

    Components are floor(scale * x). Ties go to the smaller id; a row with the query's own id is left out; fewer
    rows are all returned. Null ids or vectors and vectors with null or non-finite components take no part; missing
    components of a shorter vector count as zero; rows that repeat an id count once. Empty tables give no rows.
    """
    rows = staged(quantised(vectors, id_col, vector_col, scale), "vectors")
    asked = staged(quantised(queries, id_col, vector_col, scale), "queries")
    blocks, chunks = max(1, -(-rows.count() // block_rows)), max(1, -(-asked.count() // CHUNK))
    packed = "part long, width long, ids binary, data binary"
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    index = rows.withColumn("part", place(blocks)).groupBy("part").applyInArrow(_gather, packed)
    chunked = asked.withColumn("part", place(chunks)).groupBy("part").applyInArrow(_gather, packed)
    # Chunks of queries go to every block; a block is copied for each sixteen chunks, so no task has more than that.
    sets = max(1, -(-chunks // 16))
    left = index.withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    right = chunked.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("part"), F.pmod("part", F.lit(sets)).cast("int").alias("set"),
        F.col("width").alias("q_width"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"),
    )
    tasks = max(1, blocks * sets)
    met = left.repartition(tasks, "part", "set").join(right.repartition(tasks, "part", "set").hint("merge"), ["part", "set"])
    hits = met.select("part", "width", "ids", "data", "q_width", "q_ids", "q_data").mapInArrow(_search(k, levels), HIT_SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
