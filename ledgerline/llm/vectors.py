"""Vectors packed into block rows, and the pairing of query blocks with candidate blocks.

A stated query set meets all rows block by block. Every scan task packs its vectors into rows of up to
``size`` vectors (ids and a matrix as bytes). Blocks meet on a grid: a query block belongs to one of the
grid's rows and is sent to all its columns, a candidate block belongs to one column and is sent to all
rows, and an equi-join on the cell and the dimension makes each pair of blocks once. The grid has
about as many cells as there are shuffle partitions, its sides balance what is shuffled of either kind, and a
column holds at most ``HELD`` candidate blocks, so what a join task buffers is bounded. No group is collected, however
often an id repeats.

Pairs arrive query block by query block, so a searcher can carry its best results over a cell's candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = "ids binary, keys binary, data binary, n int, dim int, block long"
#: Candidate blocks that one cell of the grid may buffer.
HELD = 64


def usable(vector: str) -> Column:
    """Not null, not empty, and all components finite."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def pack(vectors: DataFrame, id_col: str, vector_col: str, *, size: int = 2048) -> DataFrame:
    """Block rows of the usable vectors with a non-null id: ``BLOCK``; data is row-major float64, keys hash the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, keys, data = (np.concatenate(x) for x in zip(*waiting.pop(dim), strict=True))
            made += 1
            return pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()], pa.binary()) for x in (ids, keys, data)), pa.array([len(ids)], pa.int32()), pa.array([dim], pa.int32()), pa.array([(task << 32) + made], pa.int64())], names=["ids", "keys", "data", "n", "dim", "block"])

        for batch in batches:
            ids, keys, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.float64)
            lengths = np.diff(offsets)
            for dim in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == dim)
                at = 0
                while at < len(rows):
                    have = sum(len(x[0]) for x in waiting.get(dim, ()))
                    part = rows[at : at + size - have]
                    waiting.setdefault(dim, []).append((ids[part].astype(np.int64), keys[part].astype(np.int64), values[offsets[part][:, None] + np.arange(dim)]))
                    at += len(part)
                    if have + len(part) == size:
                        yield block(dim)
        for dim in list(waiting):
            yield block(dim)

    vector = F.col(vector_col).cast("array<double>")
    kept = vectors.filter(F.col(id_col).isNotNull() & usable(vector_col)).select(F.col(id_col).cast("long"), F.xxhash64(vector), vector)
    return kept.mapInArrow(run, BLOCK)


def grid(cells: int, queries: int, candidates: int, query_blocks: int, candidate_blocks: int) -> tuple[int, int]:
    """Rows and columns of the grid for so many query and candidate vectors and blocks."""
    columns = math.ceil(math.sqrt(cells * max(1, candidates) / max(1, queries)))
    columns = max(1, min(columns, cells, candidate_blocks), math.ceil(candidate_blocks / HELD))
    return max(1, min(query_blocks, math.ceil(cells / columns))), columns


def pair(queries: DataFrame, candidates: DataFrame, shape: tuple[int, int], payload: list[str]) -> DataFrame:
    """Every query block with every candidate block of its dimension: q_block, q_ids, q_keys, q_data, dim and the
    candidates' ``payload`` columns. All pairs of a query block in a cell follow each other."""
    cell = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = candidates.select(every(shape[0]).alias("row"), cell(shape[1]).alias("column"), "dim", *[F.col(p).alias(f"c_{p}") for p in payload])
    q = queries.select(cell(shape[0]).alias("row"), every(shape[1]).alias("column"), "dim", *[F.col(p).alias(f"q_{p}") for p in ("block", "ids", "keys", "data")])
    return q.join(c.hint("shuffle_merge"), ["row", "column", "dim"]).select("q_block", "q_ids", "q_keys", "q_data", "dim", *[f"c_{p}" for p in payload])


def unpack(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(data, np.float64).reshape(-1, dim)


class Best:
    """The ``k`` best (score, then smaller id) of each query of a block, over all candidates seen so far."""

    def __init__(self, queries: int, k: int, kind: type):
        self.k, self.queries = k, queries
        self.query, self.ids, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
        #: The score a candidate must reach: the k-th best, or minus infinity.
        self.floor = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        query, ids, score = (np.concatenate(x) for x in ((self.query, query), (self.ids, ids), (self.score, score)))
        # Integers are turned by their complement: the least of them has no negative.
        order = np.lexsort((ids, ~score if score.dtype == np.int64 else -score, query))
        query = query[order]
        starts = np.concatenate(([0], np.cumsum(np.bincount(query, minlength=self.queries))))
        order = order[np.arange(len(query)) - starts[query] < self.k]
        counts = np.diff(starts)
        self.query, self.ids, self.score = query[np.arange(len(query)) - starts[query] < self.k], ids[order], score[order]
        full = np.flatnonzero(counts >= self.k)
        ends = np.cumsum(np.minimum(counts, self.k)) - 1
        self.floor[full] = self.score[ends[full]].astype(np.float64)

    def rows(self, ids: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids[self.query]), pa.array(keys[self.query]), pa.array(self.ids), pa.array(self.score)], names=["query_id", "query_key", "vec_id", "score"])


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query (id and vector) by score, ties to the smaller id: query_id, rank, vec_id, score.

    The row limit on the window keeps k rows of a query in every map task."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
