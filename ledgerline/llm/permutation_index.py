"""Approximate nearest neighbours by a permutation index.

Fit. ``pivots`` vectors of a bounded sample (those whose ids hash lowest, distinct) are the pivots.
A vector is represented by its ``prefix`` nearest pivots in order. Index: every vector is indexed; a shard is a block of
vectors whose distinct directions are posted (pivot -> directions, position) in inverted files, made once and written
to the shared folder. A query reads the files of its own nearest pivots and accumulates the footrule
distance over them; a pivot missing from a prefix counts as position ``prefix``, so only shared pivots need a
visit. The directions with the smallest distance are expanded to their vectors and reranked by exact cosine on
the originals in double precision: of a shard of n directions ``breadth`` * sqrt(n), by the same rule at every
size, and all that tie with the last of them. Equal vectors are scored once and stand for their rows in order of
id, so copies take no places from others and none is lost to the cut, however large their group.

Only the pivots come from a sample. Recall at 5 against brute force is measured in the tests (and must be 0.9 or more).

Vectors that are null, empty, zero or hold a null or non-finite component take no part; a query's own id is no
candidate; ties go to the smaller id. A query is an id and a vector: rows that repeat both get one answer, rows that repeat
an id with other vectors one each. Vectors of other dimensions than the pivots' are searched in full. An empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut
from ledgerline.llm.vectors import Best, best, grid, pack, pair, unpack, usable

PIVOTS, PREFIX, BREADTH, SHARD = 1024, 56, 7.0, 8192


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, through their largest component so that no square overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def prefixes(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest pivots of each row, nearest first."""
    near = x @ pivots.T
    part = np.argpartition(-near, min(prefix, near.shape[1]) - 1, axis=1)[:, :prefix] if prefix < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(x), 1))
    order = np.argsort(-np.take_along_axis(near, part, 1), axis=1, kind="stable")
    return np.take_along_axis(part, order, 1)


def lengths(rows: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", under="ignore"):
        return np.sqrt((rows * rows).sum(1))


def cosines(rows: np.ndarray, query: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """Cosines of the original vectors in double precision; scaled first only where squares overflow or vanish.

    Each row is summed by itself, so equal rows score the same wherever they stand (a matrix product
    may differ in the last bit by place, and ties would not go to the smaller id)."""
    with np.errstate(over="ignore", under="ignore", divide="ignore", invalid="ignore"):
        size = (lengths(rows) if known is None else known) * lengths(query[None, :])[0]
        out = (rows * query).sum(1) / size
    odd = ~(np.isfinite(size) & (size > 1e-300))
    if odd.any():
        out[odd] = (unit(rows[odd]) * unit(query[None, :])[0]).sum(1)
    return out


def groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each row of equal rows, and the first row of each group."""
    _, first, group = np.unique(key + 0.0, axis=0, return_index=True, return_inverse=True)
    return group.reshape(-1), first


def ragged(order: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of the groups ``which`` (group g holds ``order[starts[g]:starts[g + 1]]``), and the place in ``which`` of each."""
    size = starts[which + 1] - starts[which]
    place = np.repeat(np.arange(len(which)), size)
    return order[np.repeat(starts[which] - np.cumsum(size) + size, size) + np.arange(size.sum())], place


def members(group: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(group, kind="stable")
    return order, np.concatenate(([0], np.cumsum(np.bincount(group, minlength=count))))


class Shard:
    """One block of candidates: distinct vectors with their ids, and the inverted files of their distinct directions.

    Of each vector only rows that can be among ``k`` results are kept: ``k`` rows of an id, and the
    first ``2 * k`` rows by id, which hold ``k`` rows besides those of any one query id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray | None, prefix: int, k: int):
        group, first = groups(x)
        self.vectors = x[first]
        self.lengths = lengths(self.vectors)
        order = np.lexsort((ids, group))
        for same, most in (((ids,), k), ((), 2 * k)):
            keys = [group[order], *(s[order] for s in same)]
            new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in keys], axis=0)))
            at = np.arange(len(order))
            order = order[at - np.maximum.accumulate(np.where(new, at, 0)) < most]
        self.ids, self.starts = ids[order], np.concatenate(([0], np.cumsum(np.bincount(group[order], minlength=len(first)))))
        self.files = None
        if pivots is not None:
            ways = unit(self.vectors)
            way, one = groups(ways.round(12))
            self.ways = members(way, len(one))
            self.files = Files(ways[one], pivots, prefix)

    def search(self, query_id: int, query: np.ndarray, ranked: np.ndarray | None, breadth: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best ``k`` rows found."""
        near = np.arange(len(self.vectors))
        if self.files:
            near = self.files.nearest(ranked, max(k, math.ceil(breadth * math.sqrt(self.files.rows))))
            near = self.ways[0][near] if self.files.rows == len(self.vectors) else ragged(*self.ways, near)[0]
        score = cosines(self.vectors[near], query, self.lengths[near])
        if len(self.ids) == len(self.vectors):  # then ``ids`` are in the order of ``vectors``
            ids = self.ids[near]
        else:
            rows, place = ragged(np.arange(len(self.ids)), self.starts, near)
            ids, score = self.ids[rows], score[place]
        other = ids != query_id
        ids, score = ids[other], score[other]
        if len(ids) > 4 * k:
            high = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
            ids, score = ids[high], score[high]
        top = np.lexsort((ids, -score))[:k]
        return ids[top], score[top]


class Files:
    """Inverted files: for each pivot the rows that have it, and at which position."""

    def __init__(self, x: np.ndarray, pivots: np.ndarray, prefix: int):
        ranked = prefixes(x, pivots, prefix)
        self.prefix, self.rows = ranked.shape[1], len(x)
        flat = ranked.ravel()
        order = np.argsort(flat, kind="stable")
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(flat, minlength=len(pivots)))))
        row, position = np.divmod(order, self.prefix)
        self.row, self.position = row.astype(np.int32), position.astype(np.int16)

    def closeness(self, ranked: np.ndarray) -> np.ndarray:
        """Half of what each row's footrule distance to one query's ordered pivots falls short of the disjoint case.

        With a missing pivot at position m on either side, a pivot at i here and j there lowers the distance by
        (m-i)+(m-j)-|i-j|, which is twice m - max(i, j)."""
        spans = [slice(a, b) for a, b in zip(self.starts[ranked].tolist(), self.starts[ranked + 1].tolist(), strict=True)]
        rows, position = (np.concatenate([x[s] for s in spans]) for x in (self.row, self.position))
        own = np.repeat(np.arange(len(ranked), dtype=np.int16), self.starts[ranked + 1] - self.starts[ranked])
        return np.bincount(rows, self.prefix - np.maximum(own, position), self.rows).astype(np.int64)

    def nearest(self, ranked: np.ndarray, take: int) -> np.ndarray:
        """The ``take`` rows of smallest footrule distance, and all that tie with the last of them."""
        if take >= self.rows:
            return np.arange(self.rows)
        close = self.closeness(ranked)
        at_least = np.cumsum(np.bincount(close)[::-1])  # closeness is a small whole number: rows by it, from the highest
        return np.flatnonzero(close >= len(at_least) - 1 - int(np.searchsorted(at_least, take)))


def choose_pivots(vectors: DataFrame, id_col: str, vector_col: str, pivots: int = PIVOTS) -> np.ndarray:
    """At most ``pivots`` distinct directions of the commonest dimension, from the lowest id hashes."""
    kept = vectors.filter(usable(vector_col) & F.exists(vector_col, lambda x: x != 0))
    rows = kept.select(F.col(vector_col).cast("array<double>").alias("v")).orderBy(F.xxhash64(F.lit(5), F.col(id_col)), F.col(id_col)).limit(4 * pivots).toArrow().column(0).to_pylist()
    if not rows:
        return np.zeros((0, 1))
    dims = [len(r) for r in rows]
    dim = max(sorted(set(dims)), key=dims.count)
    found = np.unique(unit(np.array([r for r in rows if len(r) == dim])).round(12), axis=0)
    return found[np.random.default_rng(5).permutation(len(found))[:pivots]]


def index(vectors: DataFrame, chosen: np.ndarray, *, id_col: str, vector_col: str, prefix: int, k: int, shard: int) -> DataFrame:
    """One row a shard: its vectors, ids and inverted files as bytes, with dim, n and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data, n, dim, block in zip(*(batch.column(c).to_pylist() for c in ("ids", "data", "n", "dim", "block")), strict=True):
                made = Shard(*unpack(ids, data, dim), chosen if len(chosen) and dim == chosen.shape[1] else None, prefix, k)
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made, pickle.HIGHEST_PROTOCOL)], pa.binary()), pa.array([n], pa.int32()), pa.array([dim], pa.int32()), pa.array([block], pa.int64())], names=["shard", "n", "dim", "block"])

    return pack(vectors, id_col, vector_col, size=shard).mapInArrow(run, "shard binary, n int, dim int, block long")


def nearest(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, pivots: int = PIVOTS, prefix: int = PREFIX, breadth: float = BREADTH, shard: int = SHARD, cells: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score (cosine) of the ``k`` nearest found for each row of ``queries``."""
    cells = cells or int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nonzero = F.exists(vector_col, lambda x: x != 0)
    chosen = choose_pivots(vectors, id_col, vector_col, pivots)
    asked = cut(pack(queries.filter(nonzero).select(id_col, F.col(vector_col).cast("array<double>").alias(vector_col)).distinct(), id_col, vector_col, size=512))
    indexed = cut(index(vectors.filter(nonzero), chosen, id_col=id_col, vector_col=vector_col, prefix=prefix, k=k, shard=shard))
    (q_blocks, q_rows), (c_blocks, c_rows) = (df.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first() for df in (asked, indexed))
    pairs = pair(asked, indexed, grid(cells, q_rows, c_rows, q_blocks, c_blocks), ["shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, None
        for batch in batches:
            for q_block, q_ids, q_keys, q, dim, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if now != q_block:
                    if found is not None:
                        yield found.rows(qi, keys)
                    qi, qv = unpack(q_ids, q, dim)
                    now, keys, found = q_block, np.frombuffer(q_keys, np.int64), Best(len(qi), k, float)
                    ranked = prefixes(unit(qv), chosen, prefix) if len(chosen) and dim == chosen.shape[1] else None
                searched: Shard = pickle.loads(data)
                rows = [searched.search(qi[i], qv[i], ranked[i] if searched.files else None, breadth, k) for i in range(len(qi))]
                found.add(np.repeat(np.arange(len(qi)), [len(r[0]) for r in rows]), np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]))
        if found is not None:
            yield found.rows(qi, keys)

    return best(pairs.mapInArrow(run, "query_id long, query_key long, vec_id long, score double"), k)
