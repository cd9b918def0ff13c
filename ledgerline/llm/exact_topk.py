"""Exact top-k inner-product search by columnar branch and bound.

Vectors are integers floor(scale * x). A block of candidates is held vertically, dimension block by dimension
block, in a rotation that puts the dimensions of most energy first (eigenvectors of the second moments of a
bounded sample; any rotation keeps inner products, so the sample cannot change a result). For a
block of queries, inner products are accumulated one dimension block at a time; after each, a pair's score can
grow by at most |rest of q| * |rest of x| (Cauchy-Schwarz on the remaining mass). Pairs whose bound is below the
query's k-th best score so far are compacted away, each query by its own floor, and later dimension blocks touch
survivors only. The floor rises with every slice of candidates and is carried over all blocks of a task. What
survives is scored exactly on the integers: float64 products when all partial sums stay below 2^53, else
Python integers. Bounds are loosened by more than their rounding errors.

Ties go to the smaller id; a query's own id is no candidate. A query is an id and a vector: rows that repeat both get one
answer, rows that repeat an id with other vectors one each; repeated candidate rows are one candidate each.
Vectors that are null, empty or hold a null or non-finite component take no part; queries meet candidates
of their own dimension. Scores beyond a signed 64-bit integer are given as its nearest end. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut
from ledgerline.llm.vectors import Best, best, grid, pack, pair, unpack, usable

#: Dimensions of a block; pairs are held as a matrix until fewer than ``SPARSE`` of them are left; rows of the rotation's sample.
DIMS, SPARSE, SAMPLE = 8, 0.25, 4096
_SMALLEST, _LARGEST = -(2**63), 2**63 - 1


def rotation(rows: np.ndarray) -> np.ndarray:
    """Orthonormal directions (columns) in order of the energy that ``rows`` have along them."""
    size = np.abs(rows).max(initial=0.0)
    if not size:
        return np.eye(rows.shape[1])
    return np.linalg.eigh((rows / size).T @ (rows / size))[1][:, ::-1]


def whole(x: np.ndarray) -> np.ndarray:
    """Rows of integer-valued floats as Python integers."""
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def small(queries: np.ndarray, candidates: np.ndarray) -> bool:
    """Whether float64 holds every partial sum of their products exactly."""
    return bool(np.abs(queries).max(initial=0) * np.abs(candidates).max(initial=0) * queries.shape[1] < 2**53)


def exact_scores(queries: np.ndarray, candidates: np.ndarray, i: np.ndarray, j: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """Inner products of the pairs (i, j) as 64-bit integers."""
    if small(queries, candidates):
        return np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", queries[i[a : a + step]], candidates[j[a : a + step]]) for a in range(0, len(i), step))]).astype(np.int64)
    q, c = (whole(x) for x in (queries, candidates))
    return np.array([min(max(int((q[a] * c[b]).sum()), _SMALLEST), _LARGEST) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)


class Vertical:
    """A block of vectors in the rotation: dimension blocks, and the mass that is left after each."""

    def __init__(self, x: np.ndarray, turn: np.ndarray):
        # One power of two for the block keeps float32 in range; it divides out of every comparison.
        self.scale = float(2.0 ** np.ceil(np.log2(max(np.abs(x).max(initial=0.0), 1.0))))
        turned = x / self.scale @ turn
        self.data = turned.astype(np.float32)
        squares = turned * turned
        self.mass = np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1])  # from each dimension on


def survivors(q: Vertical, c: Vertical, rows: slice, floor: np.ndarray, seen: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate of ``rows``) that may reach the queries' floors; ``seen`` counts the pairs met and those that
    came to the last dimension block."""
    data, mass, dim = c.data[rows], c.mass[rows], c.data.shape[1]
    need = floor / q.scale / c.scale
    need = (need - np.abs(need) * 1e-6 - 1e-30).astype(np.float32)
    # What rounding can take from a float32 sum of the pair's products.
    q_error, c_error = (q.mass[:, 0] * (2e-5 + 1e-7 * dim)).astype(np.float32), mass[:, 0].astype(np.float32)
    # Bounds cannot bite while most of the mass is left: up to there it is one product.
    share = mass.sum(0) < 0.75 * mass[:, 0].sum()
    at = min(dim, -(-max(1, int(np.argmax(share))) // DIMS) * DIMS) if share.any() else dim
    part = q.data[:, :at] @ data[:, :at].T
    seen[0] += part.size
    i = j = None
    while True:
        q_rest, c_rest = (m[:, at].astype(np.float32) if at < dim else np.zeros(len(m), np.float32) for m in (q.mass, mass))
        if i is None:
            keep = ~(part + q_rest[:, None] * c_rest + q_error[:, None] * c_error < need[:, None])
            if at == dim:
                return np.nonzero(keep)
            if np.count_nonzero(keep) < SPARSE * keep.size:
                i, j = np.nonzero(keep)
                part = part[i, j]
        else:
            keep = ~(part + q_rest[i] * c_rest[j] + q_error[i] * c_error[j] < need[i])
            i, j, part = i[keep], j[keep], part[keep]
            if at == dim:
                return i, j
        to = min(dim, at + DIMS)
        if to == dim:
            seen[1] += int(np.count_nonzero(keep))
        if i is None:
            part = part + q.data[:, at:to] @ data[:, at:to].T
        else:
            part = part + np.einsum("ij,ij->i", q.data[i, at:to], data[j, at:to])
        at = to


def first_slice(queries: np.ndarray, q_ids: np.ndarray, candidates: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that hold every query's ``k`` best of a slice, where there is no floor yet."""
    if not small(queries, candidates) or len(candidates) <= k:
        return tuple(x.ravel() for x in np.indices((len(queries), len(candidates))))
    scores = np.where(q_ids[:, None] == c_ids, -np.inf, queries @ candidates.T)
    return np.nonzero(scores >= np.partition(scores, len(candidates) - k, axis=1)[:, len(candidates) - k, None])


def search_block(found: Best, queries: np.ndarray, q_ids: np.ndarray, q: Vertical, candidates: np.ndarray, c_ids: np.ndarray, turn: np.ndarray, seen: list[int]) -> None:
    """Adds a candidate block to ``found``, in slices that double, so that the floors rise early."""
    c, at, size = Vertical(candidates, turn), 0, max(256, 4 * found.k)
    while at < len(candidates):
        rows = slice(at, min(len(candidates), at + size))
        if np.isneginf(found.floor).any():
            i, j = first_slice(queries, q_ids, candidates[rows], c_ids[rows], found.k)
        else:
            i, j = survivors(q, c, rows, found.floor, seen)
        j = at + j
        other = q_ids[i] != c_ids[j]
        i, j = i[other], j[other]
        found.add(i, c_ids[j], exact_scores(queries, candidates, i, j))
        at, size = rows.stop, size * 2 if at else size


def exact_topk(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: float = 64.0, cells: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every row of ``queries`` against all of ``vectors``."""
    cells = cells or int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scaled = lambda df: df.select(id_col, F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.lit(float(scale)) * x).alias(vector_col))
    turns = rotations(scaled(vectors), id_col, vector_col, sample)
    asked = cut(pack(scaled(queries).distinct(), id_col, vector_col, size=512))
    n, asked_n = vectors.count(), asked.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    pairs = pair(asked, pack(scaled(vectors), id_col, vector_col), grid(cells, asked_n[1], n, asked_n[0], -(-n // 2048)), ["ids", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found, seen = None, None, [0, 0]
        for batch in batches:
            for q_block, q_ids, q_keys, q, dim, c_ids, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if now != q_block:
                    if found is not None:
                        yield found.rows(qi, keys)
                    qi, qv = unpack(q_ids, q, dim)
                    keys, qv, turn = np.frombuffer(q_keys, np.int64), np.floor(qv), turns.get(dim)
                    turn = np.eye(dim) if turn is None else turn
                    now, found, upright = q_block, Best(len(qi), k, np.int64), Vertical(qv, turn)
                ci, cv = unpack(c_ids, c, dim)
                search_block(found, qv, qi, upright, np.floor(cv), ci, turn, seen)
        if found is not None:
            yield found.rows(qi, keys)

    return best(pairs.mapInArrow(run, "query_id long, query_key long, vec_id long, score long"), k)


def rotations(vectors: DataFrame, id_col: str, vector_col: str, sample: int) -> dict[int, np.ndarray]:
    """A rotation for each dimension of the ``sample`` vectors whose ids hash lowest; others are searched unrotated."""
    rows = vectors.filter(usable(vector_col)).select(vector_col).orderBy(F.xxhash64(F.lit(5), F.col(id_col)), F.col(id_col)).limit(sample).toArrow().column(0).to_pylist()
    return {d: rotation(np.floor(np.array([r for r in rows if len(r) == d], float))) for d in {len(r) for r in rows}}
