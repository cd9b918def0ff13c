"""Exact search against Python integers, its pruning on real vectors, the index's parts against direct computations, and both on odd rows."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import exact_topk, permutation_index, queries, vectors

LEAST, MOST = -(2**63), 2**63 - 1


def searched(x, ids, at, k, block):
    whole = np.floor(x)
    turn, found, seen = exact_topk.rotation(whole[:4096]), vectors.Best(len(at), k, np.int64), [0, 0]
    for a in range(0, len(x), block):
        exact_topk.search_block(found, whole[at], ids[at], exact_topk.Vertical(whole[at], turn), whole[a : a + block], ids[a : a + block], turn, seen)
    return found, seen


@pytest.mark.parametrize("size", [1.0, 1e-3, 1e6, 1e8, 1e17, 1e30])
@pytest.mark.parametrize("repeated", [False, True])
def test_scores_are_those_of_integers(size, repeated):
    rng = np.random.default_rng(int(np.log10(size)) + 50 + repeated)
    for _ in range(4):
        n, d = rng.integers(1, 400), rng.integers(1, 40)
        x = 64 * rng.normal(size=(n, d)) * size
        x[rng.random(n) < 0.3] = x[0]
        ids, at = rng.integers(0, n, n) if repeated else np.arange(n), np.arange(0, n, 3)
        found, _ = searched(x, ids, at, 5, 100)
        rows = [[int(v) for v in row] for row in np.floor(x).tolist()]
        for q, i in enumerate(at.tolist()):
            scores = sorted((-min(max(sum(u * v for u, v in zip(rows[i], rows[j], strict=True)), LEAST), MOST), int(ids[j])) for j in range(n) if ids[j] != ids[i])
            mine = found.query == q
            assert [(-s, j) for s, j in scores[:5]] == list(zip(found.score[mine].tolist(), found.ids[mine].tolist(), strict=True))


def test_pruning_on_the_given_vectors():
    rows = duckdb.sql("select embedding from '/root/testdata/sf0.1/embeddings.parquet' order by vec_id").fetchall()
    x = 64 * np.array([r[0] for r in rows], float)
    _, seen = searched(x, np.arange(len(x)), np.arange(0, len(x), 20), 20, 2048)
    assert seen[0] > 0 and seen[1] / seen[0] < 0.5  # share of the pairs that come to the last dimension block


def test_large_scores_and_odd_rows(spark):
    big = 9999999.0
    rows = [(0, [big, 1.0]), (20, [big, 3.0]), (20, [big, 3.0]), (40, [1.0, -big]), (1, [big, 1.0]), (1, [big, 1.0]), (2, [big]), (3, None), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"query_id": F.lit("clash"), "score": F.lit("clash")})
    out = exact_topk.exact_topk(df, df.filter("vec_id % 20 = 0"), k=4).collect()
    whole = [(i, [int(64 * v) for v in x]) for i, x in rows if i is not None and x and all(v is not None and abs(v) < 1e300 for v in x)]
    for q in (0, 20, 40):
        mine = next(x for i, x in whole if i == q)
        want = sorted((-sum(a * b for a, b in zip(mine, x, strict=True)), i) for i, x in whole if i != q and len(x) == len(mine))[:4]
        assert [(r.vec_id, r.score) for r in sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])] == [(i, -s) for s, i in want]
    assert max(r.score for r in out) > 2**53
    two = spark.createDataFrame([(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r["rank"], r.vec_id, r.score) for r in exact_topk.exact_topk(two, two.filter("vec_id = 20"), k=1).collect()) == [(1, 1, 4096), (1, 2, 4096)]
    for search in (exact_topk.exact_topk, permutation_index.nearest):
        assert search(df.limit(0), df.limit(0), k=3).count() == 0
        assert sorted(r.vec_id for r in search(two, two.filter("vec_id = 1"), k=5).collect()) == [2, 20, 20]


def test_query_against_its_sql(spark):
    small = "/root/testdata/sf0.001"
    want = duckdb.sql(queries.OP5_SQL.replace("FROM embeddings", f"FROM '{small}/embeddings.parquet'")).fetchall()
    assert sorted(tuple(r) for r in queries.op5_exact_topk(spark, small).collect()) == sorted(want)


def test_grid_is_bounded_and_covers():
    assert vectors.grid(6, 2564, 51282, 6, 26) == (1, 6)
    rows, columns = vectors.grid(2000, 50_000_000, 1_000_000_000, 100_000, 500_000)
    assert columns >= 500_000 / vectors.HELD and rows * columns >= 2000
    rows, columns = vectors.grid(2000, 50_000, 1_000_000, 2000, 2000)
    assert rows * columns >= 2000 and rows * 20 + columns < 420  # the table is shuffled rows times, the queries columns times


def test_every_pair_of_blocks_meets_once(spark):
    rows = [(i, [float(i), 1.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    q, c = vectors.pack(df.filter("vec_id % 3 = 0"), "vec_id", "embedding", size=7).cache(), vectors.pack(df, "vec_id", "embedding", size=11).cache()
    for shape in ((1, 1), (3, 4), (4, 1)):
        met = vectors.pair(q, c, shape, ["block"]).select("q_block", "c_block").collect()
        assert sorted((r[0], r[1]) for r in met) == sorted((a.block, b.block) for a in q.collect() for b in c.collect())


def test_closeness_is_the_footrule_distance():
    rng = np.random.default_rng(5)
    x, pivots = permutation_index.unit(rng.normal(size=(200, 16))), permutation_index.unit(rng.normal(size=(40, 16)))
    m = 9
    files, ranked = permutation_index.Files(x, pivots, m), permutation_index.prefixes(x, pivots, m)
    assert all(np.array_equal(np.argsort(-(x[i] @ pivots.T), kind="stable")[:m], ranked[i]) for i in range(200))
    place = np.full((200, 40), m)
    np.put_along_axis(place, ranked, np.arange(m)[None, :], 1)
    for q in range(0, 200, 17):
        footrule = np.abs(place - place[q]).sum(1)
        close = files.closeness(ranked[q])
        assert np.array_equal(m * (m + 1) - 2 * close, footrule)
        near = set(files.nearest(ranked[q], 20).tolist())
        assert near == set(np.flatnonzero(footrule <= np.sort(footrule)[19]).tolist())


def test_recall_where_every_shard_exceeds_the_budget(spark):
    df = spark.read.parquet("/root/testdata/check_s/embeddings.parquet")
    asked = df.filter("vec_id % 50 = 0")
    rows = df.select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = permutation_index.nearest(df.coalesce(2), asked, k=5).toPandas()
    hits = 0
    for q, part in out.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        hits += (part.score.to_numpy() >= np.sort(s)[-5] - 1e-12).sum()
    print(hits / len(out))
    assert len(out) == 5 * asked.count() and hits / len(out) >= 0.9
