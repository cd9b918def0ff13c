"""The permutation index on full shards of 2,048 rows, each of which exceeds a query's budget of candidates."""

import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import permutation_index


def shards(spark, x, ids):
    """One partition, so that blocks are full, checked by their sizes."""
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").coalesce(1)
    assert {r.n for r in permutation_index.pack(df, "vec_id", "embedding").select("n").collect()} == {2048}
    return df


def recall(spark, x, ids, queries):
    """Share of the exact five nearest, by id with ties to the smaller, that are found."""
    df = shards(spark, x, ids)
    out = permutation_index.nearest(df, df.filter(F.col("vec_id").isin([int(q) for q in queries])), k=5, shard=2048, pivots=256).collect()
    found = {(r.query_id, r.vec_id) for r in out}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in queries:
        score = (u * u[ids == q][0]).sum(1).round(12)
        order = np.lexsort((ids, -score))
        hits += sum((q, i) in found for i in ids[order[ids[order] != q][:5]].tolist())
    assert len(out) == 5 * len(queries)
    return hits / (5 * len(queries))


def clustered(rng, n, dim=64):
    return rng.normal(size=(max(1, n // 40), dim))[rng.integers(0, max(1, n // 40), n)] + 0.6 * rng.normal(size=(n, dim))


def test_copies_over_the_cut_are_found_by_smallest_id(spark):
    rng = np.random.default_rng(11)
    x, ids = clustered(rng, 4096), rng.permutation(4096)
    copies = rng.permutation(4096)[:1365]
    x[copies] = x[copies[0]]
    queries = sorted(ids[copies].tolist())[3:600:60]
    assert recall(spark, x, ids, queries) == 1.0


def test_scaled_copies_over_the_cut_are_found(spark):
    rng = np.random.default_rng(12)
    x, ids = clustered(rng, 2048), rng.permutation(2048)
    copies = rng.permutation(2048)[:700]
    x[copies] = x[copies[0]] * 2.0 ** rng.integers(-3, 4, (700, 1))
    assert recall(spark, x, ids, sorted(ids[copies].tolist())[:200:40]) == 1.0


def test_equal_rows_score_the_same_wherever_they_stand():
    rng = np.random.default_rng(13)
    for dim in (24, 61, 64, 100):
        row, query = rng.normal(size=(1, dim)), rng.normal(size=dim)
        for n in (2, 7, 37, 308):
            x = np.tile(row, (n, 1))
            x[-1] = 1e200
            found = permutation_index.cosines(x, query)
            assert set(found[:-1].tolist()) == set(permutation_index.cosines(row, query).tolist()) and np.isfinite(found).all()


def test_recall_on_full_shards_with_copies_over_the_cut(spark):
    rng = np.random.default_rng(14)
    x, ids = rng.normal(size=(8192, 64)), rng.permutation(8192)
    x[:4096] = clustered(rng, 4096)
    copies = rng.permutation(8192)[:2730]
    x[copies] = x[copies[0]]
    plain = np.setdiff1d(ids, ids[copies])
    found = {name: recall(spark, x, ids, some.tolist()) for name, some in (("in the group", rng.permutation(ids[copies])[:30]), ("others", rng.permutation(plain)[:170]))}
    print(found)
    assert found["in the group"] == 1.0 and found["others"] >= 0.9
