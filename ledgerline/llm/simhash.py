"""SimHash fingerprints and near-duplicate groups by covering locality-sensitive hashing.

Fingerprint. Texts are lower-cased in A-Z, cut into words at ASCII white space and into shingles
of ``words`` words (repeats included; a shorter text is one shingle; no word: zero). Bit i is 1 if
over half of the shingles' XXH64 values have it set.

Candidates. For radius r every bit position x gets a vector a(x) of r+1 bits, and table v (every
non-zero vector of r+1 bits) looks at the bits with <a(x), v> = 1 mod 2. Two fingerprints that
differ at r positions or fewer leave some v orthogonal to all those a(x) (r equations in r+1
unknowns), so they collide in table v: 2^(r+1)-1 tables find every pair, with certainty. The a(x)
cycle over all non-zero vectors, so each table looks at about half of the 64 bits.

Scale. Equal fingerprints become one row before any table is built, so groups of exact copies,
however large, cost one row. Only keys that two or more distinct fingerprints share go on. A
bucket of over ``chunk`` fingerprints is dealt into chunks and every pair of chunks is compared in
a task of its own: memory stays bounded and no pair is missed. Comparison is numpy XOR and popcount;
a bucket emits a spanning forest of its links, never all pairs. Components come from
``components.connected``. No side of a join is broadcast, so the driver's memory doesn't grow with the table.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; rows with
a null id keep it and take part (their component is the smallest other id, or null); repeated ids
stay as rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, merged
from ledgerline.llm.components import connected

SEED, SALTS = 42, 32


def fingerprint(text: bytes | None, words: int = 4) -> int:
    w = text.lower().split() if text else []
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    hashed = xxhash.xxh64_intdigest
    h = np.fromiter((hashed(line[a:b], SEED) for a, b in zip(starts[: len(w) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)), np.uint64, len(w) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``id_col`` and ``fp``, the fingerprint's 64 bits as a (signed) long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, words) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["_id", "fp"])

    kept = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").cast("binary"))
    return kept.mapInArrow(run, f"_id {kept.dtypes[0][1]}, fp long").withColumnRenamed("_id", id_col)


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """The 2^(radius+1)-1 masks as signed 64-bit integers."""
    vectors = 2 ** (radius + 1) - 1
    masks = []
    for v in range(1, vectors + 1):
        m = sum(1 << x for x in range(bits) if bin((x % vectors + 1) & v).count("1") % 2)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return masks


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links that connect what is within ``radius`` in ``a`` (and across to ``b``): a spanning
    forest, found by breadth-first search with one vectorised comparison per fingerprint."""
    nodes = a if b is None else np.concatenate([a, b])
    todo, out = np.ones(len(nodes), bool), []
    for root in range(len(nodes)):
        if not todo[root]:
            continue
        todo[root] = False
        stack = [root]
        while stack:
            at = stack.pop()
            left = np.flatnonzero(todo)
            if not len(left):
                return out
            near = left[np.bitwise_count(nodes[left] ^ nodes[at]) <= radius]
            todo[near] = False
            stack += near.tolist()
            out += [(int(nodes[at]), int(nodes[x])) for x in near]
    return out


def links(distinct: DataFrame, *, radius: int = 4, chunk: int = 4096) -> DataFrame:
    """``src`` and ``dst``: links whose components are those of all pairs within ``radius``.

    ``distinct`` has the distinct fingerprints in ``fp``."""
    tables = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in covering_masks(radius)])).alias("table", "key")
    keys = distinct.select("fp", tables)
    shared = keys.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    dealt = keys.join(merged(shared), ["table", "key"])
    parts = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    # Chunk i meets every chunk j in the task (min, max); a bucket of one chunk stays whole.
    dealt = dealt.select("table", "key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    dealt = dealt.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    tasks = dealt.groupBy("table", "key", "lo", "hi").agg(F.collect_list("fp").alias("fps")).select("fps")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            values, offsets = column.flatten().to_numpy(), column.offsets.to_numpy()
            offsets = offsets - offsets[0]
            out: list[tuple[int, int]] = []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                if b - a == 2:
                    x, y = int(values[a]), int(values[a + 1])
                    if ((x ^ y) & 0xFFFFFFFFFFFFFFFF).bit_count() <= radius:
                        out.append((x, y))
                else:
                    out += forest(values[a:b], None, radius)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["src", "dst"])

    return tasks.mapInArrow(compare, "src long, dst long").filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, chunk: int = 4096) -> DataFrame:
    """``id_col``, ``fp`` and ``component_id``, the smallest id reachable over links."""
    fps = cut(fingerprints(docs, id_col=id_col, text_col=text_col, words=words))
    distinct = fps.groupBy("fp").agg(F.min(id_col).alias("_least"))
    roots = connected(links(distinct.select("fp"), radius=radius, chunk=chunk))
    named = distinct.join(merged(roots.withColumnRenamed("node", "fp")), "fp", "left")
    # Classes of one fingerprint are named already. Others get their name by the root, each member in one of
    # ``SALTS`` lots by its own hash, so that a large class is no task of its own.
    alone = named.filter("root is null").select(F.col("fp").alias("_fp"), F.col("_least").alias("component_id"))
    linked = named.filter("root is not null").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    least = linked.groupBy("root", "salt").agg(F.min("_least").alias("_least")).groupBy("root").agg(F.min("_least").alias("component_id"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    classes = alone.unionByName(linked.join(merged(least), ["root", "salt"]).select(F.col("fp").alias("_fp"), "component_id"))
    return fps.join(merged(classes), F.col("fp") == F.col("_fp")).select(id_col, "fp", "component_id")


def hex16(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
