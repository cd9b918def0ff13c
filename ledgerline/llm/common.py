"""Shared helpers: table access, lineage cuts, hash folds, bounded samples and column names."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the standard tables, through Spark's reader (any store Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, so that lost executors
    never cause the work above to run again.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a local master (tests on one machine) gets a
    temporary one and a cluster an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="ledgerline-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that ``cut`` gave and nothing reads any more."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that sorts and merges whatever Spark takes its size for.

    Spark takes a frame below ``explode`` or a ``cut`` for as small as what it was made from, at times by a factor of 31, and would
    build it whole in the driver to broadcast it. Sorting spills and holds no side in memory.
    """
    return df.hint("merge")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids fall in fold 0 (crc32 of '')."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def _low(share: float) -> int:
    """The bound under which ``share`` of all 64-bit hashes lie."""
    return min(2**63 - 1, int(-(2**63) + share * 2**64))


def _thin(df: DataFrame, stratum: str, hashed: Column, counts: dict, most: int) -> DataFrame:
    """Of each value of ``stratum`` with ``counts`` rows, ``most`` in expectation: those whose hash is low. No shuffle."""
    bounds = [F.when(F.col(stratum) == F.lit(v), F.lit(_low(most / n))) for v, n in counts.items() if n > most]
    return df.filter(hashed <= F.coalesce(*bounds, F.lit(2**63 - 1))) if bounds else df


def labelled_sample(docs: DataFrame, labels: DataFrame, counts: dict, *, id_col: str, text_col: str, label_col: str, per_label: int) -> DataFrame:
    """``_text`` and ``_label`` of about ``per_label`` rows (in expectation, all where there are fewer) of each label in
    ``counts`` (rows by label), cut to the shared folder.

    Which ids are in the sample is settled by their hash, on (id, label) alone. That list is bounded by ``per_label`` times
    the number of labels, so it is broadcast; texts outside the sample are never shuffled. Where ids repeat in ``docs``, rows
    are thinned once more by the hash of id and text. Rows that repeat both count once. The sample's texts are dealt
    by that hash, so a hot label or id takes no task of its own. Null ids, labels and texts don't take part.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).dropna()
    keys = F.broadcast(_thin(known, "_label", F.xxhash64(F.lit(17), "_id"), counts, per_label).distinct())
    ids = docs.select(F.col(id_col).alias("_key")).join(keys, F.col("_key") == F.col("_id"))
    met = {r[0]: r[1] for r in ids.groupBy("_label").count().collect()}
    texts = docs.select(F.col(id_col).alias("_key"), F.col(text_col).cast("string").alias("_text")).dropna()
    joined = texts.join(keys, F.col("_key") == F.col("_id")).select("_text", "_label", "_id")
    doubled = {v: n for v, n in met.items() if n > 2 * per_label}
    kept = _thin(joined, "_label", F.xxhash64(F.lit(19), "_id", "_text"), doubled, per_label)
    return cut(kept.dropDuplicates(["_id", "_text", "_label"]).select("_text", "_label"))


def with_text(docs: DataFrame, id_cols: list[str], text_col: str, made: tuple[str, ...]) -> tuple[DataFrame, int, str]:
    """``docs`` narrowed to ``id_cols`` and the text (once), the text's place, and the fields of ``id_cols`` as DDL.

    An error names columns of ``id_cols`` that ``made``, the columns the operator adds, would repeat."""
    if clash := sorted({c.lower() for c in id_cols} & {c.lower() for c in made}):
        raise ValueError(f"id_cols holds {', '.join(clash)}, which the operator adds; rename one of the two")
    names = list(dict.fromkeys([*id_cols, text_col]))
    kept = docs.select(*[F.col(c).cast("string").alias(c) if c == text_col else F.col(c) for c in names])
    kinds = dict(kept.dtypes)
    return kept, names.index(text_col), ", ".join(f"`{c}` {kinds[c]}" for c in id_cols)


def fresh(docs: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as it takes to be no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
