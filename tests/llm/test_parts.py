"""Parts of the operators against plain computations, and rows that are odd, long, repeated or skewed."""

import hashlib
import math
import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import bpe, common, components, langid, packing, quality, queries, secrets, simhash, toxicity

SMALL = "/root/testdata/sf0.01"


# --- secrets ---

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_base(text):
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(spans, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secret_query_against_a_plain_loop(spark):
    got = {r.doc_id: r for r in queries.op1_secret_scan(spark, SMALL).collect()}
    rows = duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall()
    assert len(got) == len(rows) and sum(r.n_assign + r.n_access + r.n_hex for r in got.values()) > 20
    for doc_id, text in rows:
        spans, r = plain_base(text or ""), got[doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]
        shown = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert set(shown) <= set(r.spans.split(",")) | {""}


@pytest.mark.parametrize(("encoding", "size"), [("lower", 40), ("upper", 40), ("hex", 20), ("base32", 24), ("base62", 16), ("base64url", 20)])
def test_random_keys_of_every_encoding_are_found(encoding, size):
    r = random.Random(encoding)
    letters = dict(secrets.ENCODINGS)[encoding]
    found = [secrets.surprise("".join(r.choices(letters, k=size))) for _ in range(300)]
    assert sum(bool(f) and f[1] > 8 for f in found) > 270


def test_evidence_is_calibrated_on_ordinary_runs():
    """Of identifiers and paths made of held-out words, no larger share than exp(-x) has evidence x."""
    texts = [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.1/documents.parquet' where text is not null").fetchall()]
    words = sorted({w for t in texts for w in re.findall("[A-Za-z]{2,}", t)})
    r = random.Random(7)
    shapes = [lambda w: "_".join(w).lower(), lambda w: "".join(x.title() for x in w), lambda w: "-".join(w), lambda w: "/".join(w), lambda w: "".join(w).lower(), lambda w: "_".join(w).upper(), lambda w: f"{'/'.join(w)}/{r.randrange(10**6)}"]
    runs = [x for x in (r.choice(shapes)(r.choices(words, k=r.randint(2, 7))) for _ in range(20000)) if len(x) >= secrets.SHORTEST]
    evidence = [(secrets.surprise(x) or ("", 0.0))[1] for x in runs]
    assert len(runs) > 10000
    for x in (1, 2, 4, 6):
        assert sum(e >= x for e in evidence) / len(runs) <= math.exp(-x)


def test_battery_lowers_the_evidence():
    assert secrets.fisher((0.5, 0.5, 0.5)) == pytest.approx(math.log(math.exp(-3 * math.log(2)) * (1 + 3 * math.log(2) + (3 * math.log(2)) ** 2 / 2)))
    assert secrets.fisher((0.0, 0.5, 0.5)) == -math.inf
    r = random.Random(1)
    key = "".join(r.choices(dict(secrets.ENCODINGS)["base62"], k=64))
    assert secrets.surprise(key)[1] > 20 and not secrets.surprise("".join(sorted(key)))  # the same symbols in order


def test_what_base_spans_leave_of_a_random_run():
    accept = dict.fromkeys(range(30), 0)
    r = random.Random(4)
    key = "".join(r.choices(dict(secrets.ENCODINGS)["base62"], k=30))
    text = f"x {key}+AKIA{'Q7' * 10} y"
    base, spans = secrets.all_spans(text, accept)
    assert base == [("access", 33, 57)] and (not any(s[0] == "random" for s in spans) or spans[0] == ("random", 2, 33))
    assert list(secrets.uncovered(0, 10, [("hex", 2, 4), ("hex", 3, 6), ("hex", 20, 30)])) == [("random", 0, 2), ("random", 6, 10)]
    assert list(secrets.uncovered(5, 10, [("hex", 0, 30)])) == []


# --- toxicity ---


def test_exception_phrases_reach_over_any_gap():
    lexicon = toxicity.Lexicon(words={"bad": 5.0}, phrases=frozenset({"not bad", "bad luck"}), bias=-2.0, slopes=(1.0, 1.0))
    automaton = lexicon.automaton()
    for text, hits in (("not bad", 0), ("not" + " " * 70 + "bad", 0), ("not, \n\n -- 123 -- bad", 0), ("bad" + "." * 500 + "luck", 0), ("so bad", 1), ("nott bad", 1), ("bad", 1), ("x" * 100 + "not bad", 1)):
        assert len(lexicon.matches(text, automaton)) == hits, text
    assert toxicity.word_before("ab  -cd", 5) == "ab" and toxicity.word_before("ab", 0) == ""


def test_matches_against_a_plain_search():
    r = random.Random(9)
    for _ in range(200):
        words = {"".join(r.choices("abc", k=r.randint(1, 4))): r.random() + 0.1 for _ in range(4)}
        stems = {"".join(r.choices("abc", k=r.randint(2, 4))): r.random() + 0.1 for _ in range(3)}
        text = " ".join("".join(r.choices("abc", k=r.randint(1, 6))) for _ in range(8))
        want = {}
        for m in re.finditer("[a-c]+", text):
            best = max([words.get(m[0], 0.0), *(w for s, w in stems.items() if m[0].startswith(s))])
            if best:
                want[m.start()] = best
        lexicon = toxicity.Lexicon(words=words, stems=stems)
        assert {at: w for at, (_, w) in lexicon.matches(text, lexicon.automaton()).items()} == want


def test_toxicity_held_out_and_empty_tables(spark):
    big = "/root/testdata/sf0.1"
    scored = queries.op3_toxicity(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").filter("held_out and toxic is not null").select("score", "predicted", "toxic").toPandas()
    pos, neg = scored.score[scored.toxic == 1].to_numpy(), scored.score[scored.toxic == 0].to_numpy()
    auc = ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2).item()
    recall, precision = (scored.predicted[scored.toxic == 1] == 1).mean(), (scored.toxic[scored.predicted == 1] == 1).mean()
    print(auc, recall, precision)
    assert auc > 0.9 and recall > 0.8 and precision > 0.8
    docs = spark.createDataFrame([], "doc_id long, text string")
    lexicon = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, lexicon, id_cols=["doc_id"]).count() == 0


# --- samples ---


def test_sample_is_bounded_dealt_and_whole_where_small(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("y"))
    picked = common.labelled_sample(docs, labels, {0: 18000, 1: 2000}, id_col="doc_id", text_col="text", label_col="y", per_label=3000)
    seen = {r[0]: r[1] for r in picked.groupBy("_label").count().collect()}
    assert seen[1] == 2000 and abs(seen[0] - 3000) < 300 and picked.count() == picked.distinct().count()
    hot = docs.select(F.lit(5).cast("long").alias("doc_id"), "text").unionByName(docs.limit(50).select("doc_id", F.lit("same").alias("text"))).unionByName(docs.limit(50).select("doc_id", F.lit("same").alias("text")))
    picked = common.labelled_sample(hot, spark.createDataFrame([(5, 1), (7, 0)], "doc_id long, y int"), {1: 1, 0: 1}, id_col="doc_id", text_col="text", label_col="y", per_label=100)
    seen = {r[0]: r[1] for r in picked.groupBy("_label").count().collect()}
    assert seen[0] == 1 and 50 < seen[1] < 200


# --- language ---


def grams(text):
    plain = langid.letters(text)
    return {plain[i : i + k] for k in (1, 2, 3) for i in range(len(plain) - k + 1)}


def test_language_scores_are_those_of_the_kernel():
    texts = ["the cat sat on the mat", "der hund und die katze", "le chat est sur la table", "el gato en la mesa", "the dog and the house", "die stadt und der wald"]

    def bits(t):
        row = np.zeros(langid.SLOTS, np.float32)
        langid.presence(langid.letters(t), row)
        return row

    rows = [bits(t) for t in texts]
    for a, x in zip(texts, rows, strict=True):
        for b, y in zip(texts, rows, strict=True):  # hashing is exact but for collisions
            assert x @ y / math.sqrt(x.sum() * y.sum()) == pytest.approx(len(grams(a) & grams(b)) / math.sqrt(len(grams(a)) * len(grams(b))), abs=0.03)
    rng = np.random.default_rng(0)
    marks = np.array([r / np.sqrt(r.sum()) for r in rows[:4]])
    model = langid.LanguageModel(["a", "b", "c"], np.ascontiguousarray(marks.T), rng.normal(size=(4, 3)).astype(np.float32))
    import pyarrow as pa

    names, scores = model.predict(pa.array([*texts, "", None, "12 34"]))
    for t, name, score in zip(texts, names, scores, strict=False):
        k = np.array([bits(t) @ m / np.sqrt(bits(t).sum()) for m in marks])
        f = k @ model.alpha
        assert name == model.labels[int(f.argmax())] and score == pytest.approx(np.clip(f.max(), 0, 1), abs=1e-5)
    assert names[len(texts) :] == ["und"] * 3


def test_ridge_solution_against_its_objective():
    rng = np.random.default_rng(1)
    k_xl, root = rng.random((30, 5)), rng.normal(size=(5, 5))
    k_ll, y, ridge = root @ root.T, rng.random((30, 2)), 0.1
    alpha = langid.solve(k_xl, k_ll, y, np.ones((30, 1)), ridge)
    value = lambda a: ((k_xl @ a - y) ** 2).sum() + ridge * 30 * np.trace(a.T @ k_ll @ a)
    for _ in range(20):
        assert value(alpha) <= value(alpha + 1e-3 * rng.normal(size=alpha.shape)) + 1e-9


def test_every_language_is_learned(spark):
    r = random.Random(3)
    letters = [chr(0x400 + i) for i in range(200)]
    rows = []
    for lang in range(80):
        own = r.sample(letters, 12)
        rows += [(lang * 100 + i, " ".join("".join(r.choices(own, k=5)) for _ in range(30)), f"l{lang:02}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df.filter("doc_id % 3 <> 0"))
    assert len(model.labels) == 80
    out = langid.identify(df.filter("doc_id % 3 = 0").withColumn("score", F.lit("clash")), model, id_cols=["doc_id", "lang"]).collect()
    assert sum(x.lang == x.lang_pred for x in out) / len(out) > 0.9


def test_very_long_texts_keep_their_language(spark):
    rows = duckdb.sql(f"select lang, string_agg(text, ' ' order by doc_id) from '{SMALL}/documents.parquet' where lang is not null and n_chars > 40 group by lang").fetchall()
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.learn(spark.read.parquet(f"{SMALL}/documents.parquet"))
    out = langid.identify(df, model, id_cols=["lang"]).collect()
    print([(x.lang, x.lang_pred, round(x.score, 2)) for x in out], [len(t) for _, t in rows])
    assert sum(x.lang == x.lang_pred for x in out) >= len(out) - 1


# --- quality ---


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", "x"), (None, "z" * 100000, "x")], "doc_id long, text string, expected_grade string")
    one = quality.learn(docs, spark.createDataFrame([(1, 2), (2, None)], "doc_id long, grade int"))
    assert {r.expected_grade for r in quality.grade(docs, one, id_cols=["doc_id"]).collect()} == {2.0}
    none = quality.learn(docs.limit(0), spark.createDataFrame([], "doc_id long, grade int"))
    assert {(r.expected_grade, tuple(r.tails)) for r in quality.grade(docs, none, id_cols=["doc_id"]).collect()} == {(0.0, ())}
    two = quality.learn(docs, spark.createDataFrame([(1, 0), (3, 1), (9, 1)], "doc_id long, grade int"))
    out = quality.grade(docs, two, id_cols=["doc_id"]).collect()
    assert len(out) == 5 and all(0 <= r.expected_grade <= 1 and len(r.tails) == 1 for r in out)
    assert quality.grade(docs.limit(0), two, id_cols=["doc_id"]).count() == 0
    with pytest.raises(ValueError, match="expected_grade"):
        quality.grade(docs, two, id_cols=["doc_id", "expected_grade"])


# --- SimHash ---


def test_one_bucket_of_many_chunks(spark):
    """A thousand fingerprints that share their high half, so that whole tables hold one bucket."""
    r = np.random.default_rng(4)
    fps = np.unique(r.integers(0, 2**12, 900)).tolist()
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    began = time.time()
    got = {x.node: x.root for x in simhash.connected(simhash.links(df, chunk=100)).collect()}
    assert time.time() - began < 120
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {f: got.get(f, f) for f in fps} == {f: root(f) for f in fps}


def test_rounds_leave_one_checkpoint(spark, tmp_path):
    import glob

    folder = spark.sparkContext.getCheckpointDir() or ""
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)], "src long, dst long")
    common.cut(edges)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = len(glob.glob(f"{folder}/*"))
    assert simhash.connected(edges).count() == 101
    assert len(glob.glob(f"{folder}/*")) - before <= 2


def run_plan(df):
    """What ran, with every change that adaptive execution made."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_groups_broadcast_nothing(spark, tmp_path):
    """A table of fingerprints looks small enough to broadcast; its keys are 31 times as many."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    body = r.choices(words, k=200)
    texts = [" ".join(r.choices(words, k=30)) for _ in range(200)] + [" ".join([*body[:i], "new", *body[i + 1 :]]) for i in range(100)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = common.table(spark, str(tmp_path), "documents")
    distinct = common.cut(simhash.fingerprints(docs)).select("fp").distinct()
    edges = common.cut(simhash.links(distinct))
    assert edges.count() > 50
    frames = [simhash.links(distinct), components._large_star(edges), components._small_star(edges), simhash.near_duplicates(docs)]
    assert ["Broadcast" in run_plan(df) for df in frames] == [False] * len(frames)


# --- packing and encoding ---


def test_a_document_stays_in_one_group(spark):
    import public_tokenizers

    rows = [(i, f"word{i} " * (1 + 37 * i % 3000)) for i in range(300)] + [(None, None), (7, ""), (7, "x" * 300000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit("clash"), "group": F.lit("clash")})
    out = packing.pack(df, path=public_tokenizers.path("byte_bpe_50k.json"), group=20).toPandas()
    out["group"] = out.sequence_id // 2**32
    assert out.group.nunique() > 5 and (out[out.doc_id != 7].groupby("doc_id").group.nunique() == 1).all()
    assert packing.pack(df.limit(0), path=public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_long_matches_take_linear_time_and_are_the_librarys():
    import base64

    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.load_ranks(path, public_tokenizers.PATTERN)
    with open(path, "rb") as f:
        library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}, special_tokens={})
    r = random.Random(1)
    texts = []
    for _ in range(40):
        n, letters = r.choice((513, 1000, 5000)), r.choice(("ab", "abcdefghijklmnopqrstuvwxyz", "a", "aab", "etaoin", "漢字かな", "åäö"))
        texts.append("".join(r.choices(letters, k=n)))
        texts.append((texts[-1][: r.randint(1, 12)] * n)[:n])
    assert ranks.encode_matches([t.encode() for t in texts]) == [library.encode(t) for t in texts]
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "a"):
        text = "".join(r.choices(letters, k=1_000_000)).encode()
        began = time.time()
        ids = ranks.encode_matches([text])[0]
        assert time.time() - began < 30 and ranks.decode(ids) == text


def test_encoding_of_an_empty_table(spark):
    import public_tokenizers

    df = spark.createDataFrame([], "doc_id long, text string")
    for f in (bpe.round_trip, bpe.encode):
        assert f(df, path=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN, id_cols=["doc_id"]).count() == 0


# --- pipeline ---


def test_stages_with_clashing_columns_and_no_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(120)
    odd = docs.withColumns({"score": F.lit("s"), "_score": F.lit("t"), "lang_pred": F.lit("p"), "_id": F.lit("i"), "fp": F.lit("f"), "component_id": F.lit("c"), "_key": F.lit("k"), "_keep": F.lit("k")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, odd, SMALL)
        assert kept.columns == odd.columns, name
        plain = sorted((r.doc_id, r.text) for r in stage(spark, docs, SMALL).select("doc_id", "text").collect())
        assert sorted((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()) == plain, name
        assert stage(spark, odd.limit(0), SMALL).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd.limit(0), SMALL).count() == 0
