"""The ten operators against brute force, exact round trips and held-out accuracy on small fixtures."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import bpe, exact_topk, html_crf, langid, packing, permutation_index, quality, queries, secrets, simhash, toxicity
from ledgerline.llm.components import connected

HOSTILE = [None, "", " ", "a", "\n\t", "x" * 50_000, "same text here now", "same text here now", "😀 é İ ſ", "token = abcdef123"]


def docs_of(spark, texts, extra=True):
    rows = [(i, t, "en" if i % 3 else None, "s", len(t or ""), "clash") for i, t in enumerate(texts)] + [(None, "null id text", None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id string")
    return df if extra else df.drop("_id")


def test_secret_base_spans():
    key = "0123456789abcdef01234567"
    spans = secrets.scan_text(f'PassWord: "hunter22" é AKIA{"A1" * 8} {key} token=abc')[0]
    assert spans == [("assign", 0, 19), ("access", 23, 43), ("hex", 44, 68)]
    assert secrets.scan_text("token:token:abcdefgh")[0] == []  # the failing match takes its text
    assert secrets.scan_text(None) == ([], [], [])


def test_secret_battery_finds_random_and_leaves_words():
    r = random.Random(3)
    alphabet = dict(secrets.ENCODINGS)["base62"]
    random_keys = ["".join(r.choices(alphabet, k=40)) for _ in range(50)]
    words = ["ThisIsAnOrdinaryCamelCaseName", "some_snake_case_name_of_words", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "12345678901234567890", "OrderNumber20240131OfTheYear2024"]
    assert sum(bool((s := secrets.surprise(k)) and s[1] > 10) for k in random_keys) >= 45
    assert not any((s := secrets.surprise(w)) and s[1] > 10 for w in words)


def test_secret_scan_and_redaction(spark):
    df = docs_of(spark, HOSTILE)
    out = {r.doc_id: r for r in secrets.scan_secrets(df).collect()}
    assert len(out) == len(HOSTILE) + 1 and [tuple(s) for s in out[9].spans] == [("assign", 0, 17)]
    clean = {r.doc_id: r for r in secrets.redact(df, chars_col="n_chars").collect()}
    assert clean[9].text == "[secret]" and clean[9].n_chars == 8 and clean[0].text is None and clean[5].text == HOSTILE[5]
    assert secrets.scan_secrets(df.limit(0)).count() == 0


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components_by_brute_force(rows):
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in rows:
        for j, b in rows:
            if i < j and (a ^ b).bit_count() <= 4:
                a_, b_ = sorted((root(i), root(j)))
                parent[b_] = a_
    return {i: root(i) for i in parent}


def test_covering_masks_cover_every_difference():
    masks = [m & (2**64 - 1) for m in simhash.covering_masks(4)]
    assert len(masks) == 31
    r = random.Random(1)
    for _ in range(3000):
        diff = sum(1 << b for b in r.sample(range(64), r.randint(1, 4)))
        assert any(m & diff == 0 for m in masks)


@pytest.mark.parametrize("chunk", [2, 4096])
def test_near_duplicates_against_brute_force(spark, chunk):
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [t for t in HOSTILE if t is None or len(t) < 1000]
    for _ in range(12):
        body = r.choices(words, k=120)
        texts.append(" ".join(body))
        for _ in range(6):
            body[r.randrange(120)] = r.choice(words)
            texts.append(" ".join(body))
    df = docs_of(spark, texts).filter("doc_id is not null")
    rows = [(i, slow_fingerprint(t)) for i, t in enumerate(texts)]
    got = {x.doc_id: (x.fp & (2**64 - 1), x.component_id) for x in simhash.near_duplicates(df, chunk=chunk).collect()}
    want = components_by_brute_force(rows)
    assert got == {i: (f, want[i]) for i, f in rows}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "src long, dst long")
    assert {r.node: r.root for r in connected(edges).collect()} == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_toxicity(spark):
    r = random.Random(2)
    plain = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    texts, labels = [], []
    for i in range(300):
        w = r.choices(plain, k=40)
        if i % 4 == 0:
            w[r.randrange(40)] = r.choice(["vilezor", "grubnak"])
        elif i % 4 == 1:
            w[5:7] = ["not", "vilezor"]  # an exception phrase
        texts.append(" ".join(w))
        labels.append((i, int(i % 4 == 0)))
    docs = docs_of(spark, texts)
    lexicon = toxicity.learn(docs, spark.createDataFrame(labels + [(None, 1)], "doc_id long, toxic int"), odds=1.0)
    automaton = lexicon.automaton()
    score = lambda t: lexicon.score(t, automaton)
    assert score("a fine grubnak day") > 0.3 > score("a fine day")
    assert score("a fine gru6nak day".replace("6", "8")) > 0.3  # digit substitution
    assert score("a fine grubnаk day") > 0.3  # a Cyrillic letter
    assert score("they are not vilezor at all") < 0.3
    assert score(None) == score("") < 0.3 and score("megagrubnakish") < 0.3
    out = toxicity.score(docs, lexicon, id_cols=["doc_id"]).collect()
    assert len(out) == 301 and all(0 <= x.score <= 1 for x in out)
    none = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.words == {} and none.score("x", none.automaton()) == pytest.approx(0.5)


def test_language_held_out_accuracy(spark):
    small = "/root/testdata/sf0.01"
    out = queries.op7_language_id(spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert out.filter("lang = lang_pred").count() / out.count() > 0.97


def test_language_edges(spark):
    docs = docs_of(spark, HOSTILE)
    model = langid.learn(docs)
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model, id_cols=["doc_id"]).collect()}
    assert out[0] == out[1] == out[4] == ("und", 0.0) and out[3][0] == "en"
    none = langid.learn(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, none, id_cols=["doc_id"]).collect()} == {"und"}


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 20)).astype(np.float32)
    z = x @ np.linspace(-1, 1, 20)
    model = quality.fit(x, np.digitize(z + rng.logistic(size=1500) * 0.3, [-1, 0.5, 2]))
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 3
    tails = model.tails(x)
    assert (np.diff(tails, axis=1) <= 1e-12).all()
    assert np.corrcoef(model.expected(tails), z)[0, 1] > 0.9


def test_quality_query(spark):
    small = "/root/testdata/sf0.01"
    out = queries.op4_quality(spark, small).join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").filter("held_out")
    assert out.filter(F.col("selected") == (F.col("quality") == 1)).count() / out.count() > 0.95


def test_exact_topk_against_brute_force(spark):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(size=24).tolist()) for i in range(300)] + [(300, [0.5] * 24), (301, [0.5] * 24), (302, None), (303, [float("nan")] * 24), (304, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in exact_topk.exact_topk(df, df.filter("vec_id % 20 = 0"), k=7).collect()}
    x = {i: np.floor(64 * np.array(v)).astype(int) for i, v in data if v and not np.isnan(v).any()}
    want = {}
    for q in (i for i in x if i % 20 == 0):
        order = sorted((-int(x[q] @ x[c]), c) for c in x if c != q)[:7]
        want |= {(q, k + 1): (c, -s) for k, (s, c) in enumerate(order)}
    assert got == want


def test_permutation_index_recall(spark):
    small = "/root/testdata/sf0.01"
    out = queries.op6_permutation_index(spark, small).toPandas()
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, part in out.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        hits += len(set(ids[np.argsort(-s)[:5]]) & set(part.vec_id))
        assert part.sort_values("rank").score.is_monotonic_decreasing
    assert hits / len(out) >= 0.9


def test_permutation_index_edges(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (50, [2.0, 0.1])], "vec_id long, embedding array<double>")
    out = permutation_index.nearest(df, df.filter("vec_id % 50 = 0"), k=5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in out) == [(0, 1, 1), (0, 2, 50), (50, 1, 0), (50, 2, 1)]
    assert permutation_index.nearest(df.limit(0), df.limit(0), k=5).count() == 0


def test_html_on_held_out_pages():
    import re

    model, right, wrong = html_crf.default_model(), 0, 0
    for page, main in html_crf.training_pages(150, seed=1234):
        found = html_crf.blocks(page)
        for b, y in zip(found, model.decode(found), strict=True):
            if bool(y) == any(k in main for k in re.findall(r"k(\d+)", b[0])):
                right += 1
            else:
                wrong += 1
    assert right / (right + wrong) > 0.97


def test_html_edges(spark):
    page = "<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>Title &amp; more</h1><p>One\n two<br>three<p>Four.</p><script>var t='</p>'</script></article><footer>&copy; me</footer>"
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "<p>cut off <b")], "page_id long, url string, html string")
    out = {r.page_id: (r.text, r.n_chars) for r in html_crf.extract(df, id_cols=["page_id", "url"]).collect()}
    assert out[1][0] == "Title & more\nOne two three\nFour." and out[1][1] == len(out[1][0]) and out[2] == out[3] == ("", 0)


def test_first_fit_decreasing_against_a_plain_one():
    r = np.random.default_rng(0)
    sizes = r.integers(1, 1025, 500)
    bins, offsets = packing.first_fit_decreasing(sizes, 1024)
    free, want = [], np.zeros(500, int)
    for i in np.argsort(-sizes, kind="stable"):
        b = next((j for j, f in enumerate(free) if f >= sizes[i]), len(free))
        free += [1024] * (b == len(free))
        want[i] = b
        free[b] -= sizes[i]
    assert (bins == want).all()
    for b in range(bins.max() + 1):
        at = np.argsort(offsets[bins == b])
        assert (np.cumsum(np.append(0, sizes[bins == b][at]))[:-1] == offsets[bins == b][at]).all()


def test_packing_keeps_every_id(spark):
    import zlib

    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [*HOSTILE, "lorem ipsum " * 3000, "<|endoftext|> is text", "a  b \n c"]
    out = packing.pack(docs_of(spark, texts), path=path).toPandas()
    lib = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        part = out[out.doc_id == i].sort_values("start")
        assert list(part.start) == [0, *part.length.cumsum()[:-1]] and part.length.sum() == len(ids) == part.doc_tokens.iloc[0]
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(part.start, part.length, strict=True)] == list(part.ids_crc32)
    assert out.groupby("sequence_id").length.sum().max() <= 1024 and out.doc_id.isna().sum() == 1


def test_bpe_against_the_library(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    texts = [*HOSTILE, *("".join(r.choices("ab 'st\n\t é日12.-  ", k=r.randint(0, 60))) for _ in range(400))]
    df = docs_of(spark, texts)
    out = {x.doc_id: x for x in bpe.round_trip(df, path=path, pattern=public_tokenizers.PATTERN, id_cols=["doc_id"]).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode_ordinary(t or "")
        assert out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    ids = bpe.encode(df, path=path, pattern=public_tokenizers.PATTERN, id_cols=["doc_id"])
    back = {x.doc_id: bytes(x.data) for x in bpe.decode(ids, path=path, pattern=public_tokenizers.PATTERN, id_cols=["doc_id"]).collect()}
    assert back[8] == HOSTILE[8].encode()


def test_pipeline_stages_against_their_inputs(spark):
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), docs.schema)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before) and docs.count() == len(after)
        if name == "near_duplicates":
            want = components_by_brute_force([(i, slow_fingerprint(t)) for i, t in before.items()])
            assert set(after) == set(want.values())
        if name == "secrets":
            assert set(after) == set(before) and not any(secrets.scan_text(t)[0] for t in after.values())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}
    whole = corpus_pipeline.run(spark, small)
    assert whole.count() == pieces.count()
