"""SentencePiece, whitening and importance resampling."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stopwise.llm import importance, registry, sentencepieces, whitening
from tests.llm.helpers import LOWER

TEXTS = [None, "", " ", "  a", "a  b ", "\n", "▁x", "a\0b", "é😀一\U00013000", "<s>", "</s> <0x0A>", "﻿x", "a\r\nb\tc", "the quick brown fox " * 400, "x" * 20000, "一" * 5000, " " * 3000, "straße ſ ﬁ İ", "the"]


@pytest.fixture(scope="module")
def vocab():
    return sentencepieces.vocabulary()


# --- operator 11


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abthe \n▁é😀一\0<>0x") | st.characters(exclude_categories=["Cs"]), max_size=90), max_size=6))
def test_any_text_is_encoded_as_by_the_library(texts):
    vocab = sentencepieces.vocabulary()
    for text, (ids, same) in zip(texts, vocab.encode(texts)):
        assert same and ids == vocab.library.encode(text, add_eos=True)
        assert vocab.decode(ids) == vocab.library.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 400) | st.integers(0, 31999), max_size=12))
def test_any_ids_are_decoded_as_by_the_library(ids):
    vocab = sentencepieces.vocabulary()
    assert vocab.decode(ids) == vocab.library.decode(ids)


def test_lists_and_heaps_merge_alike(vocab, monkeypatch):
    rng = random.Random(3)
    words = ["▁" + "".join(rng.choices("ethionsar.▁", k=rng.randint(0, 60))) for _ in range(400)]
    short = [vocab.merged(w) for w in words]
    monkeypatch.setattr(sentencepieces, "SHORT", 0)
    assert [vocab.merged(w) for w in words] == short


def test_documents_are_encoded_whole(spark, vocab):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "null id", 1), (3, "  a", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    got = {(r.doc_id, r.decoded_sha256): r for r in sentencepieces.digests(df).collect()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for key, text, _ in rows:
        ids = vocab.library.encode(text or "", add_eos=True)
        row = got[key, sha(vocab.library.decode(ids))]
        assert (row.n_tokens, row.ids_sha256, row.matches_library) == (len(ids), sha(" ".join(map(str, ids))), True)
    assert sentencepieces.digests(df).count() == len(rows) and sentencepieces.digests(df.limit(0)).count() == 0
    whole = sentencepieces.encoded(df.filter("doc_id = 13")).first()
    assert whole.ids == vocab.library.encode(TEXTS[13], add_eos=True) and whole.decoded == TEXTS[13]


def test_bytes_that_are_no_text(spark, vocab):
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.lit(bytearray(b"a\xe2\x82b\xff")).cast("string").alias("text"))
    assert sentencepieces.encoded(df).first().ids == vocab.library.encode(b"a\xe2\x82b\xff", add_eos=True)


def test_a_wrong_segment_is_told(vocab, monkeypatch):
    monkeypatch.setattr(type(vocab), "merged", lambda self, segment: [5] if "zebra" in segment else [1])
    (_, same), (_, other) = vocab.encode(["un zebra", "un zebrafish swims"])
    assert not same and not other
    vocab.new, vocab.old = {}, {}


def test_all_documents_agree_with_the_library(spark, sf_dir, vocab):
    got = {r.doc_id: r for r in registry.op11_sentencepiece(spark, sf_dir).collect()}
    for row in registry.table(spark, sf_dir, "documents").collect():
        ids = vocab.library.encode(row.text or "", add_eos=True)
        assert got[row.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[row.doc_id].decoded_sha256 == hashlib.sha256(vocab.library.decode(ids).encode()).hexdigest()


# --- operator 12


def plain_whitening(rows, most=8):
    able = [(k, v) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in able]
    n, sums = len(x), [sum(column) for column in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    z = np.array(x, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    return [k for k, _ in able], deviation, z @ vectors / np.sqrt(values), values / np.trace(z.T @ z / n)


def compared(rows, got):
    keys, deviation, scores, shares = plain_whitening(rows)
    parts = {(r.vec_id, r.component): r for r in got}
    assert len(got) == scores.size == len(parts)
    mine = np.array([[parts[k, j + 1].whitened for j in range(scores.shape[1])] for k in keys])
    assert np.abs(mine - scores * np.sign((mine * scores).sum(axis=0))).max() < 1e-9
    assert [parts[k, 1].deviation for k in keys] == deviation
    assert max(abs(parts[keys[0], j + 1].explained - s) for j, s in enumerate(shares)) < 1e-12
    assert {r.n for r in got} == {len(keys)} and max(r.identity_error for r in got) < 1e-9


def test_whitening_of_all_embeddings(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in registry.table(spark, sf_dir, "embeddings").collect()]
    compared(rows, registry.op12_whitening(spark, sf_dir).collect())


def test_rows_that_cannot_be_whitened(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(size=3) * (4, 2, 1)]) for i in range(200)]
    odd = [(900, None), (901, [1.0, None, 2.0]), (902, [1.0, math.nan, 2.0]), (903, [1.0, math.inf, 2.0]), (904, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("scores", F.lit(1)).repartition(3)
    compared(rows, whitening.whitened(df).collect())
    # Another length, and repeated and null ids.
    more = whitening.whitened(df.unionByName(spark.createDataFrame([(905, [1.0], 1), (None, [0.5, 0.5, 0.5], 1), (1, [0.5, 0.5, 0.5], 1)], df.schema))).collect()
    assert {r.n for r in more} == {202} and len(more) == 3 * 202


def test_little_to_whiten(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], schema)).count() == 0
    line = whitening.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], schema)).collect()
    assert {r.component for r in line} == {1} and line[0].explained == pytest.approx(1)


def test_sums_do_not_depend_on_how_rows_are_dealt(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, [float(c) for c in rng.normal(size=5)]) for i in range(999)], "vec_id long, embedding array<double>")
    runs = [whitening.fitted(df.repartition(n)) for n in (1, 5)]
    assert runs[0][:2] == runs[1][:2] and (runs[0][2] == runs[1][2]).all()
    large = np.array([[2**40, 3], [5, -(2**40)]], np.int64)
    assert (whitening.exact_products(large) == large.astype(object).T @ large.astype(object)).all()


@pytest.mark.parametrize("values", [[9, 5, 5, 5, 1, 0, 0], [3] * 12, [10, 10 - 1e-9, 10 - 2e-9, 1, 1e-3], [1e12, 1, 1e-6], list(range(40)), [7]])
def test_spectra(values):
    """Close, equal and far eigenvalues: values, vectors and numbers against a dense solver."""
    rng = np.random.default_rng(len(values))
    q, _ = np.linalg.qr(rng.normal(size=(len(values),) * 2))
    matrix = q @ np.diag(values) @ q.T
    matrix = (matrix + matrix.T) / 2
    slicer = whitening.Slicer(matrix)
    found, vectors = slicer.leading(8)
    want = np.sort(np.linalg.eigvalsh(matrix))[::-1][: len(found)]
    assert len(found) == min(8, sum(v > 1e-10 * max(values) for v in values)) or values[0] == 1e12
    assert np.abs(found - want).max() <= 1e-13 * max(values)
    assert np.abs(vectors @ vectors.T - np.eye(len(found))).max() < 1e-12
    assert np.abs(matrix @ vectors.T - vectors.T * found).max() <= 1e-12 * max(values)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 7), st.integers(0, 10**6))
def test_inertia(size, seed):
    a = np.random.default_rng(seed).integers(-2, 3, (size, size))
    a = (a + a.T).astype(float)
    values = np.linalg.eigvalsh(a)
    if np.abs(values).min() > 1e-9:
        assert whitening.inertia(a) == (values < 0).sum()


# --- operator 13

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_resampling(docs, target, order, buckets, least, percent, seed=2024):
    def feats(text):
        words = WORD.findall((text or "").translate(LOWER))
        return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, order + 1) for i in range(len(words) - n + 1)]

    s, t = ([0] * buckets for _ in range(2))
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in feats(text)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out, able = [], []
    for key, text in docs:
        words, found = feats(text)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(found), weight, score, None])
        if len(words) >= least:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    for place, row in enumerate(able[: percent * len(able) // 100]):
        row[4] = place + 1
    return out


def resampled(spark, docs, target, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"weight": F.lit(1), "_place": F.lit("x")}).repartition(3)
    rows = importance.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"), **options)
    return rows.select("doc_id", "n_features", "weight", "score", "rank").collect()


@pytest.mark.parametrize("order, buckets", [(1, 10_000), (3, 50)])
def test_resampling(spark, order, buckets):
    rng = random.Random(order)
    words = ["Alpha", "beta", "GAMMA", "d3lta", "Éclair", "straße", "東京", "x_y", "it's", "\x7f", " ", "İ"]
    docs = [(i, None if i % 17 == 0 else " ".join(rng.choices(words, k=rng.randint(0, 40))) + rng.choice(["", "\n", "."])) for i in range(150)]
    docs += [(None, "alpha " * 30), (None, "beta " * 30), (5, "gamma " * 25), (5, "gamma " * 25), (700, "beta gamma " * 4000)]
    target = ["alpha beta gamma", None, "", "d3lta d3lta alpha"]
    got = resampled(spark, docs, target, order=order, buckets=buckets, least_words=20, percent=30)
    want = plain_resampling(docs, target, order, buckets, 20, 30)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_words_of_two_texts_make_no_ngram(monkeypatch):
    texts = ["a b", "c", "", "d e f"]
    for size in (1, 3, 1 << 20):
        monkeypatch.setattr(importance, "SLICE", size)
        found = []
        data = [t.encode() for t in texts]
        for start, end in importance.slices(data):
            owner, bucket, _ = importance.features(data[start:end], 2, 1 << 32)
            found += [(start + o, b) for o, b in zip(owner.tolist(), bucket.tolist())]
        want = [(i, zlib.crc32(g.encode())) for i, t in enumerate(texts) for g in [*t.split(), *map(" ".join, zip(t.split(), t.split()[1:]))]]
        assert sorted(found) == sorted(want)


def test_resampling_of_nothing(spark):
    assert resampled(spark, [], ["alpha"]) == []
    rows = resampled(spark, [(i, "one two three " * 10) for i in range(20)], [])
    assert sorted(r["rank"] for r in rows if r["rank"]) == [1, 2] and all(r.n_features == 30 for r in rows)
    assert all(r["rank"] is None and r.weight == 0 for r in resampled(spark, [(1, ""), (2, None)], ["x"]))
