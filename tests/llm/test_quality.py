"""Operator 12: parts against plain Python, and held-out labels."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textbench.llm import quality as Q

LABELS = "doc_id long, quality int, toxic int"


def plain_tokens(text):
    return re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\x20\x09-\x0d]+", text or "")


def buckets_of(words, n):
    tokens, out = Q.Tokens(), {}
    for w in set(words):
        raw = w.encode()
        h, _ = tokens.scan(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert len(h) == 1
        out[w] = int(h[0] % np.uint64(n))
    return out


def brute_vectors(texts, n):
    place, sign = Q.index_vectors(n)
    table, seen = np.zeros((n, Q.DIM)), np.zeros(n)
    for text in texts:
        words = plain_tokens(text)
        at = buckets_of(words, n)
        ids = [at[w] for w in words]
        for i, b in enumerate(ids):
            seen[b] += 1
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                for p, s in zip(place[ids[j]], sign[ids[j]]):
                    table[b, p] += s
    mean = table.sum(axis=0) / max(1, seen.sum())
    out = np.array([t / k - mean if k else np.zeros(Q.DIM) for t, k in zip(table, seen)])
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


TEXTS = ["Hello, world!! Hello", "", None, "  \n\t ", "a", "é ü*** ñandú|x 12ab", "one two three four five " * 40, "same same same"]


def test_tokens_of_long_texts_are_those_of_short_ones(monkeypatch):
    monkeypatch.setattr(Q, "CHUNK", 64)
    tokens = Q.Tokens()
    for text in [*TEXTS, "long" * 100 + " end", "x" * 500, "a b " * 300]:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        h, row = tokens.scan(raw, np.array([0, len(raw)]))
        at = buckets_of(plain_tokens(text), 1 << 30)
        assert [int(x % np.uint64(1 << 30)) for x in h] == [at[w] for w in plain_tokens(text)] and (row == 0).all()


def test_word_vectors_equal_plain_counting(spark, monkeypatch):
    monkeypatch.setattr(Q, "SPAN", 7)
    df = spark.createDataFrame([(t,) for t in TEXTS * 3], "text string").repartition(4)
    got = Q.word_vectors(df, 256)
    assert np.allclose(got, brute_vectors(TEXTS * 3, 256), atol=1e-5)


def test_pooling_equals_plain_means(monkeypatch):
    monkeypatch.setattr(Q, "ROWS", 5)
    vectors = np.random.default_rng(1).normal(size=(64, Q.DIM)).astype(np.float32)
    x, size = Q.pooled(pa.array(TEXTS), Q.Tokens(), vectors)
    for text, row, n in zip(TEXTS, x, size):
        words = plain_tokens(text)
        at = buckets_of(words, 64)
        v = np.array([vectors[at[w]] for w in words], float).reshape(-1, Q.DIM)
        mean = v.mean(axis=0) if len(v) else np.zeros(Q.DIM)
        near = (v[1:] * v[:-1]).mean(axis=0) if len(v) > 1 else np.zeros(Q.DIM)
        assert n == len(words) and np.allclose(row, np.concatenate((mean, near)), atol=1e-4)


def test_temperature_mends_overconfidence():
    rng = np.random.default_rng(0)
    z = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-z))).astype(float)
    assert abs(Q.temperature(3 * z, y, np.ones_like(y)) - 3) < 0.3
    assert abs(Q.temperature(z / 2, y, np.ones_like(y)) - 0.5) < 0.05


def test_network_learns_what_no_linear_score_can():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    net = Q.fit_network(x, y, np.ones(len(y)), steps=800)
    assert (((Q._logit(net, x) > 0) == (y > 0)).mean()) > 0.95


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def scored(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    return Q.score_quality(docs, labels, keep=["doc_id"]).cache(), labels


def test_held_out_labels(scored):
    out, labels = scored
    rows = out.join(labels, "doc_id").collect()
    assert all(r["held_out"] == held(r["doc_id"]) for r in rows)
    good = [r["predicted"] for r in rows if r["held_out"] and r["quality"] == 1]
    bad = [r["predicted"] for r in rows if r["held_out"] and r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad) and len(bad) > 50
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_scores_of_held_out_rows_are_calibrated(scored):
    out, labels = scored
    rows = [r for r in out.join(labels, "doc_id").collect() if r["held_out"]]
    assert abs(np.mean([r["score"] - r["quality"] for r in rows])) < 0.03


def small(spark, flip=False):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    rows = []
    for i in range(400):
        text = " ".join(word() for _ in range(40)) if i % 4 else " ".join(f"{word()}***" for _ in range(40))
        rows.append((i, text, "xx" if i % 2 else "yy", f"s{i % 3}", i))
    labels = [(i, int(i % 4 > 0) if not (flip and held(i)) else 1 - int(i % 4 > 0), 0) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, LABELS)


def scores(df):
    return {r["doc_id"]: r["score"] for r in df.collect()}


def test_held_out_labels_and_other_columns_are_never_inputs(spark):
    docs, labels = small(spark)
    want = scores(Q.score_quality(docs, labels, buckets=1024))
    assert scores(Q.score_quality(docs, small(spark, flip=True)[1], buckets=1024)) == want
    other = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("q")).withColumn("n_chars", F.lit(0))
    assert scores(Q.score_quality(other, labels, buckets=1024)) == want
    assert np.mean([(want[i] >= 0.5) == (i % 4 > 0) for i in want if held(i)]) > 0.95


def test_nulls_repeats_clashes_and_long_texts(spark):
    docs, labels = small(spark)
    extra = spark.createDataFrame([(None, None), (1000, ""), (1001, None), (1002, "abcd*** " * 400_000), (5, "again"), (1003, " \n")], "doc_id long, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True).withColumn("Score", F.lit("mine")).withColumn("held_out", F.lit(7)).withColumn("v", F.lit(1))
    bad = spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 7, 0), (4, 0, 0), (4, 1, 0)], LABELS)
    out = Q.score_quality(docs, labels.unionByName(bad), buckets=1024)
    assert [c for c in out.columns if c.lower() == "score"] == ["score"] and "v" in out.columns
    rows = out.collect()
    assert len(rows) == 406
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[1000] == by[1001] == by[1003] == by[None] and 0.6 < by[1000] < 0.9  # the share of label 1
    assert by[1002] < 0.3


def test_empty_tables_and_one_class(spark):
    docs, labels = small(spark)
    assert Q.score_quality(docs.limit(0), labels, buckets=1024).count() == 0
    assert set(scores(Q.score_quality(docs, labels.limit(0), buckets=1024)).values()) == {0.5}
    one = scores(Q.score_quality(docs, labels.where("quality = 1"), buckets=1024))
    assert len(set(one.values())) == 1 and 0.9 < next(iter(one.values())) < 1
