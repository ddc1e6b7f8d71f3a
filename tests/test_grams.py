"""The n-gram kernel against plain counting."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textbench.functions import grams
from textbench.functions.grams import batch_stats
from textbench.functions.text import replaced_13a, spaced_13a, tokens_13a
from textbench.operators.bleu import STAT_COLS, bleu_prefix_stats, bleu_row_stats, pair_text_stats


def brute(h, r):
    out = [len(h), len(r)]
    count = lambda t, n: Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1))
    out += [sum((count(h, n) & count(r, n)).values()) for n in range(1, 5)]
    return out + [max(len(h) - n + 1, 0) for n in range(1, 5)]


def texts(seed, rows):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice("a b c dd eé f. x".split()) for _ in range(rnd.choice([0, 1, 2, 3, 5, 30, 200]))) for _ in range(rows)]


@pytest.mark.parametrize("size", [1, 40, 1000, 1 << 20])
def test_whole_texts(monkeypatch, size):
    monkeypatch.setattr(grams, "SLICE", size)
    h, r = texts(1, 80), texts(2, 80)
    h[3], r[4], h[5], r[5] = "  a   b ", " ", "", ""
    got = batch_stats(pa.array(h), pa.array(r), 0x20)
    assert got.tolist() == [brute(x.split(), y.split()) for x, y in zip(h, r)]


def test_texts_end_where_they_end_and_sliced_batches():
    h, r = ["ab", "ab", "a", "b", "ab"], ["abab", "ab", "ab", "", "ab"]
    assert batch_stats(pa.array(h), pa.array(r), 0x20).tolist() == [brute(x.split(), y.split()) for x, y in zip(h, r)]
    part = batch_stats(pa.array(h).slice(2), pa.array(r).slice(2), 0x20)
    assert part.tolist() == [brute(x.split(), y.split()) for x, y in zip(h[2:], r[2:])]
    assert batch_stats(pa.array([], pa.string()), pa.array([], pa.string()), 0x20).shape == (0, 10)


@pytest.mark.parametrize("size", [1, 200, 1 << 20])
def test_prefixes_in_one_walk(monkeypatch, size):
    monkeypatch.setattr(grams, "SLICE", size)
    rnd = random.Random(9)
    words = [[[rnd.choice("abcd") for _ in range(rnd.choice([0, 1, 2, 3]))] for _ in range(rnd.choice([0, 1, 5, 40]))] for _ in range(60)]
    ref = texts(3, 60)
    hyp = [" \x01 ".join(" ".join(w) for w in ws) for ws in words]
    got = batch_stats(pa.array(hyp), pa.array(ref), 0x20, [1, 4, 16])
    for ws, r, row in zip(words, ref, got.tolist()):
        want = []
        for b in (1, 4, 16):
            want += brute([t for w in ws[:b] for t in w], r.split())
        assert row == want


def test_prefix_statistics_equal_those_of_cut_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    df = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("reference"), F.concat(F.lit("Well, 3.5-4 <skipped> &amp; "), F.reverse(
        F.substring("text", 5, 900)), F.lit(" \x01 end-\nof.")).alias("prediction"))
    got = {r["id"]: r for r in bleu_prefix_stats(df, [1, 3, 64, 10**6]).collect()}
    from textbench.functions.text import words

    for b in (1, 3, 64, 10**6):
        cut = df.withColumn("prediction", F.array_join(F.slice(words(F.replace("prediction", F.lit("\x01"), F.lit(" "))), 1, b), " "))
        for r in bleu_row_stats(cut).collect():
            assert [r[c] for c in STAT_COLS] == [got[r["id"]][f"b{b}_{c}"] for c in STAT_COLS]


def test_tokens_of_the_kernel_are_the_13a_tokens(spark):
    rows = [(1, "Hello, world! It's 3.5-4%   ok .x", "Hello\tworld"), (2, None, "a"), (3, "", None), (4, "a-\nb &quot;c&quot;", "ab \"c\"")]
    df = spark.createDataFrame(rows, "id long, prediction string, reference string")
    want = df.select("id", F.greatest(F.size(tokens_13a("prediction")), F.lit(0)).alias("n"), F.greatest(F.size(tokens_13a("reference")), F.lit(0)).alias("m"))
    got = {r["id"]: (r["sys_len"], r["ref_len"]) for r in bleu_row_stats(df).collect()}
    assert got == {r["id"]: (r["n"], r["m"]) for r in want.collect()} and got[2] == (0, 1) and got[3] == (0, 0)


def test_cuts_of_the_kernel_are_those_of_the_13a_expressions(spark):
    rnd = random.Random(5)
    signs = list("aZ09.,.,--/'$%&(){}[]`~@^_ \t\n\r\x0b\x1c") + ["é", "漢", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\u1680", "\u200b", "&lt;", "-\n", "<skipped>", "12", "😀"]
    rows = [(i, "".join(rnd.choice(signs[:12] if i % 3 else signs) for _ in range(rnd.choice([0, 1, 2, 3, 8, 60])))) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, t string")
    got = df.select("id", replaced_13a("t").alias("t"), spaced_13a("t").alias("s")).orderBy("id").toPandas()

    def tokens(texts, separator):
        data, offsets = grams._buffers(pa.array(texts, pa.string()))
        t = grams.Tokenised(data, offsets, separator)
        return t.row.tolist(), t.h.tolist()

    assert tokens(got["t"], None) == tokens(got["s"], 0x20)
    # the kernel cuts the texts: no regular expression walks all of them
    plan = bleu_row_stats(df, hyp_col="t", ref_col="t")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "$1 $2" not in plan


def test_a_tokenizer_of_the_caller(spark):
    df = spark.createDataFrame([(1, "a b|c d", "c d|a b|a b")], "id long, prediction string, reference string")
    r = bleu_row_stats(df, tokenizer=lambda c: F.split(c, "\\|")).first()
    assert [r[c] for c in STAT_COLS] == brute(["a b", "c d"], ["c d", "a b", "a b"])


def test_a_very_long_text_and_distinct_large_numbers():
    rnd = np.random.default_rng(0)
    h = " ".join(map(str, rnd.integers(0, 500, 300_000)))
    r = " ".join(map(str, rnd.integers(0, 500, 200_000)))
    got = batch_stats(pa.array(["x", h]), pa.array(["x", r]), 0x20)
    assert got[1].tolist() == brute(h.split(), r.split())


def test_length_f1_and_statistics_of_one_pass_equal_the_expressions(spark):
    from textbench.functions.text import token_length
    from textbench.operators.metrics import token_f1_col

    rnd = random.Random(11)
    signs = (list("aZ09_.,-/'$%&(){}[]^ \t\n\r\x0b\x0c\x00\x1c\x1e\x7f") + [chr(c) for c in range(0x80, 0x250)]
             + ["-\n", "<skipped>", "&quot;", "&amp;lt;", "&gt;", "-<skipped>\n", "a ", "b ", "12 "])
    beyond = signs + ["漢", "\u2003", "\u2028", "\u3000", "\u1680", "\u200b", "😀", "и", "\u0301", "٣"]

    def text(i):
        if i % 17 == 0:
            return None if i % 2 else rnd.choice(["", " \n", "\xa0"])
        pool = (signs[:24] + ["a ", "b "], signs, beyond)[i % 3]
        out = "".join(rnd.choice(pool) for _ in range(rnd.choice([1, 2, 3, 8, 60])))
        out += chr(rnd.randrange(0x250)) if i % 3 < 2 else ""
        return out.replace("\x1f", "")  # which separates the tokens of a caller's tokenizer

    rows = [(i, text(rnd.randrange(10**6)), text(rnd.randrange(10**6)), i % 3) for i in range(4000)]
    rows = [(i, p if i % 4 else r, r, k) for i, p, r, k in rows]
    df = spark.createDataFrame(rows, "id long, prediction string, reference string, kind int").repartition(4).persist()
    got = {r["id"]: r for r in pair_text_stats(df, keep=["kind"]).collect()}
    want = bleu_row_stats(df.select("*", token_length("reference").alias("length"), token_f1_col("prediction", "reference").alias("f1")),
                          tokenizer=lambda c: tokens_13a(c), keep=["kind", "length", "f1"])
    assert pair_text_stats(df, keep=["kind"]).schema == want.schema
    assert len(got) == 4000
    for r in want.collect():
        assert got[r["id"]] == r


def test_pair_statistics_split_and_search_no_text_in_expressions(spark):
    from textbench.plans.q_metrics import pair_stats
    from textbench.plans.q_reports import exp_stats

    for stats in (pair_stats, exp_stats):
        plan = stats(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "array_intersect" not in plan and "<skipped>" not in plan
        assert plan.count("split(") == 1  # of the view that makes the predictions
