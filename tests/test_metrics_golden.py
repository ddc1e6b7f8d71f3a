"""Hand-computed goldens for BLEU, token F1 and exact match."""

import math

import pytest
from pyspark.sql import functions as F

from textbench.operators.bleu import bleu_from_sums, bleu_row_stats, bleu_sums, corpus_bleu
from textbench.operators.metrics import exact_match, selection_report, token_f1


def _bleu(spark, pairs):
    df = spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(pairs)], "id long, prediction string, reference string")
    return corpus_bleu(df).first()["bleu"]


def test_bleu_identical_is_100(spark):
    assert _bleu(spark, [("the cat sat on the mat", "the cat sat on the mat")]) == pytest.approx(100.0)


def test_bleu_exp_smoothing_by_hand(spark):
    # p1 = 3/4, p2 = 1/3, p3 = 0/2 -> 100/(2*2), p4 = 0/1 -> 100/(4*1); BP = 1
    # (75 * 33.33 * 25 * 25) ** 0.25 = sqrt(1250)
    assert _bleu(spark, [("a b c d", "a b x d")]) == pytest.approx(math.sqrt(1250.0), rel=1e-12)


def test_bleu_zero_when_an_order_has_no_ngrams(spark):
    # hypothesis of 2 tokens has no 3-grams -> score 0 (no effective order)
    assert _bleu(spark, [("a b", "a b c d")]) == 0.0


def test_bleu_no_match_is_zero(spark):
    assert _bleu(spark, [("x y z w", "a b c d")]) == 0.0


def test_bleu_brevity_penalty(spark):
    assert _bleu(spark, [("a b c d", "a b c d e")]) == pytest.approx(100.0 * math.exp(1 - 5 / 4), rel=1e-12)


def test_bleu_corpus_sums_statistics(spark):
    # corpus: sum stats of the two segments above: m=(3+4, 1+3, 0+2, 0+1), t=(4+4, 3+3, 2+2, 1+1)
    val = _bleu(spark, [("a b c d", "a b x d"), ("a b c d", "a b c d e")])
    p = [100 * 7 / 8, 100 * 4 / 6, 100 * 2 / 4, 100 * 1 / 2]
    bp = math.exp(1 - 9 / 8)
    assert val == pytest.approx(bp * math.exp(sum(math.log(x) for x in p) / 4), rel=1e-12)


def test_13a_tokenisation_splits_punctuation(spark):
    df = spark.createDataFrame([(0, "Hello, world.", "Hello , world .")], "id long, prediction string, reference string")
    st = bleu_row_stats(df).first()
    assert st["sys_len"] == 4 and st["ref_len"] == 4 and st["m4"] == 1


def test_bleu_row_stats_keeps_columns(spark):
    df = spark.createDataFrame([(0, "a b", "a b", "m0"), (1, "", "a", "m1")],
                               "id long, prediction string, reference string, model string")
    rows = {r["id"]: r for r in bleu_row_stats(df, keep=["model"]).collect()}
    assert rows[0]["model"] == "m0" and rows[1]["model"] == "m1"
    assert rows[1]["sys_len"] == 0 and rows[1]["ref_len"] == 1


def test_token_f1_uses_sets_and_empty_is_zero(spark):
    df = spark.createDataFrame([("a a b", "a c"), ("", "a"), ("x", "")], "prediction string, reference string")
    from textbench.operators.metrics import token_f1_col

    vals = [r[0] for r in df.select(token_f1_col("prediction", "reference")).collect()]
    assert vals == [0.5, 0.0, 0.0]


def test_token_f1_empty_table_is_null(spark):
    df = spark.createDataFrame([], "prediction string, reference string")
    assert token_f1(df).first()["token_f1"] is None


def test_exact_match_subsets_and_empty_subset(spark):
    df = spark.createDataFrame([(" a  b ", "a b", False), ("x", "y", False)],
                               "prediction string, reference string, is_refusal boolean")
    r = exact_match(df).first()
    assert (r["samples"], r["positive_samples"], r["refusal_samples"]) == (2, 2, 0)
    assert r["exact_match"] == 0.5 and r["refusal_accuracy"] == 0.0
    s = selection_report(df).first()
    assert s["positive_exact_match"] == 0.5


def test_bootstrap_methods_agree_on_point_and_roughly_on_width(spark):
    from textbench.operators.bootstrap import bootstrap_ci

    rows = [(i, (i % 10) / 10.0) for i in range(3000)]
    st = spark.createDataFrame(rows, "id long, f1 double")
    got = {m: bootstrap_ci(st, "f1", n_boot=200, method=m, blocks=256).first() for m in ("poisson", "blocks", "multinomial", "exact")}
    for r in got.values():
        assert r["f1"] == pytest.approx(0.45)
        assert r["f1_ci_lower"] < 0.45 < r["f1_ci_upper"]
    widths = [r["f1_ci_upper"] - r["f1_ci_lower"] for r in got.values()]
    assert max(widths) < 2.0 * min(widths)


@pytest.mark.parametrize("text,n", [("über", 1), ("el niño, aquí", 4), ("l'été déjà!", 5), ("Straße_1 ist naß", 3), ("漢字 x", 2), ("", 0)])
def test_tokens_of_accented_words(spark, text, n):
    from textbench.functions.text import regex_tokens, token_length

    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(token_length("t")).first()[0] == n
    assert len(df.select(regex_tokens("t")).first()[0]) == n


def test_predictions_use_whole_texts(spark):
    from textbench.plans.fixtures import pairs

    p = pairs(spark, "/root/testdata/sf0.001").where("id % 4 <> 0 AND id % 14 <> 0 AND id % 7 <> 0")
    rows = p.select("reference", "prediction").collect()
    assert all(abs(len(r["prediction"].split()) - 0.8 * len(r["reference"].split())) <= 1 for r in rows)
    assert max(len(r["prediction"].split()) for r in rows) > 128


def test_caller_defined_bootstrap_metric(spark):
    from textbench.operators.bootstrap import bootstrap_ci
    from textbench.operators.metric import Metric

    df = spark.range(400).select("id", (F.col("id") % 10).cast("double").alias("x"), F.lit(2.0).alias("y"))
    ratio = Metric("ratio", ("x", "y"), lambda s: s["x"] / s["y"])
    r = bootstrap_ci(df, ratio, n_boot=100, method="blocks", blocks=32).first()
    assert r["ratio"] == pytest.approx(2.25) and r["ratio_ci_lower"] < 2.25 < r["ratio_ci_upper"]


def test_poisson_sums_are_those_of_the_weights_one_by_one(spark):
    import random

    from textbench.operators.bootstrap import poisson_weight, replicate_scores, replicate_uniform
    from textbench.operators.metric import Metric

    rnd = random.Random(3)
    some = [0.5, 0.25, 1e9, float("inf")]
    rows = [(rnd.choice([i, 7, None]), rnd.choice([None, 1, 2, 5]), rnd.choice([None, *some]), None if i % 300 else 3.0) for i in range(1300)]
    df = spark.createDataFrame(rows, "id long, a long, b double, rare double")
    ms = [Metric(c, (c,), lambda s, c=c: s[c]) for c in ("a", "b", "rare")] + ["samples"]
    for table in (df, df.limit(1), df.limit(0)):
        weighted = table.crossJoin(spark.range(-1, 40).select(F.col("id").cast("int").alias("rep")))
        w = F.when(F.col("rep") < 0, 1).otherwise(poisson_weight(replicate_uniform(42, "id", F.col("rep"))))
        g = weighted.withColumn("w", w).where("w > 0").groupBy("rep").agg(*[F.sum(F.col("w") * F.col(c)).alias(f"score_{c}") for c in ("a", "b", "rare")],
                                                                          F.sum("w").alias("score_samples"))
        got = replicate_scores(table, ms, 40, method="poisson")
        assert dict(got.dtypes) == dict(g.dtypes)
        assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, got.collect())) == sorted(map(str, g.collect()))


def test_multinomial_sums_are_those_of_the_joined_draws(spark, monkeypatch):
    from textbench.functions.hashing import hash_uniform
    from textbench.operators import bootstrap as BS
    from textbench.operators.metric import Metric

    monkeypatch.setattr(BS, "_BLOCK_BITS", 5)
    monkeypatch.setattr(BS, "_DRAWS_AT_ONCE", 700)
    rows = [(1000 - 3 * i, None if i % 7 == 0 else i, None if i % 5 == 0 else i / 8, 3.0 if i == 9 else None) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, a long, b double, rare double")
    ms = [Metric(c, (c,), lambda s, c=c: s[c]) for c in ("a", "b", "rare")] + ["samples"]
    for table in (df, df.limit(1), df.limit(0)):
        n = table.count()
        at = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(sorted(table.collect()))], "idx long, a long, b double, rare double")
        reps = spark.range(30).select(F.col("id").cast("int").alias("rep"))
        drawn = spark.range(n).crossJoin(reps).select("rep", F.floor(hash_uniform(42, F.col("rep"), F.col("id")) * n).alias("idx"))
        drawn = drawn.unionByName(at.select(F.lit(-1).alias("rep"), "idx")).join(at, "idx")
        g = drawn.groupBy("rep").agg(*[F.sum(c).alias(f"score_{c}") for c in ("a", "b", "rare")], F.count("idx").alias("score_samples"))
        got = BS.replicate_scores(table, ms, 30, method="multinomial")
        assert sorted(map(str, got.collect())) == sorted(map(str, g.collect()))
    # neither the rows nor the draws are collected for a broadcast: only the rows before each slice are
    plan = BS.replicate_scores(df, ms, 30, method="multinomial")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "SortMergeJoin" not in plan and "draws" not in plan[plan.index("BroadcastExchange"):plan.index("BroadcastExchange") + 200]


def test_draws_of_every_replicate_sum_to_n_and_are_uniform():
    import numpy as np
    from textbench.functions.resample import DrawTree

    sizes = [0, 37, 5, 0, 100, 1]
    tree = DrawTree(sizes, 400, 7, block=8)
    blocks = [tree.number(s, at) for s, n in enumerate(sizes) for at in range(0, n, 8)]
    assert blocks == list(range(len(blocks)))
    w = np.concatenate([tree.weights(b) for b in blocks], axis=1)
    assert w.shape == (400, 143) and (w.sum(axis=1) == 143).all()
    assert abs(w.mean(axis=0) - 1).max() < 0.3 and abs(w.var() - (1 - 1 / 143)) < 0.03  # multinomial: variance 1 - 1/n
    other = DrawTree(sizes, 400, 7, block=8)  # in another order, as in another task
    for b in reversed(blocks):
        assert (other.weights(b) == tree.weights(b)).all()


def test_exact_resample_multiplies_no_rows_and_agrees_with_the_joined_draws(spark):
    from textbench.operators.bootstrap import bootstrap_ci, replicate_scores

    st = spark.range(4000).select("id", ((F.col("id") * 7919) % 101 / 101.0).alias("f1"), F.lit(3).alias("length"))
    reps = replicate_scores(st, ["samples", "f1"], 1000, method="exact")
    plan = reps._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortMergeJoin" not in plan
    rows = reps.collect()
    assert sorted(r["rep"] for r in rows) == list(range(-1, 1000)) and {r["score_samples"] for r in rows} == {4000.0}
    assert len({r["score_f1"] for r in rows}) > 900
    a, b = (bootstrap_ci(st, "f1", 1000, method=m).first() for m in ("exact", "multinomial"))
    width = b["f1_ci_upper"] - b["f1_ci_lower"]
    assert a["f1"] == pytest.approx(b["f1"]) and abs(a["f1_ci_lower"] - b["f1_ci_lower"]) < 0.1 * width
    assert abs(a["f1_ci_upper"] - b["f1_ci_upper"]) < 0.1 * width


def test_exact_resample_of_one_row_nulls_and_none(spark):
    from textbench.operators.bootstrap import bootstrap_ci

    one = spark.createDataFrame([(1, 0.5)], "id long, f1 double")
    assert tuple(bootstrap_ci(one, "f1", 20, method="exact").first()) == (0.5, 0.5, 0.5)
    some = spark.createDataFrame([(1, 0.5), (2, None)], "id long, f1 double")
    assert bootstrap_ci(some, "f1", 20, method="exact").first()["f1"] == 0.25
    assert bootstrap_ci(one.limit(0), "f1", 20, method="exact").first()["f1"] is None


@pytest.fixture(scope="module")
def some_documents(spark, tmp_path_factory):
    """Documents whose scores differ much, few enough that blocks would hold other weights than rows."""
    at = str(tmp_path_factory.mktemp("documents"))
    rows = [(i, "s", "en", 60, " ".join(f"w{(i * j) % 13}" for j in range(3 + i % 40))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{at}/documents.parquet")
    return at


def test_bootstrap_ci_resamples_rows(spark, some_documents):
    import __spark_entry__ as E

    q = E.queries()
    rows, blocks, got = (q[n](spark, some_documents).first() for n in ("a5_bootstrap_ci_poisson", "a5_bootstrap_ci_blocks", "a5_bootstrap_ci"))
    assert got == rows and got != blocks and "% 4096" not in E.oracle_sql()["a5_bootstrap_ci"]


def test_reconstruction_report_resamples_rows(spark, some_documents):
    import __spark_entry__ as E

    q = E.queries()
    rows, got = (q[n](spark, some_documents).first() for n in ("a5_bootstrap_ci_poisson", "a6_reconstruction_report"))
    for a, b in (("bleu", "bleu"), ("f1", "token_f1")):
        assert [rows[a + x] for x in ("", "_ci_lower", "_ci_upper")] == [got[b + x] for x in ("", "_ci_lower", "_ci_upper")]
    assert got["samples"] == 60 and "% 4096" not in E.oracle_sql()["a6_reconstruction_report"]
