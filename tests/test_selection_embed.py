"""Selection dataset invariants, embeddings resume, reports goldens."""

import json
import os

import pytest
from pyspark.sql import functions as F

from textbench.operators import embeddings as EM
from textbench.operators import reports as RP
from textbench.operators import selection as SEL
from textbench.sources import readers as RD
from conftest import SF_SMALL


def _docs(spark, texts):
    return spark.createDataFrame([(i * 10, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_selection_invariants(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    idx = SEL.index_ids(docs).join(docs, "doc_id")
    ex = SEL.selection_dataset(docs, seed=3)
    texts = {r["idx"]: r["text"] for r in idx.collect()}
    rows = ex.collect()
    assert len(rows) == len(texts)
    for r in rows:
        ind = r["doc_indices"]
        assert len(ind) == len(set(ind)) == r["doc_count"] and 2 <= r["doc_count"] <= 8
        if r["is_refusal"]:
            assert r["target_text"] == SEL.REFUSAL_TEXT
        else:
            assert r["target_text"] in [texts[i] for i in ind]
        if r["query_kind"] == "content":
            phrase = r["query"].split('the phrase "', 1)[1].rsplit('" exactly.', 1)[0]
            others = [i for i in ind if texts[i] != r["target_text"]]
            assert not any(phrase in texts[i] for i in others)
            # the phrase is a run of the target's whitespace words (joined by single spaces)
            assert phrase in " ".join(r["target_text"].split())
        if r["query_kind"] == "refusal_content":
            phrase = r["query"].split('the phrase "', 1)[1].rsplit('" exactly.', 1)[0]
            assert not any(phrase in texts[i] for i in ind)
    kinds = {r["query_kind"] for r in rows}
    assert {"content", "position"} <= kinds


def test_selection_one_document_corpus(spark):
    rows = SEL.selection_dataset(_docs(spark, ["only one document here"]),
                                 spark.range(50).withColumnRenamed("id", "sample_id"), seed=1).collect()
    for r in rows:
        assert r["doc_count"] == 1
        if r["is_refusal"]:
            assert r["query_kind"] == "refusal_position"


def test_selection_empty_corpus_errors(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    with pytest.raises(Exception):
        SEL.selection_dataset(empty, spark.range(3).withColumnRenamed("id", "sample_id")).collect()


def test_precompute_resume_is_idempotent(spark, tmp_path):
    docs = _docs(spark, [f"text number {i} with words" for i in range(30)])
    path = str(tmp_path / "vec")
    assert EM.precompute_embeddings(spark, docs.filter("doc_id < 150"), path, dim=16).count() == 15
    v = EM.precompute_embeddings(spark, docs, path, dim=16)
    assert v.count() == 30 and v.select("doc_id").distinct().count() == 30
    files = sorted(str(f) for f in tmp_path.rglob("*.parquet"))
    assert EM.precompute_embeddings(spark, docs, path, dim=16).count() == 30
    # a run on a part of the corpus takes nothing away
    assert EM.precompute_embeddings(spark, docs.filter("doc_id < 50"), path, dim=16).count() == 30
    assert sorted(str(f) for f in tmp_path.rglob("*.parquet")) == files
    assert EM.embedding_coverage(docs, EM.read_precomputed(spark, path), 16).first()["verdict"] == "complete"
    # another dimension starts a new generation beside the old one
    v = EM.precompute_embeddings(spark, docs, path, dim=8)
    assert v.select(F.size("embedding")).distinct().first()[0] == 8 and v.count() == 30
    assert set(files) < {str(f) for f in tmp_path.rglob("*.parquet")}


def test_precompute_read_error_leaves_files_alone(spark, tmp_path):
    docs = _docs(spark, [f"text number {i}" for i in range(10)])
    path = tmp_path / "vec"
    EM.precompute_embeddings(spark, docs, str(path), dim=16)
    files = {str(f): f.read_bytes() for f in path.rglob("*.parquet")}
    broken = path / "gen-0" / "stray" / "bucket=x" / "deep=1"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        EM.precompute_embeddings(spark, docs, str(path), dim=16).count()
    assert {str(f): f.read_bytes() for f in path.rglob("*.parquet") if "stray" not in str(f)} == files


def test_coverage_counts_duplicates_nulls_and_orphans(spark):
    docs = _docs(spark, ["a", "b", "c", "d"])
    ids = [r["doc_id"] for r in docs.collect()]
    ok, schema = [1.0, 2.0], "doc_id long, embedding array<float>"
    full = spark.createDataFrame([(i, ok) for i in ids] * 2 + [(-1, ok)], schema)
    r = EM.embedding_coverage(docs, full, 2).first()
    assert (r["rows"], r["covered"], r["missing"], r["orphans"], r["duplicates"], r["verdict"]) == (4, 4, 0, 1, 4, "duplicates")
    r = EM.embedding_coverage(docs, spark.createDataFrame([(ids[0], None), (ids[1], ok)], schema), 2).first()
    assert (r["covered"], r["missing"], r["null_vectors"], r["bad_dims"], r["verdict"]) == (1, 3, 1, 0, "resume")
    r = EM.embedding_coverage(docs, spark.createDataFrame([(ids[0], [1.0]), (ids[1], ok)], schema), 2).first()
    assert (r["covered"], r["missing"], r["bad_dims"], r["verdict"]) == (1, 3, 1, "rebuild")


def test_one_vector_per_row_whatever_the_encoder(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "c"), (None, "d"), (None, "d"), (2, None)], "doc_id long, text string")
    want = sorted((str(i), EM.HashedBagOfWords(8)([t])[0].tolist()) for i, t in [(1, "a b"), (1, "c"), (None, "d"), (None, "d"), (2, "")])
    for enc in (None, EM.HashedBagOfWords(8)):
        got = sorted((str(r["doc_id"]), r["embedding"]) for r in EM.embed_texts(df, encoder=enc, dim=8).collect())
        assert got == want


def test_a_text_without_a_vector_is_asked_for_again_and_rebuilds_nothing(spark, tmp_path):
    docs = _docs(spark, ["a", "bad", "c"])
    path = str(tmp_path / "v")

    def enc(texts):
        return [None if t == "bad" else [1.0, 2.0] for t in texts]

    for _ in range(3):
        v = EM.precompute_embeddings(spark, docs, path, encoder=enc, dim=2)
        assert v.count() == 2 and EM._generation(spark, path) == 0
    assert EM.precompute_embeddings(spark, docs, path, encoder=lambda ts: [[3.0, 4.0] for _ in ts], dim=2).count() == 3


def test_bucketed_tables_are_joined_without_a_shuffle(spark, tmp_path):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    vec = docs.where("doc_id % 3 = 0").select("doc_id", F.array(F.lit(1.0).cast("float")).alias("embedding"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        c = EM.write_bucketed(docs, "t_corpus_b", str(tmp_path / "c"), buckets=8)
        EM.write_bucketed(vec, "t_vec_b", str(tmp_path / "v"), buckets=8)
        v = EM.open_bucketed(spark, "t_vec_again", str(tmp_path / "v"), "doc_id BIGINT, embedding ARRAY<FLOAT>", buckets=8)
        pending, coverage = EM.pending_embeddings(c, v), EM.embedding_coverage(c, v, 1)
        plan = pending._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        plan = coverage._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and plan.count("Exchange") == 1  # the sums of the one result row
        assert pending.count() == 333 and coverage.first()["missing"] == 333
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for t in ("t_corpus_b", "t_vec_b", "t_vec_again"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_native_and_python_encoder_agree(spark):
    docs = _docs(spark, ["the cat the cat", "", "é ß 漢字 ñ ñ", "  one  "])
    a = {r["doc_id"]: r["embedding"] for r in EM.embed_texts(docs, dim=32).collect()}
    b = {r["doc_id"]: r["embedding"] for r in EM.embed_texts(docs, encoder=EM.HashedBagOfWords(32)).collect()}
    assert a == b and len(a) == 4


def test_gelu_matches_erf():
    import math

    import numpy as np

    x = np.linspace(-6, 6, 401)
    want = [v * 0.5 * (1 + math.erf(v / math.sqrt(2))) for v in x]
    assert np.abs(EM._gelu(x) - want).max() < 1e-6


def test_storage_estimate_gate(spark):
    df = spark.range(1000)
    r = EM.storage_estimate(df, dims=768).first()
    assert r["bytes_per_row"] == 3072 and r["total_bytes"] == 3_072_000 and r["precompute"]
    assert not EM.storage_estimate(df, mode="false").first()["precompute"]
    with pytest.raises(ValueError):
        EM.storage_estimate(df, mode="sometimes")


def test_adapter_linear_matches_numpy(spark):
    import numpy as np

    w = EM.random_adapter(4, 3, 2, layers=0, seed=1)
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0])], "doc_id long, embedding array<float>")
    got = np.array(EM.adapter_forward(df, w).first()["prefix"])
    want = np.array([1.0, 2.0, 3.0, 4.0]) @ w[0][0] + w[0][1]
    assert got.shape == (6,) and np.allclose(got, want, atol=1e-5)


def test_best_k_published_sweep(spark):
    # K-sweep table of the reference's report (fixed values)
    mlp = [(1, 47.99, .775, 7.81), (2, 41.65, .734, 3.91), (4, 31.13, .639, 1.95), (8, 32.30, .662, 0.98),
           (16, 30.04, .628, 0.49), (32, 30.39, .629, 0.24)]
    lin = [(1, 27.69, .640, 7.83), (2, 30.85, .646, 3.92), (4, 31.52, .684, 1.96), (8, 38.13, .688, 0.98),
           (16, 37.12, .713, 0.49), (32, 38.74, .722, 0.24)]
    rows = [("mlp", *r) for r in mlp] + [("linear", *r) for r in lin]
    df = spark.createDataFrame(rows, "adapter string, k int, bleu double, token_f1 double, compression double")
    best = {r["adapter"]: (r["k"], r["bleu"]) for r in RP.best_k(df).collect()}
    assert best == {"mlp": (1, 47.99), "linear": (32, 38.74)}


def test_length_quality_corr_published_points(spark):
    # plotted (avg tokens, BLEU) points of the reference's report (fixed values)
    pts = {
        "mlp_k1": [(3.89, 71.54), (5.46, 64.17), (6.00, 57.45), (6.98, 64.08), (7.81, 53.49), (8.81, 48.10),
                   (10.18, 43.65), (13.33, 30.11)],
        "linear_k32": [(4.76, 55.61), (6.54, 47.13), (8.42, 36.12), (11.60, 32.08)],
        "owt": [(205.58, 1.577), (275.72, 0.958), (355.30, 0.937), (446.94, 0.414), (557.94, 0.283), (700.90, 0.078),
                (887.80, 0.022), (1107.42, 0.004), (1514.14, 0.00025), (3387.30, 0.00000)],
    }
    rows = [(e, x, y) for e, p in pts.items() for x, y in p]
    df = spark.createDataFrame(rows, "experiment string, avg_tokens double, bleu double")
    r = {x["experiment"]: x["pearson_r"] for x in RP.length_quality_corr(df).collect()}
    assert r["mlp_k1"] == pytest.approx(-0.9737, abs=1e-4)
    assert r["linear_k32"] == pytest.approx(-0.9526, abs=1e-4)
    assert r["owt"] == pytest.approx(-0.5731, abs=1e-4)


def test_read_eval_reports_and_bucket_table(spark, tmp_path):
    root = tmp_path / "outputs"
    rep = {"bleu": 1.0, "samples": 2, "length_buckets": [
        {"min_tokens": 1, "max_tokens": 2, "avg_ref_tokens": 1.5, "bleu": 10.0, "token_f1": 0.5, "samples": 1},
        {"min_tokens": None, "max_tokens": None, "avg_ref_tokens": 0.0, "bleu": None, "token_f1": None, "samples": 0}]}
    for d in (root / "exp_a", tmp_path / "outputs-k4"):
        d.mkdir(parents=True)
        (d / "eval-report.json").write_text(json.dumps(rep))
    (root / "exp_b").mkdir()
    (root / "exp_b" / "eval-report.json").write_text(json.dumps({"bleu": 2.0}))
    reps = RD.read_eval_reports(spark, str(root))
    assert sorted(r["experiment"] for r in reps.collect()) == ["exp_a", "outputs-k4"]
    t = RP.bucket_table(reps).collect()
    assert len(t) == 2 and all(r["bucket"] == 0 for r in t)
    trend = {r["experiment"]: r["trend"] for r in RP.bleu_trend(RP.bucket_table(reps)).collect()}
    assert trend["exp_a"] == "10.0"


def test_latest_checkpoint(spark):
    df = spark.createDataFrame([("r", "o/adapter-step10.pt"), ("r", "o/adapter-step200.pt"), ("r", "o/adapter-final.pt")],
                               "run string, path string")
    r = RD.latest_checkpoint(df).first()
    assert (r["step"], r["path"]) == (200, "o/adapter-step200.pt")


def test_cross_domain_published_table(spark):
    # cross-domain table of the reference's report (fixed values; "~0" as 0.0)
    rows = [("MS-MARCO", "MS-MARCO", 47.99), ("MS-MARCO", "OpenWebText", 0.0),
            ("OpenWebText", "OpenWebText", 0.012), ("OpenWebText", "MS-MARCO", 0.141)]
    df = spark.createDataFrame(rows, "train string, eval string, bleu double")
    m = {r["train"]: r.asDict() for r in RP.cross_domain_matrix(df, "train", "eval", "bleu").collect()}
    assert m["MS-MARCO"]["MS-MARCO"] == 47.99 and m["OpenWebText"]["MS-MARCO"] == 0.141
    assert m["OpenWebText"]["OpenWebText"] == 0.012 and m["MS-MARCO"]["OpenWebText"] == 0.0


def test_reconstruction_report_with_buckets(spark):
    from textbench.operators.bleu import bleu_row_stats
    from textbench.operators.bootstrap import reconstruction_report

    rows = [(i, "a b c d e f", "a b c d e f " * (1 + i % 3)) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, prediction string, reference string")
    df = df.withColumn("length", F.size(F.split("reference", " "))).withColumn("f1", F.lit(1.0))
    st = bleu_row_stats(df, keep=["length", "f1"])
    rep = reconstruction_report(st, prefix_tokens=0, n_boot=50, buckets=4).first()
    assert rep["samples"] == 12 and rep["token_compression_ratio"] == 0.0
    assert [b["samples"] for b in rep["length_buckets"]] == [3, 3, 3, 3]
    assert rep["bleu_ci_lower"] <= rep["bleu"] <= rep["bleu_ci_upper"]
