"""Collated batches: dense, padded, in order; nulls and rows without vectors."""

from pyspark.sql import functions as F

from textbench.operators.collate import collate, training_batches


def test_arrays_are_dense_and_padded_to_the_longest(spark):
    df = spark.createDataFrame([(0, 2, [5, 6], "b"), (0, 1, [7], None), (1, 9, [], "z"), (0, 3, None, "c")],
                               "batch int, o int, t array<int>, c string")
    got = {r["batch"]: r for r in collate(df, ["batch"], ["o"], "t", {"names": "c"}, pad_id=-1).collect()}
    assert got[0]["input_ids"] == [[7, -1], [5, 6], [-1, -1]] and got[0]["attention_mask"] == [[1, 0], [1, 1], [0, 0]]
    assert got[0]["names"] == [None, "b", "c"] and (got[0]["rows"], got[0]["width"]) == (3, 2)
    assert got[1]["input_ids"] == [[]] and got[1]["width"] == 0


def test_training_batches_cover_each_epoch_once_and_resume(spark):
    docs = spark.range(21).select(F.col("id").alias("doc_id"), F.when(F.col("id") != 4, F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    vec = docs.where("doc_id <> 3").select("doc_id", F.array(F.col("doc_id").cast("float")).alias("embedding"))
    rows = training_batches(docs, vec, 4, 2, user_prompt="Say it.").collect()
    assert len(rows) == 12 and sorted(r["global_step"] for r in rows) == list(range(1, 13))
    for epoch in (0, 1):
        assert sorted(i for r in rows if r["epoch"] == epoch for i in r["ids"]) == list(range(21))
    for r in rows:
        assert all(len(x) == r["width"] for x in r["input_ids"] + r["attention_mask"]) and len(r["embeddings"]) == r["rows"]
        assert [e for e in r["embeddings"]] == [None if i == 3 else [float(i)] for i in r["ids"]]
        assert len(set(r["prefix_lengths"])) == 1 and r["width"] > r["prefix_lengths"][0]
    again = training_batches(docs, vec, 4, 2, user_prompt="Say it.", resume_step=7).collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in rows if r["global_step"] > 7)


def test_plan_has_no_python(spark):
    from textbench.plans.q_collate import bat2_training_batches

    plan = bat2_training_batches(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan
