"""Derived views over the driver tables that give every operator realistic
input (predictions, code files, agent steps, trajectories, tasks, ...).

Each view has a Spark definition (used by the registered queries) and a
DuckDB definition (``SQL_*``, used by the oracle) that produce the same rows.
Every view is a projection of a given table, so its size grows with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textbench.functions.text import words
from textbench.functions.toolcalls import add_tool_call
from textbench.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------------------
# pairs: id, model, is_refusal, reference, prediction
# ---------------------------------------------------------------------------

def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    d = F.col("doc_id")
    # every word p (1-based) of the whole text unless (p + doc_id) % 5 = 0; the
    # lambda walks the word array itself, so the text is split once per row
    thinned = F.array_join(F.filter(words(F.col("text")), lambda x, i: (i + 1 + d) % 5 != 0), " ")
    return docs.select(
        d.alias("id"),
        F.concat(F.lit("m"), (d % 2).cast("string")).alias("model"),
        (d % 7 == 0).alias("is_refusal"),
        F.when(d % 7 == 0, F.lit("no match")).otherwise(F.col("text")).alias("reference"),
        F.when(d % 14 == 0, F.lit(" no  match "))
        .when(d % 4 == 0, F.concat(F.lit("  "), F.col("text")))
        .otherwise(thinned).alias("prediction"),
        F.col("lang"),
    )


SQL_PAIRS = r"""
SELECT doc_id AS id, concat('m', CAST(doc_id % 2 AS VARCHAR)) AS model, doc_id % 7 = 0 AS is_refusal,
  CASE WHEN doc_id % 7 = 0 THEN 'no match' ELSE text END AS reference,
  CASE WHEN doc_id % 14 = 0 THEN ' no  match ' WHEN doc_id % 4 = 0 THEN concat('  ', text)
    ELSE array_to_string(list_transform(list_filter(range(1, len(w) + 1),
         lambda p: (p + doc_id) % 5 <> 0), lambda p: w[p]), ' ') END AS prediction, lang
FROM (SELECT doc_id, text, lang, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents)
"""


# ---------------------------------------------------------------------------
# code_files: doc_id, repo, lang, path, content
# ---------------------------------------------------------------------------

def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return spark.sql(
        """
        SELECT doc_id, source AS repo, lang2 AS lang, concat('src/f', doc_id, '.', lang2) AS path,
          concat(kw, 'va_', substring(h,1,6), ' = "lit ', substring(h,7,8), '"', chr(10),
                 kw, 'vb_', substring(h,15,6), ' = 7', chr(10),
                 'call_', substring(h,21,5), '(va_', substring(h,1,6), ')', chr(10)) AS content
        FROM (SELECT *, md5(concat('code:', doc_id)) AS h,
                element_at(array('py','js','rs','go'), cast(doc_id % 4 + 1 AS int)) AS lang2,
                element_at(array('','let ','let mut ','var '), cast(doc_id % 4 + 1 AS int)) AS kw
              FROM {docs})
        """,
        docs=docs,
    )


SQL_CODE_FILES = r"""
SELECT doc_id, source AS repo, lang2 AS lang, concat('src/f', doc_id, '.', lang2) AS path,
  concat(kw, 'va_', substr(h,1,6), ' = "lit ', substr(h,7,8), '"', chr(10),
         kw, 'vb_', substr(h,15,6), ' = 7', chr(10),
         'call_', substr(h,21,5), '(va_', substr(h,1,6), ')', chr(10)) AS content
FROM (SELECT *, md5(concat('code:', doc_id)) AS h,
        (['py','js','rs','go'])[doc_id % 4 + 1] AS lang2,
        (['','let ','let mut ','var '])[doc_id % 4 + 1] AS kw
      FROM documents)
"""


# ---------------------------------------------------------------------------
# steps: conv_id, s, model_output ; trajectories ; tasks
# ---------------------------------------------------------------------------

_STEPS_BODY = """
SELECT conv_id, s, CASE (conv_id + s) % 4
  WHEN 0 THEN concat('<tool_call>', chr(10), 'read /workspace/f', conv_id, '.py', chr(10), '</tool_call>')
  WHEN 1 THEN concat('Fix.', chr(10), '<tool_call>', chr(10), 'edit f', conv_id, '.py', chr(10), '<<<', chr(10),
       substring(text,1,12), chr(10), '>>>', chr(10), 'new', s, chr(10), '===', chr(10), '</tool_call>')
  WHEN 2 THEN text ELSE concat(substring(text,1,20), chr(10), '<done/>') END AS model_output
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS s
      FROM {conv} WHERE role = 'assistant')
"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    return spark.sql(_STEPS_BODY.replace("{conv}", "{conv}"), conv=conv)


SQL_STEPS = _STEPS_BODY.replace("{conv}", "conversations")


def step_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per step with the harness's view of it: the parsed call (null
    when the output is "done", which is checked first) and a deterministic
    tool result (success unless ``(conv_id + s) % 5 = 0``)."""
    st = add_tool_call(steps(spark, sf_dir), "model_output", "call", skip_done=True)
    result = F.when(
        F.col("call").isNotNull(),
        F.struct(((F.col("conv_id") + F.col("s")) % 5 != 0).alias("success"),
                 F.concat(F.lit("out "), F.col("s").cast("string")).alias("output")),
    )
    return st.withColumn("tool_result", result)


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``task_id, model, run, success, steps: array<struct<model_output, tool_call, tool_result>>``
    (serialised form: the call keeps tool, path, command)."""
    st = step_records(spark, sf_dir)
    step = F.struct(
        F.col("s"),
        F.col("model_output"),
        F.when(F.col("call").isNotNull(), F.struct(F.col("call.tool").alias("tool"), F.col("call.path").alias("path"),
                                                   F.col("call.command").alias("command"))).alias("tool_call"),
        F.col("tool_result"),
    )
    grouped = st.groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return grouped.select(
        F.col("conv_id").alias("run"),
        F.concat(F.lit("task_"), (F.col("conv_id") % 15).cast("string")).alias("task_id"),
        F.concat(F.lit("m"), (F.col("conv_id") % 2).cast("string")).alias("model"),
        (F.col("conv_id") % 3 == 0).alias("success"),
        F.transform("steps", lambda x: F.struct(x["model_output"].alias("model_output"), x["tool_call"].alias("tool_call"),
                                                x["tool_result"].alias("tool_result"))).alias("steps"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task per id ``task_0..task_14`` (the ids trajectories use): all
    parts are grouped by ``p_partkey % 15`` and the task text comes from
    the group's first part name."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    g = part.groupBy((F.col("p_partkey") % 15).alias("k")).agg(F.min_by("p_name", "p_partkey").alias("p_name"))
    return g.select(
        F.concat(F.lit("task_"), F.col("k").cast("string")).alias("id"),
        F.concat(F.lit("Fix the bug in f"), F.col("k").cast("string"), F.lit(".py: "), F.col("p_name")).alias("description"),
        F.lit("agent-base").alias("docker_image"),
        F.concat(F.lit("task_"), F.col("k").cast("string")).alias("files_dir"),
        F.array().cast("array<string>").alias("setup_commands"),
        F.lit("python -m pytest -q").alias("test_command"),
        F.when(F.col("k") % 2 == 0, 5).otherwise(10).cast("int").alias("max_steps"),
    )


SQL_TASKS = """
SELECT concat('task_', CAST(k AS VARCHAR)) AS id,
  concat('Fix the bug in f', CAST(k AS VARCHAR), '.py: ', p_name) AS description,
  CAST(CASE WHEN k % 2 = 0 THEN 5 ELSE 10 END AS INTEGER) AS max_steps
FROM (SELECT p_partkey % 15 AS k, arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY 1)
"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_brand", "p_partkey")
    return part.select(
        F.col("p_brand").alias("run"),
        F.concat(F.lit("outputs/"), F.col("p_brand"), F.lit("/adapter-step"), (F.col("p_partkey") * 25).cast("string"),
                 F.lit(".pt")).alias("path"),
    )


SQL_MANIFEST = """
SELECT p_brand AS run, concat('outputs/', p_brand, '/adapter-step', CAST(p_partkey * 25 AS VARCHAR), '.pt') AS path FROM part
"""


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "value")
    return ev.select((F.col("event_id") + 1).alias("step"), F.col("value").alias("loss"))


SQL_METRIC_LOG = "SELECT event_id + 1 AS step, value AS loss FROM events"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents projected to the corpus shape (doc_id, text)."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings keyed like documents: doc_id := vec_id."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
