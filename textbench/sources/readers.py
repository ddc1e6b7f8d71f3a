"""SRC1-SRC8: readers with explicit schemas and early validation.

Every reader returns a lazy DataFrame; file formats are Spark's own
(Parquet, JSON lines, multi-line JSON, whole-text files), so scans split
across executors and Parquet scans get column pruning and filter pushdown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textbench.session import written

MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
CONVERSATION_SCHEMA = T.StructType([T.StructField("messages", MESSAGES)])

TOOL_CALL = T.StructType([T.StructField("tool", T.StringType()), T.StructField("path", T.StringType()),
                          T.StructField("command", T.StringType())])
TOOL_RESULT = T.StructType([T.StructField("success", T.BooleanType()), T.StructField("output", T.StringType())])
STEP = T.StructType([T.StructField("model_output", T.StringType()), T.StructField("tool_call", TOOL_CALL),
                     T.StructField("tool_result", TOOL_RESULT)])
TRAJECTORY_SCHEMA = T.StructType([T.StructField("task_id", T.StringType()), T.StructField("success", T.BooleanType()),
                                  T.StructField("steps", T.ArrayType(STEP))])
TASK_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("docker_image", T.StringType()), T.StructField("files_dir", T.StringType()),
    T.StructField("setup_commands", T.ArrayType(T.StringType())), T.StructField("test_command", T.StringType()),
    T.StructField("max_steps", T.IntegerType()),
])
BUCKET = T.StructType([
    T.StructField("min_tokens", T.IntegerType()), T.StructField("max_tokens", T.IntegerType()),
    T.StructField("avg_ref_tokens", T.DoubleType()), T.StructField("bleu", T.DoubleType()),
    T.StructField("token_f1", T.DoubleType()), T.StructField("samples", T.IntegerType()),
])
EVAL_REPORT_SCHEMA = T.StructType([
    *[T.StructField(n, T.DoubleType()) for n in (
        "bleu", "bleu_ci_lower", "bleu_ci_upper", "token_f1", "token_f1_ci_lower", "token_f1_ci_upper",
        "avg_ref_tokens", "token_compression_ratio")],
    T.StructField("samples", T.LongType()),
    T.StructField("length_buckets", T.ArrayType(BUCKET)),
])

def extended(schema: T.StructType, **fields: str) -> T.StructType:
    """A copy of ``schema`` with more fields (``StructType.add`` would change the shared one)."""
    out = T.StructType(list(schema.fields))
    for name, kind in fields.items():
        out.add(name, kind)
    return out


# Task defaults for absent fields: image name (configurable, neutral) and step budget (fixed value: 20).
TASK_DEFAULT_IMAGE = "agent-base"
TASK_DEFAULT_MAX_STEPS = 20


def _reader(spark: SparkSession, fmt: str):
    return spark.read.format(fmt)


def read_corpus(spark: SparkSession, path: str, text_col: str, id_col: str | None = None, fmt: str = "parquet",
                split: str | None = None, split_col: str = "split") -> DataFrame:
    """SRC1: load a corpus, validate and project it to ``text`` (+ ``doc_id``).

    Missing text/id columns (or a missing split column when a split is
    named) raise ``ValueError`` before any job runs."""
    df = _reader(spark, fmt).load(path)
    return project_corpus(df, text_col, id_col, split, split_col)


def project_corpus(df: DataFrame, text_col: str, id_col: str | None = None, split: str | None = None,
                   split_col: str = "split") -> DataFrame:
    if text_col not in df.columns:
        raise ValueError(f"Missing text field {text_col} in dataset columns")
    if id_col and id_col not in df.columns:
        raise ValueError(f"Missing id field {id_col} in dataset columns")
    if split is not None:
        if split_col not in df.columns:
            raise ValueError(f"Missing split column {split_col}")
        df = df.filter(F.col(split_col) == split)
    cols = [F.col(text_col).alias("text")]
    if id_col:
        cols.append(F.col(id_col).alias("doc_id"))
    return df.select(*cols)


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: JSON lines of ``{"messages": [{role, content}, ...]}``."""
    return spark.read.schema(CONVERSATION_SCHEMA).json(path)


def parse_conversations(json_col: Column) -> Column:
    """SRC2 on a JSON string column (same schema as the file reader)."""
    return F.from_json(json_col, CONVERSATION_SCHEMA)


def _task_defaults(t: Column) -> Column:
    return F.struct(
        t["id"].alias("id"), t["description"].alias("description"),
        F.coalesce(t["docker_image"], F.lit(TASK_DEFAULT_IMAGE)).alias("docker_image"),
        t["files_dir"].alias("files_dir"),
        F.coalesce(t["setup_commands"], F.array().cast("array<string>")).alias("setup_commands"),
        F.coalesce(t["test_command"], F.lit("")).alias("test_command"),
        F.coalesce(t["max_steps"], F.lit(TASK_DEFAULT_MAX_STEPS)).alias("max_steps"),
    )


def parse_tasks(json_col: Column) -> Column:
    """SRC3 on a JSON string that holds one task object *or* an array of
    them: ``array<task>`` with defaults filled in."""
    as_array = F.from_json(json_col, T.ArrayType(TASK_SCHEMA))
    as_object = F.from_json(json_col, TASK_SCHEMA)
    tasks = F.when(F.trim(json_col).startswith("["), as_array).otherwise(F.array(as_object))
    return F.transform(tasks, _task_defaults)


def read_tasks(spark: SparkSession, path: str, pattern: str = "task_*.json") -> DataFrame:
    """SRC3: task files (object or array per file) under ``path`` (or the one
    file ``path``), sorted by id."""
    reader = spark.read if path.endswith(".json") else spark.read.option("pathGlobFilter", pattern)
    files = reader.text(path, wholetext=True)
    return files.select(F.explode(parse_tasks(F.col("value"))).alias("t")).select("t.*").orderBy("id")


def read_trajectories(spark: SparkSession, path: str, **more: str) -> DataFrame:
    """SRC4: serialised trajectories (JSON lines, nested steps).  ``more``: names and
    types of fields that the lines hold beside them."""
    return spark.read.schema(extended(TRAJECTORY_SCHEMA, **more)).json(path)


def parse_trajectories(json_col: Column) -> Column:
    return F.from_json(json_col, TRAJECTORY_SCHEMA)


def _open(uri: str):
    """(file system, path) of a URI, on whichever machine this runs."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


LISTED = "repo string, path string, uri string, size long, folder boolean"
FOLDERS_PER_TASK = 256
ROWS_PER_BATCH = 2000


def _list_folders(root: str):
    """Tasks that list folders (repo, path, uri; no repo: the root itself) one by
    one, giving their files and folders on as rows as they are found."""

    def run(batches):
        import pandas as pd
        from pyarrow.fs import FileSelector, FileType

        scheme = root[:root.index("://") + 3] if "://" in root else ""
        for pdf in batches:
            for repo, path, uri in zip(pdf["repo"], pdf["path"], pdf["uri"]):
                fs, at = _open(uri)
                rows = []
                for i in fs.get_file_info(FileSelector(at)):
                    folder = i.type == FileType.Directory
                    if not folder and (i.type != FileType.File or repo is None):
                        continue
                    name = i.path.rpartition("/")[2]
                    inside = "" if repo is None else f"{path}/{name}" if path else name
                    rows.append((name if repo is None else repo, inside, scheme + i.path, i.size or 0, folder))
                    if len(rows) == ROWS_PER_BATCH:
                        yield pd.DataFrame(rows, columns=["repo", "path", "uri", "size", "folder"])
                        rows = []
                yield pd.DataFrame(rows, columns=["repo", "path", "uri", "size", "folder"])

    return run


def list_code_files(spark: SparkSession, root: str) -> DataFrame:
    """(repo, path, uri, size) of every file below ``root/<repo>/``, names that
    begin with ``_`` or ``.`` included (Spark's own file sources hide those).

    Folders are a frontier of rows: one round of tasks lists all folders of a
    depth, wherever they lie, and the folders found are dealt out again as the next
    round's.  So a repository with a third of all files is listed by as many
    tasks as it has folders, and there are as many rounds as the tree is deep.  One
    folder is one call of the file system."""
    root = root.rstrip("/")
    frontier = spark.createDataFrame([(None, "", root)], "repo string, path string, uri string")
    levels = []
    while True:
        found = written(frontier.mapInPandas(_list_folders(root), LISTED), "listed")
        levels.append(found.where(~F.col("folder")).select("repo", "path", "uri", "size"))
        folders = found.where("folder").select("repo", "path", "uri")
        n = folders.count()
        if not n:
            break
        frontier = folders.repartition(min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // FOLDERS_PER_TASK))))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionAll(level)
    return out


def write_code_files(files: DataFrame, root: str) -> None:
    """(repo, path, content) rows as files ``root/<repo>/<path>``."""

    def save(batches):
        import pandas as pd

        for pdf in batches:
            for repo, path, content in zip(pdf["repo"], pdf["path"], pdf["content"]):
                uri = f"{root.rstrip('/')}/{repo}/{path}"
                fs, at = _open(uri)
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(at) as f:
                    f.write(content.encode())
            yield pd.DataFrame({"n": [len(pdf)]})

    files.select("repo", "path", "content").mapInPandas(save, "n long").agg(F.sum("n")).collect()


def read_code_files(spark: SparkSession, root: str, keep: Column | None = None) -> DataFrame:
    """SRC5: files under ``root/<repo>/...`` as (repo, path, content); pair with
    :func:`textbench.operators.sft.walk_filter` for the language, vendor, size
    and per-repo cap rules.  ``keep`` is a condition on (repo, path, size) that
    is applied before any file is opened (``sft.worth_reading`` has that of the
    walk rules).  Bytes that are not UTF-8 are replaced."""
    files = list_code_files(spark, root)
    files = files if keep is None else files.filter(keep)

    def load(batches):
        for pdf in batches:
            text = []
            for uri in pdf["uri"]:
                fs, at = _open(uri)
                with fs.open_input_stream(at, compression=None) as f:
                    text.append(f.read().decode("utf-8", errors="replace"))
            yield pdf[["repo", "path"]].assign(content=text)

    return files.hint("rebalance").mapInPandas(load, "repo string, path string, content string")


def read_eval_reports(spark: SparkSession, outputs_root: str, report_glob: str = "eval-report.json",
                      multi_line: bool = True, siblings: bool = True) -> DataFrame:
    """SRC6: every report of ``outputs*/`` siblings and of ``outputs/*/`` that has
    buckets, with its file as ``report_path``; experiment = the report's
    directory name (a ``key=`` prefix, as in Spark-written partition folders,
    is dropped)."""
    root = outputs_root.rstrip("/")
    parent = root.rsplit("/", 1)[0] if "/" in root else "."
    paths = existing_globs(spark, [f"{root}/*/{report_glob}"] + ([f"{parent}/outputs*/{report_glob}"] if siblings else []))
    if not paths:
        return spark.createDataFrame([], EVAL_REPORT_SCHEMA).select(
            "*", *[F.lit(None).cast("string").alias(c) for c in ("report_path", "experiment")])
    df = (spark.read.option("multiLine", multi_line).option("ignoreMissingFiles", True)
          .schema(EVAL_REPORT_SCHEMA).json(paths))
    df = df.withColumn("report_path", F.col("_metadata.file_path"))
    name = F.regexp_replace(F.regexp_extract("report_path", "([^/]+)/[^/]+$", 1), "^[^=/]*=", "")
    return df.withColumn("experiment", name).filter(F.col("length_buckets").isNotNull())


def existing_globs(spark: SparkSession, paths: list[str]) -> list[str]:
    """Keep the path globs that match at least one file (a metadata listing
    on the driver, no data read)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        st = hp.getFileSystem(conf).globStatus(hp)
        if st is not None and len(st) > 0:
            out.append(p)
    return out


def read_embeddings(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """SRC7: precomputed vectors (``id, embedding: array<float>``)."""
    return spark.read.parquet(path).select(id_col, "embedding")


def checkpoint_step(path: Column) -> Column:
    """SRC8: step number of an ``adapter-step<N>.pt`` file name (null otherwise)."""
    s = F.regexp_extract(path, "adapter-step(\\d+)\\.pt$", 1)
    return F.when(s == "", F.lit(None).cast("long")).otherwise(s.cast("long"))


def latest_checkpoint(manifest: DataFrame, run_col: str = "run", path_col: str = "path") -> DataFrame:
    """SRC8: per run the checkpoint with the largest step (``max_by``)."""
    m = manifest.withColumn("step", checkpoint_step(F.col(path_col))).filter(F.col("step").isNotNull())
    return m.groupBy(run_col).agg(F.max("step").alias("step"), F.max_by(path_col, "step").alias("path"))
