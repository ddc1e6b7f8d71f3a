"""SFT1-4, SRC5 filters: supervised chat examples from code repositories.

Conversations are ``array<struct<role, content>>`` columns built with
``array``/``struct``/``concat``; a repository walk is a files DataFrame, and
per-repository caps are exact, skew-safe top-n (LIM2).  No example is ever
assembled on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textbench.functions.hashing import hash_bits, hash_uniform
from textbench.functions.mutations import rename_mutation, string_literal_mutation
from textbench.functions.text import message
from textbench.functions.toolcalls import format_tool_result
from textbench.operators.splits import cap_per_group, seeded_shuffle
from textbench.operators.trajectories import SYSTEM_PROMPT

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical output.
# File extensions → language: .py py, .js js, .ts js, .rs rs, .go go
# Skipped directories: node_modules vendor .git target __pycache__
# Kept file sizes: 20 < characters < 5000 ; at most 200 files per repository
# Task descriptions:
#   Rename the variable `{old}` to `{new}` in {path}
#   Change the string {old} to {new} in {path}
# Assistant turns:
#   I'll read the file first.\n\n<tool_call>\nread {path}\n</tool_call>
#   I'll make the edit now.\n\n<tool_call>\nedit {path}\n<<<\n{old}\n>>>\n{new}\n===\n</tool_call>
#   The change has been applied.\n\n<done/>
#   Let me read the file to see the exact content.\n\n<tool_call>\nread {path}\n</tool_call>
#   Now I can see the exact text.\n\n<tool_call>\nedit {path}\n<<<\n{old}\n>>>\n{new}\n===\n</tool_call>
#   <done/>
# Run scenarios (description, command, output):
#   Run the test suite and verify all tests pass. | pytest -x | 5 passed
#   Check what Python version is installed. | python --version | Python 3.11.9
#   List all files in the project. | ls -la | total 24\ndrwxr-xr-x ...
#   Install the project dependencies. | pip install -e . | Successfully installed ...
#   Run the linter on the codebase. | ruff check . | All checks passed!
# Rates: recovery variant 0.3, read-then-edit (vs direct) 0.5; cap 30 examples per repository
# ---------------------------------------------------------------------------
LANG_EXTENSIONS = [(".py", "py"), (".js", "js"), (".ts", "js"), (".rs", "rs"), (".go", "go")]
SKIP_DIRS = ["node_modules", "vendor", ".git", "target", "__pycache__"]
RUN_SCENARIOS = [
    ("Run the test suite and verify all tests pass.", "pytest -x", "5 passed"),
    ("Check what Python version is installed.", "python --version", "Python 3.11.9"),
    ("List all files in the project.", "ls -la", "total 24\ndrwxr-xr-x ..."),
    ("Install the project dependencies.", "pip install -e .", "Successfully installed ..."),
    ("Run the linter on the codebase.", "ruff check .", "All checks passed!"),
]
RECOVERY_RATE, READ_RATE, MAX_PER_REPO, MAX_FILES = 0.3, 0.5, 30, 200

MSG_TYPE = "array<struct<role:string,content:string>>"


def _u(t: str) -> Column:
    return message(F.lit("user"), F.lit(t)) if isinstance(t, str) else message(F.lit("user"), t)


def _a(t) -> Column:
    return message(F.lit("assistant"), F.lit(t) if isinstance(t, str) else t)


def _edit_call(path: Column, old: Column, new: Column) -> Column:
    return F.concat(F.lit("<tool_call>\nedit "), path, F.lit("\n<<<\n"), old, F.lit("\n>>>\n"), new,
                    F.lit("\n===\n</tool_call>"))


def _read_call(path: Column) -> Column:
    return F.concat(F.lit("<tool_call>\nread "), path, F.lit("\n</tool_call>"))


def _ok(text: Column) -> Column:
    return message(F.lit("user"), format_tool_result(F.lit(True), text))


def _fail(text: Column) -> Column:
    return message(F.lit("user"), format_tool_result(F.lit(False), text))


def _head(desc: Column) -> list[Column]:
    return [message(F.lit("system"), F.lit(SYSTEM_PROMPT)), message(F.lit("user"), desc)]


def read_edit_conversation(path: Column, desc: Column, original: Column, old: Column, new: Column) -> Column:
    """SFT1: system, task, read call, file, edit call, confirmation, done (7 messages)."""
    return F.array(
        *_head(desc),
        _a(F.concat(F.lit("I'll read the file first.\n\n"), _read_call(path))),
        _ok(original),
        _a(F.concat(F.lit("I'll make the edit now.\n\n"), _edit_call(path, old, new))),
        _ok(F.concat(F.lit("edited "), path)),
        _a("The change has been applied.\n\n<done/>"),
    )


def direct_edit_conversation(path: Column, desc: Column, old: Column, new: Column) -> Column:
    """SFT2: the edit without reading first (5 messages)."""
    return F.array(*_head(desc), _a(_edit_call(path, old, new)), _ok(F.concat(F.lit("edited "), path)), _a("<done/>"))


def failure_recovery_conversation(path: Column, desc: Column, original: Column, wrong: Column, old: Column,
                                  new: Column) -> Column:
    """SFT3: wrong edit, error, read, right edit (9 messages)."""
    return F.array(
        *_head(desc),
        _a(_edit_call(path, wrong, new)),
        _fail(F.concat(F.lit("text not found in "), path)),
        _a(F.concat(F.lit("Let me read the file to see the exact content.\n\n"), _read_call(path))),
        _ok(original),
        _a(F.concat(F.lit("Now I can see the exact text.\n\n"), _edit_call(path, old, new))),
        _ok(F.concat(F.lit("edited "), path)),
        _a("<done/>"),
    )


def run_scenarios(spark: SparkSession) -> DataFrame:
    """The five literal run-tool conversations (fixed values)."""
    rows = [(d, c, o) for d, c, o in RUN_SCENARIOS]
    df = spark.createDataFrame(rows, "description string, command string, output string")
    msgs = F.array(
        *_head(F.col("description")),
        _a(F.concat(F.lit("<tool_call>\nrun "), F.col("command"), F.lit("\n</tool_call>"))),
        _ok(F.col("output")),
        _a("<done/>"),
    )
    return df.select(F.lit(None).cast("string").alias("repo"), F.lit("run").alias("kind"),
                     F.col("command").alias("path"), msgs.alias("messages"))


def language_of(path: Column) -> Column:
    """Language from the file extension (null when not a source file)."""
    expr = F.lit(None).cast("string")
    for ext, lang in reversed(LANG_EXTENSIONS):
        expr = F.when(path.endswith(ext), F.lit(lang)).otherwise(expr)
    return expr


def in_skipped_dir(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.exists(parts, lambda p: p.isin(*SKIP_DIRS))


def worth_reading() -> Column:
    """What the walk rules can tell from (path, size) alone, before a file is
    opened: a source language, no vendor folder, and a size in bytes that 21 to
    4999 characters of at most four bytes can have."""
    return (language_of(F.col("path")).isNotNull() & ~in_skipped_dir(F.col("path"))
            & (F.col("size") > 20) & (F.col("size") < 4 * 5000))


def walk_filter(files: DataFrame, seed: int = 42, max_files: int | None = MAX_FILES) -> DataFrame:
    """SRC5 semantics on a (repo, path, content) DataFrame: language by
    extension, vendor directories skipped, 20 < chars < 5000, then a seeded
    shuffle and at most ``max_files`` per repository (None: all of them).  Adds
    ``lang`` and ``file_order`` (the shuffled order)."""
    f = files.withColumn("lang", language_of(F.col("path")))
    f = f.filter(F.col("lang").isNotNull() & ~in_skipped_dir(F.col("path"))
                 & (F.length("content") > 20) & (F.length("content") < 5000))
    order = F.struct(hash_bits(seed, F.lit("walk"), F.col("repo"), F.col("path")).alias("h"), F.col("path").alias("p"))
    f = f.withColumn("file_order", order)
    return f if max_files is None else cap_per_group(f, "repo", max_files, F.col("file_order"))


def sft_from_repos(spark: SparkSession, files: DataFrame, seed: int = 42, max_per_repo: int | None = MAX_PER_REPO,
                   max_files: int | None = MAX_FILES,
                   with_run_scenarios: bool = True, shuffle: bool = True) -> DataFrame:
    """SFT4: rename examples (py/js/rs) with a 30 % failure-recovery variant,
    string-literal examples (read-then-edit or direct, 50/50), strictly capped
    at ``max_per_repo`` per repository in shuffled file order (from at most
    ``max_files`` files of each; None lifts either cap), plus the run
    scenarios, then shuffled.  Columns: ``repo, kind, path, messages,
    valid_recovery[, position]``; ``valid_recovery`` tells of a recovery
    example whether its wrong guess would really fail (null for other kinds)."""
    f = walk_filter(files, seed, max_files)
    key = [F.col("repo"), F.col("path")]
    ren = rename_mutation(F.col("content"), F.col("lang"), seed, *key)
    lit = string_literal_mutation(F.col("content"), seed, *key)
    f = f.withColumn("ren", F.when(F.col("lang").isin("py", "js", "rs"), ren)).withColumn("lit", lit)
    path = F.col("path")
    r_desc = F.concat(F.lit("Rename the variable `"), F.col("ren.old_text"), F.lit("` to `"), F.col("ren.new_text"),
                      F.lit("` in "), path)
    s_desc = F.concat(F.lit("Change the string "), F.col("lit.old_text"), F.lit(" to "), F.col("lit.new_text"),
                      F.lit(" in "), path)
    recover = hash_uniform(seed, F.lit("recovery"), *key) < RECOVERY_RATE
    read_first = hash_uniform(seed, F.lit("read"), *key) < READ_RATE
    wrong = F.upper(F.col("ren.old_text"))
    # a guess that equals the name, or occurs in the file, would not fail
    fails = (wrong != F.col("ren.old_text")) & ~F.contains(F.col("ren.original"), wrong)

    def ex(sub, kind, msgs, valid=F.lit(None).cast("boolean")):
        return F.struct(F.lit(sub).alias("sub"), F.lit(kind).alias("kind"), msgs.alias("messages"), valid.alias("valid_recovery"))

    cands = F.concat(
        F.when(F.col("ren").isNotNull(), F.array(ex(0, "rename", read_edit_conversation(
            path, r_desc, F.col("ren.original"), F.col("ren.old_text"), F.col("ren.new_text"))))).otherwise(F.array()),
        F.when(F.col("ren").isNotNull() & recover, F.array(ex(1, "rename_recovery", failure_recovery_conversation(
            path, r_desc, F.col("ren.original"), wrong, F.col("ren.old_text"), F.col("ren.new_text")), fails))).otherwise(F.array()),
        F.when(F.col("lit").isNotNull() & read_first, F.array(ex(2, "string_read_edit", read_edit_conversation(
            path, s_desc, F.col("lit.original"), F.col("lit.old_text"), F.col("lit.new_text"))))).otherwise(F.array()),
        F.when(F.col("lit").isNotNull() & ~read_first, F.array(ex(2, "string_direct", direct_edit_conversation(
            path, s_desc, F.col("lit.old_text"), F.col("lit.new_text"))))).otherwise(F.array()),
    )
    exploded = f.select("repo", "path", "file_order", F.explode(cands).alias("e")).select(
        "repo", "path", "file_order", "e.sub", "e.kind", "e.messages", "e.valid_recovery")
    if max_per_repo is not None:
        exploded = cap_per_group(exploded, "repo", max_per_repo, F.struct("file_order", "sub"))
    capped = exploded.select("repo", "kind", "path", "messages", "valid_recovery")
    run = run_scenarios(spark).withColumn("valid_recovery", F.lit(None).cast("boolean"))
    out = capped.unionByName(run) if with_run_scenarios else capped
    if shuffle:
        key_col = F.md5(F.concat_ws("\u0001", F.coalesce("repo", F.lit("")), F.col("path"), F.col("kind")))
        out = out.withColumn("__k", F.conv(F.substring(key_col, 1, 15), 16, 10).cast("long"))
        out = seeded_shuffle(out, "__k", seed, salt="examples").drop("__k")
    return out


def conversation_text(messages: Column) -> Column:
    """``role: content`` lines joined by \\u0001 (for checksums and counts)."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\u0001")
