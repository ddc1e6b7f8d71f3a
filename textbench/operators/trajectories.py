"""A8, A9, JN4, SFT5-8: agent trajectory analytics.

A trajectory is one row ``task_id, success, steps: array<struct<model_output,
tool_call, tool_result>>``.  Per-trajectory facts are computed with array
functions inside the row; metrics are plain aggregates, so any number of
runs is summarised with map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textbench.functions.text import message
from textbench.functions.toolcalls import DONE, NUDGE, apply_edit, format_tool_result, is_done

# Fixed value: the agent's system prompt (first message of every conversation).
SYSTEM_PROMPT = """You are a coding agent. You modify files in /workspace to complete tasks.

Tools (use inside <tool_call> tags):
- read <path>: Read file contents
- run <command>: Run shell command
- edit <path>: Replace text in file. Format:
  <<<
  exact text to find
  >>>
  replacement text
  ===

Output <done/> when finished.

Files are in /workspace. If unsure what exists, run `ls` first.

Example - fix typo in hello.py:
<tool_call>
read hello.py
</tool_call>

After seeing `prnt("hi")` in the file:
<tool_call>
edit hello.py
<<<
prnt("hi")
>>>
print("hi")
===
</tool_call>

<done/>"""


def n_tool_calls(steps: Column) -> Column:
    return F.size(F.filter(steps, lambda s: s["tool_call"].isNotNull()))


def trajectory_facts(traj: DataFrame, max_steps: int | Column = 20) -> DataFrame:
    """Per trajectory: ``n_steps``, ``n_calls``, ``first_try``, ``death_spiral``."""
    steps = F.col("steps")
    ms = max_steps if isinstance(max_steps, Column) else F.lit(max_steps)
    return traj.select(
        "*",
        F.size(steps).alias("n_steps"),
        n_tool_calls(steps).alias("n_calls"),
        (F.col("success") & (n_tool_calls(steps) <= 2)).alias("first_try"),
        ((F.size(steps) >= ms) & ~F.exists(steps, lambda s: F.instr(s["model_output"], DONE) > 0)).alias("death_spiral"),
    )


def trajectory_metrics(traj: DataFrame, max_steps: int | Column = 20, group_cols: list[str] | None = None) -> DataFrame:
    """Total, pass rate, first-try rate (success with <= 2 calls), mean
    steps, mean tool calls, death-spiral rate; an empty input gives zeros."""
    group_cols = group_cols or []
    f = trajectory_facts(traj, max_steps)
    rate = lambda c: F.coalesce(F.avg(F.when(c, 1.0).otherwise(0.0)), F.lit(0.0))
    return f.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("total"),
        rate(F.col("success")).alias("pass_rate"),
        rate(F.col("first_try")).alias("first_try_rate"),
        F.coalesce(F.avg("n_steps"), F.lit(0.0)).alias("avg_steps"),
        F.coalesce(F.avg("n_calls"), F.lit(0.0)).alias("avg_tool_calls"),
        rate(F.col("death_spiral")).alias("death_spiral_rate"),
    )


def _pct(c: Column) -> Column:
    return F.concat(F.format_number(c * 100, 1), F.lit("%"))


def _ljust(c: Column, n: int) -> Column:
    return F.when(F.length(c) >= n, c).otherwise(F.rpad(c, n, " "))


def _rjust(c: Column, n: int) -> Column:
    return F.when(F.length(c) >= n, c).otherwise(F.lpad(c, n, " "))


def compare_models(metrics: DataFrame, model_col: str = "model") -> DataFrame:
    """A8 per model rendered as the reference's fixed-width table line
    (name left-justified to 30, then five right-justified width-7 cells)."""
    num = lambda c: F.replace(F.format_number(F.col(c), 1), F.lit(","), F.lit(""))
    line = F.concat_ws(
        " ",
        _ljust(F.col(model_col), 30),
        _rjust(_pct(F.col("pass_rate")), 7),
        _rjust(_pct(F.col("first_try_rate")), 7),
        _rjust(num("avg_steps"), 7),
        _rjust(num("avg_tool_calls"), 7),
        _rjust(_pct(F.col("death_spiral_rate")), 7),
    )
    return metrics.withColumn("line", line)


def comparison_header() -> str:
    """Header and rule lines of the A9 table (fixed layout: name width 30, cells width 8)."""
    head = f"{'Model':<30} {'Pass':>8} {'1st Try':>8} {'Steps':>8} {'Tools':>8} {'Spiral':>8}"
    return head + "\n" + "-" * len(head)


def dedupe_tasks(tasks: DataFrame, order_col: str | None = None) -> DataFrame:
    """One task row per id (the reference takes the first match).  An
    aggregation (``min_by``), not a window, so repeated ids are reduced
    map-side and a hot id never gathers in one task."""
    cols = [c for c in tasks.columns if c != "id"]
    order = F.col(order_col) if order_col else F.struct(*[F.col(c) for c in cols])
    return tasks.groupBy("id").agg(F.min_by(F.struct(*[F.col(c) for c in cols]), order).alias("__t")).select("id", "__t.*")


def trajectory_task_join(traj: DataFrame, tasks: DataFrame) -> DataFrame:
    """JN4: attach the task (description, max_steps) to each trajectory.
    The task table is one row per task definition; AQE broadcasts it when
    its measured size is small and falls back to a shuffle join otherwise."""
    t = dedupe_tasks(tasks).select(F.col("id").alias("task_id"), "description", F.col("max_steps").alias("task_max_steps"))
    return traj.join(t, "task_id", "inner")


def trajectory_to_messages(task_description: Column, steps: Column) -> Column:
    """SFT5: system + task, then per step the assistant output followed by the
    formatted tool result, or a nudge when the output had neither a call
    nor the done marker."""
    head = F.array(message(F.lit("system"), F.lit(SYSTEM_PROMPT)), message(F.lit("user"), task_description))

    def per_step(s):
        out = message(F.lit("assistant"), s["model_output"])
        follow = F.when(
            s["tool_result"].isNotNull(),
            F.array(message(F.lit("user"), format_tool_result(s["tool_result"]["success"], s["tool_result"]["output"]))),
        ).when(
            s["tool_call"].isNull() & ~is_done(s["model_output"]), F.array(message(F.lit("user"), F.lit(NUDGE)))
        ).otherwise(F.array().cast("array<struct<role:string,content:string>>"))
        return F.concat(F.array(out), follow)

    return F.concat(head, F.flatten(F.transform(steps, per_step)))


def rejection_sample(traj: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SFT6: successful runs → chat examples; plus kept/attempted per task."""
    joined = trajectory_task_join(traj, tasks)
    kept = joined.filter("success").select(
        "task_id", trajectory_to_messages(F.col("description"), F.col("steps")).alias("messages"))
    report = joined.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("attempted"), F.sum(F.when(F.col("success"), 1).otherwise(0)).cast("long").alias("kept"))
    return kept, report


def flatten_trajectory(traj: DataFrame, id_cols: list[str]) -> DataFrame:
    """SFT7: one row per step with tool, path, command, the result, and
    ``call_lost``: the output holds a parseable call *and* the done marker,
    so the harness (which checks done first) never ran the call."""
    from textbench.functions.toolcalls import add_tool_call

    x = traj.select(*id_cols, F.posexplode("steps").alias("step", "st"))
    x = add_tool_call(x.withColumn("__out", F.col("st.model_output")), "__out", "__reparsed")
    return x.select(
        *id_cols, "step",
        F.col("st.tool_call.tool").alias("tool"), F.col("st.tool_call.path").alias("path"),
        F.col("st.tool_call.command").alias("command"),
        F.col("st.tool_result.success").alias("result_success"),
        (is_done(F.col("__out")) & F.col("__reparsed").isNotNull()).alias("call_lost"),
    )


def replay_edits(edits: Column, snapshot: Column, path: Column) -> Column:
    """SFT8: apply an ordered ``array<struct<old_text,new_text>>`` of edits to
    a file snapshot: ``struct<content, applied, failed, outcomes>``, where
    ``outcomes`` has ``struct<success, output>`` for every edit in order.  A fold
    with ``aggregate``; each step is TXT15 (first occurrence only)."""
    none = F.expr("cast(array() as array<struct<success: boolean, output: string>>)")
    init = F.struct(snapshot.alias("content"), F.lit(0).alias("applied"), F.lit(0).alias("failed"), none.alias("outcomes"))

    def step(acc, e):
        r = apply_edit(acc["content"], e["old_text"], e["new_text"], path)
        return F.struct(
            r["content"].alias("content"),
            (acc["applied"] + F.when(r["success"], 1).otherwise(0)).alias("applied"),
            (acc["failed"] + F.when(r["success"], 0).otherwise(1)).alias("failed"),
            F.concat(acc["outcomes"], F.array(F.struct(F.coalesce(r["success"], F.lit(False)).alias("success"), r["output"].alias("output")))).alias("outcomes"),
        )

    return F.aggregate(edits, init, step)


def rename_replay(content: Column, mutation: Column, path: Column) -> Column:
    """SFT8 for a rename conversation: its one edit replayed against what the
    description asks for (every occurrence renamed).  ``struct<success,
    matches, left>``: the edit applied; the edited file is the fully renamed one;
    occurrences that the edit, which changes only the first, leaves behind."""
    edit = F.struct(mutation["old_text"].alias("old_text"), mutation["new_text"].alias("new_text"))
    r = replay_edits(F.array(edit), content, path)
    old = mutation["old_text"]
    times = (F.length(content) - F.length(F.replace(content, old, F.lit("")))) / F.length(old)
    return F.struct((r["applied"] == 1).alias("success"), (r["content"] == mutation["mutated"]).alias("matches"),
                    (times.cast("long") - r["applied"]).alias("left"))
