"""Registered queries: tool calls, trajectories, chat data, code mutations
(TXT10-15, A8, A9, JN4, SFT1-8, SRC2-5)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textbench.functions import mutations as M
from textbench.functions import toolcalls as TC
from textbench.functions.hashing import sql_hash_uniform
from textbench.operators import sft as SFT
from textbench.operators import trajectories as TR
from textbench.plans.catalog import register
from textbench.plans.fixtures import (SQL_CODE_FILES, SQL_STEPS, SQL_TASKS, code_files, step_records, table,
                                      tasks, trajectories)
from textbench.session import checkpoint_dir
from textbench.sources import readers as RD


def _scratch(spark, name):
    """A fresh folder below the shared checkpoint folder; its last part is that of ``name``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}/{name}"

P = TC.sql_parse_tool_call("model_output")

# DuckDB: one row per step with the harness view (call null when done).
SQL_STEP_RECORDS = f"""
SELECT conv_id, s, model_output, strpos(model_output, '<done/>') > 0 AS done,
  (strpos(model_output, '<done/>') = 0 AND {P['valid']}) AS has_call,
  {P['tool']} AS tool, {P['path']} AS path, {P['command']} AS command,
  {P['old_text']} AS old_text, {P['new_text']} AS new_text,
  (conv_id + s) % 5 <> 0 AS r_success, concat('out ', CAST(s AS VARCHAR)) AS r_output
FROM ({SQL_STEPS})
"""

SQL_TRAJ = f"""
SELECT conv_id AS run, concat('task_', CAST(conv_id % 15 AS VARCHAR)) AS task_id,
  concat('m', CAST(conv_id % 2 AS VARCHAR)) AS model, conv_id % 3 = 0 AS success,
  count(*) AS n_steps, count(*) FILTER (WHERE has_call) AS n_calls, bool_or(done) AS any_done
FROM ({SQL_STEP_RECORDS}) GROUP BY conv_id
"""


@register("txt10_parse_tool_call", f"""
SELECT conv_id, s, {P['tool']} AS tool, {P['path']} AS path, {P['command']} AS command,
       {P['old_text']} AS old_text, {P['new_text']} AS new_text FROM ({SQL_STEPS})
""")
def txt10_parse_tool_call(spark, sf_dir):
    from textbench.plans.fixtures import steps

    st = TC.add_tool_call(steps(spark, sf_dir), "model_output", "c")
    return st.select("conv_id", "s", "c.tool", "c.path", "c.command", "c.old_text", "c.new_text")


@register("txt11_format_tool_result", f"""
SELECT conv_id, s, done, CASE WHEN has_call THEN md5(concat('<tool_result>', chr(10),
  CASE WHEN r_success THEN '✓' ELSE '✗' END, ' ', r_output, chr(10), '</tool_result>')) END AS result_md5
FROM ({SQL_STEP_RECORDS})
""")
def txt11_format_tool_result(spark, sf_dir):
    st = step_records(spark, sf_dir)
    fmt = TC.format_tool_result(F.col("tool_result.success"), F.col("tool_result.output"))
    return st.select("conv_id", "s", TC.is_done("model_output").alias("done"),
                     F.when(F.col("tool_result").isNotNull(), F.md5(fmt)).alias("result_md5"))


def _snapshots_sql() -> str:
    return """SELECT conv_id, text AS snapshot FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
                FROM conversations WHERE role = 'assistant') WHERE rn = 1"""


def _snapshots(spark, sf_dir):
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("conv_id", F.col("text").alias("snapshot"))


@register("txt15_apply_edit", f"""
WITH e AS (SELECT conv_id, s, path, old_text, new_text FROM ({SQL_STEP_RECORDS}) WHERE has_call AND tool = 'edit'),
j AS (SELECT e.*, snapshot, strpos(snapshot, old_text) AS pos FROM e JOIN ({_snapshots_sql()}) USING (conv_id))
SELECT conv_id, s, pos > 0 AS success,
  CASE WHEN pos > 0 THEN concat('edited ', path) ELSE concat('text not found in ', path) END AS output,
  md5(CASE WHEN pos > 0 THEN concat(substr(snapshot, 1, pos - 1), new_text, substr(snapshot, pos + length(old_text)))
      ELSE snapshot END) AS content_md5
FROM j
""")
def txt15_apply_edit(spark, sf_dir):
    """Each parsed edit applied to its conversation's file snapshot (first assistant turn)."""
    e = step_records(spark, sf_dir).filter(F.col("call.tool") == "edit")
    j = e.join(_snapshots(spark, sf_dir), "conv_id")
    r = TC.apply_edit(F.col("snapshot"), F.col("call.old_text"), F.col("call.new_text"), F.col("call.path"))
    return j.select("conv_id", "s", r["success"].alias("success"), r["output"].alias("output"),
                    F.md5(r["content"]).alias("content_md5"))


@register("sft8_replay_edits", f"""
WITH e AS (SELECT conv_id, list({{'old_text': old_text, 'new_text': new_text, 'path': path}} ORDER BY s) AS edits
           FROM ({SQL_STEP_RECORDS}) WHERE has_call AND tool = 'edit' GROUP BY conv_id),
j AS (SELECT conv_id, snapshot, edits FROM e JOIN ({_snapshots_sql()}) USING (conv_id)),
r AS (SELECT conv_id, list_reduce(edits, lambda acc, x: {{
        'content': CASE WHEN strpos(acc.content, x.old_text) > 0
                        THEN concat(substr(acc.content, 1, strpos(acc.content, x.old_text) - 1), x.new_text,
                                    substr(acc.content, strpos(acc.content, x.old_text) + length(x.old_text)))
                        ELSE acc.content END,
        'applied': acc.applied + CASE WHEN strpos(acc.content, x.old_text) > 0 THEN 1 ELSE 0 END,
        'failed': acc.failed + CASE WHEN strpos(acc.content, x.old_text) > 0 THEN 0 ELSE 1 END,
        'outcomes': concat(acc.outcomes, CASE WHEN strpos(acc.content, x.old_text) > 0 THEN '+edited f;' ELSE '-text not found in f;' END)}},
        {{'content': snapshot, 'applied': 0, 'failed': 0, 'outcomes': ''}}) AS res FROM j)
SELECT conv_id, res.applied AS applied, res.failed AS failed, res.outcomes AS outcomes, md5(res.content) AS final_md5 FROM r
""")
def sft8_replay_edits(spark, sf_dir):
    """Every run's edits, in step order, replayed on its file snapshot: the outcome of each and the final text."""
    e = step_records(spark, sf_dir).filter(F.col("call.tool") == "edit")
    edits = e.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "s", F.col("call.old_text").alias("old_text"), F.col("call.new_text").alias("new_text")))).alias("edits"))
    j = edits.join(_snapshots(spark, sf_dir), "conv_id")
    j = j.select("conv_id", TR.replay_edits(F.col("edits"), F.col("snapshot"), F.lit("f")).alias("r"))
    shown = F.transform("r.outcomes", lambda o: F.concat(F.when(o["success"], "+").otherwise("-"), o["output"], F.lit(";")))
    return j.select("conv_id", "r.applied", "r.failed", F.array_join(shown, "").alias("outcomes"), F.md5("r.content").alias("final_md5"))


def _sql_metrics(group: str = "", max_steps: str = "20", join_tasks: bool = False) -> str:
    sel = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    src = f"({SQL_TRAJ})"
    if join_tasks:
        src = f"(SELECT t.*, k.max_steps AS task_max_steps FROM ({SQL_TRAJ}) t JOIN ({SQL_TASKS}) k ON t.task_id = k.id)"
    return f"""
SELECT {sel}count(*) AS total,
  round(coalesce(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 0.0), 6) AS pass_rate,
  round(coalesce(avg(CASE WHEN success AND n_calls <= 2 THEN 1.0 ELSE 0.0 END), 0.0), 6) AS first_try_rate,
  round(coalesce(avg(n_steps), 0.0), 6) AS avg_steps,
  round(coalesce(avg(n_calls), 0.0), 6) AS avg_tool_calls,
  round(coalesce(avg(CASE WHEN n_steps >= {max_steps} AND NOT any_done THEN 1.0 ELSE 0.0 END), 0.0), 6) AS death_spiral_rate
FROM {src} {gb}
"""


_A8 = ["pass_rate", "first_try_rate", "avg_steps", "avg_tool_calls", "death_spiral_rate"]


@register("a8_trajectory_metrics", _sql_metrics())
def a8_trajectory_metrics(spark, sf_dir):
    m = TR.trajectory_metrics(trajectories(spark, sf_dir), max_steps=20)
    return m.select("total", *[F.round(c, 6).alias(c) for c in _A8])


@register("a8_trajectory_metrics_task_steps", _sql_metrics("", "task_max_steps", join_tasks=True))
def a8_trajectory_metrics_task_steps(spark, sf_dir):
    """A8 with each task's own step budget (JN4) for the death-spiral test."""
    j = TR.trajectory_task_join(trajectories(spark, sf_dir), tasks(spark, sf_dir))
    m = TR.trajectory_metrics(j, max_steps=F.col("task_max_steps"))
    return m.select("total", *[F.round(c, 6).alias(c) for c in _A8])


def _sql_line() -> str:
    pct = lambda c: f"lpad(printf('%.1f', {c} * 100) || '%', 7, ' ')"
    num = lambda c: f"lpad(printf('%.1f', {c}), 7, ' ')"
    return (f"concat_ws(' ', rpad(model, 30, ' '), {pct('pass_rate')}, {pct('first_try_rate')}, {num('avg_steps')}, "
            f"{num('avg_tool_calls')}, {pct('death_spiral_rate')})")


@register("a9_compare_models", f"""
SELECT model, total, {_sql_line()} AS line FROM ({_sql_metrics('model').replace('round(', '(').replace(', 6)', ')')})
""")
def a9_compare_models(spark, sf_dir):
    m = TR.trajectory_metrics(trajectories(spark, sf_dir), group_cols=["model"])
    return TR.compare_models(m).select("model", "total", "line")


@register("jn4_trajectory_task_join", f"""
SELECT run, task_id, description, max_steps AS task_max_steps, success FROM ({SQL_TRAJ}) t JOIN ({SQL_TASKS}) k ON t.task_id = k.id
""")
def jn4_trajectory_task_join(spark, sf_dir):
    j = TR.trajectory_task_join(trajectories(spark, sf_dir), tasks(spark, sf_dir))
    return j.select("run", "task_id", "description", "task_max_steps", "success")


def _sql_messages() -> str:
    """Per step: the messages it adds (assistant + result / nudge)."""
    return f"""
SELECT conv_id, s, concat('assistant: ', model_output,
  CASE WHEN has_call THEN concat(chr(1), 'user: <tool_result>', chr(10), CASE WHEN r_success THEN '✓' ELSE '✗' END, ' ',
                                 r_output, chr(10), '</tool_result>')
       WHEN NOT done THEN concat(chr(1), 'user: Use a tool or output <done/>.') ELSE '' END) AS part,
  1 + CASE WHEN has_call OR NOT done THEN 1 ELSE 0 END AS n_msgs
FROM ({SQL_STEP_RECORDS})
"""


@register("sft5_trajectory_to_messages", f"""
WITH p AS ({_sql_messages()}),
g AS (SELECT conv_id, string_agg(part, chr(1) ORDER BY s) AS body, sum(n_msgs) AS n FROM p GROUP BY conv_id)
SELECT g.conv_id AS run, CAST(2 + n AS INTEGER) AS n_messages,
  md5(concat('system: ', $sys$%SYS%$sys$, chr(1), 'user: ', k.description, chr(1), body)) AS messages_md5
FROM g JOIN ({SQL_TASKS}) k ON concat('task_', CAST(g.conv_id % 15 AS VARCHAR)) = k.id
""".replace("%SYS%", TR.SYSTEM_PROMPT))
def sft5_trajectory_to_messages(spark, sf_dir):
    j = TR.trajectory_task_join(trajectories(spark, sf_dir), tasks(spark, sf_dir))
    msgs = TR.trajectory_to_messages(F.col("description"), F.col("steps"))
    return j.select("run", F.size(msgs).alias("n_messages"), F.md5(SFT.conversation_text(msgs)).alias("messages_md5"))


@register("sft6_rejection_sample", f"""
WITH t AS (SELECT tr.*, k.id FROM ({SQL_TRAJ}) tr JOIN ({SQL_TASKS}) k ON tr.task_id = k.id),
p AS ({_sql_messages()}),
m AS (SELECT conv_id, sum(n_msgs) AS n FROM p GROUP BY conv_id)
SELECT task_id, count(*) AS attempted, CAST(sum(CASE WHEN success THEN 1 ELSE 0 END) AS BIGINT) AS kept,
  CAST(coalesce(sum(CASE WHEN success THEN 2 + n END), 0) AS BIGINT) AS kept_messages
FROM t JOIN m ON t.run = m.conv_id GROUP BY task_id
""")
def sft6_rejection_sample(spark, sf_dir):
    kept, report = TR.rejection_sample(trajectories(spark, sf_dir), tasks(spark, sf_dir))
    sizes = kept.groupBy("task_id").agg(F.sum(F.size("messages")).cast("long").alias("kept_messages"))
    return report.join(sizes, "task_id", "left").select(
        "task_id", "attempted", "kept", F.coalesce("kept_messages", F.lit(0).cast("long")).alias("kept_messages"))


@register("sft7_flatten_trajectory", f"""
SELECT conv_id AS run, CAST(s - 1 AS INTEGER) AS step, CASE WHEN has_call THEN tool END AS tool,
  CASE WHEN has_call THEN path END AS path, CASE WHEN has_call THEN command END AS command,
  CASE WHEN has_call THEN r_success END AS result_success, (done AND {P['valid']}) AS call_lost
FROM ({SQL_STEP_RECORDS})
""")
def sft7_flatten_trajectory(spark, sf_dir):
    return TR.flatten_trajectory(trajectories(spark, sf_dir), ["run"])


@register("src4_read_trajectories", f"""
SELECT run, task_id, success, CAST(n_steps AS INTEGER) AS n_steps, CAST(n_calls AS INTEGER) AS n_calls FROM ({SQL_TRAJ})
""")
def src4_read_trajectories(spark, sf_dir):
    """Trajectories written as JSON lines and read back by the reader."""
    path = _scratch(spark, "trajectories")
    t = trajectories(spark, sf_dir).select(F.to_json(F.struct("run", "task_id", "success", "steps")).alias("value"))
    # the run is a field of the line: as a folder it would be a file per conversation
    t.write.text(path)
    back = RD.read_trajectories(spark, path, run="long")
    return back.select("run", "task_id", "success", F.size("steps").alias("n_steps"),
                       TR.n_tool_calls(F.col("steps")).alias("n_calls"))


@register("src2_read_conversations", """
SELECT md5(string_agg(concat(role, ': ', text), chr(1) ORDER BY turn)) AS messages_md5, count(*) AS n_messages,
       count(*) FILTER (WHERE role = 'assistant') AS n_assistant
FROM conversations GROUP BY conv_id
""")
def src2_read_conversations(spark, sf_dir):
    """Conversations written as {"messages": [...]} JSON lines and read back by the reader."""
    c = table(spark, sf_dir, "conversations")
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "turn", F.col("role"), F.col("text").alias("content")))).alias("m"))
    path = _scratch(spark, "conversations")
    g.select(F.to_json(F.struct(F.transform("m", lambda x: F.struct(
        x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))).alias("value")).write.text(path)
    msgs = F.col("messages")
    return RD.read_conversations(spark, path).select(
        F.md5(SFT.conversation_text(msgs)).alias("messages_md5"), F.size(msgs).alias("n_messages"),
        F.size(F.filter(msgs, lambda m: m["role"] == "assistant")).alias("n_assistant"))


@register("src3_read_tasks", f"""
SELECT id, description, 'agent-base' AS docker_image, max_steps FROM ({SQL_TASKS})
""")
def src3_read_tasks(spark, sf_dir):
    """Task files (an object or an array each, some fields absent) written to a
    folder and read back by the reader, with defaults."""
    t = tasks(spark, sf_dir)
    as_obj = F.to_json(F.struct("id", "description", "max_steps"))
    as_arr = F.to_json(F.array(F.struct("id", "description", "max_steps")))
    path = _scratch(spark, "tasks")
    t.select("id", F.when(F.col("max_steps") == 5, as_arr).otherwise(as_obj).alias("value")).write.partitionBy("id").text(path)
    out = RD.read_tasks(spark, path, pattern="part-*")
    return out.select("id", "description", "docker_image", "max_steps")


# -- code files, mutations, SFT builders ------------------------------------

_J = "(?m)"


def _sql_rename() -> str:
    pats = {k: _J + v for k, v in M.ASSIGN_PATTERNS.items()}
    names = (f"CASE lang WHEN 'py' THEN regexp_extract_all(content, '{pats['py']}', 2) "
             f"WHEN 'js' THEN regexp_extract_all(content, '{pats['js']}', 2) "
             f"WHEN 'rs' THEN regexp_extract_all(content, '{pats['rs']}', 2) END")
    skip = ", ".join(f"'{n}'" for n in M.SKIP_NAMES)
    return f"""
SELECT *, CASE WHEN nm IS NOT NULL AND nm NOT IN ({skip}) AND length(nm) >= 2 THEN nm END AS ren_old FROM (
  SELECT *, names[CAST(floor({sql_hash_uniform(42, "'rename'", 'repo', 'path')} * len(names)) AS INTEGER) + 1] AS nm
  FROM (SELECT *, {names} AS names FROM c))
"""


def _sql_literal() -> str:
    dq, sq = M.DQ_LITERAL, M.SQ_LITERAL.replace("'", "''")
    lits = f"CASE WHEN len(regexp_extract_all(content, '{dq}')) > 0 THEN regexp_extract_all(content, '{dq}') ELSE regexp_extract_all(content, '{sq}') END"
    return f"""
SELECT *, lits[n + 1] AS lit_old,
  concat(substr(lits[n + 1], 1, length(lits[n + 1]) - 1), '_modified', right(lits[n + 1], 1)) AS lit_new
FROM (SELECT *, CAST(floor({sql_hash_uniform(42, "'string'", 'repo', 'path')} * len(lits)) AS INTEGER) AS n
      FROM (SELECT *, {lits} AS lits FROM c))
"""


@register("txt12_rename_mutation", f"""
WITH c AS ({SQL_CODE_FILES}), r AS ({_sql_rename()})
SELECT doc_id, ren_old AS old_text, concat(ren_old, '_renamed') AS new_text,
  md5(replace(content, ren_old, concat(ren_old, '_renamed'))) AS mutated_md5 FROM r WHERE ren_old IS NOT NULL
""")
def txt12_rename_mutation(spark, sf_dir):
    c = code_files(spark, sf_dir)
    m = M.rename_mutation(F.col("content"), F.col("lang"), 42, F.col("repo"), F.col("path"))
    return c.select("doc_id", m.alias("m")).filter(F.col("m").isNotNull()).select(
        "doc_id", "m.old_text", "m.new_text", F.md5("m.mutated").alias("mutated_md5"))


@register("sft8_rename_mismatch", f"""
WITH c AS ({SQL_CODE_FILES}), r AS ({_sql_rename()}),
x AS (SELECT repo, content, ren_old AS old, concat(ren_old, '_renamed') AS new,
        (length(content) - length(replace(content, ren_old, ''))) // length(ren_old) AS times FROM r WHERE ren_old IS NOT NULL),
y AS (SELECT repo, times, concat(substr(content, 1, strpos(content, old) - 1), new, substr(content, strpos(content, old) + length(old)))
        = replace(content, old, new) AS matches FROM x)
SELECT repo, count(*) AS renames, count(*) AS applied, count(*) FILTER (WHERE matches) AS complete,
       CAST(sum(times - 1) AS BIGINT) AS left_over FROM y GROUP BY repo
""")
def sft8_rename_mismatch(spark, sf_dir):
    """Rename conversations whose one edit (first occurrence) does not give the fully renamed file, per repository."""
    m = M.rename_mutation(F.col("content"), F.col("lang"), 42, F.col("repo"), F.col("path"))
    f = code_files(spark, sf_dir).withColumn("m", m).where(F.col("m").isNotNull())
    f = f.select("repo", TR.rename_replay(F.col("content"), F.col("m"), F.col("path")).alias("r"))
    return f.groupBy("repo").agg(
        F.count(F.lit(1)).alias("renames"), F.count(F.when(F.col("r.success"), 1)).alias("applied"),
        F.count(F.when(F.col("r.matches"), 1)).alias("complete"), F.sum("r.left").cast("long").alias("left_over"))


@register("txt13_string_literal_mutation", f"""
WITH c AS ({SQL_CODE_FILES}), l AS ({_sql_literal()})
SELECT doc_id, lit_old AS old_text, lit_new AS new_text,
  md5({M.sql_splice('content', M.DQ_LITERAL, 'n', 'lit_new')}) AS mutated_md5 FROM l WHERE len(lits) > 0
""")
def txt13_string_literal_mutation(spark, sf_dir):
    c = code_files(spark, sf_dir)
    m = M.string_literal_mutation(F.col("content"), 42, F.col("repo"), F.col("path"))
    return c.select("doc_id", m.alias("m")).filter(F.col("m").isNotNull()).select(
        "doc_id", "m.old_text", "m.new_text", F.md5("m.mutated").alias("mutated_md5"))


def _sql_typo() -> str:
    pat = M.CALL_NAME
    u = sql_hash_uniform(42, "'typo-pos'", "repo", "path")
    return f"""
WITH c AS ({SQL_CODE_FILES}),
a AS (SELECT *, regexp_extract_all(content, '{pat}') AS calls FROM c),
b AS (SELECT *, CAST(floor({sql_hash_uniform(42, "'typo'", 'repo', 'path')} * len(calls)) AS INTEGER) AS n FROM a WHERE len(calls) > 0),
d AS (SELECT *, calls[n + 1] AS m, regexp_extract(calls[n + 1], '^(\\w+)', 1) AS name FROM b),
e AS (SELECT *, CAST(1 + floor({u} * (length(name) - 2)) AS INTEGER) AS idx FROM d),
f AS (SELECT *, concat(substr(name, 1, idx), substr(name, idx + 2, 1), substr(name, idx + 1, 1), substr(name, idx + 3)) AS typo FROM e)
"""


@register("txt14_typo_mutation", _sql_typo() + f"""
SELECT doc_id, typo AS old_text, name AS new_text,
  md5({M.sql_splice('content', M.CALL_NAME, 'n', "concat(typo, substr(m, length(name) + 1))")}) AS broken_md5
FROM f WHERE typo <> name
""")
def txt14_typo_mutation(spark, sf_dir):
    c = code_files(spark, sf_dir)
    m = M.typo_mutation(F.col("content"), 42, F.col("repo"), F.col("path"))
    return c.select("doc_id", m.alias("m")).filter(F.col("m").isNotNull()).select(
        "doc_id", "m.old_text", "m.new_text", F.md5("m.original").alias("broken_md5"))


def _sql_walk(cap: bool = True) -> str:
    from textbench.functions.hashing import sql_hash_bits

    h = sql_hash_bits(42, "'walk'", "repo", "path")
    return f"""
WITH c0 AS ({SQL_CODE_FILES}),
c1 AS (SELECT * FROM c0 WHERE length(content) > 20 AND length(content) < 5000
       AND NOT list_has_any(string_split(path, '/'), ['node_modules','vendor','.git','target','__pycache__'])),
c AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {h}, path) AS file_rank FROM c1{' QUALIFY file_rank <= 200' if cap else ''})
"""


_SRC5_PATH = "CASE doc_id % 5 WHEN 0 THEN '__init__' WHEN 1 THEN '_internal/code' WHEN 2 THEN '.hidden/m' ELSE 'src/code/f' END"


@register("src5_read_code_files", _sql_walk().replace("WITH c0 AS (", "WITH c00 AS (").replace("c1 AS (SELECT * FROM c0 ", f"""c0 AS (SELECT doc_id, repo, lang, content,
  concat({_SRC5_PATH}, doc_id, '.', lang) AS path FROM c00),
c1 AS (SELECT * FROM c0 """) + """
SELECT repo, lang, count(*) AS files, CAST(sum(length(content)) AS BIGINT) AS chars,
       count(*) FILTER (WHERE starts_with(path, '_') OR starts_with(path, '.')) AS hidden FROM c GROUP BY repo, lang
""")
def src5_read_code_files(spark, sf_dir):
    """Repositories written as files (hidden names among them, and folders named
    like the root), listed and read by the reader, then the walk rules."""
    root = _scratch(spark, "code/mirror/code")
    place = F.expr(_SRC5_PATH)
    files = code_files(spark, sf_dir).select("repo", F.concat(place, F.col("doc_id").cast("string"), F.lit("."), F.col("lang")).alias("path"), "content")
    RD.write_code_files(files, root)
    f = SFT.walk_filter(RD.read_code_files(spark, root, keep=SFT.worth_reading()), seed=42)
    return f.groupBy("repo", "lang").agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.length("content")).cast("long").alias("chars"),
        F.count(F.when(F.col("path").startswith("_") | F.col("path").startswith("."), 1)).alias("hidden"))


def _conv_len_sql(kind: str) -> str:
    """Total characters of all message contents, per conversation kind (DuckDB)."""
    sysl = len(TR.SYSTEM_PROMPT)
    read = "length('I''ll read the file first.' || chr(10) || chr(10) || '<tool_call>' || chr(10) || 'read ' || path || chr(10) || '</tool_call>')"
    res = lambda body: f"length('<tool_result>' || chr(10) || '✓ ' || {body} || chr(10) || '</tool_result>')"
    edit = lambda old, new: f"length('<tool_call>' || chr(10) || 'edit ' || path || chr(10) || '<<<' || chr(10) || {old} || chr(10) || '>>>' || chr(10) || {new} || chr(10) || '===' || chr(10) || '</tool_call>')"
    if kind == "read_edit":
        return (f"({sysl} + length(descr) + {read} + {res('content')} + length('I''ll make the edit now.') + 2 + "
                f"{edit('old', 'new')} + {res(chr(39) + 'edited ' + chr(39) + ' || path')} + length('The change has been applied.') + 2 + 7)")
    if kind == "direct":
        return f"({sysl} + length(descr) + {edit('old', 'new')} + {res(chr(39) + 'edited ' + chr(39) + ' || path')} + 7)"
    # recovery
    rread = "length('Let me read the file to see the exact content.' || chr(10) || chr(10) || '<tool_call>' || chr(10) || 'read ' || path || chr(10) || '</tool_call>')"
    fail = "length('<tool_result>' || chr(10) || '✗ text not found in ' || path || chr(10) || '</tool_result>')"
    return (f"({sysl} + length(descr) + {edit('upper(old)', 'new')} + {fail} + {rread} + {res('content')} + "
            f"length('Now I can see the exact text.') + 2 + {edit('old', 'new')} + {res(chr(39) + 'edited ' + chr(39) + ' || path')} + 7)")


def _sql_candidates(cap: bool = True) -> str:
    rec = sql_hash_uniform(42, "'recovery'", "repo", "path")
    rd = sql_hash_uniform(42, "'read'", "repo", "path")
    return _sql_walk(cap) + f"""
, r AS ({_sql_rename().replace('FROM c))', 'FROM c WHERE lang IN (' + chr(39) + 'py' + chr(39) + ', ' + chr(39) + 'js' + chr(39) + ', ' + chr(39) + 'rs' + chr(39) + ')))')}),
l AS ({_sql_literal()}),
ren AS (SELECT repo, path, file_rank, content, ren_old AS old, concat(ren_old, '_renamed') AS new,
               concat('Rename the variable `', ren_old, '` to `', ren_old, '_renamed', '` in ', path) AS descr,
               {rec} < 0.3 AS recover FROM r WHERE ren_old IS NOT NULL),
lit AS (SELECT repo, path, file_rank, content, lit_old AS old, lit_new AS new,
               concat('Change the string ', lit_old, ' to ', lit_new, ' in ', path) AS descr,
               {rd} < 0.5 AS read_first FROM l WHERE len(lits) > 0),
cand AS (
  SELECT repo, file_rank, 0 AS sub, 'rename' AS kind, 7 AS n_msgs, {_conv_len_sql('read_edit')} AS chars, NULL AS valid FROM ren
  UNION ALL
  SELECT repo, file_rank, 1, 'rename_recovery', 9, {_conv_len_sql('recovery')},
         upper(old) <> old AND NOT contains(content, upper(old)) FROM ren WHERE recover
  UNION ALL
  SELECT repo, file_rank, 2, CASE WHEN read_first THEN 'string_read_edit' ELSE 'string_direct' END,
         CASE WHEN read_first THEN 7 ELSE 5 END,
         CASE WHEN read_first THEN {_conv_len_sql('read_edit')} ELSE {_conv_len_sql('direct')} END, NULL FROM lit),
capped AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY repo ORDER BY file_rank, sub) <= 30)
"""


@register("sft4_sft_from_repos", _sql_candidates() + f"""
SELECT repo, kind, count(*) AS examples, CAST(sum(n_msgs) AS BIGINT) AS messages, CAST(sum(chars) AS BIGINT) AS chars
FROM capped GROUP BY repo, kind
UNION ALL
SELECT NULL, 'run', 5, 25, CAST({sum(len(TR.SYSTEM_PROMPT) + len(d) + len('<tool_call>\nrun ' + c + '\n</tool_call>') + len('<tool_result>\n✓ ' + o + '\n</tool_result>') + 7 for d, c, o in SFT.RUN_SCENARIOS)} AS BIGINT)
""")
def sft4_sft_from_repos(spark, sf_dir):
    """SFT examples from the code-file view: counts, messages and characters per repo and kind."""
    ex = SFT.sft_from_repos(spark, code_files(spark, sf_dir).drop("lang"), seed=42)
    chars = F.aggregate(F.col("messages"), F.lit(0).cast("long"), lambda a, m: a + F.length(m["content"]))
    return ex.groupBy("repo", "kind").agg(
        F.count(F.lit(1)).alias("examples"), F.sum(F.size("messages")).cast("long").alias("messages"),
        F.sum(chars).cast("long").alias("chars"))


@register("sft1_read_edit_conversation", _sql_candidates(cap=False) + """
SELECT repo, count(*) AS examples, CAST(sum(chars) AS BIGINT) AS chars FROM cand WHERE kind IN ('rename', 'string_read_edit') GROUP BY repo
""")
def sft1_read_edit_conversation(spark, sf_dir):
    """Read-then-edit conversations for every rename and read-first string mutation (no cap)."""
    ex = SFT.sft_from_repos(spark, code_files(spark, sf_dir).drop("lang"), seed=42, max_per_repo=None, max_files=None,
                            with_run_scenarios=False, shuffle=False)
    chars = F.aggregate(F.col("messages"), F.lit(0).cast("long"), lambda a, m: a + F.length(m["content"]))
    return ex.filter(F.col("kind").isin("rename", "string_read_edit")).groupBy("repo").agg(
        F.count(F.lit(1)).alias("examples"), F.sum(chars).cast("long").alias("chars"))


@register("sft2_direct_edit_conversation", _sql_candidates(cap=False) + """
SELECT repo, count(*) AS examples, CAST(sum(chars) AS BIGINT) AS chars FROM cand WHERE kind = 'string_direct' GROUP BY repo
""")
def sft2_direct_edit_conversation(spark, sf_dir):
    ex = SFT.sft_from_repos(spark, code_files(spark, sf_dir).drop("lang"), seed=42, max_per_repo=None, max_files=None,
                            with_run_scenarios=False, shuffle=False)
    chars = F.aggregate(F.col("messages"), F.lit(0).cast("long"), lambda a, m: a + F.length(m["content"]))
    return ex.filter(F.col("kind") == "string_direct").groupBy("repo").agg(
        F.count(F.lit(1)).alias("examples"), F.sum(chars).cast("long").alias("chars"))


@register("sft3_failure_recovery_conversation", _sql_candidates(cap=False) + """
SELECT repo, count(*) AS examples, CAST(sum(chars) AS BIGINT) AS chars, count(*) FILTER (WHERE valid) AS valid
FROM cand WHERE kind = 'rename_recovery' GROUP BY repo
""")
def sft3_failure_recovery_conversation(spark, sf_dir):
    ex = SFT.sft_from_repos(spark, code_files(spark, sf_dir).drop("lang"), seed=42, max_per_repo=None, max_files=None,
                            with_run_scenarios=False, shuffle=False)
    chars = F.aggregate(F.col("messages"), F.lit(0).cast("long"), lambda a, m: a + F.length(m["content"]))
    return ex.filter(F.col("kind") == "rename_recovery").groupBy("repo").agg(
        F.count(F.lit(1)).alias("examples"), F.sum(chars).cast("long").alias("chars"),
        F.count(F.when(F.col("valid_recovery"), 1)).alias("valid"))
