"""TXT10, TXT11, TXT15: tool-call parsing, result formatting, edit semantics.

All parsing is ``regexp_extract`` + ``when`` chains over the model output,
so a trajectory log of any size is parsed inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical output:
#   tool-call block:  <tool_call> ... </tool_call>  (first block only)
#   path prefix stripped from arguments: /workspace/
#   edit block, strict:  <<<\n OLD \n>>>\n NEW \n===
#   edit block, loose:   <<< OLD >>> NEW ===  (whitespace around parts dropped)
#   done marker: <done/>
#   result wrapper: <tool_result>\n{✓|✗} {output}\n</tool_result>
#   failed edit output: text not found in {path}
#   successful edit output: edited {path}
#   nudge after an output with neither call nor done: Use a tool or output <done/>.
# ---------------------------------------------------------------------------
CALL_RE = "(?s)<tool_call>\\s*(.*?)\\s*</tool_call>"
EDIT_STRICT_RE = "(?s)<<<\n(.*?)\n>>>\n(.*?)\n==="
EDIT_LOOSE_RE = "(?s)<<<\\s*(.*?)\\s*>>>\\s*(.*?)\\s*==="
WORKSPACE = "/workspace/"
DONE = "<done/>"
NUDGE = "Use a tool or output <done/>."
OK_MARK, FAIL_MARK = "✓", "✗"

TOOL_CALL_TYPE = "struct<tool:string,path:string,command:string,old_text:string,new_text:string>"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def parse_tool_call(text) -> Column:
    """First ``<tool_call>`` block → ``struct<tool, path, command, old_text, new_text>``.

    Null when there is no block, the block is empty, the tool is unknown or
    an edit block matches neither the strict nor the loose pattern.
    """
    t = _c(text)
    has = t.rlike(CALL_RE)
    content = _strip(F.regexp_extract(t, CALL_RE, 1))
    first = _strip(F.substring_index(content, "\n", 1))
    tool = F.regexp_extract(first, "^(\\S+)", 1)
    raw_args = F.regexp_extract(first, "^\\S+\\s+(.*)$", 1)
    args = F.when(raw_args == "", F.lit(None).cast("string")).when(
        raw_args.startswith(WORKSPACE), F.substring(raw_args, len(WORKSPACE) + 1, 1 << 30)
    ).otherwise(raw_args)
    strict = content.rlike(EDIT_STRICT_RE)
    loose = content.rlike(EDIT_LOOSE_RE)
    old = F.when(strict, F.regexp_extract(content, EDIT_STRICT_RE, 1)).otherwise(F.regexp_extract(content, EDIT_LOOSE_RE, 1))
    new = F.when(strict, F.regexp_extract(content, EDIT_STRICT_RE, 2)).otherwise(F.regexp_extract(content, EDIT_LOOSE_RE, 2))
    null_s = F.lit(None).cast("string")

    def mk(tool_name, path, command, old_text, new_text):
        return F.struct(F.lit(tool_name).alias("tool"), path.alias("path"), command.alias("command"),
                        old_text.alias("old_text"), new_text.alias("new_text"))

    return (
        F.when(~has | (first == ""), F.lit(None).cast(TOOL_CALL_TYPE))
        .when(tool == "read", mk("read", args, null_s, null_s, null_s))
        .when(tool == "run", mk("run", null_s, args, null_s, null_s))
        .when((tool == "edit") & (strict | loose), mk("edit", args, null_s, old, new))
        .otherwise(F.lit(None).cast(TOOL_CALL_TYPE))
    )


def add_tool_call(df, text_col: str, out_col: str = "tool_call", skip_done: bool = False):
    """DataFrame form of :func:`parse_tool_call` for pipelines.

    Each intermediate (block content, first line, tool, arguments, edit
    pattern flags) is its own projected column, so every regex runs once per
    row and the generated code stays small; Catalyst keeps the projections
    apart because the regex expressions are referenced more than once.
    With ``skip_done`` the call is null whenever the output contains the done
    marker (the harness checks done first).
    """
    t = F.col(text_col)
    d = df.withColumn("__tc_has", t.rlike(CALL_RE)).withColumn(
        "__tc_content", _strip(F.regexp_extract(t, CALL_RE, 1)))
    d = d.withColumn("__tc_first", _strip(F.substring_index(F.col("__tc_content"), "\n", 1)))
    d = d.withColumn("__tc_tool", F.regexp_extract(F.col("__tc_first"), "^(\\S+)", 1)).withColumn(
        "__tc_raw", F.regexp_extract(F.col("__tc_first"), "^\\S+\\s+(.*)$", 1))
    d = d.withColumn("__tc_strict", F.col("__tc_content").rlike(EDIT_STRICT_RE)).withColumn(
        "__tc_loose", F.col("__tc_content").rlike(EDIT_LOOSE_RE))
    raw = F.col("__tc_raw")
    args = F.when(raw == "", F.lit(None).cast("string")).when(
        raw.startswith(WORKSPACE), F.substring(raw, len(WORKSPACE) + 1, 1 << 30)).otherwise(raw)
    strict, content = F.col("__tc_strict"), F.col("__tc_content")
    old = F.when(strict, F.regexp_extract(content, EDIT_STRICT_RE, 1)).otherwise(F.regexp_extract(content, EDIT_LOOSE_RE, 1))
    new = F.when(strict, F.regexp_extract(content, EDIT_STRICT_RE, 2)).otherwise(F.regexp_extract(content, EDIT_LOOSE_RE, 2))
    d = d.withColumn("__tc_args", args)
    null_s = F.lit(None).cast("string")
    a, tool = F.col("__tc_args"), F.col("__tc_tool")

    def mk(tool_name, path, command, old_text, new_text):
        return F.struct(F.lit(tool_name).alias("tool"), path.alias("path"), command.alias("command"),
                        old_text.alias("old_text"), new_text.alias("new_text"))

    none = ~F.col("__tc_has") | (F.col("__tc_first") == "")
    if skip_done:
        none = none | is_done(t)
    call = (
        F.when(none, F.lit(None).cast(TOOL_CALL_TYPE))
        .when(tool == "read", mk("read", a, null_s, null_s, null_s))
        .when(tool == "run", mk("run", null_s, a, null_s, null_s))
        .when((tool == "edit") & (strict | F.col("__tc_loose")), mk("edit", a, null_s, old, new))
        .otherwise(F.lit(None).cast(TOOL_CALL_TYPE))
    )
    return d.withColumn(out_col, call).drop(*[c for c in d.columns if c.startswith("__tc_")])


def is_done(text) -> Column:
    """TXT11: the output signals completion."""
    return F.instr(_c(text), DONE) > 0


def format_tool_result(success, output) -> Column:
    """TXT11: wrap a tool result for the next user turn."""
    return F.concat(
        F.lit("<tool_result>\n"),
        F.when(_c(success), F.lit(OK_MARK)).otherwise(F.lit(FAIL_MARK)),
        F.lit(" "), _c(output), F.lit("\n</tool_result>"),
    )


def apply_edit(content, old, new, path) -> Column:
    """TXT15: replace the first occurrence of ``old``;
    ``struct<success, output, content>`` (content unchanged on failure)."""
    body, o, n = _c(content), _c(old), _c(new)
    pos = F.instr(body, o)
    edited = F.concat(F.substring(body, 1, pos - 1), n, F.substring(body, pos + F.length(o), 1 << 30))
    found = pos > 0
    return F.struct(
        found.alias("success"),
        F.when(found, F.concat(F.lit("edited "), _c(path))).otherwise(F.concat(F.lit("text not found in "), _c(path))).alias("output"),
        F.when(found, edited).otherwise(body).alias("content"),
    )


# DuckDB text of the parser (oracle side).
def sql_parse_tool_call(x: str) -> dict[str, str]:
    """Return DuckDB expressions for tool, path, command, old_text, new_text."""
    content = f"trim(regexp_extract({x}, '(?s)<tool_call>\\s*(.*?)\\s*</tool_call>', 1), ' ' || chr(9) || chr(10) || chr(13))"
    first = f"trim(split_part({content}, chr(10), 1), ' ' || chr(9) || chr(10) || chr(13))"
    tool = f"regexp_extract({first}, '^(\\S+)', 1)"
    raw = f"regexp_extract({first}, '^\\S+\\s+(.*)$', 1)"
    args = f"(CASE WHEN {raw} = '' THEN NULL WHEN starts_with({raw}, '/workspace/') THEN substr({raw}, 12) ELSE {raw} END)"
    strict = f"regexp_matches({content}, '(?s)<<<\\n(.*?)\\n>>>\\n(.*?)\\n===')"
    loose = f"regexp_matches({content}, '(?s)<<<\\s*(.*?)\\s*>>>\\s*(.*?)\\s*===')"
    old = (f"(CASE WHEN {strict} THEN regexp_extract({content}, '(?s)<<<\\n(.*?)\\n>>>\\n(.*?)\\n===', 1) "
           f"ELSE regexp_extract({content}, '(?s)<<<\\s*(.*?)\\s*>>>\\s*(.*?)\\s*===', 1) END)")
    new = (f"(CASE WHEN {strict} THEN regexp_extract({content}, '(?s)<<<\\n(.*?)\\n>>>\\n(.*?)\\n===', 2) "
           f"ELSE regexp_extract({content}, '(?s)<<<\\s*(.*?)\\s*>>>\\s*(.*?)\\s*===', 2) END)")
    has = f"(regexp_matches({x}, '(?s)<tool_call>\\s*(.*?)\\s*</tool_call>') AND {first} <> '')"
    valid = f"({has} AND ({tool} IN ('read', 'run') OR ({tool} = 'edit' AND ({strict} OR {loose}))))"
    return {
        "valid": valid,
        "tool": f"(CASE WHEN {valid} THEN {tool} END)",
        "path": f"(CASE WHEN {valid} AND {tool} IN ('read', 'edit') THEN {args} END)",
        "command": f"(CASE WHEN {valid} AND {tool} = 'run' THEN {args} END)",
        "old_text": f"(CASE WHEN {valid} AND {tool} = 'edit' THEN {old} END)",
        "new_text": f"(CASE WHEN {valid} AND {tool} = 'edit' THEN {new} END)",
    }
