"""Tool-call parser, edit semantics, trajectories, mutations, SFT builders."""

import json
import os

import pytest
from pyspark.sql import functions as F

from textbench.functions import mutations as M
from textbench.functions import toolcalls as TC
from textbench.operators import sft as SFT
from textbench.operators import trajectories as TR
from textbench.sources import readers as RD


def _parse(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    a = [r[0] for r in df.select(TC.parse_tool_call("t")).collect()]
    b = [r["c"] for r in TC.add_tool_call(df, "t", "c").collect()]
    assert a == b
    return a


def test_parse_tool_call_cases(spark):
    out = _parse(spark, [
        "<tool_call>\nread /workspace/a.py\n</tool_call>",
        "<tool_call>\nrun ls -la\n</tool_call>",
        "<tool_call>\nedit f.py\n<<<\nold\n>>>\nnew\n===\n</tool_call>",
        "<tool_call>\nedit f.py\n<<<   old >>>   new ===\n</tool_call>",
        "<tool_call>\nedit f.py\n<<<\n\n>>>\n\n===\n</tool_call>",
        "<tool_call>\n\n</tool_call>",
        "<tool_call>\nfly away\n</tool_call>",
        "no call here",
        "<tool_call>read a</tool_call> then <tool_call>read b</tool_call>",
        "<tool_call>\nread\n</tool_call>",
    ])
    assert out[0].asDict() == {"tool": "read", "path": "a.py", "command": None, "old_text": None, "new_text": None}
    assert out[1]["tool"] == "run" and out[1]["command"] == "ls -la"
    assert (out[2]["old_text"], out[2]["new_text"], out[2]["path"]) == ("old", "new", "f.py")
    assert (out[3]["old_text"], out[3]["new_text"]) == ("old", "new")
    assert out[4]["tool"] == "edit"
    assert out[5] is None and out[6] is None and out[7] is None
    assert out[8]["path"] == "a"
    assert out[9]["tool"] == "read" and out[9]["path"] is None


def test_apply_edit_first_occurrence_and_not_found(spark):
    df = spark.createDataFrame([("x x x", "x", "y"), ("abc", "zz", "q")], "c string, o string, n string")
    r = df.select(TC.apply_edit("c", "o", "n", F.lit("f.py")).alias("r")).collect()
    assert (r[0]["r"]["success"], r[0]["r"]["content"], r[0]["r"]["output"]) == (True, "y x x", "edited f.py")
    assert (r[1]["r"]["success"], r[1]["r"]["content"], r[1]["r"]["output"]) == (False, "abc", "text not found in f.py")


def test_format_tool_result(spark):
    df = spark.createDataFrame([(True, "ok"), (False, "bad")], "s boolean, o string")
    got = [r[0] for r in df.select(TC.format_tool_result("s", "o")).collect()]
    assert got == ["<tool_result>\n✓ ok\n</tool_result>", "<tool_result>\n✗ bad\n</tool_result>"]


def _traj(spark, rows):
    return spark.createDataFrame([(t, s, steps) for t, s, steps in rows], RD.TRAJECTORY_SCHEMA)


def test_trajectory_metrics_recorded_log_shape(spark):
    # schema-identical records authored for the test: one read then a done+edit output
    call = {"tool": "read", "path": "a.py", "command": None}
    res = {"success": True, "output": "x"}
    rows = [
        ("t1", False, [("<tool_call>\nread a.py\n</tool_call>", call, res),
                       ("<tool_call>\nedit a.py\n<<<\na\n>>>\nb\n===\n</tool_call>\n\n<done/>", None, None)]),
        ("t2", True, [("<done/>", None, None)]),
        ("t3", False, [("thinking", None, None)] * 20),
    ]
    m = TR.trajectory_metrics(_traj(spark, rows)).first()
    assert m["total"] == 3
    assert m["pass_rate"] == pytest.approx(1 / 3)
    assert m["first_try_rate"] == pytest.approx(1 / 3)
    assert m["avg_steps"] == pytest.approx(23 / 3)
    assert m["avg_tool_calls"] == pytest.approx(1 / 3)
    assert m["death_spiral_rate"] == pytest.approx(1 / 3)
    flat = TR.flatten_trajectory(_traj(spark, rows), ["task_id"]).filter("call_lost").count()
    assert flat == 1


def test_trajectory_metrics_empty_is_zero(spark):
    m = TR.trajectory_metrics(_traj(spark, [])).collect()
    assert m == [] or m[0]["total"] == 0


def test_messages_nudge_and_results(spark):
    call = {"tool": "read", "path": "a.py", "command": None}
    rows = [("t", True, [("<tool_call>\nread a.py\n</tool_call>", call, {"success": False, "output": "boom"}),
                         ("hmm", None, None), ("<done/>", None, None)])]
    df = _traj(spark, rows)
    msgs = df.select(TR.trajectory_to_messages(F.lit("do it"), F.col("steps")).alias("m")).first()["m"]
    roles = [m["role"] for m in msgs]
    assert roles == ["system", "user", "assistant", "user", "assistant", "user", "assistant"]
    assert msgs[3]["content"] == "<tool_result>\n✗ boom\n</tool_result>"
    assert msgs[5]["content"] == "Use a tool or output <done/>."


def test_replay_edits_sequence(spark):
    df = spark.createDataFrame([("a b a", [("a", "c"), ("zz", "q"), ("a", "d")])],
                               "snap string, edits array<struct<old_text:string,new_text:string>>")
    r = df.select(TR.replay_edits(F.col("edits"), F.col("snap"), F.lit("f")).alias("r")).first()["r"]
    assert (r["content"], r["applied"], r["failed"]) == ("c b d", 2, 1)
    assert [tuple(o) for o in r["outcomes"]] == [(True, "edited f"), (False, "text not found in f"), (True, "edited f")]


def test_mutations_semantics(spark):
    code = 'x = 1\nname_a = "hello world"\nprint_it(name_a)\n'
    df = spark.createDataFrame([(code, "py", 0)], "c string, lang string, k long")
    r = df.select(M.rename_mutation("c", "lang", 1, F.col("k")).alias("r")).first()["r"]
    if r is not None:  # a 1-char pick returns None, like the reference
        assert r["mutated"] == code.replace(r["old_text"], r["old_text"] + "_renamed")
    s = df.select(M.string_literal_mutation("c", 1, F.col("k")).alias("s")).first()["s"]
    assert s["old_text"] == '"hello world"' and s["new_text"] == '"hello world_modified"'
    assert s["mutated"] == code.replace('"hello world"', '"hello world_modified"')
    t = df.select(M.typo_mutation("c", 1, F.col("k")).alias("t")).first()["t"]
    assert t["mutated"] == code and t["new_text"] == "print_it"
    assert sorted(t["old_text"]) == sorted("print_it") and t["old_text"] != "print_it"
    assert t["original"] == code.replace("print_it", t["old_text"], 1)


def test_upper_case_name_recovery_is_flagged_equal(spark):
    df = spark.createDataFrame([("CONST = 1\n", "py", 0)], "c string, lang string, k long")
    r = df.select(M.rename_mutation("c", "lang", 1, F.col("k")).alias("r")).first()["r"]
    assert r["old_text"] == "CONST" and r["old_text"].upper() == r["old_text"]


def test_read_tasks_object_and_array(spark, tmp_path):
    (tmp_path / "task_a.json").write_text(json.dumps({"id": "b", "description": "d2", "max_steps": 5}))
    (tmp_path / "task_b.json").write_text(json.dumps([{"id": "a", "description": "d1"}, {"id": "c", "description": "d3"}]))
    (tmp_path / "other.json").write_text(json.dumps({"id": "zzz", "description": "ignored"}))
    rows = RD.read_tasks(spark, str(tmp_path)).collect()
    assert [r["id"] for r in rows] == ["a", "b", "c"]
    assert rows[0]["max_steps"] == 20 and rows[1]["max_steps"] == 5
    assert rows[0]["docker_image"] == "agent-base" and rows[0]["setup_commands"] == []


def test_read_code_files_walk_rules(spark, tmp_path):
    def put(rel, text):
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    body = 'value_one = "some literal"\nother = 2\n'
    put("repo1/src/a.py", body)
    put("repo1/node_modules/x.js", body)
    put("repo1/b.ts", "let thing = 'abc def'\n" * 2)
    put("repo1/tiny.py", "x=1")
    put("repo2/main.rs", "let mut count = 3;\nlet label = \"a b c\";\n")
    put("repo2/README.md", body)
    files = RD.read_code_files(spark, str(tmp_path))
    assert files.count() == 6
    assert RD.read_code_files(spark, str(tmp_path), keep=SFT.worth_reading()).count() == 3
    kept = SFT.walk_filter(files).select("repo", "path", "lang").collect()
    assert sorted((r["repo"], r["path"], r["lang"]) for r in kept) == [
        ("repo1", "b.ts", "js"), ("repo1", "src/a.py", "py"), ("repo2", "main.rs", "rs")]
    ex = SFT.sft_from_repos(spark, files, seed=1)
    kinds = {r["kind"] for r in ex.collect()}
    assert "run" in kinds and "rename" in kinds
    assert ex.filter(F.col("kind") == "run").count() == 5


def test_read_code_files_keeps_hidden_names_and_repeated_root(spark, tmp_path):
    root = tmp_path / "code" / "mirror" / "code"
    want = {("p3", "z.py"), ("p3", "__init__.py"), ("_private", "a/_util.py"), ("p3", ".cfg/b.py"), ("p3", "code/mirror/c.py"),
            ("p 4%", "ünï.py")}
    for repo, path in want:
        f = root / repo / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(f"# {repo} {path} é")
    rows = RD.read_code_files(spark, str(root)).collect()
    assert {(r["repo"], r["path"]) for r in rows} == want
    assert all(r["content"] == f"# {r['repo']} {r['path']} é" for r in rows)


def test_whole_word_rename(spark):
    from textbench.functions.mutations import rename_mutation

    df = spark.createDataFrame([("total = 1\nsubtotal = total + 2\n",)], "code string")
    sub, whole = df.select(*[rename_mutation("code", F.lit("py"), 1, F.lit("k"), whole_word=w)["mutated"] for w in (False, True)]).first()
    assert whole.count("subtotal = ") == 1 or "total = 1" in whole  # the other name was drawn
    if "total_renamed = 1" in whole:
        assert "\nsubtotal = total_renamed + 2" in whole and "subtotal_renamed" in sub


def test_listing_spreads_one_repository_over_tasks(spark, tmp_path, monkeypatch):
    """One repository has almost all files, many folders deep; no task lists it alone."""
    import os

    from textbench.sources import readers as RD

    monkeypatch.setattr(RD, "ROWS_PER_BATCH", 3)
    want = set()
    for d in range(40):
        folder = tmp_path / "big" / f"d{d % 8}" / f"e{d}" / ".hidden"
        os.makedirs(folder)
        for k in range(5):
            (folder / f"_f{k}.py").write_text("x = 1")
            want.add(("big", f"d{d % 8}/e{d}/.hidden/_f{k}.py"))
    (tmp_path / "small").mkdir()
    (tmp_path / "small" / "a.py").write_text("x")
    (tmp_path / "empty").mkdir()
    (tmp_path / "stray.py").write_text("not in a repository")
    want.add(("small", "a.py"))
    files = RD.list_code_files(spark, str(tmp_path))
    assert {(r["repo"], r["path"]) for r in files.collect()} == want and files.count() == len(want)
    deepest = files.withColumn("p", F.input_file_name()).where("repo = 'big'").select("p").distinct().count()
    assert deepest > 4  # written by so many tasks
    assert all(r["uri"].endswith(r["path"]) and r["size"] > 0 for r in files.collect())


def test_rename_replay_reports_what_the_first_edit_leaves(spark):
    df = spark.createDataFrame([("ab = 1\nuse(ab)\nab2 = ab\n",), ("ab = 1\n",)], "c string")
    m = F.struct(F.col("c").alias("original"), F.replace("c", F.lit("ab"), F.lit("ab_renamed")).alias("mutated"),
                 F.lit("ab").alias("old_text"), F.lit("ab_renamed").alias("new_text"))
    rows = [tuple(r["r"]) for r in df.select(TR.rename_replay(F.col("c"), m, F.lit("f")).alias("r")).collect()]
    assert rows == [(True, False, 3), (True, True, 0)]


def test_trajectories_are_not_a_file_per_run(spark, tmp_path):
    import __spark_entry__ as E

    rows = [(c if c else None, t, "assistant" if t % 2 else "user", f"<tool_call>\nread /workspace/f{c}.py\n</tool_call>\n\u00e9 \"{t}\"") for c in range(120) for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = E.queries()["src4_read_trajectories"](spark, str(tmp_path))
    files = out.inputFiles()
    assert 0 < len(files) < 60 and not any("run=" in f for f in files)
    got = {r["run"]: (r["task_id"], r["success"], r["n_steps"], r["n_calls"]) for r in out.collect()}
    assert len(got) == 120 and got[None][:3] == (None, None, 2) and got[7][:3] == ("task_7", False, 2) and dict(out.dtypes)["run"] == "bigint"
