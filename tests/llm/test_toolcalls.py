import json

import pytest
from textbench.llm import toolcalls
from textbench.llm.toolcalls import SCHEMAS, canonical, derive_calls, link_tool_calls, parse_json, schema_error


@pytest.mark.parametrize("value,schema,error", [
    ({"a": 1}, {"type": "object", "required": ["a"]}, None),
    ({}, {"required": ["a"]}, "$: a is missing"),
    ({"b": 1}, {"properties": {}, "additionalProperties": False}, "$: b is not allowed"),
    ({"a": "x"}, {"properties": {"a": {"type": "integer"}}}, "$.a: not of type integer"),
    (True, {"type": "integer"}, "$: not of type integer"), (3.0, {"type": "integer"}, None), (None, {"type": ["string", "null"]}, None),
    (1, {"enum": [True, "1"]}, "$: not in enum"), (5, {"maximum": 4}, "$: above maximum"), (5, {"minimum": 6}, "$: below minimum"),
    ("abc", {"maxLength": 2}, "$: length out of bounds"), ([1, "x"], {"items": {"type": "number"}}, "$[1]: not of type number"),
    ({"a": {"$ref": "c1"}}, {"properties": {"a": {"type": "integer"}}}, None)])
def test_schema(value, schema, error):
    assert schema_error(value, schema) == error


def test_strict_json():
    assert parse_json('{"b": 1, "a": [1.5, null]}') == ({"b": 1, "a": [1.5, None]}, None)
    for bad in (None, "", "{", '{"a": NaN}', '{"a": 1, "a": 2}', "[1,]"):
        assert parse_json(bad)[1]
    assert canonical({"ü": 1, "a": {"z": "é", "b": True}}) == '{"a":{"b":true,"z":"é"},"ü":1}'


CALLS = "conv_id long, turn long, call_id string, name string, arguments string, level string, c string"


def _link(spark, calls, results):
    c = spark.createDataFrame([(*x, "l", "c") for x in calls], CALLS)
    r = spark.createDataFrame([(*x, 1) for x in results], "conv_id long, turn long, call_id string, content string, seq int")
    schemas = {"f": {"type": "object", "properties": {"x": {"type": "integer"}}}}
    return [r.asDict() for r in link_tool_calls(c, r, schemas).collect()]


def _ref(i):
    return json.dumps({"after": {"$ref": i}})


@pytest.mark.parametrize("group", [100_000, 1])
def test_links_order_and_status(spark, monkeypatch, group):
    """Conversations ordered in a task, and (with a bound of 1) by joins."""
    monkeypatch.setattr(toolcalls, "GROUP", group)
    calls = [(1, 1, "a", "f", '{"x": 1}'), (1, 3, "b", "f", _ref("a")), (1, 5, "c", "f", json.dumps([{"$ref": "a"}, {"$ref": "b"}])),
             (1, 0, "late", "f", _ref("c")), (1, 7, "p", "f", _ref("q")), (1, 7, "q", "f", _ref("p")), (1, 9, "r", "f", _ref("q")),
             (1, 2, "m", "f", _ref("nowhere")), (2, 1, "a", "f", '{"x": "no"}'), (2, 2, "a", "f", "{}"), (2, 3, None, "f", "{}"),
             (2, 4, "u", "unknown", "{}"), (2, 5, "n", "f", None), (None, 1, "a", "f", "{}"), (None, None, "b", "f", _ref("a"))]
    results = [(1, 2, "a", "one"), (1, 4, "a", "two"), (2, 9, "ghost", "x"), (2, 9, None, "y"), (None, 2, "a", "z"), (2, 1, "a", None)]
    got = _link(spark, calls, results)
    assert len(got) == len(calls) + 2
    at = {(r["conv_id"], r["call_id"], r["turn"]): r for r in got}
    level = {k[1]: r["level"] for k, r in at.items() if k[0] == 1}
    assert level == {"a": 0, "m": 0, "b": 1, "c": 2, "late": 3, "p": None, "q": None, "r": None}
    order = sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["seq"])
    assert [r["call_id"] for r in order] == ["a", "m", "b", "c", "late", "p", "q", "r"] and [r["seq"] for r in order] == list(range(8))
    assert json.loads(at[(1, "a", 1)]["canonical"]) == {"arguments": {"x": 1}, "id": "a", "name": "f", "result": "one"}
    assert at[(1, "a", 1)]["status"] == "linked" and at[(1, "b", 3)]["status"] == "pending"
    assert at[(1, "m", 2)]["error"] == "names a call that is not there"
    assert (at[(2, "a", 1)]["status"], at[(2, "a", 1)]["valid"], at[(2, "a", 2)]["status"]) == ("linked", False, "repeated")
    assert at[(2, None, 3)]["status"] == "pending" and at[(2, "ghost", 9)]["status"] == "orphan" and at[(2, None, 9)]["status"] == "orphan"
    assert at[(2, "u", 4)]["error"] == "unknown tool unknown" and at[(2, "n", 5)]["error"] == "no arguments"
    assert at[(None, "a", 1)]["status"] == "linked" and at[(None, "b", None)]["level"] == 1


def test_repeated_rows_and_empty_tables(spark):
    got = _link(spark, [(1, 1, "a", "f", "{}")] * 3, [(1, 2, "a", "r")] * 4)
    assert sorted(r["status"] for r in got) == ["linked", "repeated", "repeated"] and sorted(r["seq"] for r in got) == [0, 1, 2]
    assert _link(spark, [], []) == []
    assert [r["status"] for r in _link(spark, [], [(1, 2, "a", "r")])] == ["orphan"]


def test_conversations_against_plain_code(spark):
    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    calls, results = derive_calls(conv)
    got = {(r["conv_id"], r["call_id"]): r for r in link_tool_calls(calls, results, SCHEMAS).collect()}
    calls, results = calls.collect(), {(r["conv_id"], r["call_id"]): r["content"] for r in results.collect()}
    have = {(c["conv_id"], c["call_id"]): c for c in calls}
    assert len(have) == len(calls) and set(got) == set(have) | set(results)

    def level(key):
        after = json.loads(have[key]["arguments"]).get("after")
        up = (key[0], after["$ref"]) if after else None
        return 0 if up not in have else level(up) + 1

    for key, c in have.items():
        r = got[key]
        assert r["level"] == level(key) and r["status"] == ("linked" if key in results else "pending")
        want = {"arguments": json.loads(c["arguments"]), "id": key[1], "name": c["name"], "result": results.get(key)}
        assert r["canonical"] == json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_calls_without_an_id_are_nodes_of_their_own(spark):
    calls = [(1, 1, "a", "f", "{}"), (1, 2, None, "f", _ref("nowhere")), (1, 3, None, "f", _ref("a")), (1, 4, None, "f", "{}"),
             (1, 4, None, "f", "{}"), (1, 5, "b", "f", _ref("a"))]
    got = {(r["call_id"], r["turn"]): r for r in _link(spark, calls, [])}
    assert (got[(None, 2)]["level"], got[(None, 2)]["error"]) == (0, "names a call that is not there")
    assert (got[(None, 3)]["level"], got[(None, 3)]["valid"]) == (1, True)
    assert (got[(None, 4)]["level"], got[(None, 4)]["valid"], got[(None, 4)]["status"]) == (0, True, "pending")
    assert sorted(r["seq"] for r in _link(spark, calls, [])) == list(range(6))


def test_escaped_references_find_their_call(spark):
    calls = [(1, 1, "café", "f", "{}"), (1, 2, 'q"x\\', "f", "{}"), (1, 3, "u", "f", '{"after": {"$ref": "caf\\u00e9"}}'),
             (1, 4, "v", "f", json.dumps({"after": {"$ref": 'q"x\\'}})), (1, 5, "w", "f", json.dumps({"x": 1, "s": '{"$ref": "no"}'}))]
    got = {r["call_id"]: r for r in _link(spark, calls, [])}
    assert (got["u"]["level"], got["u"]["error"]) == (1, None) and (got["v"]["level"], got["v"]["error"]) == (1, None)
    assert (got["w"]["level"], got["w"]["error"]) == (0, None)


def test_a_long_chain_takes_no_round_per_level(spark, monkeypatch):
    made = []
    real = toolcalls.materialise
    monkeypatch.setattr(toolcalls, "materialise", lambda df, tag: made.append(tag) or real(df, tag))
    calls = [(1, i, f"c{i}", "f", _ref(f"c{i - 1}") if i else "{}") for i in range(5000)]
    got = {r["call_id"]: r for r in _link(spark, calls, [])}
    assert all(got[f"c{i}"]["level"] == i == got[f"c{i}"]["seq"] for i in range(5000)) and len(made) < 20


def test_one_turn_for_all_calls_and_very_long_texts(spark):
    calls = [(1, None, f"c{i:03d}", "f", "{}") for i in range(300)] + [(1, 7, "long", "f", json.dumps({"s": "x" * 3_000_000}))]
    got = {r["call_id"]: r for r in _link(spark, calls, [(1, 8, "long", "y" * 3_000_000)])}
    assert [got[f"c{i:03d}"]["seq"] for i in range(300)] == list(range(300)) and got["long"]["seq"] == 300
    assert len(got["long"]["canonical"]) > 6_000_000
