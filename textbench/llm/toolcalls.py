"""Operator 2: linking tool calls with their results.

Calls and results are joined by (conversation, call id) after results are
aggregated per id, so a repeated id never multiplies rows.  Arguments may name
earlier calls (``{"$ref": "<call id>"}``); calls are ordered topologically:
level 0 names no call, any other is one above the highest call it names, and
within a conversation calls go by level, turn and id.  The references of a
conversation (at most GROUP of them) are ordered in one task, so chains of any
length cost no extra round; a conversation with more is ordered by joins, one
round per level.  Arguments are validated against the JSON schema of their tool,
and every linked call is serialised as canonical JSON (sorted keys, no spaces,
UTF-8).
"""

from __future__ import annotations

import json
import math

from collections import defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textbench.llm.common import materialise
from textbench.operators.ranking import range_rank

REF = r'"\$ref"\s*:\s*"((?:[^"\\]|\\.)*)"'
GROUP = 100_000  # references of a conversation that one task orders
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return kind in TYPES and isinstance(value, TYPES[kind])


def schema_error(value, schema: dict, at: str = "$") -> str | None:
    """The first way in which ``value`` breaks ``schema`` (type, enum, bounds,
    lengths, properties, required, additionalProperties, items), or None."""
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{at}: not of type {kinds if isinstance(kinds, str) else '/'.join(kinds)}"
    if "enum" in schema and not any(type(value) is type(e) and value == e for e in schema["enum"]):
        return f"{at}: not in enum"
    if _is(value, "number"):
        if value < schema.get("minimum", -math.inf):
            return f"{at}: below minimum"
        if value > schema.get("maximum", math.inf):
            return f"{at}: above maximum"
    if isinstance(value, (str, list)):
        low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        if not schema.get(low, 0) <= len(value) <= schema.get(high, math.inf):
            return f"{at}: length out of bounds"
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            if error := schema_error(item, schema["items"], f"{at}[{i}]"):
                return error
    if isinstance(value, dict):
        for name in schema.get("required", []):
            if name not in value:
                return f"{at}: {name} is missing"
        known = schema.get("properties", {})
        for name in sorted(value):
            if name in known:
                # a reference stands for a value that is only known at run time
                if isinstance(value[name], dict) and set(value[name]) == {"$ref"}:
                    continue
                if error := schema_error(value[name], known[name], f"{at}.{name}"):
                    return error
            elif schema.get("additionalProperties", True) is False:
                return f"{at}: {name} is not allowed"
    return None


def _refuse(name):
    raise ValueError(f"{name} is not JSON")


def _unique(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("repeated key")
    return out


def parse_json(text: str | None):
    """(value, error): strict JSON without NaN, infinities or repeated keys."""
    if text is None:
        return None, "no arguments"
    try:
        return json.loads(text, parse_constant=_refuse, object_pairs_hook=_unique), None
    except (ValueError, RecursionError) as e:
        return None, "not JSON: " + str(e).split(":")[0]


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _levels_of(edges: list[tuple[str, str]]) -> list[tuple[str, int | None]]:
    """Levels of the calls of one conversation that name others (key, ref);
    None on a cycle or above one."""
    waits, named_by = defaultdict(int), defaultdict(list)
    for key, ref in edges:
        waits[key] += 1
        named_by[ref].append(key)
    level = dict.fromkeys(waits)
    ready = [(ref, 0) for ref in named_by if ref not in waits]
    while ready:
        done, at = ready.pop()
        for key in named_by[done]:
            level[key] = max(level[key] or 0, at + 1)
            waits[key] -= 1
            if not waits[key]:
                ready.append((key, level[key]))
    return [(key, n if waits[key] == 0 else None) for key, n in level.items()]


def _conversation_levels(batches):
    """Arrow batches of references (ck, key, ref), sorted by ck, as rows ck, key,
    level: one conversation in memory at a time."""
    at, edges, done = None, [], []

    def rows():
        cols = list(zip(*done))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()))],
                                          names=["ck", "key", "level"])

    for batch in batches:
        for ck, key, ref in zip(*[batch.column(c).to_pylist() for c in range(3)]):
            if ck != at:
                done += [(at, *r) for r in _levels_of(edges)]
                at, edges = ck, []
                if len(done) > 10_000:
                    yield rows()
                    done = []
            edges.append((key, ref))
    done += [(at, *r) for r in _levels_of(edges)]
    if done:
        yield rows()


def call_levels(calls: DataFrame) -> DataFrame:
    """(ck, key, level, missing) of calls (ck, key, refs): ``level`` is null on
    a cycle or above one; ``missing`` counts named calls that the conversation
    does not have.  ``ck`` and ``key`` name conversations and calls and are
    never null; a call without an id has a key that no reference names."""
    node = materialise(calls.select("ck", "key", "refs"), "calls")  # one row per call already
    wants = node.select("ck", "key", F.explode(F.array_distinct("refs")).alias("ref"))
    have = node.select(F.col("ck").alias("hc"), F.col("key").alias("hk"))
    wants = wants.join(have, (F.col("ck") == F.col("hc")) & (F.col("ref") == F.col("hk")), "left")
    wants = materialise(wants.select("ck", "key", "ref", F.col("hk").isNotNull().alias("there")), "refs")
    absent = wants.where("not there").groupBy("ck", "key").agg(F.count("*").alias("missing"))
    edges = wants.where("there").select("ck", "key", "ref")
    large = materialise(edges.groupBy("ck").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("ck"), "large")
    small = edges.join(large, "ck", "left_anti").repartition("ck").sortWithinPartitions("ck")
    small = small.select("ck", "key", "ref").mapInArrow(_conversation_levels, "ck string, key string, level long")
    levels = [materialise(small, "levels")]

    left = edges.join(large, "ck")
    if not large.isEmpty():
        left = materialise(left, "refs")
        waiting = left.select("ck", "key").distinct()
        fresh, depth = node.select("ck", "key").join(large, "ck").join(waiting, ["ck", "key"], "left_anti"), 0
        while not left.isEmpty() and not fresh.isEmpty():
            depth += 1
            # references to calls that are done no longer count; whoever has none left comes next
            rest = left.join(fresh.select("ck", F.col("key").alias("ref")), ["ck", "ref"], "left_anti")
            rest = materialise(rest, "refs")
            fresh = left.select("ck", "key").distinct().join(rest.select("ck", "key").distinct(), ["ck", "key"], "left_anti")
            fresh = materialise(fresh, "levels")
            levels.append(fresh.withColumn("level", F.lit(depth).cast("long")))
            left = rest
        levels.append(left.select("ck", "key").distinct().withColumn("level", F.lit(None).cast("long")))
    found = levels[0]
    for part in levels[1:]:
        found = found.unionAll(part)
    found = found.withColumn("named", F.lit(True))
    out = node.select("ck", "key").join(found, ["ck", "key"], "left").join(absent, ["ck", "key"], "left")
    return out.select("ck", "key", F.when(F.col("named"), F.col("level")).otherwise(F.lit(0)).cast("int").alias("level"),
                      F.coalesce("missing", F.lit(0)).alias("missing"))


def _dense_order(df: DataFrame) -> DataFrame:
    """``seq``: position of a call in its conversation, from 0, by level (null
    last), turn and id.  Only these are sorted, in ranges, so a conversation of any
    length, or with one turn for all, is spread over tasks."""
    keys = df.select("rid", "ck", F.coalesce("level", F.lit(2 ** 30)).alias("lv"), "turn", "call_id", "nth")
    seq = range_rank(keys, ["lv", "turn", "call_id", "nth", "rid"], "seq", partition_cols=["ck"]).select(F.col("rid").alias("sr"), "seq")
    return df.join(seq, F.col("rid") == F.col("sr")).drop("sr")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """``calls`` (conv_id, turn, call_id, name, arguments) and ``results``
    (conv_id, turn, call_id, content) -> one row per call, and one per id that
    only results have: conv_id, call_id, turn, name, level, seq, status, valid,
    error, canonical.

    status: 'linked'; 'pending' (no result); 'orphan' (a result without a call:
    level, seq and canonical null); 'repeated' (a later call with an id that the
    conversation already used).  An id's first result (by turn, then content)
    counts.  Null conversation or call ids: a null conversation is one of its
    own; a call without an id is pending, a node of its own that no reference
    names, and results without an id are orphans.  References are read as JSON
    strings, escapes resolved.  A call
    that is on a cycle of references, or above one, has level null and goes
    last.  ``valid`` is false, with the reason in ``error``, if the arguments
    are null, not strict JSON, break the schema, name a call that is not there,
    or if the tool is unknown.  Equal rows count once each; extra columns are
    not read.  ``schemas`` is a parameter of the program, one entry per tool.
    """
    c = calls.select("conv_id", F.col("turn").cast("long").alias("turn"), "call_id", "name", "arguments")
    raw = F.coalesce(F.regexp_extract_all("arguments", F.lit(REF), F.lit(1)), F.array().cast("array<string>"))
    # what the expression found are the insides of JSON strings
    refs = F.from_json(F.concat(F.lit('["'), F.array_join(raw, '","'), F.lit('"]')), "array<string>")
    refs = F.transform(F.coalesce(refs, F.array().cast("array<string>")), lambda x: F.concat(F.lit("i"), x))
    c = c.withColumn("refs", F.when(F.size(raw) > 0, F.array_distinct(refs)).otherwise(F.array().cast("array<string>")))
    same = ["conv_id", "call_id", "turn", "name", "arguments", "refs"]
    c = c.groupBy(*same).agg(F.count("*").alias("m")).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    # the first call of an id is found by aggregation, not by a window over the id
    first = c.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "name", "arguments", "i")).alias("first"))
    c = c.alias("x").join(first.alias("y"), F.expr("x.conv_id <=> y.conv_id and x.call_id <=> y.call_id")).select(
        "x.*", (~F.struct("x.turn", "x.name", "x.arguments", "x.i").eqNullSafe(F.col("y.first"))).cast("int").alias("later"))
    c = c.withColumn("nth", F.when(F.col("call_id").isNull(), F.lit(0)).otherwise(F.col("later")) * F.col("i")).drop("m", "i", "later")
    rid = F.monotonically_increasing_id()
    c = c.withColumn("rid", rid).withColumn("ck", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")))
    # a later call of an id shares its key; a call without an id has its own
    c = materialise(c.withColumn("key", F.coalesce(F.concat(F.lit("i"), F.col("call_id")), F.concat(F.lit("r"), F.col("rid").cast("string")))), "tool-calls")

    r = results.select("conv_id", F.col("turn").cast("long").alias("turn"), "call_id", "content")
    r = r.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("res"))
    named = F.expr("x.conv_id <=> r.conv_id and x.call_id = r.call_id")
    linked = c.alias("x").join(r.alias("r"), named, "left").select(
        "x.*", F.col("r.res").isNotNull().alias("has"), F.col("r.res.content").alias("content"))
    orphans = r.alias("r").join(c.select("conv_id", "call_id").distinct().alias("x"), named, "left_anti").select(
        "conv_id", "call_id", F.col("res.turn").alias("turn"))

    levels = call_levels(c.where(F.col("nth") == 0))
    linked = linked.join(levels, ["ck", "key"], "left").withColumn("missing", F.coalesce("missing", F.lit(0)))
    linked = _dense_order(linked)

    def finish(batches):
        for pdf in batches:
            error, text = [], []
            for x in pdf.itertuples():
                value, problem = parse_json(x.arguments)
                if problem is None:
                    schema = schemas.get(x.name)
                    problem = f"unknown tool {x.name}" if schema is None else schema_error(value, schema)
                if problem is None and x.missing:
                    problem = "names a call that is not there"
                error.append(problem)
                text.append(canonical({"arguments": value, "id": x.call_id, "name": x.name,
                                       "result": x.content if x.has else None}))
            yield pdf.drop(columns=["arguments", "content", "missing"]).assign(error=error, canonical=text)

    out = linked.select("conv_id", "call_id", "turn", "name", "level", "seq", "nth", "has", "arguments", "content", "missing")
    kept = out.drop("arguments", "content", "missing").schema
    out = out.mapInPandas(_nullable(finish), kept.add("error", "string").add("canonical", "string"))
    status = F.when(F.col("nth") > 0, "repeated").when(F.col("has"), "linked").otherwise("pending")
    out = out.select("conv_id", "call_id", "turn", "name", "level", "seq", status.alias("status"),
                     F.col("error").isNull().alias("valid"), "error", "canonical")
    none = [F.lit(None).cast(out.schema[n].dataType).alias(n) for n in ("name", "level", "seq")]
    return out.unionByName(orphans.select(
        "conv_id", "call_id", "turn", *none, F.lit("orphan").alias("status"), F.lit(False).alias("valid"),
        F.lit("result without a call").alias("error"), F.lit(None).cast("string").alias("canonical")))


def _nullable(fn):
    """Integer and text columns with nulls arrive as objects, not as floats and NaN."""

    def run(batches):
        def clean():
            for pdf in batches:
                yield pd.DataFrame({c: pd.Series([None if pd.isna(v) else int(v) if c in ("turn", "level", "seq", "conv_id")
                                                  and isinstance(v, float) else v for v in pdf[c]], dtype=object, index=pdf.index)
                                    for c in pdf.columns})

        yield from fn(clean())

    return run


#: the tools of the conversations' derived calls
SCHEMAS = {
    "search": {"type": "object", "required": ["query"], "additionalProperties": False, "properties": {
        "query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 500},
        "after": {"type": "string"}}},
    "read_file": {"type": "object", "required": ["path", "limit"], "additionalProperties": False, "properties": {
        "path": {"type": "string"}, "limit": {"type": "integer", "minimum": 0}, "query": {"type": "string"},
        "after": {"type": "string"}}},
    "write_note": {"type": "object", "required": ["query"], "properties": {
        "query": {"type": "string", "maxLength": 2000}, "after": {"type": "string"}}},
}


def derive_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that the turns of ``conversations`` (conv_id, turn,
    role, text) stand for: every assistant turn is a call whose arguments hold
    its whole text, every user turn from 1 on the result of the turn before.
    Three of four calls refer to the call two turns earlier."""
    x = conversations.select("conv_id", "turn", "role", "text")
    cid = F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
    before = F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), (F.col("turn") - 2).cast("string"))
    which = F.pmod(F.crc32(F.coalesce("text", F.lit(""))), F.lit(4))
    name = F.element_at(F.array(*[F.lit(n) for n in ("search", "read_file", "write_note", "delete_all")]), (which + 1).cast("int"))
    ref = F.when((F.col("turn") >= 3) & (F.pmod(F.col("turn"), F.lit(8)) >= 3), F.struct(before.alias("$ref")))
    args = F.to_json(F.struct(F.col("text").alias("query"), F.length("text").alias("limit"), F.when(
        which == 1, F.concat(F.lit("/notes/"), F.col("turn").cast("string"))).alias("path"), ref.alias("after")))
    calls = x.where("role = 'assistant'").select("conv_id", "turn", cid.alias("call_id"), name.alias("name"), args.alias("arguments"))
    of = F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), (F.col("turn") - 1).cast("string"))
    results = x.where("role = 'user' and turn > 0").select("conv_id", "turn", of.alias("call_id"), F.col("text").alias("content"))
    return calls, results
