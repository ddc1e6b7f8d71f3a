"""Operator 11 against a trie built in plain Python."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from textbench.llm import prefixtrie
from textbench.llm.prefixtrie import SpillingQueue, conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def trunc_mod(a, b):
    return a - b * int(a / b)


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))] for c, ts in own.items()}
    members = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        turns = tuple(own.get(c - trunc_mod(c, 20), [])[:h] + ts[h:])
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append((c, len(turns) == d))
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        words = len(re.findall(r"[^\x20\x09-\x0d]+", path[-1][1])) if path else 0
        leaves[path] = sum(leaves[p] for p in below) or 1
        saved[path] = sum(saved[p] for p in below) + (len(members[path]) - 1) * words
    out = []
    for path, who in members.items():
        ends = ",".join(str(c) for c, end in sorted(who) if end)
        parent = min(members[path[:-1]])[0] if path else None
        out.append((min(who)[0], len(path), parent, len(who), len(children.get(path, [])), leaves[path], saved[path],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, **options):
    got = conversation_trie(spark.createDataFrame(rows, SCHEMA), **options)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def random_rows(seed, convs, longest):
    rnd = random.Random(seed)
    rows = []
    for c in range(convs):
        rows += [(c * rnd.choice([1, 1, -1]), t, rnd.choice(["user", "bot"]), rnd.choice(["Hi there", "yes", "no no no", ""]))
                 for t in range(rnd.randint(0, longest))]
    return rows


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows)


@pytest.mark.parametrize("shard_rows", [1, 7, 100_000])
def test_shards_pieces_and_spills_give_the_same_trie(spark, shard_rows):
    check(spark, random_rows(shard_rows, 120, 9), shard_rows=shard_rows, limit=5)


def test_one_conversation_with_most_turns(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "CHAIN", 6)  # carried over three times
    rows = [(40, t, "user", f"turn {t % 3}") for t in range(400)] + random_rows(5, 60, 5)
    check(spark, rows, shard_rows=10, limit=20)


def test_first_turn_shared_by_most_and_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "IDS", 16)  # many chunks of ids
    rows = [(c * 20, 0, "user", "same start") for c in range(150)]
    rows += [(c * 20, 1, "bot", f"answer {c % 4}") for c in range(100)]
    check(spark, rows, shard_rows=12, limit=8)


def test_nulls_ties_repeated_rows_and_long_texts(spark):
    rows = [(20, None, None, None), (20, 1, "a", None), (20, 1, "a", "x y"), (20, 1, "a", "x y"), (20, 1, None, "x"),
            (21, 0, "a", "w " * 500_000), (22, 0, "a", "w " * 500_000), (None, 1, "a", "b"), (None, None, None, None),
            (41, 0, "user", "no base"), (-3, 0, "user", "below"), (-20, 0, "user", "base"), (0, 0, "user", "zero"), (23, 0, "", "")]
    check(spark, rows)


def test_empty_table_only_null_ids_and_clashing_columns(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0
    rows = random_rows(3, 30, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("c", "d", "i", "n", "k1", "LEN", "depth", "r", "x", "__rk_at"):
        df = df.withColumn(c, F.lit("q"))
    assert sorted((tuple(r) for r in conversation_trie(df).collect()), key=str) == brute(rows)


def test_queue_gives_back_spilled_messages_in_order():
    rnd = random.Random(1)
    q = SpillingQueue(limit=10)
    sent = [(rnd.randint(0, 30), rnd.randint(0, 3), i, i) for i in range(500)]
    for m in sent:
        q.push(m)
    assert q.spills > 10
    for a in range(31):
        for b in range(4):
            assert sorted(map(tuple, q.take(a, b))) == sorted(m for m in sent if m[:2] == (a, b))
    assert not q.heap and not q.runs
