from collections import defaultdict

import pytest
from helpers import space_words
from textbench.llm.mixing import mix_sources, source_targets


def _targets(sizes, weights=(3, 1, 2), budget=1.5, repeats=2):
    """Share, cap, and share what is over again, until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = budget * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level > repeats * sizes[s]}
        if not full:
            target.update({s: w[s] * level for s in open_})
            break
        for s in full:
            target[s] = repeats * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, "c": 10, None: 500}, {"a": 1}, {"a": 0, "b": 0},
    {"z": 5, "y": 50000, "x": 3, "é": 70, "B": 11, None: 1}, {f"s{i}": (i * 37) % 101 + 1 for i in range(30)}])
def test_targets_against_repeated_sharing(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    assert got == pytest.approx(_targets(sizes))


def test_mix_of_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mix_sources(docs, bucket_rows=100).collect()
    again = {r["doc_id"]: r["taken"] for r in mix_sources(docs.repartition(7)).collect()}
    assert len(rows) == docs.count() and {r["doc_id"]: r["taken"] for r in rows} == again
    sizes, taken, target, longest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in rows:
        assert r["size"] == len(space_words(r["text"])) and r["copies"] in (0, 1, 2) and r["taken"] == r["size"] * r["copies"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    assert target == pytest.approx(_targets(sizes))
    assert all(r["source_size"] == sizes[r["source"]] for r in rows)
    for s in sizes:  # a document is not cut, so a source may be off by one
        assert abs(taken[s] - target[s]) <= longest[s] + 1, s
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())


def test_edges(spark):
    rows = [(1, "a b c", None, "t"), (2, None, "s", "t"), (3, "", "s", "t"), (None, "x y", "s", "t"), (4, "p q", "s", "t"),
            (4, "p q", "s", "t"), (5, "word " * 5000, "long", "t"), (6, None, "empty", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, Target string")
    out = mix_sources(df)
    assert out.columns == ["doc_id", "text", "source", "size", "source_size", "target", "copies", "taken"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert {r["source"]: r["source_size"] for r in got} == {None: 3, "s": 6, "long": 5000, "empty": 0}
    assert mix_sources(df.where("false")).count() == 0


def test_no_python_in_the_plan(spark):
    plan = mix_sources(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_a_third_of_equal_rows_and_a_third_of_null_ids_are_spread_and_hit_their_target(spark):
    """Every repeat has its own place: a kind that is most of its source is taken in part."""
    rows = [(7, "same old words", "a")] * 400 + [(None, f"text number {i}", "a") for i in range(400)]
    rows += [(1000 + i, f"other text {i} of b", "b") for i in range(400)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 4), bucket_rows=50).collect()
    assert len(got) == 1200
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 6 for s in target), (taken, target)
    equal = [r["copies"] for r in got if r["doc_id"] == 7]
    nulls = [r["copies"] for r in got if r["doc_id"] is None]
    share = target["a"] / 2400
    for part in (equal, nulls):  # both kinds lie all along the queue
        assert abs(sum(part) / 400 - share) < 0.12
    again = mix_sources(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string"), weights=(1, 4)).collect()
    count = lambda rs: sorted((str(r["doc_id"]), r["text"], r["copies"]) for r in rs)
    assert count(again) == count(got)


def test_very_long_texts(spark):
    rows = [(i, "w " * (500_000 if i == 0 else 10), "s") for i in range(20)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r["size"] for r in got} == {500_000, 10} and sum(r["taken"] for r in got) <= 1.5 * sum(r["size"] for r in got)
