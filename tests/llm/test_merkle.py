"""Operator 13 against a tree built in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from textbench.llm.merkle import fold, leaf_digest, merkle_manifest, proof_digest, tamper_check

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """Root of the nodes and, per node, its (before, after) level by level."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + 16] for i in range(0, len(nodes), 16)]
        for k, pos in enumerate(at):
            run, q = runs[pos // 16], pos % 16
            paths[k].append(("".join(run[:q]), "".join(run[q + 1:])))
        at = [p // 16 for p in at]
        nodes = [sha("".join(r)) for r in runs]
    return nodes[0], paths


def brute(rows):
    """Sorted result rows of ``tamper_check`` for (doc_id, source, lang, n_chars, text) rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    climbed = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        climbed[g] = climb([leaf_of(r) for r in groups[g]])
    root, tops = climb([climbed[g][0] for g in order])
    out = []
    for g, top in zip(order, tops):
        subroot, paths = climbed[g]
        for r, path in zip(groups[g], paths):
            path = path + top
            claim = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                claim = (*r[:4], r[4].translate(LOWER))
            h = leaf_of(claim)
            for before, after in path:
                h = sha(before + h + after)
            out.append((r[0], leaf_of(r), subroot, root, sha("".join(a + b for a, b in path)), h, h == root))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = sorted((tuple(r) for r in tamper_check(df).collect()), key=str)
    assert got == brute(rows)
    return got


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*COLUMNS).collect()]
    got = check(spark, rows)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 3


def test_hot_source_of_several_rounds_and_many_sources(spark):
    hot = [(i * 3, "hot", None, i, f"Text {i}") for i in range(4200)]  # more than 256 * 16 leaves
    cold = [(10**9 + i, f"s{i:04d}", "en", 1, "A") for i in range(300)]  # more than 256 groups, of one leaf each
    check(spark, hot + cold + [(5, None, "en", 1, "É"), (4, None, "en", 1, "A b")])


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_sizes_about_the_edges_of_runs_and_blocks(spark, n):
    check(spark, [(i, "a", "en", 1, "ABC") for i in range(n)])


def test_nulls_empty_and_long_texts_ties_and_repeated_rows(spark):
    check(spark, [(None, None, None, None, None), (None, None, None, None, None), (1, "", "", 0, ""), (1, "", "", 0, ""),
                  (1, "", "", 0, "Other"), (-7, "é", "x", -3, "A" * 2_000_000), (2, "-", "-", None, "-"), (0, "z", None, 2, "ß\x00")])


def test_empty_table_and_clashing_columns(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert tamper_check(spark.createDataFrame([], schema)).count() == 0
    rows = [(i, "s", "en", 1, f"T{i}") for i in range(40)]
    df = spark.createDataFrame(rows, schema)
    for c in ("g", "i", "n", "h", "path", "Leaf", "root", "pos", "grp", "claim", "__rk_at"):
        df = df.withColumn(c, F.lit("x"))
    assert sorted((tuple(r) for r in tamper_check(df).collect()), key=str) == brute(rows)


def test_manifest_proves_each_row_and_no_other(spark):
    df = spark.createDataFrame([(i, i % 3, f"v{i}") for i in range(100)], "k long, part int, v string")
    m = merkle_manifest(df, ["k", "v"], "k", "part")
    assert m.where(fold() != F.col("root")).count() == 0
    forged = m.withColumn("claim", leaf_digest(F.col("k"), F.lit("other")))
    assert forged.where(fold() == F.col("root")).count() == 0
    assert m.select(proof_digest().alias("p")).distinct().count() == 100
