import math
import random

import numpy as np
from helpers import components
from textbench.llm.vectors import block_links, near_vectors, needed_collisions

SCHEMA = "vec_id long, embedding array<float>, label int, cls string, n_links string"


def _want(rows):
    ok = {}
    for i, v, label in rows:
        if label is None or v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        ok[i] = (label, np.asarray(np.float32(v), np.float64))
    links = [(a, b) for a in ok for b in ok if a < b and ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1])
             and ok[a][1] @ ok[b][1] / np.linalg.norm(ok[a][1]) / np.linalg.norm(ok[b][1]) >= 0.98]
    comp = components([r[0] for r in rows], links)
    return {i: (sum(i in x for x in links), comp[i], comp[i] == i) for i, _, _ in rows}


def _got(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "c", "n") for i, v, label in rows], SCHEMA)


def _rows():
    rnd = np.random.default_rng(1)
    rows, i = [], 0
    for label in (0, 1):
        for _ in range(12):
            base = rnd.standard_normal(16)
            for _ in range(6):  # around the threshold
                rows.append((i, [float(x) for x in base + rnd.standard_normal(16) * rnd.choice([0, 0.05, 0.1, 0.15, 0.2])], label))
                i += 1
    rows += [(i + k, list(rows[3][1]), 0) for k in range(5)] + [(i + 5, [x * 4 for x in rows[3][1]], 0)]
    i += 6
    nan, inf = float("nan"), float("inf")
    for v, label in ((None, 0), ([], 0), ([0.0] * 16, 0), ([nan] + [1.0] * 15, 0), ([inf] + [1.0] * 15, 0), ([None] + [1.0] * 15, 0),
                     (rows[3][1], None), ([1.0, 0.0], 0), ([1.0, 0.01], 0), ([1e-30] + [0.0] * 15, 1), ([1e30] + [0.0] * 15, 1), ([-0.0, 1.0], 1)):
        rows.append((i, v, label))
        i += 1
    return rows


def test_against_brute_force_and_any_block_size(spark):
    rows = _rows()
    assert _got(near_vectors(_frame(spark, rows))) == _want(rows)
    assert _got(near_vectors(_frame(spark, rows), block_rows=9)) == _want(rows)


def test_null_and_repeated_ids_and_empty(spark):
    v = [1.0, 2.0]
    rows = [(None, v, 1), (5, v, 1), (5, v, 1), (6, v, 1), (6, [-1.0, 0.5], 1), (7, [-1.0, 0.5], 1)]
    got = near_vectors(_frame(spark, rows)).collect()
    assert len(got) == 6
    assert sorted({(r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"]}) == [(5, 1, 5), (6, 2, 5), (7, 1, 5)]
    assert near_vectors(_frame(spark, [])).count() == 0


def test_recall_of_the_calibrated_count():
    """Pairs exactly at the threshold are found, unrelated ones hardly ever verified."""
    rnd = np.random.default_rng(7)
    x = rnd.standard_normal((600, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    o = rnd.standard_normal((600, 32))
    o -= (o * x).sum(1, keepdims=True) * x
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    y = 0.9801 * x + math.sqrt(1 - 0.9801 ** 2) * o
    found = set()
    for u, v in block_links(x, y, 0.98, 48):
        found.update(zip(u.tolist(), v.tolist()))
    assert {(i, i) for i in range(600)} <= found
    assert needed_collisions(48) >= 30
