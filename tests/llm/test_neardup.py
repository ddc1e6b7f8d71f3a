import random

import numpy as np
from helpers import components, similar_pairs, word_shingles
from textbench.llm.neardup import circulant_signature, near_duplicates

SCHEMA = "doc_id long, text string, n_shingles string, component_id string, id string, bands int, text_x string"


def _rows(spark, pairs):
    return spark.createDataFrame([(i, t, "x", "y", "z", 1, None) for i, t in pairs], SCHEMA)


def _want(pairs, k):
    sets = {i: word_shingles(t, k) for i, t in pairs}
    comp = components(sets, list(similar_pairs(sets)))
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}


def _got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_edges_and_families(spark):
    rnd = random.Random(1)
    base = [f"w{rnd.randrange(50)}" for _ in range(120)]
    pairs = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "é ß 漢字 é ß"), (8, "É ß 漢字 é ß")]
    for i in range(30):
        w = list(base)
        for _ in range(i % 6):
            w[rnd.randrange(len(w))] = f"v{rnd.randrange(1000)}"
        pairs.append((100 + i, " ".join(w).title() if i % 3 else " \n ".join(w)))
    pairs.append((300, " ".join(base * 400)))
    pairs.append((301, " ".join(base * 380)))
    for k in (2, 5):
        assert _got(near_duplicates(_rows(spark, pairs), k=k)) == _want(pairs, k)


def test_null_and_repeated_ids(spark):
    pairs = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f"), (2, "x y z u v w"),
             (9, "x y z u v w"), (9, "x y z u v w")]
    got = near_duplicates(_rows(spark, pairs), k=2).collect()
    assert len(got) == 7
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got if r["doc_id"]) == [
        (2, 2, True), (2, 2, True), (3, 2, False), (9, 2, False), (9, 2, False)]
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)


def test_empty_table(spark):
    out = near_duplicates(_rows(spark, []), k=5)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"] and out.count() == 0


def test_whole_small_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert _got(near_duplicates(docs, k=2)) == _want(pairs, 2)


def test_signature_estimates_jaccard():
    rnd = np.random.default_rng(2)
    x = rnd.integers(0, 2**63, 1000, dtype=np.uint64)
    a, b = x[:900], x[100:]
    agree = (circulant_signature(a, 2048) == circulant_signature(b, 2048)).mean()
    assert abs(agree - 0.8) < 0.03
    big = rnd.integers(0, 2**63, 5000, dtype=np.uint64)
    parts = np.minimum(circulant_signature(big[:2500], 64), circulant_signature(big[2500:], 64))
    assert (circulant_signature(big, 64) == parts).all()
