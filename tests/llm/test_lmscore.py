import math
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from helpers import space_words
from textbench.llm import lmscore
from textbench.llm.lmscore import cross_entropy_difference

BG = [(1, "the cat sat on the mat the end"), (2, "THE dog sat on the log"), (3, None), (4, ""), (5, "the cat the cat zebra"),
      (6, "漢字 漢字 ñu"), (6, "漢字 漢字 ñu"), (None, "the the the the")]
TG = ["the cat sat", "cat sat on the mat", None, ""]


def _want(docs, target, d=0.75, min_count=2):
    """Both models by dictionaries: discounted bigrams over add-one unigrams."""
    words = {"b": Counter(), "t": Counter()}
    for name, texts in (("b", docs), ("t", target)):
        for x in texts:
            words[name].update(space_words(x))
    nb, nt = sum(words["b"].values()), sum(words["t"].values())
    ratio = nb / nt if nt else 0.0
    voc = {w for w in {**words["b"], **words["t"]} if words["b"][w] + ratio * words["t"][w] >= min_count}

    def pairs(x):
        w = [t if t in voc else "<unk>" for t in space_words(x)]
        return list(zip(["<s>"] + w[:-1], w))

    grams = {n: Counter(p for x in texts for p in pairs(x)) for n, texts in (("b", docs), ("t", target))}
    kept = {g for g in {**grams["b"], **grams["t"]} if grams["b"][g] + ratio * grams["t"][g] >= min_count}
    size = len(voc) + 1

    def loss(n, v, w):
        uni, ctx = Counter(), Counter()
        for (a, b), c in grams[n].items():
            uni[b] += c
            ctx[a] += c
        part = {g: max(grams[n][g] - d, 0) / ctx[g[0]] for g in kept if ctx[g[0]]}
        back = max(1 - sum(p for g, p in part.items() if g[0] == v), 1e-12)
        return -math.log2(part.get((v, w), 0) + back * (uni[w] + 1) / (sum(uni.values()) + size))

    out = []
    for x in docs:
        p = pairs(x)
        out.append((len(p), *(sum(loss(n, *g) for g in p) / len(p) if p else None for n in ("t", "b"))))
    return out


def test_against_dictionaries(spark):
    docs = spark.createDataFrame([(i, t, "s", "k") for i, t in BG], "doc_id long, text string, Score string, key string").coalesce(1)
    target = spark.createDataFrame([(t, 1) for t in TG], "text string, n int")
    out = cross_entropy_difference(docs, target)
    assert out.columns == ["doc_id", "text", "key", "n_tokens", "loss_target", "loss_background", "score"]
    for r, (n, lt, lb) in zip(out.collect(), _want([t for _, t in BG], TG)):
        assert r["n_tokens"] == n
        if n:
            assert (r["loss_target"], r["loss_background"]) == pytest.approx((lt, lb), rel=1e-5)
            assert r["score"] == pytest.approx(r["loss_target"] - r["loss_background"])
        else:
            assert r["loss_target"] is None and r["score"] is None


def test_target_like_texts_score_lower(spark):
    docs = spark.createDataFrame([(i, f"stock market price {i % 7} falls" if i % 2 else f"green tea and cake number {i % 5}") for i in range(200)],
                                 "doc_id long, text string")
    target = spark.createDataFrame([("green tea and cake",), ("tea and cake number 3",)], "text string")
    got = {r["doc_id"]: r["score"] for r in cross_entropy_difference(docs, target).collect()}
    assert max(s for i, s in got.items() if i % 2 == 0) < min(s for i, s in got.items() if i % 2)


def test_bounds_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h a b c d"), (2, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    assert all(math.isfinite(r["score"]) for r in cross_entropy_difference(docs, none).collect())
    assert all(math.isfinite(r["score"]) for r in cross_entropy_difference(docs, docs, vocabulary=2, model=1).collect())
    assert cross_entropy_difference(docs.where("false"), docs).count() == 0


def test_models_have_no_size_limit(spark):
    # 80,000 words, each of which has evidence: more than the 65,000 of a capped vocabulary
    texts = [f"a{i % 40_000} b{i % 40_000} a{i % 40_000}" for i in range(80_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    target = spark.createDataFrame([("a1 b1",)], "text string")
    got = [r["loss_background"] for r in cross_entropy_difference(docs, target, keep=["doc_id"]).collect()]
    # all documents have the same counts in the background, so none may be scored by back-off alone
    assert len(got) == 80_000 and max(got) == pytest.approx(min(got))


def test_joined_values_against_dictionaries(spark):
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(BG)], "doc_id long, text string")
    target, want = spark.createDataFrame([(t,) for t in TG], "text string"), _want([t for _, t in BG], TG)
    for r in cross_entropy_difference(docs, target, hot=1, hot_rows=1).collect():
        n, lt, lb = want[r["doc_id"]]
        assert r["n_tokens"] == n
        assert not n or (r["loss_target"], r["loss_background"]) == pytest.approx((lt, lb), rel=1e-9)


@pytest.mark.parametrize("bits", [6, 8, 26])
def test_words_that_bit_tables_leave_open(spark, bits):
    """With 64 bits most words seem to be inside the vocabulary and outside it;
    the values are those of the dictionaries all the same."""
    texts = [t for _, t in BG] + [f"rare{i} the cat once{i} sat rare{i} on once{i + 1}" for i in range(40)] + ["alone" * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = _want(texts, TG)
    got = cross_entropy_difference(docs, spark.createDataFrame([(t,) for t in TG], "text string"), filter_bits=bits, hot=8).collect()
    assert len(got) == len(want)
    for r in got:
        n, lt, lb = want[r["doc_id"]]
        assert r["n_tokens"] == n
        assert not n or (r["loss_target"], r["loss_background"]) == pytest.approx((lt, lb), rel=1e-9)


def test_consumed_tables_are_deleted(spark):
    from textbench.session import checkpoint_dir

    def tables():
        found = (Path(checkpoint_dir(spark).removeprefix("file:")) / "llm").glob("lm-*")
        return {p.name.rsplit("-", 1)[0]: p for p in found if p not in old}

    old = set((Path(checkpoint_dir(spark).removeprefix("file:")) / "llm").glob("lm-*"))
    docs = spark.createDataFrame(list(enumerate(["a b a b c"] * 20)), "doc_id long, text string")
    out = cross_entropy_difference(docs, docs)
    assert set(tables()) == {"lm-scored", "lm-tails"}
    assert out.count() == 20


def test_very_long_text(spark):
    text = "alpha beta gamma " * 200_000 + "z" * 300_000
    docs = spark.createDataFrame([(1, text), (2, "alpha beta"), (3, "z" * 300_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in cross_entropy_difference(docs, docs.where("doc_id = 2"), keep=["doc_id"]).collect()}
    assert got[1]["n_tokens"] == 600_001 and got[3]["n_tokens"] == 1
    assert all(math.isfinite(r["score"]) for r in got.values())


def test_packed_bigrams_come_back():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5000):
        words = rng.integers(0, 2**64 - 1, max(n // 3, 1), dtype=np.uint64, endpoint=True)
        v, w, c = rng.choice(words, n), rng.choice(words, n), rng.integers(1, 2**40, n)
        for a, b in zip((v, w, c), lmscore._unpack(lmscore._pack(v, w, c))):
            assert a.dtype == b.dtype and (a == b).all()


def test_bigrams_of_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "BUCKET", 7)
    texts = [t for _, t in BG] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = _want(texts, TG)
    for r in cross_entropy_difference(docs, spark.createDataFrame([(t,) for t in TG], "text string")).collect():
        n, lt, lb = want[r["doc_id"]]
        assert r["n_tokens"] == n
        assert not n or (r["loss_target"], r["loss_background"]) == pytest.approx((lt, lb), rel=1e-9)


def test_places_in_a_table_of_hashes():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 1000):
        table = np.unique(np.concatenate((rng.integers(0, 2**64 - 1, n, dtype=np.uint64), np.arange(n, dtype=np.uint64))))
        asked = np.concatenate((table, rng.integers(0, 2**64 - 1, 50, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)))
        at, has = lmscore._find(table, asked, lmscore._index(table))
        assert (has == np.isin(asked, table)).all()
        assert not n or (table[at[has]] == asked[has]).all()
