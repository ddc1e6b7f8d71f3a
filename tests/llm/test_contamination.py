import hashlib

from helpers import alnum_words
from textbench.llm.contamination import contamination

DOCS = "doc_id long, text string, n_words string, hits string, item string"


def _want(docs, items, size=10):
    windows = []
    for item, text in items:
        w = alnum_words(text)
        k = min(size, len(w))
        windows += [(item, w[i:i + k]) for i in range(len(w) - k + 1)] if k else []
    out = {}
    for i, text in docs:
        w, on, found = alnum_words(text), set(), set()
        for item, win in windows:
            for at in range(len(w) - len(win) + 1):
                if w[at:at + len(win)] == win:
                    on.update(range(at, at + len(win)))
                    if item is not None:
                        found.add(str(item))
        ids = sorted(found)
        out[i] = (len(w), len(on), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(on))
    return out


def _got(df):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect()}


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "Short item"), (10, "one"),
         (3, None), (4, "?!"), (None, "nobody owns this"), (2, "Short item"), (5, "is on is on is on is on is on is on is on"),
         (6, "é1 ñandú ßx 漢字 five six seven eight nine ten eleven")]
TEXTS = [(1, None), (2, ""), (3, "two three four five six seven eight nine ten eleven twelve"),
         (4, "a b One-two. THREE four, five six seven eight nine ten x two three"), (5, "a short! ITEM, short item item"),
         (6, "nobody owns this; nobody owns that"), (7, "is on " * 3000), (8, "É1 ñandú ßx 漢字 five six seven eight nine ten"),
         (9, "é1 ñandú ßx 漢字 five six seven eight nine ten eleven " * 2), (10, "one two three four five six seven eight nine ten"),
         (11, "two three four five six seven eight nine ten"), (12, "on is on is on is on is on is")]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "n", "h", "i") for i, t in TEXTS], DOCS)
    bench = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, words string")
    want = _want(TEXTS, ITEMS)
    assert _got(contamination(docs, bench)) == want
    assert contamination(docs, bench).columns[:4] == ["doc_id", "text", "hits", "item"]
    # several passes over blocks of the benchmark give the same
    assert _got(contamination(docs, bench, block_words=12, keep=["doc_id"])) == want


def test_repeated_rows_empty_tables_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "short item", "", "", ""), (1, "short item", "", "", ""), (1, "short item", "", "", "")], DOCS)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert [r["n_hit"] for r in contamination(docs, bench).collect()] == [2, 2, 2]
    none = contamination(docs, bench.where("false")).collect()
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in none] == [(2, 0, False)] * 3
    assert contamination(docs.where("false"), bench).count() == 0


def test_whole_small_table(spark):
    path = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")
    want = _want([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()])
    assert _got(contamination(docs, bench, keep=["doc_id"])) == want
    assert any(x[4] for x in want.values())


def test_items_repeated_in_most_rows_fill_no_block(spark, monkeypatch):
    """All copies of an item meet in its block once, and results are those of one copy."""
    from textbench.llm import contamination as C

    docs = spark.createDataFrame([(1, "one two three four"), (2, "five six"), (3, "seven")], "doc_id long, text string")
    items = [("a", "two three")] * 200 + [("b", "six")] * 50 + [("c", None), ("d", "nothing here")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    sizes = []
    real = C.Windows
    monkeypatch.setattr(C, "Windows", lambda rows, size: sizes.append(len(rows)) or real(rows, size))
    got = {r["doc_id"]: (r["n_hit"], r["item_ids"]) for r in C.contamination(docs, bench, block_words=2).collect()}
    assert got == {1: (2, ["a"]), 2: (1, ["b"]), 3: (0, [])} and sum(sizes) <= 4
