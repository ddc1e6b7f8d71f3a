"""Operator 1: cross-entropy difference scores from matched n-gram models.

Two bigram models, of a target and of a background corpus, share one vocabulary
(the words of both, those without evidence are one unknown word), one order,
one discount and one way of backing off, so that the loss of a token under the
one can be compared with its loss under the other.  A document's score is the
mean over its tokens of loss(target) - loss(background), in bits: the lower,
the more it is like the target.

Counts cover both corpora whole, and so do the models: target counts are scaled
to the background's size ("matched"), and every word and every bigram of a
matched count of MIN_COUNT at least belongs to them, however many those are.
All tables stay on Spark.  As

    -log2(part(v, w) + back(v) p1(w)) = -log2 back(v) - log2 p1(w) - log2(1 + part(v, w) / (back(v) p1(w))),

a document's loss is a sum of values of its words and of its bigrams.  Values
of the most frequent ones are broadcast (a fixed number, so that no key of the
join is hot); the other words and bigrams of a document are joined with theirs.

Every word is in the vocabulary or outside it, and a bit table of either side is
broadcast.  Where only one of them has a word, that settles it: a word outside is
replaced by the unknown one before its bigrams are counted or looked up.  Words
that both tables seem to have stay as they are and are settled by joins, so the
size of the tables changes the work, never the result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textbench.llm.common import FILTER_BITS, int64_list, materialise, release, row_slices, text_buffers, unused_name
from textbench.llm.words import U64, WordScanner

DISCOUNT = 0.75
MIN_COUNT = 2  # a matched count below this is no evidence; it may be the scored text's own
FLUSH = 1 << 18  # distinct entries that a task counts before it hands them over
BUCKET = 1 << 19  # tokens whose bigrams are summed at a time; changes no result
PARTS = 2  # parts in which the values that are not broadcast are joined; changes no result
HOT = 1 << 20  # values that are broadcast, not joined; changes no result
HOT_ROWS = 1 << 16  # rows of a table that are joined by broadcast; changes no result
BEGIN, UNKNOWN = 1, 2  # in place of a word's hash
INNER, LAST = 3, 4  # in place of a bigram's second word: the value of a word in a text, and at its end


def pair_hash(v: np.ndarray, w) -> np.ndarray:
    """What Spark's ``xxhash64(v, w)`` gives for two longs."""
    p1, p2, p3, p4, p5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                           0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = np.full(len(v), 42, U64)
    for x in (v, np.broadcast_to(np.asarray(w, U64), v.shape)):
        x = x * p2
        h = (h + p5 + U64(8)) ^ (((x << U64(31)) | (x >> U64(33))) * p1)
        h = ((h << U64(27)) | (h >> U64(37))) * p1 + p4
        h = (h ^ (h >> U64(33))) * p2
        h = (h ^ (h >> U64(29))) * p3
        h = h ^ (h >> U64(32))
    return h


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts ``x``, and where a new value begins in it."""
    order = np.argsort(x)
    y = x[order]
    new = np.ones(len(x), bool)
    new[1:] = y[1:] != y[:-1]
    return order, new


def _fold(keys, cols, counts):
    """Rows of equal key as one: their ``cols`` (equal in all of them), the sums of their ``counts``."""
    k = np.concatenate(keys)
    order, new = _runs(k)
    at = np.flatnonzero(new)
    first = order[at]
    cols = [np.concatenate(c)[first] for c in zip(*cols)]
    counts = [np.concatenate(c)[order] for c in zip(*counts)]
    return k[first], cols, [np.add.reduceat(c, at) if len(at) else c for c in counts]


def _count(docs: DataFrame, extract, schema: str) -> DataFrame:
    """Partial sums of the rows (key, columns, counts) that the first function of ``extract()`` makes
    of (hashes, first), as its second one returns them."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        scanner = WordScanner("space")
        state, finish = extract()
        keys, cols, counts, held = [], [], [], 0

        def rows(k, c, n):
            return pa.RecordBatch.from_arrays(finish(k, c, n), names=names)

        for batch in batches:
            offsets, data = text_buffers(batch.column(0))
            for i, j in row_slices(offsets):
                k, c, n = state(*scanner.scan(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]))
                keys.append(k)
                cols.append(c)
                counts.append(n)
                held += len(k)
                if held > 2 * FLUSH:
                    k, c, n = _fold(keys, cols, counts)
                    keys, cols, counts, held = [k], [c], [n], len(k)
                    if held > FLUSH:
                        yield rows(k, c, n)
                        keys, cols, counts, held = [], [], [], 0
        if keys:
            yield rows(*_fold(keys, cols, counts))

    return docs.select("text").mapInArrow(run, schema)


def _both(background: DataFrame, target: DataFrame, extract, schema: str, keys: list[str], counts: list[str]) -> DataFrame:
    """Sums of ``counts`` by ``keys``, as b_... of the background and t_... of the target."""
    zero = F.lit(0).cast("long")

    def side(df, name):
        return _count(df, extract, schema).select(*keys, *[
            (F.col(c) if m == name else zero).alias(f"{m}_{c}") for c in counts for m in "bt"])

    return side(background, "b").unionAll(side(target, "t")).groupBy(*keys).agg(
        *[F.sum(f"{m}_{c}").alias(f"{m}_{c}") for c in counts for m in "bt"])


def _longs(*cols) -> list[pa.Array]:
    return [pa.array(x.view(np.int64)) for x in cols]


def _planes(x: np.ndarray) -> bytes:
    """The bytes of ``x``, the lowest of all numbers first, then the next ones."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _pack(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> bytes:
    """Bigrams and their counts: distinct words as differences, then places among them."""
    x = np.concatenate((v, w))
    order, new = _runs(x)
    words, at = x[order[new]], np.empty(len(x), np.int64)
    at[order] = np.cumsum(new) - 1
    parts = [np.array([len(words), len(v)], "<u8").tobytes(), _planes(np.diff(words, prepend=U64(0)).astype("<u8")),
             _planes(at.astype("<u4")), _planes(n.astype("<u8"))]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)
    size, n = (int(x) for x in data[:16].view("<u8"))

    def numbers(start, count, kind):
        width = np.dtype(kind).itemsize
        return np.ascontiguousarray(data[start:start + count * width].reshape(width, count).T).view(kind).ravel()

    words = np.cumsum(numbers(16, size, "<u8"), dtype=U64)
    at = numbers(16 + 8 * size, 2 * n, "<u4")
    return words[at[:n]], words[at[n:]], numbers(16 + 8 * size + 8 * n, n, "<u8").astype(np.int64)


def _bigrams(background: DataFrame, target: DataFrame, shared, tokens: int, ratio: float) -> DataFrame:
    """v, w, open, b_n, t_n of the bigrams that reach MIN_COUNT, have a word in
    doubt (``open``: 1 the first, 2 the second) or the unknown word.

    Tasks hand over packed blocks of bigrams by a share of their hash.  There is
    a share for every BUCKET tokens, so that the bigrams of one, which one task
    sums, stay few at every size (two shares a task); a frequent bigram is one entry of a block."""
    buckets = max(1, -(-tokens // BUCKET))

    def pairs_of():
        sides = shared.value

        def found(h, first):
            h = _settle(sides, h)
            v = _before(h, first)
            return pair_hash(v, h), [v, h], [np.ones(len(h), np.int64)]

        def finish(k, cols, counts):
            share = (k % U64(buckets)).astype(np.int64)
            order = np.argsort(share, kind="stable")
            share, (v, w, n) = share[order], (x[order] for x in (*cols, *counts))
            cut = np.flatnonzero(np.diff(share, prepend=-1))
            ends = np.append(cut[1:], len(share))
            return [pa.array(share[cut]), pa.array([_pack(v[i:j], w[i:j], n[i:j]) for i, j in zip(cut, ends)], pa.binary())]

        return found, finish

    def merged(held):
        sides = shared.value
        keys, cols, counts = [], [], []
        for side, block in held:
            v, w, n = _unpack(block)
            keys.append(pair_hash(v, w))
            cols.append([v, w])
            counts.append([n * (1 - side), n * side])
        _, (v, w), (b, t) = _fold(keys, cols, counts)
        doubt = _in_doubt(sides, v).astype(np.int64) + 2 * _in_doubt(sides, w).astype(np.int64)
        keep = (b + t * ratio >= MIN_COUNT) | (doubt > 0) | (v == UNKNOWN) | (w == UNKNOWN)
        return pa.RecordBatch.from_arrays(_longs(*(x[keep] for x in (v, w, doubt, b, t))), names=["v", "w", "open", "b_n", "t_n"])

    def merge(batches):
        held, last = [], None
        for batch in batches:
            for bucket, side, block in zip(*(batch.column(i) for i in range(3))):
                if held and bucket.as_py() != last:
                    yield merged(held)
                    held = []
                last = bucket.as_py()
                held.append((side.as_py(), block.as_py()))
        if held:
            yield merged(held)

    blocks = [_count(df, pairs_of, "bucket long, block binary").select("bucket", F.lit(side).alias("side"), "block")
              for side, df in enumerate((background, target))]
    blocks = blocks[0].unionAll(blocks[1]).repartitionById(
        -(-buckets // 2), F.col("bucket").cast("int")).sortWithinPartitions("bucket")
    return blocks.mapInArrow(merge, "v long, w long, open long, b_n long, t_n long")


def _hottest(df: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """``df`` as the rows of the highest ``n`` (at most ``size``) and the others:
    the lowest bound of which that holds, from a histogram of rounded-down
    logarithms (and of the values themselves, up to 1024)."""
    n = F.col("n")
    step = F.when(n < 1024, n).otherwise(F.floor(F.log2(n.cast("double")) * 64) + 384)
    hist = sorted(df.select(step.cast("long").alias("s")).groupBy("s").agg(F.count("*").alias("c")).collect(), reverse=True)
    total, low = 0, None
    for r in hist:
        if total + r["c"] > size:
            break
        total, low = total + r["c"], r["s"]
    if low is None:
        return df.where(F.lit(False)), df
    return df.where(step >= low), df.where(step < low)


def _join(df: DataFrame, table: DataFrame, on: list[str], size: int = HOT_ROWS) -> DataFrame:
    """Inner join; the rows of ``table`` with the highest ``n`` reach ``df`` by broadcast."""
    hot, rest = _hottest(table, size)
    cold = df.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest.drop("n"), on)
    return df.join(F.broadcast(hot.drop("n")), on).unionByName(cold)


def _bits(keys: DataFrame, size: int) -> np.ndarray:
    """A table of 2^size bits, those of the hashes in ``keys`` set."""
    place = F.shiftrightunsigned(F.col(keys.columns[0]), 64 - size)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    rows = keys.select(F.shiftright(place, 6).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (size - 6), U64)
    out[rows.column("at").to_numpy()] = rows.column("bit").to_numpy().view(U64)
    return out


def _maybe(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h >> U64(64 - (64 * len(bits) - 1).bit_length())
    return (bits[(place >> U64(6)).astype(np.int64)] >> (place & U64(63))) & U64(1) == 1


def _settle(words: tuple, h: np.ndarray) -> np.ndarray:
    """``h`` with UNKNOWN for the words that are outside the vocabulary beyond doubt."""
    outside, inside = words[:2]
    return np.where(_maybe(outside, h) & ~_maybe(inside, h), U64(UNKNOWN), h)


def _in_doubt(words: tuple, h: np.ndarray) -> np.ndarray:
    """Which of the settled words ``h`` the bit tables leave open."""
    outside, inside, common, index = words
    return (h != BEGIN) & (h != UNKNOWN) & _maybe(outside, h) & _maybe(inside, h) & ~_find(common, h, index)[1]


def _index(table: np.ndarray) -> np.ndarray:
    """Where the values of each leading part of a hash begin in the sorted ``table``."""
    bits = max(1, len(table).bit_length())
    starts = np.arange(1 << bits, dtype=U64) << U64(64 - bits)
    return np.append(np.searchsorted(table, starts), len(table)).astype(np.int32)


def _find(table: np.ndarray, h: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``h`` in the sorted ``table`` of hashes, and whether they are there."""
    if not len(table):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    part = (h >> U64(64 - (len(index) - 2).bit_length())).astype(np.int64)
    at, end = index[part].astype(np.int64), index[part + 1]
    left = np.flatnonzero(at < end)
    while len(left):
        # few values share a leading part, so the rows that go on are soon none
        left = left[table[at[left]] < h[left]]
        at[left] += 1
        left = left[at[left] < end[left]]
    at = np.minimum(at, len(table) - 1)
    return at, table[at] == h


def _before(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The word before each word; BEGIN before the first of a text."""
    v = np.empty(len(h), U64)
    v[1:] = h[:-1]
    v[first[:-1][np.diff(first) > 0]] = BEGIN
    return v


def _last(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    last = np.zeros(len(h), bool)
    last[first[1:][np.diff(first) > 0] - 1] = True
    return last


def _top(counts: DataFrame, value, size: int | None, keys: list[str]) -> DataFrame:
    """The rows of a matched count of MIN_COUNT at least; if the caller asks for
    fewer, the ``size`` highest (the smaller key first among equal ones)."""
    rows = counts.where(value >= MIN_COUNT)
    return rows if size is None else rows.orderBy(value.desc(), *keys).limit(size)


def fit(background: DataFrame, target: DataFrame, vocabulary: int | None = None, model: int | None = None,
        discount: float = DISCOUNT, hot: int = HOT, hot_rows: int = HOT_ROWS, filter_bits: int = FILTER_BITS) -> dict:
    """Both models as a table of values (key, n, b, t), and what holds for words that are not in it."""
    spark = background.sparkSession

    def words_of():
        def found(h, first):
            last = _last(h, first)
            return h, [], [np.ones(len(h), np.int64), last.astype(np.int64)]

        return found, lambda k, cols, counts: _longs(k, *counts)

    words = materialise(_both(background, target, words_of, "v long, n long, last long", ["v"], ["n", "last"]), "lm-words")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("b_n", "t_n", "b_last", "t_last")]
    size = words.agg(*sums).first()
    ratio = float(size["b_n"]) / size["t_n"] if size["t_n"] else 0.0
    matched = F.col("b_n") + F.col("t_n") * F.lit(ratio)
    total = F.col("b_n") + F.col("t_n")
    voc = _top(words, matched, vocabulary, ["v"])
    voc = voc if vocabulary is None else materialise(voc, "lm-vocabulary")
    others = words.where(matched < MIN_COUNT) if vocabulary is None else words.join(voc.select("v"), "v", "left_anti")
    others = others.select("v")
    n_voc = voc.agg(F.count("*").alias("n"), *sums).first()
    common = _hottest(voc.withColumn("n", total), hot_rows)[0].select("v").toArrow().column("v").to_numpy()
    common = np.sort(common.view(U64))
    sides = (_bits(others, filter_bits), _bits(voc.select("v"), filter_bits), common, _index(common))
    shared = spark.sparkContext.broadcast(sides)
    has_unknown = (F.col("v") == UNKNOWN) | (F.col("w") == UNKNOWN)
    grams = materialise(_bigrams(background, target, shared, size["b_n"] + size["t_n"], ratio), "lm-bigrams")
    # bigrams with a word in doubt: v1, w1 are the words as the models know them
    unknown = F.lit(UNKNOWN).cast("long")
    asked, before = grams.where(F.col("open") > 0), []
    for c, bit in (("v", 1), ("w", 2)):
        mine = asked.where(F.col("open").bitwiseAND(bit) > 0)
        rest = asked.where(F.col("open").bitwiseAND(bit) == 0).withColumn(f"{c}1", F.col(c))
        mine = mine.join(others.select(F.col("v").alias(c), unknown.alias(f"{c}1")), c, "left").withColumn(
            f"{c}1", F.coalesce(f"{c}1", c))
        asked = materialise(mine.unionByName(rest), f"lm-open-{c}")
        release(*before)
        before = [asked]
    settled = grams.where(F.col("open") == 0).select("v", "w", "b_n", "t_n").unionAll(
        asked.select(F.col("v1").alias("v"), F.col("w1").alias("w"), "b_n", "t_n"))
    # only bigrams with the unknown word come together from several rows
    counts = settled.where(~has_unknown).unionAll(settled.where(has_unknown).groupBy("v", "w").agg(
        F.sum("b_n").alias("b_n"), F.sum("t_n").alias("t_n")))
    kept = materialise(_top(counts, matched, model, ["v", "w"]), "lm-kept")
    release(grams)

    # of each word: the share that its kept successors leave, and its own probability
    zero = F.lit(0.0)
    parts = {m: F.greatest(F.col(f"{m}_n") - discount, zero) for m in "bt"}
    given = kept.groupBy("v").agg(*[F.sum(parts[m]).alias(f"{m}_given") for m in "bt"])
    left = {c: size[c] - n_voc[c] for c in ("b_n", "t_n", "b_last", "t_last")}
    fixed = spark.createDataFrame([(BEGIN, 0, 0, -size["b_last"], -size["t_last"]),
                                   (UNKNOWN, left["b_n"], left["t_n"], left["b_last"], left["t_last"])],
                                  "v long, b_n long, t_n long, b_last long, t_last long")
    of = voc.select(*fixed.columns).unionAll(fixed).join(given, "v", "left")
    cols = [F.col("v"), total.alias("n")]
    for m in "bt":
        ctx = F.col(f"{m}_n") - F.col(f"{m}_last")
        back = F.when(ctx > 0, 1.0 - F.coalesce(f"{m}_given", zero) / F.when(ctx > 0, ctx)).otherwise(1.0)
        cols += [ctx.alias(f"{m}_ctx"), F.greatest(back, F.lit(1e-12)).alias(f"{m}_back"),
                 ((F.col(f"{m}_n") + 1) / F.lit(float(size[f"{m}_n"] + n_voc["n"] + 1))).alias(f"{m}_p")]
    of = materialise(of.select(*cols), "lm-word-values")
    release(words)
    if vocabulary is not None:
        release(voc)
    base = {r["v"]: r for r in of.where(F.col("v").isin(BEGIN, UNKNOWN)).collect()}

    rows = kept.withColumn("count", total)
    rows = _join(rows, of.select("v", "n", *[f"{m}_{c}" for c in ("ctx", "back") for m in "bt"]), ["v"], hot_rows)
    rows = _join(rows, of.select(F.col("v").alias("w"), "n", "b_p", "t_p"), ["w"], hot_rows)
    gain = {m: -F.log2(1.0 + F.when(F.col(f"{m}_ctx") > 0, parts[m] / F.when(F.col(f"{m}_ctx") > 0, F.col(f"{m}_ctx"))).otherwise(0.0)
                       / (F.col(f"{m}_back") * F.col(f"{m}_p"))) for m in "bt"}
    rows = materialise(rows.select("v", "w", F.col("count").alias("n"), gain["b"].alias("b"), gain["t"].alias("t")), "lm-bigram-values")
    release(kept)

    # texts are asked with the words that the bit tables settle, so the others have keys of their own
    key = F.xxhash64("v", "w")
    closed = rows.select(key.alias("key"), "n", "b", "t")
    opened = asked.where((F.col("v") != F.col("v1")) | (F.col("w") != F.col("w1"))).select(
        key.alias("key"), F.col("v1").alias("v"), F.col("w1").alias("w"), total.alias("count"))
    opened = _join(opened, rows.where(has_unknown), ["v", "w"], hot_rows)
    opened = opened.select("key", F.col("count").alias("n"), "b", "t")
    loss = {}
    for m in "bt":
        u = base[UNKNOWN]
        loss[m] = {"begin": -np.log2(base[BEGIN][f"{m}_back"]), "back": -np.log2(u[f"{m}_back"]), "word": -np.log2(u[f"{m}_p"])}
    known = of.where((F.col("v") != BEGIN) & (F.col("v") != UNKNOWN))
    single = []
    for at in (INNER, LAST):
        value = [(-F.log2(f"{m}_p") - F.lit(float(loss[m]["word"])) + (
            -F.log2(f"{m}_back") - F.lit(float(loss[m]["back"])) if at == INNER else zero)).alias(m) for m in "bt"]
        single.append(known.select(F.xxhash64("v", F.lit(at).cast("long")).alias("key"), "n", *value))
    values = materialise(closed.unionAll(opened).unionAll(single[0]).unionAll(single[1]), "lm-values")
    release(of, rows, asked)
    top, rest = _hottest(values, hot)
    top = top.select("key", "b", "t").toArrow()
    at = np.argsort(top.column("key").to_numpy().view(U64))
    keys = top.column("key").to_numpy().view(U64)[at]
    return {"loss": loss, "words": sides, "key": keys, "index": _index(keys),
            "bits": _bits(rest.select("key"), filter_bits), "rest": rest.select("key", "b", "t"), "values": values, **{m: top.column(m).to_numpy()[at] for m in "bt"}}


def cross_entropy_difference(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text: str = "text",
                             keep: list[str] | None = None, **options) -> DataFrame:
    """One row per document: the columns ``keep`` (all by default), then
    n_tokens, loss_target, loss_background (bits per token) and score (their
    difference).

    Words are lower-cased (A-Z) runs without ASCII white space.  A null or
    wordless text has n_tokens 0 and null losses and score.  Repeated rows count
    each time.  An empty target leaves its model uniform over the vocabulary;
    empty documents give an empty result.  Extra columns pass through; those
    named like a result are left out.  ``vocabulary`` and ``model`` ask for
    smaller models (the words and bigrams of the highest matched counts).
    """
    results = ["n_tokens", "loss_target", "loss_background", "score"]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in results]
    text = F.col(f"`{text_col}`")
    model = fit(docs.select(text.alias("text")), target.select(F.col(f"`{target_text}`").alias("text")), **options)
    rest, values = model.pop("rest"), model.pop("values")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*[F.col(f"`{c}`") for c in keep], text.alias("n_tokens"))
    tail, rid = unused_name(source, "tail"), unused_name(source, "rid")
    schema = T.StructType(source.schema.fields[:-1])
    schema = schema.add("n_tokens", "long").add("loss_target", "double").add("loss_background", "double")
    schema = schema.add(tail, T.ArrayType(T.LongType(), False))

    def run(batches):
        m = shared.value
        scanner = WordScanner("space")
        for batch in batches:
            offsets, data = text_buffers(batch.column(batch.num_columns - 1))
            n, sums, open_keys, open_counts = [], {"t": [], "b": []}, [], []
            for i, j in row_slices(offsets):
                h, first = scanner.scan(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                h = _settle(m["words"], h)
                size = np.diff(first)
                n.append(size)
                # the values of a word stand beside each other: its bigram's and its own
                keys = np.empty(2 * len(h), U64)
                keys[::2] = pair_hash(_before(h, first), h)
                keys[1::2] = pair_hash(h, np.where(_last(h, first), U64(LAST), U64(INNER)))
                at, has = _find(m["key"], keys, m["index"])
                for name, out in sums.items():
                    value = np.where(has, m[name][at], 0.0) if len(m["key"]) else np.zeros(len(keys))
                    total = np.concatenate(([0.0], np.cumsum(value)))
                    c = m["loss"][name]
                    out.append(total[2 * first[1:]] - total[2 * first[:-1]] + c["begin"] + c["word"] * size + c["back"] * (size - 1))
                wanted = ~has & _maybe(m["bits"], keys)
                upto = np.concatenate(([0], np.cumsum(wanted)))
                open_keys.append(keys[wanted])
                open_counts.append(upto[2 * first[1:]] - upto[2 * first[:-1]])
            cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
            cols = [batch.column(c) for c in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(cat(n, np.int64).astype(np.int64)), pa.array(cat(sums["t"], float)), pa.array(cat(sums["b"], float)),
                 int64_list(cat(open_keys, U64), cat(open_counts, np.int64))], names=schema.fieldNames())

    # written once, so that row ids stay
    rows = materialise(source.mapInArrow(run, schema).withColumn(rid, F.monotonically_increasing_id()), "lm-scored")
    # a part of the keys at a time, so that only its shuffle takes disk
    asked, found = rows.select(F.col(rid).alias("rid"), F.explode(tail).alias("key")), []
    for part in range(PARTS):
        mine = F.pmod(F.col("key"), F.lit(PARTS)) == part
        found.append(materialise(asked.where(mine).join(rest.where(mine), "key").groupBy("rid").agg(
            F.sum("b").alias("b"), F.sum("t").alias("t")), "lm-tails"))
    more = reduce(DataFrame.unionAll, found).groupBy("rid").agg(F.sum("b").alias("b"), F.sum("t").alias("t"))
    more = more.toDF(rid, unused_name(rows, "more_b"), unused_name(rows, "more_t"))
    release(values)
    out = rows.join(more, rid, "left")
    for c, extra in (("loss_target", more.columns[2]), ("loss_background", more.columns[1])):
        out = out.withColumn(c, F.when(F.col("n_tokens") > 0, (F.col(c) + F.coalesce(extra, F.lit(0.0))) / F.col("n_tokens")))
    out = out.withColumn("score", F.col("loss_target") - F.col("loss_background"))
    return out.select(*[F.col(f"`{c}`") for c in keep], *results)
