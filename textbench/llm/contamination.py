"""Operator 7: benchmark decontamination by a prefix-filtered containment join.

Words are lower-cased (A-Z) runs of 0-9, a-z and characters beyond ASCII.  A
window is ``size`` consecutive words of a benchmark item (a shorter item is one
window).  A document contains a window if the words of the window occur in it
in a row, that is, with containment 1, so one necessary prefix token per window
suffices: its two-word shingles are ordered by their frequency in all
documents, and only the rarest is joined with the shingles of the documents.
A match fixes where the window would begin; the positional bound (not before
the text) and the length bound (not beyond it) apply, and every word of the
window is then compared.

The benchmark is the stated query set.  Its windows go to the tasks in blocks
of at most ``block_words`` words; there is one pass over the documents per
block, so the size of a broadcast is bounded whatever the benchmark's size.
Each document is scanned where it is read: nothing is shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textbench.llm.common import materialise, pick, row_slices, text_buffers, unused_name
from textbench.llm.words import U64, WordScanner, gram_hashes, mix64

BLOCK_WORDS = 2_000_000


def _shingles(h: np.ndarray) -> np.ndarray:
    return gram_hashes(h, min(2, len(h)))


def _item_words(bench: DataFrame) -> DataFrame:
    """(item, words): the word hashes of every item, in order."""

    def run(batches):
        scanner = WordScanner("alnum")
        for batch in batches:
            offsets, data = text_buffers(batch.column(1))
            for i, j in row_slices(offsets):
                h, first = scanner.scan(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                rows = [h[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(rows, pa.binary()),
                                                  pa.array(np.diff(first))], names=["item", "words", "n"])

    return bench.mapInArrow(run, "item string, words binary, n long")


class Windows:
    """The distinct windows of one block of items, indexed by their rarest shingle."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], size: int):
        at: dict[bytes, set] = {}
        for item, words in items:
            k = min(size, len(words))
            for i in range(len(words) - k + 1 if k else 0):
                at.setdefault(words[i:i + k].tobytes(), set()).add(item)
        self.rows = [(np.frombuffer(w, U64), sorted(x for x in who if x is not None)) for w, who in at.items()]
        self.sizes = sorted({min(2, len(w)) for w, _ in self.rows})
        self.tokens = np.unique(np.concatenate([_shingles(w) for w, _ in self.rows])) if self.rows else np.zeros(0, U64)

    def index(self, counts: dict[int, int]) -> dict:
        """``counts``: occurrences in all documents of each shingle."""
        key, offset = [], []
        for w, _ in self.rows:
            s = _shingles(w)
            rarity = [(counts.get(int(x), 0), int(x)) for x in s]
            o = rarity.index(min(rarity))
            key.append(s[o])
            offset.append(o)
        key, offset = np.array(key, U64), np.array(offset, np.int64)
        order = np.argsort(key, kind="stable")
        length = np.array([len(w) for w, _ in self.rows], np.int64)[order]
        width = int(length.max())
        words = np.zeros((len(order), width), U64)
        for r, o in enumerate(order):
            words[r, :length[r]] = self.rows[o][0]
        token, start = np.unique(key[order], return_index=True)
        return {"token": token, "start": np.append(start, len(order)), "offset": offset[order], "length": length,
                "words": words, "items": [self.rows[o][1] for o in order],
                "single": bool((length == 1).any())}


class TokenSet:
    """Membership of 64-bit hashes: a bit table first, then binary search."""

    def __init__(self, sorted_keys: np.ndarray):
        self.keys = sorted_keys
        self.bits = max(16, int(len(sorted_keys)).bit_length() + 4)
        self.table = np.zeros(1 << self.bits, bool)
        self.table[(sorted_keys & U64((1 << self.bits) - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` that hold a key, and which."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        p = np.flatnonzero(self.table[(h & U64((1 << self.bits) - 1)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, h[p]), len(self.keys) - 1)
        ok = self.keys[k] == h[p]
        return p[ok], k[ok]


def _shingle_counts(docs: DataFrame, tokens_bc, sizes: list[int]) -> dict[int, int]:
    """Occurrences over all documents of the block's shingles of ``sizes`` words
    (as many rows as the block has shingles at most)."""

    def run(batches):
        scanner, known = WordScanner("alnum"), TokenSet(tokens_bc.value)
        total = np.zeros(len(known.keys), np.int64)
        for batch in batches:
            offsets, data = text_buffers(batch.column(0))
            for i, j in row_slices(offsets):
                h, _ = scanner.scan(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                for size in sizes:
                    total += np.bincount(known.find(gram_hashes(h, size))[1], minlength=len(total))
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known.keys[has].view(np.int64)), pa.array(total[has])],
                                         names=["token", "n"])

    rows = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r["token"] % (1 << 64): r["n"] for r in rows}


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The concatenation of begin[i] .. begin[i] + count[i] - 1."""
    skip = np.concatenate(([0], np.cumsum(count)[:-1])) if len(count) else count
    return np.repeat(begin - skip, count) + np.arange(int(count.sum()))


def _matches(h, first, index, known, limit=1 << 18):
    """(word position, window) of every occurrence of a window."""
    row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found = [known.find(gram_hashes(h, 2))]
    if index["single"]:
        found.append(known.find(gram_hashes(h, 1)))
    out = []
    for pos, key in found:
        fan = index["start"][key + 1] - index["start"][key]
        cut = np.searchsorted(np.cumsum(fan), np.arange(limit, int(fan.sum()) + limit, limit)) + 1 if len(fan) else []
        a = 0
        for b in cut:
            p, k, f = pos[a:b], key[a:b], fan[a:b]
            a = b
            if not len(p):
                continue
            win = _ranges(index["start"][k], f)
            begin = np.repeat(p, f) - index["offset"][win]
            row = row_of[np.repeat(p, f)]
            size = index["length"][win]
            ok = (begin >= first[row]) & (begin + size <= first[row + 1])
            begin, win, size = begin[ok], win[ok], size[ok]
            for j in range(index["words"].shape[1]):
                if not len(begin):
                    break
                live = size > j
                same = ~live
                same[live] = h[begin[live] + j] == index["words"][win[live], j]
                begin, win, size = begin[same], win[same], size[same]
            out.append((begin, win))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([b for b, _ in out]), np.concatenate([w for _, w in out])


def _scan(docs: DataFrame, index_bc, hits: str) -> DataFrame:
    """Add this block's hits to the column ``hits``: struct(n_words, n_hit, spans, items);
    spans holds disjoint hit ranges (begin, end, begin, end ...) of word positions."""
    names = docs.columns
    out_schema = T.StructType([f for f in docs.schema if f.name not in (hits, "text_" + hits)])
    out_schema.add(docs.schema[hits])
    text_at, prior_at = names.index("text_" + hits), names.index(hits)

    def run(batches):
        index = index_bc.value
        scanner, known = WordScanner("alnum"), TokenSet(index["token"])
        for batch in batches:
            offsets, data = text_buffers(batch.column(text_at))
            prior = batch.column(prior_at).to_pylist() if batch.column(prior_at).null_count < len(batch) else [None] * len(batch)
            result = []
            for i, j in row_slices(offsets):
                h, first = scanner.scan(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                begin, win = _matches(h, first, index, known)
                row = np.searchsorted(first, begin, "right") - 1
                order = np.argsort(row, kind="stable")
                row, begin, win = row[order], begin[order], win[order]
                edge = np.searchsorted(row, np.arange(j - i + 1))
                for r in range(j - i):
                    n = int(first[r + 1] - first[r])
                    old = prior[i + r] or {"spans": [], "items": []}
                    lo, hi = edge[r], edge[r + 1]
                    spans, items = old["spans"], set(old["items"])
                    if hi > lo:
                        change = np.zeros(n + 1, np.int64)
                        np.add.at(change, begin[lo:hi] - first[r], 1)
                        np.add.at(change, begin[lo:hi] - first[r] + index["length"][win[lo:hi]], -1)
                        for a, b in zip(spans[::2], spans[1::2]):
                            change[a] += 1
                            change[b] -= 1
                        on = np.concatenate(([False], np.cumsum(change)[:-1] > 0, [False]))
                        spans = np.flatnonzero(on[1:] != on[:-1]).tolist()
                        for w in np.unique(win[lo:hi]):
                            items.update(index["items"][w])
                    n_hit = sum(spans[1::2]) - sum(spans[::2])
                    result.append({"n_words": n, "n_hit": n_hit, "spans": spans, "items": sorted(items)})
            cols = [batch.column(c) for c in range(len(names)) if c not in (text_at, prior_at)]
            kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_arrays([*cols, pa.array(result, kind)],
                                             names=[c for c in names if c not in (hits, "text_" + hits)] + [hits])

    return docs.mapInArrow(run, out_schema)


def contamination(docs: DataFrame, bench: DataFrame, size: int = 10, text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", keep: list[str] | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: the columns ``keep`` (all by default), then
    n_words, n_hit (words inside an occurrence of a window), hit_spans, n_items,
    item_ids (sorted as strings), items_sha256, contaminated.

    * A null, empty or wordless text has no words and no hits.
    * A benchmark item without words has no window; repeated items count once;
      an item with a null id marks words as hit but is not listed.
    * An empty benchmark hits nothing; empty documents give an empty result.
    * Extra columns pass through; those named like a result are left out.
    """
    spark = docs.sparkSession
    results = ["n_words", "n_hit", "hit_spans", "n_items", "item_ids", "items_sha256", "contaminated"]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in results]
    # repeated rows of an item go before blocks are dealt, so that a block holds each once
    wanted = bench.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).distinct()
    items = materialise(_item_words(wanted), "items")
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-int(total) // block_words))
    hits = unused_name(docs, "hits")
    kind = "struct<n_words:bigint,n_hit:bigint,spans:array<bigint>,items:array<string>>"
    current = docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(None).cast(kind).alias(hits))
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    place = [F.col(f"`{c}`") for c in keep]
    for b in range(blocks):
        # an item longer than a block is still whole: blocks split by item
        mine = items.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b) if blocks > 1 else items
        rows = mine.select("item", "words").collect()
        windows = Windows([(r["item"], np.frombuffer(r["words"], U64)) for r in rows], size)
        if not windows.rows:
            index = {"token": np.zeros(0, U64), "start": np.zeros(1, np.int64), "offset": np.zeros(0, np.int64),
                     "length": np.zeros(0, np.int64), "words": np.zeros((0, 1), U64), "items": [], "single": False}
        else:
            tokens = spark.sparkContext.broadcast(windows.tokens)
            index = windows.index(_shingle_counts(texts, tokens, windows.sizes))
        if b == 0:
            source = docs.select(*place, F.lit(None).cast(kind).alias(hits), F.col(f"`{text_col}`").alias("text_" + hits))
        else:
            source = current.withColumnRenamed("again_" + hits, "text_" + hits)
        last = b == blocks - 1
        if not last:  # the text goes on to the next block beside the hits
            source = source.withColumn("again_" + hits, F.col("text_" + hits))
        current = _scan(source, spark.sparkContext.broadcast(index), hits)
        if not last:
            current = materialise(current, "blocks")
    h = F.col(hits)
    out = current.select(
        *place, h.n_words.alias("n_words"), h.n_hit.alias("n_hit"), h.spans.alias("hit_spans"),
        F.size(h["items"]).cast("long").alias("n_items"), h["items"].alias("item_ids"),
        F.sha2(F.array_join(h["items"], ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)
