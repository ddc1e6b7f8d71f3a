"""Operator 8: near-duplicate documents by circulant MinHash.

Words of a text are lower-cased (A-Z) runs without ASCII white space; a
document's set holds its distinct ``k``-word shingles (the whole sequence if it
is shorter).  Two permutations give every signature coordinate: the first
places a shingle on a circle of 2^32 positions, the second, shifted by j along
the circle, is coordinate j.  Documents that agree on one band of ``rows``
coordinates fall into one candidate group; links (Jaccard >= ``threshold``) are
confirmed on the full sets, and a distributed union-find gives the classes.

Documents with equal sets form one class before banding, so copies cost one
representative.  With 40 bands of 6 rows a pair at similarity 0.8 shares no
band with probability 5e-6, and two texts need no shared band of their own if
others tie them into the same group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textbench.llm.common import int64_list, materialise, maybe_in, pick, row_slices, text_buffers
from textbench.llm.components import connected_components
from textbench.llm.groups import link_components
from textbench.llm.words import U64, WordScanner, mix64, shingle_set

BANDS, ROWS = 40, 6
BLOCK_ROWS = 1000


def circulant_signature(s: np.ndarray, size: int) -> np.ndarray:
    """``size`` MinHash coordinates of a set of 64-bit shingles: sigma puts
    each shingle on the circle, pi read ``j`` places further is coordinate j."""
    place = (mix64(s ^ U64(0xA0761D6478BD642F)) >> U64(32)).astype(np.uint32)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    shift = np.arange(size, dtype=np.uint32)
    for i in range(0, len(place), 512):
        x = place[i:i + 512, None] + shift[None, :]
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        np.minimum(out, x.min(axis=0), out=out)
    return out


def _band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    acc = np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
    for column in sig.reshape(bands, rows).T:
        acc = mix64(acc ^ column.astype(U64))
    return acc


def sketch(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` (id, text) -> id, n_shingles, f1, f2 (128-bit fingerprint of
    the set), bands (one key per band; none for an empty set)."""

    def run(batches):
        scanner = WordScanner("space")
        for batch in batches:
            offsets, data = text_buffers(batch.column(1))
            size, f1, f2, keys = [], [], [], []
            for i, j in row_slices(offsets):
                part = offsets[i:j + 1] - offsets[i]
                h, first = scanner.scan(data[offsets[i]:offsets[j]], part)
                for a, b in zip(first[:-1], first[1:]):
                    s = shingle_set(h[a:b], k)
                    size.append(len(s))
                    x, y = set_fingerprint(s)
                    f1.append(x)
                    f2.append(y)
                    if len(s):
                        keys.append(_band_keys(circulant_signature(s, bands * rows), bands, rows))
            size = np.array(size, np.int64)
            flat = np.concatenate(keys) if keys else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(np.array(f1, U64).view(np.int64)),
                 pa.array(np.array(f2, U64).view(np.int64)), int64_list(flat, np.where(size > 0, bands, 0))],
                names=["id", "n_shingles", "f1", "f2", "bands"])

    return docs.mapInArrow(run, "id long, n_shingles long, f1 long, f2 long, bands array<long>")


def set_fingerprint(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    return np.sum(mix64(s + U64(1)), dtype=U64), np.sum(mix64(s ^ U64(0xE7037ED1A0B428DB)), dtype=U64)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """``docs`` (id, grp, f1, text) -> id, grp, sh: the sorted set as packed
    64-bit values; rows whose set does not have the fingerprint ``f1`` go."""

    def run(batches):
        scanner = WordScanner("space")
        for batch in batches:
            offsets, data = text_buffers(batch.column(3))
            want = batch.column(2).to_numpy().view(U64)
            for i, j in row_slices(offsets):
                part = offsets[i:j + 1] - offsets[i]
                h, first = scanner.scan(data[offsets[i]:offsets[j]], part)
                sets = [shingle_set(h[a:b], k) for a, b in zip(first[:-1], first[1:])]
                keep = np.array([set_fingerprint(x)[0] == w for x, w in zip(sets, want[i:j])], bool)
                packed = [x.tobytes() for x, ok in zip(sets, keep) if ok]
                mask = pa.array(keep)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).filter(mask), batch.column(1).slice(i, j - i).filter(mask),
                     pa.array(packed, pa.binary())], names=["id", "grp", "sh"])

    return docs.mapInArrow(run, "id long, grp long, sh binary")


def _forest(sets: list[np.ndarray], num: int, den: int, asked: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that connect whatever is linked (den * inter >= num * union) among
    ``sets``, or whatever links the ``asked`` ones with any.  One set at a time
    is intersected with all others through an inverted list; without asked
    ones, it stops once at most one component has members left."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    ids, inv = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate(([0], np.cumsum(size)))
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(inv, kind="stable")
    post = owner[order]
    start = np.concatenate(([0], np.cumsum(np.bincount(inv, minlength=len(ids)))))
    comp = np.arange(n)
    todo = np.ones(n, bool) if asked is None else asked.copy()
    out = []
    while True:
        left = np.bincount(comp[todo], minlength=n)
        live = np.flatnonzero(left)
        if len(live) < (2 if asked is None else 1) or (comp == comp[0]).all():
            return out
        c = live[np.argmin(left[live])]
        i = int(np.flatnonzero(todo & (comp == c))[0])
        todo[i] = False
        mine = inv[begin[i]:begin[i + 1]]
        length = start[mine + 1] - start[mine]
        at = np.repeat(start[mine] - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
        inter = np.bincount(post[at], minlength=n)
        hit = np.flatnonzero(den * inter >= num * (size + size[i] - inter))
        for c2, j in zip(*np.unique(comp[hit], return_index=True)):
            if c2 != comp[i]:
                out.append((i, int(hit[j])))
                comp[comp == c2] = comp[i]


def verify_sets(num: int, den: int):
    """Exact Jaccard confirmation of one block of members."""

    def block(pdf):
        pdf = pdf.sort_values(["id", "asked"], ascending=[True, False]).drop_duplicates("id", ignore_index=True)
        sets = [np.frombuffer(x, U64) for x in pdf["sh"]]
        ids, asked = pdf["id"].to_numpy(), pdf["asked"].to_numpy(bool)
        pairs = _forest(sets, num, den, asked if asked.any() else None) if len(ids) > 1 else []
        import pandas as pd

        return pd.DataFrame({"a": [int(ids[i]) for i, _ in pairs], "b": [int(ids[j]) for _, j in pairs]}, dtype="int64")

    def verify(df: DataFrame, asked: DataFrame | None = None) -> DataFrame:
        df = df.withColumn("asked", F.lit(False))
        if asked is not None:
            df = df.unionByName(asked.withColumn("asked", F.lit(True)))
        return df.groupBy("block").applyInPandas(block, "a long, b long")

    return verify


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                    num: int = 80, den: int = 100, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id
    reachable over links den * |A n B| >= num * |A u B|, itself included), kept.

    * Texts without words (null, empty, white space) link with nothing: each
      is its own component.
    * Rows with a null id take no part in links: component_id null, kept true.
    * Repeated ids: every input row gives a row; different texts under one id
      count as linked with each other.
    * Extra columns are not read, whatever their names; an empty table gives an
      empty result; texts are used whole, whatever their length.
    """
    docs = pick(df, id=id_col, text=text_col)
    sk = materialise(sketch(docs, k, bands, rows), "sketch")
    known = sk.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    mark = ["f1", "f2", "n_shingles"]
    classes = known.groupBy(*mark).agg(F.min("id").alias("rep")).withColumn("cls", F.monotonically_increasing_id())
    classes = materialise(classes, "classes")
    member = materialise(known.select("id", *mark).join(classes, mark).select("id", "cls").distinct(), "member")

    reps = known.join(classes, (F.col("id") == F.col("rep")) & (known["f1"] == classes["f1"])
                      & (known["f2"] == classes["f2"]) & (known["n_shingles"] == classes["n_shingles"]))
    keyed = reps.select("cls", F.explode("bands").alias("key"))
    keyed = materialise(keyed, "bands")
    shared = keyed.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high")
    shared = materialise(shared.select("key", "low"), "shared")
    near = maybe_in(keyed, "key", shared.select("key")).join(shared, "key").where("cls != low").select(
        F.col("cls").alias("a"), F.col("low").alias("b"))
    cand = materialise(connected_components(near), "cand")

    picked = classes.join(cand, F.col("cls") == F.col("node")).select("rep", "f1", "cls", F.col("component").alias("grp"))
    texts = docs.join(picked, F.col("id") == F.col("rep")).select(F.col("cls").alias("id"), "grp", "f1", "text")
    sets = materialise(shingle_sets(texts, k).dropDuplicates(["id"]), "sets")
    comp = link_components(sets, verify_sets(num, den), BLOCK_ROWS)

    # different texts under one id tie their classes together
    several = member.groupBy("id").agg(F.min("cls").alias("a"), F.max("cls").alias("top")).where("a < top")
    ties = member.join(several, "id").select("a", F.col("cls").alias("b")).where("a != b")
    comp = connected_components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(ties))
    smallest = classes.join(comp, F.col("cls") == F.col("node"), "left").select(
        "cls", "rep", F.coalesce("component", "cls").alias("component"))
    smallest = smallest.join(smallest.groupBy("component").agg(F.min("rep").alias("low")), "component").select(
        F.col("cls").alias("ccls"), "low")
    final = member.join(smallest, F.col("cls") == F.col("ccls")).groupBy(F.col("id").alias("cid")).agg(
        F.min("low").alias("component_id"))
    out = sk.select("id", "n_shingles").join(final, F.col("id") == F.col("cid"), "left").select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
