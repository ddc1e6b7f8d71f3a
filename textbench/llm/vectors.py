"""Operator 3: near-duplicate vectors by collision counting on sorted projections.

Unit vectors of one label are projected on many random directions.  For a query
vector, each projection sorted by value has a window centred on the query; two
vectors that fall into each other's windows collide there.  The number of
collisions over all projections decides whether a pair is verified, and the
count needed is calibrated: at the threshold the difference of two unit vectors
has length d = sqrt(2 - 2 cos), a Gaussian projection of it the deviation d, so
a window of twice that holds a linked pair with probability 0.954, and the
count is the largest that such a pair misses with probability below 1e-9.
Verified pairs have their exact cosine in double precision.

One more projection, on a unit direction, deals the vectors: linked pairs lie at
most d apart on it, so cells of width d need to meet only themselves and their
neighbours.  Cells are cut into blocks of bounded size, and a task counts the
collisions of one pair of blocks; pairs never leave it.  A task returns one row
per linked vector: how many links it found, and the smallest class it reached.
Equal vectors form one class before that, so copies cost one representative.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textbench.llm.common import materialise, pick
from textbench.llm.components import connected_components

PROJECTIONS = 48
BLOCK_ROWS = 1500
MISS = 1e-9


def needed_collisions(m: int, p: float = math.erf(math.sqrt(2)), miss: float = MISS) -> int:
    """The largest count that a pair colliding with probability ``p`` per
    projection stays below with probability at most ``miss``."""
    below = 0.0
    for c in range(m + 1):
        below += math.comb(m, c) * p ** c * (1 - p) ** (m - c)
        if below > miss:
            return c
    return m


def directions(dim: int, m: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(17)).standard_normal((dim, m))


def _direction(dim: int) -> np.ndarray:
    a = np.random.Generator(np.random.PCG64(23)).standard_normal(dim)
    return a / np.linalg.norm(a)


def _units(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square over- or underflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def collision_counts(left: np.ndarray, right: np.ndarray, window: float) -> np.ndarray:
    """Collisions of each left with each right row over all projections."""
    n, k = left.shape[0], right.shape[0]
    count = np.zeros((n, k), np.uint8)
    row = np.arange(n)
    for j in range(left.shape[1]):
        order = np.argsort(right[:, j])
        values = right[order, j]
        change = np.zeros((n, k + 1), np.int8)
        change[row, np.searchsorted(values, left[:, j] - window, "left")] += 1
        change[row, np.searchsorted(values, left[:, j] + window, "right")] -= 1
        count[:, order] += np.cumsum(change[:, :k], axis=1, dtype=np.uint8)
    return count


def block_links(x: np.ndarray, y: np.ndarray | None, cosine: float, m: int):
    """Index pairs (into x, into y; within x, i < j, if y is None) with cosine >= ``cosine``."""
    window = 2 * math.sqrt(max(2 - 2 * cosine, 0.0)) + 1e-9
    need = needed_collisions(m)
    a = directions(x.shape[1], m)
    other = x if y is None else y
    px, py = x @ a, other @ a
    for i in range(0, len(x), 256):
        r, c = np.nonzero(collision_counts(px[i:i + 256], py, window) >= need)
        r = r + i
        if y is None:
            r, c = r[r < c], c[r < c]
        for s in range(0, len(r), 50_000):
            u, v = r[s:s + 50_000], c[s:s + 50_000]
            ok = np.einsum("ij,ij->i", x[u], other[v]) >= cosine
            yield u[ok], v[ok]


def _block(cosine: float, m: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one = ((pdf["cell"] == pdf["c1"]) & (pdf["slot"] == pdf["s1"])).to_numpy()
        two = ((pdf["cell"] == pdf["c2"]) & (pdf["slot"] == pdf["s2"])).to_numpy()
        cls, mult = pdf["cls"].to_numpy(), pdf["mult"].to_numpy()
        x = _units(pdf["embedding"])
        same = bool((one & two).any())
        at1, at2 = np.flatnonzero(one), np.flatnonzero(two)
        links = np.zeros(len(pdf), np.int64)
        order = np.argsort(cls)  # roots are the smallest class
        rank = np.empty(len(pdf), np.int64)
        rank[order] = np.arange(len(pdf))
        root = rank.copy()
        if len(at1) and len(at2):
            for u, v in block_links(x[at1], None if same else x[at2], cosine, m):
                u, v = at1[u], at2[v]
                np.add.at(links, u, mult[v])
                np.add.at(links, v, mult[u])
                while len(u):  # hook the larger root below the smaller until both ends agree
                    low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
                    live = low < high
                    if not live.any():
                        break
                    np.minimum.at(root, order[high[live]], low[live])
                    while True:
                        up = root[order[root]]
                        if (up == root).all():
                            break
                        root = up
        hit = np.flatnonzero(links)
        return pd.DataFrame({"cls": cls[hit], "links": links[hit], "root": cls[order[root[hit]]]})

    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 cosine: float = 0.98, m: int = PROJECTIONS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per input row: id, n_links (other vectors with an equal label and
    cosine >= ``cosine``), component_id (smallest id reachable, itself
    included), kept (id = component_id).

    * A null label, a null or empty vector, one with a null or non-finite
      component, and the zero vector link with nothing; vectors of different
      length do not link.
    * A null id takes no part in links (component_id null, kept true).  Rows that repeat id, label and
      vector are one vector; an id with several vectors counts the links of each.
    * Extra columns are not read.  An empty table gives an empty result.
    """
    rows = pick(df, id=id_col, v=vec_col, label=label_col)
    value = F.col("v").cast("array<double>")
    bad = F.exists(value, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    size = F.aggregate(value, F.lit(0.0), lambda s, e: F.greatest(s, F.abs(e)))
    usable = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
                        & (F.size("v") > 0) & ~bad & (size > 0))
    usable = usable.select("id", "label", value.alias("embedding"))
    owner = materialise(usable.distinct(), "vec-rows")
    classes = owner.groupBy("label", "embedding").agg(F.min("id").alias("rep"), F.count("*").alias("mult"))
    classes = materialise(classes.withColumn("cls", F.monotonically_increasing_id()), "vec-classes")
    member = materialise(owner.join(classes, ["label", "embedding"]).select("id", "cls"), "vec-members")

    width = math.sqrt(max(2 - 2 * cosine, 0.0)) + 1e-9

    def deal(batches):
        axis = {}
        for pdf in batches:
            cell = []
            for v in pdf["embedding"]:
                if len(v) not in axis:
                    axis[len(v)] = _direction(len(v))
                cell.append(math.floor(float(_units([v])[0] @ axis[len(v)]) / width))
            yield pdf.assign(dim=[len(v) for v in pdf["embedding"]], cell=cell)

    dealt = classes.mapInPandas(
        deal, classes.select("label", "embedding", "rep", "mult", "cls").schema.add("dim", "integer").add("cell", "integer"))
    dealt = materialise(dealt, "vec-dealt")
    sizes = dealt.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("k"))
    near = [sizes.select("label", "dim", (F.col("cell") + d).alias("cell"), F.col("k").alias(f"k{d}")) for d in (1, -1)]
    sizes = sizes.join(near[0], ["label", "dim", "cell"], "left").join(near[1], ["label", "dim", "cell"], "left")
    sizes = materialise(sizes, "vec-cells")
    x = dealt.join(sizes, ["label", "dim", "cell"]).withColumn("slot", F.pmod(F.xxhash64("cls"), F.col("k")).cast("int"))
    cell, slot = F.col("cell"), F.col("slot")

    def meet(k, c1, c2, s1, s2):
        pairs = F.transform(F.sequence(F.lit(0), k - 1), lambda t: F.struct(
            c1.alias("c1"), c2.alias("c2"), s1(t).alias("s1"), s2(t).alias("s2")))
        return F.when(k.isNull(), F.array().cast("array<struct<c1:int,c2:int,s1:int,s2:int>>")).otherwise(pairs)

    blocks = F.concat(
        meet(F.col("k"), cell, cell, lambda t: F.least(slot, t), lambda t: F.greatest(slot, t)),
        meet(F.col("k-1"), cell, cell + 1, lambda t: slot, lambda t: t),
        meet(F.col("k1"), cell - 1, cell, lambda t: t, lambda t: slot))
    x = x.withColumn("p", F.explode(blocks)).select(
        "label", "dim", "p.*", "cell", "slot", "cls", "mult", "embedding")
    found = x.groupBy("label", "dim", "c1", "c2", "s1", "s2").applyInPandas(
        _block(cosine, m), "cls long, links long, root long")
    found = materialise(found, "vec-links")

    degree = found.groupBy("cls").agg(F.sum("links").alias("links"))
    several = member.groupBy("id").agg(F.min("cls").alias("a"), F.max("cls").alias("top")).where("a < top")
    edges = found.select(F.col("cls").alias("a"), F.col("root").alias("b")).unionAll(
        member.join(several, "id").select("a", F.col("cls").alias("b")))
    comp = connected_components(edges)
    full = classes.select("cls", "rep", "mult").join(degree, "cls", "left").join(
        comp, F.col("cls") == F.col("node"), "left").select(
        "cls", "rep", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n"),
        F.coalesce("component", "cls").alias("component"))
    low = full.groupBy("component").agg(F.min("rep").alias("low"))
    full = full.join(low, "component").select(F.col("cls").alias("ccls"), "n", "low")
    final = member.join(full, F.col("cls") == F.col("ccls")).groupBy(F.col("id").alias("cid")).agg(
        F.sum("n").alias("n_links"), F.min("low").alias("component_id"))
    out = rows.select("id").join(final, F.col("id") == F.col("cid"), "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))

