"""Bootstrap confidence intervals over sufficient statistics.

The reference recomputes the metric from text for each of 1000 resamples.
Here every row contributes its sufficient statistics once (F1 value, BLEU
n-gram counts) and a replicate is a weighted sum of them:

* ``method="blocks"`` (default): statistics are additive, so rows are first
  summed into ``blocks`` hash-assigned blocks (map-side partial aggregation) and
  Poisson(1) weights are drawn per (block, replicate).  Block sums of
  randomly assigned iid rows are iid, so the interval estimates the same
  sampling variance with ``blocks x R`` rows in place of ``n x R``.
* ``method="exact"``: the textbook resample of exactly ``n`` rows with
  replacement at corpus size.  Rows get places in range slices (P2); the draws of
  each replicate are split down a tree of blocks by conditional binomials
  (``functions/resample.py``), and a task multiplies the weights of a block with
  its statistics.  No row is multiplied: what leaves a task is one row per replicate.
* ``method="poisson"``: each row gets an independent Poisson(1) weight per
  replicate, drawn from P1 hashes.  A task finds the weights of its rows from two
  hashes a row and multiplies them with the statistics, so neither here nor over
  blocks is a row multiplied: what leaves a task is one row per replicate.
* ``method="multinomial"``: exactly ``n`` rows by ``R * n`` draws from hashes of
  (replicate, place), reproducible in SQL.  Draws are shuffled to the block
  of rows they fall on, four bytes each, and meet its rows there.

Percentiles are exact and linearly interpolated (``percentile``), as in
numpy's default.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbench.functions.hashing import hash_bits, hash_uniform
from textbench.functions.resample import DrawTree
from textbench.operators.metric import Metric, finished, resolve, statistics
from textbench.operators.ranking import dense_index, range_sorted

# Cumulative Poisson(1) probabilities P(K <= k), k = 0..11 (rule: e^-1 * sum 1/j!);
# a draw beyond the last one (probability 6e-11) counts as weight 12.
POISSON1_CDF = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]


def poisson_weight(u: Column) -> Column:
    expr = F.lit(len(POISSON1_CDF))
    for k in reversed(range(len(POISSON1_CDF))):
        expr = F.when(u < F.lit(POISSON1_CDF[k]), F.lit(k)).otherwise(expr)
    return expr


def sql_poisson_weight(u: str) -> str:
    parts = " ".join(f"WHEN {u} < {POISSON1_CDF[k]!r} THEN {k}" for k in range(len(POISSON1_CDF)))
    return f"(CASE {parts} ELSE {len(POISSON1_CDF)} END)"


def replicate_seeds(seed, id_col: str) -> tuple[Column, Column]:
    """Per-row ``h1, h2`` (md5 of (seed, id); h2 odd), computed once per row."""
    return (hash_bits(seed, F.col(id_col), F.lit("a")),
            hash_bits(seed, F.col(id_col), F.lit("b")).bitwiseOR(F.lit(1)))


def replicate_uniform_from(h1: Column, h2: Column, rep: Column) -> Column:
    """Weyl sequence per row: ``((h1 + rep * h2) mod 2^32) / 2^32``."""
    return F.pmod(h1 + rep.cast("long") * h2, F.lit(4294967296)).cast("double") / F.lit(4294967296.0)


def replicate_uniform(seed, id_col: str, rep: Column) -> Column:
    h1, h2 = replicate_seeds(seed, id_col)
    return replicate_uniform_from(h1, h2, rep)


def sql_replicate_uniform(seed, id_col: str, rep: str) -> str:
    h1 = f"('0x' || substr(md5(concat_ws(':', '{seed}', CAST({id_col} AS VARCHAR), 'a')), 1, 8))::BIGINT"
    h2 = f"(('0x' || substr(md5(concat_ws(':', '{seed}', CAST({id_col} AS VARCHAR), 'b')), 1, 8))::BIGINT | 1)"
    return f"(CAST((({h1}) + CAST({rep} AS BIGINT) * {h2}) % 4294967296 AS DOUBLE) / 4294967296.0)"


def replicate_scores(stats: DataFrame, metrics: list[str | Metric], n_boot: int = 1000, seed: int = 42,
                     method: str = "blocks", id_col: str = "id", blocks: int = 4096,
                     row_weight: str | None = None) -> DataFrame:
    """One row per replicate ``rep`` with a ``score_<metric>`` column per
    metric.  ``rep = -1`` is the full sample (weight 1 for every row), so a
    point estimate and its interval come out of the same pass."""
    ms = resolve(metrics)
    if method == "poisson":
        return _poisson_sums(stats, ms, n_boot, seed, id_col, row_weight).select("rep", *finished(ms, "score_"))
    elif method == "blocks":
        blk = stats.groupBy(F.pmod(hash_bits(seed, F.col(id_col), F.lit("block")), F.lit(blocks)).alias("__blk")).agg(
            *[F.sum(c).alias(c) for c in statistics(ms)], F.count(F.lit(1)).alias("__rows"))
        return replicate_scores(blk, ms, n_boot, seed, "poisson", id_col="__blk", row_weight="__rows")
    elif method == "exact":
        return _exact_sums(stats, ms, n_boot, seed, id_col).select("rep", *finished(ms, "score_"))
    elif method == "multinomial":
        return _multinomial_sums(stats, ms, n_boot, seed, id_col).select("rep", *finished(ms, "score_"))
    else:
        raise ValueError(f"unknown method {method}")


#: the least 32-bit draw of weight 1, 2, ...: that of :func:`poisson_weight` on draw / 2^32
_DRAW_OF_WEIGHT = [math.ceil(p * 4294967296) for p in POISSON1_CDF if math.ceil(p * 4294967296) < 4294967296]
_ROWS_AT_ONCE = 512
_BLOCK_BITS = 10  # rows of a block of multinomial draws; the rest of 32 bits holds the replicate
_DRAWS_AT_ONCE = 4_000_000


def _poisson_weights(h1: np.ndarray, h2: np.ndarray, n_boot: int) -> np.ndarray:
    """(n_boot, rows): the Poisson(1) weights of rows with these seeds."""
    draw = np.arange(n_boot, dtype=np.uint32)[:, None] * h2.astype(np.uint32) + h1.astype(np.uint32)  # modulo 2^32
    w = np.zeros(draw.shape, np.uint8)
    for least in _DRAW_OF_WEIGHT:
        w += draw >= np.uint32(least)
    return w.astype(np.float64)


class _WeightedSums:
    """Sums of rows' statistics with a weight per row and replicate, as Spark's
    ``sum`` has them: nulls are left out, and a replicate without rows is not there."""

    def __init__(self, whole: list[bool], n_boot: int):
        """``whole``: which columns are integers; the last one is the number of rows."""
        self.whole, self.n_boot = whole, n_boot
        self.total, self.there = np.zeros((n_boot + 1, len(whole))), np.zeros((n_boot + 1, len(whole)), bool)

    def add(self, w: np.ndarray, x: np.ndarray, known: np.ndarray) -> None:
        """``w``: (n_boot + 1, rows), ``x`` and ``known`` (not null): (rows, columns)."""
        finite = np.isfinite(x).all(axis=1)
        self.total += w @ np.where(finite[:, None], x, 0)
        for j in np.flatnonzero(~finite):  # infinite times 0 would be NaN
            on = w[:, j] > 0
            self.total[on] += w[on, j, None] * x[j]
        self.there |= w.any(axis=1)[:, None] if known.all() else w @ known > 0

    def batch(self, names: list[str]) -> pa.RecordBatch:
        on = self.there[:, -1]
        sums_ = [pa.array(np.rint(self.total[on, c]).astype(np.int64) if int_ else self.total[on, c], mask=~self.there[on, c])
                 for c, int_ in enumerate(self.whole)]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(-1, self.n_boot, dtype=np.int32)[on]), *sums_], names=names)


def _matrix(columns: list) -> tuple[np.ndarray, np.ndarray]:
    """Values and whether they are not null, (rows, columns), of Arrow columns of doubles."""
    return (np.column_stack([c.fill_null(0).to_numpy() for c in columns]),
            np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in columns]))


def _summed(stats: DataFrame, cols: list[str]) -> tuple[list[bool], list[str], str]:
    """Which sums (of ``cols`` and the rows) are integers, their names after ``rep``, and their schema."""
    kinds = dict(stats.dtypes)
    whole = [kinds[c] in ("tinyint", "smallint", "int", "bigint") for c in cols] + [True]
    names = ["rep", *[f"__sum_{c}" for c in cols], "__sum_n"]
    return whole, names, "rep int, " + ", ".join(f"`{c}` {'long' if int_ else 'double'}" for c, int_ in zip(names[1:], whole))


def _poisson_sums(stats: DataFrame, metrics: list[Metric], n_boot: int, seed: int, id_col: str, row_weight: str | None) -> DataFrame:
    """rep and the weighted sums of the metrics' statistics, each row with a
    Poisson(1) weight of its own per replicate (rep -1: each row once).
    ``row_weight``: how many rows a row stands for."""
    cols = statistics(metrics)
    whole, names, schema = _summed(stats, cols)

    def run(batches):
        out = _WeightedSums(whole, n_boot)
        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy() for c in (0, 1))
            x, known = _matrix(batch.columns[2:])
            for i in range(0, len(x), _ROWS_AT_ONCE):
                part = slice(i, i + _ROWS_AT_ONCE)
                w = np.ones((n_boot + 1, len(x[part])))
                w[1:] = _poisson_weights(h1[part], h2[part], n_boot)
                out.add(w, x[part], known[part])
        yield out.batch(names)

    h1, h2 = replicate_seeds(seed, id_col)
    rows = F.col(row_weight) if row_weight else F.lit(1)
    part = stats.select(h1.alias("__h1"), h2.alias("__h2"), *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(cols)],
                        rows.cast("double").alias("__rows"))
    return part.mapInArrow(run, schema).groupBy("rep").agg(*[F.sum(c).alias(c) for c in names[1:]])


def _packed(draws: DataFrame) -> DataFrame:
    """``draws`` (rep, __idx) as ``block, draws``: the rows drawn from a block of
    ``2^_BLOCK_BITS`` rows, four bytes a draw (replicate and place), many in one row."""
    def pack(held):
        rep, idx = (np.concatenate(c) for c in zip(*held))
        block = idx >> _BLOCK_BITS
        order = np.argsort(block.astype(np.uint16) if block.max() < 1 << 16 else block, kind="stable")
        block = block[order]
        packed = (rep[order].astype(np.uint32) << np.uint32(_BLOCK_BITS)) | (idx[order] & ((1 << _BLOCK_BITS) - 1)).astype(np.uint32)
        cut = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
        for k in range(0, len(cut) - 1, 1000):
            some = cut[k:k + 1001]
            yield pa.RecordBatch.from_arrays([pa.array(block[some[:-1]]), pa.array([packed[i:j].tobytes() for i, j in zip(some[:-1], some[1:])], pa.binary())],
                                             names=["block", "draws"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in (0, 1)])
            n += batch.num_rows
            if n >= _DRAWS_AT_ONCE:
                yield from pack(held)
                held, n = [], 0
        if n:
            yield from pack(held)

    return draws.select("rep", "__idx").mapInArrow(run, "block long, draws binary")


def _multinomial_sums(stats: DataFrame, metrics: list[Metric], n_boot: int, seed: int, id_col: str) -> DataFrame:
    """rep and the weighted sums of the metrics' statistics, the weights being ``n``
    draws by hash (rep -1: each row once).  The packed draws of a block meet its rows."""
    cols = statistics(metrics)
    whole, names, schema = _summed(stats, cols)
    if n_boot >= 1 << (32 - _BLOCK_BITS):
        raise ValueError(f"fewer than {1 << (32 - _BLOCK_BITS)} replicates are needed, not {n_boot}")
    ranked = dense_index(stats.select(F.col(id_col).alias("__id"), *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(cols)]),
                         "__id", "__idx", total_col="__n")
    draws = ranked.select(F.col("__idx").alias("__j"), "__n", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("rep"))
    u = hash_uniform(seed, F.col("rep"), F.col("__j"))
    packed = _packed(draws.select("rep", F.floor(u * F.col("__n")).cast("long").alias("__idx")))
    rows = ranked.select(F.shiftright("__idx", _BLOCK_BITS).alias("block"), F.col("__idx").bitwiseAND((1 << _BLOCK_BITS) - 1).alias("at"),
                         *[f"__x{i}" for i in range(len(cols))], F.lit(1.0).alias("__rows"))

    def run(held: pa.Table, drawn: pa.Table) -> pa.Table:
        held = held.sort_by("at")
        n = held.num_rows
        w = np.zeros((n_boot, n), np.int64).ravel()
        for d in drawn.column("draws"):
            d = np.frombuffer(d.as_buffer(), np.uint32)
            w += np.bincount((d >> np.uint32(_BLOCK_BITS)).astype(np.int64) * n + (d & np.uint32((1 << _BLOCK_BITS) - 1)), minlength=n_boot * n)
        out = _WeightedSums(whole, n_boot)
        x, known = _matrix([c.combine_chunks() for c in held.columns[2:]])
        out.add(np.vstack([np.ones(n), w.reshape(n_boot, n)]), x, known)
        return pa.Table.from_batches([out.batch(names)])

    both = rows.groupBy("block").cogroup(packed.groupBy("block")).applyInArrow(run, schema)
    return both.groupBy("rep").agg(*[F.sum(c).alias(c) for c in names[1:]])


def _exact_sums(stats: DataFrame, metrics: list[Metric], n_boot: int, seed: int, id_col: str) -> DataFrame:
    """rep and the weighted sums of the metrics' statistics, the weights being
    ``n`` draws with replacement (rep -1: each row once)."""
    cols = statistics(metrics)
    placed = range_sorted(stats.select(F.col(id_col).alias("__id"), *cols), ["__id"], without=("__id",))
    # one number per slice: as many as there are partitions
    sizes = {r["__rk_slice"]: r["n"] for r in placed.groupBy("__rk_slice").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = [sizes.get(k, 0) for k in range(max(sizes, default=-1) + 1)]
    names = ["rep", *[f"__sum_{c}" for c in cols], "__sum_n"]

    def run(batches):
        tree = DrawTree(sizes, n_boot, seed)
        total, seen = np.zeros((n_boot + 1, len(cols) + 1)), False
        block, weights = -1, None
        for batch in batches:
            slices, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = np.column_stack([*[batch.column(2 + k).to_numpy() for k in range(len(cols))], np.ones(batch.num_rows)])
            key = tree.blocks_before[slices] + at // tree.block
            cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))) if len(key) else []
            for i, j in zip(cut[:-1], cut[1:]):
                if key[i] != block:  # a block that goes on in another batch (or task) has the same weights there
                    block, weights = int(key[i]), tree.weights(int(key[i]))
                total[1:] += weights[:, at[i:j] % tree.block] @ x[i:j]
                total[0] += x[i:j].sum(axis=0)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, n_boot)), *[pa.array(total[:, k].copy()) for k in range(total.shape[1])]], names=names)

    part = placed.select("__rk_slice", "__rk_at", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    part = part.mapInArrow(run, ", ".join(f"`{c}` {'long' if c == 'rep' else 'double'}" for c in names))
    return part.groupBy("rep").agg(*[F.sum(c).alias(c) for c in names[1:]])


def bootstrap_ci(stats: DataFrame, metrics: list[str | Metric] | str | Metric, n_boot: int = 1000, ci: float = 0.95, seed: int = 42,
                 method: str = "blocks", id_col: str = "id", blocks: int = 4096) -> DataFrame:
    """A5: one row with ``<metric>`` (full-sample value), ``<metric>_ci_lower``
    and ``<metric>_ci_upper`` (percentiles of the replicate scores) per metric."""
    metrics = resolve(metrics)
    lo, hi = (1 - ci) / 2, (1 + ci) / 2
    reps = replicate_scores(stats, metrics, n_boot, seed, method, id_col, blocks=blocks)
    out = []
    for m in (m.name for m in metrics):
        sc, boot = F.col(f"score_{m}"), F.col("rep") >= 0
        out += [
            F.max(F.when(~boot, sc)).alias(m),
            F.percentile(F.when(boot, sc), F.lit(lo)).alias(f"{m}_ci_lower"),
            F.percentile(F.when(boot, sc), F.lit(hi)).alias(f"{m}_ci_upper"),
        ]
    return reps.groupBy().agg(*out)


def reconstruction_report(stats: DataFrame, prefix_tokens: int, n_boot: int = 1000, seed: int = 42,
                          method: str = "blocks", buckets: int | None = None,
                          keys: DataFrame | None = None) -> DataFrame:
    """Bleu, its CI, token F1, its CI, average reference tokens,
    compression ratio and samples in one row, from one weighted pass.
    ``stats`` = per-row ``id``, ``f1``, ``length`` and BLEU statistics.
    With ``buckets`` the record also carries ``length_buckets`` (A4, as an
    ordered ``array<struct>``), like the reference's report file."""
    ci = bootstrap_ci(stats, ["bleu", "f1", "length", "samples"], n_boot, 0.95, seed, method)
    avg = F.coalesce(F.col("length"), F.lit(0.0))
    out = ci.select(
        "bleu", "bleu_ci_lower", "bleu_ci_upper",
        F.col("f1").alias("token_f1"), F.col("f1_ci_lower").alias("token_f1_ci_lower"),
        F.col("f1_ci_upper").alias("token_f1_ci_upper"),
        avg.alias("avg_ref_tokens"),
        (avg / F.lit(prefix_tokens) if prefix_tokens else F.lit(0.0)).alias("token_compression_ratio"),
        F.coalesce(F.col("samples"), F.lit(0)).cast("long").alias("samples"),
    )
    if buckets:
        from textbench.functions.hashing import with_scalars
        from textbench.operators.buckets import as_report_array, length_buckets

        arr = as_report_array(length_buckets(stats, buckets, keys=keys))
        out = with_scalars(out, arr)
    return out
