"""SPL1-3, LIM1-2, SMP1-5: deterministic splits, limits and sampling.

Every random choice is a P1 hash of (seed, salt, key), so results do not
depend on partitioning, task retries or execution order.  Exact-count cuts
use the P2 rank histogram; nothing is sorted into a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textbench.functions.hashing import hash_bits, hash_randint, hash_uniform
from textbench.operators.buckets import label_by_rank
from textbench.operators.ranking import range_rank, two_level_rank


def _shuffle_key(df: DataFrame, seed, key: str, salt: str = "shuffle") -> DataFrame:
    return df.withColumn("__h", hash_bits(seed, F.lit(salt), F.col(key)))


def auto_split(df: DataFrame, key: str, validation_ratio: float | None, test_ratio: float | None,
               seed: int = 42, split_col: str = "split") -> DataFrame:
    """SPL1: hold out ``ceil(n * (val + test))`` rows in seeded-shuffle order,
    the first ``ceil(holdout * test / (val + test))`` of them as ``test``
    (none when the test ratio is 0), the rest as ``validation``."""
    val = validation_ratio or 0.0
    test = test_ratio or 0.0
    hold = val + test
    if hold <= 0.0:
        raise ValueError("validation_ratio/test_ratio must be > 0 when auto-splitting")
    if hold >= 1.0:
        raise ValueError("validation_ratio + test_ratio must be < 1.0")

    def label(r, n):
        n_hold = F.ceil(n * F.lit(hold))
        n_test = F.ceil(n_hold * F.lit(test / hold)) if test > 0 else F.lit(0)
        return F.when(r < n_test, "test").when(r < n_hold, "validation").otherwise("train")

    h = _shuffle_key(df, seed, key)
    out = label_by_rank(h, "__h", key, label, split_col)
    return out.drop("__h")


def named_split(df: DataFrame, name: str, split_col: str = "split",
                supported: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """SPL2: rows of one named split; unsupported names are an error."""
    if name not in supported:
        raise ValueError(f"Unsupported evaluation split: {name}")
    if split_col not in df.columns:
        raise ValueError(f"Missing split column {split_col}")
    return df.filter(F.col(split_col) == name)


def group_split(df: DataFrame, group: Column, validation_ratio: float, test_ratio: float, seed: int = 42,
                split_col: str = "split") -> DataFrame:
    """SPL3: split by a group key (document id, or a hash of the normalised
    text for duplicate-aware splits): all rows of a group share a split."""
    u = hash_uniform(seed, F.lit("group"), group)
    return df.withColumn(
        split_col,
        F.when(u < test_ratio, "test").when(u < test_ratio + validation_ratio, "validation").otherwise("train"),
    )


FEW = 10_000  # rows that a limit may gather in one task


def limit_first(df: DataFrame, n: int | None, order_key: str, few: int = FEW) -> DataFrame:
    """LIM1: first ``n`` rows in dataset order (``None`` = all).

    Up to ``few`` rows meet in one task (``orderBy.limit``).  For more, only the
    keys are ranked (P2's range slices) and the key of the n-th row is a
    threshold: rows before it are filtered where they lie, and of the rows
    that share it as many are taken as are missing."""
    if n is None:
        return df
    if n <= few:
        return df.orderBy(order_key).limit(n)
    key = F.col(order_key)
    ranked = range_rank(df.select(order_key), [order_key], "__r")
    last = ranked.where(F.col("__r") == n - 1).select(order_key).collect()
    if not last:  # fewer rows than asked for
        return df
    cut = F.lit(last[0][0]).cast(df.schema[order_key].dataType)
    before = (key < cut) | (key.isNull() & cut.isNotNull())  # nulls first
    before = F.coalesce(before, F.lit(False))
    missing = n - df.where(before).count()
    same = range_rank(df.where(key.eqNullSafe(cut)), [order_key], "__r").where(F.col("__r") < missing).drop("__r")
    return df.where(before).unionByName(same)


def limit_splits(df: DataFrame, split_col: str, limits: dict[str, int | None], order_key: str) -> DataFrame:
    """LIM1 per split: the first ``limits[split]`` rows of each split in dataset
    order (``None``: all of it); splits without an entry keep all their rows."""
    out = df.filter(F.col(split_col).isNull() | ~F.col(split_col).isin(*limits)) if limits else df
    for split, n in limits.items():
        out = out.unionByName(limit_first(df.filter(F.col(split_col) == split), n, order_key))
    return out


def cap_per_group(df: DataFrame, group: str, n: int, order: Column, salts: int = 64,
                  rank_col: str | None = None) -> DataFrame:
    """LIM2: at most ``n`` rows per group, the first by ``order`` (ties by
    ``order`` are broken arbitrarily; pass a unique order).

    Skew-safe: a first window keeps the top ``n`` of every (group, salt)
    slice, so a hot group is spread over ``salts`` tasks; the second window
    sees at most ``n * salts`` rows per group.  Exact: the top ``n`` of a
    group are among the top ``n`` of its slices.
    """
    salted = df.withColumn("__o", order).withColumn("__salt", F.pmod(F.xxhash64(F.col("__o")), F.lit(salts)))
    w1 = Window.partitionBy(group, "__salt").orderBy("__o")
    first = salted.withColumn("__r1", F.row_number().over(w1)).filter(F.col("__r1") <= n)
    w2 = Window.partitionBy(group).orderBy("__o")
    out = first.withColumn("__r2", F.row_number().over(w2)).filter(F.col("__r2") <= n)
    if rank_col:
        out = out.withColumn(rank_col, F.col("__r2"))
    return out.drop("__o", "__salt", "__r1", "__r2")


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42, position_col: str = "position",
                   salt: str = "shuffle") -> DataFrame:
    """SMP1: deterministic permutation: 0-based position in hash order."""
    h = _shuffle_key(df, seed, key, salt)
    return two_level_rank(h, "__h", key, position_col).drop("__h")


def bernoulli(rate: float, seed, salt: str, *keys) -> Column:
    """SMP2: independent coin flip per (seed, salt, keys)."""
    return hash_uniform(seed, F.lit(salt), *keys) < F.lit(rate)


def sample_k_of_n(k, n, seed, *keys) -> Column:
    """SMP3: ``k`` distinct indices in ``[0, n)`` (k clamped to [1, n]) by
    Floyd's algorithm [public: Bentley & Floyd 1987], then put in a random
    order; no rejection loop."""
    kk = F.greatest(F.lit(1), F.least(k, n))
    steps = F.sequence(n - kk, n - 1)

    def step(acc, j):
        t = hash_randint(F.lit(0), j, seed, *keys, F.lit("floyd"), j)
        return F.when(F.array_contains(acc, t), F.concat(acc, F.array(j))).otherwise(F.concat(acc, F.array(t)))

    chosen = F.aggregate(steps, F.array().cast("array<bigint>"), step)
    keyed = F.transform(chosen, lambda v: F.struct(hash_bits(seed, *keys, F.lit("order"), v).alias("h"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda s: s["v"])


def decoy_index(n, chosen, seed, *keys) -> Column:
    """SMP4: uniform index in ``[0, n)`` outside ``chosen`` (which must not
    cover everything): draw in ``[0, n - k)`` then step over the sorted
    chosen indices."""
    k = F.size(chosen)
    d = hash_randint(F.lit(0), n - k - 1, seed, *keys, F.lit("decoy"))
    return F.aggregate(F.array_sort(chosen), d, lambda acc, c: F.when(acc >= c, acc + 1).otherwise(acc))


def random_truncate(tokens, batch_id, seed, min_tokens: int | None, max_tokens: int) -> Column:
    """SMP5: one random cap per batch in ``[min_tokens, max_tokens]``
    (fixed ``max_tokens`` when ``min_tokens`` is None), applied to its rows."""
    if min_tokens is None:
        cap = F.lit(max_tokens)
    else:
        cap = hash_randint(F.lit(min_tokens), F.lit(max_tokens), seed, F.lit("trunc"), batch_id)
    return F.slice(tokens, 1, cap.cast("int"))
