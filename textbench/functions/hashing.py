"""Deterministic per-row randomness.

Seeded RNG objects do not survive a distributed plan (task retries, AQE
re-planning and partition order would all change the draws).  Every random
decision is therefore a pure function of ``(seed, salt, key columns)``:
``md5`` of the colon-joined values, first 52 bits, divided by 2**52 (so that
every index of a corpus of more than 2**32 rows can be drawn).  The same
expression runs in DuckDB as
``('0x' || substr(md5(concat_ws(':', ...)), 1, 13))::BIGINT / 4503599627370496.0``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = 4503599627370496.0


def _parts(seed, cols) -> list[Column]:
    out = [F.lit(str(seed))]
    for c in cols:
        out.append(F.col(c) if isinstance(c, str) else c)
    return out


def hash_bits(seed, *cols) -> Column:
    """Unsigned 32-bit integer from md5 of ``seed:col1:col2...`` (bigint)."""
    digest = F.md5(F.concat_ws(":", *_parts(seed, cols)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_uniform(seed, *cols) -> Column:
    """Uniform double in [0, 1), a multiple of 2**-52."""
    digest = F.md5(F.concat_ws(":", *_parts(seed, cols)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(TWO_52)


def hash_randint(lo, hi, seed, *cols) -> Column:
    """Uniform integer in the closed range [lo, hi] (lo/hi may be columns)."""
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    return (lo_c + F.floor(hash_uniform(seed, *cols) * (hi_c - lo_c + 1))).cast("bigint")


def sql_hash_uniform(seed, *exprs: str) -> str:
    """DuckDB SQL text of :func:`hash_uniform` (for oracle queries)."""
    inner = ", ".join([f"'{seed}'"] + [f"CAST({e} AS VARCHAR)" for e in exprs])
    return f"(('0x' || substr(md5(concat_ws(':', {inner})), 1, 13))::BIGINT / 4503599627370496.0)"


def sql_hash_randint(lo: str, hi: str, seed, *exprs: str) -> str:
    return f"CAST(({lo}) + floor({sql_hash_uniform(seed, *exprs)} * (({hi}) - ({lo}) + 1)) AS BIGINT)"


def sql_hash_bits(seed, *exprs: str) -> str:
    """DuckDB SQL text of :func:`hash_bits`."""
    inner = ", ".join([f"'{seed}'"] + [f"CAST({e} AS VARCHAR)" for e in exprs])
    return f"(('0x' || substr(md5(concat_ws(':', {inner})), 1, 8))::BIGINT)"


def with_scalars(df, scalars):
    """Attach the columns of a one-row aggregate (``groupBy().agg(...)``,
    exactly one row by construction) to every row of ``df`` as a scalar
    subquery: Spark evaluates it once and inlines the value into the tasks,
    so no join (and no data-sized side) is involved."""
    cols = scalars.columns
    packed = scalars.select(F.struct(*[F.col(c) for c in cols]).alias("__sv")).scalar()
    out = df.withColumn("__sv", packed)
    return out.select(*[F.col(c) for c in df.columns], *[F.col("__sv")[c].alias(c) for c in cols])
