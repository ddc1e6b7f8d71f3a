"""Corpus BLEU from per-row n-gram sufficient statistics.

Definition [public: Papineni et al. 2002; sacreBLEU defaults]: 13a
tokenisation, n = 1..4, one reference, clipped n-gram matches, brevity
penalty ``exp(1 - ref/sys)`` when ``sys < ref``, ``exp`` smoothing (each
order with zero matches doubles the divisor), score 0 when nothing matches
at all or when some order has no hypothesis n-grams.

Physical plan: no exchange.  A numpy kernel over Arrow batches makes the literal
replacements, cuts tokens and counts the grams of many pairs at once
(``functions/grams.py``); a row's statistics come from its own two texts, so no
n-gram ever becomes a row or crosses the network.  A very long document costs
one task its own size, never a third of the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textbench.functions.grams import LATIN, MARK, MAX_ORDER, batch_pair_stats, batch_stats, replaced
from textbench.functions.text import spaced_13a, token_length, tokens_13a, words

STAT_COLS = ["sys_len", "ref_len"] + [f"m{n}" for n in range(1, 5)] + [f"t{n}" for n in range(1, 5)]


def bleu_row_stats(
    df: DataFrame,
    id_col: str = "id",
    hyp_col: str = "prediction",
    ref_col: str = "reference",
    tokenizer=tokens_13a,
    keep: list[str] | None = None,
) -> DataFrame:
    """Per-row BLEU statistics: ``sys_len, ref_len, m1..m4, t1..t4``.

    ``tokenizer``: a column function from text to an array of tokens (a token
    of the caller's that holds U+001F counts as several).  ``keep`` lists
    extra columns of ``df`` carried through to the output.  A null text has no tokens.
    """
    spaced, separator = (lambda c: c, None) if tokenizer is tokens_13a else (lambda c: F.array_join(tokenizer(c), "\x1f"), 0x1F)
    return _counted(df, [id_col, *(keep or [])], spaced(F.col(hyp_col)), spaced(F.col(ref_col)), separator, None, STAT_COLS)


def pair_text_stats(df: DataFrame, id_col: str = "id", hyp_col: str = "prediction", ref_col: str = "reference",
                    keep: list[str] | None = None) -> DataFrame:
    """Per row ``length`` (reference length, as ``text.token_length``), ``f1`` (as
    ``metrics.token_f1_col``) and the statistics of :func:`bleu_row_stats`, after ``keep``:
    all from one pass of the kernel over both texts.

    The kernel counts tokens of texts in Latin script; where a reference has other
    characters, the expression counts them (the classes of those grow with Unicode)."""
    kept = [id_col, *(keep or [])]
    ref = F.col(ref_col)
    src = df.select(*[F.col(f"`{c}`") for c in kept], F.when(ref.rlike(f"[^\\x00-{LATIN}]"), token_length(ref)).cast("int").alias("__n"),
                    F.col(hyp_col).alias("__h"), ref.alias("__r"))
    schema = T.StructType([*src.schema.fields[:-3], T.StructField("length", T.IntegerType()), T.StructField("f1", T.DoubleType()),
                           *[T.StructField(c, T.LongType()) for c in STAT_COLS]])

    def run(batches):
        for batch in batches:
            *cols, beyond, hyp, ref = batch.columns
            no_hyp, no_ref = (c.is_null().to_numpy(zero_copy_only=False) for c in (hyp, ref))
            stats, sets, length = batch_pair_stats(hyp.fill_null(""), ref.fill_null(""))
            own, other, common = sets.T
            length = np.where(beyond.is_valid().to_numpy(zero_copy_only=False), beyond.fill_null(0).to_numpy(zero_copy_only=False), length)
            precision, recall = common / np.maximum(own, 1), common / np.maximum(other, 1)
            f1 = 2 * precision * recall / np.maximum(precision + recall, 1e-300)
            # a null text beside an empty one scores 0, else null
            unknown = (no_hyp & (no_ref | (other > 0))) | (no_ref & (own > 0))
            cols += [pa.array(length.astype(np.int32), mask=no_ref), pa.array(f1, mask=unknown), *[pa.array(stats[:, c]) for c in range(stats.shape[1])]]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return src.mapInArrow(run, schema)


def bleu_prefix_stats(
    df: DataFrame,
    budgets: list[int],
    id_col: str = "id",
    hyp_col: str = "prediction",
    ref_col: str = "reference",
    keep: list[str] | None = None,
) -> DataFrame:
    """Per-row BLEU statistics of the first ``b`` words of the hypothesis for
    every budget ``b``, as columns ``b<b>_sys_len`` ... ``b<b>_t4``.

    Both texts are tokenised once, the hypothesis up to the largest budget; one
    walk over it gives all prefixes (a prefix's 13a tokens are the first tokens
    of the longer text, since every word ends at a space)."""
    budgets = sorted(set(budgets))
    mark = chr(MARK)
    head = F.slice(words(F.replace(F.col(hyp_col), F.lit(mark), F.lit(" "))), 1, budgets[-1])
    names = [f"b{b}_{c}" for b in budgets for c in STAT_COLS]
    return _counted(df, [id_col, *(keep or [])], spaced_13a(F.array_join(head, f" {mark} ")), spaced_13a(F.col(ref_col)), 0x20, budgets, names)


def _counted(df: DataFrame, keep: list[str], hyp: Column, ref: Column, separator: int | None, budgets: list[int] | None,
             names: list[str]) -> DataFrame:
    """Columns ``keep`` and the statistics ``names`` of each row."""
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(hyp, F.lit("")).alias("__h"), F.coalesce(ref, F.lit("")).alias("__r"))
    schema = T.StructType([*src.schema.fields[:-2], *[T.StructField(c, T.LongType()) for c in names]])

    def run(batches):
        for batch in batches:
            k = batch.num_columns - 2
            texts = batch.columns[k:] if separator is not None else [replaced(c) for c in batch.columns[k:]]
            stats = batch_stats(*texts, separator, budgets)
            cols = [batch.column(c) for c in range(k)] + [pa.array(stats[:, c]) for c in range(stats.shape[1])]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return src.mapInArrow(run, schema)


def bleu_sums() -> list[Column]:
    """Aggregations that turn per-row statistics into corpus totals."""
    return [F.sum(c).cast("double").alias(f"S_{c}") for c in STAT_COLS]


def bleu_from_sums(prefix: str = "S_") -> Column:
    """Corpus BLEU (0-100) from summed statistics columns ``{prefix}m1`` etc."""
    return bleu_from(lambda c: F.col(prefix + c))


def bleu_from(g) -> Column:
    """Corpus BLEU (0-100) from ``g(name)``, the sum of each statistic."""
    sys_len, ref_len = g("sys_len"), g("ref_len")
    bp = F.when(sys_len < ref_len, F.when(sys_len > 0, F.exp(1 - ref_len / sys_len)).otherwise(0.0)).otherwise(1.0)
    zeros = F.lit(0)
    log_sum = F.lit(0.0)
    for n in range(1, 5):
        m, t = g(f"m{n}"), g(f"t{n}")
        zeros = zeros + F.when(m == 0, 1).otherwise(0)
        p = F.when(m == 0, 100.0 / (F.pow(F.lit(2.0), zeros) * t)).otherwise(100.0 * m / t)
        log_sum = log_sum + F.log(p)
    any_match = (g("m1") + g("m2") + g("m3") + g("m4")) > 0
    all_totals = F.least(g("t1"), g("t2"), g("t3"), g("t4")) > 0
    return (
        F.when(sys_len.isNull(), F.lit(None).cast("double"))
        .when(~any_match | ~all_totals, F.lit(0.0))
        .otherwise(bp * F.exp(log_sum / 4.0))
    )


def corpus_bleu(df: DataFrame, id_col: str = "id", hyp_col: str = "prediction", ref_col: str = "reference",
                group_cols: list[str] | None = None) -> DataFrame:
    """A3: corpus BLEU, optionally per group (e.g. per model)."""
    group_cols = group_cols or []
    stats = bleu_row_stats(df, id_col, hyp_col, ref_col, keep=group_cols)
    return stats.groupBy(*group_cols).agg(*bleu_sums()).select(*group_cols, bleu_from_sums().alias("bleu"))


# ---------------------------------------------------------------------------
# DuckDB text of the same computation (oracle side)
# ---------------------------------------------------------------------------

SQL_13A = r"""
list_filter(string_split_regex(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    ' ' || replace(replace(replace(replace(replace(replace(replace(
        regexp_replace({x}, '\s+$', ''), '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '),
        '&quot;', '"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') || ' ',
    '([\{-\~\[-\` -\&\(-\+\:-\@\/])', ' \1 ', 'g'),
    '([^0-9])([\.,])', '\1 \2 ', 'g'),
    '([\.,])([^0-9])', ' \1 \2', 'g'),
    '([0-9])(-)', '\1 \2 ', 'g'),
  '\s+'), lambda t: t <> '')
"""


def sql_bleu_row_stats(src: str, id_col: str = "id", hyp: str = "prediction", ref: str = "reference",
                       keep: list[str] | None = None) -> str:
    """DuckDB query producing the same per-row statistics as :func:`bleu_row_stats`."""
    keep = keep or []
    kp = "".join(f"{k}, " for k in keep)
    return f"""
WITH tok AS (
  SELECT {id_col}, {kp}{SQL_13A.replace('{x}', hyp)} AS h, {SQL_13A.replace('{x}', ref)} AS r FROM ({src})
), x AS (
  SELECT {id_col}, {kp}1 AS s, unnest(h) AS w1, unnest(range(len(h))) AS i FROM tok
  UNION ALL
  SELECT {id_col}, {kp}0 AS s, unnest(r) AS w1, unnest(range(len(r))) AS i FROM tok
), y AS (
  SELECT *, lead(w1, 1) OVER win AS w2, lead(w1, 2) OVER win AS w3, lead(w1, 3) OVER win AS w4
  FROM x WINDOW win AS (PARTITION BY {id_col}, s ORDER BY i)
), g AS (
  SELECT {id_col}, {kp}1 AS n, w1 AS g, s FROM y
  UNION ALL SELECT {id_col}, {kp}2, concat_ws(chr(1), w1, w2), s FROM y WHERE w2 IS NOT NULL
  UNION ALL SELECT {id_col}, {kp}3, concat_ws(chr(1), w1, w2, w3), s FROM y WHERE w3 IS NOT NULL
  UNION ALL SELECT {id_col}, {kp}4, concat_ws(chr(1), w1, w2, w3, w4), s FROM y WHERE w4 IS NOT NULL
), pg AS (
  SELECT {id_col}, {kp}n, g, sum(s) AS ch, sum(1 - s) AS cr FROM g GROUP BY ALL
), per AS (
  SELECT {id_col}, {kp}
    sum(CASE WHEN n = 1 THEN ch ELSE 0 END) AS sys_len,
    sum(CASE WHEN n = 1 THEN cr ELSE 0 END) AS ref_len,
    sum(CASE WHEN n = 1 THEN least(ch, cr) ELSE 0 END) AS m1,
    sum(CASE WHEN n = 2 THEN least(ch, cr) ELSE 0 END) AS m2,
    sum(CASE WHEN n = 3 THEN least(ch, cr) ELSE 0 END) AS m3,
    sum(CASE WHEN n = 4 THEN least(ch, cr) ELSE 0 END) AS m4
  FROM pg GROUP BY ALL
)
SELECT t.{id_col}, {''.join(f't.{k}, ' for k in keep)}
  CAST(coalesce(sys_len, 0) AS BIGINT) AS sys_len, CAST(coalesce(ref_len, 0) AS BIGINT) AS ref_len,
  CAST(coalesce(m1, 0) AS BIGINT) AS m1, CAST(coalesce(m2, 0) AS BIGINT) AS m2,
  CAST(coalesce(m3, 0) AS BIGINT) AS m3, CAST(coalesce(m4, 0) AS BIGINT) AS m4,
  CAST(greatest(coalesce(sys_len, 0), 0) AS BIGINT) AS t1, CAST(greatest(coalesce(sys_len, 0) - 1, 0) AS BIGINT) AS t2,
  CAST(greatest(coalesce(sys_len, 0) - 2, 0) AS BIGINT) AS t3, CAST(greatest(coalesce(sys_len, 0) - 3, 0) AS BIGINT) AS t4
FROM tok t LEFT JOIN per USING ({id_col}{''.join(f', {k}' for k in keep)})
"""


def sql_bleu_from_sums(p: str = "S_") -> str:
    """DuckDB expression of :func:`bleu_from_sums`."""
    z = []
    acc = "0"
    for n in range(1, 5):
        acc = f"{acc} + CASE WHEN {p}m{n} = 0 THEN 1 ELSE 0 END"
        z.append(acc)
    logs = " + ".join(
        f"ln(CASE WHEN {p}m{n} = 0 THEN 100.0 / (pow(2.0, {z[n-1]}) * {p}t{n}) ELSE 100.0 * {p}m{n} / {p}t{n} END)"
        for n in range(1, 5)
    )
    bp = (f"CASE WHEN {p}sys_len < {p}ref_len THEN (CASE WHEN {p}sys_len > 0 THEN "
          f"exp(1 - {p}ref_len / {p}sys_len) ELSE 0.0 END) ELSE 1.0 END")
    return (
        f"CASE WHEN {p}sys_len IS NULL THEN NULL "
        f"WHEN ({p}m1 + {p}m2 + {p}m3 + {p}m4) = 0 OR least({p}t1, {p}t2, {p}t3, {p}t4) = 0 THEN 0.0 "
        f"ELSE ({bp}) * exp(({logs}) / 4.0) END"
    )


def sql_bleu_sums(p: str = "S_") -> str:
    return ", ".join(f"CAST(sum({c}) AS DOUBLE) AS {p}{c}" for c in STAT_COLS)
