"""Operator 4: mixing sources to target weights by weighted fair queueing, in
DataFrame operations only.

Every source has a target number of words (``source_targets``).  Its documents
are shuffled by a hash of id and text (and of their number among equal rows, so
that each repeat has a place of its own) and may be taken up to ``repeats`` times, one whole round
after another.  A copy's virtual finish time is the words its source has put out
up to and including it, divided by the source's weight in the queue, its target.
All copies are sorted by finish time over all sources and the sequence is cut
where the words taken reach the total budget: a source stops near its target,
since at virtual time 1 each has put out just that.

Both running sums (words within a source, words over the whole sequence) are
taken in two levels: buckets of equal hash range or equal virtual time, sums
per bucket, and running sums inside a bucket, so neither a hot source nor the
whole sequence is ever one task's window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textbench.llm.common import materialise, unused_name
from textbench.operators.ranking import range_rank

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
REPEATS = 2
BUCKET_ROWS = 20_000
SHUFFLE_RANGE = 1 << 60  # shuffle values are the first 15 hex digits of an md5
LATEST = 2.0  # copies that finish later than this are beyond the cut (it lies near 1)


def word_count(text) -> F.Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in the text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """``sizes`` (source, size), one row per source -> source, source_size, target.

    Sources by code point, null last, take ``weights`` in turn and share
    ``budget`` times all sizes by them; none gets more than ``repeats`` times
    its size, the excess going to the others by weight.  In closed form: at
    level v a source gets min(weight * v, repeats * size), and the level is
    found between the points where sources fill up, by one running sum over the
    sources sorted by these points.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.encode(F.coalesce("source", F.lit("")), "UTF-8"))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), turn)
    s = sizes.select("source", F.col("size").alias("source_size")).withColumn("w", w)
    s = s.withColumn("cap", F.col("source_size") * float(repeats)).withColumn("full", F.col("cap") / F.col("w"))
    order = W.orderBy("full", F.col("source").isNull(), "source")
    s = s.withColumns({
        "used": F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "live": F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)),
        "goal": F.sum("source_size").over(W.partitionBy()) * float(budget)})
    # the level if all before this source are full and it and all later ones are not;
    # right for the first source that it does not fill, and lower for those after it
    s = s.withColumn("try", (F.col("goal") - F.col("used")) / F.col("live"))
    s = s.withColumn("level", F.max(F.when(F.col("try") <= F.col("full"), F.col("try"))).over(W.partitionBy()))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("level")))
    return s.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights=WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS, seed: int = 11,
                bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All columns of ``docs``, then size, source_size, target, copies, taken.

    * A null or wordless text has size 0: it adds no words, whatever its copies.
    * A null source is a source of its own, the last; null ids and repeated
      rows are documents like others.  Rows that repeat id, source and text are
      numbered; each has its own place in the shuffle and its own copies, and
      which of them gets which is left open.
    * Documents are taken whole or not at all; one that is longer than twice its
      source's target is not.
    * Extra columns pass through; those named like a result are replaced.  An
      empty table gives an empty result; sources without words get target 0.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("size", "source_size", "target", "copies", "taken")])
    text, src, did = F.col(f"`{text_col}`"), F.col(f"`{source_col}`"), F.col(f"`{id_col}`")
    rid = unused_name(docs, "rid")
    # written once, so that row ids stay
    docs = materialise(docs.withColumn(rid, F.monotonically_increasing_id()), "mix-documents")
    rows = docs.select(F.col(rid).alias("rid"), did.alias("id"), src.alias("source"), word_count(text).alias("words"), F.md5(text).alias("h"))
    rows = materialise(rows, "mix-sizes")
    kind = ["id", "source", "h"]
    several = rows.groupBy(*kind).agg(F.count("*").alias("m")).where(F.col("m") > 1).select(*[F.col(c).alias(f"k_{c}") for c in kind])
    several = materialise(several, "mix-repeated")
    same = F.expr(" and ".join(f"{c} <=> k_{c}" for c in kind))
    # numbered in ranges: one kind may be a third of all rows
    repeated = range_rank(rows.join(several, same, "left_semi"), ["rid"], "nth", partition_cols=kind)
    rows = rows.join(several, same, "left_anti").withColumn("nth", F.lit(0).cast("long")).unionByName(repeated)
    value = F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string"), F.col("h"), F.when(F.col("nth") > 0, F.col("nth"))))
    rows = rows.withColumn("r", F.conv(F.substring(value, 1, 15), 16, 10).cast("long"))
    rows = materialise(rows.select("rid", "id", "source", "words", "r", "h", "nth"), "mix-rows")
    k = max(1, -(-rows.count() // bucket_rows))
    sizes = rows.groupBy("source").agg(F.sum("words").alias("size"))
    sizes = materialise(source_targets(sizes, weights, budget, repeats), "mix-sources")
    goal = sizes.agg(F.sum("target")).first()[0] or 0.0

    # words that the source puts out up to each document, in the order of the shuffle
    wide = rows.withColumn("b", F.floor(F.col("r") / float(SHUFFLE_RANGE) * k))
    per = wide.groupBy("source", "b").agg(F.sum("words").alias("bw"))
    before = per.select("source", "b", (F.sum("bw").over(W.partitionBy("source").orderBy("b")) - F.col("bw")).alias("off"))
    inside = W.partitionBy("source", "b").orderBy("r", "id", "h", "nth").rowsBetween(W.unboundedPreceding, 0)
    run = wide.withColumn("cum", F.sum("words").over(inside)).alias("x").join(
        before.alias("y"), F.expr("x.source <=> y.source and x.b = y.b")).select(
        "x.*", (F.col("cum") + F.col("off")).alias("upto")).drop("cum", "b")
    run = run.alias("x").join(sizes.alias("y"), F.expr("x.source <=> y.source")).select("x.*", "y.source_size", "y.target")
    run = materialise(run, "mix-run")

    # the sequence of all copies by finish time, cut at the budget
    finish = F.when(F.col("target") > 0, (F.col("upto") + F.col("turn") * F.col("source_size")) / F.col("target")).otherwise(
        F.col("r") / float(SHUFFLE_RANGE))
    seq = run.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("finish", finish)
    seq = seq.where(F.col("finish") < LATEST).withColumn("v", F.floor(F.col("finish") * k)).select(
        "rid", "id", "h", "nth", "r", "words", "turn", "finish", "v")
    per = seq.groupBy("v").agg(F.sum("words").alias("vw"))
    before = per.select(F.col("v").alias("pv"), (F.sum("vw").over(W.orderBy("v")) - F.col("vw")).alias("off"))
    order = W.partitionBy("v").orderBy("finish", "r", "id", "h", "nth", "turn").rowsBetween(W.unboundedPreceding, 0)
    state = seq.join(before, F.col("v") == F.col("pv")).withColumn("total", F.sum("words").over(order) + F.col("off"))
    chosen = state.where(F.col("total") <= goal).groupBy("rid").agg(F.count("*").cast("int").alias("copies"))

    facts = run.join(chosen, "rid", "left").select(
        F.col("rid").alias("_rid"), F.col("words").alias("_size"), "source_size", "target", F.coalesce("copies", F.lit(0)).alias("copies"))
    out = docs.join(facts, F.col(rid) == F.col("_rid"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c != rid], F.col("_size").alias("size"), "source_size", "target", "copies",
                      (F.col("_size") * F.col("copies")).alias("taken"))
