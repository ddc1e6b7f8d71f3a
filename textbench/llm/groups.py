"""Components of a verified similarity relation inside candidate groups of any size.

Members of a candidate group are compared in blocks of bounded size.  A group
that fits one block is settled there.  A larger one (copies may be a third of
all rows) is cut into blocks by a hash; components found inside the blocks are
bridged through a few members of each, round after round, which joins dense
groups in a number of comparisons proportional to their size.  What is still
apart then (members outside the largest component of their group) is compared
with every block of its group, so no link between two components is lost: of
any two components at least one is not the largest.

That last step copies the payload of a group of n members up to n / block_rows
times.  With a ``PairTest`` it meets narrow rows instead: members that are apart
meet the others of their group in generated code, a test on a few words per
member leaves the pairs that may be linked, and only those get their payload.
With the keys that brought a group together, its members are first compared by
key, where links lie, so that few components are left and bridges are rarely needed.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textbench.llm.common import materialise, maybe_in
from textbench.llm.components import connected_components

REPS = 8  # members by which a component takes part in a bridging round
KEYS, KEY_ROWS = 3, 32  # a member's smallest keys by which it is compared, and members of a key compared at once
PAIR_ROWS = 4096  # narrow rows that a member meets at once: what a merge join keeps as a plain list


class PairTest(NamedTuple):
    """How members are compared pair by pair.  ``narrow(members)`` returns id,
    ``cls`` (a whole number; linked members are of one class or of neighbouring
    ones) and a few numbers per member; ``near(x, y)``, of two such rows (column
    by name), may be true for pairs without a link and is never false for linked
    ones; ``confirm(pairs, members)`` returns the linked ones of pairs (a, b)."""
    narrow: Callable[[DataFrame], DataFrame]
    near: Callable[[dict, dict], Column]
    confirm: Callable[[DataFrame, DataFrame], DataFrame]


def _slot(col, parts, salt: int = 0):
    return F.pmod(F.xxhash64(col, F.lit(salt)), parts).cast("int")


def _near_pairs(members: DataFrame, label: DataFrame, test: PairTest) -> DataFrame:
    """Pairs (a, b) of different components of a group, not both in its largest,
    that pass ``test.near``.  ``label``: id, grp, comp, main."""
    every = test.narrow(members).join(label, "id").withColumn("asked", F.col("comp") != F.col("main")).drop("main")
    every = materialise(every, "narrow")
    names = [c for c in every.columns if c not in ("grp", "asked")]
    # a member that is asked meets its class and the next one, and of the class before what is not asked itself
    bins = every.groupBy("grp", "cls", "asked").agg(F.ceil(F.count("*") / PAIR_ROWS).cast("int").alias("slots"))
    bins = materialise(bins, "narrow-bins")
    # no null occurs: said to Spark, so that the test's code has no branch for it and is short enough to be compiled
    bare = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names]
    y = every.join(bins, ["grp", "cls", "asked"]).withColumn("slot", _slot("id", F.col("slots")))
    y = y.select("grp", F.col("cls").alias("of"), F.coalesce("asked", F.lit(True)).alias("y_asked"), "slot", *bare).withColumnsRenamed(
        {c: f"y_{c}" for c in names})
    steps = bins.select("grp", F.col("cls").alias("of"), F.col("asked").alias("y_asked"), "slots", F.explode(
        F.when(F.col("asked"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(-1), F.lit(0), F.lit(1)))).alias("step"))
    steps = steps.withColumn("cls", F.col("of") - F.col("step")).drop("step")
    x = every.where("asked").drop("asked").join(steps, ["grp", "cls"]).withColumn(
        "slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    x = x.select("grp", "of", F.coalesce("y_asked", F.lit(True)).alias("y_asked"), "slot", *bare).withColumnsRenamed(
        {c: f"x_{c}" for c in names})
    # a few large groups are many pairs in few bytes: the tasks' number is given, so that they are not put together
    tasks, on = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["grp", "of", "y_asked", "slot"]
    both = x.repartition(tasks, *on).hint("merge").join(y.repartition(tasks, *on), on)
    once = ~F.col("y_asked") | (F.col("x_cls") < F.col("y_cls")) | (F.col("x_id") < F.col("y_id"))
    near = test.near(*[{c: F.col(f"{side}_{c}") for c in names} for side in "xy"])
    return both.where((F.col("x_comp") != F.col("y_comp")) & once & near).select(
        F.col("x_id").alias("a"), F.col("y_id").alias("b"))


def link_components(members: DataFrame, verify: Callable[..., DataFrame], block_rows: int,
                    keys: DataFrame | None = None, test: PairTest | None = None) -> DataFrame:
    """``members``: id, grp and any payload, one row per id.  ``verify(rows)``
    takes such rows with ``block`` (a block's number) and returns links (a, b)
    that connect whatever is linked in a block; ``verify(rows, asked)`` returns
    what links the asked rows of a block with its others.
    ``keys`` (id, key), a bounded number per id: members of large groups are first
    compared where they share a key, in place of blocks cut by a hash.  ``test``: how
    what is still apart in large groups is compared, in place of verify(rows, asked).
    Returns (node, component) for linked ids, as ``connected_components``."""
    payload = [c for c in members.columns if c not in ("id", "grp")]

    def blocks(df, *number):
        return df.select(F.xxhash64(*number).alias("block"), "id", *payload)

    big = materialise(
        members.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > block_rows)
        .select("grp", F.ceil(F.col("n") / block_rows).cast("int").alias("k")), "big")
    none = big.isEmpty()
    if none or keys is None:
        first = members.join(big, "grp", "left")
        edges = materialise(verify(blocks(first, "grp", _slot("id", F.coalesce("k", F.lit(1))))), "links")
    else:
        edges = materialise(verify(blocks(members.join(big, "grp", "left_anti"), "grp")), "links")
    if none:
        return connected_components(edges)

    inside = members.join(big, "grp")
    if keys is not None:
        ids = inside.select("id")
        mine = maybe_in(keys, "id", ids).join(ids, "id").groupBy("id").agg(
            F.slice(F.array_sort(F.collect_set("key")), 1, KEYS).alias("keys"))
        mine = materialise(mine.select("id", F.explode("keys").alias("key")), "group-keys")
        many = mine.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        part = F.pmod(F.xxhash64("id", "key"), F.ceil(F.col("n") / KEY_ROWS)).cast("int")
        places = mine.join(many, "key").select(F.col("id").alias("kid"), "key", part.alias("slot"))
        edges = materialise(edges.unionAll(verify(blocks(
            inside.join(places, F.col("id") == F.col("kid")), "key", "slot"))), "links")
    before, step = None, 0
    while True:
        comp = materialise(connected_components(edges), "comp")
        label = inside.select("id", "grp", "k").join(comp, F.col("id") == F.col("node"), "left").select(
            "id", "grp", "k", F.coalesce("component", "id").alias("comp"))
        per = label.groupBy("grp", "comp").agg(F.count("*").alias("c"))
        apart = materialise(
            per.groupBy("grp").agg(F.count("*").alias("comps"), F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("n"),
                                   F.count_if(F.col("c") >= KEY_ROWS / 2).alias("parts"))
            .where(F.col("comps") > 1).select("grp", "comps", F.col("top.comp").alias("main"), "n", "parts"), "apart")
        total, n, whole = apart.agg(F.sum("comps"), F.sum("n"), F.sum("parts")).first()
        if total is None:
            return comp
        label = label.join(apart.drop("n", "parts"), "grp")
        step += 1
        # after the keys, bridges are worth their rounds where blocks stayed components
        bridges = keys is None or test is None or step > 1 or whole * 4 * KEY_ROWS > n
        if bridges and (before is None or total < 0.9 * before):
            before = total
            rank = F.row_number().over(W.partitionBy("grp", "comp").orderBy(F.xxhash64("id", F.lit(step)), "id"))
            reps = label.withColumn("r", rank).where(F.col("r") <= REPS).select(
                F.col("id").alias("rid"),
                _slot("comp", F.ceil(F.col("comps") * REPS / block_rows).cast("int"), step).alias("slot"))
            bridge = inside.join(reps, F.col("id") == F.col("rid"))
            edges = materialise(edges.unionAll(verify(blocks(bridge, "grp", "slot"))), "links")
            continue
        if test is not None:
            pairs = materialise(_near_pairs(inside, label.select("id", "grp", "comp", "main"), test), "near-pairs")
            known = comp.select(F.col("node").alias("a"), F.col("component").alias("b"))
            return connected_components(materialise(known.unionAll(test.confirm(pairs, inside)), "links"))
        rest = label.where(F.col("comp") != F.col("main"))
        parts = rest.groupBy("grp").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("p"))
        data = inside.join(parts, "grp").withColumn("slot", _slot("id", F.col("k"))).withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
        asked = rest.select(F.col("id").alias("rid")).join(inside, F.col("id") == F.col("rid")).join(parts, "grp")
        asked = asked.withColumn("part", _slot("id", F.col("p"))).withColumn(
            "slot", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        number = ["grp", "slot", "part"]
        edges = materialise(edges.unionAll(verify(blocks(data, *number), blocks(asked, *number))), "links")
        return connected_components(edges)
