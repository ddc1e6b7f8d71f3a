"""Operator 10: fuzzy line deduplication by MinHash, in DataFrame operations only.

Lines of all texts are compared by their sets of ``q``-character shingles (a
shorter line is one shingle).  Equal lines count as one from the start.  Every
shingle gets one 64-bit hash; part of it deals the shingle to one of CLASSES
classes, and within a class the minima of ``hash xor c_j`` are the signature
coordinates, the constants c_j differing in their leading bits.  A band is ROWS
coordinates of one class.  Lines that share a band fall into one candidate
group; Jaccard >= num / den is confirmed on the full shingle sets, a distributed
union-find joins confirmed links, and of each component one line stays: that of
the smallest document id, then the earliest in it.

The shingles of a line are exploded and aggregated where the line is (after the
one exchange that brings equal lines together), so they are never shuffled.
With 10 bands of 4 a pair at similarity 0.8 shares no band with probability
0.5 %, at 0.85 0.06 %, and members of one group are compared whatever band
brought them together.

Lines are identified by a 64-bit hash; among 10^9 different lines two share it
with probability 3 %.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textbench.llm.common import conf, materialise, maybe_in, unused_name
from textbench.llm.components import connected_components
from textbench.llm.groups import PairTest, link_components

Q = 8
CLASSES, BANDS_PER_CLASS, ROWS = 5, 2, 4
WORDS, PARTS = 32, 4  # 64-bit words of a line's bit table, and the rows in which it is made
BLOCK_ROWS = 512
# a task has CLASSES groups per line: the aggregation's first hash table (2^16 groups by default) would hold a third
# of them, and each shingle of the others would go through the second
HASH_BITS = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _constants() -> list[int]:
    """One constant per coordinate; the leading bits differ."""
    n = BANDS_PER_CLASS * ROWS
    return [_signed((j << 61) | (0x1D8E4E27C47D124F * (2 * j + 1) >> 3 & ((1 << 61) - 1))) for j in range(n)]


def band_keys(lines: DataFrame, q: int) -> DataFrame:
    """``lines`` (lid, line), one row per line id -> (lid, key), one row per band.
    Lines are cut as UTF-16 code units, where a shingle is found in constant time."""
    x = lines.select("lid", F.encode("line", "UTF-16BE").alias("u"))
    last = F.greatest(F.expr("cast(octet_length(u) div 2 as int)") - q, F.lit(0))
    x = x.select("lid", "u", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    x = x.select("lid", F.expr(f"xxhash64(substring(u, 2 * i + 1, {2 * q}))").alias("h"))
    x = x.select("lid", F.shiftrightunsigned(F.shiftrightunsigned("h", 32) * CLASSES, 32).alias("c"), "h")
    mins = [F.min(F.col("h").bitwiseXOR(F.lit(c))).alias(f"m{j}") for j, c in enumerate(_constants())]
    sig = x.groupBy("lid", "c").agg(*mins)
    keys = [F.xxhash64("c", F.lit(b), *[f"m{j}" for j in range(b * ROWS, (b + 1) * ROWS)]) for b in range(BANDS_PER_CLASS)]
    return sig.select("lid", F.explode(F.array(*keys)).alias("key"))


def with_bits(members: DataFrame, q: int) -> DataFrame:
    """Adds b0 .. b31: a line's shingles as a table of 2048 bits.  Where two
    tables differ, the sets differ: the number of different bits bounds the
    size of the symmetric difference from below.  The table is made in PARTS
    rows per line, so that a shingle meets few of its words, and put together."""
    x = members.select("id", F.encode("line", "UTF-16BE").alias("u"))
    last = F.greatest(F.expr("cast(octet_length(u) div 2 as int)") - q, F.lit(0))
    x = x.select("id", "u", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    x = x.select("id", F.expr(f"xxhash64(substring(u, 2 * i + 1, {2 * q}))").alias("h"))
    x = x.select("id", F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"),
                 F.expr(f"cast(shiftrightunsigned(h, 6) & {WORDS - 1} as int)").alias("w"))
    each = WORDS // PARTS
    part = x.groupBy("id", F.expr(f"w div {each}").alias("part")).agg(
        *[F.bit_or(F.when(F.col("w") % each == j, F.col("bit")).otherwise(F.lit(0))).alias(f"p{j}") for j in range(each)])
    bits = part.groupBy("id").agg(
        *[F.bit_or(F.when(F.col("part") == j // each, F.col(f"p{j % each}")).otherwise(F.lit(0))).alias(f"b{j}")
          for j in range(WORDS)])
    return members.join(bits, "id")


def _shingles(line: str, q: int) -> str:
    """SQL: the set of a line's shingles, as an array of hashes."""
    # the code units are bound to a name, so that they are encoded once per line and not once per shingle
    return (f"array_distinct(element_at(transform(array(encode({line}, 'UTF-16BE')), u -> transform("
            f"sequence(0, greatest(cast(octet_length(u) div 2 as int) - {q}, 0)), i -> xxhash64(substring(u, 2 * i + 1, {2 * q})))), 1))")


def _differ(x, y, names):
    out = F.lit(0)
    for n in names:
        out = out + F.bit_count(x[n].bitwiseXOR(y[n]))
    return out


def _too_far(x, y, num: int, den: int) -> list:
    """Conditions on size and bit tables of two lines, each of which rules a link
    out: the sizes, some words of the tables, all words."""
    a, b = x["size"], y["size"]
    words = [f"b{j}" for j in range(WORDS)]
    return [(a * den < b * num) | (b * den < a * num)] + [
        _differ(x, y, names) * (den + num) > (a + b) * (den - num) for names in (words[:WORDS // 4], words)]


def pair_test(q: int, num: int, den: int) -> PairTest:
    """The comparison of ``verify_lines`` for pairs of lines of large groups."""
    words = [f"b{j}" for j in range(WORDS)]
    # a class is a little wider than the logarithms of two linked sizes can lie apart
    width = 1.000001 * math.log(den / num) + 1e-6 if num > 0 else math.inf

    def narrow(members: DataFrame) -> DataFrame:
        sized = members.select("id", F.expr(f"size({_shingles('line', q)})").alias("size"), *words)
        return sized.withColumn("cls", F.floor(F.log("size") / width))

    def near(x, y):
        sizes, some, every = _too_far(x, y, num, den)
        return ~sizes & ~some & ~every

    def confirm(pairs: DataFrame, members: DataFrame) -> DataFrame:
        line = members.select("id", "line")
        both = pairs.join(line.toDF("a", "la"), "a").join(line.toDF("b", "lb"), "b")
        both = both.select("a", "b", F.expr(_shingles("la", q)).alias("x"), F.expr(_shingles("lb", q)).alias("y"))
        both = both.withColumn("both", F.size(F.array_intersect("x", "y")))
        return both.where(F.col("both") * den >= (F.size("x") + F.size("y") - F.col("both")) * num).select("a", "b")

    return PairTest(narrow, near, confirm)


def verify_lines(q: int, num: int, den: int):
    """Exact Jaccard of the lines of one block (some dozens), on their full
    shingle sets.

    A fold over the pairs of the block keeps a label per line; a pair of equal
    labels is connected already and is skipped, a linked pair merges its
    labels.  A block so returns one link per line at most, however dense it is.
    Jaccard >= num / den asks for a symmetric difference of at most (den - num)
    / (den + num) of both sizes, so pairs whose bit tables differ in more bits
    are settled without a look at the sets."""
    sh = _shingles("line", q)
    words = [f"b{j}" for j in range(WORDS)]

    def linked(x, y):
        a, b = x["size"], y["size"]
        both = F.size(F.array_intersect(x["sh"], y["sh"]))
        sizes, some, every = _too_far(x, y, num, den)
        return (F.when(sizes, F.lit(False)).when(some, F.lit(False)).when(every, F.lit(False))
                .otherwise(both * den >= (a + b - both) * num))

    def verify(df: DataFrame, asked: DataFrame | None = None) -> DataFrame:
        df = df.withColumn("asked", F.lit(asked is None))
        if asked is not None:
            df = df.unionByName(asked.withColumn("asked", F.lit(True)))
        s = df.repartition("block").select("block", "asked", "id", F.expr(sh).alias("sh"), *words)
        s = s.select("block", F.struct(~F.col("asked"), F.col("id"), F.col("asked"), F.size("sh").alias("size"), "sh", *words).alias("m"))
        rows = s.groupBy("block").agg(F.collect_list("m").alias("ms"))
        # asked lines come first; each is compared with all lines of the block that
        # follow it, or, if only some are asked, with those that are not
        rows = rows.select(F.sort_array("ms").alias("ms")).where(F.size("ms") > 1)
        rows = rows.select(F.transform("ms", lambda m, i: F.struct(i.alias("i"), m.alias("m"))).alias("ms"))

        def visit(acc, x, y):
            li, lj = F.get(acc, x["i"]), F.get(acc, y["i"])
            merge = F.transform(acc, lambda c: F.when(c == F.greatest(li, lj), F.least(li, lj)).otherwise(c))
            hit = F.when((y["i"] > x["i"]) & (li != lj), linked(x["m"], y["m"])).otherwise(F.lit(False))
            return F.when(hit, merge).otherwise(acc)

        others = F.col("ms") if asked is None else F.filter("ms", lambda y: ~y["m"]["asked"])
        label = F.aggregate(
            F.filter("ms", lambda x: x["m"]["asked"]), F.sequence(F.lit(0), F.size("ms") - 1),
            lambda acc, x: F.aggregate(others, acc, lambda inner, y: visit(inner, x, y)))
        ends = F.transform(label, lambda c, i: F.struct(F.get("ms", i)["m"]["id"].alias("a"), F.get("ms", c)["m"]["id"].alias("b")))
        return rows.select(F.explode(F.filter(ends, lambda e: e["a"] != e["b"])).alias("p")).select("p.a", "p.b")

    return verify


def line_components(lines: DataFrame, q: int = Q, num: int = 80, den: int = 100) -> DataFrame:
    """``lines`` (lid, line), any number of rows per line -> (node, component) of lines with a link."""
    distinct = lines.groupBy("lid").agg(F.first("line").alias("line"))
    with conf(lines.sparkSession, HASH_BITS, "20"):
        keyed = materialise(band_keys(distinct, q), "lines-bands")
    shared = keyed.groupBy("key").agg(F.min("lid").alias("low"), F.max("lid").alias("high")).where("low < high")
    shared = materialise(shared.select("key", "low"), "lines-shared")
    near = maybe_in(keyed, "key", shared.select("key")).join(shared, "key").where("lid != low").select(
        F.col("lid").alias("a"), F.col("low").alias("b"))
    cand = materialise(connected_components(near), "lines-cand")
    members = maybe_in(lines, "lid", cand.select("node")).join(cand, F.col("lid") == F.col("node")).groupBy(
        F.col("lid").alias("id")).agg(F.first("component").alias("grp"), F.first("line").alias("line"))
    members = materialise(with_bits(members, q), "lines-members")
    return link_components(members, verify_lines(q, num, den), BLOCK_ROWS, keyed.select(F.col("lid").alias("id"), "key"),
                           pair_test(q, num, den))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: int = Q,
                num: int = 80, den: int = 100) -> DataFrame:
    """All columns of ``docs``, then n_lines (lines that hold more than white
    space), n_kept, removed (positions of removed lines, from 0, ascending)
    and kept_text (the text without them).

    * A null text has no lines: n_lines and n_kept 0, kept_text null; an empty
      text stays empty.  Blank lines are never compared nor removed.
    * Of a component the line with the smallest (id, position) stays, null ids
      last; rows that repeat both id and text are treated alike.
    * Lines may be of any length.  Extra columns pass through; those named like
      a result are replaced.  An empty table gives an empty result.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_kept", "removed", "kept_text")])
    key, has = F.xxhash64(F.col(f"`{text_col}`")), F.col(f"`{id_col}`")
    base = docs.select(F.coalesce(has.cast("long"), F.lit((1 << 63) - 1)).alias("id"), key.alias("h"),
                       F.col(f"`{text_col}`").alias("text"))
    lines = base.select("id", "h", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(
        F.length(F.btrim("line", F.lit(" \t\r\x0b\x0c"))) > 0)
    lid = F.xxhash64("line")
    # texts are split once for all steps but the last
    occ = materialise(lines.select("id", "h", "pos", lid.alias("lid"), "line"), "lines-occ")
    comp = materialise(line_components(occ.select("lid", "line"), q, num, den), "lines-comp")

    node = occ.join(comp, F.col("lid") == F.col("node"), "left").select(
        "id", "h", "pos", F.coalesce("component", "lid").alias("grp"))
    first = node.groupBy("grp").agg(F.count("*").alias("c"), F.min(F.struct("id", "pos", "h")).alias("stay")).where("c > 1")
    gone = node.join(first, "grp").where(F.struct("id", "pos", "h") != F.col("stay"))
    per = gone.groupBy("id", "h").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    per = materialise(per.select(F.col("id").alias("_gid"), F.col("h").alias("_gh"), "gone"), "lines-gone")

    i, h = unused_name(docs, "row_id"), unused_name(docs, "row_hash")
    left = docs.withColumn(i, F.coalesce(has.cast("long"), F.lit((1 << 63) - 1))).withColumn(h, key)
    # counted before the join: what is not asked for need not travel
    count = F.coalesce(F.size(F.filter(F.split(F.col(f"`{text_col}`"), "\n"), lambda x: F.length(
        F.btrim(x, F.lit(" \t\r\x0b\x0c"))) > 0)), F.lit(0)).cast("long")
    left = left.withColumn("n_lines", F.when(F.col(f"`{text_col}`").isNull(), F.lit(0).cast("long")).otherwise(count))
    out = left.join(per.withColumnsRenamed({"gone": "removed"}), (F.col(i) == F.col("_gid")) & (F.col(h) == F.col("_gh")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    kept = F.array_join(F.filter(F.split(F.col(f"`{text_col}`"), "\n"), lambda x, p: ~F.array_contains(removed, p)), "\n")
    kept = F.when(F.col("removed").isNull(), F.col(f"`{text_col}`")).otherwise(kept)
    names = [F.col(f"`{c}`") for c in docs.columns]
    return out.select(*names, "n_lines", (F.col("n_lines") - F.size(removed)).alias("n_kept"), removed.alias("removed"),
                      kept.alias("kept_text"))
