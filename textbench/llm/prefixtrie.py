"""Operator 11: prefix trie of conversations, subtree totals by time-forward processing.

A node is a distinct sequence of first turns (role and text).  It is found by a
128-bit key: the exclusive or, over the turns, of two 64-bit hashes of
(place, role, text), a running value along each conversation; two sequences
of one length share a key with a chance of 2^-128.  Nodes are groups of
(conversation, depth) rows, so a first turn that a third of all conversations
share is summed before it is shuffled.  A node's name is (smallest member,
depth); the nodes with one smallest member are a vertical path.

Subtree totals go from children to parents in reverse level order.  The
nodes are cut into shards:

* A node is light if its members have at most ``shard_rows`` turns from it on,
  which bounds its subtree.  Whole light subtrees are shards; a task takes some,
  sorted by falling depth, and every node sends its totals to its parent through
  a priority queue ordered like the nodes (it spills sorted runs to its
  own temporary file), so a node's messages are on top when its turn comes.
* The heavy nodes above get the totals of the shard roots below them, summed per
  parent before they meet it.  They have few leaves (each has more
  than ``shard_rows`` turns under it), so cut into path pieces of ``shard_rows``
  levels they are a small tree of pieces, at most about 2 * rows / shard_rows;
  that tree is processed the same way across the shard roots, and then
  every piece for itself, with what its child pieces sent.

So no task holds more than its shards, whether one first turn leads a third of
all conversations or one conversation has a third of all turns.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textbench.llm.common import materialise
from textbench.llm.merkle import sql_crc32
from textbench.operators.ranking import range_rank, range_sorted

CHAIN = 4096  # turns of a conversation in one window
IDS = 4096  # conversation ids in one chunk of an id list
WORD = r"[^\x20\x09-\x0D]+"
QUEUE = 200_000  # messages of a queue in memory


# -- rebuilt conversations and their prefixes --

def family(c: Column) -> tuple[Column, Column]:
    """(h, base): how many first turns a conversation takes over, and from which."""
    return F.crc32(c.cast("string")) % 4, c - c % 20


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """c, i (place in the conversation), n (its turns), t1, t2 (hashes of role
    and text) and w (words).  Turns ascend, null first; equal turns by role,
    then text.  Rows without a conv_id are left out."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("c"), "turn", F.coalesce("role", F.lit("")).alias("r"),
                                F.coalesce("text", F.lit("")).alias("x")).where(F.col("c").isNotNull())
    rows = rows.select("*", F.xxhash64(F.lit(1), "r", "x").alias("t1"), F.xxhash64(F.lit(2), "x", "r").alias("t2"),
                       F.regexp_count("x", F.lit(WORD)).cast("long").alias("w"))
    return range_rank(rows, ["turn", "r", "x"], "i", "n", ["c"], without=("r", "x"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, rows): c and len of every rebuilt conversation; c, pos, t1,
    t2, w and len of its turns.  At most 39 conversations share a base."""
    h, base = family(F.col("c"))
    own = turns.where(F.col("i") == 0).select("c", "n", h.alias("h"), base.alias("base"))
    sizes = own.select(F.col("c").alias("bc"), F.col("n").alias("bn"))
    convs = own.join(sizes, F.col("base") == F.col("bc"), "left").withColumn("m", F.least("h", F.coalesce("bn", F.lit(0))))
    convs = materialise(convs.select("c", "h", "base", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")),
                        "trie-conversations")
    first = turns.where((F.col("i") < 3) & (F.col("c") % 20 == 0)).select(F.col("c").alias("base"), "i", "t1", "t2", "w")
    heads = convs.join(first, "base").where(F.col("i") < F.col("h")).select("c", F.col("i").alias("pos"), "t1", "t2", "w", "len")
    tails = turns.join(convs, "c").where(F.col("i") >= F.col("h")).select(
        "c", (F.col("m") + F.col("i") - F.col("h")).alias("pos"), "t1", "t2", "w", "len")
    return convs.select("c", "len"), heads.unionAll(tails)


def _running(rows: DataFrame, longest: int) -> DataFrame:
    """``rows`` (c, pos, u1, u2, ...) with k1, k2: u1 and u2 of all turns up to
    pos, by exclusive or.  Long conversations go in stretches of CHAIN turns,
    whose totals are carried on the same way."""
    stretch = F.expr(f"pos div {CHAIN}")
    w = Window.partitionBy("c", "s").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("s", stretch).withColumn("k1", F.bit_xor("u1").over(w)).withColumn("k2", F.bit_xor("u2").over(w))
    if longest > CHAIN:
        totals = rows.groupBy("c", stretch.alias("pos")).agg(F.bit_xor("u1").alias("u1"), F.bit_xor("u2").alias("u2"))
        carry = _running(totals, -(-longest // CHAIN)).select("c", (F.col("pos") + 1).alias("s"), F.col("k1").alias("x1"), F.col("k2").alias("x2"))
        out = out.join(carry, ["c", "s"], "left")
        out = out.withColumn("k1", F.col("k1").bitwiseXOR(F.coalesce("x1", F.lit(0)))).withColumn(
            "k2", F.col("k2").bitwiseXOR(F.coalesce("x2", F.lit(0)))).drop("x1", "x2")
    return out.drop("s")


def prefix_members(convs: DataFrame, rows: DataFrame, chain: int | None = None) -> DataFrame:
    """One row per (conversation, depth from 1): the node's key k1, k2, its
    parent's p1, p2, words of its last text, and the conversation's len."""
    longest = convs.agg(F.max("len")).first()[0] or 0
    u = rows.select("c", "pos", "w", "len", F.xxhash64(F.lit(3), "pos", "t1", "t2").alias("u1"),
                    F.xxhash64(F.lit(4), "pos", "t2", "t1").alias("u2"))
    keyed = _running(u, longest)
    return materialise(keyed.select(
        "c", (F.col("pos") + 1).cast("long").alias("d"), "k1", "k2", F.col("k1").bitwiseXOR(F.col("u1")).alias("p1"),
        F.col("k2").bitwiseXOR(F.col("u2")).alias("p2"), "w", "len"), "trie-members")


def trie_nodes(convs: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node: c (smallest member), d, key, pc (its parent's smallest
    member), n_convs, w, ends, end_c (its last member that ends here) and
    weight (turns of its members from here on, itself included)."""
    ends = F.col("d") == F.col("len")
    nodes = members.groupBy("d", "k1", "k2").agg(
        F.min("c").alias("c"), F.count(F.lit(1)).alias("n_convs"), F.first("p1").alias("p1"), F.first("p2").alias("p2"),
        F.first("w").alias("w"), F.count(F.when(ends, 1)).alias("ends"), F.max(F.when(ends, F.col("c"))).alias("end_c"),
        F.sum(F.col("len") - F.col("d") + 1).alias("weight"))
    zero = F.lit(0).cast("long")
    none = F.col("len") == 0
    root = convs.groupBy().agg(
        F.min("c").alias("c"), F.count(F.lit(1)).alias("n_convs"), F.count(F.when(none, 1)).alias("ends"),
        F.max(F.when(none, F.col("c"))).alias("end_c"), F.sum(F.col("len") + 1).alias("weight")).where(F.col("n_convs") > 0)
    root = root.select(zero.alias("d"), zero.alias("k1"), zero.alias("k2"), "*", F.lit(None).cast("long").alias("p1"),
                       F.lit(None).cast("long").alias("p2"), zero.alias("w"))
    nodes = materialise(nodes.unionByName(root), "trie-keys")
    up = nodes.select((F.col("d") + 1).alias("cd"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("c").alias("pc"))
    tree = nodes.join(up, (F.col("d") == F.col("cd")) & (F.col("p1") == F.col("q1")) & (F.col("p2") == F.col("q2")), "left")
    return materialise(tree.select("c", "d", "k1", "k2", "pc", "n_convs", "w", "ends", "end_c", "weight"), "trie-nodes")


# -- time-forward processing --

class SpillingQueue:
    """A priority queue of messages: four integers, least first by the first
    two.  Beyond ``limit`` messages, those in memory are written as a sorted run
    to a temporary file and read back in small blocks."""

    BLOCK = 4096

    def __init__(self, limit: int = QUEUE):
        self.limit, self.heap, self.runs, self.spills = limit, [], [], 0

    def push(self, message: tuple[int, int, int, int]) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            file = tempfile.TemporaryFile()
            np.array(sorted(self.heap), np.int64).tofile(file)
            file.seek(0)
            self.heap, self.spills = [], self.spills + 1
            self._next(self.spills, file)

    def _next(self, number: int, file) -> None:
        block = np.fromfile(file, np.int64, 4 * self.BLOCK).reshape(-1, 4).tolist()
        if block:
            heapq.heappush(self.runs, (block[0], number, 0, block, file))
        else:
            file.close()

    def take(self, a: int, b: int):
        """All messages to (a, b), which is not after any message's address."""
        while self.heap and self.heap[0][0] == a and self.heap[0][1] == b:
            yield heapq.heappop(self.heap)
        while self.runs and self.runs[0][0][0] == a and self.runs[0][0][1] == b:
            head, number, i, block, file = heapq.heappop(self.runs)
            yield head
            if i + 1 < len(block):
                heapq.heappush(self.runs, (block[i + 1], number, i + 1, block, file))
            else:
                self._next(number, file)

    def close(self) -> None:
        for run in self.runs:
            run[-1].close()


def time_forward(count_children: bool, limit: int):
    """A function of Arrow batches with c, lvl, pc, plvl, top, children, leaves
    and saved first, sorted by falling lvl and then c, which adds to each node what
    its children in the shard sent and sends its totals to (pc, plvl) unless it
    is a top.  With ``count_children`` messages count as children, and a node
    without any is a leaf."""

    def run(batches):
        queue = SpillingQueue(limit)
        try:
            for batch in batches:
                cols = [batch.column(k).to_pylist() for k in range(8)]
                out = ([], [], [])
                for c, lvl, pc, plvl, top, children, leaves, saved in zip(*cols):
                    for _, _, more_leaves, more_saved in queue.take(-lvl, c):
                        children += count_children
                        leaves += more_leaves
                        saved += more_saved
                    if count_children and children == 0:
                        leaves = 1
                    if not top:
                        queue.push((-plvl, pc, leaves, saved))
                    for k, v in enumerate((children, leaves, saved)):
                        out[k].append(v)
                for k in range(3):
                    at = batch.schema.get_field_index(("children", "leaves", "saved")[k])
                    batch = batch.set_column(at, batch.schema.field(at), pa.array(out[k], pa.int64()))
                yield batch
        finally:
            queue.close()

    return run


_STATE = ["c", "lvl", "pc", "plvl", "top", "children", "leaves", "saved"]


def _forward(df: DataFrame, shard: Column | None, parts: int, count_children: bool, limit: int) -> DataFrame:
    """Run ``time_forward`` on ``df``, dealt by ``shard`` (None: the one shard of shard roots)."""
    extra = [c for c in df.columns if c not in _STATE]
    dealt = df.coalesce(1) if shard is None else df.repartition(parts, shard)
    rows = dealt.select(*[F.col(c).cast("boolean" if c == "top" else "long") for c in _STATE], *extra)
    return rows.sortWithinPartitions(F.col("lvl").desc(), "c").mapInArrow(time_forward(count_children, limit), rows.schema)


def subtree_totals(tree: DataFrame, members: DataFrame, shard_rows: int, limit: int = QUEUE) -> DataFrame:
    """``tree`` with children, leaves and saved: the number of children, and the
    sums over the whole subtree."""
    spark = tree.sparkSession
    rows = tree.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // max(shard_rows, 1_000_000)))
    zero = F.lit(0).cast("long")
    own = ((F.col("n_convs") - 1) * F.col("w")).alias("saved")
    base = tree.select("*", F.col("d").alias("lvl"), (F.col("d") - 1).alias("plvl"), own)
    heavy_keys = tree.where(F.col("weight") > shard_rows).select("d", "k1", "k2")

    # light nodes: a conversation's path leaves the heavy nodes once, into the shard of the node it gets to
    light_rows = members.join(heavy_keys, ["d", "k1", "k2"], "left_anti")
    shard = light_rows.groupBy(F.col("c").alias("sc")).agg(F.min(F.struct("d", "k1", "k2")).alias("shard"))
    light = base.where((F.col("weight") <= shard_rows) & (F.col("d") > 0)).join(shard, F.col("c") == F.col("sc"))
    whole = base.where((F.col("weight") <= shard_rows) & (F.col("d") == 0))  # the root, of a trie that is one shard
    light = light.drop("sc").withColumn("top", F.col("d") == F.col("shard.d"))
    light = light.withColumn("children", zero).withColumn("leaves", zero)
    below = _forward(light, F.col("shard"), parts, True, limit).drop("shard")
    below = materialise(below, "trie-light")

    # nodes above the shards, with what the shard roots below them send
    sent = below.where("top").groupBy(F.col("pc").alias("tc"), F.col("plvl").alias("td")).agg(
        F.count(F.lit(1)).alias("s_children"), F.sum("leaves").alias("s_leaves"), F.sum("saved").alias("s_saved"))
    above = base.where(F.col("weight") > shard_rows).unionByName(whole)
    kids = above.where(F.col("d") > 0).groupBy(F.col("pc").alias("hc"), F.col("plvl").alias("hd")).agg(F.count(F.lit(1)).alias("h_children"))
    above = above.join(sent, (F.col("c") == F.col("tc")) & (F.col("d") == F.col("td")), "left").join(
        kids, (F.col("c") == F.col("hc")) & (F.col("d") == F.col("hd")), "left")
    children = F.coalesce("s_children", zero) + F.coalesce("h_children", zero)
    above = above.withColumn("children", children).withColumn(
        "leaves", F.coalesce("s_leaves", zero) + F.when(children == 0, 1).otherwise(0)).withColumn(
        "saved", F.col("saved") + F.coalesce("s_saved", zero))
    above = above.withColumn("piece", F.expr(f"d div {shard_rows}")).drop("tc", "td", "hc", "hd", "s_children", "s_leaves", "s_saved", "h_children")
    above = materialise(above, "trie-heavy")

    # across the shard roots: a piece is named by its path and highest level, its parent by the node it hangs from
    pieces = above.groupBy("c", "piece").agg(
        F.min("d").alias("lvl"), F.min_by("pc", "d").alias("hangs"), F.sum("children").alias("children"),
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    names = pieces.select(F.col("c").alias("hangs"), F.col("piece").alias("above"), F.col("lvl").alias("plvl"))
    pieces = pieces.withColumn("above", F.expr(f"(lvl - 1) div {shard_rows}")).join(names, ["hangs", "above"], "left")
    pieces = pieces.select("c", "lvl", F.col("hangs").alias("pc"), "plvl", F.col("hangs").isNull().alias("top"), "children", "leaves", "saved")
    done = materialise(_forward(pieces, None, 1, False, limit), "trie-pieces")
    passed = done.where(~F.col("top")).groupBy(F.col("pc").alias("tc"), (F.col("lvl") - 1).alias("td")).agg(
        F.sum("leaves").alias("s_leaves"), F.sum("saved").alias("s_saved"))
    above = above.join(passed, (F.col("c") == F.col("tc")) & (F.col("d") == F.col("td")), "left")
    above = above.withColumn("leaves", F.col("leaves") + F.coalesce("s_leaves", zero)).withColumn(
        "saved", F.col("saved") + F.coalesce("s_saved", zero))
    # inside a piece a node's parent is the one before it on the path
    highest = above.groupBy(F.col("c").alias("oc"), F.col("piece").alias("op")).agg(F.min("d").alias("first"))
    above = above.join(highest, (F.col("c") == F.col("oc")) & (F.col("piece") == F.col("op"))).withColumn("top", F.col("d") == F.col("first"))
    above = above.drop("tc", "td", "s_leaves", "s_saved", "oc", "op", "first")
    above = _forward(above, F.struct("c", "piece"), parts, False, limit).drop("piece")
    return below.unionByName(above).drop("lvl", "plvl", "top")


# -- lists of members --

def _id_digests(rows: DataFrame) -> DataFrame:
    """d, k1, k2 and the SHA-256 of the ids of each node, ascending and
    comma-joined.  Ids are sorted by ranges, so a node with a third of them is
    sorted by many tasks; each makes chunks of its ids as text.  A hash is a
    chain over its input, so one task reads the chunks of a node, as a stream."""
    placed = range_sorted(rows, ["d", "k1", "k2", "c"])
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",")
    chunks = placed.groupBy("d", "k1", "k2", F.col("__rk_slice").alias("s"), F.expr(f"__rk_at div {IDS}").alias("b")).agg(ids.alias("ids"))

    def run(batches):
        key, sha = None, None
        for batch in batches:
            out = []
            names = zip(*[batch.column(k).to_pylist() for k in range(3)])
            for name, text in zip(names, batch.column(5)):
                if name != key:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = name, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(text.as_py().encode())
            yield _digest_rows(out)
        if key is not None:
            yield _digest_rows([(*key, sha.hexdigest())])

    dealt = chunks.repartition("d", "k1", "k2").sortWithinPartitions("d", "k1", "k2", "s", "b").select("d", "k1", "k2", "s", "b", "ids")
    return dealt.mapInArrow(run, "d long, k1 long, k2 long, ids_sha256 string")


def _digest_rows(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[], [], [], []]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["d", "k1", "k2", "ids_sha256"])


def conversation_trie(conversations: DataFrame, shard_rows: int | None = None, limit: int = QUEUE) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (its
    smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.

    ``conversations``: conv_id, turn, role, text; other columns are left out.  A
    null role or text is empty; a null turn comes first; equal turns go by role
    and text, and a repeated row is one more turn.  Rows without a conv_id belong to
    no conversation.  Without conversations there is no root and no row.
    ``shard_rows``: the turns that a shard may have; by default an eighth of
    a partition's share, between 1,000 and a million.
    """
    turns = numbered_turns(conversations)
    convs, rows = rebuilt(turns)
    members = prefix_members(convs, rows)
    tree = trie_nodes(convs, members)
    if shard_rows is None:
        parts = int(tree.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        shard_rows = min(1_000_000, max(1_000, members.count() // (8 * parts)))
    totals = subtree_totals(tree, members, shard_rows, limit)
    zero = F.lit(0).cast("long")
    last = members.where(F.col("d") == F.col("len")).select("d", "k1", "k2", "c").unionAll(
        convs.where(F.col("len") == 0).select(zero, zero, zero, "c"))
    several = tree.where(F.col("ends") > 1).select("d", "k1", "k2")
    digests = _id_digests(last.join(several, ["d", "k1", "k2"], "left_semi"))
    out = totals.join(digests, ["d", "k1", "k2"], "left")
    one = F.sha2(F.coalesce(F.col("end_c").cast("string"), F.lit("")), 256)
    return out.select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("pc").alias("parent_conv_id"), "n_convs",
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ids_sha256", one).alias("ends_sha256"))


SQL = rf"""
WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
           FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, count(*) AS n, {sql_crc32('CAST(c AS VARCHAR)')} % 4 AS h, c - c % 20 AS base FROM o GROUP BY c),
v AS (SELECT k.*, least(k.h, coalesce(b.n, 0)) AS m FROM k LEFT JOIN k b ON b.c = k.base),
t AS (SELECT v.c, o.i AS pos, md5(r) || md5(x) AS id, len(regexp_extract_all(x, '{WORD}')) AS w FROM v JOIN o ON o.c = v.base AND o.i < v.h
      UNION ALL
      SELECT v.c, m + i - h, md5(r) || md5(x), len(regexp_extract_all(x, '{WORD}')) FROM v JOIN o ON o.c = v.c AND o.i >= v.h),
a AS (SELECT v.c, coalesce(s.ids, []) AS ids, coalesce(s.ws, []) AS ws
      FROM v LEFT JOIN (SELECT c, list(id ORDER BY pos) AS ids, list(w ORDER BY pos) AS ws FROM t GROUP BY c) s USING (c)),
p AS (SELECT c, len(ids) AS n, d, md5(array_to_string(ids[1:d], '')) AS key, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w
      FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS d FROM a)),
nd AS (SELECT d, key, min(c) AS rep, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS saved,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256 FROM p GROUP BY d, key),
mem AS (SELECT p.c, p.d, nd.rep FROM p JOIN nd USING (d, key)),
tree AS (SELECT nd.*, up.rep AS parent FROM nd LEFT JOIN mem up ON up.c = nd.rep AND up.d = nd.d - 1),
kids AS (SELECT parent AS rep, d - 1 AS d, count(*) AS n_children FROM tree WHERE d > 0 GROUP BY ALL),
full_tree AS (SELECT tree.*, coalesce(n_children, 0) AS n_children FROM tree LEFT JOIN kids USING (rep, d)),
sub AS (SELECT anc.rep, anc.d, sum(x.saved) AS saved_tokens, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves
        FROM full_tree x JOIN mem anc ON anc.c = x.rep AND anc.d <= x.d GROUP BY ALL)
SELECT rep AS conv_id, d AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves,
       saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM full_tree JOIN sub USING (rep, d)
"""
