"""Operator 13: Merkle manifest of a dataset by concatenated-level strings.

Every row is a leaf: the SHA-256 of its columns, each with its length before
it.  The leaves of a group, in order of the id, are the lowest level of a tree
in which every 16 consecutive nodes have one parent; the groups' roots form
one more such tree.

Plan: rows shrink to digests in the scan.  Range slices number the leaves of
each group, so a group with a third of all rows is numbered by many tasks.
Leaves then meet in aligned blocks of 16 * 16, and a block keeps a level as one
string of concatenated hex digests: a parent is the hash of a fixed-width
substring of 16 digests, and a node's siblings are what flanks it there.  The
roots of the blocks are the leaves of the next round, which is 256 times
smaller, until each group has one; then the groups' roots go the same way.
On the way back every block gets the path above it (a join of blocks, not of
rows), and rows come out of their block with the whole path: no row is joined
with its ancestors, and what a task holds is one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbench.llm.common import materialise
from textbench.operators.ranking import range_rank

FAN = 16
BLOCK = FAN * FAN
HEX = 64  # characters of a digest


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 of the columns one after the other: ``-`` for a null, else the
    number of UTF-8 bytes, ``:`` and the value (integers in decimal)."""
    parts = [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
             for s in (c.cast("string") for c in columns)]
    return F.sha2(F.concat(*parts), 256)


def _last_run(a: str) -> Column:
    """The number of the last run of 16 among ``a`` nodes."""
    return F.expr(f"({a} - 1) div {FAN}")


def _blocks(nodes: DataFrame, payload: list[str], tag: str) -> DataFrame:
    """``nodes``: g, i (0-based, without gaps), n (nodes of g), h and payload
    columns.  One row per aligned block: its levels ``l0`` and ``l1`` as
    strings, the entries' payload in order, and the digest of the node above."""
    entry = F.struct("i", "h", *payload)
    b = nodes.groupBy("g", F.expr(f"i div {BLOCK}").alias("b")).agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(entry)).alias("e"))  # at most 256 entries
    b = b.select("g", "b", "n", F.size("e").alias("cnt"),
                 F.array_join(F.transform("e", lambda x: x["h"]), "").alias("l0"),
                 F.transform("e", lambda x: F.struct(x["i"].alias("i"), *[x[c].alias(c) for c in payload])).alias("e"))
    b = b.withColumn("l1", F.array_join(F.transform(
        F.sequence(F.lit(0), _last_run("cnt")), lambda j: F.sha2(F.substring(F.col("l0"), j * (FAN * HEX) + 1, F.lit(FAN * HEX)), 256)), ""))
    top = F.when(F.col("n") == 1, F.col("l0")).when(F.col("n") <= FAN, F.sha2("l0", 256)).otherwise(F.sha2("l1", 256))
    return materialise(b.withColumn("digest", top), tag)


def _rounds(nodes: DataFrame, payload: list[str], tag: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every round, and (g, h): the root of each g."""
    rounds = [_blocks(nodes, payload, f"{tag}-0")]
    most = rounds[0].agg(F.max("n")).first()[0] or 1
    while most > BLOCK:  # each round is 256 times smaller
        up = rounds[-1].where(F.col("n") > BLOCK).select(
            "g", F.col("b").alias("i"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("digest").alias("h"))
        rounds.append(_blocks(up, [], f"{tag}-{len(rounds)}"))
        most = -(-most // BLOCK)
    roots = rounds[0].where(F.col("n") <= BLOCK)
    for r in rounds[1:]:
        roots = roots.unionByName(r.where(F.col("n") <= BLOCK), allowMissingColumns=True)
    return rounds, roots.select("g", F.col("digest").alias("h"))


def _side(level: str, place: Column, right: bool) -> Column:
    """What stands before (or after) a node in its run."""
    if right:
        return F.substring(F.col(level), place * HEX + HEX + 1, F.lit(FAN * HEX))
    return F.substring(F.col(level), F.lit(1), place * HEX)


def _unfold(blocks: DataFrame, above: DataFrame, keep: list[str]) -> DataFrame:
    """The entries of each block with their path: the siblings in the block,
    then ``path`` of ``above`` (g, b, path and ``keep``)."""
    runs = F.transform(F.sequence(F.lit(0), _last_run("cnt")), lambda r: F.struct(
        r.cast("int").alias("r"), F.substring(F.col("l0"), r * (FAN * HEX) + 1, F.lit(FAN * HEX)).alias("s"),
        F.slice("e", (r * FAN + 1).cast("int"), F.lit(FAN)).alias("e")))
    b = blocks.join(above, ["g", "b"]).select("g", "n", "l1", "path", *keep, F.explode(runs).alias("run"))
    b = b.select("g", "n", "l1", "path", *keep, "run.r", "run.s", F.posexplode("run.e").alias("q", "x"))
    first = F.struct(_side("s", F.col("q"), False).alias("l"), _side("s", F.col("q"), True).alias("r"))
    second = F.struct(_side("l1", F.col("r"), False).alias("l"), _side("l1", F.col("r"), True).alias("r"))
    none = F.expr("cast(array() as array<struct<l: string, r: string>>)")
    own = F.when(F.col("n") == 1, none).when(F.col("n") <= FAN, F.array(first)).otherwise(F.array(first, second))
    at = F.col("q") * HEX + 1
    return b.select("g", "x", F.substring(F.col("s"), at, F.lit(HEX)).alias("h"), F.concat(own, F.col("path")).alias("path"), *keep)


def _down(rounds: list[DataFrame], above: DataFrame, keep: list[str], tag: str) -> DataFrame:
    """Entries of the first round with whole paths; ``above``: g, path and
    ``keep`` of each g, for what lies beyond its root."""
    lower = None
    for k in range(len(rounds) - 1, -1, -1):
        blocks = rounds[k]
        done = blocks.where(F.col("n") <= BLOCK).select("g", "b").join(above, "g")
        here = done if lower is None else done.unionByName(lower)
        rows = _unfold(blocks, here, keep)
        if k == 0:
            return rows
        lower = materialise(rows.select("g", F.col("x.i").alias("b"), "path", *keep), f"{tag}-paths-{k}")


def merkle_manifest(docs: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "source",
                    claim: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, leaf, subroot (its group's
    root), root, ``path`` (array of the siblings before and after, level by
    level up to the root) and ``claim``: the digest to verify, by default the leaf.

    Groups ascend with nulls first, strings by their bytes; leaves ascend by the
    id, null ids first, rows of one id by their digests (equal rows are
    leaves of their own).  Null columns and empty texts have digests of their
    own.  A group of one row has its leaf as root; so has a table of one group
    whose root is that group's.  An empty table gives no rows.  Columns that
    are not asked for are left out.
    """
    leaf = leaf_digest(*[F.col(f"`{c}`") for c in columns])
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{group_col}`").alias("grp"), leaf.alias("leaf"),
                       (claim if claim is not None else F.lit(None).cast("string")).alias("claim"))
    rows = materialise(rows, "merkle-leaves")
    rows = range_rank(rows, ["grp", "id", "leaf"], "pos", stored=True)
    # a group's number is its first position; groups ascend with it
    groups = rows.groupBy(F.col("grp").alias("g_grp")).agg(F.min("pos").alias("g"), F.count(F.lit(1)).alias("n"))
    nodes = rows.join(groups, F.col("grp").eqNullSafe(F.col("g_grp"))).select(
        "g", (F.col("pos") - F.col("g")).alias("i"), "n", F.col("leaf").alias("h"), "id", "claim")
    rounds, subroots = _rounds(nodes, ["id", "claim"], "merkle")

    tops = range_rank(subroots.select(F.col("g").alias("grp"), F.col("h")), ["grp"], "i", "n")
    top_nodes = tops.select(F.lit(0).cast("long").alias("g"), "i", "n", "h", F.col("grp").alias("sub"))
    top_rounds, root = _rounds(top_nodes, ["sub"], "merkle-top")
    empty = F.expr("cast(array() as array<struct<l: string, r: string>>)")
    sub_paths = _down(top_rounds, root.select("g", F.col("h").alias("root"), empty.alias("path")), ["root"], "merkle-top")
    above = materialise(sub_paths.select(F.col("x.sub").alias("g"), F.col("h").alias("subroot"), "root", "path"), "merkle-subroots")
    out = _down(rounds, above, ["subroot", "root"], "merkle")
    return out.select(F.col("x.id").alias(id_col), F.col("h").alias("leaf"), "subroot", "root", "path",
                      F.coalesce(F.col("x.claim"), F.col("h")).alias("claim"))


def proof_digest(path: str = "path") -> Column:
    """SHA-256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def fold(claim: str = "claim", path: str = "path") -> Column:
    """The root that follows from a leaf's digest and its siblings."""
    return F.aggregate(path, F.col(claim), lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tamper_check(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents``, verified row by row after some rows were
    changed: where 5 divides the CRC-32 of the decimal doc_id, the text's A-Z are
    lower-cased (rows without an id are not changed)."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    altered = leaf_digest(*[F.col(c) for c in columns[:-1]], F.translate("text", UPPER, LOWER))
    m = merkle_manifest(docs, columns, claim=F.when(changed, altered))
    m = m.select("doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), fold().alias("folded_root"))
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))


# -- the same in DuckDB: levels unrolled (16^6 rows of a group, 16^4 groups) --

_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda ch: ord(ch)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"""


def sql_crc32(x: str) -> str:
    return _CRC.replace("{x}", x)


def _sql_levels(name: str, levels: int) -> str:
    """Nodes ``{name}l0`` (g, i, h, n) and climbers ``{name}p0`` (rid, g, pos, sib, fold) up to level ``levels``."""
    out = []
    for k in range(levels):
        l, r, p, nl, np_ = f"{name}l{k}", f"{name}r{k}", f"{name}p{k}", f"{name}l{k + 1}", f"{name}p{k + 1}"
        out.append(f"""
{r} AS (SELECT g, i // 16 AS j, string_agg(h, '' ORDER BY i) AS s FROM {l} WHERE n > 1 GROUP BY g, i // 16),
{nl} AS (SELECT g, j AS i, sha256(s) AS h, count(*) OVER (PARTITION BY g) AS n FROM {r}
         UNION ALL SELECT g, i, h, n FROM {l} WHERE n = 1),
{np_} AS (SELECT rid, p.g, pos // 16 AS pos,
            CASE WHEN s IS NULL THEN sib ELSE concat(sib, substr(s, 1, (pos % 16) * 64), substr(s, (pos % 16) * 64 + 65)) END AS sib,
            CASE WHEN s IS NULL THEN fold ELSE sha256(concat(substr(s, 1, (pos % 16) * 64), fold, substr(s, (pos % 16) * 64 + 65))) END AS fold
          FROM {p} p LEFT JOIN {r} r ON p.g = r.g AND p.pos // 16 = r.j)""")
    return ",".join(out)


def _sql_leaf(text: str) -> str:
    parts = ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(octet_length(encode(CAST({c} AS VARCHAR))), ':', {c}) END"
                      for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256(concat({parts}))"


SQL = f"""
WITH d0 AS (SELECT doc_id, source, {_sql_leaf('text')} AS leaf,
              CASE WHEN {sql_crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {_sql_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS claim FROM documents),
d AS (SELECT *, row_number() OVER () AS rid, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM d0),
ll0 AS (SELECT g, rid, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS i, leaf AS h,
          count(*) OVER (PARTITION BY g) AS n FROM d),
lp0 AS (SELECT d.rid, d.g, ll0.i AS pos, '' AS sib, coalesce(d.claim, d.leaf) AS fold FROM d JOIN ll0 USING (rid)),
{_sql_levels('l', 6)},
tl0 AS (SELECT 0 AS g, g AS i, h, count(*) OVER () AS n FROM ll6),
tp0 AS (SELECT rid, 0 AS g, g AS pos, sib, fold FROM lp6),
{_sql_levels('t', 4)}
SELECT d.doc_id, d.leaf, ll6.h AS subroot, tl4.h AS root, sha256(tp4.sib) AS proof_sha256, tp4.fold AS folded_root, tp4.fold = tl4.h AS verified
FROM d JOIN ll6 ON d.g = ll6.g JOIN tp4 ON d.rid = tp4.rid CROSS JOIN tl4
"""
