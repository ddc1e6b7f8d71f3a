import random

from helpers import char_shingles, components, similar_pairs
from textbench.llm import lines
from textbench.llm.lines import dedup_lines

SCHEMA = "doc_id long, text string, removed string, lid int, pos int, N_LINES string"


def _blank(line):
    return not line.strip(" \t\r\x0b\x0c")


def _want(docs, q=8):
    first, occ = {}, []
    for i, text in docs:
        for pos, line in enumerate((text or "").split("\n") if text is not None else []):
            if not _blank(line):
                occ.append((i, pos, line))
    names = sorted({x[2] for x in occ})
    sets = {n: char_shingles(line, q) for n, line in enumerate(names)}
    comp = components(sets, list(similar_pairs(sets)))
    of = {line: comp[n] for n, line in enumerate(names)}
    for i, pos, line in sorted(occ):
        first.setdefault(of[line], (i, pos))
    out = {}
    for i, text in docs:
        lines = [] if text is None else text.split("\n")
        real = [p for p, x in enumerate(lines) if not _blank(x)]
        gone = [p for p in real if first[of[lines[p]]] != (i, p)]
        kept = None if text is None else "\n".join(x for p, x in enumerate(lines) if p not in gone)
        out[i] = (len(real), len(real) - len(gone), gone, kept)
    return out


def _got(df):
    return {r["doc_id"]: (r["n_lines"], r["n_kept"], r["removed"], r["kept_text"]) for r in df.collect()}


def test_edges_and_fuzzy_lines(spark):
    rnd = random.Random(4)
    base = "the quick brown fox jumps over the lazy dog and runs along the river until the evening comes"
    docs = [(1, None), (2, ""), (3, "\n\n \t\n"), (4, "short\nshort\nshorter"), (5, "ab\nab\nabc"), (6, base + "\n" + base.upper())]
    for i in range(20):
        at = rnd.randrange(len(base))
        docs.append((10 + i, f"line of its own {i * 7919} {rnd.random()}\n" + base[:at] + "é" + base[at + 1:] + "\n\n漢字𝄞漢字"))
    docs.append((99, ("x" * 50_000) + "\n" + ("x" * 50_000)))
    df = spark.createDataFrame([(i, t, "r", 1, 2, "n") for i, t in docs], SCHEMA)
    got = dedup_lines(df)
    assert got.columns == ["doc_id", "text", "lid", "pos", "n_lines", "n_kept", "removed", "kept_text"]
    assert _got(got) == _want(docs)


def test_null_and_repeated_ids(spark):
    line = "a line that is long enough to count here"
    rows = [(None, line), (1, line), (1, line), (2, line + "\nother")]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_lines"], r["n_kept"], r["kept_text"]) for r in got) == [
        (0, 1, 0, ""), (1, 1, 1, line), (1, 1, 1, line), (2, 2, 1, "other")]


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_small_table_against_brute_force(spark):
    """Exact lines all go; fuzzy ones as brute force finds them, but for the
    stated miss of the bands at the very threshold."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = _want([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = _got(dedup_lines(docs))
    assert set(got) == set(want)
    wrong = [i for i in want if got[i] != want[i]]
    assert len(wrong) <= 0.01 * len(want)


def test_no_python_in_the_plan(spark):
    plan = dedup_lines(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_bit_tables_hold_every_shingle(spark):
    """The table put together from its parts is the one of all shingles."""
    rows = [(1, "a line of some length, with éß and 漢字"), (2, "short"), (3, "x" * 300)]
    df = spark.createDataFrame(rows, "id long, line string")
    got = {r["id"]: [r[f"b{j}"] for j in range(lines.WORDS)] for r in lines.with_bits(df, 8).collect()}
    for i, line in rows:
        units = line.encode("utf-16-be")
        parts = [(bytearray(units[2 * k:2 * k + 16]),) for k in range(max(1, len(units) // 2 - 7))]
        hashes = spark.createDataFrame(parts, "s binary").selectExpr("xxhash64(s) AS h").collect()
        want = [0] * lines.WORDS
        for (h,) in hashes:
            want[(h >> 6) & (lines.WORDS - 1)] |= 1 << (h & 63)
        assert [x & ((1 << 64) - 1) for x in got[i]] == want


def _large_group():
    """100 lines with one to four edits each of one line: all in one candidate
    group, few of them linked; sizes differ where words are put in."""
    rnd = random.Random(8)
    base = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200))
    out = []
    for n in range(100):
        line = base
        for _ in range(rnd.randrange(1, 5)):
            at = rnd.randrange(len(line))
            line = line[:at] + rnd.choice("ABCDEFGH") * rnd.choice((1, 1, 1, 30)) + line[at + 1:]
        out.append((n, line))
    return out


def _components_of(spark, rows):
    df = spark.createDataFrame(rows, "lid long, line string")
    return {r["node"]: r["component"] for r in lines.line_components(df).collect()}


def test_large_group_is_not_copied_block_by_block(spark, monkeypatch):
    """Lines that are apart meet the rest of a large group as narrow rows: the
    rows with text that are compared do not grow with the number of its blocks."""
    rows, seen = _large_group(), []
    verify_lines = lines.verify_lines

    def counting(*args):
        verify = verify_lines(*args)

        def counted(df, asked=None):
            seen.append(df.count() + (0 if asked is None else asked.count()))
            return verify(df) if asked is None else verify(df, asked)
        return counted

    monkeypatch.setattr(lines, "verify_lines", counting)
    monkeypatch.setattr(lines, "BLOCK_ROWS", 8)
    got = _components_of(spark, rows)
    sets = {i: char_shingles(line, 8) for i, line in rows}
    want = components(sets, list(similar_pairs(sets)))
    assert {i: got.get(i, i) for i in sets} == want
    assert 10 < len(set(want.values())) < 90
    assert sum(seen) <= 10 * len(rows)


def test_pairs_by_size_class_and_slot_lose_no_link(spark, monkeypatch):
    """What the keys do not find, the narrow rows do, in slots of any size."""
    from textbench.llm import groups

    rows = _large_group()
    monkeypatch.setattr(lines, "BLOCK_ROWS", 8)
    monkeypatch.setattr(groups, "KEY_ROWS", 1)
    monkeypatch.setattr(groups, "REPS", 0)
    monkeypatch.setattr(groups, "PAIR_ROWS", 7)
    got = _components_of(spark, rows)
    sets = {i: char_shingles(line, 8) for i, line in rows}
    assert {i: got.get(i, i) for i in sets} == components(sets, list(similar_pairs(sets)))
