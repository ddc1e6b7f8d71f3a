import random

from helpers import components, similar_pairs
from pyspark.sql import functions as F
from textbench.llm.components import connected_components
from textbench.llm.groups import link_components
from textbench.llm.lines import verify_lines, with_bits


def _got(df):
    return {r["node"]: r["component"] for r in df.collect()}


def test_chain_star_ring_and_noise(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)]
    links += [(200, 201), (201, 202), (202, 200), (300, 300), (201, 200), (200, 201)]
    df = spark.createDataFrame(links + [(None, 5), (7, None)], "a long, b long")
    got = _got(connected_components(df))
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == components(nodes, [x for x in links if x[0] != x[1]])


def test_random_graph(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(330)]
    links = [x for x in links if x[0] != x[1]]
    got = _got(connected_components(spark.createDataFrame(links, "a long, b long")))
    assert got == components({n for x in links for n in x}, links)


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_larger_than_a_block_lose_no_link(spark):
    """One group of 90 lines in three families and loners, compared in blocks of 8."""
    rnd = random.Random(5)
    word = ["alpha", "bravo", "carbon", "delta", "ember", "fjord", "gamma", "harbor", "island", "jungle"]
    lines = []
    for family in range(3):
        base = " ".join(rnd.choice(word) + str(family) for _ in range(14))
        for _ in range(25):
            at = rnd.randrange(len(base))
            lines.append(base[:at] + rnd.choice("xyz") + base[at + 1:])
    lines += [" ".join(rnd.choice(word) + str(rnd.random())[2:5] for _ in range(14)) for _ in range(15)]
    rows = list(enumerate(lines))
    members = spark.createDataFrame([(i, 1, x) for i, x in rows], "id long, grp long, line string")
    got = _got(link_components(with_bits(members, 5), verify_lines(5, 80, 100), 8))
    sets = {i: {x[j:j + 5] for j in range(len(x) - 4)} for i, x in rows}
    want = components(sets, list(similar_pairs(sets)))
    assert {i: got.get(i, i) for i in sets} == want
    assert len(set(want.values())) < 40
