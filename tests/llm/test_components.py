"""Connected components against union-find."""

from __future__ import annotations

import random

from datalode.llm.components import components


def expected(links):
    parent = {x: x for link in links for x in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in parent}


def test_chain_star_and_random(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 130)]
    mixed = [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)]
    mixed = [(a, b) for a, b in mixed if a != b]
    links = chain + star + mixed
    rng.shuffle(links)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in got} == expected(links)
    assert len(got) == len(expected(links))


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
