"""Connected components against union-find."""

import random

from polysafe.llm.components import EDGES, components


def brute(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


def test_random_graphs_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    edges += [(k, k + 1) for k in range(1000, 1060)]
    edges += [(2000, k) for k in range(2001, 2200)] + [(5, 5), (7000, 7000), (1, 2), (2, 1)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == brute(edges)


def test_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert components(spark.createDataFrame([(4, 4)], "a long, b long")).collect() == []


def test_small_graphs_take_few_partitions(spark):
    """Files of a round follow its edges, not the shuffle partitions; a larger graph is still spread."""
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        small = components(spark.createDataFrame([(k, k + 1) for k in range(0, 60, 2)], "a long, b long"))
        assert small.rdd.getNumPartitions() == 1
        assert {(r.node, r.component) for r in small.collect()} == {(n, n - n % 2) for n in range(60)}
        large = components(spark.range(0, 6 * EDGES, 2).selectExpr("id AS a", "id + 1 AS b"))
        assert large.rdd.getNumPartitions() == 3
        assert large.where("component <> node - node % 2").isEmpty() and large.count() == 6 * EDGES
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
