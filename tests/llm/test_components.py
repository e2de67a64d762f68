import random

import pytest

from flowquarry.llm.components import connected_components
from tests.llm import rows as R


@pytest.mark.parametrize("links", [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(5, 5)], [(None, 1), (2, None)]])
def test_shapes(spark, links):
    check(spark, links)


def test_random_links(spark):
    rng = random.Random(3)
    check(spark, [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] * 2)


def check(spark, links):
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    clean = {frozenset(p) for p in links if None not in p and p[0] != p[1]}
    nodes = {n for p in clean for n in p}
    assert found == R.components(nodes, lambda a, b: frozenset((a, b)) in clean)


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
