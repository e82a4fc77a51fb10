import random

import pytest

from terralith.operators.components import connected_components


@pytest.mark.parametrize("limit", [0, 10**6])
def test_against_union_find(spark, limit):
    r = random.Random(4)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(6000, 6050)] + [(7, 7), (None, 3), (2, None)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(3), one_task_edges=limit).collect()}
    up = {}

    def root(x):
        up.setdefault(x, x)
        return x if up[x] == x else root(up[x])

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in up}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
