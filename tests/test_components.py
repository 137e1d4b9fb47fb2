"""Components by one task and by rounds against a plain union of sets."""
import numpy as np
import pytest

from canopyframe.operators.components import components, labels


def plain(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return sorted((x, find(x)) for x in up)


def graphs():
    rng = np.random.default_rng(5)
    yield [(i, i + 1) for i in range(60)] + [(100, 101)]  # a path
    yield [(7, i) for i in range(8, 90)] + [(500, i) for i in range(400, 460)]  # hubs
    yield [tuple(map(int, e)) for e in rng.integers(-50, 50, (60, 2))]
    yield [(5, 5)]


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_components(spark, most):
    for edges in graphs():
        df = spark.createDataFrame(edges, "a long, b long").repartition(3)
        assert sorted(map(tuple, components(df, task_edges=most).collect())) == plain(edges)


def test_labels_of_long_paths():
    n = 5000
    p = np.random.default_rng(1).permutation(n)
    node, comp = labels(p[:-1], p[1:])
    assert (comp == 0).all() and len(node) == n
