import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import trees


def nodes(spark, rows):
    return spark.createDataFrame(rows, "id long, parent long, name string")


def test_any_depth_and_many_children(spark):
    r = random.Random(4)
    rows = [(0, None, "r")] + [(i, i - 1, f"n{i}" if i % 3 else None) for i in range(1, 70)]  # a path of 70 nodes
    rows += [(i, r.choice([0, 0, 0, r.randrange(70)]), f"c{i}") for i in range(100, 400)] + [(500, 499, "orphan"), (501, None, None)]
    name, up = {i: n for i, _, n in rows}, {i: p for i, p, _ in rows}
    want = {}
    for i in name:
        path, at = [], i
        while at is not None and at in name:
            path.append(at)
            at = up[at]
        want[i] = (len(path) - 1, " > ".join(name[k] for k in reversed(path) if name[k] is not None))
    got = {x.id: (x.depth, x.inherited or "") for x in trees.propagate(nodes(spark, rows).repartition(3), "id", "parent", F.col("name")).collect()}
    assert got == want


def test_empty_and_circles(spark):
    assert trees.propagate(nodes(spark, []), "id", "parent", F.col("name")).count() == 0
    with pytest.raises(ValueError, match="circle"):
        trees.propagate(nodes(spark, [(1, 2, "a"), (2, 1, "b")]), "id", "parent", F.col("name"), most=2)
