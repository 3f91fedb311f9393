import random

import pytest

from lamella.llm.common import components


@pytest.mark.parametrize("one_task", [1_000_000, 0])
def test_components(spark, one_task):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        todo = [start] if start not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task).collect()}
    assert got == {k: v for k, v in want.items() if near[k] != {k}}
    assert not components(spark.createDataFrame([], "a long, b long"), one_task=one_task).collect()
