"""Connected components: long chains under small batches, many levels, and against a plain search."""

import numpy as np
import pytest
from tallymill.llm.shared import batches_of, components


def found(spark, edges, *more):
    rows = components(spark.createDataFrame(edges, "src long, dst long").repartition(4), *more).collect()
    assert len(rows) == len({r["node"] for r in rows})
    return {r["node"]: r["component"] for r in rows}


@pytest.mark.parametrize("one_task", [0, 50, 200_000])
def test_a_long_chain(spark, one_task):
    keys = np.random.default_rng(5).permutation(10_000)[:3000].tolist()
    with batches_of(spark, 16):
        assert found(spark, list(zip(keys, keys[1:])), one_task) == dict.fromkeys(keys, min(keys))


def test_an_ordered_chain(spark):
    with batches_of(spark, 1):
        assert found(spark, [(i, i + 1) for i in range(600)], 0) == dict.fromkeys(range(601), 0)


@pytest.mark.parametrize("one_task", [0, 200_000])
def test_many_components_by_a_plain_search(spark, one_task):
    rng = np.random.default_rng(6)
    edges = [tuple(e) for e in rng.integers(0, 2000, (1100, 2)).tolist()] + [(7, 7), (5000, 5000), (None, 3)]
    near: dict[int, set[int]] = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want: dict[int, int] = {}
    for first in sorted(near):
        todo = [first]
        while todo:
            node = todo.pop()
            if node not in want:
                want[node] = first
                todo += near[node]
    with batches_of(spark, 16):
        assert found(spark, edges, one_task) == want


def test_no_edges(spark):
    assert found(spark, []) == {} and found(spark, [(1, 1)], 0) == {}
