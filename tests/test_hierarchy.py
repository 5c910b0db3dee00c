import random

import pytest

from lodegraph.operators import hierarchy as H

LINKS = "id string, parent string, near string"


def brute(par):
    tree, ring = {}, {}
    for x in par:
        path, y, seen = [x], par[x], {x}
        while y is not None and y in par and y not in seen:
            path.append(y)
            seen.add(y)
            y = par[y]
        open_end = y is None or y not in par
        tree[x] = (path[-1], len(path) - 1, path[::-1]) if open_end else (None, None, None)
        if not open_end and y == x:
            ring[x] = min(path)
    return tree, ring


def forest(seed, n):
    r = random.Random(seed)
    return {f"n{i:03d}": None if r.random() < 0.1 else "gone" if r.random() < 0.05 else f"n{r.randrange(n) if r.random() < 0.12 else max(0, i - 1 - r.randrange(3)):03d}" for i in range(n)}


@pytest.mark.parametrize("seed, limit, fan", [(1, 10**6, 8), (2, 0, 8), (2, 4, 2), (5, 1, 2), (7, 12, 2)])
def test_random_forests(spark, seed, limit, fan):
    """In one task, in levels or by pointer doubling, merged partitions agree with a walk over every node."""
    par = forest(seed, 60)
    tree, ring = brute(par)
    links = spark.createDataFrame([(k, v, "f") for k, v in par.items()], LINKS)
    got = {x.id: x for x in H.hierarchy(links, None, limit, 5, fan).collect()}
    assert {k: (v.root, v.depth, v.path) for k, v in got.items()} == tree
    assert {k: v.cycle_id for k, v in got.items() if v.on_cycle} == ring
    assert {x.symbol_id: x.cycle_id for x in H.find_cycles(links, None, limit, 5, fan).collect()} == ring
    pairs = {(x.ancestor, x.descendant, x.distance) for x in H.descendants(H.hierarchy(links, None, limit, 5, fan)).collect()}
    assert pairs == {(a, k, d - i) for k, (_, d, p) in tree.items() if p for i, a in enumerate(p[:-1])}


def test_long_chain_and_hot_group(spark):
    """A deep chain in one locality group is split over partitions and still resolves."""
    n = 3000
    links = spark.createDataFrame([(f"c{i:05d}", f"c{i - 1:05d}" if i else None, "one") for i in range(n)], LINKS)
    got = H.hierarchy(links, "near", 10**6, 8)
    assert got.where("id = 'c02999'").first().depth == n - 1
    assert got.where("root = 'c00000'").count() == n


def test_links_of_dirty_rows(spark):
    rows = [("A ", " b", "f", 1, "x"), ("a", "\tB ", "f", 2, "x"), ("b", "", None, 1, None), (None, "a", "f", 3, "x"), (" ", "a", "f", 4, "x"), ("s", "S", "g", 1, "x"), ("a", "old", "f", 0, "x")]
    df = spark.createDataFrame(rows, "id string, parent string, file string, seq long, near string")
    links = H.parent_links(df)
    assert {(x.id, x.parent) for x in links.collect()} == {("a", "b"), ("b", None), ("s", "s")}
    assert [(x.cycle_id, x.symbol_id) for x in H.find_cycles(links).collect()] == [("s", "s")]


def test_empty(spark):
    empty = spark.createDataFrame([], LINKS)
    assert H.find_cycles(empty).count() == 0
    assert H.hierarchy(empty).count() == 0
