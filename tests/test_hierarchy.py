import random

import pytest
from pyspark.sql import functions as F

from quirestack.operators.hierarchy import descendants, hierarchy, tree_paths

SCHEMA = "sc string, node string, par string, kids array<string>, seen int, node_id string"


def brute(rows):
    nodes = {}
    for sc, node, par, kids, seen, _ in rows:
        if node is not None:
            nodes.setdefault(sc, {})[node] = (par, kids)
    out = {}
    for sc, own in nodes.items():
        up = {}
        for n, (par, _) in own.items():
            by = [m for m, (_, kids) in own.items() if kids and n in kids]
            up[n] = par if par in own else min(by) if by else None
        for n in own:
            seen, x = [], n
            while x is not None and x not in seen:
                seen.append(x)
                x = up[x]
            out[sc, n] = (seen[-1], len(seen) - 1) if x is None else (min(seen[seen.index(x):]), -1)
    return out


def rows_of(seed, n, scopes, chain=0.5):
    r = random.Random(seed)
    rows = []
    for sc in scopes:
        ids = [f"n{i:03d}" for i in range(n)]
        for i, x in enumerate(ids):
            p = r.random()
            par = ids[max(0, i - 1)] if p < chain else r.choice(ids) if p < chain + 0.15 else None if p < chain + 0.3 else "gone" if p < chain + 0.35 else ids[r.randrange(i + 1)]
            kids = r.sample(ids, 2) if r.random() < 0.2 else None
            rows.append((sc, x, par, kids, 1, "clash"))
    return rows


@pytest.mark.parametrize("limit,seed", [(1000, 1), (7, 1), (7, 2), (3, 3), (25, 4)])
def test_roots_and_depths(spark, limit, seed):
    rows = rows_of(seed, 40, ["a", "b", None])
    rows += rows[:30]  # repeated rows
    rows += [("c", "only", "only", [], 1, None), (None, None, "x", None, 1, None), ("d", "x1", None, [None, "x1"], 1, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = hierarchy(df, ["sc"], "node", "par", "kids", latest="seen", limit=limit)
    found = {(r.sc, r.node_id): (r.root_id, r.node_depth) for r in got.collect()}
    assert got.count() == len(found)
    assert found == brute(rows)


@pytest.mark.parametrize("period", [1, 2, 3, 4, 8])
def test_cycles_across_parts(spark, period):
    rows = [("s", f"c{i}", f"c{(i + 1) % period}", None, 1, "") for i in range(period)]
    rows += [("s", f"t{i:02d}", "c0" if i == 0 else f"t{i - 1:02d}", None, 1, "") for i in range(12)]
    rows += [("s", f"r{i}", f"r{i - 1}" if i else None, None, 1, "") for i in range(9)]
    got = {(r.sc, r.node_id): (r.root_id, r.node_depth) for r in hierarchy(spark.createDataFrame(rows, SCHEMA), ["sc"], "node", "par", limit=2).collect()}
    assert got == brute(rows)


def test_paths_and_descendants(spark):
    rows = [("s", "a", None, None, 1, ""), ("s", "b", "a", None, 1, ""), ("s", "c", "b", None, 1, ""), ("s", "d", "a", None, 1, ""), ("s", "x", "x", None, 1, ""), (None, "a", None, None, 1, "")]
    paths = tree_paths(hierarchy(spark.createDataFrame(rows, SCHEMA), ["sc"], "node", "par"), ["sc"])
    got = {(r.sc, r.node_id): r.node_path for r in paths.collect()}
    assert got == {("s", "a"): ["a"], ("s", "b"): ["a", "b"], ("s", "c"): ["a", "b", "c"], ("s", "d"): ["a", "d"], ("s", "x"): None, (None, "a"): ["a"]}
    below = {(r.node_id, r.descendant_id, r.distance) for r in descendants(paths, ["sc"]).collect()}
    assert below == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 1)}


@pytest.mark.parametrize("limit", [1000, 6])
def test_paths_go_down_the_links(spark, limit):
    rows = rows_of(5, 60, ["a", "b", None])
    trees = hierarchy(spark.createDataFrame(rows, SCHEMA), ["sc"], "node", "par", "kids")
    paths = tree_paths(trees, ["sc"], limit=limit).collect()
    up = {(r.sc, r.node_id): r.link_parent for r in trees.collect()}
    assert len(paths) == len(up)
    for r in paths:
        if r.node_depth < 0:
            assert r.node_path is None
            continue
        want = [r.node_id]
        while up[r.sc, want[0]] is not None:
            want.insert(0, up[r.sc, want[0]])
        assert r.node_path == want and want[0] == r.root_id


def test_deep_chain(spark):
    """A chain of 200,000 links, and the paths of one of 2,000."""
    df = spark.range(200_001).select(F.lit("s").alias("sc"), F.col("id").cast("string").alias("node"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("par"))
    assert hierarchy(df, ["sc"], "node", "par").agg(F.max("node_depth")).first()[0] == 200_000
    paths = tree_paths(hierarchy(df.where("id <= 2000"), ["sc"], "node", "par"), ["sc"])
    assert paths.agg(F.max(F.size("node_path")), F.sum(F.size("node_path"))).first()[:] == (2001, 2001 * 2002 // 2)


def test_long_chain(spark):
    df = spark.range(3000).select(F.lit("s").alias("sc"), F.col("id").cast("string").alias("node"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("par"))
    assert hierarchy(df, ["sc"], "node", "par").agg(F.max("node_depth")).first()[0] == 2999


def test_empty(spark):
    assert hierarchy(spark.createDataFrame([], SCHEMA), ["sc"], "node", "par", "kids").count() == 0
