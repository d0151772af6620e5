"""Parent links to roots, depths, cycles, paths and descendants.

Links are combined in weighted disjoint-set forests: every node holds the top of its part and its offset (number of
links) to it.  Forests are first built within a partition; a scope too large for one is spread over several, and its
forests are merged in rounds of distributed joins, each of which doubles the height that is settled.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirestack.session import cut

#: Nodes of one scope that a single task may hold; larger scopes are spread over several tasks.
SCOPE_LIMIT = 200_000
BATCH_NODES = 50_000
#: Entries of paths that are put together at a time.
PATH_ENTRIES = 1_000_000


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], target: int) -> Iterator[pa.Table]:
    """Tables of whole groups, of at least ``target`` rows but the last, from batches sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < target:
            continue
        t = pa.Table.from_batches(held)
        changed = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            v = t.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            changed |= v[1:] != v[:-1]
        at = np.flatnonzero(changed)
        if len(at):
            yield t.slice(0, at[-1] + 1)
            t = t.slice(at[-1] + 1)
        held, rows = t.to_batches(), t.num_rows
    if rows:
        yield pa.Table.from_batches(held)


def forest(parent: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weighted forest over ``parent`` (index of the parent, -1 for none), with full path compression.

    Gives ``top`` (index of the root; for a node that leads into a cycle some node on it), ``offset`` (links up to the
    root), ``cyclic``, and ``low``: the smallest ``rank`` on the way to the root, or on the cycle that is reached.
    """
    n = len(parent)
    top = np.where(parent >= 0, parent, np.arange(n))
    offset = (parent >= 0).astype(np.int64)
    low = np.minimum(rank, rank[top])
    live = np.flatnonzero(parent >= 0)
    for _ in range(max(1, n).bit_length() + 1):
        if not len(live):
            break
        mid = top[live]
        far, reach = top[mid], low[mid]
        offset[live] += offset[mid]
        low[live] = np.minimum(low[live], reach)
        top[live] = far
        live = live[parent[far] >= 0]
    cyclic = parent[top] >= 0
    # after at least n steps the ends of cyclic nodes are the nodes on cycles, and have seen the whole cycle
    return top, offset, cyclic, np.where(cyclic, low[top], low)


def _lookup(scope: np.ndarray, node: np.ndarray, wanted: np.ndarray, has: np.ndarray) -> np.ndarray:
    """Index of the node that ``wanted`` names within the same scope, -1 for none."""
    many = int(max(node.max(initial=0), wanted.max(initial=0))) + 1
    out = np.full(len(node), -1)
    at = np.flatnonzero(has)
    out[at] = pd.Index(scope * many + node).get_indexer(scope[at] * many + wanted[at])
    return out


def _ranked(columns: list[pa.Array]) -> tuple[list[np.ndarray], pa.Array]:
    """Codes of the strings in order of their bytes, -1 for null, and the strings by code."""
    coded = pa.chunked_array([c.cast(pa.string()) for c in columns]).combine_chunks().dictionary_encode()
    words = coded.dictionary
    order = pc.sort_indices(words).to_numpy()
    rank = np.empty(len(words) + 1, np.int64)
    rank[order] = np.arange(len(words))
    rank[-1] = -1
    codes = rank[coded.indices.fill_null(len(words)).to_numpy()]
    return np.split(codes, np.cumsum([len(c) for c in columns])[:-1]), words.take(pa.array(order))


def _local(t: pa.Table) -> pa.Table:
    """Forests of one table of whole parts; links that leave the part stay open in ``_up`` and ``_up2``."""
    part = t.column("_part").to_numpy().astype(np.int64)
    scope = t.column("_scope").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    names = t.column("_node").combine_chunks()
    (node, a, b), words = _ranked([names, t.column("_parent").combine_chunks(), t.column("_other").combine_chunks()])
    group = scope * (int(part.max()) + 1) + part
    split = t.column("_split").to_numpy()
    parent = _lookup(group, node, a, a >= 0)
    # in a spread scope a first choice that is not here may be elsewhere, so the second has to wait
    second = _lookup(group, node, b, (b >= 0) & (parent < 0) & ~(split & (a >= 0)))
    parent = np.where(parent >= 0, parent, second)
    away = split & (parent < 0) & ((a >= 0) | (b >= 0))
    top, offset, cyclic, low = forest(parent, node)
    left = away[top] & ~cyclic
    text = lambda code, has: words.take(pa.array(code, mask=~has))
    yes = np.ones(len(node), bool)
    cols = [t.column("_scope").combine_chunks(), names, text(node[parent], parent >= 0), text(np.where(cyclic, low, node[top]), yes), pa.array(np.where(cyclic, -1, offset).astype(np.int32)), pa.array(left), text(a[top], left & (a[top] >= 0)), text(b[top], left & (b[top] >= 0)), text(low, yes)]
    return pa.table(cols, names=["_scope", "_node", "_link", "_root", "_depth", "_open", "_up", "_up2", "_low"])


LOCAL_SCHEMA = "_scope string, _node string, _link string, _root string, _depth int, _open boolean, _up string, _up2 string, _low string"


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, ["_scope", "_part"], BATCH_NODES):
        yield from _local(t).to_batches()


def hierarchy(df: DataFrame, scope: list[str], node: str, parent: str, children: str | None = None, latest: str | None = None, limit: int = SCOPE_LIMIT) -> DataFrame:
    """Root, depth and effective parent of each node of each tree scope.

    ``parent`` names a node of the same scope; where it names none, the smallest node that lists the node in the array
    ``children`` (if given) is the parent.  A node without a parent is a root of depth 0.  A node on a cycle, or that
    leads into one, has depth -1 and as root the smallest node of that cycle; a node that is its own parent is a cycle.

    A node given several times counts once: the row with the largest ``latest``, ties by the largest links.  Rows whose
    node is null are left out; null scope columns are values of their own.  Columns: ``scope``, ``node_id``,
    ``link_parent``, ``root_id``, ``node_depth``.  ``limit`` is the number of nodes of a scope that one task may hold.
    """
    key = F.concat_ws("", *(F.concat(F.coalesce(F.length(F.col(c).cast("string")).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in scope)) if scope else F.lit("")
    order = F.struct(*([F.col(latest)] if latest else []), F.col(parent), *([F.col(children)] if children else []))
    nodes = df.where(F.col(node).isNotNull()).groupBy(*(F.col(c).alias(f"_s{i}") for i, c in enumerate(scope)), F.col(node).cast("string").alias("_node")).agg(F.max(order).alias("_o"), F.first(key).alias("_scope"))
    nodes = nodes.select(*(f"_s{i}" for i in range(len(scope))), "_scope", "_node", F.col(f"_o.{parent}").cast("string").alias("_parent"), *([F.col(f"_o.{children}").alias("_kids")] if children else []))
    slim = nodes.select("_scope", "_node", "_parent")
    if children:
        listed = nodes.select("_scope", F.col("_node").alias("_by"), F.explode("_kids").alias("_node")).where(F.col("_node").isNotNull()).groupBy("_scope", "_node").agg(F.min("_by").alias("_other"))
        slim = slim.join(listed, ["_scope", "_node"], "left")
    else:
        slim = slim.withColumn("_other", F.lit(None).cast("string"))
    # how many parts each scope needs; one row for each scope that needs several, found by a pre-aggregated count
    large = df.where(F.col(node).isNotNull()).groupBy(key.alias("_scope")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    large = cut(large.select("_scope", F.ceil(F.col("_n") / limit).cast("int").alias("_parts")))
    spread = not large.isEmpty()
    if spread:
        placed = slim.join(large, "_scope", "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("_node"), F.col("_parts")).cast("int"), F.lit(0))).withColumn("_split", F.col("_parts").isNotNull()).drop("_parts")
        placed = placed.repartition("_scope", "_part")
    else:
        placed = slim.withColumns({"_part": F.lit(0), "_split": F.lit(False)}).repartition("_scope")
    done = placed.sortWithinPartitions("_scope", "_part").mapInArrow(_combine, LOCAL_SCHEMA)
    if spread:
        done = _merge(cut(done))
    flat = done.select("_scope", "_node", "_link", "_root", "_depth")
    names = [f"_s{i}" for i in range(len(scope))]
    scopes = _scope_columns(flat, nodes, names)
    return scopes.select(*(F.col(f"_s{i}").alias(c) for i, c in enumerate(scope)), F.col("_node").alias("node_id"), F.col("_link").alias("link_parent"), F.col("_root").alias("root_id"), F.col("_depth").alias("node_depth"))


def _scope_columns(flat: DataFrame, nodes: DataFrame, names: list[str]) -> DataFrame:
    """Get the scope's own columns back out of the length-prefixed key."""
    rest, out = F.col("_scope"), flat
    for name in names:
        kind = nodes.schema[name].dataType.simpleString()
        out = out.withColumn("_size", F.substring_index("_scope", ":", 1)).withColumn("_tail", F.expr("substr(_scope, length(_size) + 2)"))
        out = out.withColumn(name, F.expr(f"case when _size <> '-' then cast(left(_tail, cast(_size as int)) as {kind}) end")).withColumn("_scope", F.expr("case when _size = '-' then _tail else substr(_tail, cast(_size as int) + 1) end"))
    return out.drop("_size", "_tail", "_scope")


def _merge(local: DataFrame) -> DataFrame:
    """Merge the parts' forests: open tops take the top and offset of the node they hang from, until none is open."""
    # which of its two named parents an open top has: the first if such a node exists, else the second
    tops = local.where(F.col("_open") & (F.col("_node") == F.col("_root"))).select("_scope", "_node", "_up", "_up2")
    known = local.select("_scope", F.col("_node").alias("_k"), F.lit(True).alias("_is"))
    tops = tops.join(known.withColumnRenamed("_k", "_up").withColumnRenamed("_is", "_is1"), ["_scope", "_up"], "left")
    tops = tops.join(known.withColumnRenamed("_k", "_up2").withColumnRenamed("_is", "_is2"), ["_scope", "_up2"], "left")
    tops = tops.select("_scope", "_node", F.when(F.col("_is1"), F.col("_up")).when(F.col("_is2"), F.col("_up2")).alias("_first"))
    # contracted links: top -> the top of the part in which its parent lies, with the offset in between
    heads = local.select("_scope", F.col("_node").alias("_first"), F.col("_root").alias("_next"), F.col("_depth").alias("_d"), F.col("_low").alias("_m"))
    weight = F.when(F.col("_next").isNull(), 0).when(F.col("_d") < 0, -1).otherwise(F.col("_d") + 1).cast("long")
    links = cut(tops.join(heads, ["_scope", "_first"], "left").select("_scope", "_node", "_first", F.coalesce("_next", "_node").alias("_next"), weight.alias("_w"), "_m"))
    # weight 0: a root; -1: ends in a cycle that is known; above 0: links up to ``_next``
    ahead = lambda s: s.select("_scope", F.col("_node").alias("_next"), F.col("_next").alias("_n2"), F.col("_w").alias("_w2"), F.col("_seen").alias("_seen2"))
    state = links.select("_scope", "_node", "_next", "_w", F.col("_next").alias("_seen"))
    open_links = lambda s: s.where(F.col("_w") > 0).join(ahead(s), ["_scope", "_next"]).where(F.col("_w2") != 0)
    moving = (F.col("_w") > 0) & F.col("_n2").isNotNull()
    for _ in range(max(1, links.count()).bit_length() + 1):
        if open_links(state).isEmpty():
            break
        state = state.join(ahead(state), ["_scope", "_next"], "left").select(
            "_scope", "_node",
            F.when(moving, F.col("_n2")).otherwise(F.col("_next")).alias("_next"),
            F.when(moving & (F.col("_w2") < 0), F.lit(-1)).when(moving, F.col("_w") + F.col("_w2")).otherwise(F.col("_w")).alias("_w"),
            F.when(moving, F.least("_seen", "_seen2")).otherwise(F.col("_seen")).alias("_seen"))
        state = cut(state)
    # what is still open leads into a cycle across parts: its ends lie on the cycle and have seen all its tops, and the
    # smallest node lies on the way from some top's parent to the next top
    ring = cut(open_links(state).select("_scope", F.col("_next").alias("_node")).distinct())
    if not ring.isEmpty():
        ring = ring.join(state.select("_scope", "_node", "_seen"), ["_scope", "_node"])
        least = ring.join(links, ["_scope", "_node"]).groupBy("_scope", "_seen").agg(F.min("_m").alias("_min"))
        tag = ring.join(least, ["_scope", "_seen"]).select("_scope", F.col("_node").alias("_next"), "_min")
        state = cut(state.join(tag, ["_scope", "_next"], "left").select("_scope", "_node", F.coalesce("_min", "_next").alias("_next"), F.when(F.col("_min").isNotNull(), F.lit(-1)).otherwise(F.col("_w")).alias("_w")))
    final = state.select("_scope", F.col("_node").alias("_root"), F.col("_next").alias("_r2"), F.col("_w").alias("_w2"))
    joined = local.join(final, ["_scope", "_root"], "left").join(links.select("_scope", "_node", "_first"), ["_scope", "_node"], "left")
    has = F.col("_open") & F.col("_r2").isNotNull()
    depth = F.when(has & (F.col("_w2") < 0), F.lit(-1)).when(has, F.col("_depth") + F.col("_w2")).otherwise(F.col("_depth"))
    return joined.select("_scope", "_node", F.coalesce("_link", "_first").alias("_link"), F.when(has, F.col("_r2")).otherwise(F.col("_root")).alias("_root"), depth.cast("int").alias("_depth"))


def _code_of(t: pa.Table, keys: list[str]) -> np.ndarray:
    """One number for each combination of the values of ``keys``; null is a value."""
    out = np.zeros(t.num_rows, np.int64)
    for k in keys:
        coded = t.column(k).combine_chunks().dictionary_encode()
        out = np.unique(out * (len(coded.dictionary) + 1) + coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return out


def _path_slices(t: pa.Table, scope: list[str]) -> Iterator[pa.RecordBatch]:
    """``t`` (whole scopes) with the path of each node, found by going up an index of parents for all nodes of a slice at once."""
    code = _code_of(t, scope)
    (node, link), _ = _ranked([t.column("node_id").combine_chunks(), t.column("link_parent").combine_chunks()])
    parent = _lookup(code, node, link, link >= 0)
    depth = t.column("node_depth").to_numpy().astype(np.int64)
    names = t.column("node_id").combine_chunks()
    size = np.where(depth >= 0, depth + 1, 0)
    total = np.cumsum(size)
    start = 0
    while start < t.num_rows:
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + PATH_ENTRIES, "right")))
        n = size[start:end]
        last = np.cumsum(n) - 1
        flat = np.empty(int(n.sum()), np.int64)
        live = np.flatnonzero(n)
        at, here = last[live], live + start
        while len(live):
            flat[at] = here
            up = np.flatnonzero(depth[here] > 0)
            live, at, here = live[up], at[up] - 1, parent[here[up]]
        offsets = pa.array(np.r_[0, last + 1].astype(np.int32), mask=np.r_[n == 0, False])
        paths = pa.ListArray.from_arrays(offsets, names.take(pa.array(flat)).cast(pa.string()))
        part = t.slice(start, end - start)
        yield pa.RecordBatch.from_arrays([*(part.column(c).combine_chunks() for c in part.column_names), paths], names=[*part.column_names, "node_path"])
        start = end


def tree_paths(trees: DataFrame, scope: list[str], limit: int = SCOPE_LIMIT) -> DataFrame:
    """``trees`` as ``hierarchy`` gives it, with ``node_path``: the node ids from the root down to the node.

    Nodes without a root have a null path.  A scope of at most ``limit`` nodes is in one task, which goes up an index of
    parents; the paths themselves are never shuffled.  In larger scopes paths grow through joins on the parent, the
    settled height doubling each round, so that no task holds a scope.
    """
    columns = [*scope, "node_id", "link_parent", "root_id", "node_depth"]
    trees = cut(trees.select(*columns))
    large = trees.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*scope)
    large = cut(large)
    spread = not large.isEmpty()
    same = lambda left, right: functools.reduce(lambda x, y: x & y, [left[c].eqNullSafe(right[c]) for c in scope])
    small = trees.join(large, same(trees, large), "left_anti") if spread else trees
    schema = T.StructType([*trees.schema.fields, T.StructField("node_path", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, scope, BATCH_NODES):
            yield from _path_slices(t, scope)

    done = small.repartition(*scope).sortWithinPartitions(*scope).mapInArrow(run, schema)
    return done.union(_joined_paths(trees.join(large, same(trees, large), "left_semi"), scope)) if spread else done


def _joined_paths(trees: DataFrame, scope: list[str]) -> DataFrame:
    """Paths through joins; only nodes whose path has not reached the root yet go into a round."""
    trees = cut(trees)
    piece = trees.where(F.col("node_depth") >= 0).select(*scope, "node_id", F.col("link_parent").alias("_up"), F.array("node_id").alias("node_path"))
    deepest = trees.agg(F.max("node_depth")).first()[0]
    for _ in range(max(0, deepest or 0).bit_length()):
        ahead = piece.select(*(F.col(c).alias(f"_a_{c}") for c in scope), F.col("node_id").alias("_a_node"), F.col("_up").alias("_a_up"), F.col("node_path").alias("_a_path"))
        on = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_a_{c}")) for c in scope], F.col("_up") == F.col("_a_node"))
        moved = piece.where(F.col("_up").isNotNull()).join(ahead, on).select(*scope, "node_id", F.col("_a_up").alias("_up"), F.concat("_a_path", "node_path").alias("node_path"))
        piece = cut(piece.where(F.col("_up").isNull()).union(moved))
    back = piece.select(*(F.col(c).alias(f"_a_{c}") for c in scope), F.col("node_id").alias("_a_node"), "node_path")
    on = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_a_{c}")) for c in scope], F.col("node_id") == F.col("_a_node"))
    return trees.join(back, on, "left").select(*scope, "node_id", "link_parent", "root_id", "node_depth", "node_path")


def descendants(paths: DataFrame, scope: list[str]) -> DataFrame:
    """One row for each pair of a node and one of its descendants, from ``tree_paths``; ``distance`` counts links."""
    at = paths.where(F.col("node_depth") > 0).select(*scope, F.col("node_id").alias("descendant_id"), "node_depth", F.posexplode(F.slice("node_path", F.lit(1), F.col("node_depth"))).alias("_i", "node_id"))
    return at.select(*scope, "node_id", "descendant_id", (F.col("node_depth") - F.col("_i")).alias("distance"))
