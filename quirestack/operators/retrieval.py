"""Nearest vectors, grounding checks, greedy matching and section outlines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quirestack.operators.grouped import per_group
from quirestack.functions.text import content_tokens, coverage, fabricated_numbers


def nearest_vectors(vectors: DataFrame, queries: DataFrame, key: str, vector: str, part: list[str], k: int) -> DataFrame:
    """The ``k`` rows of ``vectors`` nearest to each row of ``queries`` by Euclidean distance, within the columns ``part``.

    Columns: ``query_id``, ``hit_id``, ``distance`` (rounded to 6 digits), ``place``.  Ties go to the smaller id.  k <= 0
    gives no rows; null vectors take no part.  The query set goes to the executors in blocks of its rows; each batch of
    vectors keeps its own best k for each query before anything is shuffled.
    """
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("query_id"), *part, vector)
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("hit_id"), *part, vector)
    best = None
    for block in _blocks(asked, part, vector):
        here = rows.mapInArrow(_distances(rows.sparkSession.sparkContext.broadcast(block), part, vector, k), T.StructType([T.StructField("query_id", T.LongType()), T.StructField("hit_id", T.LongType()), T.StructField("distance", T.DoubleType())]))
        best = here if best is None else best.union(here)
    if best is None or k <= 0:
        return vectors.sparkSession.createDataFrame([], "query_id long, hit_id long, distance double, place int")
    w = W.partitionBy("query_id").orderBy("distance", "hit_id")
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _blocks(asked: DataFrame, part: list[str], vector: str, size: int = 20_000) -> Iterator[tuple]:
    held: list = []
    for r in asked.toLocalIterator():
        held.append((r["query_id"], tuple(r[p] for p in part), r[vector]))
        if len(held) == size:
            yield _packed(held)
            held = []
    if held:
        yield _packed(held)


def _packed(held: list) -> dict:
    out: dict = {}
    for q, p, v in held:
        out.setdefault(p, ([], []))
        out[p][0].append(q)
        out[p][1].append(v)
    return {p: (np.array(q, np.int64), np.array(v, float)) for p, (q, v) in out.items()}


def _distances(shared, part: list[str], vector: str, k: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or k <= 0:
                continue
            ids = b.column("hit_id").to_numpy(zero_copy_only=False)
            x = np.stack(b.column(vector).to_numpy(zero_copy_only=False)).astype(float)
            groups: dict[tuple, list[int]] = {}
            for i, p in enumerate(zip(*(b.column(p).to_pylist() for p in part), strict=True) if part else [()] * b.num_rows):
                groups.setdefault(p, []).append(i)
            for p, members in groups.items():
                at = np.array(members)
                if p not in shared.value:
                    continue
                q, v = shared.value[p]
                own, here = (x[at] ** 2).sum(1), x[at]
                for s in range(0, len(q), 256):
                    some = v[s : s + 256]
                    squares = (some**2).sum(1)[:, None] + own[None, :] - 2 * some @ here.T
                    d = np.round(np.sqrt(np.maximum(squares, 0)), 6)
                    order = np.lexsort((np.broadcast_to(ids[at], d.shape), d))[:, :k]
                    n = order.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q[s : s + 256], n)), pa.array(ids[at][order].ravel()), pa.array(np.take_along_axis(d, order, 1).ravel())], names=["query_id", "hit_id", "distance"])

    return run


def verify_claims(claims: DataFrame, claim: str, evidence: str, threshold: float = 0.6) -> DataFrame:
    """Adds ``claim_coverage``, ``missing_numbers`` and ``supported``: covered enough and no number made up.  No claim is dropped."""
    return claims.withColumns({"claim_coverage": F.round(coverage(claim, evidence), 6), "missing_numbers": fabricated_numbers(claim, evidence)}).withColumn("supported", F.col(evidence).isNotNull() & (F.col("claim_coverage") >= threshold) & (F.size("missing_numbers") == 0))


def claim_bag(c: str):  # noqa: ANN201
    return F.array_distinct(content_tokens(c))


def greedy_match(pairs: DataFrame, group: list[str], left: str, right: str, score: str) -> DataFrame:
    """One-to-one matches: best score first, ties by the larger numbers.  ``pairs`` of a group (a page) are few."""
    made = f"{left} {pairs.schema[left].dataType.simpleString()}, {right} {pairs.schema[right].dataType.simpleString()}, {score} double"

    def run(g: dict[str, np.ndarray]) -> tuple:
        order = np.lexsort((-g[right], -g[left], -g[score]))
        used_l, used_r, keep = set(), set(), []
        for i, a, b in zip(order.tolist(), g[left][order].tolist(), g[right][order].tolist(), strict=True):
            if a not in used_l and b not in used_r:
                used_l.add(a)
                used_r.add(b)
                keep.append(i)
        return g[left][keep], g[right][keep], g[score][keep]

    return per_group(pairs.select(*group, left, right, score), group, [left, right], run, made)


def section_outline(headings: DataFrame, group: list[str], order: list[str], level: str, key: str) -> DataFrame:
    """``headings`` with ``parent_heading``: the nearest one before it of a lower level, null for none.

    The open headings are carried on from row to row of the sorted partition, so levels of any number and groups of any
    size will do.  A heading without a level has no parent and is none's.
    """
    schema = T.StructType([*headings.schema.fields, T.StructField("parent_heading", headings.schema[key].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_ = None, []
        for b in batches:
            out = []
            for *head, own, name in zip(*(b.column(g).to_pylist() for g in group), b.column(level).to_pylist(), b.column(key).to_pylist(), strict=True):
                if head != held:
                    held, open_ = head, []
                if own is None:
                    out.append(None)
                    continue
                while open_ and open_[-1][0] >= own:
                    open_.pop()
                out.append(open_[-1][1] if open_ else None)
                open_.append((own, name))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, b.schema.field(key).type)], names=schema.names)

    return headings.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, schema)
