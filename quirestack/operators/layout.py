"""Page layout: columns, reading order around full-width blocks, suppression of overlapping regions, clusters, coverage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quirestack.operators.grouped import per_group

PAGE = ["paper_id", "generation", "page_index"]
SUPPRESS = 0.5
NEAR = 12.0
#: A block of more than this share of the page's used width is full-width.
WIDE = 0.6


def best_gutter(left: np.ndarray, right: np.ndarray, low: float, high: float) -> tuple[float, int, int, int]:
    """Where fewest boxes are cut between low and high, in steps of one point, how many are cut, and how many lie on either
    side; ties go to the most even split, then the left."""
    x = np.arange(low, high + 1e-9)
    a, b = np.sort(left), np.sort(right)
    before, behind = np.searchsorted(b, x, "right"), len(a) - np.searchsorted(a, x, "left")
    cut = len(a) - before - behind
    at = np.lexsort((x, -np.minimum(before, behind), cut))[0]
    return float(x[at]), int(cut[at]), int(before[at]), int(behind[at])


def page_columns(boxes: DataFrame, most_cut: float = 0.2) -> DataFrame:
    """One row for each page: ``column_count`` (1 or 2) and ``gutter_x`` (null for one column).

    ``boxes``: paper_id, generation, page_index, block_no, x0, x1.  Two columns need two boxes on both sides and at most the
    share ``most_cut`` of boxes across the gutter.
    """

    def run(g: dict[str, np.ndarray]) -> tuple:
        a, b = g["x0"], g["x1"]
        fine = ~(np.isnan(a) | np.isnan(b)) & (a < b)
        a, b = a[fine], b[fine]
        if len(a) < 4:
            return [1], [np.nan]
        low, high = a.min(), b.max()
        x, cut, before, behind = best_gutter(a, b, round(low + 0.3 * (high - low)), round(low + 0.7 * (high - low)))
        return ([2], [x]) if min(before, behind) >= 2 and cut <= most_cut * len(a) else ([1], [np.nan])

    return per_group(boxes.select(*PAGE, "block_no", "x0", "x1"), PAGE, ["block_no"], run, "column_count int, gutter_x double")


def column_order(boxes: DataFrame) -> DataFrame:
    """``block_no`` and ``layout_rank``: full-width blocks part the page into slabs; within a slab the left column comes first."""
    ends = boxes.groupBy(*PAGE).agg(F.min("x0").alias("_lo"), F.max("x1").alias("_hi"))
    wide = F.col("x1") - F.col("x0") > WIDE * (F.col("_hi") - F.col("_lo"))
    rows = boxes.join(ends, PAGE).withColumn("_w", wide.cast("int"))
    before = F.coalesce(F.sum("_w").over(W.partitionBy(*PAGE).orderBy("y0", "x0", "block_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    side = F.when(F.col("_w") == 1, 0).otherwise(((F.col("x0") + F.col("x1")) / 2 > (F.col("_lo") + F.col("_hi")) / 2).cast("int"))
    rows = rows.withColumns({"_slab": 2 * before + F.col("_w"), "_side": side})
    return rows.select(*PAGE, "block_no", (F.row_number().over(W.partitionBy(*PAGE).orderBy("_slab", "_side", "y0", "x0", "block_no")) - 1).alias("layout_rank"))


def suppressed(boxes: DataFrame) -> DataFrame:
    """``block_no`` and ``kept``: from the largest region down, one that a kept region covers by more than half goes."""

    def run(g: dict[str, np.ndarray]) -> tuple:
        x0, y0, x1, y1, no = (g[c] for c in ("x0", "y0", "x1", "y1", "block_no"))
        area = (x1 - x0) * (y1 - y0)
        order = np.lexsort((no, -area))
        x0, y0, x1, y1, own = x0[order], y0[order], x1[order], y1[order], np.maximum(area[order], 1e-9)
        kept = np.zeros(len(no), bool)
        for i in range(len(no)):
            k = np.flatnonzero(kept[:i])
            shared = np.maximum(0, np.minimum(x1[i], x1[k]) - np.maximum(x0[i], x0[k])) * np.maximum(0, np.minimum(y1[i], y1[k]) - np.maximum(y0[i], y0[k]))
            kept[i] = not (shared / own[i] > SUPPRESS).any()
        return no[order], kept

    return per_group(boxes.select(*PAGE, "block_no", "x0", "y0", "x1", "y1"), PAGE, ["block_no"], run, "block_no long, kept boolean")


def clusters(boxes: DataFrame, near: float = NEAR) -> DataFrame:
    """``block_no`` and ``cluster_no`` (the smallest block_no of the cluster): boxes within ``near`` points are connected."""

    def run(g: dict[str, np.ndarray]) -> tuple:
        x0, y0, x1, y1, no = (g[c] for c in ("x0", "y0", "x1", "y1", "block_no"))
        low = np.arange(len(no))
        order = np.argsort(x0, kind="stable")
        reach = np.searchsorted(x0[order], x1[order] + near, "right")  # those that begin before a box ends
        pairs = [(order[i], order[i + 1 : reach[i]]) for i in range(len(no))]
        links = [np.stack([np.full(len(j), i), j]) for i, j in ((i, j[(y0[i] - near <= y1[j]) & (y0[j] - near <= y1[i])]) for i, j in pairs) if len(j)]
        a, b = np.concatenate(links, 1) if links else np.zeros((2, 0), int)
        while True:  # the smallest number spreads over the links, and through what is already one
            new = low.copy()
            np.minimum.at(new, a, low[b])
            np.minimum.at(new, b, low[a])
            new = new[new]
            if (new == low).all():
                return no, no[low]
            low = new

    return per_group(boxes.select(*PAGE, "block_no", "x0", "y0", "x1", "y1"), PAGE, ["block_no"], run, "block_no long, cluster_no long")


def covered_area(boxes: DataFrame) -> DataFrame:
    """``union_area``: what the page's boxes cover together."""

    def run(g: dict[str, np.ndarray]) -> tuple:
        return ([round(union_area(g["x0"], g["y0"], g["x1"], g["y1"]), 4)],)

    return per_group(boxes.select(*PAGE, "block_no", "x0", "y0", "x1", "y1"), PAGE, ["block_no"], run, "union_area double")


def union_area(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> float:
    """The area of the grid cells between all edges that some box covers."""
    fine = (x1 > x0) & (y1 > y0)
    x0, y0, x1, y1 = x0[fine], y0[fine], x1[fine], y1[fine]
    xs, ys = np.unique(np.r_[x0, x1]), np.unique(np.r_[y0, y1])
    if not len(xs):
        return 0.0
    count = np.zeros((len(xs), len(ys)), np.int64)
    a, b, c, d = np.searchsorted(xs, x0), np.searchsorted(xs, x1), np.searchsorted(ys, y0), np.searchsorted(ys, y1)
    for i, j, sign in ((a, c, 1), (b, c, -1), (a, d, -1), (b, d, 1)):
        np.add.at(count, (i, j), sign)
    covered = count.cumsum(0).cumsum(1)[:-1, :-1] > 0
    return float(np.diff(xs) @ covered @ np.diff(ys))
