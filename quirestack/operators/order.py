"""Operators on order and place: as-of lookups, visible ranges, nearest boxes, even samples, packing with a cut."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quirestack.functions import geometry as G
from quirestack.functions.text import estimate_tokens
from quirestack.session import cut


def as_of(asked: DataFrame, known: DataFrame, group: list[str], at: str, start: str, take: str) -> DataFrame:
    """``asked`` with ``take`` of the last row of ``known`` of the same group whose ``start`` is at or before ``at``; null for none.

    Both sides are put in one order and the last known row is carried on, so there is no range join.  Ties in ``start`` go
    to the larger ``take``.
    """
    k = known.select(*group, F.col(start).cast("double").alias("_at"), F.lit(0).alias("_side"), F.col(take).alias("_take"), F.lit(None).cast(asked.select(F.struct("*")).schema[0].dataType).alias("_row"))
    q = asked.select(*group, F.col(at).cast("double").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(known.schema[take].dataType).alias("_take"), F.struct("*").alias("_row"))
    w = W.partitionBy(*group).orderBy("_at", "_side", F.asc_nulls_last("_take")).rowsBetween(W.unboundedPreceding, 0)
    return k.unionByName(q).withColumn("_found", F.last("_take", ignorenulls=True).over(w)).where("_side = 1").select("_row.*", F.col("_found").alias(take))


def running_totals(rows: DataFrame, group: list[str], order: list[str], totals: dict[str, Column]) -> DataFrame:
    """``rows`` with the running total, the row itself included, of each expression of ``totals`` over its group in ``order``.

    For groups that no one task should sort: the rows are laid out by ranges of group and order, every range sums for
    itself, and what the ranges before it sum to is added.  Ties in ``order`` have to be broken by the caller; nulls count 0.
    """
    laid = rows.withColumns({f"_t_{n}": F.coalesce(c, F.lit(0)).cast("long") for n, c in totals.items()}).repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id())
    laid = cut(laid)
    sums = laid.groupBy(*group, "_range").agg(*(F.sum(f"_t_{n}").alias(f"_s_{n}") for n in totals))
    before = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*(F.col(g).alias(f"_g_{g}") for g in group), F.col("_range").alias("_r"), *(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in totals))
    same = F.col("_range") == F.col("_r")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    own = W.partitionBy(*group, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    made = laid.join(sums, same).withColumns({n: F.sum(f"_t_{n}").over(own) + F.col(f"_o_{n}") for n in totals})
    return made.select(*rows.columns, *totals)


def visible(spans: DataFrame, views: DataFrame, group: list[str], overscan: int = 1) -> DataFrame:
    """For each view (``view_top``, ``view_height``) of a group the first and last span (``place``, ``top``, ``height``) that
    shows, widened by ``overscan`` on both sides, and the one that shows most (the first of equals); null where none does."""
    both = views.join(spans, group)
    share = F.least(F.col("top") + F.col("height"), F.col("view_top") + F.col("view_height")) - F.greatest("top", "view_top")
    last = spans.groupBy(*group).agg(F.max("place").alias("_last"))
    shown = both.withColumn("_share", share).where("_share > 0").groupBy(*views.columns).agg(F.min("place").alias("_a"), F.max("place").alias("_z"), F.max(F.struct("_share", (-F.col("place")).alias("p"))).alias("_m"))
    return views.join(shown, views.columns, "left").join(last, group, "left").select(*views.columns, F.when(F.col("_a").isNotNull(), F.greatest(F.col("_a") - overscan, F.lit(0))).cast("int").alias("first_place"), F.when(F.col("_z").isNotNull(), F.least(F.col("_z") + overscan, F.col("_last"))).cast("int").alias("last_place"), (-F.col("_m.p")).cast("int").alias("main_place"))


def box_at(points: DataFrame, boxes: DataFrame, page: list[str], near: float = 0.0) -> DataFrame:
    """For each point (``point_no``, ``x``, ``y``) the smallest box of its page that holds it, ``near`` points around included; ties to the smaller ``box_no``."""
    b = F.col("box")
    hit = points.join(boxes, page).where((F.col("x") >= b[0] - near) & (F.col("x") <= b[2] + near) & (F.col("y") >= b[1] - near) & (F.col("y") <= b[3] + near))
    return hit.groupBy("point_no").agg(F.min(F.struct(G.area(b).alias("a"), F.col("box_no"))).alias("m")).select("point_no", "m.box_no")


def nearest_box(shapes: DataFrame, boxes: DataFrame, page: list[str], reach: float = 6.0, most_ratio: float = 16.0) -> DataFrame:
    """For each shape (``shape_no``, ``shape``) the box of its page within ``reach`` that is nearest: the distance of the
    centres times the ratio of the areas, at most ``most_ratio``; ties to the smaller ``box_no``."""
    s, b = F.col("shape"), F.col("box")
    gap_x, gap_y = F.greatest(b[0] - s[2], s[0] - b[2], F.lit(0.0)), F.greatest(b[1] - s[3], s[1] - b[3], F.lit(0.0))
    centre = F.hypot((s[0] + s[2] - b[0] - b[2]) / 2, (s[1] + s[3] - b[1] - b[3]) / 2)
    big, small = F.greatest(G.area(s), G.area(b)), F.least(G.area(s), G.area(b))
    weight = F.least(F.when(small > 0, big / small).otherwise(most_ratio), F.lit(most_ratio))
    near = shapes.join(boxes, page).where(F.hypot(gap_x, gap_y) <= reach).withColumn("k", F.round(centre * weight, 6))
    return near.groupBy("shape_no").agg(F.min(F.struct("k", "box_no")).alias("m")).select("shape_no", "m.box_no", F.col("m.k").alias("cost"))


def even_sample(count: Column, quota: int) -> Column:
    """Up to ``quota`` numbers from 0 to ``count`` - 1, evenly spaced with both ends; halves go to the even number."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(max(quota, 2) - 1)), lambda i: F.bround(i * (count - 1) / F.lit(max(quota, 2) - 1)).cast("int"))
    return F.when(count <= 0, F.expr("cast(array() as array<int>)")).when(count <= quota, F.sequence(F.lit(0), count - 1)).when(F.lit(quota <= 1), F.array(F.lit(0))).otherwise(F.array_distinct(spread))


def longest_prefix(text: Column, room: Column, floor: int) -> Column:
    """How many characters of ``text`` cost at most ``room`` tokens, as ``estimate_tokens`` counts them.

    Whole runs of blanks and letters and single signs are taken while they fit; of a run of plain letters and digits as many characters as the rest pays.
    """
    atoms = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?s)[ \t]*[A-Za-z0-9]+|."), F.lit(0))
    plain = lambda a: a.rlike("[A-Za-z0-9]$")
    cost = lambda a: F.when(plain(a), F.greatest(F.lit(1), F.ceil(F.octet_length(a) / floor).cast("int"))).otherwise(F.octet_length(a))
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("chars"), F.lit(True).alias("open"))

    def step(s: Column, a: Column) -> Column:
        left = F.greatest(room - s["used"], F.lit(0)).cast("int")
        fits = s["open"] & (cost(a) <= left)
        part = F.when(s["open"] & ~fits & plain(a), left * floor).otherwise(0)
        return F.struct((s["used"] + F.when(fits, cost(a)).otherwise(0)).alias("used"), (s["chars"] + F.when(fits, F.length(a)).otherwise(part)).cast("int").alias("chars"), fits.alias("open"))

    return F.aggregate(atoms, start, step)["chars"]


PACKED = "kept boolean, used_before int, used_after int, cut_to int"


def pack(items: DataFrame, group: list[str], component: str, order: list[str], text: str, budgets: dict[str, int], cuttable: tuple[str, ...] = (), floor: int = 1) -> DataFrame:
    """Greedy packing in order: an item that does not fit its component's budget is left out and later, smaller ones may
    still fit; one of a component in ``cuttable`` is cut to what is left instead, if anything is.

    Adds ``tokens``, ``kept``, ``used_before``, ``used_after`` and ``cut_to`` (tokens it was cut to, null if it was not).
    The sum is carried on from row to row of the sorted partition, so a group of any size takes no memory.  An unknown
    component has budget 0; null text costs nothing.
    """
    rows = items.withColumn("tokens", estimate_tokens(text, floor)).select(*group, component, *order, "tokens")
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(PACKED).fields])
    heads = [*group, component]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, used, budget, may_cut = None, 0, 0, False
        for b in batches:
            out = []
            for *head, tokens in zip(*(b.column(h).to_pylist() for h in heads), b.column("tokens").to_pylist(), strict=True):
                if head != held:
                    held, used, budget, may_cut = head, 0, budgets.get(head[-1], 0), head[-1] in cuttable
                before, cost, short = used, tokens or 0, None
                kept = used + cost <= budget
                if not kept and may_cut and used < budget:
                    kept, cost = True, budget - used
                    short = cost
                used += cost if kept else 0
                out.append((kept, before, used, short))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([r[i] for r in out], t) for i, t in enumerate((pa.bool_(), pa.int32(), pa.int32(), pa.int32())))], names=schema.names)

    return rows.repartition(*heads).sortWithinPartitions(*heads, *order).mapInArrow(run, schema)
