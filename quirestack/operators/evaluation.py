"""Scores of what was found against what should be: sets, regions, reading orders, and their means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quirestack.functions import geometry as G


def ratio(a: Column, b: Column) -> Column:
    """Null where there is nothing to divide by."""
    return F.when(b > 0, F.round(a / b, 6))


def set_scores(found: DataFrame, gold: DataFrame, group: list[str], item: list[str]) -> DataFrame:
    """For each group: ``correct``, ``false_items``, ``missed``, ``precision``, ``recall`` and ``f1`` of distinct items.

    A group that only one side has counts with zero items of the other.  Precision without found items and recall without
    gold ones are null; f1 is 0 where either is null or 0 and the group has items.
    """
    both = found.select(*group, *item, F.lit(1).alias("f"), F.lit(0).alias("g")).union(gold.select(*group, *item, F.lit(0), F.lit(1)))
    each = both.groupBy(*group, *item).agg(F.max("f").alias("f"), F.max("g").alias("g"))
    out = each.groupBy(*group).agg(F.sum(F.col("f") * F.col("g")).alias("correct"), F.sum(F.col("f") * (1 - F.col("g"))).alias("false_items"), F.sum((1 - F.col("f")) * F.col("g")).alias("missed"))
    c, x, m = F.col("correct"), F.col("false_items"), F.col("missed")
    return out.withColumns({"precision": ratio(c, c + x), "recall": ratio(c, c + m), "f1": F.round(2 * c / (2 * c + x + m), 6)})


def best_overlaps(gold: DataFrame, found: DataFrame, page: list[str], least: float) -> DataFrame:
    """Pairs of a gold and a found region of the same page and kind that overlap by ``least`` or more (area shared over joint).

    Columns of ``gold``: ``page``, kind, gold_no, gold_box; of ``found``: ``page``, kind, found_no, found_box.
    """
    return gold.join(found, [*page, "kind"]).withColumn("overlap", F.round(G.iou(F.col("gold_box"), F.col("found_box")), 6)).where(F.col("overlap") >= least)


def kind_scores(matches: DataFrame, gold: DataFrame, found: DataFrame, group: list[str]) -> DataFrame:
    """For each group and kind the numbers of matches, gold and found regions, and f1 (0 where nothing matches)."""
    key = [*group, "kind"]
    m, g, f = matches.groupBy(*key).agg(F.count(F.lit(1)).alias("matched")), gold.groupBy(*key).agg(F.count(F.lit(1)).alias("gold")), found.groupBy(*key).agg(F.count(F.lit(1)).alias("found"))
    out = g.join(f, key, "full").join(m, key, "left").na.fill(0, ["matched", "gold", "found"])
    return out.withColumn("f1", F.round(2 * F.col("matched") / (F.col("gold") + F.col("found")), 6))


def macro_f1(scores: DataFrame, group: list[str]) -> DataFrame:
    """The mean f1 of the kinds that have gold regions."""
    return scores.where("gold > 0").groupBy(*group).agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.count(F.lit(1)).alias("kinds"))


def substitutes(missed: DataFrame, found: DataFrame, page: list[str], least: float = 0.5) -> DataFrame:
    """Gold regions without a match of which a found region of another kind lies ``least`` inside: another convention, no miss."""
    f = found.select(*page, F.col("kind").alias("other_kind"), F.col("found_box"))
    inside = G.shared_area(F.col("gold_box"), F.col("found_box")) / F.when(G.area(F.col("found_box")) > 0, G.area(F.col("found_box")))
    return missed.join(f, page).where((F.col("kind") != F.col("other_kind")) & (inside >= least)).select(*page, "kind", "gold_no").distinct()


def order_concordance(both: DataFrame, page: list[str]) -> DataFrame:
    """The share of pairs of a page that stand in the same order in ``gold_at`` and ``found_at``; -1 for less than two."""
    other = both.select(*page, F.col("gold_at").alias("g2"), F.col("found_at").alias("f2"))
    pairs = both.join(other, page).where("gold_at < g2").groupBy(*page).agg(F.round(F.avg((F.col("found_at") < F.col("f2")).cast("double")), 6).alias("c"))
    return both.select(*page).distinct().join(pairs, page, "left").select(*page, F.coalesce("c", F.lit(-1.0)).alias("concordance"))


def common_ratio(rows: DataFrame, group: list[str], side: str, slow: str, fast: str, value: str) -> DataFrame:
    """The median over groups that both sides ran of their ratio; null where none did."""
    each = rows.groupBy(*group).agg(F.sum(F.when(F.col(side) == slow, F.col(value))).alias("s"), F.sum(F.when(F.col(side) == fast, F.col(value))).alias("f"))
    return each.where("s is not null and f > 0").agg(F.round(F.expr("median(s / f)"), 6).alias("median_ratio"), F.count(F.lit(1)).alias("groups"))


BUCKETS = 4_096


def at_ranks(rows: DataFrame, group: list[str], value: str, ranks: dict[str, str]) -> DataFrame:
    """The values at exact ranks of each group: ``ranks`` gives a name and an expression over the group's count ``n`` (from 1).

    Values are counted by buckets between the group's ends; only the buckets that hold a wanted rank are numbered, so no
    task sorts a group.  Nulls and NaN have no rank; a rank outside 1 to n gives null.
    """
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*group, F.col(value).cast("double").alias("_v"))
    ends = rows.groupBy(*group).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("n"))
    spot = F.least(F.floor((F.col("_v") - F.col("_lo")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0) * BUCKETS), F.lit(BUCKETS - 1))
    placed = rows.join(ends, group).withColumn("_b", spot)
    w = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    counts = placed.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    wanted = ends.select(*group, F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.expr(e).cast("long").alias("rank")) for k, e in ranks.items()))).alias("_w")).select(*group, "_w.name", "_w.rank")
    hit = wanted.join(counts, group).where("rank > _before and rank <= _before + _c").select(*group, "name", "_b", (F.col("rank") - F.col("_before")).alias("_k"))
    numbered = placed.join(hit.select(*group, "_b").distinct(), [*group, "_b"], "left_semi").withColumn("_k", F.row_number().over(W.partitionBy(*group, "_b").orderBy("_v")))
    found = hit.join(numbered.select(*group, "_b", "_k", "_v"), [*group, "_b", "_k"])
    return found.groupBy(*group).agg(*(F.max(F.when(F.col("name") == k, F.col("_v"))).alias(k) for k in ranks))
