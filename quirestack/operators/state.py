"""State after a log of changes, without a database: every operator is an aggregation that combines before it shuffles.

A change has a key, an order, a kind (insert, update, delete) and values.  An insert of a key that is there already, and an
update or delete of one that is not, change nothing and are told as refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def judged(changes: DataFrame, key: list[str], order: list[str], kind: str) -> DataFrame:
    """``changes`` with ``accepted``: whether the key was there (update, delete) or not (insert) before the change.

    Whether a key is there depends only on the last insert or delete before, refused ones included: after any insert it is
    there, after any delete it is not.  Null kinds are refused.  Ties in ``order`` have to be broken by the caller.
    """
    w = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    there = F.coalesce(F.last(F.when(F.col(kind) == "insert", True).when(F.col(kind) == "delete", False), ignorenulls=True).over(w), F.lit(False))
    return changes.withColumn("accepted", F.coalesce(F.when(F.col(kind) == "insert", ~there).when(F.col(kind).isin("update", "delete"), there), F.lit(False)))


def state_after(accepted: DataFrame, key: list[str], order: list[str], kind: str, values: list[str]) -> DataFrame:
    """The rows that are there after all accepted changes: ``key``, the last non-null ``values`` since the key's last
    insert, and ``version`` (1 after the insert, one more for each update)."""
    place = F.struct(*order)
    rows = accepted.where("accepted").withColumn("_place", place)
    begun = rows.groupBy(*key).agg(F.max(F.when(F.col(kind) == "insert", F.col("_place"))).alias("_from"), F.max(F.when(F.col(kind) == "delete", F.col("_place"))).alias("_gone"))
    alive = begun.where("_gone is null or _gone < _from").drop("_gone")
    now = rows.join(alive, key).where("_place >= _from")
    return now.groupBy(*key).agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), F.col("_place"))).alias(v) for v in values), F.count(F.lit(1)).alias("version"))


def audit(accepted: DataFrame, key: list[str], order: list[str], kind: str) -> DataFrame:
    """One row for each change, refused ones too: ``outcome`` (the kind, or denied) and the key's ``version`` after it."""
    w = W.partitionBy(*key).orderBy(*order)
    life = F.sum(F.when(F.col("accepted") & (F.col(kind) == "insert"), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = accepted.withColumn("_life", life)
    inside = W.partitionBy(*key, "_life").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    version = F.sum(F.when(F.col("accepted") & F.col(kind).isin("insert", "update"), 1).otherwise(0)).over(inside)
    gone = F.max(F.when(F.col("accepted") & (F.col(kind) == "delete"), 1).otherwise(0)).over(inside)
    return rows.withColumn("version", F.when((gone == 1) | (F.col("_life") == 0), 0).otherwise(version)).withColumn("outcome", F.when(F.col("accepted"), F.col(kind)).otherwise("denied")).drop("_life")


def audit_is_append_only(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows of an earlier audit that a later one has lost or changed; repeated rows count as often as they are there."""
    return before.exceptAll(after)


def cascade(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """The children whose parent is still there."""
    return children.join(parents.select(*keys).distinct(), keys, "left_semi")


def dangling(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """The children whose parent is not there: what a foreign key refuses.  A null in ``keys`` refers to nothing."""
    whole = children
    for k in keys:
        whole = whole.where(F.col(k).isNotNull())
    return whole.join(parents.select(*keys).distinct(), keys, "left_anti")


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``wins``: the first of each key; the others would break its uniqueness."""
    least = rows.groupBy(*key).agg(F.min(F.struct(*order)).alias("_least"))
    return rows.join(least, key).withColumn("wins", F.struct(*order) == F.col("_least")).drop("_least")


def listing(rows: DataFrame, owner: list[str], order: list, most: int | None = None) -> DataFrame:  # noqa: ANN001
    """Rows numbered in ``order`` within their owner, from 1; with ``most`` only so many."""
    out = rows.withColumn("place", F.row_number().over(W.partitionBy(*owner).orderBy(*order)).cast("long"))
    return out if most is None else out.where(F.col("place") <= most)
