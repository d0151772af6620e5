"""Disturbed copies of documents, to see what survives: every choice comes from a hash of the row and a seed, so that runs
and clusters agree.  And what came of it: matched rows, ids that collide, the shortest prefix that tells rows apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quirestack.functions import geometry as G


#: Edits of shorter texts that are counted.
EDITS = 64


def chance(seed: int, *columns: Column | str) -> Column:
    """A number in [0, 1) from the columns and the seed."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 30)) / float(1 << 30)


def jittered(blocks: DataFrame, number: str, box: str, most: float = 0.6, seed: int = 1) -> DataFrame:
    """Each edge of each box moved by up to ``most`` points; edges stay in order."""
    edge = lambda i: F.col(box)[i] + (2 * chance(seed + i, number) - 1) * most
    return blocks.withColumn(box, F.when(F.col(box).isNotNull(), G.ordered(F.array(*(edge(i) for i in range(4))))))


def retyped(blocks: DataFrame, number: str, kind: str, rate: float, kinds: tuple[str, ...], seed: int = 1) -> DataFrame:
    """About ``rate`` of the rows get another of ``kinds``."""
    other = F.filter(F.array(*map(F.lit, kinds)), lambda k: k != F.col(kind))
    pick = other[F.floor(chance(seed + 1, number) * F.size(other)).cast("int")]
    return blocks.withColumn(kind, F.when(chance(seed, number) < rate, pick).otherwise(F.col(kind)))


def noisy(blocks: DataFrame, number: str, text: str, rate: float, seed: int = 1) -> DataFrame:
    """About ``rate`` of the texts lose a character or have two change places, at a place of the text's own."""
    at = (F.floor(chance(seed + 1, number) * (F.length(text) - 1)) + 1).cast("int")
    head, tail = F.left(F.col(text), at - 1), F.col(text).substr(at + 2, F.length(text))
    a, b = F.col(text).substr(at, F.lit(1)), F.col(text).substr(at + 1, F.lit(1))
    worse = F.when(chance(seed + 2, number) < 0.5, F.concat(head, b, tail)).otherwise(F.concat(head, b, a, tail))
    return blocks.withColumn(text, F.when((chance(seed, number) < rate) & (F.length(text) > 1), worse).otherwise(F.col(text)))


def split_in_two(blocks: DataFrame, number: str, text: str, box: str, rate: float, seed: int = 1) -> DataFrame:
    """About ``rate`` of the blocks in two: the text at the blank nearest behind its middle, the box at the same share of its height.

    Adds ``part`` (0, 1, or null for a block that stays).  A text without such a blank stays whole.
    """
    half = F.floor(F.length(text) / 2).cast("int")
    cut = F.locate(" ", F.col(text), 1)  # a blank at all
    behind = F.instr(F.col(text).substr(half + 1, F.length(text)), " ")
    at = half + behind
    share = at / F.length(text)
    b = F.col(box)
    y = b[1] + (b[3] - b[1]) * share
    piece = lambda part, t, b: F.struct(part.cast("int").alias("part"), t.alias("t"), b.alias("b"))
    two = F.array(piece(F.lit(0), F.left(F.col(text), at - 1), F.array(b[0], b[1], b[2], y)), piece(F.lit(1), F.col(text).substr(at + 1, F.length(text)), F.array(b[0], y, b[2], b[3])))
    one = F.array(piece(F.lit(None), F.col(text), b))
    wanted = (chance(seed, number) < rate) & (cut > 0) & (behind > 0) & (at < F.length(text))
    return blocks.withColumn("_p", F.explode(F.when(F.coalesce(wanted, F.lit(False)), two).otherwise(one))).withColumns({text: F.col("_p.t"), box: F.col("_p.b"), "part": F.col("_p.part")}).drop("_p")


def merged(blocks: DataFrame, group: list[str], order: list[str], number: str, text: str, box: str, rate: float, seed: int = 1) -> DataFrame:
    """About ``rate`` of the blocks joined to the one before them: one row for each run, with the first ``number``, all
    texts joined by blanks and the box around all."""
    w = W.partitionBy(*group).orderBy(*order)
    starts = F.when(F.lag(number).over(w).isNull() | (chance(seed, number) >= rate), 1).otherwise(0)
    run = blocks.withColumn("_s", starts).withColumn("_run", F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, 0)))
    b = F.col(box)
    item = F.struct(*order, F.col(number).alias("_n"), F.col(text).alias("_t"))
    out = run.groupBy(*group, "_run").agg(F.sort_array(F.collect_list(item)).alias("_i"), F.array(F.min(b[0]), F.min(b[1]), F.max(b[2]), F.max(b[3])).alias(box))
    return out.select(*group, F.col("_i")[0]["_n"].alias(number), F.array_join(F.filter(F.transform("_i", lambda x: x["_t"]), lambda t: t.isNotNull()), " ").alias(text), box, F.size("_i").alias("merged_rows"))


def matched_runs(base: DataFrame, other: DataFrame, page: list[str], least_overlap: float = 0.9, least_likeness: float = 0.95) -> DataFrame:
    """Rows of two runs that are the same thing: boxes that overlap enough and texts that are alike enough (edits over the
    longer length); each row's best partner, ties to the smaller number.  Columns of both: ``page``, ``no``, ``box``, ``text``."""
    o = other.select(*page, F.col("no").alias("other_no"), F.col("box").alias("other_box"), F.col("text").alias("other_text"))
    near = base.join(o, page).withColumn("overlap", F.round(G.iou(F.col("box"), F.col("other_box")), 6)).where(F.col("overlap") >= least_overlap)
    longest = F.greatest(F.length("text"), F.length("other_text"))
    # the edits of short texts are counted only as far as they can count
    short = int(EDITS / (1 - least_likeness)) if least_likeness < 1 else 0
    edits = F.when(longest <= short, F.levenshtein("text", "other_text", EDITS)).otherwise(F.levenshtein("text", "other_text"))
    alike = F.when(longest == 0, 1.0).when(F.col("text") == F.col("other_text"), 1.0).when(edits < 0, 0.0).otherwise(1 - edits / longest)
    near = near.withColumn("likeness", F.round(alike, 6)).where(F.col("likeness") >= least_likeness)
    return near.groupBy("no").agg(F.max(F.struct("overlap", "likeness", (-F.col("other_no")).alias("m"))).alias("b")).select("no", (-F.col("b.m")).alias("other_no"), "b.overlap", "b.likeness")


def collisions(rows: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """Keys that different things share: ``key`` and the number of distinct ``identity``; repeated rows are no collision."""
    return rows.select(key, *identity).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("things")).where("things > 1")


def prefix_floor(rows: DataFrame, group: list[str], text: str, number: str, most: int = 64) -> DataFrame:
    """For each group the shortest prefix length at which all its different texts differ; null if ``most`` does not do.

    Neighbours in alphabetical order share the longest prefixes, so one pass over the sorted texts is enough.
    """
    each = rows.where(F.col(text).isNotNull()).groupBy(*group, text).agg(F.min(number).alias(number))
    before = F.lag(text).over(W.partitionBy(*group).orderBy(text))
    shared = F.size(F.filter(F.sequence(F.lit(1), F.lit(most)), lambda i: (F.left(F.col(text), i) == F.left(before, i)) & (F.length(text) >= i) & (F.length(before) >= i)))
    same = F.when(before.isNull(), 0).otherwise(shared)
    out = each.withColumn("_s", same).groupBy(*group).agg(F.max("_s").alias("_m"))
    return out.select(*group, F.when(F.col("_m") < most, F.col("_m") + 1).alias("prefix_length"))
