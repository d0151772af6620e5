"""Evidence around a selection, rung by rung: outline and structure, neighbours, relations, citations; each block is
claimed once, by the first rung that reaches it.

Selections are rows (``question_id``, paper, generation, ``block_id``); every rung is a join on the paper, so any number of
questions is answered at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quirestack.functions.text import citation_labels, entry_label
from quirestack.operators.retrieval import section_outline

PAPER = ["paper_id", "generation"]
SEED = ["question_id", *PAPER, "block_id"]


@dataclass(frozen=True)
class Policy:
    """Limits of the rungs for each selected block."""

    parents: int = 2
    children: int = 12
    siblings: int = 6
    radius: int = 2
    related: int = 12
    citations: int = 8

    def __post_init__(self) -> None:
        if min(self.parents, self.children, self.siblings, self.radius, self.related, self.citations) < 0:
            raise ValueError("limits must not be negative")


def _rung(df: DataFrame, stage: int, reason, place) -> DataFrame:  # noqa: ANN001
    return df.select(*SEED, "target_id", F.lit(stage).alias("stage"), reason.alias("reason"), place.cast("long").alias("place"))


def neighbours(seeds: DataFrame, ranked: DataFrame, policy: Policy) -> DataFrame:
    """The blocks before and after in reading order, nearest first and both sides in turn."""
    own = seeds.join(ranked.select(*PAPER, "block_id", "rank"), [*PAPER, "block_id"])
    steps = F.array(*(F.lit(k) for k in range(-policy.radius, policy.radius + 1) if k))
    wide = own.select(*SEED, "rank", F.explode(steps).alias("step")).withColumn("at", F.col("rank") + F.col("step"))
    hit = wide.join(ranked.select(*PAPER, F.col("block_id").alias("target_id"), F.col("rank").alias("at")), [*PAPER, "at"])
    return _rung(hit, 1, F.concat(F.lit("adjacent:"), F.when(F.col("step") > 0, "+").otherwise(""), F.col("step").cast("string")), 2 * F.abs("step") + (F.col("step") > 0).cast("int"))


def ancestors(seeds: DataFrame, links: DataFrame, policy: Policy) -> DataFrame:
    """Up to ``parents`` blocks above, nearest first."""
    up = links.where("parent_id is not null").select(*PAPER, F.col("block_id").alias("here"), F.col("parent_id").alias("next"))
    there = links.select(*PAPER, F.col("block_id").alias("next"))
    level, out = seeds.withColumn("here", F.col("block_id")), None
    for k in range(1, policy.parents + 1):
        level = level.join(up, [*PAPER, "here"]).join(there, [*PAPER, "next"]).select(*SEED, F.col("next").alias("here"))
        this = _rung(level.withColumn("target_id", F.col("here")), 0, F.lit(f"parent:{k}"), F.lit(1000 + k))
        out = this if out is None else out.union(this)
    return out


def children(seeds: DataFrame, links: DataFrame, policy: Policy) -> DataFrame:
    kids = links.where("parent_id is not null").select(*PAPER, F.col("parent_id").alias("block_id"), F.col("block_id").alias("target_id"), "sibling_order")
    w = W.partitionBy(*SEED).orderBy("sibling_order", "target_id")
    return _rung(seeds.join(kids, [*PAPER, "block_id"]).withColumn("k", F.row_number().over(w)).where(F.col("k") <= policy.children), 0, F.lit("child"), 2000 + F.col("k"))


def outline(seeds: DataFrame, ranked: DataFrame, headings: DataFrame) -> DataFrame:
    """The headings above each block, outermost first; ``headings``: paper, ``block_id``, ``rank``, ``heading_level``."""
    tree = section_outline(headings.select(*PAPER, "block_id", "rank", "heading_level"), PAPER, ["rank"], "heading_level", "block_id").select(*PAPER, F.col("block_id").alias("here"), F.col("parent_heading").alias("next"))
    w = W.partitionBy(*PAPER).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    own = ranked.withColumn("heading", F.last(F.when(F.col("is_heading"), F.col("block_id")), ignorenulls=True).over(w))
    level = seeds.join(own.select(*PAPER, "block_id", "heading"), [*PAPER, "block_id"]).where("heading is not null").select(*SEED, F.col("heading").alias("here"))
    deepest = int(headings.agg(F.max("heading_level")).first()[0] or 0)
    out = _rung(level.withColumn("target_id", F.col("here")), 0, F.lit("section-heading"), F.lit(999))
    for k in range(1, deepest):
        level = level.join(tree, [*PAPER, "here"]).where("next is not null").select(*SEED, F.col("next").alias("here"))
        out = out.union(_rung(level.withColumn("target_id", F.col("here")), 0, F.lit("outline-heading"), F.lit(999 - k)))
    return out


def related(seeds: DataFrame, edges: DataFrame, policy: Policy) -> DataFrame:
    """Relations in both directions but those that cite, known kinds first; ``edges``: paper, rel_type, from_block, to_block, ``kind_rank``."""
    there = edges.select(*PAPER, F.col("from_block").alias("block_id"), F.col("to_block").alias("target_id"), "rel_type", "kind_rank")
    back = edges.select(*PAPER, F.col("to_block").alias("block_id"), F.col("from_block").alias("target_id"), "rel_type", "kind_rank")
    hit = seeds.join(there.union(back).distinct(), [*PAPER, "block_id"]).where("target_id <> block_id")
    w = W.partitionBy(*SEED).orderBy("kind_rank", "rel_type", "target_id")
    return _rung(hit.withColumn("k", F.row_number().over(w)).where(F.col("k") <= policy.related), 2, F.col("rel_type"), F.col("k"))


def citations(seeds: DataFrame, texts: DataFrame, entries: DataFrame, cites: DataFrame, policy: Policy) -> DataFrame:
    """Entries that edges name, then those whose label the text prints in brackets.  A label printed by several entries names none."""
    by_edge = seeds.join(cites.select(*PAPER, F.col("from_block").alias("block_id"), F.col("to_block").alias("target_id")).distinct(), [*PAPER, "block_id"]).select(*SEED, "target_id", F.lit("edge").alias("how"), F.lit(0).alias("first"))
    labels = entries.select(*PAPER, "block_id", entry_label("text").alias("label")).where("label is not null").groupBy(*PAPER, "label").agg(F.min("block_id").alias("target_id"), F.count(F.lit(1)).alias("n")).where("n = 1")
    marks = seeds.join(texts.select(*PAPER, "block_id", "text"), [*PAPER, "block_id"]).select(*SEED, F.posexplode(citation_labels("text")).alias("first", "label"))
    by_label = marks.join(labels, [*PAPER, "label"]).select(*SEED, "target_id", F.lit("label").alias("how"), (F.col("first") + 1).alias("first"))
    both = by_edge.union(by_label).groupBy(*SEED, "target_id").agg(F.min(F.struct("first", "how")).alias("m"))
    w = W.partitionBy(*SEED).orderBy("m.first", "target_id")
    return _rung(both.withColumn("k", F.row_number().over(w)).where(F.col("k") <= policy.citations), 3, F.concat(F.lit("citation-"), F.col("m.how")), F.col("k"))


def section_siblings(seeds: DataFrame, ranked: DataFrame, claimed: DataFrame, policy: Policy) -> DataFrame:
    """The nearest blocks of the same section that nothing has claimed yet, at most ``siblings``."""
    w = W.partitionBy(*PAPER).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    parts = ranked.withColumn("section", F.sum(F.col("is_heading").cast("int")).over(w))
    own = seeds.join(parts.select(*PAPER, "block_id", "section", F.col("rank").alias("here")), [*PAPER, "block_id"]).where("section > 0")
    # claims of a question lie within its rungs' limits, so at most so many of the nearest can be taken already
    far = policy.siblings + policy.children + policy.parents + 2 * policy.radius + 32
    near = own.join(parts.select(*PAPER, "section", F.col("block_id").alias("target_id"), "rank"), [*PAPER, "section"]).where((F.col("target_id") != F.col("block_id")) & (F.abs(F.col("rank") - F.col("here")) <= far))
    free = near.join(claimed.select("question_id", *PAPER, "target_id").distinct(), ["question_id", *PAPER, "target_id"], "left_anti").join(seeds.select("question_id", *PAPER, F.col("block_id").alias("target_id")), ["question_id", *PAPER, "target_id"], "left_anti")
    w = W.partitionBy(*SEED).orderBy(F.abs(F.col("rank") - F.col("here")), "rank", "target_id")
    return _rung(free.withColumn("k", F.row_number().over(w)).where(F.col("k") <= policy.siblings), 0, F.lit("section-sibling"), 3000 + F.col("k"))


def first_claims(rungs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Each block of a question once, under the rung that reached it first; the selected blocks themselves are left out."""
    least = rungs.groupBy("question_id", *PAPER, "target_id").agg(F.min(F.struct("stage", "place", "reason")).alias("c"))
    own = seeds.select("question_id", *PAPER, F.col("block_id").alias("target_id")).distinct()
    return least.join(own, ["question_id", *PAPER, "target_id"], "left_anti").select("question_id", *PAPER, "target_id", "c.stage", "c.reason", "c.place")
