"""Anchors: selectors of a block, and finding it again in another parse by tiers of falling certainty."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quirestack.functions import geometry as G
from quirestack.functions.normal import normal_text
from quirestack.operators.order import as_of

CONTEXT = 64
TIERS = ("block", "hash", "position", "quote", "shape", "section", "orphan")


def find_approximately(pattern: str, text: str, most: int) -> tuple[int, int, int] | None:
    """Start, end and errors of the best occurrence of ``pattern`` in ``text`` with at most ``most`` edits: fewest errors, then first.

    Sellers' table, one vector operation chain for each character of the pattern.
    """
    p = np.frombuffer(pattern.encode("utf-32-le"), np.uint32)
    t = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(p):
        return (0, 0, 0)

    def table(p: np.ndarray, t: np.ndarray) -> np.ndarray:
        at = np.arange(len(t) + 1)
        row = np.zeros(len(t) + 1, np.int64)
        for i, c in enumerate(p, 1):
            new = np.minimum(row + 1, np.r_[i, row[:-1] + (t != c)])
            row = np.minimum.accumulate(new - at) + at  # insertions, by a running minimum
        return row

    ends = table(p, t)
    end = int(np.argmin(ends))
    errors = int(ends[end])
    if errors > most:
        return None
    starts = table(p[::-1], t[:end][::-1])  # from the end backwards: the longest stretch that reaches the same errors first
    return (end - int(np.flatnonzero(starts == errors)[0]), end, errors)


def most_errors(length: int) -> int:
    return min(256, length // 2)


PLACE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "end", "errors")])


@F.pandas_udf(PLACE)
def quote_place(pattern: pd.Series, text: pd.Series) -> pd.DataFrame:
    """Where the quote stands in the text, if it does with at most half of it wrong."""
    found = [find_approximately(p, t, most_errors(len(p))) if isinstance(p, str) and isinstance(t, str) else None for p, t in zip(pattern, text, strict=True)]
    return pd.DataFrame([f or (None, None, None) for f in found], columns=["start", "end", "errors"]).astype("Int32")


def match_score(errors: Column, length: Column, before: Column, after: Column, place: Column) -> Column:
    """Quote, context and position weighed 50, 20 + 20 and 2."""
    quote = F.greatest(F.lit(0.0), 1 - errors / F.greatest(length, F.lit(1)))
    return (50 * quote + 20 * before + 20 * after + 2 * place) / 92


def selectors(blocks: DataFrame) -> DataFrame:
    """What finds a block again: ``exact``, ``prefix`` and ``suffix`` (CONTEXT characters of the neighbours in document order),
    ``text_hash``, ``stream_start`` (its offset in the document's text) and ``section`` (the heading it stands under)."""
    w = W.partitionBy("paper_id", "generation").orderBy("doc_order", "block_no")
    rows = blocks.where("doc_order is not null").withColumn("exact", normal_text(F.coalesce("text", F.lit(""))))
    before, after = F.lag("exact").over(w), F.lead("exact").over(w)
    start = F.coalesce(F.sum(F.length("exact") + 1).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    section = F.last(F.when(F.col("block_type") == "heading", F.col("exact")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)) if "block_type" in blocks.columns else F.lit(None).cast("string")
    return rows.select("paper_id", "generation", "block_no", "block_id", "page_index", "bbox", "exact", F.coalesce(before.substr(F.greatest(F.length(before) - CONTEXT + 1, F.lit(1)), F.lit(CONTEXT)), F.lit("")).alias("prefix"), F.coalesce(F.substring(after, 1, CONTEXT), F.lit("")).alias("suffix"), F.sha2("exact", 256).alias("text_hash"), start.alias("stream_start"), section.alias("section"))


def _alike(a: Column, b: Column) -> Column:
    """The share of two contexts that agrees; 1 where both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def resolve(old: DataFrame, new: DataFrame, most: float = 0.25) -> DataFrame:
    """Where each row of ``old`` (as ``selectors`` gives it) is in ``new``: ``block_no``, ``tier``, ``found_no`` and ``score``.

    block: same id and same text; hash: the only block with the same text; position: the block at the same offset, with the
    same text; quote: the block on the same page that holds the text with at most the share ``most`` of its characters
    wrong, weighed with its neighbours and its place; shape: the block on the page that overlaps most, by half or more;
    section: the first block with the text of the heading it stood under; orphan: none.  A surviving id alone proves nothing.
    """
    a = old.select("paper_id", "block_no", "block_id", "page_index", F.col("bbox").alias("box"), "exact", "text_hash", "prefix", "suffix", "stream_start", "section")
    b = new.select("paper_id", F.col("block_no").alias("found_no"), F.col("block_id").alias("new_id"), F.col("page_index").alias("page"), F.col("bbox").alias("new_box"), F.col("exact").alias("new_exact"), F.col("text_hash").alias("new_hash"), F.col("prefix").alias("new_prefix"), F.col("suffix").alias("new_suffix"), F.col("stream_start").alias("new_start"))
    solid = F.col("exact") != ""
    tier = lambda df, k, score: df.select("block_no", "found_no", F.lit(score).alias("score"), F.lit(k).alias("k"))
    by_id = tier(a.where(solid).join(b, (a.paper_id == b.paper_id) & (a.block_id == b.new_id) & (a.text_hash == b.new_hash)).groupBy("block_no").agg(F.min("found_no").alias("found_no")), 0, 1.0)
    by_hash = tier(a.where(solid).join(b, (a.paper_id == b.paper_id) & (a.text_hash == b.new_hash)).groupBy("block_no").agg(F.min("found_no").alias("found_no"), F.count(F.lit(1)).alias("n")).where("n = 1"), 1, 0.98)
    settled = by_id.select("block_no").union(by_hash.select("block_no")).distinct()
    rest = a.join(settled, "block_no", "left_anti")
    at = as_of(rest.where(solid).select("paper_id", "block_no", "exact", "stream_start"), b, ["paper_id"], "stream_start", "new_start", "found_no")
    by_place = tier(at.join(b.select("found_no", "new_exact"), "found_no").where("new_exact = exact"), 2, 0.95)
    near = rest.join(b, (rest.paper_id == b.paper_id) & (rest.page_index == b.page)).drop(b.paper_id)
    best = lambda df, k: df.groupBy("block_no").agg(F.max(F.struct("score", (-F.col("found_no")).alias("no"))).alias("b")).select("block_no", (-F.col("b.no")).alias("found_no"), "b.score", F.lit(k).alias("k"))
    quoted = near.where(solid & (F.length("new_exact") >= 0.5 * F.length("exact"))).withColumn("q", quote_place("exact", "new_exact")).where(F.col("q.errors") <= most * F.length("exact"))
    place = 1 - F.abs(F.col("new_start") + F.col("q.start") - F.col("stream_start")) / F.greatest(F.col("new_start") + F.col("q.start"), F.col("stream_start"), F.lit(1))
    quoted = quoted.withColumn("score", F.round(match_score(F.col("q.errors"), F.length("exact"), _alike(F.col("prefix"), F.col("new_prefix")), _alike(F.col("suffix"), F.col("new_suffix")), place), 6))
    shaped = near.withColumn("score", F.round(G.iou(F.col("box"), F.col("new_box")), 6)).where("score >= 0.5")
    headings = b.where("new_exact <> ''").groupBy("paper_id", F.col("new_exact").alias("section")).agg(F.min("found_no").alias("found_no"))
    by_section = tier(rest.where("section is not null").join(headings, ["paper_id", "section"]), 5, 0.3)
    rows = by_id.union(by_hash).union(by_place).union(best(quoted, 3)).union(best(shaped, 4)).union(by_section)
    first = rows.groupBy("block_no").agg(F.min(F.struct("k", "found_no", "score")).alias("r"))
    names = F.array(*map(F.lit, TIERS))
    return a.select("block_no").distinct().join(first, "block_no", "left").select("block_no", names[F.coalesce("r.k", F.lit(6))].alias("tier"), "r.found_no", F.coalesce("r.score", F.lit(0.0)).alias("score"))
