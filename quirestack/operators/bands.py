"""Lines of a page from spans, their bands without overlap, outlines of stacked lines, and the boxes of a stretch of text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quirestack.functions.flow import part_of_box

#: A span belongs to a line if it shares more than this of the lower one's height with the line's first span; a band is at most so many pitches high.
SAME_LINE, MOST_PITCH = 0.5, 1.15
#: Lines so close above one another are one stack.
LINE_GAP = 2.0


def line_numbers(spans: DataFrame, page: list[str], number: str) -> DataFrame:
    """``page``, ``number``, ``box`` and ``line_no`` (from 0): spans from top to bottom, each on the line of the last line's
    first span if it shares enough of its height, else on a new one.  The first span of the line is carried on, so a page
    of any size takes no memory.  Spans without a box have no line and are left out."""
    rows = spans.where(F.col("box").isNotNull()).select(*page, number, "box", F.col("box")[1].alias("_y"), F.col("box")[0].alias("_x"))
    schema = T.StructType([*(f for f in rows.schema.fields if f.name not in ("_y", "_x")), T.StructField("line_no", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, line, top, bottom = None, 0, 0.0, 0.0
        for b in batches:
            out = []
            for *head, box in zip(*(b.column(c).to_pylist() for c in page), b.column("box").to_pylist(), strict=True):
                shorter, shared = min(bottom - top, box[3] - box[1]), min(bottom, box[3]) - max(top, box[1])
                if head != held:
                    held, line, top, bottom = head, 0, box[1], box[3]
                elif not (shorter > 0 and shared > SAME_LINE * shorter):
                    line, top, bottom = line + 1, box[1], box[3]
                out.append(line)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*page, number, "box")), pa.array(out, pa.int32())], names=schema.names)

    return rows.repartition(*page).sortWithinPartitions(*page, "_y", "_x", number).mapInArrow(run, schema)


def line_bands(lines: DataFrame, page: list[str]) -> DataFrame:
    """``page``, ``line_no`` and ``band``: the box around each line, at most MOST_PITCH times the page's usual distance of
    lines high, and ended where the next line begins if that lies below it."""
    b = F.col("box")
    each = lines.groupBy(*page, "line_no").agg(F.min(b[0]).alias("x0"), F.min(b[1]).alias("y0"), F.max(b[2]).alias("x1"), F.max(b[3]).alias("y1"))
    w = W.partitionBy(*page).orderBy("line_no")
    gap = F.col("y0") - F.lag("y0").over(w)
    # half points, halves away from zero; the commonest distance, the smaller of equals
    usual = each.withColumn("_g", gap).where("_g > 0").withColumn("pitch", F.floor(F.col("_g") * 2 + 0.5) / 2)
    usual = usual.groupBy(*page, "pitch").agg(F.count(F.lit(1)).alias("n")).groupBy(*page).agg(F.max(F.struct("n", (-F.col("pitch")).alias("p"))).alias("m")).select(*page, (-F.col("m.p")).alias("pitch"))
    low = each.join(usual, page, "left").withColumn("y1", F.when((F.col("pitch") > 0) & (F.col("y1") - F.col("y0") > MOST_PITCH * F.col("pitch")), F.col("y0") + MOST_PITCH * F.col("pitch")).otherwise(F.col("y1")))
    n = F.lead(F.struct("x0", "y0", "x1")).over(w)
    low = low.withColumn("_n", n)
    beside = F.least("x1", F.col("_n.x1")) - F.greatest("x0", F.col("_n.x0")) <= 0
    end = F.when(F.col("_n").isNotNull() & ~beside & (F.col("y1") > F.col("_n.y0")) & (F.col("_n.y0") > F.col("y0")), F.col("_n.y0")).otherwise(F.col("y1"))
    return low.withColumn("y1", end).select(*page, "line_no", F.array("x0", "y0", "x1", "y1").alias("band"))


def stacked_rings(bands: DataFrame, page: list[str], gap: float = LINE_GAP) -> DataFrame:
    """``page``, ``stack_no``, ``lines`` and ``ring``: the outline of each run of lines that lie close above one another and
    overlap sideways, down its right edges and up its left ones."""
    b, w = F.col("band"), W.partitionBy(*page).orderBy("line_no")
    prior = F.lag("band").over(w)
    apart = prior.isNull() | (b[1] - prior[3] > gap) | (F.least(b[2], prior[2]) <= F.greatest(b[0], prior[0]))
    runs = bands.withColumn("_new", apart.cast("int")).withColumn("stack_no", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1)
    each = runs.groupBy(*page, "stack_no").agg(F.sort_array(F.collect_list(F.struct("line_no", "band"))).alias("_l"))
    right = F.flatten(F.transform("_l", lambda x: F.array(F.array(x["band"][2], x["band"][1]), F.array(x["band"][2], x["band"][3]))))
    left = F.reverse(F.flatten(F.transform("_l", lambda x: F.array(F.array(x["band"][0], x["band"][1]), F.array(x["band"][0], x["band"][3])))))
    return each.select(*page, "stack_no", F.size("_l").alias("lines"), F.concat(right, left).alias("ring"))


def range_boxes(lines: DataFrame, asked: DataFrame, group: list[str]) -> DataFrame:
    """For each asked stretch of characters (``asked_no``, ``from_char``, ``to_char``) the boxes of the lines that hold some of
    it (``start``, ``end``, ``box``), each cut to its share of the line."""
    hit = asked.join(lines, group).where((F.col("start") < F.col("to_char")) & (F.col("end") > F.col("from_char")))
    a, z = F.greatest(F.col("from_char") - F.col("start"), F.lit(0)), F.least(F.col("to_char"), F.col("end")) - F.col("start")
    return hit.select("asked_no", "start", part_of_box(F.col("box"), F.col("end") - F.col("start"), a, z).alias("quad"))
