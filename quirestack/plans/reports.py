"""Positions, ranges, paths and short texts that are read off the document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quirestack.functions import geometry as G
from quirestack.operators.hierarchy import hierarchy, tree_paths
from quirestack.plans.analytics import SQL as OTHERS
from quirestack.plans.analytics import heading_parents
from quirestack.plans.records import _PLAIN, _TREES, p2_descendants, p2_paths
from quirestack.plans.structure import unwrapped
from quirestack.session import table

PAPER = ["paper_id", "generation"]
RANGE = 500


def tree_positions(spark: SparkSession, d: str) -> DataFrame:
    """Where each canvas node is drawn: below its parent by depth, above the middle of its leaves, which stand side by side."""
    paths = p2_paths(spark, d).where("forest = 'canvas' and node_depth >= 0")
    below = p2_descendants(spark, d).where("forest = 'canvas'")
    inner = below.select("paper_id", "node_id").distinct()
    leaves = paths.join(inner, ["paper_id", "node_id"], "left_anti").withColumn("x", F.row_number().over(W.partitionBy("paper_id", "root_id").orderBy("node_path")) - 1).select("paper_id", F.col("node_id").alias("leaf"), "x")
    own = leaves.select("paper_id", F.col("leaf").alias("node_id"), "x").union(below.join(leaves, (below.paper_id == leaves.paper_id) & (F.col("descendant_id") == F.col("leaf"))).select(below.paper_id, "node_id", "x"))
    middle = own.groupBy("paper_id", "node_id").agg(((F.min("x") + F.max("x")) / 2).alias("x"))
    return paths.join(middle, ["paper_id", "node_id"]).select("paper_id", "node_id", (F.col("x") * 300.0).alias("x_pos"), (F.col("node_depth") * 200).alias("y_pos"))


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").where("doc_order is not null").select(*PAPER, "block_no", "doc_order", F.length(F.coalesce("text", F.lit(""))).alias("n")).distinct()
    w = W.partitionBy(*PAPER).orderBy("doc_order", "block_no").rowsBetween(W.unboundedPreceding, -1)
    return b.withColumn("start", F.coalesce(F.sum(F.col("n") + 1).over(w), F.lit(0))).select(*PAPER, "block_no", "start", (F.col("start") + F.col("n")).alias("end"))


def blocks_in_range(spark: SparkSession, d: str) -> DataFrame:
    """The blocks that hold some of the characters 777 to 1,276, 1,554 to 2,053, … of each paper.

    Ranges and blocks meet in stretches of RANGE characters, so the join is an equality and no block meets all ranges.
    """
    blocks = _ranges(spark, d).where("end > start")
    last = blocks.groupBy(*PAPER).agg(F.max("end").alias("e"))
    asked = last.select(*PAPER, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("e"), F.lit(777).cast("bigint"))).alias("lo")).withColumn("hi", F.col("lo") + RANGE)
    cells = lambda a, z: F.explode(F.sequence(F.floor(F.col(a) / RANGE), F.floor((F.col(z) - 1) / RANGE)))
    both = asked.withColumn("cell", cells("lo", "hi")).join(blocks.withColumn("cell", cells("start", "end")), [*PAPER, "cell"])
    return both.where((F.col("start") < F.col("hi")) & (F.col("end") > F.col("lo"))).select(*PAPER, "lo", "block_no").distinct()


def blocks_under_quads(spark: SparkSession, d: str) -> DataFrame:
    """The blocks whose outline meets a retrieved block's, two points around it, without those that hold another that does."""
    b = table(spark, d, "blocks").where("bbox is not null").select(*PAPER, "page_index", "block_id", "bbox").distinct()
    r = table(spark, d, "retrieved_blocks").select("retrieval_no", *PAPER, "block_id").distinct().join(b, [*PAPER, "block_id"])
    x = F.col("bbox")
    shapes = r.select("retrieval_no", *PAPER, "page_index", F.array(x[0] - 2, x[1] - 2, x[2] + 2, x[3] + 2).alias("shape"))
    hit = shapes.join(b, [*PAPER, "page_index"]).where(G.boxes_meet(F.col("shape"), F.col("bbox")) & G.polygons_meet(G.ring(F.col("shape")), G.ring(F.col("bbox")))).select("retrieval_no", *PAPER, "block_id")
    down = p2_descendants(spark, d).where("forest = 'block'").select(*PAPER, F.col("node_id").alias("block_id"), F.col("descendant_id").alias("held"))
    holding = hit.join(down, [*PAPER, "block_id"]).join(hit.select("retrieval_no", *PAPER, F.col("block_id").alias("held")), ["retrieval_no", *PAPER, "held"]).select("retrieval_no", *PAPER, "block_id").distinct()
    return hit.join(holding, ["retrieval_no", *PAPER, "block_id"], "left_anti")


def scroll_targets(spark: SparkSession, d: str) -> DataFrame:
    """How far to scroll for each block at one and a half times the page's size, pages 16 apart, 24 above it."""
    p = table(spark, d, "paper_pages").select(*PAPER, "page_index", "height").distinct()
    w = W.partitionBy(*PAPER).orderBy("page_index").rowsBetween(W.unboundedPreceding, -1)
    p = p.withColumn("top", F.coalesce(F.sum(F.col("height") * 1.5 + 16).over(w), F.lit(0.0)))
    b = table(spark, d, "blocks").where("bbox is not null").select(*PAPER, "page_index", "block_no", "bbox").distinct()
    return b.join(p, [*PAPER, "page_index"]).select("block_no", F.round(F.greatest(F.col("top") + 1.5 * F.col("bbox")[1] - 24, F.lit(0.0)), 4).alias("scroll_top"))


def section_paths(spark: SparkSession, d: str) -> DataFrame:
    """The headings above each heading and itself, outermost first, as one text of ids."""
    h = heading_parents(spark, d)
    t = tree_paths(hierarchy(h, PAPER, "block_id", "parent_heading"), PAPER)
    return t.select(*PAPER, F.col("node_id").alias("block_id"), F.array_join("node_path", " > ").alias("section_path"))


def partial_reasons(spark: SparkSession, d: str) -> DataFrame:
    """For each paper with pages that lack a text layer a sentence that names the first ten."""
    p = table(spark, d, "paper_pages").where("not has_text_layer").select(*PAPER, "page_index").distinct()
    each = p.groupBy(*PAPER).agg(F.sort_array(F.collect_list("page_index")).alias("p"))
    shown = F.array_join(F.transform(F.slice("p", 1, 10), lambda i: (i + 1).cast("string")), ", ")
    return each.select(*PAPER, F.concat(F.lit("no text layer on page "), shown, F.when(F.size("p") > 10, F.concat(F.lit(" and "), (F.size("p") - 10).cast("string"), F.lit(" more"))).otherwise("")).alias("reason"))


def latest_questions(spark: SparkSession, d: str) -> DataFrame:
    """The last five explorations and answers of each canvas, oldest first."""
    n = table(spark, d, "canvas_nodes").where("node_type in ('exploration', 'ai_response')").groupBy("paper_id", "node_id").agg(F.min("created_at").alias("at"))
    last = n.withColumn("k", F.row_number().over(W.partitionBy("paper_id").orderBy(F.desc("at"), F.desc("node_id")))).where("k <= 5")
    return last.select("paper_id", "node_id", F.row_number().over(W.partitionBy("paper_id").orderBy("at", "node_id")).cast("long").alias("place"))


def node_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Each canvas node's label, status and number of tags, with what stands for them where its data lacks them or is damaged."""
    n = table(spark, d, "canvas_nodes").select("node_id", "node_type", "node_data").distinct().withColumn("body", unwrapped(F.col("node_data")))
    get = lambda k: F.get_json_object("body", f"$.{k}")
    return n.select("node_id", F.coalesce(get("label"), F.concat(F.lit("untitled "), F.col("node_type"))).alias("label"), F.coalesce(get("status"), F.lit("idle")).alias("status"), F.coalesce(F.json_array_length(get("tags")), F.lit(0)).alias("tags"))


def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """The key under which what a model made of a prompt is kept."""
    e = table(spark, d, "eval_items").select("item_id", "instruction", "question")
    return e.select("item_id", F.sha2(F.concat_ws("\x1f", F.lit("model-a"), F.coalesce("instruction", F.lit("")), F.coalesce("question", F.lit(""))), 256).alias("cache_key"))


def kind_report(spark: SparkSession, d: str) -> DataFrame:
    """One text for each paper: its kinds of blocks, most frequent first, with their counts."""
    b = table(spark, d, "blocks").select(*PAPER, "block_no", "block_type").distinct().groupBy(*PAPER, "block_type").agg(F.count(F.lit(1)).alias("n"))
    line = F.struct((-F.col("n")).alias("k"), "block_type", F.format_string("%s: %d", "block_type", "n").alias("t"))
    return b.groupBy(*PAPER).agg(F.sort_array(F.collect_list(line)).alias("l")).select(*PAPER, F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("report"))


QUERIES = {f.__name__: f for f in (tree_positions, blocks_in_range, blocks_under_quads, scroll_targets, section_paths, partial_reasons, latest_questions, node_summaries, cache_keys, kind_report)}

_BODIES = f"(SELECT node_id, node_type, CASE WHEN json_valid(j3) AND json_type(j3) = 'OBJECT' THEN j3 END AS body FROM (SELECT *, {_PLAIN.format('j2')} AS j3 FROM (SELECT *, {_PLAIN.format('j1')} AS j2 FROM (SELECT *, {_PLAIN.format('node_data')} AS j1 FROM (SELECT DISTINCT node_id, node_type, node_data FROM canvas_nodes)))))"
SQL = {
    "tree_positions": _TREES + ", cv AS (SELECT * FROM down WHERE forest = 'canvas'), lf AS (SELECT paper_id, node_path, row_number() OVER (PARTITION BY paper_id, root_id ORDER BY node_path) - 1 AS x FROM cv o WHERE NOT EXISTS (FROM cv k WHERE k.paper_id = o.paper_id AND k.up = o.node_id)) SELECT cv.paper_id, cv.node_id, (min(lf.x) + max(lf.x)) / 2.0 * 300.0 AS x_pos, any_value(cv.node_depth * 200)::INTEGER AS y_pos FROM cv JOIN lf ON lf.paper_id = cv.paper_id AND list_contains(lf.node_path, cv.node_id) GROUP BY cv.paper_id, cv.node_id",
    "blocks_in_range": "WITH b AS (SELECT DISTINCT paper_id, generation, block_no, doc_order, length(coalesce(text, '')) AS n FROM blocks WHERE doc_order IS NOT NULL), s AS (SELECT *, coalesce(sum(n + 1) OVER (PARTITION BY paper_id, generation ORDER BY doc_order, block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM b), e AS (SELECT paper_id, generation, max(a + n) AS last FROM s WHERE n > 0 GROUP BY ALL), q AS (SELECT paper_id, generation, unnest(range(0, last + 1, 777))::BIGINT AS lo FROM e) SELECT q.paper_id, q.generation, q.lo, s.block_no FROM q JOIN s USING (paper_id, generation) WHERE s.n > 0 AND s.a < q.lo + 500 AND s.a + s.n > q.lo",
    "blocks_under_quads": _TREES + ", bb AS (SELECT DISTINCT paper_id, generation, page_index, block_id, bbox AS v FROM blocks WHERE bbox IS NOT NULL), q AS (SELECT DISTINCT r.retrieval_no, bb.paper_id, bb.generation, bb.page_index, v FROM retrieved_blocks r JOIN bb USING (paper_id, generation, block_id)), h AS (SELECT q.retrieval_no, q.paper_id, q.generation, bb.block_id FROM q JOIN bb USING (paper_id, generation, page_index) WHERE bb.v[1] <= q.v[3] + 2 AND q.v[1] - 2 <= bb.v[3] AND bb.v[2] <= q.v[4] + 2 AND q.v[2] - 2 <= bb.v[4]) SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h o JOIN down d ON d.forest = 'block' AND (d.paper_id, d.generation, d.node_id) = (o.paper_id, o.generation, o.block_id) WHERE o.retrieval_no = h.retrieval_no AND o.block_id <> h.block_id AND list_contains(d.node_path, h.block_id))",
    "scroll_targets": "WITH p AS (SELECT DISTINCT paper_id, generation, page_index, height FROM paper_pages) SELECT b.block_no, round(greatest((SELECT coalesce(sum(o.height * 1.5 + 16), 0) FROM p o WHERE (o.paper_id, o.generation) = (b.paper_id, b.generation) AND o.page_index < b.page_index) + 1.5 * b.bbox[2] - 24, 0), 4) AS scroll_top FROM (SELECT DISTINCT paper_id, generation, page_index, block_no, bbox FROM blocks WHERE bbox IS NOT NULL) b JOIN p USING (paper_id, generation, page_index)",
    "partial_reasons": "SELECT paper_id, generation, 'no text layer on page ' || array_to_string(list_transform(p[1:10], lambda i: (i + 1)::VARCHAR), ', ') || CASE WHEN len(p) > 10 THEN ' and ' || (len(p) - 10) || ' more' ELSE '' END AS reason FROM (SELECT paper_id, generation, list_sort(list(DISTINCT page_index)) AS p FROM paper_pages WHERE NOT has_text_layer GROUP BY ALL)",
    "latest_questions": "SELECT paper_id, node_id, row_number() OVER (PARTITION BY paper_id ORDER BY made, node_id) AS place FROM (SELECT paper_id, node_id, min(created_at) AS made FROM canvas_nodes WHERE node_type IN ('exploration', 'ai_response') GROUP BY paper_id, node_id QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY min(created_at) DESC, node_id DESC) <= 5)",
    "node_summaries": f"SELECT node_id, coalesce(body->>'$.label', 'untitled ' || node_type) AS label, coalesce(body->>'$.status', 'idle') AS status, coalesce(CASE WHEN json_type(body, '$.tags') = 'ARRAY' THEN json_array_length(body, '$.tags') END, 0)::INTEGER AS tags FROM {_BODIES}",
    "cache_keys": "SELECT item_id, sha256('model-a' || chr(31) || coalesce(instruction, '') || chr(31) || coalesce(question, '')) AS cache_key FROM eval_items",
    "kind_report": "SELECT paper_id, generation, string_agg(block_type || ': ' || n, chr(10) ORDER BY n DESC, block_type) AS report FROM (SELECT paper_id, generation, block_type, count(DISTINCT block_no) AS n FROM blocks GROUP BY ALL) GROUP BY ALL",
}
SQL["section_paths"] = "WITH RECURSIVE p AS (" + OTHERS["heading_parents"] + "), w AS (SELECT paper_id, generation, block_id, block_id AS path FROM p WHERE parent_heading IS NULL UNION ALL SELECT p.paper_id, p.generation, p.block_id, w.path || ' > ' || p.block_id FROM w JOIN p ON (p.paper_id, p.generation, p.parent_heading) = (w.paper_id, w.generation, w.block_id)) SELECT paper_id, generation, block_id, path AS section_path FROM w"
