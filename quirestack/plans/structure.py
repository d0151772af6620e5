"""More data-quality rules, over links, sections, payloads and derived values; each returns what violates it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quirestack.functions import geometry as G
from quirestack.functions import normal as N
from quirestack.functions import text as X
from quirestack.operators import layout
from quirestack.plans.analytics import coverage_sql
from quirestack.plans.fields import _id_sql, _normal
from quirestack.session import table

PAPER = ["paper_id", "generation"]


def _blocks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "blocks").select(*PAPER, "block_id", "block_no", *columns).distinct()


def _rows(df: DataFrame, rule: str, record: str = "block_id") -> DataFrame:
    return df.select(F.lit(rule).alias("rule_id"), *PAPER, F.col(record).cast("string").alias("record_id")).distinct()


def unwrapped(c):  # noqa: ANN001, ANN201
    """A JSON text serialised up to three times more, as the text of its object; null for what is no object."""
    for _ in range(3):
        c = F.when(F.ltrim(c).startswith('"'), F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>")[0]).otherwise(c)
    return F.when(F.try_parse_json(c).isNotNull() & F.ltrim(F.regexp_replace(c, "^\\s+", "")).startswith("{"), c)


def _payload(spark: SparkSession, d: str, kinds: list[str], *columns: str) -> DataFrame:
    b = table(spark, d, "blocks").where(F.col("block_type").isin(*kinds) & F.col("payload").isNotNull()).select(*PAPER, "block_id", "block_type", "payload", *columns).distinct()
    return b.withColumn("body", unwrapped(F.col("payload"))).where("body is not null")


def rule_page_size(spark: SparkSession, d: str) -> DataFrame:
    """A page's size is that of its media box in points, sides exchanged where it is turned sideways."""
    p = table(spark, d, "paper_pages").select(*PAPER, "page_id", "width", "height", "rotation", "media_box").distinct()
    box = G.crop_box(F.col("media_box"), F.lit(None).cast("array<double>"))
    size = G.viewport_size(box[2] - box[0], box[3] - box[1], F.lit(1.0), F.col("rotation"))
    off = F.greatest(F.abs(size[0] - F.col("width")), F.abs(size[1] - F.col("height"))) > 1e-6
    return _rows(p.where(off | box.isNull()), "page_size", "page_id")


def rule_page_covered(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of a page that has any cover at least one hundredth of it."""
    b = F.col("bbox")
    boxes = table(spark, d, "blocks").where("bbox is not null").select(*PAPER, "page_index", "block_no", b[0].alias("x0"), b[1].alias("y0"), b[2].alias("x1"), b[3].alias("y1")).distinct()
    pages = table(spark, d, "paper_pages").select(*PAPER, "page_index", "page_id", "width", "height").distinct()
    covered = layout.covered_area(boxes).withColumnRenamed("union_area", "covered")
    return _rows(pages.join(covered, [*PAPER, "page_index"]).where(F.col("covered") < 0.01 * F.col("width") * F.col("height")), "page_covered", "page_id")


def rule_complete_has_confidence(spark: SparkSession, d: str) -> DataFrame:
    """A complete paper has a confidence for itself and for each of its pages."""
    p = table(spark, d, "papers").where("status = 'complete'").select(*PAPER, "confidence").distinct()
    pages = table(spark, d, "paper_pages").where("confidence is null").select(*PAPER).distinct()
    return _rows(p.where("confidence is null").select(*PAPER).union(p.select(*PAPER).join(pages, PAPER, "left_semi")), "complete_has_confidence", "paper_id")


def rule_nested_shares_flow(spark: SparkSession, d: str) -> DataFrame:
    """Flows partition the blocks at the top; a nested block on its parent's page is in its parent's flow."""
    b = _blocks(spark, d, "parent_id", "flow_kind", "page_index")
    up = b.select(*PAPER, F.col("block_id").alias("parent_id"), F.col("flow_kind").alias("up_flow"), F.col("page_index").alias("up_page"))
    return _rows(b.join(up, [*PAPER, "parent_id"]).where("page_index = up_page and flow_kind <> up_flow"), "nested_shares_flow")


def rule_children_ascend(spark: SparkSession, d: str) -> DataFrame:
    """child_ids lists the children of a page and flow by ascending sibling_order."""
    b = _blocks(spark, d, "sibling_order", "page_index", "flow_kind")
    listed = table(spark, d, "blocks").select(*PAPER, "block_id", "child_ids").distinct().select(*PAPER, "block_id", F.posexplode("child_ids").alias("at", "child_id")).where("child_id is not null")
    own = listed.join(b.select(*PAPER, F.col("block_id").alias("child_id"), "sibling_order", "page_index", "flow_kind"), [*PAPER, "child_id"])
    w = W.partitionBy(*PAPER, "block_id", "page_index", "flow_kind").orderBy("at")
    return _rows(own.withColumn("before", F.lag("sibling_order").over(w)).where("before > sibling_order"), "children_ascend")


def rule_title_in_source(spark: SparkSession, d: str) -> DataFrame:
    """A paper's title stands in one of its title blocks after both are brought to the normal form; so does nothing in a block without text."""
    p = table(spark, d, "papers").where("metadata.title is not null").select(*PAPER, F.col("metadata.title").alias("title")).distinct()
    t = table(spark, d, "blocks").where("block_type = 'title'").select(*PAPER, "text").distinct().withColumn("shown", N.normal_text("text"))
    shown = t.groupBy(*PAPER).agg(F.collect_set("shown").alias("shown"))
    p = p.withColumn("wanted", N.normal_text("title")).join(shown, PAPER)
    return _rows(p.where(~F.exists("shown", lambda s: F.contains(s, F.col("wanted")))), "title_in_source", "paper_id")


def rule_payload_ids_resolve(spark: SparkSession, d: str) -> DataFrame:
    """caption_block and referenced_by in a payload name blocks of the same paper and generation."""
    p = _payload(spark, d, ["figure", "table", "equation"])
    named = F.from_json("body", "caption_block string, referenced_by array<string>")
    ids = F.concat(F.array(named["caption_block"]), F.coalesce(named["referenced_by"], F.array()))
    listed = p.select(*PAPER, "block_id", F.explode(F.filter(ids, lambda x: x.isNotNull())).alias("named"))
    return _rows(listed.join(_blocks(spark, d).select(*PAPER, F.col("block_id").alias("named")), [*PAPER, "named"], "left_anti"), "payload_ids_resolve")


def rule_parent_relations_agree(spark: SparkSession, d: str) -> DataFrame:
    """A parent_of relation agrees with the parent that the child itself names."""
    r = table(spark, d, "relations").where("rel_type = 'parent_of'").select(*PAPER, "from_block", "to_block").distinct()
    b = _blocks(spark, d, "parent_id").select(*PAPER, F.col("block_id").alias("to_block"), "parent_id")
    return _rows(r.join(b, [*PAPER, "to_block"]).where("parent_id is null or parent_id <> from_block"), "parent_relations_agree", "to_block")


def rule_section_listed_once(spark: SparkSession, d: str) -> DataFrame:
    """No heading opens two sections of one paper."""
    s = table(spark, d, "papers").select(*PAPER, "sections").groupBy(*PAPER).agg(F.max("sections").alias("sections")).select(*PAPER, F.explode("sections").alias("s")).select(*PAPER, F.col("s.heading_block_id").alias("heading"))
    return _rows(s.groupBy(*PAPER, "heading").count().where("count > 1"), "section_listed_once", "heading")


def _edges(spark: SparkSession, d: str, kind: str) -> DataFrame:
    r = table(spark, d, "relations").where(F.col("rel_type") == kind).select(*PAPER, "from_block", "to_block").distinct()
    b = _blocks(spark, d, "page_index", "bbox")
    side = lambda s: b.select(*PAPER, F.col("block_id").alias(f"{s}_block"), F.col("page_index").alias(f"{s}_page"), F.col("bbox").alias(f"{s}_box"))
    return r.join(side("from"), [*PAPER, "from_block"]).join(side("to"), [*PAPER, "to_block"])


def rule_next_page_ascends(spark: SparkSession, d: str) -> DataFrame:
    """What continues on the next page continues on a later one."""
    return _rows(_edges(spark, d, "continues_on_next_page").where("to_page <= from_page"), "next_page_ascends", "from_block")


def rule_next_column_apart(spark: SparkSession, d: str) -> DataFrame:
    """What continues in the next column stays on its page, beside where it was."""
    e = _edges(spark, d, "continues_in_next_column")
    shared = (F.col("from_box")[0] < F.col("to_box")[2]) & (F.col("to_box")[0] < F.col("from_box")[2])
    return _rows(e.where((F.col("from_page") != F.col("to_page")) | shared), "next_column_apart", "from_block")


def rule_grid_cells_agree(spark: SparkSession, d: str) -> DataFrame:
    """Each cell of a table's grid names a cell block of the paper that has the same text."""
    p = _payload(spark, d, ["table"])
    cells = F.from_json("body", "grid struct<cells array<struct<cell_id string, text string>>>")["grid"]["cells"]
    c = p.select(*PAPER, "block_id", F.explode(cells).alias("c")).select(*PAPER, "block_id", F.col("c.cell_id").alias("cell_id"), F.col("c.text").alias("cell_text")).where("cell_id is not null")
    b = _blocks(spark, d, "block_type", "text").select(*PAPER, F.col("block_id").alias("cell_id"), "block_type", "text")
    far = c.join(b, [*PAPER, "cell_id"], "left").where("block_type is null or block_type <> 'table_cell' or not (text <=> cell_text)")
    return _rows(far, "grid_cells_agree", "cell_id")


def rule_complete_has_crops(spark: SparkSession, d: str) -> DataFrame:
    """The figures of a complete paper have an image."""
    p = table(spark, d, "papers").where("status = 'complete'").select(*PAPER).distinct()
    f = _payload(spark, d, ["figure"]).where(F.get_json_object("body", "$.image").isNull())
    return _rows(f.join(p, PAPER, "left_semi"), "complete_has_crops")


def rule_inline_not_displayed(spark: SparkSession, d: str) -> DataFrame:
    """An equation in a line is not set apart."""
    return _rows(_payload(spark, d, ["inline_equation"]).where(F.get_json_object("body", "$.display") == "true"), "inline_not_displayed")


def rule_block_id_recomputes(spark: SparkSession, d: str) -> DataFrame:
    """A block's id comes from its source, page, place on a one-point grid, type and first letters."""
    p = table(spark, d, "papers").select(*PAPER, "source_hash").distinct()
    b = table(spark, d, "blocks").select(*PAPER, "block_id", "page_index", "bbox", "block_type", "text").distinct().withColumn("form", N.normal_text("text")).join(p, PAPER)
    parts = (F.col("source_hash"), F.col("page_index").cast("string"), G.quantise(F.col("bbox")[0]).cast("string"), G.quantise(F.col("bbox")[1]).cast("string"), F.col("block_type"), F.substring(F.coalesce("form", F.lit("")), 1, 8))
    return _rows(b.where(X.base32_id("blk_", 16, *parts) != F.col("block_id")), "block_id_recomputes")


QUERIES = {f.__name__: f for f in (rule_page_size, rule_page_covered, rule_complete_has_confidence, rule_nested_shares_flow, rule_children_ascend, rule_title_in_source, rule_payload_ids_resolve, rule_parent_relations_agree, rule_section_listed_once, rule_next_page_ascends, rule_next_column_apart, rule_grid_cells_agree, rule_complete_has_crops, rule_inline_not_displayed, rule_block_id_recomputes)}


def _sql(rule: str, record: str, body: str) -> str:
    return f"SELECT DISTINCT '{rule}' AS rule_id, x.paper_id, x.generation, {record} AS record_id FROM {body}"


_ON = "(y.paper_id, y.generation) = (x.paper_id, x.generation)"
#: Payloads read through, as the other engine does it.
_BODY = "(SELECT DISTINCT paper_id, generation, block_id, block_type, CASE WHEN json_valid(j3) AND json_type(j3) = 'OBJECT' THEN j3 END AS body FROM (SELECT *, CASE WHEN json_valid(j2) AND json_type(j2) = 'VARCHAR' THEN j2->>'$' ELSE j2 END AS j3 FROM (SELECT *, CASE WHEN json_valid(j1) AND json_type(j1) = 'VARCHAR' THEN j1->>'$' ELSE j1 END AS j2 FROM (SELECT *, CASE WHEN json_valid(payload) AND json_type(payload) = 'VARCHAR' THEN payload->>'$' ELSE payload END AS j1 FROM blocks WHERE payload IS NOT NULL))))"
_GRID = "floor(bbox[{i}] + 0.5)::BIGINT"
_PARTS = f"concat_ws('|', source_hash, page_index, {_GRID.format(i=1)}, {_GRID.format(i=2)}, block_type, substr(coalesce({_normal('text')}, ''), 1, 8))"
SQL = {
    "rule_title_in_source": _sql("title_in_source", "x.paper_id", f"(SELECT DISTINCT paper_id, generation, {_normal('metadata.title')} AS wanted FROM papers WHERE metadata.title IS NOT NULL) x WHERE EXISTS (FROM blocks y WHERE {_ON} AND y.block_type = 'title') AND NOT EXISTS (FROM blocks y WHERE {_ON} AND y.block_type = 'title' AND contains({_normal('y.text')}, x.wanted))"),
    "rule_block_id_recomputes": _sql("block_id_recomputes", "x.block_id", f"(SELECT DISTINCT b.paper_id, b.generation, b.block_id, sha256({_PARTS}) AS h FROM blocks b JOIN papers p ON (p.paper_id, p.generation) = (b.paper_id, b.generation)) x WHERE 'blk_' || {_id_sql('h', 16, 0, 'abcdefghijklmnopqrstuvwxyz234567', 20)} <> x.block_id"),
    "rule_page_size": _sql("page_size", "x.page_id", "paper_pages x WHERE greatest(abs(CASE WHEN rotation IN (90, 270) THEN abs(media_box[4] - media_box[2]) ELSE abs(media_box[3] - media_box[1]) END - width), abs(CASE WHEN rotation IN (90, 270) THEN abs(media_box[3] - media_box[1]) ELSE abs(media_box[4] - media_box[2]) END - height)) > 1e-6"),
    "rule_complete_has_confidence": _sql("complete_has_confidence", "x.paper_id", f"papers x WHERE status = 'complete' AND (confidence IS NULL OR EXISTS (FROM paper_pages y WHERE {_ON} AND y.confidence IS NULL))"),
    "rule_nested_shares_flow": _sql("nested_shares_flow", "x.block_id", f"blocks x JOIN blocks y ON {_ON} AND y.block_id = x.parent_id AND y.page_index = x.page_index WHERE x.flow_kind <> y.flow_kind"),
    "rule_children_ascend": _sql("children_ascend", "x.block_id", "(SELECT paper_id, generation, block_id, sibling_order, lag(sibling_order) OVER (PARTITION BY paper_id, generation, block_id, page_index, flow_kind ORDER BY pos) AS before FROM (SELECT l.paper_id, l.generation, l.block_id, l.pos, b.sibling_order, b.page_index, b.flow_kind FROM (SELECT paper_id, generation, block_id, unnest(child_ids) AS child_id, unnest(range(len(child_ids))) AS pos FROM (SELECT DISTINCT paper_id, generation, block_id, child_ids FROM blocks)) l JOIN (SELECT DISTINCT paper_id, generation, block_id, sibling_order, page_index, flow_kind FROM blocks) b ON (b.paper_id, b.generation, b.block_id) = (l.paper_id, l.generation, l.child_id))) x WHERE x.before > x.sibling_order"),
    "rule_payload_ids_resolve": _sql("payload_ids_resolve", "x.block_id", f"(SELECT paper_id, generation, block_id, unnest(list_append(coalesce(json_extract(body, '$.referenced_by')::VARCHAR[], []), body->>'$.caption_block')) AS named FROM {_BODY} WHERE body IS NOT NULL AND block_type IN ('figure', 'table', 'equation')) x WHERE named IS NOT NULL AND NOT EXISTS (FROM blocks y WHERE {_ON} AND y.block_id = x.named)"),
    "rule_parent_relations_agree": _sql("parent_relations_agree", "x.to_block", f"relations x JOIN blocks y ON {_ON} AND y.block_id = x.to_block WHERE rel_type = 'parent_of' AND y.parent_id IS DISTINCT FROM x.from_block"),
    "rule_section_listed_once": _sql("section_listed_once", "x.heading", "(SELECT paper_id, generation, s.heading_block_id AS heading FROM (SELECT paper_id, generation, unnest(sections) AS s FROM (SELECT paper_id, generation, max(sections) AS sections FROM papers GROUP BY ALL)) GROUP BY ALL HAVING count(*) > 1) x"),
    "rule_next_page_ascends": _sql("next_page_ascends", "x.from_block", f"relations x JOIN blocks y ON {_ON} AND y.block_id = x.from_block JOIN blocks z ON (z.paper_id, z.generation, z.block_id) = (x.paper_id, x.generation, x.to_block) WHERE rel_type = 'continues_on_next_page' AND z.page_index <= y.page_index"),
    "rule_next_column_apart": _sql("next_column_apart", "x.from_block", f"relations x JOIN blocks y ON {_ON} AND y.block_id = x.from_block JOIN blocks z ON (z.paper_id, z.generation, z.block_id) = (x.paper_id, x.generation, x.to_block) WHERE rel_type = 'continues_in_next_column' AND (z.page_index <> y.page_index OR (y.bbox[1] < z.bbox[3] AND z.bbox[1] < y.bbox[3]))"),
    "rule_grid_cells_agree": _sql("grid_cells_agree", "x.cell_id", f"(SELECT paper_id, generation, block_id, c->>'$.cell_id' AS cell_id, c->>'$.text' AS cell_text FROM (SELECT paper_id, generation, block_id, unnest(json_extract(body, '$.grid.cells[*]')) AS c FROM {_BODY} WHERE body IS NOT NULL AND block_type = 'table')) x WHERE x.cell_id IS NOT NULL AND NOT EXISTS (FROM blocks y WHERE {_ON} AND y.block_id = x.cell_id AND y.block_type = 'table_cell' AND y.text IS NOT DISTINCT FROM x.cell_text)"),
    "rule_complete_has_crops": _sql("complete_has_crops", "x.block_id", f"{_BODY} x JOIN papers y ON {_ON} AND y.status = 'complete' WHERE x.body IS NOT NULL AND x.block_type = 'figure' AND x.body->>'$.image' IS NULL"),
    "rule_inline_not_displayed": _sql("inline_not_displayed", "x.block_id", f"{_BODY} x WHERE x.body IS NOT NULL AND x.block_type = 'inline_equation' AND x.body->>'$.display' = 'true'"),
}
_ALL = "(SELECT DISTINCT paper_id, generation, page_index, block_no, bbox[1] AS x0, bbox[2] AS y0, bbox[3] AS x1, bbox[4] AS y1 FROM blocks WHERE bbox IS NOT NULL)"
SQL["rule_page_covered"] = _sql("page_covered", "x.page_id", f"paper_pages x JOIN ({coverage_sql(_ALL)}) y ON (y.paper_id, y.generation, y.page_index) = (x.paper_id, x.generation, x.page_index) WHERE y.union_area < 0.01 * x.width * x.height")
