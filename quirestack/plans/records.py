"""Queries over nested records and parent-child trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quirestack.operators.hierarchy import descendants, hierarchy, tree_paths
from quirestack.operators.nested import nested_objects
from quirestack.session import table

RECORD = ["record_kind", "paper_id", "generation", "record_id"]


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "blocks").select(F.lit("block").alias("record_kind"), "paper_id", "generation", F.col("block_id").alias("record_id"), F.col("payload").alias("body"))
    nodes = table(spark, d, "canvas_nodes").select(F.lit("canvas").alias("record_kind"), "paper_id", F.lit(0).alias("generation"), F.col("node_id").alias("record_id"), F.col("node_data").alias("body"))
    # repeated deliveries are dropped before parsing
    return blocks.union(nodes).where(F.col("body").isNotNull()).distinct()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nested_objects(_payloads(spark, d), "body", RECORD).select(*RECORD, "parent_path", "object_path")


def p1_objects(spark: SparkSession, d: str) -> DataFrame:
    """Every nested object with its link, place and text: the table from which typed tables are read."""
    return nested_objects(_payloads(spark, d), "body", RECORD, with_text=True)


def p1_cells(spark: SparkSession, d: str) -> DataFrame:
    """Table cells as a flat table, tied to the grid that holds them."""
    cells = p1_objects(spark, d).where(F.col("object_path").rlike("^/grid/cells/[0-9]+$"))
    body = F.from_json("object_text", "cell_id string, r int, c int, text string, is_header boolean")
    return cells.select(*RECORD, "parent_path", "object_path", body.alias("cell")).select(*RECORD, "parent_path", "object_path", "cell.cell_id", F.col("cell.r").alias("row_no"), F.col("cell.c").alias("col_no"), F.col("cell.text").alias("cell_text"), F.col("cell.is_header"))


def p1_figure_panels(spark: SparkSession, d: str) -> DataFrame:
    """Figure panels as a flat table with their labels and sources."""
    panels = p1_objects(spark, d).where(F.col("object_path").rlike("^/panels/[0-9]+$"))
    body = F.from_json("object_text", "label string, source string, confidence double")
    return panels.select(*RECORD, "object_path", "array_position", body.alias("panel")).select(*RECORD, "object_path", "array_position", F.col("panel.label").alias("panel_label"), F.col("panel.source").alias("panel_source"), F.col("panel.confidence").alias("panel_confidence"))


#: Flat tables of the other shapes: name, where its objects stand, and its columns as (name, JSON path, type).
SHAPES: dict[str, tuple[str, tuple[tuple[str, str, str], ...]]] = {
    "p1_symbols": ("/symbols/[0-9]+", (("symbol", "symbol", "string"), ("definition_block", "definition_block", "string"), ("section_depth", "scope.section.level", "int"))),
    "p1_detected_labels": ("/detected_labels/[0-9]+", (("label_text", "text", "string"), ("label_source", "source", "string"), ("label_confidence", "confidence", "double"), ("font_face", "style.font.face", "string"), ("font_size", "style.font.size", "int"))),
    "p1_images": ("(?:/[^/]+)*/image", (("image_uri", "uri", "string"), ("image_width", "width", "int"), ("image_height", "height", "int"), ("crop_x", "crop.origin.x", "int"), ("crop_y", "crop.origin.y", "int"))),
    "p1_footnotes": ("/grid/cells/[0-9]+/footnotes/[0-9]+", (("mark", "mark", "string"), ("target_block", "target.block", "string"))),
    "p1_source_refs": ("/source_refs/[0-9]+", (("source_block", "block_id", "string"), ("source_page", "page", "int"))),
    "p1_quads": ("/source_refs/[0-9]+/quads/[0-9]+", (("box_width", "box.w", "int"), ("box_height", "box.h", "int"))),
    "p1_thread": ("/thread/[0-9]+", (("role", "role", "string"),)),
    "p1_thread_parts": ("/thread/[0-9]+/parts/[0-9]+", (("part_kind", "kind", "string"), ("part_body", "body", "string"), ("target_block", "target.block_id", "string"), ("span_start", "target.span.start", "int"), ("span_end", "target.span.end", "int"))),
}


def _shape(name: str):  # noqa: ANN202
    where, columns = SHAPES[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        found = p1_objects(spark, d).where(F.col("object_path").rlike(f"^{where}$"))
        return found.select(*RECORD, "parent_path", "object_path", *(F.get_json_object("object_text", f"$.{path}").try_cast(kind).alias(column) for column, path, kind in columns))

    run.__name__, run.__doc__ = name, f"The objects at {where} as a flat table, tied to what holds them."
    return run


TREE = ["forest", "paper_id", "generation"]


def _forests(spark: SparkSession, d: str) -> DataFrame:
    blocks = hierarchy(table(spark, d, "blocks"), ["paper_id", "generation"], "block_id", "parent_id", latest="ingested_at")
    nodes = hierarchy(table(spark, d, "canvas_nodes"), ["paper_id"], "node_id", "parent_id", "children_ids", latest="ingested_at")
    return blocks.select(F.lit("block").alias("forest"), "*").union(nodes.select(F.lit("canvas").alias("forest"), "paper_id", F.lit(0).alias("generation"), "node_id", "link_parent", "root_id", "node_depth"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _forests(spark, d).select(*TREE, "node_id", "root_id", "node_depth")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    return tree_paths(_forests(spark, d), TREE)


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(tree_paths(_forests(spark, d), TREE), TREE)


def p2_cycles(spark: SparkSession, d: str) -> DataFrame:
    """The nodes set apart because their way upwards ends in a cycle."""
    return _forests(spark, d).where(F.col("node_depth") < 0).select(*TREE, "node_id", "root_id")


def ancestors_of_block(spark: SparkSession, d: str) -> DataFrame:
    """Every ancestor of every block, for trees of any depth; blocks whose way up is a cycle have none."""
    return p2_descendants(spark, d).where("forest = 'block'").select("paper_id", "generation", F.col("descendant_id").alias("block_id"), F.col("node_id").alias("ancestor_id"), "distance")


def top_level_ancestor(spark: SparkSession, d: str) -> DataFrame:
    """The first block of each block's tree, with the section the block stands under: the nearest heading above it."""
    paths = p2_paths(spark, d).where("forest = 'block' and node_depth >= 0")
    return paths.select("paper_id", "generation", F.col("node_id").alias("block_id"), F.col("node_path")[0].alias("top_id"), "node_depth")


def preorder_rank(spark: SparkSession, d: str) -> DataFrame:
    """Canvas nodes in pre-order, siblings by id: the place of each node in its tree's thread."""
    paths = p2_paths(spark, d).where("forest = 'canvas' and node_depth >= 0")
    w = W.partitionBy("paper_id", "root_id").orderBy("node_path")
    return paths.select("paper_id", "root_id", "node_id", (F.row_number().over(w) - 1).cast("long").alias("thread_place"))


def subtree_delete(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each canvas after every diagram node and all below it are deleted."""
    doomed = table(spark, d, "canvas_nodes").where("node_type = 'diagram'").select("paper_id", "node_id").distinct()
    below = p2_descendants(spark, d).where("forest = 'canvas'").join(doomed, ["paper_id", "node_id"], "left_semi").select("paper_id", F.col("descendant_id").alias("node_id"))
    return table(spark, d, "canvas_nodes").select("paper_id", "node_id").distinct().join(doomed.union(below).distinct(), ["paper_id", "node_id"], "left_anti")


QUERIES = {f.__name__: f for f in (p1_found, p1_objects, p1_cells, p1_figure_panels, p2_found, p2_paths, p2_descendants, p2_cycles, ancestors_of_block, top_level_ancestor, preorder_rank, subtree_delete)} | {n: _shape(n) for n in SHAPES}

_TREES = """
WITH RECURSIVE b AS (SELECT DISTINCT ON (paper_id, generation, block_id) 'block' AS forest, paper_id, generation, block_id AS node_id, parent_id, NULL::VARCHAR[] AS kids
        FROM blocks ORDER BY paper_id, generation, block_id, ingested_at DESC),
    c AS (SELECT DISTINCT ON (paper_id, node_id) 'canvas' AS forest, paper_id, 0::INTEGER AS generation, node_id, parent_id, children_ids AS kids
        FROM canvas_nodes ORDER BY paper_id, node_id, ingested_at DESC),
    n AS (SELECT * FROM b UNION ALL SELECT * FROM c),
    listed AS (SELECT forest, paper_id, generation, k AS node_id, min(by_id) AS other
        FROM (SELECT forest, paper_id, generation, node_id AS by_id, unnest(kids) AS k FROM n) GROUP BY ALL),
    links AS (SELECT n.forest, n.paper_id, n.generation, n.node_id, coalesce(p.node_id, l.other) AS up
        FROM n LEFT JOIN n p ON (p.forest, p.paper_id, p.generation, p.node_id) = (n.forest, n.paper_id, n.generation, n.parent_id)
        LEFT JOIN listed l ON (l.forest, l.paper_id, l.generation, l.node_id) = (n.forest, n.paper_id, n.generation, n.node_id)),
    down AS (SELECT forest, paper_id, generation, node_id, node_id AS root_id, 0 AS node_depth, [node_id] AS node_path, up FROM links WHERE up IS NULL
        UNION ALL SELECT l.forest, l.paper_id, l.generation, l.node_id, d.root_id, d.node_depth + 1, list_append(d.node_path, l.node_id), l.up
        FROM down d JOIN links l ON (l.forest, l.paper_id, l.generation, l.up) = (d.forest, d.paper_id, d.generation, d.node_id)),
    lost AS (SELECT l.* FROM links l ANTI JOIN down d ON (l.forest, l.paper_id, l.generation, l.node_id) = (d.forest, d.paper_id, d.generation, d.node_id)),
    reach AS (SELECT forest, paper_id, generation, node_id, up AS cur FROM lost
        UNION SELECT r.forest, r.paper_id, r.generation, r.node_id, l.up
        FROM reach r JOIN lost l ON (l.forest, l.paper_id, l.generation, l.node_id) = (r.forest, r.paper_id, r.generation, r.cur)),
    rings AS (SELECT forest, paper_id, generation, node_id FROM reach WHERE node_id = cur),
    cyc AS (SELECT r.forest, r.paper_id, r.generation, r.node_id, min(r.cur) AS root_id FROM reach r
        JOIN rings g ON (g.forest, g.paper_id, g.generation, g.node_id) = (r.forest, r.paper_id, r.generation, r.cur) GROUP BY ALL)
"""

_PLAIN = "CASE WHEN json_valid({0}) AND json_type({0}) = 'VARCHAR' THEN {0}->>'$' ELSE {0} END"
#: The records as objects, read through up to three serialisations, and all objects and arrays in them with their pointers.
_OBJECTS = f"""WITH RECURSIVE raw AS (SELECT DISTINCT 'block' AS record_kind, paper_id, generation, block_id AS record_id, payload AS j0 FROM blocks WHERE payload IS NOT NULL
        UNION ALL SELECT DISTINCT 'canvas', paper_id, 0, node_id, node_data FROM canvas_nodes WHERE node_data IS NOT NULL),
    one AS (SELECT * EXCLUDE j0, {_PLAIN.format('j0')} AS j1 FROM raw), two AS (SELECT * EXCLUDE j1, {_PLAIN.format('j1')} AS j2 FROM one), three AS (SELECT * EXCLUDE j2, {_PLAIN.format('j2')} AS j3 FROM two),
    o AS (SELECT * EXCLUDE j3, j3::JSON AS body, row_number() OVER () AS rid FROM three WHERE json_valid(j3) AND json_type(j3) = 'OBJECT'),
    t AS (SELECT o.rid, j.id, j.parent, j.key, j.type, j.value FROM o, json_tree(o.body) j WHERE j.type IN ('OBJECT', 'ARRAY')),
    p AS (SELECT rid, id, type, value, '' AS ptr, '' AS up FROM t WHERE parent IS NULL
        UNION ALL SELECT t.rid, t.id, t.type, t.value, p.ptr || '/' || replace(replace(t.key, '~', '~0'), '/', '~1'), CASE WHEN p.type = 'OBJECT' THEN p.ptr ELSE p.up END FROM p JOIN t ON t.rid = p.rid AND t.parent = p.id)"""
_RECORD = "record_kind, paper_id, generation::INTEGER AS generation, record_id"

SQL = {
    "p1_found": _OBJECTS + f" SELECT DISTINCT {_RECORD}, up AS parent_path, ptr AS object_path FROM p JOIN o USING (rid) WHERE type = 'OBJECT' AND ptr <> ''",
    "p1_cells": _OBJECTS + f" SELECT {_RECORD}, up AS parent_path, ptr AS object_path, value->>'$.cell_id' AS cell_id, try_cast(value->>'$.r' AS INTEGER) AS row_no, try_cast(value->>'$.c' AS INTEGER) AS col_no, value->>'$.text' AS cell_text, try_cast(value->>'$.is_header' AS BOOLEAN) AS is_header FROM p JOIN o USING (rid) WHERE type = 'OBJECT' AND regexp_full_match(ptr, '/grid/cells/[0-9]+')",
    "p1_figure_panels": _OBJECTS + f" SELECT {_RECORD}, ptr AS object_path, regexp_extract(ptr, '([0-9]+)$', 1)::INTEGER AS array_position, value->>'$.label' AS panel_label, value->>'$.source' AS panel_source, try_cast(value->>'$.confidence' AS DOUBLE) AS panel_confidence FROM p JOIN o USING (rid) WHERE type = 'OBJECT' AND regexp_full_match(ptr, '/panels/[0-9]+')",
    "p2_found": _TREES + "SELECT forest, paper_id, generation, node_id, root_id, node_depth::INTEGER AS node_depth FROM down UNION ALL SELECT forest, paper_id, generation, node_id, root_id, -1 FROM cyc",
    "ancestors_of_block": _TREES + "SELECT paper_id, generation, node_id AS block_id, unnest(node_path[1:-2]) AS ancestor_id, (unnest(range(len(node_path) - 1, 0, -1)))::INTEGER AS distance FROM down WHERE node_depth > 0 AND forest = 'block'",
    "top_level_ancestor": _TREES + "SELECT paper_id, generation, node_id AS block_id, root_id AS top_id, node_depth::INTEGER AS node_depth FROM down WHERE forest = 'block'",
    "preorder_rank": _TREES + "SELECT paper_id, root_id, node_id, row_number() OVER (PARTITION BY paper_id, root_id ORDER BY node_path) - 1 AS thread_place FROM down WHERE forest = 'canvas'",
    "subtree_delete": _TREES + ", gone AS (SELECT paper_id, node_id FROM canvas_nodes WHERE node_type = 'diagram' UNION SELECT d.paper_id, d.node_id FROM down d JOIN canvas_nodes c ON c.paper_id = d.paper_id AND c.node_type = 'diagram' AND list_contains(d.node_path[1:-2], c.node_id) WHERE d.forest = 'canvas') SELECT DISTINCT paper_id, node_id FROM canvas_nodes c WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.paper_id = c.paper_id AND g.node_id = c.node_id)",
    "p2_cycles": _TREES + "SELECT forest, paper_id, generation, node_id, root_id FROM cyc",
    "p2_paths": _TREES + "SELECT d.forest, d.paper_id, d.generation, d.node_id, d.up AS link_parent, d.root_id, d.node_depth::INTEGER AS node_depth, d.node_path FROM down d UNION ALL SELECT c.forest, c.paper_id, c.generation, c.node_id, l.up, c.root_id, -1, NULL FROM cyc c JOIN links l ON (l.forest, l.paper_id, l.generation, l.node_id) = (c.forest, c.paper_id, c.generation, c.node_id)",
    "p2_descendants": _TREES + "SELECT forest, paper_id, generation, unnest(node_path[1:-2]) AS node_id, node_id AS descendant_id, (unnest(range(len(node_path) - 1, 0, -1)))::INTEGER AS distance FROM down WHERE node_depth > 0",
}
_KINDS = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE"}
for _name, (_where, _columns) in SHAPES.items():
    SQL[_name] = _OBJECTS + f" SELECT {_RECORD}, up AS parent_path, ptr AS object_path, {', '.join(f'try_cast(value->>{chr(39)}$.{p}{chr(39)} AS {_KINDS[k]}) AS {c}' for c, p, k in _columns)} FROM p JOIN o USING (rid) WHERE type = 'OBJECT' AND regexp_full_match(ptr, '{_where}')"
