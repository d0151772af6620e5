"""Queries over disturbed documents and over the parts of records: what survives, and what a record says of itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quirestack.functions import geometry as G
from quirestack.functions import normal as N
from quirestack.functions import text as X
from quirestack.operators import bands as B
from quirestack.operators import perturb as D
from quirestack.plans.structure import _BODY, unwrapped
from quirestack.session import table
from quirestack.sources.documents import PAGE, RELATION, nest, shred

PAPER = ["paper_id", "generation"]


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").where("text is not null and bbox is not null and doc_order is not null")
    return b.select(*PAPER, "page_index", "block_no", "block_type", "doc_order", "text", "bbox").distinct()


def perturbed_geometry(spark: SparkSession, d: str) -> DataFrame:
    """How far jitter of up to 0.6 points moved each box, and whether its id on a one-point grid changed."""
    b = _blocks(spark, d)
    j = D.jittered(b, "block_no", "bbox").select("block_no", F.col("bbox").alias("moved"))
    both = b.join(j, "block_no")
    cell = lambda c: F.array(G.quantise(F.col(c)[0]), G.quantise(F.col(c)[1]))
    far = F.array_max(F.zip_with("bbox", "moved", lambda x, y: F.abs(x - y)))
    return both.select("block_no", (far <= 0.6000001).alias("within"), (far > 0).alias("moved_at_all"), (cell("bbox") != cell("moved")).alias("id_changed"))


def perturbed_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each text after noise on a fifth of them, and how many edits that is."""
    b = _blocks(spark, d)
    n = D.noisy(b, "block_no", "text", 0.2).select("block_no", F.col("text").alias("noisy_text"))
    return b.join(n, "block_no").select("block_no", "noisy_text", F.levenshtein("text", "noisy_text", 4).alias("edits"))


def perturbed_structure(spark: SparkSession, d: str) -> DataFrame:
    """For each page: its blocks, and how many there are after a third were split and after a third were merged."""
    b = _blocks(spark, d)
    page = [*PAPER, "page_index"]
    split = D.split_in_two(b, "block_no", "text", "bbox", 0.33).groupBy(*page).agg(F.count(F.lit(1)).alias("after_split"))
    merged = D.merged(b, page, ["doc_order", "block_no"], "block_no", "text", "bbox", 0.33).groupBy(*page).agg(F.count(F.lit(1)).alias("after_merge"), F.sum("merged_rows").alias("rows_kept"))
    return b.groupBy(*page).agg(F.count(F.lit(1)).alias("blocks")).join(split, page).join(merged, page)


def retyped_share(spark: SparkSession, d: str) -> DataFrame:
    """The share of blocks of each kind that a rate of one tenth retyped."""
    b = _blocks(spark, d)
    r = D.retyped(b, "block_no", "block_type", 0.1, ("paragraph", "list_item", "caption")).select("block_no", F.col("block_type").alias("new_type"))
    return b.join(r, "block_no").groupBy("block_type").agg(F.count(F.lit(1)).alias("blocks"), F.round(F.avg((F.col("new_type") != F.col("block_type")).cast("double")), 6).alias("retyped"))


def run_matches(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of a disturbed run (jitter and noise) found again in the undisturbed one."""
    b = _blocks(spark, d).where("block_type <> 'algorithm'")
    other = D.noisy(D.jittered(b, "block_no", "bbox"), "block_no", "text", 0.2)
    shape = lambda x: x.select(*PAPER, "page_index", F.col("block_no").alias("no"), F.col("bbox").alias("box"), "text")
    m = D.matched_runs(shape(b), shape(other), [*PAPER, "page_index"])
    return m.select("no", (F.col("no") == F.col("other_no")).alias("is_same"))


def id_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Page, grid cell, kind and first eight letters that different blocks of one paper share."""
    b = _blocks(spark, d).withColumn("form", N.normal_text("text"))
    key = F.concat_ws("|", "paper_id", "generation", "page_index", G.quantise(F.col("bbox")[0]).cast("string"), G.quantise(F.col("bbox")[1]).cast("string"), "block_type", F.left(F.col("form"), F.lit(8)))
    return D.collisions(b.select(key.alias("id_key"), "bbox", "form"), "id_key", ["bbox", "form"])


def prefix_lengths(spark: SparkSession, d: str) -> DataFrame:
    """For each paper how many first letters tell its headings apart."""
    h = table(spark, d, "blocks").where("block_type = 'heading' and text is not null").select(*PAPER, "block_no", "text").distinct()
    return D.prefix_floor(h, PAPER, "text", "block_no").select(*PAPER, "prefix_length")


def equation_payloads(spark: SparkSession, d: str) -> DataFrame:
    """What each equation says of itself: set apart, imaged, referred to by how many blocks."""
    e = table(spark, d, "blocks").where("block_type in ('equation', 'inline_equation') and payload is not null").select(*PAPER, "block_id", "payload").distinct().withColumn("body", unwrapped(F.col("payload"))).where("body is not null")
    get = lambda k: F.get_json_object("body", f"$.{k}")
    return e.select(*PAPER, "block_id", (get("display") == "true").alias("is_display"), F.when(get("image").isNull(), "UNAVAILABLE").otherwise("AVAILABLE").alias("image_state"), F.coalesce(F.size(F.from_json(get("referenced_by"), "array<string>")), F.lit(0)).alias("referring"))


def payload_mirrors(spark: SparkSession, d: str) -> DataFrame:
    """The caption of each figure and table as the relations tell it, written into its payload's place."""
    r = table(spark, d, "relations").where("rel_type = 'caption_of'").select(*PAPER, "from_block", F.col("to_block").alias("block_id")).groupBy(*PAPER, "block_id").agg(F.min("from_block").alias("by_relation"))
    f = table(spark, d, "blocks").where("block_type in ('figure', 'table') and payload is not null").select(*PAPER, "block_id", "payload").distinct().withColumn("body", unwrapped(F.col("payload"))).where("body is not null")
    own = F.get_json_object("body", "$.caption_block")
    return f.join(r, [*PAPER, "block_id"], "left").select(*PAPER, "block_id", F.coalesce("by_relation", own).alias("caption_block"), (own.isNotNull() & F.col("by_relation").isNotNull() & (own != F.col("by_relation"))).alias("differs"))


def resolved_citations(spark: SparkSession, d: str) -> DataFrame:
    """What each bracketed label of a block resolves to: the entry of a cites edge if the block has just one, else the one entry that prints the label, else NOT_FOUND or AMBIGUOUS."""
    t = table(spark, d, "blocks").where("text is not null").select(*PAPER, "block_id", "block_type", "text").distinct()
    marks = t.where("block_type <> 'reference_entry'").select(*PAPER, "block_id", F.explode(X.citation_labels("text")).alias("label"))
    labels = t.where("block_type = 'reference_entry'").select(*PAPER, F.col("block_id").alias("entry"), F.regexp_extract("text", r"^\s*\[([0-9]+)\]", 1).alias("label")).where("label <> ''").groupBy(*PAPER, "label").agg(F.min("entry").alias("entry"), F.count(F.lit(1)).alias("n"))
    edges = table(spark, d, "relations").where("rel_type = 'cites'").select(*PAPER, F.col("from_block").alias("block_id"), "to_block").distinct().groupBy(*PAPER, "block_id").agg(F.min("to_block").alias("cited"), F.count(F.lit(1)).alias("k")).where("k = 1")
    out = marks.join(labels, [*PAPER, "label"], "left").join(edges, [*PAPER, "block_id"], "left")
    state = F.when(F.col("cited").isNotNull(), "edge").when(F.col("n") == 1, "label").when(F.col("n") > 1, "AMBIGUOUS").otherwise("NOT_FOUND")
    return out.select(*PAPER, "block_id", "label", state.alias("method"), F.when(state == "edge", F.col("cited")).when(state == "label", F.col("entry")).alias("entry_id"))


def line_flows(spark: SparkSession, d: str) -> DataFrame:
    """The flow that place and look give each block: a page number or a line in the top or bottom twentieth is a header or
    footer, a caption opens as one, a narrow block at the side is in the margin, the rest is body; and the type that follows."""
    pages = table(spark, d, "paper_pages").select(*PAPER, "page_index", "width", "height").distinct()
    b = table(spark, d, "blocks").where("bbox is not null and text is not null").select(*PAPER, "page_index", "block_no", "bbox", "text").distinct().join(pages, [*PAPER, "page_index"])
    x0, y0, x1, y1 = G.edges(F.col("bbox"))
    flow = F.when(X.is_page_number("text") & (y0 > 0.5 * F.col("height")), "footer").when(y1 < 0.05 * F.col("height"), "header").when(y0 > 0.95 * F.col("height"), "footer").when(F.col("text").rlike(X.CAPTION), "caption").when((x1 < 0.15 * F.col("width")) | (x0 > 0.85 * F.col("width")), "margin").otherwise("body")
    b = b.withColumn("flow", flow)
    kind = F.when(F.col("flow").isin("header", "footer"), F.when(X.is_page_number("text"), "page_number").otherwise(F.col("flow"))).when(F.col("flow") == "caption", "caption").when(F.col("text").rlike(X.SECTION) & (F.length("text") < 80), "heading").otherwise("paragraph")
    return b.select("block_no", F.col("flow").alias("derived_flow"), kind.alias("derived_type"))


def page_confidences(spark: SparkSession, d: str) -> DataFrame:
    """The confidence a page's kind gives: whole with a text layer, less by the share of characters that could not be read, little when scanned."""
    t = table(spark, d, "blocks").where("text is not null").select(*PAPER, "page_index", "block_no", "text").distinct().groupBy(*PAPER, "page_index").agg(F.sum(F.length("text")).alias("chars"), F.sum(F.regexp_count("text", F.lit("\\x{FFFD}"))).alias("lost"))
    p = table(spark, d, "paper_pages").select(*PAPER, "page_index", "has_text_layer", "is_scanned").distinct().join(t, [*PAPER, "page_index"], "left")
    share = F.coalesce(F.col("lost") / F.col("chars"), F.lit(0.0))
    base = F.when(F.col("is_scanned"), 0.6).when(F.col("has_text_layer"), 1.0).otherwise(0.8)
    return p.select(*PAPER, "page_index", F.round(base * (1 - share), 6).alias("page_confidence"))


def paper_outline(spark: SparkSession, d: str) -> DataFrame:
    """The entries of each paper's outline in reading order: its headings, the blocks of type title, abstract and author in front of the first, and references."""
    b = table(spark, d, "blocks").where("doc_order is not null").select(*PAPER, "block_id", "block_no", "block_type", "doc_order").distinct()
    w = W.partitionBy(*PAPER).orderBy("doc_order", "block_no").rowsBetween(W.unboundedPreceding, 0)
    b = b.withColumn("section", F.sum((F.col("block_type") == "heading").cast("int")).over(w))
    keep = (F.col("block_type") == "heading") | ((F.col("section") == 0) & F.col("block_type").isin("title", "abstract", "author"))
    place = F.row_number().over(W.partitionBy(*PAPER).orderBy("doc_order", "block_no")).cast("long")
    return b.where(keep).select(*PAPER, "block_id", F.when(F.col("block_type") == "heading", "section").otherwise("front").alias("entry_kind"), place.alias("place"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "blocks").where("flow_kind = 'body' and bbox is not null").select(*PAPER, "page_index", "block_no", F.col("bbox").alias("box")).distinct()


LINES = [*PAPER, "page_index"]


def text_lines(spark: SparkSession, d: str) -> DataFrame:
    """The line of its page on which each body block begins."""
    return B.line_numbers(_spans(spark, d), LINES, "block_no").select("block_no", "line_no")


def line_bands(spark: SparkSession, d: str) -> DataFrame:
    """The band of each line of each page."""
    b = B.line_bands(B.line_numbers(_spans(spark, d), LINES, "block_no"), LINES)
    return b.select(*LINES, "line_no", *(F.round(F.col("band")[i], 4).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))


def line_outlines(spark: SparkSession, d: str) -> DataFrame:
    """The outline of each stack of lines: how many lines and corners it has and how large it is."""
    r = B.stacked_rings(B.line_bands(B.line_numbers(_spans(spark, d), LINES, "block_no"), LINES), LINES)
    return r.select(*LINES, "stack_no", "lines", F.size("ring").alias("corners"), F.round(F.abs(G.signed_area(F.col("ring"))), 4).alias("outline_area"))


def highlight_quads(spark: SparkSession, d: str) -> DataFrame:
    """The boxes of the second tenth of each block's text, laid out over as many lines as its text has."""
    b = table(spark, d, "blocks").where("bbox is not null and length(text) >= 20").select("block_no", "text", "bbox").distinct()
    n = F.size(F.split("text", "\n"))
    lines = b.select("block_no", n.alias("n"), "bbox", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    w = W.partitionBy("block_no").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0))
    step = (F.col("bbox")[3] - F.col("bbox")[1]) / F.col("n")
    lines = lines.withColumn("start", start).select("block_no", "start", (F.col("start") + F.length("line")).alias("end"), F.array(F.col("bbox")[0], F.col("bbox")[1] + step * F.col("i"), F.col("bbox")[2], F.col("bbox")[1] + step * (F.col("i") + 1)).alias("box"))
    tenth = F.floor(F.length("text") / 10)
    asked = b.select("block_no", F.col("block_no").alias("asked_no"), tenth.alias("from_char"), (2 * tenth).alias("to_char"))
    q = B.range_boxes(lines, asked, ["block_no"])
    return q.select(F.col("asked_no").alias("block_no"), F.col("start").cast("long").alias("line_start"), F.round(F.col("quad")[0], 4).alias("quad_left"), F.round(F.col("quad")[2], 4).alias("quad_right"))


def relation_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Relations nested by paper, written as JSON without nulls, and shredded again."""
    n = nest(table(spark, d, "relations"), PAPER, RELATION, "relations").select(*PAPER, F.to_json("relations").alias("j"))
    return shred(n, PAPER, "j", "rel_type string, from_block string, to_block string, confidence double, provenance string").drop("array_position")


def page_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Pages nested by paper and shredded again, with their place in the array."""
    n = nest(table(spark, d, "paper_pages"), PAPER, PAGE, "pages").select(*PAPER, F.to_json("pages").alias("j"))
    return shred(n, PAPER, "j", "page_index int, page_id string, width double, height double, rotation int").select(*PAPER, "array_position", "page_index", "page_id", "width", "height", "rotation")


QUERIES = {f.__name__: f for f in (perturbed_geometry, perturbed_texts, perturbed_structure, retyped_share, run_matches, id_collisions, prefix_lengths, equation_payloads, payload_mirrors, resolved_citations, line_flows, page_confidences, paper_outline, text_lines, line_bands, line_outlines, highlight_quads, relation_round_trip, page_round_trip)}

_T = "(SELECT DISTINCT paper_id, generation, page_index, block_no, block_id, block_type, doc_order, text, bbox FROM blocks)"
_SQL_CAPTION, _SQL_SECTION, _SQL_PAGE = (p.replace("'", "''") for p in (X.CAPTION, X.SECTION, X.PAGE_NUMBER))
#: Lines by recursion over a page's boxes from top to bottom.
_LINES = """WITH RECURSIVE r AS (SELECT paper_id, generation, page_index, block_no, bbox AS v, row_number() OVER (PARTITION BY paper_id, generation, page_index ORDER BY bbox[2], bbox[1], block_no) AS k FROM (SELECT DISTINCT paper_id, generation, page_index, block_no, bbox FROM blocks WHERE flow_kind = 'body' AND bbox IS NOT NULL)),
    l AS (SELECT *, 0 AS line_no, v AS anchor FROM r WHERE k = 1
        UNION ALL SELECT r.paper_id, r.generation, r.page_index, r.block_no, r.v, r.k, CASE WHEN same THEN line_no ELSE line_no + 1 END, CASE WHEN same THEN anchor ELSE r.v END
        FROM (SELECT r.*, l.line_no, l.anchor, least(l.anchor[4] - l.anchor[2], r.v[4] - r.v[2]) > 0 AND least(l.anchor[4], r.v[4]) - greatest(l.anchor[2], r.v[2]) > 0.5 * least(l.anchor[4] - l.anchor[2], r.v[4] - r.v[2]) AS same FROM l JOIN r ON (r.paper_id, r.generation, r.page_index) = (l.paper_id, l.generation, l.page_index) AND r.k = l.k + 1) r)"""
_BANDS = _LINES + """, e AS (SELECT paper_id, generation, page_index, line_no, min(v[1]) AS x0, min(v[2]) AS y0, max(v[3]) AS x1, max(v[4]) AS y1 FROM l GROUP BY ALL), g AS (SELECT paper_id, generation, page_index, floor(gap * 2 + 0.5) / 2 AS pitch, count(*) AS n FROM (SELECT *, y0 - lag(y0) OVER (PARTITION BY paper_id, generation, page_index ORDER BY line_no) AS gap FROM e) WHERE gap > 0 GROUP BY ALL), u AS (SELECT paper_id, generation, page_index, arg_max(pitch, (n, -pitch)) AS pitch FROM g GROUP BY ALL),
    h AS (SELECT e.* REPLACE (CASE WHEN pitch > 0 THEN least(y1, y0 + 1.15 * pitch) ELSE y1 END AS y1) FROM e LEFT JOIN u USING (paper_id, generation, page_index)), n AS (SELECT *, lead(x0) OVER w AS nx0, lead(y0) OVER w AS ny0, lead(x1) OVER w AS nx1 FROM h WINDOW w AS (PARTITION BY paper_id, generation, page_index ORDER BY line_no))"""
SQL = {
    "text_lines": _LINES + " SELECT block_no, line_no::INTEGER AS line_no FROM l",
    "line_bands": _BANDS + " SELECT paper_id, generation, page_index, line_no::INTEGER AS line_no, round(x0, 4) AS x0, round(y0, 4) AS y0, round(x1, 4) AS x1, round(CASE WHEN least(x1, nx1) > greatest(x0, nx0) AND y1 > ny0 AND ny0 > y0 THEN ny0 ELSE y1 END, 4) AS y1 FROM n",
    "relation_round_trip": "SELECT DISTINCT paper_id, generation, rel_type, from_block, to_block, confidence, provenance FROM relations",
    "page_round_trip": "SELECT paper_id, generation, (row_number() OVER (PARTITION BY paper_id, generation ORDER BY page_index) - 1)::INTEGER AS array_position, page_index, page_id, width, height, rotation FROM (SELECT DISTINCT paper_id, generation, page_index, page_id, width, height, rotation FROM paper_pages)",
    "highlight_quads": "WITH b AS (SELECT DISTINCT block_no, text, bbox, string_split(text, chr(10)) AS p, floor(length(text) / 10.0)::BIGINT AS t FROM blocks WHERE bbox IS NOT NULL AND length(text) >= 20), l AS (SELECT block_no, bbox, t, unnest(p) AS line, unnest(range(len(p))) AS i FROM b), s AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY block_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM l) SELECT block_no, a AS line_start, round(bbox[1] + (bbox[3] - bbox[1]) / greatest(length(line), 1) * greatest(t - a, 0), 4) AS quad_left, round(bbox[1] + (bbox[3] - bbox[1]) / greatest(length(line), 1) * (least(2 * t, a + length(line)) - a), 4) AS quad_right FROM s WHERE a < 2 * t AND a + length(line) > t",
    "prefix_lengths": "WITH h AS (SELECT DISTINCT paper_id, generation, text FROM blocks WHERE block_type = 'heading' AND text IS NOT NULL), n AS (SELECT paper_id, generation, k, count(*) AS a, count(DISTINCT left(text, k) || chr(1) || least(length(text), k)) AS b FROM h, (SELECT unnest(range(1, 65)) AS k) GROUP BY ALL) SELECT paper_id, generation, min(k) FILTER (a = b)::INTEGER AS prefix_length FROM n GROUP BY ALL",
    "equation_payloads": f"SELECT paper_id, generation, block_id, body->>'$.display' = 'true' AS is_display, CASE WHEN body->>'$.image' IS NULL THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS image_state, coalesce(json_array_length(body, '$.referenced_by'), 0)::INTEGER AS referring FROM {_BODY} WHERE body IS NOT NULL AND block_type IN ('equation', 'inline_equation')",
    "payload_mirrors": f"WITH f AS (SELECT paper_id, generation, block_id, body->>'$.caption_block' AS own, (SELECT min(from_block) FROM relations r WHERE (r.paper_id, r.generation, r.to_block) = (x.paper_id, x.generation, x.block_id) AND rel_type = 'caption_of') AS by_relation FROM {_BODY} x WHERE body IS NOT NULL AND block_type IN ('figure', 'table')) SELECT paper_id, generation, block_id, coalesce(by_relation, own) AS caption_block, coalesce(own <> by_relation, false) AS differs FROM f",
    "line_flows": f"WITH b AS (SELECT DISTINCT t.*, p.width, p.height FROM {_T} t JOIN (SELECT DISTINCT paper_id, generation, page_index, width, height FROM paper_pages) p USING (paper_id, generation, page_index) WHERE bbox IS NOT NULL AND text IS NOT NULL), f AS (SELECT block_no, text, CASE WHEN regexp_matches(text, '{_SQL_PAGE}') AND bbox[2] > 0.5 * height THEN 'footer' WHEN bbox[4] < 0.05 * height THEN 'header' WHEN bbox[2] > 0.95 * height THEN 'footer' WHEN regexp_matches(text, '{_SQL_CAPTION}') THEN 'caption' WHEN bbox[3] < 0.15 * width OR bbox[1] > 0.85 * width THEN 'margin' ELSE 'body' END AS flow FROM b) SELECT block_no, flow AS derived_flow, CASE WHEN flow IN ('header', 'footer') THEN CASE WHEN regexp_matches(text, '{_SQL_PAGE}') THEN 'page_number' ELSE flow END WHEN flow = 'caption' THEN 'caption' WHEN regexp_matches(text, '{_SQL_SECTION}') AND length(text) < 80 THEN 'heading' ELSE 'paragraph' END AS derived_type FROM f",
    "page_confidences": f"WITH t AS (SELECT paper_id, generation, page_index, sum(length(text)) AS chars, sum(length(text) - length(replace(text, chr(65533), ''))) AS lost FROM {_T} WHERE text IS NOT NULL GROUP BY ALL) SELECT paper_id, generation, page_index, round(CASE WHEN is_scanned THEN 0.6 WHEN has_text_layer THEN 1.0 ELSE 0.8 END::DOUBLE * (1 - coalesce(lost / chars, 0)), 6) AS page_confidence FROM (SELECT DISTINCT paper_id, generation, page_index, has_text_layer, is_scanned FROM paper_pages) p LEFT JOIN t USING (paper_id, generation, page_index)",
    "paper_outline": f"WITH b AS (SELECT *, EXISTS (FROM {_T} h WHERE (h.paper_id, h.generation) = (t.paper_id, t.generation) AND h.block_type = 'heading' AND h.doc_order IS NOT NULL AND (h.doc_order, h.block_no) <= (t.doc_order, t.block_no)) AS inside FROM {_T} t WHERE doc_order IS NOT NULL AND block_type IN ('heading', 'title', 'abstract', 'author')) SELECT paper_id, generation, block_id, CASE WHEN block_type = 'heading' THEN 'section' ELSE 'front' END AS entry_kind, row_number() OVER (PARTITION BY paper_id, generation ORDER BY doc_order, block_no) AS place FROM b WHERE block_type = 'heading' OR NOT inside",
    "resolved_citations": f"WITH t AS (SELECT DISTINCT paper_id, generation, block_id, block_type, text FROM {_T} WHERE text IS NOT NULL), m AS (SELECT DISTINCT paper_id, generation, block_id, unnest(list_filter(flatten(list_transform(regexp_extract_all(text, '\\[([0-9][0-9,\\s–-]*)\\]', 1), lambda m: regexp_split_to_array(m, '[,\\s–-]+'))), lambda x: x <> '')) AS label FROM t WHERE block_type <> 'reference_entry'), e AS (SELECT paper_id, generation, regexp_extract(text, '^\\s*\\[([0-9]+)\\]', 1) AS label, min(block_id) AS entry, count(*) AS n FROM t WHERE block_type = 'reference_entry' GROUP BY ALL HAVING label <> ''), c AS (SELECT paper_id, generation, from_block AS block_id, min(to_block) AS cited FROM relations WHERE rel_type = 'cites' GROUP BY ALL HAVING count(DISTINCT to_block) = 1) SELECT m.paper_id, m.generation, m.block_id, m.label, CASE WHEN cited IS NOT NULL THEN 'edge' WHEN n = 1 THEN 'label' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'NOT_FOUND' END AS method, CASE WHEN cited IS NOT NULL THEN cited WHEN n = 1 THEN entry END AS entry_id FROM m LEFT JOIN e USING (paper_id, generation, label) LEFT JOIN c USING (paper_id, generation, block_id)",
}
