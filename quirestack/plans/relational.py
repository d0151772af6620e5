"""Lookups, joins, aggregations, windows, set operations and state changes over the document tables, as SQL that Spark
plans by itself.  Repeated deliveries of a record count once, so each base view is distinct over a record's key and those
of its columns that the query uses."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("papers", "paper_pages", "blocks", "relations", "retrieved_blocks", "canvas_nodes", "book_sections", "documents", "doc_labels", "eval_items", "events", "embeddings", "customer", "orders", "lineitem", "nation", "region", "supplier", "part")

#: Base view: (key, the record's other columns, table).  A column may be given as "expression AS name".
BASE: dict[str, tuple[str, str, str]] = {
    "b": ("paper_id, generation, block_id, block_no", "owner_id, page_index, block_type, flow_kind, sibling_order, doc_order, parent_id, text, text_normalised, text IS NOT NULL AS has_text, content_hash, source_kind, confidence, created_at", "blocks"),
    "g": ("paper_id, generation, block_id, block_no", "page_index, block_type, flow_kind, doc_order, bbox[0] AS x0, bbox[1] AS y0, bbox[2] AS x1, bbox[3] AS y1", "blocks"),
    "pp": ("paper_id, generation, page_index", "owner_id, page_id, width, height, rotation, user_unit, has_text_layer, is_scanned, confidence", "paper_pages"),
    "p": ("owner_id, paper_id, generation", "source_hash, ir_version, parser_name, parser_version, parser_profile, parsed_at, status, partial_reason, confidence, needs_review, created_at", "papers"),
    "r": ("paper_id, generation, rel_type, from_block, to_block, confidence, provenance", "owner_id", "relations"),
    "n": ("paper_id, node_id", "node_type, pos_x, pos_y, node_data, parent_id, created_at, updated_at", "canvas_nodes"),
    "rb": ("retrieval_no", "question_id, owner_id, paper_id, generation, block_id, ladder_stage, reason, page_index, block_type, flow_kind, text, proposed_repairs, distance, retrieved_at", "retrieved_blocks"),
    "bs": ("section_no", "owner_id, paper_id, section_id, title, section_level, content, model_name, generated_at", "book_sections"),
}
DERIVED = {
    "promoted": "SELECT owner_id, paper_id, min(generation) AS generation FROM papers GROUP BY owner_id, paper_id",
    "ord": "SELECT *, (row_number() OVER (PARTITION BY paper_id, generation ORDER BY doc_order, block_no) - 1) AS reading_rank FROM b WHERE doc_order IS NOT NULL",
}
NEEDS = {"ord": ["b"]}


def views(spark: SparkSession, d: str, text: str) -> None:
    """The input tables that ``text`` names, as temporary views."""
    words = set(re.findall(r"\w+", text))
    for t in TABLES:
        if t in words:
            spark.read.parquet(f"{d}/{t}.parquet").createOrReplaceTempView(t)


def _split(columns: str) -> list[tuple[str, str]]:
    """(name, text) of each column."""
    return [(c.rsplit(" ", 1)[-1], c) for c in columns.split(", ")]


def _base(name: str, words: set[str] | None) -> str:
    """A base view: each record once.  With ``words`` only the key and the columns among them are read and shuffled."""
    key, rest, source = BASE[name]
    columns = _split(key) + [c for c in _split(rest) if words is None or c[0] in words]
    return f"SELECT DISTINCT {', '.join(t for _, t in columns)} FROM {source}"


def expand(uses: str, body: str, recursive: str = "", pruned: bool = True) -> str:
    """``body`` with the base views that it uses in front; ``recursive`` holds recursive views that come after them."""
    names: list[str] = []
    for u in uses.split():
        names += [x for x in (*NEEDS.get(u, []), u) if x not in names]
    words = set(re.findall(r"\w+", " ".join([body, recursive, *(DERIVED[n] for n in names if n in DERIVED)]))) if pruned else None
    parts = [f"{n} AS ({DERIVED[n] if n in DERIVED else _base(n, words)})" for n in names] + ([recursive] if recursive else [])
    if parts and body.startswith("WITH "):
        body = ", " + body[5:]
    return ("WITH " + ("RECURSIVE " if recursive else "") + ", ".join(parts) + " " if parts else "") + body


def duck(text: str) -> str:
    """The few spellings in which the other engine differs: lists count from 1."""
    for i in range(3, -1, -1):
        text = text.replace(f"bbox[{i}]", f"bbox[{i + 1}]")
    return text


def query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        views(spark, d, text)
        return spark.sql(text)

    return run


KEY = "paper_id, generation"
OVERLAP = "greatest(0.0, least(a.x1, c.x1) - greatest(a.x0, c.x0))"
AREA = "greatest(0.0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0.0, least(a.y1, c.y1) - greatest(a.y0, c.y0))"
IOU = f"({AREA}) / nullif((a.x1 - a.x0) * (a.y1 - a.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) - ({AREA}), 0)"
#: name: (base views, body[, recursive views]).  Queries that both engines read as written.
COMMON: dict[str, tuple[str, ...]] = {
    # lookups and projections
    "paper_lookup": ("p", "SELECT owner_id, paper_id, generation, status, source_hash, parser_name, confidence, needs_review FROM p"),
    "generations_of_paper": ("p", "SELECT owner_id, paper_id, generation, CAST(row_number() OVER (PARTITION BY owner_id, paper_id ORDER BY generation) AS BIGINT) AS place FROM p"),
    "promoted_generation": ("p promoted", "SELECT p.owner_id, p.paper_id, p.generation, p.generation = q.generation AS is_promoted FROM p JOIN promoted q ON p.owner_id = q.owner_id AND p.paper_id = q.paper_id"),
    "pages_in_order": ("pp", "SELECT owner_id, paper_id, generation, page_id, page_index, width, height, rotation FROM pp"),
    "block_lookup": ("b promoted", "SELECT b.owner_id, b.paper_id, b.generation, b.block_id, b.block_type, b.text FROM b JOIN promoted q ON b.owner_id = q.owner_id AND b.paper_id = q.paper_id AND b.generation = q.generation"),
    "blocks_in_doc_order": ("ord", "SELECT paper_id, generation, block_id, doc_order, CAST(reading_rank AS BIGINT) AS reading_rank FROM ord"),
    "blocks_on_page": ("b", f"SELECT {KEY}, page_index, block_id, CAST(row_number() OVER (PARTITION BY {KEY}, page_index ORDER BY flow_kind, sibling_order, block_no) AS BIGINT) AS place FROM b"),
    "relations_in_order": ("r", f"SELECT {KEY}, rel_type, from_block, to_block, CAST(row_number() OVER (PARTITION BY {KEY} ORDER BY rel_type, from_block, to_block, provenance, confidence) AS BIGINT) AS place FROM r"),
    "block_location": ("g", f"SELECT {KEY}, block_id, page_index, x0, y0, x1, y1, x1 - x0 AS box_width, y1 - y0 AS box_height FROM g"),
    "visual_regions": ("b", f"SELECT {KEY}, page_index, block_id, block_type FROM b WHERE block_type IN ('figure', 'table', 'equation', 'chart', 'diagram')"),
    "typed_lookup_state": ("b", "SELECT paper_id, generation, block_id, CASE WHEN block_type IN ('equation', 'inline_equation') THEN 'equation' WHEN block_type = 'figure' THEN 'figure' WHEN block_type IN ('table', 'table_row', 'table_cell') THEN 'table' ELSE 'NOT_FOUND' END AS answered_as FROM b"),
    "citation_target_type": ("b", "SELECT DISTINCT block_type, CASE WHEN block_type IN ('equation', 'inline_equation') THEN 'equation' WHEN block_type IN ('figure', 'chart', 'diagram') THEN 'figure' WHEN block_type LIKE 'table%' THEN 'table' WHEN block_type = 'reference_entry' THEN 'reference' ELSE 'text' END AS target_type FROM b"),
    "region_sort_key": ("g", f"SELECT {KEY}, page_index, block_id, CAST(row_number() OVER (PARTITION BY {KEY}, page_index ORDER BY CASE WHEN doc_order IS NULL THEN 1 ELSE 0 END, coalesce(CAST(doc_order AS DOUBLE), y0), x0, y1, block_no) AS BIGINT) AS place FROM g"),
    "channel_privilege": ("b", "SELECT DISTINCT source_kind, source_kind IN ('pdf_text_layer', 'pdf_vector') AND source_kind NOT LIKE '%ocr' AS is_high_privilege FROM b"),
    "page_kind": ("pp b", "SELECT x.paper_id, x.generation, x.page_index, CASE WHEN x.is_scanned THEN 'SCANNED' WHEN x.has_text_layer AND count(b.block_id) > 0 THEN 'DIGITAL' WHEN count(b.block_id) > 0 THEN 'VECTOR_ONLY' WHEN x.is_scanned IS NULL THEN 'UNKNOWN' ELSE 'BLANK' END AS page_kind, CAST(count(b.block_id) AS BIGINT) AS blocks FROM pp x LEFT JOIN b ON b.paper_id = x.paper_id AND b.generation = x.generation AND b.page_index = x.page_index GROUP BY x.paper_id, x.generation, x.page_index, x.is_scanned, x.has_text_layer"),
    "session_rows_alive": ("rb", "SELECT question_id, retrieval_no, retrieved_at FROM rb WHERE retrieved_at IS NULL OR retrieved_at > TIMESTAMP '2025-01-01 00:00:00'"),
    "highlight_search": ("rb", "SELECT retrieval_no, paper_id, page_index, block_type FROM rb WHERE lower(text) LIKE '%sample%'"),
    "job_list": ("", "SELECT user_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS BIGINT) AS newest FROM events"),
    # joins
    "resolve_highlights": ("rb b p", "SELECT rb.question_id, rb.retrieval_no, b.block_id, b.page_index, b.block_type, p.status FROM rb JOIN b ON rb.owner_id = b.owner_id AND rb.paper_id = b.paper_id AND rb.generation = b.generation AND rb.block_id = b.block_id JOIN p ON p.owner_id = b.owner_id AND p.paper_id = b.paper_id AND p.generation = b.generation"),
    "three_way_owner_join": ("", "SELECT c.c_custkey, o.o_orderkey, l.l_linenumber, l.l_quantity FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey"),
    "relations_from_block": ("b r", "SELECT b.paper_id, b.generation, b.block_id, r.rel_type, r.to_block FROM b JOIN r ON b.paper_id = r.paper_id AND b.generation = r.generation AND b.block_id = r.from_block"),
    "relations_to_block": ("b r", "SELECT b.paper_id, b.generation, b.block_id, r.rel_type, r.from_block FROM b JOIN r ON b.paper_id = r.paper_id AND b.generation = r.generation AND b.block_id = r.to_block"),
    "reference_by_label": ("b", f"SELECT {KEY}, label, block_id FROM (SELECT {KEY}, block_id, regexp_extract(text, '^\\\\s*\\\\[([0-9]+)\\\\]', 1) AS label, row_number() OVER (PARTITION BY {KEY}, regexp_extract(text, '^\\\\s*\\\\[([0-9]+)\\\\]', 1) ORDER BY block_no) AS k FROM b WHERE block_type = 'reference_entry') t WHERE k = 1"),
    "children_of_block": ("b", f"SELECT {KEY}, parent_id AS block_id, block_id AS child_id, CAST(row_number() OVER (PARTITION BY {KEY}, parent_id ORDER BY sibling_order, block_id) AS BIGINT) AS place FROM b WHERE parent_id IS NOT NULL"),
    "is_top_level": ("b", "SELECT b.paper_id, b.generation, b.block_id, b.parent_id IS NULL OR q.block_id IS NULL OR q.block_type IN ('title', 'heading') AS top_level FROM b LEFT JOIN b q ON q.paper_id = b.paper_id AND q.generation = b.generation AND q.block_id = b.parent_id"),
    "caption_edges": ("r", "SELECT paper_id, generation, to_block AS owner_block, from_block AS caption_block FROM r WHERE rel_type = 'caption_of' UNION SELECT paper_id, generation, from_block, to_block FROM r WHERE rel_type = 'captioned_by'"),
    "nearest_float": ("g", f"SELECT {KEY}, caption_id, float_id FROM (SELECT a.paper_id, a.generation, a.block_id AS caption_id, c.block_id AS float_id, row_number() OVER (PARTITION BY a.paper_id, a.generation, a.block_id ORDER BY greatest(a.y0 - c.y1, c.y0 - a.y1, 0.0), c.block_no) AS k FROM g a JOIN g c ON a.paper_id = c.paper_id AND a.generation = c.generation AND a.page_index = c.page_index WHERE a.block_type = 'caption' AND c.block_type IN ('figure', 'table') AND {OVERLAP} >= 0.35 * least(a.x1 - a.x0, c.x1 - c.x0) AND greatest(a.y0 - c.y1, c.y0 - a.y1, 0.0) <= 90) t WHERE k = 1"),
    "overlapping_blocks": ("g", f"SELECT a.paper_id, a.generation, a.page_index, a.block_id AS block_a, c.block_id AS block_b, round({IOU}, 6) AS iou FROM g a JOIN g c ON a.paper_id = c.paper_id AND a.generation = c.generation AND a.page_index = c.page_index AND a.flow_kind = c.flow_kind AND a.block_no < c.block_no WHERE {IOU} > 0.3"),
    "best_region_overlap": ("g", f"SELECT a.paper_id, a.page_index, a.block_id, max(round({IOU}, 6)) AS best_iou FROM g a JOIN g c ON a.paper_id = c.paper_id AND a.page_index = c.page_index AND a.block_type = c.block_type AND a.generation = 1 AND c.generation = 2 GROUP BY a.paper_id, a.page_index, a.block_id"),
    "near_misses": ("g", f"SELECT paper_id, page_index, block_id, best_iou FROM (SELECT a.paper_id, a.page_index, a.block_id, max(round({IOU}, 6)) AS best_iou FROM g a JOIN g c ON a.paper_id = c.paper_id AND a.page_index = c.page_index AND a.block_type = c.block_type AND a.generation = 1 AND c.generation = 2 GROUP BY a.paper_id, a.page_index, a.block_id) t WHERE best_iou >= 0.25 AND best_iou < 0.5"),
    "cited_text_gather": ("rb b", "SELECT rb.question_id, rb.block_id, b.text IS NULL AS is_missing FROM rb LEFT JOIN b ON rb.paper_id = b.paper_id AND rb.generation = b.generation AND rb.block_id = b.block_id"),
    "blocks_moved_between_generations": ("b", "SELECT a.paper_id, a.block_id, a.page_index AS old_page, c.page_index AS new_page FROM b a JOIN b c ON a.paper_id = c.paper_id AND a.block_id = c.block_id AND c.generation = a.generation + 1 WHERE a.page_index <> c.page_index"),
    "anchor_by_hash": ("b", "SELECT a.paper_id, a.block_id, min(c.block_id) AS found_id FROM b a JOIN b c ON a.paper_id = c.paper_id AND a.content_hash = c.content_hash AND c.generation = a.generation + 1 GROUP BY a.paper_id, a.generation, a.block_id HAVING count(DISTINCT c.block_id) = 1"),
    # aggregations
    "count_blocks": ("b", f"SELECT owner_id, {KEY}, CAST(count(*) AS BIGINT) AS blocks FROM b GROUP BY owner_id, {KEY}"),
    "paper_counts": ("p pp b r", "SELECT p.paper_id, p.generation, coalesce(x.pages, 0) AS pages, coalesce(y.blocks, 0) AS blocks, coalesce(y.refs, 0) AS refs, coalesce(z.relations, 0) AS relations FROM p LEFT JOIN (SELECT paper_id, generation, CAST(count(*) AS BIGINT) AS pages FROM pp GROUP BY paper_id, generation) x ON x.paper_id = p.paper_id AND x.generation = p.generation LEFT JOIN (SELECT paper_id, generation, CAST(count(*) AS BIGINT) AS blocks, CAST(sum(CASE WHEN block_type = 'reference_entry' THEN 1 ELSE 0 END) AS BIGINT) AS refs FROM b GROUP BY paper_id, generation) y ON y.paper_id = p.paper_id AND y.generation = p.generation LEFT JOIN (SELECT paper_id, generation, CAST(count(*) AS BIGINT) AS relations FROM r GROUP BY paper_id, generation) z ON z.paper_id = p.paper_id AND z.generation = p.generation"),
    "memory_usage": ("bs", "SELECT owner_id, CAST(count(*) AS BIGINT) AS row_count, CAST(coalesce(sum(octet_length(encode(content))), 0) AS BIGINT) AS byte_count FROM bs GROUP BY owner_id"),
    "running_heads": ("b pp", f"SELECT t.paper_id, t.generation, t.head_key, t.pages FROM (SELECT {KEY}, head_key, CAST(count(DISTINCT page_index) AS BIGINT) AS pages FROM (SELECT {KEY}, page_index, regexp_replace(lower(trim(text)), '[0-9]+', '#', 'g') AS head_key FROM b WHERE flow_kind IN ('header', 'footer') AND text IS NOT NULL) h GROUP BY {KEY}, head_key) t JOIN (SELECT {KEY}, count(DISTINCT page_index) AS n FROM pp GROUP BY {KEY}) q ON q.paper_id = t.paper_id AND q.generation = t.generation WHERE t.pages >= greatest(2.0, 0.35 * q.n)"),
    "capability_counts": ("b", f"SELECT {KEY}, CAST(sum(CASE WHEN block_type = 'heading' THEN 1 ELSE 0 END) AS BIGINT) AS headings, CAST(sum(CASE WHEN block_type = 'equation' THEN 1 ELSE 0 END) AS BIGINT) AS equations, CAST(sum(CASE WHEN block_type = 'figure' THEN 1 ELSE 0 END) AS BIGINT) AS figures, CAST(sum(CASE WHEN block_type = 'table' THEN 1 ELSE 0 END) AS BIGINT) AS tables, CAST(sum(CASE WHEN block_type = 'caption' THEN 1 ELSE 0 END) AS BIGINT) AS captions, CAST(sum(CASE WHEN parent_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS nested FROM b GROUP BY {KEY}"),
    "warnings_by_kind": ("p", "SELECT status, coalesce(partial_reason, 'none') AS reason, CAST(count(*) AS BIGINT) AS papers FROM p GROUP BY status, coalesce(partial_reason, 'none')"),
    "annotator_scores": ("", "WITH l AS (SELECT DISTINCT doc_id, annotator, unsafe FROM doc_labels WHERE unsafe IS NOT NULL), m AS (SELECT doc_id, CASE WHEN avg(unsafe) > 0.5 THEN 1 ELSE 0 END AS gold FROM l GROUP BY doc_id), c AS (SELECT l.annotator, CAST(sum(CASE WHEN l.unsafe = 1 AND m.gold = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(l.unsafe) AS BIGINT) AS predicted, CAST(sum(m.gold) AS BIGINT) AS actual FROM l JOIN m ON l.doc_id = m.doc_id GROUP BY l.annotator) SELECT annotator, tp, predicted, actual, CASE WHEN predicted > 0 THEN round(tp / CAST(predicted AS DOUBLE), 6) ELSE 0.0 END AS p, CASE WHEN actual > 0 THEN round(tp / CAST(actual AS DOUBLE), 6) END AS r FROM c"),
    "operational_rates": ("", "SELECT event_type, CAST(count(*) AS BIGINT) AS runs, CAST(sum(CASE WHEN value < 1 THEN 1 ELSE 0 END) AS BIGINT) AS empty_runs, round(sum(CASE WHEN value > 90 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 6) AS failure_rate FROM events GROUP BY event_type"),
    "ratio_intervals": ("", "WITH i AS (SELECT event_type, min(value) AS low, median(value) AS mid, max(value) AS high FROM events WHERE value > 0 GROUP BY event_type) SELECT a.event_type AS slow, c.event_type AS fast, round(a.low / c.high, 6) AS ratio_low, round(a.mid / c.mid, 6) AS ratio_mid, round(a.high / c.low, 4) AS ratio_high, CASE WHEN a.mid / c.mid >= 1 AND a.high / c.low - a.low / c.high <= abs(a.mid / c.mid - 1) THEN 'MET' WHEN a.mid / c.mid < 1 AND a.high / c.low - a.low / c.high <= abs(a.mid / c.mid - 1) THEN 'NOT MET' ELSE 'NOT ESTABLISHED' END AS verdict FROM i a JOIN i c ON a.event_type <> c.event_type"),
    "mode_smallest": ("b", f"SELECT {KEY}, page_index, min(block_type) AS modal_type FROM (SELECT {KEY}, page_index, block_type, rank() OVER (PARTITION BY {KEY}, page_index ORDER BY count(*) DESC) AS k FROM b GROUP BY {KEY}, page_index, block_type) t WHERE k = 1 GROUP BY {KEY}, page_index"),
    "mixes_columns": ("g rb", "SELECT rb.question_id, max(CASE WHEN a.x1 < c.x0 OR c.x1 < a.x0 THEN 1 ELSE 0 END) AS mixes FROM rb JOIN rb s ON rb.question_id = s.question_id AND rb.paper_id = s.paper_id AND rb.generation = s.generation AND rb.page_index = s.page_index AND rb.retrieval_no < s.retrieval_no JOIN g a ON a.paper_id = rb.paper_id AND a.generation = rb.generation AND a.block_id = rb.block_id JOIN g c ON c.paper_id = s.paper_id AND c.generation = s.generation AND c.block_id = s.block_id GROUP BY rb.question_id"),
    "source_rates": ("", "SELECT source, CAST(count(*) AS BIGINT) AS documents, CAST(sum(CASE WHEN text IS NULL OR trim(text) = '' THEN 1 ELSE 0 END) AS BIGINT) AS blank FROM documents GROUP BY source"),
    # windows
    "adjacent_blocks": ("b", f"SELECT {KEY}, block_id, lag(block_id, 1) OVER w AS prev_1, lag(block_id, 2) OVER w AS prev_2, lead(block_id, 1) OVER w AS next_1, lead(block_id, 2) OVER w AS next_2 FROM b WINDOW w AS (PARTITION BY {KEY}, page_index, flow_kind, coalesce(parent_id, '') ORDER BY sibling_order, block_no)"),
    "body_spill": ("ord", f"SELECT {KEY}, block_id, lag(block_id) OVER w AS before_id, lead(block_id) OVER w AS after_id, (lead(page_index) OVER w) - page_index AS pages_on FROM ord WHERE flow_kind = 'body' WINDOW w AS (PARTITION BY {KEY} ORDER BY doc_order, block_no)"),
    "dense_order_per_flow": ("b", f"SELECT {KEY}, block_id, CAST(row_number() OVER (PARTITION BY {KEY}, page_index, flow_kind, coalesce(parent_id, '') ORDER BY sibling_order, block_no) - 1 AS BIGINT) AS dense_order, sibling_order FROM b"),
    "in_references": ("ord", f"SELECT {KEY}, block_id, coalesce(max(CASE WHEN block_type = 'heading' THEN reading_rank END) OVER w, -1) = coalesce(max(CASE WHEN block_type = 'heading' AND lower(text) LIKE '%reference%' THEN reading_rank END) OVER w, -2) AS in_references FROM ord WINDOW w AS (PARTITION BY {KEY} ORDER BY doc_order, block_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
    "section_membership": ("ord", f"SELECT {KEY}, block_id, CAST(sum(CASE WHEN block_type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY {KEY} ORDER BY doc_order, block_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS section_no FROM ord"),
    "page_offsets": ("pp", f"SELECT {KEY}, page_index, coalesce(sum(height + 16) OVER (PARTITION BY {KEY} ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS page_top FROM pp"),
    "stream_offsets": ("ord", f"SELECT {KEY}, block_id, CAST(coalesce(sum(length(coalesce(text, '')) + 1) OVER (PARTITION BY {KEY} ORDER BY doc_order, block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS stream_start FROM ord"),
    "island_grouping": ("g", f"SELECT {KEY}, page_index, block_id, CAST(sum(starts) OVER (PARTITION BY {KEY}, page_index ORDER BY y0, x0, block_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS island FROM (SELECT *, CASE WHEN lag(y1) OVER (PARTITION BY {KEY}, page_index ORDER BY y0, x0, block_no) IS NULL OR y0 - lag(y1) OVER (PARTITION BY {KEY}, page_index ORDER BY y0, x0, block_no) > 12 THEN 1 ELSE 0 END AS starts FROM g) t"),
    "continuation_pairs": ("ord", f"SELECT {KEY}, block_id, next_id FROM (SELECT {KEY}, block_id, text, page_index, lead(block_id) OVER w AS next_id, lead(text) OVER w AS next_text, lead(page_index) OVER w AS next_page FROM ord WHERE block_type = 'paragraph' AND text IS NOT NULL WINDOW w AS (PARTITION BY {KEY} ORDER BY doc_order, block_no)) t WHERE next_page = page_index + 1 AND NOT (text LIKE '%.' OR text LIKE '%!' OR text LIKE '%?') AND substring(next_text, 1, 1) BETWEEN 'a' AND 'z'"),
    # top-k and set operations
    "earliest_due_job": ("", "SELECT user_id, event_type, event_id FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) t WHERE k = 1"),
    "newest_audit_rows": ("", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200"),
    "relations_capped": ("r", f"SELECT {KEY}, rel_type, from_block, to_block FROM (SELECT *, row_number() OVER (PARTITION BY {KEY}, from_block ORDER BY CASE rel_type WHEN 'explains' THEN 0 WHEN 'references' THEN 1 WHEN 'caption_of' THEN 2 ELSE 9 END, rel_type, to_block, provenance, confidence) AS k FROM r WHERE rel_type NOT IN ('parent_of', 'cites')) t WHERE k <= 12"),
    "first_claim_union": ("rb", "SELECT question_id, block_id, ladder_stage, retrieval_no FROM (SELECT *, row_number() OVER (PARTITION BY question_id, block_id ORDER BY CASE ladder_stage WHEN 'selected' THEN 0 WHEN 'adjacency' THEN 1 WHEN 'structure' THEN 2 WHEN 'related' THEN 3 WHEN 'citation' THEN 4 WHEN 'semantic' THEN 5 ELSE 9 END, retrieval_no) AS k FROM rb) t WHERE k = 1"),
    "relation_dedupe": ("r b", "SELECT r.paper_id, r.generation, r.rel_type, r.from_block, r.to_block, max(r.confidence) AS confidence FROM r WHERE EXISTS (SELECT 1 FROM b WHERE b.paper_id = r.paper_id AND b.generation = r.generation AND b.block_id = r.from_block) AND EXISTS (SELECT 1 FROM b WHERE b.paper_id = r.paper_id AND b.generation = r.generation AND b.block_id = r.to_block) GROUP BY r.paper_id, r.generation, r.rel_type, r.from_block, r.to_block"),
    "ids_retired": ("b", "SELECT a.paper_id, a.block_id FROM b a LEFT JOIN b c ON a.paper_id = c.paper_id AND a.block_id = c.block_id AND c.generation = 2 WHERE a.generation = 1 AND c.block_id IS NULL AND a.paper_id IN (SELECT paper_id FROM b WHERE generation = 2)"),
    "channels_distinct": ("b", "SELECT DISTINCT source_kind FROM b WHERE source_kind IN ('ocr', 'pdf_raster')"),
    "caption_association": ("r b", "WITH t AS (SELECT paper_id, generation, from_block, to_block FROM r WHERE rel_type = 'caption_of' INTERSECT SELECT b.paper_id, b.generation, b.block_id, b.parent_id FROM b WHERE b.block_type = 'caption'), f AS (SELECT paper_id, generation, from_block, to_block FROM r WHERE rel_type = 'caption_of' EXCEPT SELECT b.paper_id, b.generation, b.block_id, b.parent_id FROM b WHERE b.block_type = 'caption') SELECT 'agree' AS outcome, CAST(count(*) AS BIGINT) AS links FROM t UNION ALL SELECT 'differ', CAST(count(*) AS BIGINT) FROM f"),
    # state changes, as the state after them
    "upsert_latest_paper": ("p", "SELECT owner_id, paper_id, generation, status FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, paper_id ORDER BY parsed_at DESC, generation DESC) AS k FROM p) t WHERE k = 1"),
    "cascade_delete_blocks": ("b p", "SELECT b.paper_id, b.generation, b.block_id FROM b WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.paper_id = b.paper_id AND p.status = 'failed')"),
    "idempotent_enqueue": ("", "SELECT user_id, min(event_id) AS event_id, event_type FROM events GROUP BY user_id, event_type"),
    "ttl_purge": ("rb", "SELECT question_id, count(*) AS kept FROM rb WHERE retrieved_at > TIMESTAMP '2024-12-01 00:00:00' GROUP BY question_id"),
    "backoff_delay": ("", "SELECT event_id, least(300.0, 2.0 * power(2.0, event_id % 10)) AS delay_s FROM events"),
    "generate_only_missing": ("pp b", "SELECT pp.paper_id, pp.generation, pp.page_index FROM pp WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.paper_id = pp.paper_id AND b.generation = pp.generation AND b.page_index = pp.page_index)"),
}

SQL = {}
QUERIES = {}
for _name, _parts in COMMON.items():
    # the other engine reads whole records, so what is pruned here is compared with what is not
    _text, _whole = expand(*_parts), expand(*_parts, pruned=False)
    QUERIES[_name] = query(_text.replace(", 'g')", ")").replace("encode(content)", "content").replace("encode(coalesce(content, ''))", "coalesce(content, '')"))
    SQL[_name] = duck(_whole).replace("\\\\", "\\")
