"""Data-quality rules: each is a query that returns what violates it, (rule_id, paper_id, generation, record_id)."""

from __future__ import annotations

from quirestack.plans.relational import duck, expand, query

SELF = "x.paper_id, x.generation, x.block_id"
SAME = "q.paper_id = x.paper_id AND q.generation = x.generation"

#: rule: (base views, what to select as paper_id, generation, record_id[, recursive views])
RULES: dict[str, tuple[str, ...]] = {
    "finite_coordinates": ("g", f"SELECT {SELF} FROM g x WHERE isnan(x.x0) OR isnan(x.y0) OR isnan(x.x1) OR isnan(x.y1)"),
    "ordered_box": ("g", f"SELECT {SELF} FROM g x WHERE x.x0 > x.x1 OR x.y0 > x.y1"),
    "positive_area": ("g", f"SELECT {SELF} FROM g x WHERE (x.x1 - x.x0) * (x.y1 - x.y0) <= 0"),
    "inside_page": ("g pp", f"SELECT {SELF} FROM g x JOIN pp q ON {SAME} AND q.page_index = x.page_index WHERE x.x0 < -1 OR x.y0 < -1 OR x.x1 > q.width + 1 OR x.y1 > q.height + 1"),
    "page_exists": ("b pp", f"SELECT {SELF} FROM b x WHERE NOT EXISTS (SELECT 1 FROM pp q WHERE {SAME} AND q.page_index = x.page_index)"),
    "unique_ids": ("b", "SELECT x.paper_id, x.generation, x.block_id FROM b x GROUP BY x.paper_id, x.generation, x.block_id HAVING count(*) > 1"),
    "contiguous_pages": ("pp", "SELECT x.paper_id, x.generation, x.page_id FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, generation ORDER BY page_index) - 1 AS k FROM pp) x WHERE x.k <> x.page_index"),
    "status_reason": ("p", "SELECT x.paper_id, x.generation, x.status FROM p x WHERE (x.status = 'partial') <> (x.partial_reason IS NOT NULL)"),
    "relation_from_resolves": ("r b", f"SELECT x.paper_id, x.generation, x.from_block FROM r x WHERE NOT EXISTS (SELECT 1 FROM b q WHERE {SAME} AND q.block_id = x.from_block)"),
    "relation_to_resolves": ("r b", f"SELECT x.paper_id, x.generation, x.to_block FROM r x WHERE NOT EXISTS (SELECT 1 FROM b q WHERE {SAME} AND q.block_id = x.to_block)"),
    "parent_resolves": ("b", f"SELECT {SELF} FROM b x WHERE x.parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b q WHERE {SAME} AND q.block_id = x.parent_id)"),
    "child_resolves": ("b k", f"SELECT {SELF} FROM k x WHERE NOT EXISTS (SELECT 1 FROM b q WHERE {SAME} AND q.block_id = x.child_id)"),
    "child_names_parent": ("b k", f"SELECT {SELF} FROM k x JOIN b q ON {SAME} AND q.block_id = x.child_id WHERE q.parent_id IS NULL OR q.parent_id <> x.block_id"),
    "parent_lists_child": ("b k", f"SELECT {SELF} FROM b x WHERE x.parent_id IS NOT NULL AND EXISTS (SELECT 1 FROM b q WHERE {SAME} AND q.block_id = x.parent_id) AND NOT EXISTS (SELECT 1 FROM k q WHERE {SAME} AND q.block_id = x.parent_id AND q.child_id = x.block_id)"),
    "unique_relations": ("r", "SELECT x.paper_id, x.generation, x.from_block FROM r x GROUP BY x.paper_id, x.generation, x.rel_type, x.from_block, x.to_block HAVING count(*) > 1"),
    "doc_order_dense": ("ord", f"SELECT {SELF} FROM ord x WHERE x.reading_rank <> x.doc_order"),
    "doc_order_only_body": ("b", f"SELECT {SELF} FROM b x WHERE x.doc_order IS NOT NULL AND x.flow_kind <> 'body'"),
    "doc_order_ascends_pages": ("ord", f"SELECT {SELF} FROM (SELECT *, lag(page_index) OVER (PARTITION BY paper_id, generation ORDER BY doc_order, block_no) AS before_page FROM ord) x WHERE x.before_page > x.page_index"),
    "sibling_order_unique": ("b", f"SELECT {SELF} FROM (SELECT *, count(*) OVER (PARTITION BY paper_id, generation, page_index, flow_kind, coalesce(parent_id, ''), sibling_order) AS n FROM b) x WHERE x.n > 1"),
    "caption_endpoints": ("r b", f"SELECT x.paper_id, x.generation, x.from_block FROM r x JOIN b q ON {SAME} AND q.block_id = x.from_block WHERE x.rel_type = 'caption_of' AND q.block_type <> 'caption'"),
    "cites_reference_entry": ("r b", f"SELECT x.paper_id, x.generation, x.to_block FROM r x JOIN b q ON {SAME} AND q.block_id = x.to_block WHERE x.rel_type = 'cites' AND q.block_type <> 'reference_entry'"),
    "known_flow": ("b", f"SELECT {SELF} FROM b x WHERE x.flow_kind NOT IN ('body', 'caption', 'footnote', 'header', 'footer', 'margin')"),
    "confidence_range": ("b", f"SELECT {SELF} FROM b x WHERE x.confidence IS NULL OR x.confidence < 0 OR x.confidence > 1"),
    "text_layer_has_hash": ("b", f"SELECT {SELF} FROM b x WHERE x.source_kind = 'pdf_text_layer' AND x.has_text AND x.content_hash IS NULL"),
    "right_angle_rotation": ("pp", "SELECT x.paper_id, x.generation, x.page_id FROM pp x WHERE x.rotation NOT IN (0, 90, 180, 270)"),
    "self_parent": ("b", f"SELECT {SELF} FROM b x WHERE x.parent_id = x.block_id"),
    "section_heading_resolves": ("b s", f"SELECT x.paper_id, x.generation, x.heading_id FROM s x WHERE NOT EXISTS (SELECT 1 FROM b q WHERE {SAME} AND q.block_id = x.heading_id AND q.block_type = 'heading')"),
    "section_parent_lower": ("s", f"SELECT x.paper_id, x.generation, x.heading_id FROM s x JOIN s q ON {SAME} AND q.heading_id = x.parent_heading WHERE q.section_level >= x.section_level"),
}

EXTRA = {
    "k": ("k AS (SELECT DISTINCT paper_id, generation, block_id, child_id FROM blocks LATERAL VIEW explode(child_ids) t AS child_id WHERE child_id IS NOT NULL)", "k AS (SELECT DISTINCT paper_id, generation, block_id, child_id FROM (SELECT paper_id, generation, block_id, unnest(child_ids) AS child_id FROM blocks) t WHERE child_id IS NOT NULL)"),
    "s": ("s AS (SELECT DISTINCT paper_id, generation, e.heading_block_id AS heading_id, e.section_level, e.parent_heading_block_id AS parent_heading FROM (SELECT paper_id, generation, explode(sections) AS e FROM papers) t)", "s AS (SELECT DISTINCT paper_id, generation, e.heading_block_id AS heading_id, e.section_level, e.parent_heading_block_id AS parent_heading FROM (SELECT paper_id, generation, unnest(sections) AS e FROM papers) t)"),
}


def _text(uses: str, body: str, engine: int) -> str:
    """The rule with its base views in front: pruned to what it uses for Spark (engine 0), whole for the other one."""
    names = uses.split()
    more = ", ".join(EXTRA[n][engine] for n in names if n in EXTRA)
    text = expand(" ".join(n for n in names if n not in EXTRA), "@ " + body, pruned=engine == 0)
    head = text[: text.index("@ ")].strip()
    if more:
        head = f"{head}, {more}" if head else f"WITH {more}"
    return f"{head} {body}"


QUERIES = {}
SQL = {}


def _body(rule: str, body: str) -> str:
    """The rule's rows under common names, each once."""
    head, _, rest = body.partition(" FROM ")
    columns = [c.strip() for c in head.removeprefix("SELECT ").split(",")]
    return f"SELECT DISTINCT '{rule}' AS rule_id, {columns[0]} AS paper_id, {columns[1]} AS generation, {columns[2]} AS record_id FROM {rest}"


for _rule, (_uses, _sql) in RULES.items():
    QUERIES[f"rule_{_rule}"] = query(_text(_uses, _body(_rule, _sql), 0))
    SQL[f"rule_{_rule}"] = duck(_text(_uses, _body(_rule, _sql), 1))


def _counts(engine: int) -> str:
    """Violations by rule; every rule keeps base views of its own, so none reads another's columns."""
    return "SELECT rule_id, CAST(count(*) AS BIGINT) AS violations FROM (" + " UNION ALL ".join(f"SELECT * FROM ({_text(u, _body(r, q), engine)}) AS t_{r}" for r, (u, q) in RULES.items()) + ") t GROUP BY rule_id"


QUERIES["violations_by_rule"] = query(_counts(0))
SQL["violations_by_rule"] = duck(_counts(1))
