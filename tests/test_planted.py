"""Each rule finds a violation that is planted for it."""

from pathlib import Path

import duckdb
import pytest

from quirestack.plans import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")

B = "(SELECT min(block_no) FROM blocks WHERE bbox IS NOT NULL AND {})"
#: rule: (statements that plant the violation, the record that is found, as SQL on the tables before they run)
PLANTED = {
    "finite_coordinates": ("UPDATE blocks SET bbox = ['nan'::DOUBLE, 1, 2, 3] WHERE block_no = {b}", "block"),
    "ordered_box": ("UPDATE blocks SET bbox = [9.0, 1, 2, 3] WHERE block_no = {b}", "block"),
    "positive_area": ("UPDATE blocks SET bbox = [2.0, 1, 2, 3] WHERE block_no = {b}", "block"),
    "inside_page": ("UPDATE blocks SET bbox = [2.0, 1, 99999, 3] WHERE block_no = {b}", "block"),
    "page_exists": ("UPDATE blocks SET page_index = 999 WHERE block_no = {b}", "block"),
    "unique_ids": ("INSERT INTO blocks SELECT * REPLACE (block_no + 900000 AS block_no) FROM blocks WHERE block_no = {b}", "block"),
    "contiguous_pages": ("UPDATE paper_pages SET page_index = 77 WHERE page_id = (SELECT min(page_id) FROM paper_pages)", "page"),
    "status_reason": ("UPDATE papers SET status = 'partial', partial_reason = NULL WHERE paper_id = (SELECT min(paper_id) FROM papers)", "partial"),
    "relation_from_resolves": ("INSERT INTO relations SELECT * REPLACE ('blk_none' AS from_block) FROM relations LIMIT 1", "blk_none"),
    "relation_to_resolves": ("INSERT INTO relations SELECT * REPLACE ('blk_none' AS to_block) FROM relations LIMIT 1", "blk_none"),
    "parent_resolves": ("UPDATE blocks SET parent_id = 'blk_none' WHERE block_no = {b}", "block"),
    "child_resolves": ("UPDATE blocks SET child_ids = ['blk_none'] WHERE block_no = {b}", "block"),
    "child_names_parent": ("UPDATE blocks SET child_ids = [block_id] WHERE block_no = {b}", "block"),
    "parent_lists_child": ("UPDATE blocks SET parent_id = block_id, child_ids = NULL WHERE block_no = {b}", "block"),
    "unique_relations": ("INSERT INTO relations SELECT * REPLACE (confidence / 2 AS confidence) FROM relations WHERE from_block = (SELECT min(from_block) FROM relations)", "relation"),
    "doc_order_dense": ("UPDATE blocks SET doc_order = 99999 WHERE block_no = {b}", "block"),
    "doc_order_only_body": ("UPDATE blocks SET flow_kind = 'header', doc_order = 3 WHERE block_no = {b}", "block"),
    "doc_order_ascends_pages": ("UPDATE blocks SET page_index = -5 WHERE block_no = (SELECT max(block_no) FROM blocks WHERE doc_order > 3)", "late"),
    "sibling_order_unique": ("INSERT INTO blocks SELECT * REPLACE (block_no + 900000 AS block_no, 'blk_new' AS block_id) FROM blocks WHERE block_no = {b}", "block"),
    "known_flow": ("UPDATE blocks SET flow_kind = 'sideways' WHERE block_no = {b}", "block"),
    "confidence_range": ("UPDATE blocks SET confidence = 1.5 WHERE block_no = {b}", "block"),
    "text_layer_has_hash": ("UPDATE blocks SET source_kind = 'pdf_text_layer', text = 'x', content_hash = NULL WHERE block_no = {b}", "block"),
    "right_angle_rotation": ("UPDATE paper_pages SET rotation = 45 WHERE page_id = (SELECT min(page_id) FROM paper_pages)", "page"),
    "self_parent": ("UPDATE blocks SET parent_id = block_id WHERE block_no = {b}", "block"),
    "caption_endpoints": ("INSERT INTO relations SELECT owner_id, paper_id, generation, 'caption_of', block_id, block_id, 1.0, 'x' FROM blocks WHERE block_no = {b}", "block"),
    "cites_reference_entry": ("INSERT INTO relations SELECT owner_id, paper_id, generation, 'cites', block_id, block_id, 1.0, 'x' FROM blocks WHERE block_no = {b}", "block"),
    "page_size": ("UPDATE paper_pages SET width = width + 5 WHERE page_id = (SELECT min(page_id) FROM paper_pages)", "page"),
    "page_covered": ("DELETE FROM blocks WHERE (paper_id, generation, page_index) = (SELECT (paper_id, generation, page_index) FROM blocks WHERE block_no = {b}) AND block_no <> {b}; UPDATE blocks SET bbox = [1.0, 1, 2, 2] WHERE block_no = {b}", None),
    "complete_has_confidence": ("UPDATE papers SET status = 'complete', confidence = NULL WHERE paper_id = (SELECT min(paper_id) FROM papers)", "paper"),
    "nested_shares_flow": ("UPDATE blocks SET parent_id = block_id WHERE block_no = {b}; INSERT INTO blocks SELECT * REPLACE (block_no + 900000 AS block_no, 'blk_new' AS block_id, 'margin' AS flow_kind) FROM blocks WHERE block_no = {b}", "blk_new"),
    "children_ascend": ("INSERT INTO blocks SELECT * REPLACE (block_no + 900000 AS block_no, 'blk_new' AS block_id, sibling_order + 1 AS sibling_order) FROM blocks WHERE block_no = {b}; UPDATE blocks SET child_ids = ['blk_new', block_id] WHERE block_no = {b}", "block"),
    "title_in_source": ("UPDATE papers SET metadata = struct_update(metadata, title := 'Another title') WHERE paper_id IN (SELECT paper_id FROM blocks WHERE block_type = 'title')", None),
    "payload_ids_resolve": ("UPDATE blocks SET block_type = 'figure', payload = '{{\"caption_block\": \"blk_none\"}}' WHERE block_no = {b}", "block"),
    "parent_relations_agree": ("INSERT INTO relations SELECT owner_id, paper_id, generation, 'parent_of', 'blk_none', block_id, 1.0, 'x' FROM blocks WHERE block_no = {b}", "block"),
    "section_listed_once": ("UPDATE papers SET sections = list_concat(sections, sections) WHERE len(sections) > 0", None),
    "next_page_ascends": ("INSERT INTO relations SELECT owner_id, paper_id, generation, 'continues_on_next_page', block_id, block_id, 1.0, 'x' FROM blocks WHERE block_no = {b}", "block"),
    "next_column_apart": ("INSERT INTO relations SELECT owner_id, paper_id, generation, 'continues_in_next_column', block_id, block_id, 1.0, 'x' FROM blocks WHERE block_no = {b}", "block"),
    "grid_cells_agree": ("UPDATE blocks SET block_type = 'table', payload = '{{\"grid\": {{\"cells\": [{{\"cell_id\": \"blk_none\", \"text\": \"t\"}}]}}}}' WHERE block_no = {b}", "blk_none"),
    "complete_has_crops": ("UPDATE papers SET status = 'complete'; UPDATE blocks SET block_type = 'figure', payload = '\"{{\\\"image\\\": null}}\"' WHERE block_no = {b}", "block"),
    "inline_not_displayed": ("UPDATE blocks SET block_type = 'inline_equation', payload = '{{\"display\": true}}' WHERE block_no = {b}", "block"),
    "text_normalised": ("UPDATE blocks SET text = 'Straße ﬁ', text_normalised = 'straße fi' WHERE block_no = {b}", "block"),
    "content_hash": ("UPDATE blocks SET text = 'x', content_hash = 'sha256:0' WHERE block_no = {b}", "block"),
    "block_id_recomputes": ("UPDATE blocks SET text = 'x' WHERE block_no = {b}", "block"),
    "section_heading_resolves": ("UPDATE papers SET sections = [{{'heading_block_id': 'blk_none', 'section_level': 1, 'parent_heading_block_id': NULL}}] WHERE paper_id = (SELECT min(paper_id) FROM papers)", "blk_none"),
    "section_parent_lower": ("UPDATE papers SET sections = [{{'heading_block_id': 'h1', 'section_level': 2, 'parent_heading_block_id': NULL}}, {{'heading_block_id': 'h2', 'section_level': 2, 'parent_heading_block_id': 'h1'}}] WHERE paper_id = (SELECT min(paper_id) FROM papers)", "h2"),
}


def test_every_rule_has_one():
    assert {f"rule_{r}" for r in PLANTED} == {n for n in registry.queries() if n.startswith("rule_")}


@pytest.mark.parametrize("rule", PLANTED)
def test_planted(spark, tmp_path, rule):
    con = duckdb.connect()
    for t in ("blocks", "papers", "paper_pages", "relations"):
        con.execute(f"CREATE TABLE {t} AS SELECT DISTINCT * FROM read_parquet('{DATA}/{t}.parquet')")
    con.execute("DELETE FROM blocks b WHERE EXISTS (FROM blocks c WHERE c.block_no = b.block_no AND c.ingested_at > b.ingested_at)")
    ask = lambda q: con.execute(q).fetchone()[0]
    b = ask("SELECT min(block_no) FROM blocks WHERE bbox IS NOT NULL AND doc_order > 2 AND flow_kind = 'body' AND text IS NOT NULL")
    records = {"block": ask(f"SELECT block_id FROM blocks WHERE block_no = {b}"), "page": ask("SELECT min(page_id) FROM paper_pages"), "paper": ask("SELECT min(paper_id) FROM papers"), "relation": ask("SELECT min(from_block) FROM relations"), "late": ask("SELECT arg_max(block_id, block_no) FROM blocks WHERE doc_order > 3")}
    statements, record = PLANTED[rule]
    for s in statements.format(b=b).split("; "):
        con.execute(s)
    for t in ("blocks", "papers", "paper_pages", "relations"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    found = {r.record_id for r in registry.queries()[f"rule_{rule}"](spark, str(tmp_path)).collect()}
    assert found if record is None else records.get(record, record) in found
