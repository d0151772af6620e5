"""Queries over single records: normal forms, coordinates, polygons, ids, times and decoded JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirestack.functions import geometry as G
from quirestack.functions import normal as N
from quirestack.functions import records as R
from quirestack.session import table

KEY = ["paper_id", "generation", "block_id"]


def _texts(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "blocks").where("text is not null").select("paper_id", "generation", "block_id", "block_no", "text", *more).distinct()


def normal_forms(spark: SparkSession, d: str) -> DataFrame:
    """The normal form of each block's text and its hash."""
    return _texts(spark, d).select("block_no", N.normal_text("text").alias("normal_form")).select("block_no", "normal_form", N.content_hash(F.col("normal_form")).alias("normal_hash"))


def _violations(rows: DataFrame, rule: str) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule_id"), "paper_id", "generation", F.col("block_id").alias("record_id")).distinct()


def rule_text_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Blocks whose stored normal form is not that of their text."""
    t = _texts(spark, d, "text_normalised").where("text_normalised is not null").withColumn("form", N.normal_text("text"))
    return _violations(t.where("form <> text_normalised"), "text_normalised")


def rule_content_hash(spark: SparkSession, d: str) -> DataFrame:
    """Blocks whose hash is not that of their text's normal form, or who have a hash and no text."""
    b = table(spark, d, "blocks").where("content_hash is not null").select(*KEY, "text", "content_hash").distinct()
    return _violations(b.withColumn("made", N.content_hash(N.normal_text("text"))).where("made is null or made <> content_hash"), "content_hash")


def match_forms(spark: SparkSession, d: str) -> DataFrame:
    """The form in which quotes are compared, and where its first and last characters came from."""
    m = _texts(spark, d).select("block_no", N.matching("text").alias("m"))
    return m.select("block_no", F.col("m.form").alias("match_form"), F.col("m.places")[0].alias("first_place"), F.element_at("m.places", -1).alias("end_place"))


def quote_contexts(spark: SparkSession, d: str) -> DataFrame:
    """For each retrieved text the words around its middle third."""
    r = table(spark, d, "retrieved_blocks").where("length(text) > 30").select("retrieval_no", "text").distinct()
    a, z = F.floor(F.length("text") / 3).cast("int"), F.floor(2 * F.length("text") / 3).cast("int")
    return r.select("retrieval_no", N.context("text", a, z, F.lit(32)).alias("c")).select("retrieval_no", "c.before", "c.after")


def page_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """Each page's media box read from the top left after rotation, its corner brought there and back, and its frame."""
    p = table(spark, d, "paper_pages").where("rotation in (0, 90, 180, 270) and media_box is not null").select("paper_id", "generation", "page_index", "media_box", "rotation").distinct()
    p = p.withColumn("crop", G.crop_box(F.col("media_box"), F.lit(None).cast("array<double>"))).where("crop is not null")
    turn, crop = F.col("rotation"), F.col("crop")
    corner = F.array(crop[0] + 10, crop[1] + 20)
    box = G.moved_box(F.col("media_box"), lambda x: G.from_raw(x, crop, turn))
    there = G.from_raw(corner, crop, turn)
    back = G.to_raw(there, crop, turn)
    return p.select("paper_id", "generation", "page_index", *(F.round(box[i], 4).alias(f"m{i}") for i in range(4)), F.round(there[0], 4).alias("x"), F.round(there[1], 4).alias("y"), (F.abs(back[0] - corner[0]) + F.abs(back[1] - corner[1]) < 1e-6).alias("comes_back"))


def viewport_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Each block's box on a surface turned by 90 degrees at one and a half times the page's size, as an overlay, and its way back."""
    pages = table(spark, d, "paper_pages").where("user_unit > 0").select("paper_id", "generation", "page_index", "width", "height", "user_unit").distinct()
    b = table(spark, d, "blocks").where("bbox is not null").select("paper_id", "generation", "page_index", "block_no", "bbox").distinct().join(pages, ["paper_id", "generation", "page_index"])
    scale, turn = G.viewport_scale(F.lit(1.5), F.col("user_unit")), F.lit(90)
    seen = G.moved_box(F.col("bbox"), lambda x: G.to_viewport(x, F.col("width"), F.col("height"), scale, turn))
    b = b.withColumn("seen", seen)
    back = G.moved_box(F.col("seen"), lambda x: G.from_viewport(x, F.col("width"), F.col("height"), scale, turn))
    o, size = G.overlay(F.col("seen")), G.viewport_size(F.col("width"), F.col("height"), scale, turn)
    near = F.forall(F.zip_with(back, G.ordered(F.col("bbox")), lambda x, y: F.abs(x - y) < 1e-6), lambda ok: ok)
    return b.select("block_no", *(F.round(o[n], 4).alias(f"{n}_px") for n in ("left", "top", "width", "height")), F.round(size[0], 4).alias("surface_width"), near.alias("comes_back"))


def meeting_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Body blocks of a page whose outlines share a point, edges included."""
    b = table(spark, d, "blocks").where("flow_kind = 'body' and bbox is not null").select("paper_id", "generation", "page_index", "block_no", "bbox").distinct()
    other = b.select("paper_id", "generation", "page_index", F.col("block_no").alias("other_no"), F.col("bbox").alias("box"))
    pairs = b.join(other, ["paper_id", "generation", "page_index"]).where((F.col("block_no") < F.col("other_no")) & G.boxes_meet(F.col("bbox"), F.col("box")))
    return pairs.where(G.polygons_meet(G.ring(F.col("bbox")), G.ring(F.col("box")))).select("block_no", "other_no")


def cell_outlines(spark: SparkSession, d: str) -> DataFrame:
    """The outline of each grid cell in a table's payload: its extent, its area, whether it crosses itself, and as SVG."""
    from quirestack.plans.records import p1_objects

    cells = p1_objects(spark, d).where(F.col("object_path").rlike("^/grid/cells/[0-9]+$"))
    ring = F.from_json("object_text", "polygon array<array<double>>")["polygon"]
    c = cells.select("paper_id", "generation", "record_id", "object_path", ring.alias("ring")).where("ring is not null and size(ring) > 2")
    e = G.extent(F.col("ring"))
    return c.select("paper_id", "generation", F.col("record_id").alias("block_id"), "object_path", F.round(F.abs(G.signed_area(F.col("ring"))), 4).alias("outline_area"), G.polygon_is_simple(F.col("ring")).alias("is_simple"), G.box_is_extent(e, F.col("ring")).alias("box_fits"), G.svg_points(F.col("ring")).alias("svg"))


def derived_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of papers and pages that come from their content, the scope of their vectors, and the shape of stored ids."""
    p = table(spark, d, "papers").select("owner_id", "paper_id", "generation", "source_hash", "created_at").distinct()
    return p.select("paper_id", "generation", "owner_id", R.paper_key(F.col("owner_id"), F.col("source_hash")).alias("derived_paper"), R.page_key(F.col("source_hash"), F.lit(0)).alias("first_page"), R.scope_key(F.col("owner_id"), F.col("paper_id"), F.col("generation")).alias("vector_scope"), R.is_id(F.col("paper_id"), "ppr_").alias("well_formed"), F.substring(R.ulid(F.col("created_at"), F.col("paper_id")), 1, 10).alias("ulid_time"), R.generation(F.col("generation")).alias("valid_generation"))


def shifted_times(spark: SparkSession, d: str) -> DataFrame:
    """When each paper's record has to be confirmed again (365 days) and when it may go (90 days)."""
    p = table(spark, d, "papers").select("paper_id", "generation", "created_at").distinct().withColumn("at", R.iso_text(F.col("created_at")))
    return p.select("paper_id", "generation", F.col("at").alias("created_text"), R.shifted(F.col("at"), 365).alias("confirm_by"), R.shifted(F.col("at"), 90).alias("keep_until"))


def vector_blobs(spark: SparkSession, d: str) -> DataFrame:
    """Each vector as bytes of 32-bit floats; vectors of another width have none."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return e.select("vec_id", F.hex(F.substring(R.checked_vector(F.col("embedding"), 64), 1, 4)).alias("first_float"), F.octet_length(R.checked_vector(F.col("embedding"), 64)).alias("blob_bytes"), R.checked_vector(F.col("embedding"), 768).isNull().alias("other_width"))


def decoded_children(spark: SparkSession, d: str) -> DataFrame:
    """child_ids written as a JSON text and read back."""
    b = table(spark, d, "blocks").select("block_no", "child_ids").distinct().withColumn("as_text", R.json_array(F.col("child_ids")))
    return b.select("block_no", "as_text", F.size(R.strings(F.col("as_text"))).alias("children"))


def node_contracts(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each canvas node's data: label and status have to be texts, tags an array, and the page a number if there is one."""
    n = table(spark, d, "canvas_nodes").where("node_data is not null").select("node_id", "node_data").distinct()
    faults = R.contract(F.col("node_data"), {"label": "string", "status": "string", "tags": "array", "page_number?": "integer"})
    return n.select("node_id", F.array_join(faults, "; ").alias("faults"))


def zooms(spark: SparkSession, d: str) -> DataFrame:
    """The zoom that fits each page into a window of 900 by 700, by width and as a whole."""
    p = table(spark, d, "paper_pages").select("paper_id", "generation", "page_index", "width", "height").distinct()
    fit = lambda mode: F.round(G.fit_zoom(F.lit(mode), F.col("width"), F.col("height"), F.lit(900.0), F.lit(700.0), F.lit(9.0)), 6)
    return p.select("paper_id", "generation", "page_index", fit("width").alias("by_width"), fit("page").alias("by_page"), fit("custom").alias("clamped"))


QUERIES = {f.__name__: f for f in (normal_forms, rule_text_normalised, rule_content_hash, match_forms, quote_contexts, page_coordinates, viewport_boxes, meeting_blocks, cell_outlines, derived_ids, shifted_times, vector_blobs, decoded_children, node_contracts, zooms)}

_SPACES = "[\\t\\n\\x{0B}\\x{0C}\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+"


def _normal(c: str) -> str:
    """The normal form as the other engine can say it: simple folding, and the letters whose full folding differs."""
    out = f"nfc_normalize({c})"
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("ĳ", "ij"), ("Ĳ", "IJ")):
        out = f"replace({out}, '{a}', '{b}')"
    out = f"lower(trim(regexp_replace({out}, '{_SPACES}', ' ', 'g'), ' '))"
    for a, b in (("ß", "ss"), ("ς", "σ"), ("ſ", "s"), ("µ", "μ")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


_HEX = "array_to_string(list_transform(range(1, {n} + 1), lambda i: lpad(bin(strpos('0123456789abcdef', substr({h}, i, 1)) - 1), 4, '0')), '')"
_DIGITS = "array_to_string(list_transform(range(0, {n}), lambda k: substr('{a}', list_sum(list_transform(range(1, 6), lambda j: CASE WHEN substr({b}, (k * 5 + j)::INT, 1) = '1' THEN (16 >> (j - 1)::INT) ELSE 0 END))::INT + 1, 1)), '')"


def _id_sql(h: str, digits: int, skip: int, alphabet: str, hexes: int) -> str:
    bits = f"substr({_HEX.format(n=hexes, h=h)}, {skip + 1})"
    return _DIGITS.format(n=digits, a=alphabet, b=bits)


_B = "(SELECT DISTINCT paper_id, generation, block_id, block_no, text, text_normalised, content_hash FROM blocks)"
_TURN = "CASE rotation WHEN 0 THEN {a} WHEN 90 THEN {b} WHEN 180 THEN {c} ELSE {d} END"
SQL = {
    "normal_forms": f"SELECT block_no, n AS normal_form, 'sha256:' || sha256(n) AS normal_hash FROM (SELECT DISTINCT block_no, {_normal('text')} AS n FROM blocks WHERE text IS NOT NULL)",
    "rule_text_normalised": f"SELECT DISTINCT 'text_normalised' AS rule_id, paper_id, generation, block_id AS record_id FROM {_B} WHERE text IS NOT NULL AND text_normalised IS NOT NULL AND {_normal('text')} <> text_normalised",
    "rule_content_hash": f"SELECT DISTINCT 'content_hash' AS rule_id, paper_id, generation, block_id AS record_id FROM {_B} WHERE content_hash IS NOT NULL AND (text IS NULL OR 'sha256:' || sha256({_normal('text')}) <> content_hash)",
    "page_coordinates": "WITH p AS (SELECT DISTINCT paper_id, generation, page_index, rotation, least(media_box[1], media_box[3]) AS a, least(media_box[2], media_box[4]) AS b, greatest(media_box[1], media_box[3]) AS c, greatest(media_box[2], media_box[4]) AS e FROM paper_pages WHERE rotation IN (0, 90, 180, 270) AND media_box IS NOT NULL), q AS (SELECT *, c - a AS w, e - b AS h FROM p WHERE c > a AND e > b) SELECT paper_id, generation, page_index, 0.0::DOUBLE AS m0, 0.0::DOUBLE AS m1, round(CASE WHEN rotation IN (90, 270) THEN h ELSE w END, 4) AS m2, round(CASE WHEN rotation IN (90, 270) THEN w ELSE h END, 4) AS m3, round("
    + _TURN.format(a="10", b="20", c="w - 10", d="h - 20") + ", 4)::DOUBLE AS x, round(" + _TURN.format(a="h - 20", b="10", c="20", d="w - 10") + ", 4)::DOUBLE AS y, true AS comes_back FROM q",
    "viewport_boxes": "WITH p AS (SELECT DISTINCT paper_id, generation, page_index, width, height, user_unit FROM paper_pages WHERE user_unit > 0), b AS (SELECT DISTINCT paper_id, generation, page_index, block_no, bbox FROM blocks WHERE bbox IS NOT NULL) SELECT block_no, round((height - greatest(bbox[2], bbox[4])) * 1.5 * user_unit, 4) AS left_px, round(least(bbox[1], bbox[3]) * 1.5 * user_unit, 4) AS top_px, round(abs(bbox[4] - bbox[2]) * 1.5 * user_unit, 4) AS width_px, round(abs(bbox[3] - bbox[1]) * 1.5 * user_unit, 4) AS height_px, round(height * 1.5 * user_unit, 4) AS surface_width, true AS comes_back FROM b JOIN p USING (paper_id, generation, page_index)",
    "meeting_blocks": "WITH b AS (SELECT DISTINCT paper_id, generation, page_index, block_no, bbox AS v FROM blocks WHERE flow_kind = 'body' AND bbox IS NOT NULL) SELECT a.block_no, c.block_no AS other_no FROM b a JOIN b c USING (paper_id, generation, page_index) WHERE a.block_no < c.block_no AND least(a.v[3], c.v[3]) >= greatest(a.v[1], c.v[1]) AND least(a.v[4], c.v[4]) >= greatest(a.v[2], c.v[2])",
    "derived_ids": f"SELECT paper_id, generation, owner_id, 'ppr_' || {_id_sql('h1', 26, 6, '0123456789ABCDEFGHJKMNPQRSTVWXYZ', 34)} AS derived_paper, 'pg_' || {_id_sql('h2', 16, 0, 'abcdefghijklmnopqrstuvwxyz234567', 20)} AS first_page, concat(owner_id, '/', paper_id, '@', generation) AS vector_scope, regexp_full_match(paper_id, 'ppr_[0-9A-HJKMNP-TV-Z]{{26}}') AS well_formed, array_to_string(list_transform(range(0, 10), lambda k: substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', (((epoch_us(created_at) // 1000) >> (45 - 5 * k)::INT) & 31)::INT + 1, 1)), '') AS ulid_time, CASE WHEN generation >= 1 THEN generation END AS valid_generation FROM (SELECT DISTINCT paper_id, generation, owner_id, created_at, sha256(owner_id || ':' || source_hash) AS h1, sha256(source_hash || '|0') AS h2 FROM papers)",
    "shifted_times": "SELECT paper_id, generation, strftime(t, '%Y-%m-%dT%H:%M:%S.%gZ') AS created_text, strftime(t + INTERVAL 365 DAY, '%Y-%m-%dT%H:%M:%S.%gZ') AS confirm_by, strftime(t + INTERVAL 90 DAY, '%Y-%m-%dT%H:%M:%S.%gZ') AS keep_until FROM (SELECT DISTINCT paper_id, generation, created_at::TIMESTAMP AS t FROM papers)",
    "decoded_children": "SELECT DISTINCT block_no, '[' || coalesce(array_to_string(list_transform(child_ids, lambda x: coalesce('\"' || x || '\"', 'null')), ','), '') || ']' AS as_text, coalesce(len(list_filter(child_ids, lambda x: x IS NOT NULL)), 0)::INTEGER AS children FROM blocks",
    "zooms": "SELECT DISTINCT paper_id, generation, page_index, round(least(4.0, greatest(0.25, 900.0 / width)), 6) AS by_width, round(least(4.0, greatest(0.25, least(900.0 / width, 700.0 / height))), 6) AS by_page, 4.0::DOUBLE AS clamped FROM paper_pages",
}
