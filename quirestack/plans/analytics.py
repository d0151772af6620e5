"""Queries through the DataFrame operators: vectors, packing, grounding, text functions, geometry, outlines, documents, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirestack.functions import geometry as G
from quirestack.functions import normal as N
from quirestack.functions import text as X
from quirestack.operators import layout
from quirestack.operators.anchoring import CONTEXT, resolve, selectors
from quirestack.operators.memory import canonical_json, gated, verbatim
from quirestack.operators.order import longest_prefix, pack
from quirestack.operators.retrieval import greedy_match, nearest_vectors, section_outline, verify_claims
from quirestack.plans.fields import _id_sql, _normal
from quirestack.plans.records import _TREES, p2_paths
from quirestack.session import table
from quirestack.sources.documents import nest_pages, shred_pages
from quirestack.streaming.queue import drain, job_states, read_events, windowed_counts

BUDGETS = {"selected": 2200, "adjacent": 1500, "structure": 1300, "relation": 1100, "citation": 900, "semantic": 600}


def knn_in_partition(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of the same label, for every vector whose number is divisible by 100."""
    e = table(spark, d, "embeddings")
    return nearest_vectors(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", ["label"], 5)


def knn_global(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return nearest_vectors(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", [], 10)


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "retrieved_blocks").select("question_id", "retrieval_no", "ladder_stage", "text").distinct()


def evidence_pack(spark: SparkSession, d: str) -> DataFrame:
    """What of each question's evidence fits its stage's budget, in order of retrieval."""
    return pack(_evidence(spark, d), ["question_id"], "ladder_stage", ["retrieval_no"], "text", BUDGETS, cuttable=("selected",), floor=4)


def evidence_cuts(spark: SparkSession, d: str) -> DataFrame:
    """How many characters are left of each item that was cut to its budget, and that one more would not fit."""
    cut = evidence_pack(spark, d).where("cut_to is not null").join(_evidence(spark, d), ["question_id", "ladder_stage", "retrieval_no"])
    cut = cut.withColumn("kept_chars", longest_prefix(F.col("text"), F.col("cut_to"), 4))
    return cut.select("question_id", "retrieval_no", "cut_to", "kept_chars", (X.estimate_tokens(F.left("text", F.col("kept_chars")), 4) <= F.col("cut_to")).alias("fits"), (X.estimate_tokens(F.left("text", F.col("kept_chars") + 1), 4) > F.col("cut_to")).alias("is_longest"))


def evidence_usage(spark: SparkSession, d: str) -> DataFrame:
    kept = F.col("kept").cast("long")
    return evidence_pack(spark, d).groupBy("question_id", "ladder_stage").agg(F.max("used_after").cast("long").alias("used_tokens"), F.sum(kept).alias("items_kept"), F.sum(1 - kept).alias("items_dropped"))


def evidence_text(spark: SparkSession, d: str) -> DataFrame:
    """The kept evidence of each question and stage as one text."""
    both = evidence_pack(spark, d).where("kept").join(_evidence(spark, d), ["question_id", "ladder_stage", "retrieval_no"])
    item = F.struct("retrieval_no", F.format_string("[%d] %s\n", "retrieval_no", F.coalesce("text", F.lit(""))).alias("t"))
    return both.groupBy("question_id", "ladder_stage").agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["t"]), "").alias("evidence"))


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "retrieved_blocks").select("retrieval_no", X.estimate_tokens("text", 4).cast("long").alias("tokens")).distinct()


def claim_grounding(spark: SparkSession, d: str) -> DataFrame:
    """How much of each held-out question its passage covers, and which numbers it lacks."""
    v = verify_claims(table(spark, d, "eval_items").select("item_id", "question", "passage"), "question", "passage")
    return v.select("item_id", "claim_coverage", F.size("missing_numbers").alias("missing_numbers"), "supported")


def grounding_totals(spark: SparkSession, d: str) -> DataFrame:
    return claim_grounding(spark, d).agg(F.count(F.lit(1)).alias("claims_total"), F.sum((~F.col("supported")).cast("long")).alias("claims_flagged"), F.bool_and("supported").alias("fully_grounded"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "blocks").where("text is not null").select("block_no", "block_type", "text").distinct()


def text_features(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select(
        "block_no", F.array_join(X.citation_labels("text"), ",").alias("labels"), X.caption_kind("text").alias("caption_kind"), X.caption_number("text").alias("caption_number"),
        X.section_number("text").alias("section_number"), X.last_year("text").alias("year_found"), X.is_prose("text").alias("is_prose"), X.furniture_key("text").alias("furniture_key"), X.is_page_number("text").alias("is_page_number"))


def text_cleaning(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("block_no", X.sanitise("text").alias("clean_text"), X.dehyphenate("text").alias("joined_text"), X.truncated("text", 80).alias("short_text"), N.content_hash(N.normal_text("text")).alias("text_hash"), X.mixed_script("text").alias("mixed_script"), X.looks_unterminated("text").alias("unterminated"), X.opens_mid_sentence("text").alias("mid_sentence"), X.three_classes("text").alias("three_classes"), X.is_name_list("text").alias("name_list"), F.round(X.symbol_density("text"), 6).alias("symbol_density"))


def content_token_counts(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "eval_items").select(F.explode(X.content_tokens("passage")).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))


def derived_block_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids from page, place and type on a one-point grid, the way the store derives them."""
    g = table(spark, d, "blocks").select("block_no", "paper_id", "page_index", "bbox", "block_type", "text").distinct().withColumn("form", N.normal_text("text"))
    parts = (F.sha2("paper_id", 256), F.col("page_index").cast("string"), G.quantise(F.col("bbox")[0]).cast("string"), G.quantise(F.col("bbox")[1]).cast("string"), F.col("block_type"), F.substring(F.coalesce("form", F.lit("")), 1, 8))
    return g.select("block_no", X.base32_id("blk_", 16, *parts).alias("derived_id"))


def geometry_features(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "blocks").select("block_no", "bbox").distinct()
    b = F.col("bbox")
    return g.select("block_no", F.round(G.area(b), 6).alias("box_area"), F.round(F.abs(G.signed_area(G.ring(b))), 6).alias("ring_area"), (G.extent(G.ring(b))[2]).alias("right_edge"), G.quantise(b[0], 0.5).alias("grid_x"), G.point_in_polygon((b[0] + b[2]) / 2, (b[1] + b[3]) / 2, G.ring(b)).alias("holds_centre"))


def page_frames(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "paper_pages").select("paper_id", "generation", "page_index", "media_box", "rotation", "user_unit").distinct()
    size = G.page_size(F.col("media_box"), F.col("rotation"), F.col("user_unit"))
    return p.select("paper_id", "generation", "page_index", F.round(size["width"], 4).alias("frame_width"), F.round(size["height"], 4).alias("frame_height"), G.rotation(F.col("rotation")).alias("turn"))


def region_matches(spark: SparkSession, d: str) -> DataFrame:
    """One-to-one matches of the regions of two generations of a page by overlap."""
    g = table(spark, d, "blocks").select("paper_id", "generation", "page_index", "block_type", "block_no", "bbox").distinct()
    a = g.where("generation = 1").select("paper_id", "page_index", "block_type", F.col("block_no").alias("gold_no"), F.col("bbox").alias("a"))
    c = g.where("generation = 2").select("paper_id", "page_index", "block_type", F.col("block_no").alias("found_no"), F.col("bbox").alias("c"))
    pairs = a.join(c, ["paper_id", "page_index", "block_type"]).withColumn("overlap", F.round(G.iou(F.col("a"), F.col("c")), 6)).where("overlap >= 0.5")
    return greedy_match(pairs, ["paper_id", "page_index", "block_type"], "gold_no", "found_no", "overlap")


def heading_parents(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "blocks").where("block_type = 'heading' and doc_order is not null").select("paper_id", "generation", "block_id", "doc_order", "text").distinct()
    level = F.coalesce(F.size(F.split(X.section_number("text"), r"\.")), F.lit(1))
    out = section_outline(h.withColumn("heading_level", level), ["paper_id", "generation"], ["doc_order", "block_id"], "heading_level", "block_id")
    return out.select("paper_id", "generation", "block_id", "heading_level", "parent_heading")


def branch_context(spark: SparkSession, d: str) -> DataFrame:
    """For each canvas node the ids of up to five nodes above it, nearest last."""
    paths = p2_paths(spark, d).where("forest = 'canvas' and node_depth >= 0")
    return paths.select("paper_id", "node_id", F.array_join(F.slice("node_path", F.greatest(F.col("node_depth") - 4, F.lit(1)), F.least(F.col("node_depth"), F.lit(5))), ">").alias("context"))


def nested_pages(spark: SparkSession, d: str) -> DataFrame:
    """Each page as one document with its blocks in order, as JSON."""
    pages = nest_pages(table(spark, d, "blocks"))
    return pages.select("paper_id", "generation", "page_index", F.size("blocks").alias("block_count"), F.to_json("blocks").alias("page_json"))


def nest_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Blocks after nesting into page documents, writing them as JSON and reading that back."""
    return shred_pages(nested_pages(spark, d), "page_json").select("paper_id", "generation", "page_index", "block_id", "block_type", "flow_kind", "sibling_order", "text")


def highlight_export(spark: SparkSession, d: str) -> DataFrame:
    """One Markdown text for each question, with a heading where the page changes."""
    r = table(spark, d, "retrieved_blocks").select("question_id", "retrieval_no", "page_index", "text").distinct()
    item = F.struct("page_index", "retrieval_no", "text")
    rows = r.groupBy("question_id").agg(F.sort_array(F.collect_list(item)).alias("i"))
    line = F.transform("i", lambda x, k: F.concat(F.when((k == 0) | (x["page_index"] != F.col("i")[F.greatest(k - 1, F.lit(0))]["page_index"]), F.concat(F.lit("## Page "), (x["page_index"] + 1).cast("string"), F.lit("\n"))).otherwise(""), F.lit("> "), X.truncated(F.coalesce(x["text"], F.lit("")), 120)))
    return rows.select("question_id", F.array_join(line, "\n").alias("markdown"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("bbox")
    return table(spark, d, "blocks").where("flow_kind = 'body' and bbox is not null").select("paper_id", "generation", "page_index", "block_no", b[0].alias("x0"), b[1].alias("y0"), b[2].alias("x1"), b[3].alias("y1")).distinct()


def page_columns(spark: SparkSession, d: str) -> DataFrame:
    return layout.page_columns(_boxes(spark, d))


def column_order(spark: SparkSession, d: str) -> DataFrame:
    return layout.column_order(_boxes(spark, d))


def suppressed_regions(spark: SparkSession, d: str) -> DataFrame:
    return layout.suppressed(_boxes(spark, d))


def region_clusters(spark: SparkSession, d: str) -> DataFrame:
    return layout.clusters(_boxes(spark, d))


def page_coverage(spark: SparkSession, d: str) -> DataFrame:
    return layout.covered_area(_boxes(spark, d))


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    return selectors(table(spark, d, "blocks").select("paper_id", "generation", "block_no", "block_id", "block_type", "page_index", "bbox", "text", "doc_order").distinct())


def anchor_selectors(spark: SparkSession, d: str) -> DataFrame:
    return _anchors(spark, d).select("block_no", "exact", "prefix", "suffix", "text_hash")


def anchor_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Every block of a first generation, found again in the second where the paper has one."""
    a = _anchors(spark, d)
    new = a.where("generation = 2")
    return resolve(a.where("generation = 1").join(new.select("paper_id").distinct(), "paper_id", "left_semi"), new)


def anchor_rates(spark: SparkSession, d: str) -> DataFrame:
    return anchor_resolution(spark, d).groupBy("tier").agg(F.count(F.lit(1)).alias("anchors"), F.round(F.avg("score"), 6).alias("mean_score"))


def proposal_gates(spark: SparkSession, d: str) -> DataFrame:
    """The gate of each book section as a proposal for its owner's memory, in order of generation."""
    s = table(spark, d, "book_sections").select("section_no", "owner_id", "generated_at", "content").distinct()
    return gated(s.withColumn("content", F.to_json(F.struct(F.col("content").alias("note")))), "owner_id", ["generated_at", "section_no"], "content").select("section_no", "owner_id", "gate")


def evidence_verbatim(spark: SparkSession, d: str) -> DataFrame:
    """Whether each retrieved text still stands in its block."""
    r = table(spark, d, "retrieved_blocks").select("retrieval_no", "paper_id", "generation", "block_id", "text").distinct()
    b = table(spark, d, "blocks").select("paper_id", "generation", "block_id", F.col("text").alias("body")).distinct()
    return r.join(b, ["paper_id", "generation", "block_id"], "left").select("retrieval_no", verbatim(F.col("body"), F.col("text"), F.lit(0)).alias("is_verbatim"))


def canonical_node_data(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "canvas_nodes").select("node_id", "node_data").distinct()
    return n.select("node_id", canonical_json("node_data").alias("canonical_data"))


def float_references(spark: SparkSession, d: str) -> DataFrame:
    """Callouts like "Figure 3" tied to the one captioned block of that kind and number; a number printed twice resolves to none."""
    t = table(spark, d, "blocks").where("text is not null").select("paper_id", "generation", "block_id", "block_type", "text").distinct()
    kind = lambda c: F.when(c.startswith("fig"), "figure").when(c.startswith("tab"), "table").otherwise(c)
    captions = t.where("block_type = 'caption'").select("paper_id", "generation", kind(X.caption_kind("text")).alias("kind"), X.caption_number("text").alias("number"), F.col("block_id").alias("caption_id")).where("kind is not null")
    known = captions.groupBy("paper_id", "generation", "kind", "number").agg(F.min("caption_id").alias("caption_id"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    calls = t.where("block_type <> 'caption'").select("paper_id", "generation", "block_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?i)\b(?:figure|fig\.?|table)\s*[0-9]+"), F.lit(0))).alias("call"))
    calls = calls.select("paper_id", "generation", "block_id", kind(F.lower(F.regexp_extract("call", r"(?i)^(figure|fig|table)", 1))).alias("kind"), F.regexp_extract("call", "([0-9]+)$", 1).alias("number")).distinct()
    return calls.join(known, ["paper_id", "generation", "kind", "number"]).select("paper_id", "generation", "block_id", "kind", "number", "caption_id")


def citation_links(spark: SparkSession, d: str) -> DataFrame:
    """Bracketed markers with the block that has them, exploded by label, and how often a label is cited in its paper."""
    t = table(spark, d, "blocks").where("text is not null").select("paper_id", "generation", "block_id", "text").distinct()
    marks = t.select("paper_id", "generation", "block_id", F.explode(X.citation_labels("text")).alias("label"))
    total = marks.groupBy("paper_id", "generation", "label").agg(F.count(F.lit(1)).alias("cited_by"))
    return marks.join(total, ["paper_id", "generation", "label"])


def paper_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Bibliographic fields, and whether the title stands in the paper's title block after both are normalised."""
    p = table(spark, d, "papers").select("paper_id", "generation", F.col("metadata.title").alias("title"), F.coalesce(F.size("metadata.authors"), F.lit(-1)).alias("author_count"), F.col("metadata.pub_year").alias("pub_year"), F.coalesce("metadata.doi", F.lit("")).alias("doi")).distinct()
    shown = table(spark, d, "blocks").where("block_type = 'title'").select("paper_id", "generation", N.normal_text("text").alias("shown")).groupBy("paper_id", "generation").agg(F.collect_set("shown").alias("shown"))
    p = p.withColumn("wanted", N.normal_text("title"))
    has = F.exists(F.coalesce("shown", F.expr("cast(array() as array<string>)")), lambda x: F.contains(x, F.col("wanted")))
    return p.join(shown, ["paper_id", "generation"], "left").select("paper_id", "generation", "title", "author_count", "pub_year", "doi", F.coalesce(has, F.lit(False)).alias("title_shown"))


def id_churn(spark: SparkSession, d: str) -> DataFrame:
    """The share of derived ids that a shift of up to 0.6 points changes, by block type; the shift comes from the id's hash, so runs agree."""
    g = table(spark, d, "blocks").select("block_no", "block_type", "bbox").distinct()
    shift = (F.pmod(F.xxhash64("block_no"), F.lit(1201)) - 600) / 1000.0
    cell = lambda v: G.quantise(v)
    moved = (cell(F.col("bbox")[0]) != cell(F.col("bbox")[0] + shift)) | (cell(F.col("bbox")[1]) != cell(F.col("bbox")[1] + shift))
    return g.groupBy("block_type").agg(F.count(F.lit(1)).alias("blocks"), F.round(F.avg(moved.cast("double")), 6).alias("churn"))


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = windowed_counts(read_events(spark, d, EVENTS, "events.parquet"), "ts", "event_type")
    out = drain(counts, "update").groupBy("window", "event_type").agg(F.max_by("events", "batch_no").alias("events"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("window_hour"), "event_type", "events")


def stream_job_states(spark: SparkSession, d: str) -> DataFrame:
    states = drain(job_states(read_events(spark, d, EVENTS, "events.parquet"), "user_id", "event_type", "event_id"), "update")
    newest = states.groupBy("key").agg(F.max_by(F.struct("state", "attempts", "last_event"), "batch_no").alias("s"))
    return newest.select(F.col("key").alias("user_id"), "s.state", "s.attempts", "s.last_event")


QUERIES = {f.__name__: f for f in (knn_in_partition, knn_global, evidence_pack, evidence_cuts, evidence_usage, evidence_text, token_estimate, claim_grounding, grounding_totals, text_features, text_cleaning, content_token_counts, derived_block_ids, geometry_features, page_frames, region_matches, heading_parents, branch_context, nested_pages, nest_round_trip, highlight_export, page_columns, column_order, suppressed_regions, region_clusters, page_coverage, anchor_selectors, anchor_resolution, anchor_rates, proposal_gates, evidence_verbatim, canonical_node_data, float_references, citation_links, paper_metadata, id_churn, stream_window_counts, stream_job_states)}

_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_TOKENS = f"list_filter(list_transform(regexp_extract_all(%s, '{X.TOKEN}'), lambda t: trim(lower(t), '._-')), lambda t: t <> '' AND t NOT IN ({_STOP}))"
_DISTANCE = "round(list_distance(a.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6)"
_COST = "coalesce(list_sum(list_transform(regexp_extract_all(text, '(?s)[ \\t]*[A-Za-z0-9]+|.'), lambda a: CASE WHEN regexp_matches(a, '[A-Za-z0-9]$') THEN greatest(1, CAST(ceil(octet_length(encode(a)) / 4.0) AS BIGINT)) ELSE octet_length(encode(a)) END)), 0)::INTEGER"
_LIMITS = "CASE ladder_stage " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in BUDGETS.items()) + " ELSE 0 END"
#: Each stage's items taken one after the other.
_PACK = f"""WITH RECURSIVE i AS (SELECT question_id, ladder_stage, retrieval_no, text, {_COST} AS tokens, {_LIMITS} AS most, row_number() OVER (PARTITION BY question_id, ladder_stage ORDER BY retrieval_no) AS k FROM (SELECT DISTINCT question_id, ladder_stage, retrieval_no, text FROM retrieved_blocks)),
    w AS (SELECT i.*, k AS at, tokens <= most OR (ladder_stage = 'selected' AND most > 0) AS kept, 0 AS used_before, CASE WHEN tokens <= most THEN tokens WHEN ladder_stage = 'selected' THEN most ELSE 0 END AS used_after, CASE WHEN tokens > most AND ladder_stage = 'selected' THEN most END AS cut_to FROM i WHERE k = 1
        UNION ALL SELECT i.*, i.k, w.used_after + i.tokens <= i.most OR (i.ladder_stage = 'selected' AND w.used_after < i.most), w.used_after, CASE WHEN w.used_after + i.tokens <= i.most THEN w.used_after + i.tokens WHEN i.ladder_stage = 'selected' THEN i.most ELSE w.used_after END, CASE WHEN w.used_after + i.tokens > i.most AND i.ladder_stage = 'selected' AND w.used_after < i.most THEN i.most - w.used_after END
        FROM w JOIN i ON i.question_id = w.question_id AND i.ladder_stage = w.ladder_stage AND i.k = w.at + 1)"""
_B = "(SELECT DISTINCT paper_id, generation, page_index, block_no, block_id, block_type, flow_kind, sibling_order, doc_order, parent_id, text, bbox FROM blocks)"
SQL = {
    "evidence_pack": _PACK + " SELECT question_id, ladder_stage, retrieval_no, tokens, kept, used_before::INTEGER AS used_before, used_after::INTEGER AS used_after, cut_to::INTEGER AS cut_to FROM w",
    "evidence_usage": _PACK + " SELECT question_id, ladder_stage, max(used_after)::BIGINT AS used_tokens, count(*) FILTER (kept) AS items_kept, count(*) FILTER (NOT kept) AS items_dropped FROM w GROUP BY ALL",
    "evidence_text": _PACK + " SELECT question_id, ladder_stage, string_agg('[' || retrieval_no || '] ' || coalesce(text, '') || chr(10), '' ORDER BY retrieval_no) AS evidence FROM w WHERE kept GROUP BY ALL",
    "grounding_totals": "@GROUNDING@",
    "branch_context": "@BRANCH@",
    "highlight_export": "SELECT question_id, string_agg(CASE WHEN prior IS DISTINCT FROM page_index THEN '## Page ' || (page_index + 1) || chr(10) ELSE '' END || '> ' || CASE WHEN length(t) > 120 THEN t[1:119] || '…' ELSE t END, chr(10) ORDER BY page_index, retrieval_no) AS markdown FROM (SELECT question_id, page_index, retrieval_no, trim(regexp_replace(coalesce(text, ''), '[\\r\\n]+', ' ', 'g'), ' ') AS t, lag(page_index) OVER (PARTITION BY question_id ORDER BY page_index, retrieval_no) AS prior FROM (SELECT DISTINCT question_id, page_index, retrieval_no, text FROM retrieved_blocks)) GROUP BY question_id",
    "paper_metadata": "WITH p AS (SELECT DISTINCT paper_id, generation, metadata.title AS title, coalesce(len(metadata.authors), -1)::INTEGER AS author_count, metadata.pub_year AS pub_year, coalesce(metadata.doi, '') AS doi FROM papers) SELECT *, EXISTS (FROM blocks b WHERE (b.paper_id, b.generation) = (p.paper_id, p.generation) AND block_type = 'title' AND contains(@TEXT@, @TITLE@)) AS title_shown FROM p",
    "derived_block_ids": "@IDS@",
    "knn_in_partition": f"SELECT query_id, hit_id, distance, place::INTEGER AS place FROM (SELECT a.vec_id AS query_id, c.vec_id AS hit_id, {_DISTANCE} AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DISTANCE}, c.vec_id) AS place FROM embeddings a JOIN embeddings c ON a.label = c.label WHERE a.vec_id % 100 = 0) WHERE place <= 5",
    "knn_global": f"SELECT query_id, hit_id, distance, place::INTEGER AS place FROM (SELECT a.vec_id AS query_id, c.vec_id AS hit_id, {_DISTANCE} AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DISTANCE}, c.vec_id) AS place FROM embeddings a CROSS JOIN embeddings c WHERE a.vec_id % 100 = 0) WHERE place <= 10",
    "token_estimate": "SELECT DISTINCT retrieval_no, coalesce(list_sum(list_transform(regexp_extract_all(text, '(?s)[ \\t]*[A-Za-z0-9]+|.'), lambda a: CASE WHEN regexp_matches(a, '[A-Za-z0-9]$') THEN greatest(1, CAST(ceil(octet_length(encode(a)) / 4.0) AS BIGINT)) ELSE octet_length(encode(a)) END)), 0)::BIGINT AS tokens FROM retrieved_blocks",
    "claim_grounding": f"WITH t AS (SELECT item_id, {_TOKENS % 'question'} AS w, {_TOKENS % 'passage'} AS h FROM eval_items), m AS (SELECT item_id, CASE WHEN len(w) = 0 THEN 1.0 ELSE round(len(list_filter(w, lambda x: list_contains(h, x))) / len(w)::DOUBLE, 6) END AS claim_coverage, len(list_filter(w, lambda x: regexp_matches(x, '{X.NUMERIC}') AND NOT list_contains(h, x)))::INTEGER AS missing_numbers FROM t) SELECT *, claim_coverage >= 0.6 AND missing_numbers = 0 AS supported FROM m",
    "content_token_counts": f"SELECT token, count(*) AS uses FROM (SELECT unnest({_TOKENS % 'passage'}) AS token FROM eval_items) GROUP BY token",
    "geometry_features": "SELECT DISTINCT block_no, round(greatest(bbox[3] - bbox[1], 0) * greatest(bbox[4] - bbox[2], 0), 6) AS box_area, round(abs((bbox[3] - bbox[1]) * (bbox[4] - bbox[2])), 6) AS ring_area, greatest(bbox[1], bbox[3]) AS right_edge, floor(bbox[1] / 0.5 + 0.5)::BIGINT AS grid_x, bbox[1] <> bbox[3] AND bbox[2] <> bbox[4] AS holds_centre FROM blocks",
    "page_frames": "SELECT DISTINCT paper_id, generation, page_index, round(CASE WHEN rotation % 360 IN (90, 270) THEN (media_box[4] - media_box[2]) / user_unit ELSE (media_box[3] - media_box[1]) / user_unit END, 4) AS frame_width, round(CASE WHEN rotation % 360 IN (90, 270) THEN (media_box[3] - media_box[1]) / user_unit ELSE (media_box[4] - media_box[2]) / user_unit END, 4) AS frame_height, rotation % 360 AS turn FROM paper_pages",
    "nest_round_trip": "SELECT DISTINCT paper_id, generation, page_index, block_id, block_type, flow_kind, sibling_order, text FROM blocks",
    "stream_window_counts": "SELECT strftime(ts, '%Y-%m-%d %H') AS window_hour, event_type, count(*) AS events FROM events GROUP BY ALL",
    "evidence_verbatim": "SELECT r.retrieval_no, coalesce(b.body[1:length(r.text)] = r.text, false) AS is_verbatim FROM (SELECT DISTINCT retrieval_no, paper_id, generation, block_id, text FROM retrieved_blocks) r LEFT JOIN (SELECT DISTINCT paper_id, generation, block_id, text AS body FROM blocks) b ON r.paper_id = b.paper_id AND r.generation = b.generation AND r.block_id = b.block_id",
    "citation_links": "WITH t AS (SELECT DISTINCT paper_id, generation, block_id, text FROM blocks WHERE text IS NOT NULL), m AS (SELECT paper_id, generation, block_id, unnest(list_distinct(list_filter(flatten(list_transform(regexp_extract_all(text, '\\[([0-9][0-9,\\s–-]*)\\]', 1), lambda m: regexp_split_to_array(m, '[,\\s–-]+'))), lambda x: x <> ''))) AS label FROM t) SELECT *, count(*) OVER (PARTITION BY paper_id, generation, label) AS cited_by FROM m",
    "float_references": "WITH t AS (SELECT DISTINCT paper_id, generation, block_id, block_type, text FROM blocks WHERE text IS NOT NULL), k AS (SELECT paper_id, generation, CASE WHEN lower(regexp_extract(text, '" + X.CAPTION + "', 1)) LIKE 'fig%' THEN 'figure' ELSE lower(regexp_extract(text, '" + X.CAPTION + "', 1)) END AS kind, regexp_extract(text, '" + X.CAPTION + "', 2) AS number, min(block_id) AS caption_id FROM t WHERE block_type = 'caption' GROUP BY ALL HAVING count(*) = 1), c AS (SELECT DISTINCT paper_id, generation, block_id, CASE WHEN lower(call) LIKE 'fig%' THEN 'figure' ELSE 'table' END AS kind, regexp_extract(call, '([0-9]+)$', 1) AS number FROM (SELECT paper_id, generation, block_id, unnest(regexp_extract_all(text, '(?i)\\b(?:figure|fig\\.?|table)\\s*[0-9]+')) AS call FROM t WHERE block_type <> 'caption')) SELECT c.*, k.caption_id FROM c JOIN k USING (paper_id, generation, kind, number)",
    "heading_parents": "WITH h AS (SELECT DISTINCT paper_id, generation, block_id, doc_order, coalesce(len(string_split(nullif(regexp_extract(text, '" + X.SECTION + "', 1), ''), '.')), 1)::INTEGER AS heading_level FROM blocks WHERE block_type = 'heading' AND doc_order IS NOT NULL), k AS (SELECT a.paper_id, a.generation, a.block_id, a.heading_level, c.block_id AS parent_heading, row_number() OVER (PARTITION BY a.paper_id, a.generation, a.block_id ORDER BY c.doc_order DESC, c.block_id DESC) AS n FROM h a LEFT JOIN h c ON a.paper_id = c.paper_id AND a.generation = c.generation AND (c.doc_order, c.block_id) < (a.doc_order, a.block_id) AND c.heading_level < a.heading_level) SELECT paper_id, generation, block_id, heading_level, parent_heading FROM k WHERE n = 1",
}
SQL["grounding_totals"] = f"SELECT count(*) AS claims_total, count(*) FILTER (NOT supported) AS claims_flagged, bool_and(supported) AS fully_grounded FROM ({SQL['claim_grounding']})"
SQL["branch_context"] = _TREES + "SELECT paper_id, node_id, array_to_string(node_path[greatest(len(node_path) - 5, 1):-2], '>') AS context FROM down WHERE forest = 'canvas'"
SQL["paper_metadata"] = SQL["paper_metadata"].replace("@TEXT@", _normal("b.text")).replace("@TITLE@", _normal("p.title"))
_BOX = "(SELECT DISTINCT paper_id, generation, page_index, block_no, bbox[1] AS x0, bbox[2] AS y0, bbox[3] AS x1, bbox[4] AS y1 FROM blocks WHERE flow_kind = 'body' AND bbox IS NOT NULL)"
SQL["column_order"] = f"WITH e AS (SELECT paper_id, generation, page_index, min(x0) AS lo, max(x1) AS hi FROM {_BOX} GROUP BY ALL), r AS (SELECT b.*, x1 - x0 > 0.6 * (hi - lo) AS wide, (x0 + x1) / 2 > (lo + hi) / 2 AS far FROM {_BOX} b JOIN e USING (paper_id, generation, page_index)), s AS (SELECT *, (SELECT count(*) FROM r q WHERE (q.paper_id, q.generation, q.page_index) = (r.paper_id, r.generation, r.page_index) AND q.wide AND (q.y0, q.x0, q.block_no) < (r.y0, r.x0, r.block_no)) AS above FROM r) SELECT paper_id, generation, page_index, block_no, (row_number() OVER (PARTITION BY paper_id, generation, page_index ORDER BY 2 * above + wide::INT, CASE WHEN wide THEN 0 ELSE far::INT END, y0, x0, block_no) - 1)::INTEGER AS layout_rank FROM s"


def coverage_sql(box: str) -> str:
    """The area that the boxes of each page cover together, by the grid of their edges."""
    edges = lambda a, z: f"(SELECT paper_id, generation, page_index, v, lead(v) OVER (PARTITION BY paper_id, generation, page_index ORDER BY v) AS n FROM (SELECT paper_id, generation, page_index, {a} AS v FROM {box} UNION SELECT paper_id, generation, page_index, {z} FROM {box}))"
    return f"SELECT paper_id, generation, page_index, round(sum(CASE WHEN EXISTS (FROM {box} b WHERE (b.paper_id, b.generation, b.page_index) = (x.paper_id, x.generation, x.page_index) AND b.x0 <= x.v AND b.x1 >= x.n AND b.y0 <= y.v AND b.y1 >= y.n) THEN (x.n - x.v) * (y.n - y.v) ELSE 0 END), 4) AS union_area FROM {edges('x0', 'x1')} x JOIN {edges('y0', 'y1')} y USING (paper_id, generation, page_index) WHERE x.n IS NOT NULL AND y.n IS NOT NULL GROUP BY ALL"


SQL["page_coverage"] = coverage_sql(_BOX)
SQL["page_columns"] = f"WITH b AS (SELECT * FROM {_BOX} WHERE x0 < x1), e AS (SELECT paper_id, generation, page_index, count(*) AS n, min(x0) AS lo, max(x1) AS hi FROM b GROUP BY ALL), g AS (SELECT *, unnest(range(round_even(lo + 0.3 * (hi - lo), 0)::BIGINT, round_even(lo + 0.7 * (hi - lo), 0)::BIGINT + 1)) AS x FROM e WHERE n >= 4), c AS (SELECT g.paper_id, g.generation, g.page_index, g.n, g.x, count(*) FILTER (b.x0 < g.x AND b.x1 > g.x) AS cut, count(*) FILTER (b.x1 <= g.x) AS l, count(*) FILTER (b.x0 >= g.x) AS r FROM g JOIN b USING (paper_id, generation, page_index) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY paper_id, generation, page_index ORDER BY cut, -least(l, r), x) AS p FROM c) SELECT q.paper_id, q.generation, q.page_index, CASE WHEN least(l, r) >= 2 AND cut <= 0.2 * k.n THEN 2 ELSE 1 END::INTEGER AS column_count, CASE WHEN least(l, r) >= 2 AND cut <= 0.2 * k.n THEN x::DOUBLE END AS gutter_x FROM (SELECT DISTINCT paper_id, generation, page_index FROM {_BOX}) q LEFT JOIN k ON (k.paper_id, k.generation, k.page_index) = (q.paper_id, q.generation, q.page_index) AND k.p = 1"
_GRID = "floor(bbox[{i}] + 0.5)::BIGINT"
SQL["derived_block_ids"] = f"SELECT block_no, 'blk_' || {_id_sql('h', 16, 0, 'abcdefghijklmnopqrstuvwxyz234567', 20)} AS derived_id FROM (SELECT DISTINCT block_no, sha256(concat_ws('|', sha256(paper_id), page_index, {_GRID.format(i=1)}, {_GRID.format(i=2)}, block_type, substr(coalesce({_normal('text')}, ''), 1, 8))) AS h FROM blocks)"
SQL["region_clusters"] = f"WITH RECURSIVE b AS (SELECT * FROM {_BOX}), n AS (SELECT a.paper_id, a.generation, a.page_index, a.block_no AS s, c.block_no AS t FROM b a JOIN b c USING (paper_id, generation, page_index) WHERE a.x1 + 12 >= c.x0 AND c.x1 + 12 >= a.x0 AND a.y1 + 12 >= c.y0 AND c.y1 + 12 >= a.y0), r AS (SELECT paper_id, generation, page_index, block_no AS s, block_no AS t FROM b UNION SELECT r.paper_id, r.generation, r.page_index, r.s, n.t FROM r JOIN n ON n.s = r.t) SELECT paper_id, generation, page_index, s AS block_no, min(t) AS cluster_no FROM r GROUP BY ALL"
SQL["anchor_selectors"] = f"WITH t AS (SELECT DISTINCT paper_id, generation, block_no, doc_order, {_normal("coalesce(text, '')")} AS exact FROM blocks WHERE doc_order IS NOT NULL) SELECT block_no, exact, coalesce(right(lag(exact) OVER w, @N@), '') AS prefix, coalesce(left(lead(exact) OVER w, @N@), '') AS suffix, sha256(exact) AS text_hash FROM t WINDOW w AS (PARTITION BY paper_id, generation ORDER BY doc_order, block_no)".replace("@N@", str(CONTEXT))
SQL["stream_job_states"] = "WITH e AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS fails FROM events), f AS (SELECT user_id, min(event_id) FILTER (event_type = 'purchase') AS done, min(event_id) FILTER (fails = 3) AS dead, max(event_id) AS newest FROM e GROUP BY user_id), l AS (SELECT user_id, done, dead, least(coalesce(done, newest), coalesce(dead, newest)) AS last_event FROM f) SELECT l.user_id, CASE WHEN last_event = done THEN 'done' WHEN last_event = dead THEN 'dead' WHEN event_type = 'error' THEN 'retrying' ELSE 'running' END AS state, fails::INTEGER AS attempts, last_event FROM l JOIN e ON e.user_id = l.user_id AND e.event_id = l.last_event"
_Q = {k: v.replace("'", "''") for k, v in {"cap": X.CAPTION, "sec": X.SECTION, "page": X.PAGE_NUMBER, "year": X.YEAR, "arxiv": X.ARXIV}.items()}
SQL["text_features"] = f"""SELECT DISTINCT block_no, array_to_string(list_filter(list_reverse(list_reduce(list_prepend([]::VARCHAR[], list_transform(flatten(list_transform(regexp_extract_all(text, '\\[([0-9][0-9,\\s–-]*)\\]', 1), lambda m: regexp_split_to_array(m, '[,\\s–-]+'))), lambda x: [x])), lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a ELSE list_prepend(x[1], a) END)), lambda x: x <> ''), ',') AS labels,
    nullif(lower(regexp_extract(text, '{_Q["cap"]}', 1)), '') AS caption_kind, nullif(regexp_extract(text, '{_Q["cap"]}', 2), '') AS caption_number, nullif(regexp_extract(text, '{_Q["sec"]}', 1), '') AS section_number, try_cast(regexp_extract_all(regexp_replace(text, '{_Q["arxiv"]}', ' ', 'g'), '{_Q["year"]}', 1)[-1] AS INTEGER) AS year_found,
    len(regexp_extract_all(text, '[A-Za-z]{{4,}}')) >= 2 AS is_prose, regexp_replace(lower(trim(text, ' ')), '[0-9]+', '#', 'g') AS furniture_key, regexp_matches(text, '{_Q["page"]}') AS is_page_number FROM blocks WHERE text IS NOT NULL"""
_SQUEEZED = "trim(regexp_replace({c}, '[ \\t\\n\\r\\x0B\\x0C]+', ' ', 'g'), ' ')"
_ONE_LINE = "trim(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), ' ')"
SQL["text_cleaning"] = f"""SELECT DISTINCT block_no, {_SQUEEZED.format(c=f"regexp_replace(regexp_replace(text, '{X.CONTROL}', '', 'g'), '[<>&]', ' ', 'g')")} AS clean_text,
    replace(regexp_replace(text, '[-­‐][ \\t]*(\\r\\n|\\n|\\r)+[ \\t]*', '', 'g'), '­', '') AS joined_text, CASE WHEN length({_ONE_LINE}) > 80 THEN {_ONE_LINE}[1:79] || '…' ELSE {_ONE_LINE} END AS short_text, 'sha256:' || sha256({_normal('text')}) AS text_hash,
    regexp_matches(text, '\\p{{Latin}}[\\p{{Cyrillic}}\\p{{Greek}}]|[\\p{{Cyrillic}}\\p{{Greek}}]\\p{{Latin}}') AS mixed_script,
    NOT regexp_matches(text, '[.!?][\"''’”)\\]]*\\s*$') OR regexp_matches(text, '(?i)\\b(et al|e\\.g|i\\.e|cf|vs|Fig|Eq|Tab|Sec|resp|approx)\\.\\s*$') OR regexp_matches(text, '[-­‐]\\s*$') AS unterminated,
    regexp_matches(text, '^\\s*\\p{{Ll}}') AS mid_sentence, regexp_matches(text, '[A-Z]') AND regexp_matches(text, '[a-z]') AND regexp_matches(text, '[0-9]') AS three_classes,
    len(list_filter(regexp_split_to_array(trim(text, ' '), '[\\s,;]+'), lambda w: w <> '' AND NOT regexp_full_match(w, '(?s)and|&|\\p{{Lu}}.*'))) = 0 AS name_list,
    round(CASE WHEN length(text) = 0 THEN 0.0 ELSE len(regexp_extract_all(text, '[\\p{{Sm}}∂∇∑∏√∞]')) / length(text)::DOUBLE END, 6) AS symbol_density FROM blocks WHERE text IS NOT NULL"""

