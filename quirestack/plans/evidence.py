"""Evidence around selected blocks, and running text: reflow, marks, records, foreign text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quirestack.functions import flow as L
from quirestack.functions import text as X
from quirestack.operators import expansion as P
from quirestack.operators.memory import IMPERATIVE, LINK, signals
from quirestack.session import table

PAPER = ["paper_id", "generation"]
POLICY = P.Policy()
#: Relations in the order in which they are followed.
KINDS = ("caption_of", "references", "explains", "defines", "parent_of", "continues_on_next_page", "mirrors")


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "retrieved_blocks").where("ladder_stage = 'selected'").select("question_id", *PAPER, "block_id").distinct()


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").where("doc_order is not null").select(*PAPER, "block_id", "block_no", "doc_order", (F.col("block_type") == "heading").alias("is_heading")).distinct()
    return b.withColumn("rank", F.row_number().over(W.partitionBy(*PAPER).orderBy("doc_order", "block_no"))).drop("doc_order", "block_no")


def _links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "blocks").select(*PAPER, "block_id", "parent_id", "sibling_order").distinct()


def _headings(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "blocks").where("block_type = 'heading' and doc_order is not null").select(*PAPER, "block_id", F.coalesce(F.size(F.split(X.section_number("text"), r"\.")), F.lit(1)).alias("heading_level")).distinct()
    return _ranked(spark, d).where("is_heading").join(t, [*PAPER, "block_id"])


def _edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Relations that tie blocks, and those that cite."""
    r = table(spark, d, "relations").select(*PAPER, "rel_type", "from_block", "to_block").distinct()
    entry = table(spark, d, "blocks").where("block_type = 'reference_entry'").select(*PAPER, F.col("block_id").alias("to_block"), F.lit(True).alias("is_entry")).distinct()
    r = r.join(entry, [*PAPER, "to_block"], "left").withColumn("citing", (F.col("rel_type") == "cites") | ((F.col("rel_type") == "references") & F.coalesce("is_entry", F.lit(False))))
    rank = F.coalesce(*(F.when(F.col("rel_type") == k, F.lit(i)) for i, k in enumerate(KINDS)), F.lit(len(KINDS)))
    return r.where("not citing").withColumn("kind_rank", rank), r.where("citing")


def expand_adjacent(spark: SparkSession, d: str) -> DataFrame:
    return P.neighbours(_seeds(spark, d), _ranked(spark, d), POLICY).select(*P.SEED, "target_id", "reason")


def expand_parents(spark: SparkSession, d: str) -> DataFrame:
    return P.ancestors(_seeds(spark, d), _links(spark, d), POLICY).select(*P.SEED, "target_id", "reason")


def expand_children(spark: SparkSession, d: str) -> DataFrame:
    return P.children(_seeds(spark, d), _links(spark, d), POLICY).select(*P.SEED, "target_id", "place")


def expand_outline(spark: SparkSession, d: str) -> DataFrame:
    return P.outline(_seeds(spark, d), _ranked(spark, d), _headings(spark, d)).select(*P.SEED, "target_id", "reason")


def expand_related(spark: SparkSession, d: str) -> DataFrame:
    return P.related(_seeds(spark, d), _edges(spark, d)[0], POLICY).select(*P.SEED, "target_id", "reason", "place")


def expand_citations(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "blocks").where("text is not null").select(*PAPER, "block_id", "block_type", "text").distinct()
    return P.citations(_seeds(spark, d), t, t.where("block_type = 'reference_entry'"), _edges(spark, d)[1], POLICY).select(*P.SEED, "target_id", "reason", "place")


def expand_all(spark: SparkSession, d: str) -> DataFrame:
    """Every block around each question's selection, under the rung that claims it first."""
    seeds, ranked, links = _seeds(spark, d), _ranked(spark, d), _links(spark, d)
    t = table(spark, d, "blocks").where("text is not null").select(*PAPER, "block_id", "block_type", "text").distinct()
    ties, cites = _edges(spark, d)
    near = P.neighbours(seeds, ranked, POLICY)
    above = P.outline(seeds, ranked, _headings(spark, d)).union(P.ancestors(seeds, links, POLICY)).union(P.children(seeds, links, POLICY))
    siblings = P.section_siblings(seeds, ranked, above.union(near), POLICY)
    rungs = above.union(siblings).union(near).union(P.related(seeds, ties, POLICY)).union(P.citations(seeds, t, t.where("block_type = 'reference_entry'"), cites, POLICY))
    return P.first_claims(rungs, seeds)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "blocks").where("text is not null").select("block_no", *PAPER, "block_id", "block_type", "doc_order", "text").distinct()


def reflowed(spark: SparkSession, d: str) -> DataFrame:
    """Each block's lines as running text, and where its tenth source character stands in it."""
    r = _texts(spark, d).select("block_no", L.reflow("text").alias("r"))
    return r.select("block_no", "r.reflowed", L.place_in(F.col("r.places"), F.lit(10)).alias("place_of_10"))


def line_joins(spark: SparkSession, d: str) -> DataFrame:
    """For each paragraph and the next in reading order how sure it is that the text goes on, and both as one text where it does."""
    w = W.partitionBy(*PAPER).orderBy("doc_order", "block_no")
    t = _texts(spark, d).where("block_type = 'paragraph' and doc_order is not null").withColumn("after", F.lead("text").over(w)).where("after is not null")
    t = t.withColumn("sureness", L.join_sureness(F.col("text"), F.col("after")))
    return t.select("block_no", "sureness", F.when(F.col("sureness") > 0, F.length(L.joined(F.array("text", "after")))).alias("joined_chars"))


def hyphen_proposals(spark: SparkSession, d: str) -> DataFrame:
    """The offsets of the hyphens at line ends that might be closed."""
    t = _texts(spark, d).select("block_no", L.block_text(F.split("text", "\n")).alias("b"))
    return t.select("block_no", F.explode("b.hyphens").alias("hyphen_at"))


def author_year_marks(spark: SparkSession, d: str) -> DataFrame:
    t = _texts(spark, d).where("block_type <> 'reference_entry'")
    return t.select("block_no", F.posexplode(L.author_year_marks(F.col("text"))).alias("mark_no", "mark")).select("block_no", "mark_no", "mark", L.first_surname(F.col("mark")).alias("surname"))


def author_year_links(spark: SparkSession, d: str) -> DataFrame:
    """Marks tied to the one entry of the paper that begins with the surname and holds the year; several tie to none."""
    t = _texts(spark, d)
    entries = t.where("block_type = 'reference_entry'").select(*PAPER, F.col("block_id").alias("entry_id"), F.regexp_extract("text", r"^\s*(?:\[[^\]]*\]\s*)?(\p{Lu}[\p{L}'’-]+)", 1).alias("surname"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b((?:19|20)[0-9]{2})"), F.lit(1)))).alias("year")).where("surname <> ''")
    one = entries.groupBy(*PAPER, "surname", "year").agg(F.min("entry_id").alias("entry_id"), F.count_distinct("entry_id").alias("n")).where("n = 1").drop("n")
    marks = t.where("block_type <> 'reference_entry'").select(*PAPER, "block_id", F.explode(L.author_year_marks(F.col("text"))).alias("mark"))
    marks = marks.select(*PAPER, "block_id", L.first_surname(F.col("mark")).alias("surname"), F.substring_index("mark", "|", -1).alias("year")).distinct()
    return marks.join(one, [*PAPER, "surname", "year"]).select(*PAPER, "block_id", "surname", "year", "entry_id")


def entry_records(spark: SparkSession, d: str) -> DataFrame:
    """Reference blocks parted into their records."""
    t = _texts(spark, d).where("block_type in ('reference_entry', 'bibliography', 'paragraph')")
    return t.select("block_no", F.posexplode(L.records(F.col("text"))).alias("record_no", "record"))


def foreign_text(spark: SparkSession, d: str) -> DataFrame:
    """Retrieved text marked as foreign, its hash, and which patterns of instructions and links it holds."""
    r = table(spark, d, "retrieved_blocks").where("text is not null").select("retrieval_no", "text").distinct()
    marked = L.datamarked(F.col("text"), "^")
    return r.select("retrieval_no", marked.alias("marked"), L.prompt_hash(marked).alias("marked_hash"), F.array_join(F.concat(signals(F.col("text"), IMPERATIVE), signals(F.col("text"), LINK)), ",").alias("signals"))


QUERIES = {f.__name__: f for f in (expand_adjacent, expand_parents, expand_children, expand_outline, expand_related, expand_citations, expand_all, reflowed, line_joins, hyphen_proposals, author_year_marks, author_year_links, entry_records, foreign_text)}

_S = "s AS (SELECT DISTINCT question_id, paper_id, generation, block_id FROM retrieved_blocks WHERE ladder_stage = 'selected')"
_O = "o AS (SELECT *, row_number() OVER (PARTITION BY paper_id, generation ORDER BY doc_order, block_no) AS rank FROM (SELECT DISTINCT paper_id, generation, block_id, block_no, doc_order, block_type, text FROM blocks WHERE doc_order IS NOT NULL))"
_K = "k AS (SELECT DISTINCT paper_id, generation, block_id, parent_id, sibling_order FROM blocks)"
_EDGE = "r AS (SELECT DISTINCT x.paper_id, x.generation, rel_type, from_block, to_block, rel_type = 'cites' OR (rel_type = 'references' AND EXISTS (FROM blocks b WHERE (b.paper_id, b.generation, b.block_id) = (x.paper_id, x.generation, x.to_block) AND b.block_type = 'reference_entry')) AS citing FROM relations x)"
_RANK = "CASE rel_type " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + f" ELSE {len(KINDS)} END"
_MARK = L.AUTHOR_YEAR
_T = "t AS (SELECT DISTINCT block_no, paper_id, generation, block_id, block_type, doc_order, text FROM blocks WHERE text IS NOT NULL)"
_NAMES = ", ".join(f"CASE WHEN regexp_matches(text, '(?im){p.replace(chr(39), chr(39) * 2)}') THEN '{n}' END" for n, p in (*IMPERATIVE, *LINK) if "(?!" not in p)
SQL = {
    "expand_adjacent": f"WITH {_S}, {_O} SELECT s.question_id, s.paper_id, s.generation, s.block_id, n.block_id AS target_id, 'adjacent:' || CASE WHEN n.rank > m.rank THEN '+' ELSE '' END || (n.rank - m.rank) AS reason FROM s JOIN o m USING (paper_id, generation, block_id) JOIN o n ON n.paper_id = s.paper_id AND n.generation = s.generation AND abs(n.rank - m.rank) BETWEEN 1 AND 2",
    "expand_parents": f"WITH {_S}, {_K} SELECT s.question_id, s.paper_id, s.generation, s.block_id, p.block_id AS target_id, 'parent:1' AS reason FROM s JOIN k USING (paper_id, generation, block_id) JOIN k p ON (p.paper_id, p.generation, p.block_id) = (s.paper_id, s.generation, k.parent_id) UNION ALL SELECT s.question_id, s.paper_id, s.generation, s.block_id, g.block_id, 'parent:2' FROM s JOIN k USING (paper_id, generation, block_id) JOIN k p ON (p.paper_id, p.generation, p.block_id) = (s.paper_id, s.generation, k.parent_id) JOIN k g ON (g.paper_id, g.generation, g.block_id) = (s.paper_id, s.generation, p.parent_id)",
    "expand_children": f"WITH {_S}, {_K} SELECT * FROM (SELECT s.question_id, s.paper_id, s.generation, s.block_id, c.block_id AS target_id, 2000 + row_number() OVER (PARTITION BY s.question_id, s.paper_id, s.generation, s.block_id ORDER BY c.sibling_order, c.block_id) AS place FROM s JOIN k c ON (c.paper_id, c.generation, c.parent_id) = (s.paper_id, s.generation, s.block_id)) WHERE place <= 2012",
    "expand_outline": f"WITH RECURSIVE {_S}, {_O}, h AS (SELECT *, coalesce(len(string_split(nullif(regexp_extract(text, '{X.SECTION}', 1), ''), '.')), 1) AS lvl FROM o WHERE block_type = 'heading'), p AS (SELECT a.paper_id, a.generation, a.block_id, (SELECT arg_max(c.block_id, c.rank) FROM h c WHERE c.paper_id = a.paper_id AND c.generation = a.generation AND c.rank < a.rank AND c.lvl < a.lvl) AS up FROM h a), q AS (SELECT s.*, (SELECT arg_max(h.block_id, h.rank) FROM h WHERE h.paper_id = s.paper_id AND h.generation = s.generation AND h.rank <= m.rank) AS target_id, 'section-heading' AS reason FROM s JOIN o m USING (paper_id, generation, block_id) UNION ALL SELECT q.question_id, q.paper_id, q.generation, q.block_id, p.up, 'outline-heading' FROM q JOIN p ON (p.paper_id, p.generation, p.block_id) = (q.paper_id, q.generation, q.target_id) WHERE p.up IS NOT NULL) SELECT question_id, paper_id, generation, block_id, target_id, reason FROM q WHERE target_id IS NOT NULL",
    "expand_related": f"WITH {_S}, {_EDGE}, e AS (SELECT paper_id, generation, from_block AS a, to_block AS b, rel_type FROM r WHERE NOT citing UNION SELECT paper_id, generation, to_block, from_block, rel_type FROM r WHERE NOT citing) SELECT * FROM (SELECT s.question_id, s.paper_id, s.generation, s.block_id, e.b AS target_id, rel_type AS reason, row_number() OVER (PARTITION BY s.question_id, s.paper_id, s.generation, s.block_id ORDER BY {_RANK}, rel_type, e.b) AS place FROM s JOIN e ON (e.paper_id, e.generation, e.a) = (s.paper_id, s.generation, s.block_id) WHERE e.a <> e.b) WHERE place <= 12",
    "entry_records": f"WITH {_T}, u AS (SELECT block_no, string_split_regex(regexp_replace(text, '(\\S)\\s+(\\[[0-9]{{1,4}}\\]\\s)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS r FROM t WHERE block_type IN ('reference_entry', 'bibliography', 'paragraph')) SELECT block_no, unnest(range(len(r)))::INTEGER AS record_no, unnest(r) AS record FROM u",
    "author_year_marks": f"WITH {_T}, u AS (SELECT block_no, regexp_extract_all(text, '{_MARK.replace(chr(39), chr(39) * 2)}', 1) AS a, regexp_extract_all(text, '{_MARK.replace(chr(39), chr(39) * 2)}', 2) AS y FROM t WHERE block_type <> 'reference_entry'), v AS (SELECT block_no, unnest(range(len(a)))::INTEGER AS mark_no, unnest(a) AS n, unnest(y) AS y FROM u) SELECT block_no, mark_no, n || '|' || y AS mark, regexp_extract(n, '^(\\p{{Lu}}[\\p{{L}}''’-]+)', 1) AS surname FROM v",
}
