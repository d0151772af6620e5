"""Queries over the operators for training text, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirestack.llm.bpe import encode_corpus
from quirestack.llm.canon import alike_classes, alike_pairs, consistent_form
from quirestack.llm.leak import leaks
from quirestack.llm.ocr import Repair, noise
from quirestack.llm.safety import THRESHOLD, fit, scored
from quirestack.llm.split import LIMIT, OVERLAP, split_texts
from quirestack.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return noise(table(spark, d, "blocks"))


def p3_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The scanned blocks as continuous text."""
    return Repair(table(spark, d, "blocks")).paragraphs()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    printed = table(spark, d, "blocks").where(F.col("source_kind") != "ocr")
    return alike_pairs(printed, "text", "paper_id", "block_no")


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every block that prints like another text of its paper, with its class, its text's representative and the class's size."""
    printed = table(spark, d, "blocks").where(F.col("source_kind") != "ocr")
    return alike_classes(printed, "text", "paper_id", "block_no")


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every printed block, and whether ``text_normalised`` still belongs to it."""
    printed = table(spark, d, "blocks").where((F.col("source_kind") != "ocr") & F.col("text").isNotNull()).select("block_no", "text", "text_normalised").distinct()
    forms = consistent_form(printed, "text", ["block_no", "text_normalised"])
    stored = consistent_form(forms, "text_normalised", ["block_no", "text_form"], "stored_form")
    squeeze = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    return stored.select("block_no", "text_form", (squeeze("stored_form") == squeeze("text_form")).alias("stored_agrees"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "retrieved_blocks").select(F.lit("retrieved_block").alias("item_kind"), F.col("retrieval_no").alias("item_no"), F.col("text").alias("body"))
    sections = table(spark, d, "book_sections").select(F.lit("book_section").alias("item_kind"), F.col("section_no").alias("item_no"), F.col("content").alias("body"))
    return blocks.union(sections).where(F.col("body").isNotNull()).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_texts(_items(spark, d), "body", ["item_kind", "item_no"], with_text=False)
    return pieces.where("piece_no = 0 and piece_count > 1").select("item_kind", "item_no", (F.col("longest_run") > LIMIT).cast("int").alias("forced"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_texts(_items(spark, d), "body", ["item_kind", "item_no"])


def p5_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Each item put together again from its pieces, and how many of them break the limit or the overlap."""
    pieces = p5_pieces(spark, d)
    kept = F.when(F.col("piece_no") == 0, F.col("piece_text")).otherwise(F.expr(f"substr(piece_text, {OVERLAP} + 1)"))
    row = F.struct("piece_no", kept.alias("kept"), F.col("piece_text").alias("t"))
    listed = pieces.groupBy("item_kind", "item_no").agg(F.sort_array(F.collect_list(row)).alias("p"))
    carried = F.filter(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.right(F.col("p")[i - 1]["t"], F.lit(OVERLAP)) != F.left(F.col("p")[i]["t"], F.lit(OVERLAP)))
    return listed.select("item_kind", "item_no", F.md5(F.array_join(F.transform("p", lambda x: x["kept"]), "")).alias("text_md5"), F.size(F.filter("p", lambda x: F.length(x["t"]) > LIMIT)).alias("oversized"), F.when(F.size("p") < 2, 0).otherwise(F.size(carried)).alias("bad_overlaps"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), "text", ["doc_id"])


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Each leak with its length and the share of the held-out text that its tiles cover; a passage in another order has ``copied_words`` 0."""
    rows = leaks(table(spark, d, "documents"), "text", "doc_id", table(spark, d, "eval_items"), "item_id", ["passage", "question"])
    return rows.withColumn("coverage", F.round(F.col("covered_words") / F.col("item_words"), 4))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The leaks with twelve consecutive words."""
    return p7_report(spark, d).where("copied_words > 0").select("doc_id", "item_id").distinct()


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """A score for each document."""
    docs = table(spark, d, "documents")
    _, linear = fit(docs, "text", "doc_id", table(spark, d, "doc_labels"))
    return scored(docs, "text", "doc_id", ["source"], linear)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_scores(spark, d).where(F.col("unsafe_score") >= THRESHOLD).select("doc_id")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """The rate of such documents for each source."""
    unsafe = (F.col("unsafe_score") >= THRESHOLD).cast("long")
    return p8_scores(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(unsafe).alias("unsafe_documents")).withColumn("unsafe_rate", F.round(F.col("unsafe_documents") / F.col("documents"), 6))


QUERIES = {f.__name__: f for f in (p3_found, p3_paragraphs, p4_found, p4_classes, p4_forms, p5_found, p5_pieces, p5_rebuilt, p6_ids, p7_found, p7_report, p8_scores, p8_found, p8_rates)}

SQL = {
    "p5_rebuilt": """
        SELECT 'retrieved_block' AS item_kind, retrieval_no AS item_no, md5(text) AS text_md5, 0::INTEGER AS oversized, 0::INTEGER AS bad_overlaps FROM (SELECT DISTINCT retrieval_no, text FROM retrieved_blocks WHERE text IS NOT NULL)
        UNION ALL SELECT 'book_section', section_no, md5(content), 0, 0 FROM (SELECT DISTINCT section_no, content FROM book_sections WHERE content IS NOT NULL)""",
    "p5_found": """
        WITH items AS (SELECT DISTINCT 'retrieved_block' AS item_kind, retrieval_no AS item_no, text AS body FROM retrieved_blocks WHERE text IS NOT NULL
            UNION SELECT DISTINCT 'book_section', section_no, content FROM book_sections WHERE content IS NOT NULL)
        SELECT item_kind, item_no, (list_max(list_transform(regexp_split_to_array(body, '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x0B\\x1C-\\x1F]'), lambda s: length(s))) > 1600)::INTEGER AS forced
        FROM items WHERE length(body) > 1600""",
}
