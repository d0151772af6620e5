"""Documents in and out: nesting blocks into page documents, reading them back, JSON lines, checked reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "struct<sibling_order:int,block_no:bigint,block_id:string,block_type:string,flow_kind:string,doc_order:int,parent_id:string,child_ids:array<string>,bbox:array<double>,text:string,source_kind:string,confidence:double>"
FIELDS = "sibling_order block_no block_id block_type flow_kind doc_order parent_id child_ids bbox text source_kind confidence".split()


def nest_pages(blocks: DataFrame) -> DataFrame:
    """One row for each page of a generation, with its blocks as an array in sibling order.

    A page is the unit because its size is bounded by paper, while a whole document's may not be.  Repeated blocks count
    once.  Null fields stay absent in JSON and read back as null.
    """
    rows = blocks.select("paper_id", "generation", "page_index", *FIELDS).distinct()
    return rows.groupBy("paper_id", "generation", "page_index").agg(F.sort_array(F.collect_list(F.struct(*FIELDS))).alias("blocks"))


def shred_pages(pages: DataFrame, column: str) -> DataFrame:
    """The inverse of ``nest_pages`` on its JSON: one row for each block.  A damaged document gives no rows."""
    keys = [c for c in pages.columns if c in ("paper_id", "generation", "page_index")]
    return pages.select(*keys, F.explode(F.from_json(column, f"array<{BLOCK}>")).alias("b")).select(*keys, "b.*")


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines; a second run replaces the first."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a given schema; a line that does not fit is an error, and so are NaN and Infinity."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("allowNonNumericNumbers", False).json(path)


def asset_uri(paper: Column, generation: Column, kind: str, block: Column, scale: int = 3) -> Column:
    """Where the crop of a block lies."""
    return F.format_string(f"asset://%s/%d/{kind}/%s@{scale}x.png", paper, generation, block)


def page_text(text: Column, number: int) -> Column:
    """One page of a flat text with markers like [Page 3]; null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?s)\[Page {number}\](.*?)(?=\[Page [0-9]+\]|$)", 1)), F.lit(""))


def last_page(text: Column) -> Column:
    """The largest page marker, 1 if there is none."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"\[Page ([0-9]+)\]"), F.lit(1)), lambda n: n.cast("int"))), F.lit(1))


RELATION = "rel_type from_block to_block confidence provenance".split()
PAGE = "page_index page_id width height rotation user_unit media_box has_text_layer is_scanned confidence".split()


def nest(rows: DataFrame, keys: list[str], fields: list[str], name: str) -> DataFrame:
    """One row for each value of ``keys`` with its rows as an array of structs, repeated rows once."""
    return rows.select(*keys, *fields).distinct().groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))


def shred(documents: DataFrame, keys: list[str], column: str, schema: str) -> DataFrame:
    """The rows of a JSON array of objects, one each, with ``keys`` and ``array_position``; what is no such array gives none."""
    return documents.select(*keys, F.posexplode(F.from_json(column, f"array<struct<{schema}>>")).alias("array_position", "b")).where("b is not null").select(*keys, "array_position", "b.*")


def without_nulls(row: Column) -> Column:
    """A struct as JSON without its null fields."""
    return F.to_json(row, {"ignoreNullFields": "true"})


def keyed_answers(documents: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON object of answers by question id as rows ``question_id`` and the answer's fields; null answers are left out."""
    return documents.select(F.explode(F.from_json(column, f"map<string,struct<{schema}>>")).alias("question_id", "a")).where("a is not null").select("question_id", "a.*")


def statements(text: Column) -> Column:
    """The statements of a script, parted by lines that hold nothing but --;; , without those that are blank."""
    return F.filter(F.transform(F.split(text, r"(?m)^[ \t]*--;;[ \t]*$"), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")
