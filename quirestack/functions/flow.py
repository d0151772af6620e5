"""Lines to paragraphs and back: line joins, reflow with a map to the source, continued blocks, citation marks, marked text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of marks in running text and of the heads of reference entries.
AUTHOR_YEAR = r"(\p{Lu}[\p{L}'’-]+(?:(?:\s+(?:and|&)\s+|,\s+)\p{Lu}[\p{L}'’-]+)*(?:\s+et\s+al\.?)?),?\s+\(?((?:19|20)[0-9]{2})[a-z]?\)?"
RECORD_HEAD = r"(?<=\S)\s+(?=\[[0-9]{1,4}\]\s)"

_BREAK = re.compile(r"[-­‐‑]$")


def joins_word(line: Column, after: Column) -> Column:
    """A line that ends in a letter and a hyphen, before one that goes on with a lower-case letter."""
    return F.coalesce(line.rlike(r"\p{L}[-­‐‑]\s*$") & after.rlike(r"^\s*\p{Ll}"), F.lit(False))


def join_sureness(line: Column, after: Column) -> Column:
    """How sure it is that a paragraph goes on: a broken word, an open sentence before a small letter, an open sentence, or not."""
    open_ = ~line.rlike(r"[.!?:][\"'’”)\]]*\s*$")
    return F.when(joins_word(line, after), 0.9).when(open_ & after.rlike(r"^\s*\p{Ll}"), 0.8).when(open_, 0.6).otherwise(0.0)


def reflow_one(text: str) -> tuple[str, list[int]]:
    """Lines joined by blanks, broken words whole, blank lines kept as one line end; and where each character came from."""
    out, places = [], []
    at = 0
    lines = []
    for m in re.finditer(r"([^\r\n]*)(\r\n|\n|\r|$)", text):
        if m.start() == len(text) and lines:
            break
        lines.append((m[1], m.start()))
    for k, (line, start) in enumerate(lines):
        left, body = len(line) - len(line.lstrip()), line.strip()
        if not body:
            if out and out[-1] != "\n":
                out.append("\n")
                places.append(start)
            continue
        if out and out[-1] not in "\n":
            before = out[-1]
            if _BREAK.match(before) and len(out) > 1 and out[-2].isalpha() and body[0].islower():
                out.pop()
                places.pop()
            else:
                out.append(" ")
                places.append(max(0, start - 1))
        for i, c in enumerate(body):
            out.append(c)
            places.append(start + left + i)
        at = k
    while out and out[-1] == "\n":
        out.pop()
        places.pop()
    return "".join(out), [*places, len(text)] if at >= 0 else [len(text)]


@F.pandas_udf(T.StructType([T.StructField("reflowed", T.StringType()), T.StructField("places", T.ArrayType(T.IntegerType()))]))
def reflow(texts: pd.Series) -> pd.DataFrame:
    """``reflow_one`` of each text; null gives the empty text."""
    made = [reflow_one(t) if isinstance(t, str) else ("", [0]) for t in texts]
    return pd.DataFrame({"reflowed": [m[0] for m in made], "places": [m[1] for m in made]})


def place_in(places: Column, offset: Column) -> Column:
    """Where a source offset stands after a reflow: the first character from it or from behind it."""
    return F.size(F.filter(places, lambda p: p < offset))


def joined(texts: Column) -> Column:
    """Continued blocks as one text: a broken word is closed at the seam, else a blank stands there."""
    seam = lambda a, b: F.when((a == "") | (b == ""), F.concat(a, b)).when(joins_word(a, b), F.concat(F.regexp_replace(a, r"[-­‐‑]\s*$", ""), F.ltrim(b))).otherwise(F.concat_ws(" ", F.rtrim(a), F.ltrim(b)))
    return F.aggregate(F.filter(texts, lambda x: x.isNotNull()), F.lit(""), seam)


def block_text(lines: Column) -> Column:
    """Lines as one text with line ends, and the offsets of the hyphens that might be closed."""
    n = F.size(lines)
    text = F.array_join(lines, "\n")
    starts = lambda i: F.aggregate(F.slice(lines, F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x) + 1)
    hit = F.filter(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.expr("cast(array() as array<int>)")), lambda i: joins_word(lines[i - 1], lines[i]))
    return F.struct(text.alias("text"), F.transform(hit, lambda i: starts(i) - 2).alias("hyphens"))


def author_year_marks(text: Column) -> Column:
    """Marks like "Miller and Lee (2004)" as "surnames|year", in order."""
    names, years = F.regexp_extract_all(text, F.lit(AUTHOR_YEAR), F.lit(1)), F.regexp_extract_all(text, F.lit(AUTHOR_YEAR), F.lit(2))
    return F.zip_with(names, years, lambda a, y: F.concat_ws("|", a, y))


def first_surname(marks: Column) -> Column:
    return F.regexp_extract(marks, r"^(\p{Lu}[\p{L}'’-]+)", 1)


def records(text: Column) -> Column:
    """Reference entries run together, parted before each "[12] "."""
    return F.split(text, RECORD_HEAD)


def part_of_box(box: Column, length: Column, start: Column, end: Column) -> Column:
    """The box of a stretch of a line, by its share of the characters."""
    wide = (box[2] - box[0]) / F.greatest(length, F.lit(1))
    return F.array(box[0] + wide * start, box[1], box[0] + wide * end, box[3])


def datamarked(text: Column, mark: str) -> Column:
    """Foreign text that can't pass for instructions: each run of white space is the mark, and the whole stands in a tag."""
    return F.concat(F.lit("<untrusted>"), F.regexp_replace(text, r"\s+", mark), F.lit("</untrusted>"))


def prompt_hash(prompt: Column) -> Column:
    return F.sha2(prompt, 256)
