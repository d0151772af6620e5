"""Scalar text functions as Columns: they stay inside generated code.  Each gives null for null unless it says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without evidential content.
STOPWORDS = (
    "a about above after all also an and any are as at be because been before being below between both but by can did do does doing during each few "
    "for from further had has have having he her here hers him his how i if in into is it its itself just me more most my never no nor not now of off "
    "on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under "
    "until up very was we were what when where which while who whom why will with would you your"
).split()
# Patterns of tokens, markers, captions, numbers and identifiers.
TOKEN = r"[0-9A-Za-z][0-9A-Za-z._\-]*"
NUMERIC = r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"
ATOM = r"(?s)[ \t]*[A-Za-z0-9]+|."
CITATION = r"\[([0-9][0-9,\s–-]*)\]"
ENTRY_LABEL = r"(?m)^\[([0-9]{1,4}|[A-Za-z][A-Za-z0-9+'’]{1,19})\]"
CAPTION = r"(?i)^\s*(figure|fig\.?|table|algorithm|listing)\s*([0-9]+(\.[0-9]+)*|[A-Z]\.?[0-9]+(\.[0-9]+)*|[IVX]+)\s*[.:)\s]"
SECTION = r"^\s*((?:[0-9]+|[A-Z]|[IVXL]+)(?:\.[0-9]+)*)\s*[.)]?\s+(\S.*)$"
EQUATION_NUMBER = r"([(\[]\s*[A-Za-z]?\.?\s*[0-9]+(\.[0-9]+)*\s*[)\]])\s*$"
ARXIV = r"(?i)arXiv:\s*([0-9]{4}\.[0-9]{4,5})(v[0-9]+)?"
YEAR = r"\b(19[5-9][0-9]|20[0-4][0-9])\b"
PAGE_NUMBER = r"^\s*[-–—]?\s*([0-9]{1,4}|[ivxlcIVXLC]{1,7})\s*[-–—]?\s*$"
CALLOUT = r"(?i)\b(figure|fig|table|equation|algorithm|listing)s?\.?\s*\(?\s*([0-9]+(\.[0-9]+)*)"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F­؜​-‏‪-‮⁠-⁯﻿]"
BLANK = r"[ \t\n\r\x0B\x0C]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_blanks(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), BLANK, " "))


def dehyphenate(c: Column | str) -> Column:
    """Words broken at a line end made whole; a lone soft hyphen goes too."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"[-­‐][ \t]*(\r\n|\n|\r)+[ \t]*", ""), "­", "")


def strip_control(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), CONTROL, "")


def strip_tagish(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"[<>&]", " ")


def sanitise(c: Column | str) -> Column:
    """Control characters go, tag characters become blanks, blanks collapse, in this order."""
    return collapse_blanks(strip_tagish(strip_control(c)))


def content_tokens(c: Column | str) -> Column:
    """Lower-case tokens in order, without stopwords; null gives an empty array."""
    found = F.transform(F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.regexp_replace(F.lower(t), r"^[._\-]+|[._\-]+$", ""))
    return F.filter(found, lambda t: (t != "") & ~t.isin(*STOPWORDS))


def coverage(claim: Column | str, evidence: Column | str) -> Column:
    """Share of the claim's content tokens that the evidence has; 1 for a claim without any."""
    want, have = content_tokens(claim), content_tokens(evidence)
    return F.when(F.size(want) == 0, 1.0).otherwise(F.size(F.filter(want, lambda t: F.array_contains(have, t))) / F.size(want))


def fabricated_numbers(claim: Column | str, evidence: Column | str) -> Column:
    """Number tokens of the claim that the evidence lacks."""
    have = content_tokens(evidence)
    return F.filter(content_tokens(claim), lambda t: t.rlike(NUMERIC) & ~F.array_contains(have, t))


def estimate_tokens(c: Column | str, floor: int = 1) -> Column:
    """An upper bound of the tokens that any byte-level vocabulary makes: bytes, with a merge credit inside words."""
    atoms = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(ATOM), F.lit(0))
    cost = F.transform(atoms, lambda a: F.when(a.rlike("[A-Za-z0-9]$"), F.greatest(F.lit(1), F.ceil(F.octet_length(a) / floor).cast("int"))).otherwise(F.octet_length(a)))
    return F.aggregate(cost, F.lit(0), lambda s, x: s + x)


def citation_labels(c: Column | str) -> Column:
    """Distinct labels of markers like [1, 3–5], in printed order; ranges are not expanded."""
    inner = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(CITATION), F.lit(1))
    return F.filter(F.array_distinct(F.flatten(F.transform(inner, lambda m: F.split(m, r"[,\s–-]+")))), lambda x: x != "")


def entry_label(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(c), ENTRY_LABEL, 1), F.lit(""))


def caption_kind(c: Column | str) -> Column:
    return F.nullif(F.lower(F.regexp_extract(_col(c), CAPTION, 1)), F.lit(""))


def caption_number(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(c), CAPTION, 2), F.lit(""))


def section_number(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(c), SECTION, 1), F.lit(""))


def equation_number(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(c), EQUATION_NUMBER, 1), F.lit(""))


def arxiv_id(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(c), ARXIV, 1), F.lit(""))


def last_year(c: Column | str) -> Column:
    """The last year that stands outside an arXiv id."""
    return F.try_element_at(F.regexp_extract_all(F.regexp_replace(_col(c), ARXIV, " "), F.lit(YEAR), F.lit(1)), F.lit(-1)).cast("int")


def is_prose(c: Column | str) -> Column:
    return F.regexp_count(_col(c), F.lit("[A-Za-z]{4,}")) >= 2


def symbol_density(c: Column | str) -> Column:
    return F.when(F.length(_col(c)) == 0, 0.0).otherwise(F.regexp_count(_col(c), F.lit(r"[\p{Sm}∂∇∑∏√∞]")) / F.length(_col(c)))


def looks_unterminated(c: Column | str) -> Column:
    """No final stop, or one that only ends an abbreviation, or a hyphen at the end."""
    t = _col(c)
    abbreviation = t.rlike(r"(?i)\b(et al|e\.g|i\.e|cf|vs|Fig|Eq|Tab|Sec|resp|approx)\.\s*$")
    return ~t.rlike(r"[.!?][\"'’”)\]]*\s*$") | abbreviation | t.rlike(r"[-­‐]\s*$")


def opens_mid_sentence(c: Column | str) -> Column:
    return _col(c).rlike(r"^\s*\p{Ll}")


def is_page_number(c: Column | str) -> Column:
    return _col(c).rlike(PAGE_NUMBER)


def furniture_key(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.trim(_col(c))), "[0-9]+", "#")


def truncated(c: Column | str, length: int) -> Column:
    t = F.trim(F.regexp_replace(_col(c), r"[\r\n]+", " "))
    return F.when(F.length(t) > length, F.concat(F.substring(t, 1, length - 1), F.lit("…"))).otherwise(t)


def strip_reasoning(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"(?s)^\s*<think>.*?</think>\s*", "")


def camel_case(c: Column | str) -> Column:
    parts = F.split(_col(c), "_")
    return F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.initcap(p)), ""))


def three_classes(c: Column | str) -> Column:
    return _col(c).rlike("[A-Z]") & _col(c).rlike("[a-z]") & _col(c).rlike("[0-9]")


def mixed_script(c: Column | str) -> Column:
    """Some word mixes Latin letters with Cyrillic or Greek ones."""
    return _col(c).rlike(r"\p{IsLatin}[\p{IsCyrillic}\p{IsGreek}]|[\p{IsCyrillic}\p{IsGreek}]\p{IsLatin}")


def is_name_list(c: Column | str) -> Column:
    return F.forall(F.split(F.trim(_col(c)), r"[\s,;]+"), lambda w: (w == "") | w.rlike(r"^(and|&|\p{Lu}.*)$"))


def quoted_window(text: Column | str, selected: Column | str, around: int = 500) -> Column:
    """The text around the first place of ``selected``; null where it does not occur."""
    at = F.instr(_col(text), _col(selected))
    return F.when(at > 0, _col(text).substr(F.greatest(at - around, F.lit(1)), F.length(_col(selected)) + 2 * around))


def base32_id(prefix: str, chars: int, *parts: Column) -> Column:
    """``prefix`` and the first ``chars`` base-32 digits (a-z2-7) of the SHA-256 of the parts joined by ``|``."""
    bits = F.array_join(F.transform(F.split(F.sha2(F.concat_ws("|", *parts), 256).substr(1, (chars * 5 + 3) // 4), ""), lambda h: F.when(h != "", F.lpad(F.conv(h, 16, 2), 4, "0")).otherwise("")), "")
    digits = F.transform(F.sequence(F.lit(0), F.lit(chars - 1)), lambda i: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz234567"), F.conv(F.substring(bits, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1)))
    return F.concat(F.lit(prefix), F.array_join(digits, ""))
