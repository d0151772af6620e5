"""The one normal form of texts, behind hashes, ids and quote matching, and the form for matching quotes with its way back.

The form: canonical composition, ligatures expanded, each run of white space one blank, no blanks at the ends, full case
folding by code point.  Strings are handed over in Arrow batches; each step is one call of the interpreter's C code.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ligatures, white space, hyphens at line ends.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ"}
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　﻿"
HYPHENS, NEWLINES = "-­‐‑", "\n\r"

_RUN = re.compile(f"[{SPACES}]+")
_LIGATURE = str.maketrans(LIGATURES)


@functools.cache
def _folds() -> dict[int, str]:
    """Full case folding of each code point that has one."""
    return {cp: low for cp in range(0x1F000) if not 0xD800 <= cp < 0xE000 and (low := chr(cp).casefold()) != chr(cp)}


def normal_form(text: str) -> str:
    """The normal form of one text."""
    spaced = _RUN.sub(" ", unicodedata.normalize("NFC", text).translate(_LIGATURE)).strip(" ")
    return spaced.lower() if spaced.isascii() else spaced.translate(_folds())


def match_form(text: str) -> tuple[str, list[int]]:
    """The form in which quotes are compared, and for each of its characters (and its end) the place in ``text`` it came from.

    A hyphen before a line end goes, with the line end, if a letter is before it and a lower-case letter after it; runs of
    white space are one blank; each character is then brought to the normal form by itself.
    """
    kept: list[tuple[str, int]] = []
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c in HYPHENS and i and text[i - 1].isalpha():
            j = i + 1
            while j < n and text[j] in NEWLINES:
                j += 1
            if j > i + 1 and j < n and text[j].isalpha() and text[j].islower():
                i = j
                continue
        if c in SPACES:
            if kept and kept[-1][0] != " ":
                kept.append((" ", i))
        else:
            kept.append((c, i))
        i += 1
    if kept and kept[-1][0] == " ":
        kept.pop()
    out, places = [], []
    for c, at in kept:
        for f in c if c == " " else normal_form(c):
            out.append(f)
            places.append(at)
    return "".join(out), [*places, n]


def word_edge(text: str, place: int, step: int) -> int:
    """The place moved by ``step`` (1 or -1) until it parts no word."""
    at = min(max(place, 0), len(text))
    while 0 < at < len(text) and text[at - 1] not in SPACES and text[at] not in SPACES:
        at += step
    return at


@F.pandas_udf(T.StringType())
def normal_text(texts: pd.Series) -> pd.Series:
    """Null for null."""
    return texts.map(normal_form, na_action="ignore")


@F.pandas_udf(T.StructType([T.StructField("form", T.StringType()), T.StructField("places", T.ArrayType(T.IntegerType()))]))
def matching(texts: pd.Series) -> pd.DataFrame:
    """``match_form`` of each text; null gives the empty form."""
    made = [match_form(t) if isinstance(t, str) else ("", [0]) for t in texts]
    return pd.DataFrame({"form": [m[0] for m in made], "places": [m[1] for m in made]})


@F.pandas_udf(T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())]))
def context(texts: pd.Series, starts: pd.Series, ends: pd.Series, around: pd.Series) -> pd.DataFrame:
    """About ``around`` characters on both sides of a stretch, cut at the edges of words."""
    rows = []
    for t, s, e, n in zip(texts, starts, ends, around, strict=True):
        rows.append((t[word_edge(t, s - n, -1) : s], t[e : word_edge(t, e + n, 1)]) if isinstance(t, str) else (None, None))
    return pd.DataFrame(rows, columns=["before", "after"])


def content_hash(normal: Column) -> Column:
    """The hash of a normal form."""
    return F.concat(F.lit("sha256:"), F.sha2(normal.cast("binary"), 256))


def has_lone_surrogate(c: Column) -> Column:
    """A text that has no UTF-8 form reaches Spark with replacement characters in it."""
    return F.contains(c, F.lit("�"))


def context_errors(haystack: Column, wanted: Column, start: Column) -> Column:
    """How many characters of ``wanted`` do not stand in ``haystack`` from ``start`` (0-based, not below 0) on; null for an
    empty ``wanted`` and where nothing is left."""
    window = F.substring(haystack, F.greatest(start, F.lit(0)) + 1, F.length(wanted))
    both = F.least(F.length(window), F.length(wanted))
    off = F.aggregate(F.sequence(F.lit(1), both), F.lit(0), lambda s, i: s + (F.substring(window, i, F.lit(1)) != F.substring(wanted, i, F.lit(1))).cast("int"))
    return F.when((F.length(wanted) > 0) & (F.length(window) > 0), F.length(wanted) - F.length(window) + off)
