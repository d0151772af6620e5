"""One consistent form for texts that print alike.

A batch of texts becomes one array of code points.  Lookup tables give each code point its expansion (accents apart,
width and joined letters undone, look-alike letters as Latin ones, invisible characters gone); the expansions are
gathered at offsets from a prefix sum.  Marks are then ordered and composed for all texts at once.
"""

from __future__ import annotations

import functools
import itertools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirestack.operators.nested import byte_chunks
from quirestack.session import cut, free_names

# Letters of other scripts that print like the Latin letter at the same place in the second line.
LOOK_ALIKE = "АВЕКМНОРСТУХЅІЈԌԚԜҮӀаеорсухѕіјһԁԛԝӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧνοϲϳ"
LATIN = "ABEKMHOPCTYXSIJGQWYIaeopcyxsijhdqwlABEZHIKMNOPTYXvocj"
# Characters without a glyph that are not of category Cf.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠎᠏ㅤﾠ"
HYPHENS = "‐‑"

# The ranges outside which no code point decomposes, combines or is invisible (Hangul goes by rule).
ASSIGNED = ((0, 0x3400), (0xA000, 0xAC00), (0xF900, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE01F0))

S_BASE, L_BASE, V_BASE, T_BASE = 0xAC00, 0x1100, 0x1161, 0x11A7


def _joined(ch: str, kind: str) -> bool:
    name = unicodedata.name(ch, "")
    return kind == "compat" and (" LIGATURE " in name or name.startswith("LATIN") and unicodedata.category(ch)[0] == "L" and len(unicodedata.normalize("NFKD", ch)) > 1)


@functools.cache
def tables(fold: bool = True) -> dict[str, np.ndarray]:
    """Lookup tables over all code points, derived from Unicode's data; without ``fold`` those of plain NFC."""
    n = sys.maxunicode + 1
    same = dict(zip(LOOK_ALIKE, LATIN, strict=True)) | dict.fromkeys(HYPHENS, "-")
    canonical: dict[tuple[int, int], int] = {}
    expand: dict[int, str] = {}
    classes = np.zeros(n, np.uint8)

    def full(ch: str) -> str:
        if S_BASE <= ord(ch) < S_BASE + 11172:
            return ch
        kind, _, _ = unicodedata.decomposition(ch).partition(" ")
        parts = unicodedata.decomposition(ch)
        if parts and not parts.startswith("<"):
            return "".join(full(chr(int(x, 16))) for x in parts.split())
        if not fold:
            return ch
        kind = kind.strip("<>")
        if kind in ("wide", "narrow", "noBreak", "initial", "medial", "final", "isolated") or kind and _joined(ch, kind) or ch == "µ":
            out = "".join(full(chr(int(x, 16))) for x in parts.split()[1:])
        else:
            out = ch
        if out == ch and (unicodedata.category(ch) == "Cf" or ch in INVISIBLE or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF):
            return ""
        if unicodedata.category(ch) == "Zs" or ch == "\t":
            return " "
        return "".join(same.get(x, x) for x in out)

    for cp in itertools.chain(*(range(a, b) for a, b in ASSIGNED)):
        ch = chr(cp)
        if c := unicodedata.combining(ch):
            classes[cp] = c
        d = unicodedata.decomposition(ch)
        if d and not d.startswith("<") and " " in d and unicodedata.normalize("NFC", ch) == ch:
            a, b = (int(x, 16) for x in d.split())
            canonical[a, b] = cp
        if d or cp > 126 or cp == 9:
            e = full(ch)
            if e != ch:
                expand[cp] = e
    length = np.ones(n, np.int64)
    start = np.zeros(n, np.int64)
    single = np.arange(n, dtype=np.uint32)
    flat: list[int] = []
    for cp, e in expand.items():
        length[cp] = len(e)
        if len(e) == 1:
            single[cp] = ord(e)
        elif e:
            start[cp] = len(flat)
            flat += map(ord, e)
    pairs = np.array([[a, b, c] for (a, b), c in canonical.items()], np.int64)
    key = pairs[:, 0] << 21 | pairs[:, 1]
    order = np.argsort(key)
    joins = classes > 0
    joins[pairs[:, 1]] = True
    joins[V_BASE : V_BASE + 21] = True
    joins[T_BASE + 1 : T_BASE + 28] = True
    return {"length": length, "start": start, "single": single, "flat": np.array(flat or [0], np.uint32), "class": classes, "key": key[order], "to": pairs[order, 2], "joins": joins}


def _composite(base: np.ndarray, mark: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
    """The composed code point of each pair, 0 if there is none."""
    key = base.astype(np.int64) << 21 | mark
    at = np.minimum(np.searchsorted(t["key"], key), len(t["key"]) - 1)
    out = np.where(t["key"][at] == key, t["to"][at], 0)
    lead, vowel = base.astype(np.int64) - L_BASE, mark.astype(np.int64) - V_BASE
    out = np.where((lead >= 0) & (lead < 19) & (vowel >= 0) & (vowel < 21), S_BASE + (lead * 21 + vowel) * 28, out)
    syllable, tail = base.astype(np.int64) - S_BASE, mark.astype(np.int64) - T_BASE
    return np.where((syllable >= 0) & (syllable < 11172) & (syllable % 28 == 0) & (tail > 0) & (tail < 28), base + tail, out)


def canonical_points(texts: pa.Array, fold: bool = True, tidy: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all consistent forms in a row, and where each text's begin; null is like an empty text.

    Without ``tidy`` accents stay apart from their letters and blanks at line ends stay, for callers that drop both.
    """
    t = tables(fold)
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    ends = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][off - off[0]]
    # expansion at offsets from a prefix sum
    size = t["length"][points]
    new_off = np.r_[0, np.cumsum(size)]
    out = np.repeat(t["single"][points], size)
    many = np.flatnonzero(size > 1)
    if len(many):
        at = np.repeat(new_off[many] - np.r_[0, np.cumsum(size[many])[:-1]], size[many]) + np.arange(size[many].sum())
        out[at] = t["flat"][np.repeat(t["start"][points[many]], size[many]) + (at - np.repeat(new_off[many], size[many]))]
    row_end = new_off[ends]
    if not tidy:
        return out, row_end
    if fold:
        out, row_end = _blanks(out, row_end)
    joins = t["joins"][out]
    return _compose(out, row_end, joins, t) if joins.any() else (out, row_end)


def canonical_array(texts: pa.Array, fold: bool = True) -> pa.Array:
    """The consistent form of each text; null stays null.  Without ``fold`` only accents are made consistent (NFC)."""
    out, row_end = canonical_points(texts, fold)
    data = out.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (out > 0x7F) + (out > 0x7FF) + (out > 0xFFFF)
    byte_off = np.r_[0, np.cumsum(width)][row_end].astype(np.int64)
    made = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(byte_off), pa.py_buffer(data))
    return pa.compute.if_else(texts.is_valid(), made, pa.scalar(None, pa.large_string())).cast(pa.string())


def _blanks(out: np.ndarray, row_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line ends as one character, and no blanks where they do not show: at the end of a line."""
    newline = out == 0x0A
    cr = out == 0x0D
    before_newline = np.r_[newline[1:], False]
    before_newline[row_end[1:][row_end[1:] > 0] - 1] = False
    keep = ~(cr & before_newline)
    out = np.where(cr, np.uint32(0x0A), out)
    ends = np.flatnonzero(keep & (out == 0x0A))
    blank = out == 0x20
    # the next position that is not a blank; a blank run that reaches a line end or the text's end goes
    idx = np.where(~blank & keep, np.arange(len(out)), len(out))
    nxt = np.minimum.accumulate(idx[::-1])[::-1] if len(out) else idx
    row = np.searchsorted(row_end, np.arange(len(out)), "right") - 1
    stop = row_end[1:][np.minimum(row, len(row_end) - 2)] if len(out) else row
    is_end = np.zeros(len(out) + 1, bool)
    is_end[ends] = True
    is_end[len(out)] = True
    keep &= ~(blank & ((nxt >= stop) | is_end[nxt]))
    return out[keep], np.r_[0, np.cumsum(keep)][row_end]


def _compose(out: np.ndarray, row_end: np.ndarray, joins: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order marks by class within their runs and compose them with their base, all runs at once."""
    first = np.zeros(len(out), bool)
    first[row_end[:-1][row_end[:-1] < len(out)]] = True
    ccc = t["class"][out]
    run = np.cumsum((ccc == 0) | first)
    marks = np.flatnonzero(ccc > 0)
    if len(marks):
        order = np.lexsort((marks, ccc[marks], run[marks]))
        out = out.copy()
        out[marks] = out[marks[order]]
        ccc = t["class"][out]
    base = np.maximum.accumulate(np.where(~joins | first, np.arange(len(out)), -1))
    # a run may also start with a mark at the start of a text; that mark is then nobody's part but may be a base
    todo = np.flatnonzero(joins & ~first)
    held = base[todo]
    rank = todo - held
    keep = np.ones(len(out), bool)
    blocked = np.full(len(out), -1, np.int64)
    blocked[first & (ccc > 0)] = 255
    out = out.copy()
    step = 1
    order = np.argsort(rank, kind="stable")
    todo, held, rank = todo[order], held[order], rank[order]
    cuts = np.searchsorted(rank, np.arange(1, (rank.max() if len(rank) else 0) + 2))
    for step in range(len(cuts) - 1):
        m, b = todo[cuts[step] : cuts[step + 1]], held[cuts[step] : cuts[step + 1]]
        c = ccc[m].astype(np.int64)
        free = (blocked[b] < c) & ((c > 0) | (blocked[b] < 0))
        new = np.where(free, _composite(out[b], out[m], t), 0)
        hit = new > 0
        out[b[hit]] = new[hit]
        keep[m[hit]] = False
        miss = ~hit
        # what does not join and is no mark becomes the base of what follows
        blocked[b[miss]] = np.where(c[miss] == 0, 255, c[miss])
        starters = miss & (c == 0)
        if starters.any():
            _rebase(m[starters], todo, held, rank, cuts, step, blocked)
    return out[keep], np.r_[0, np.cumsum(keep)][row_end]


def _rebase(at: np.ndarray, todo: np.ndarray, held: np.ndarray, rank: np.ndarray, cuts: np.ndarray, step: int, blocked: np.ndarray) -> None:
    """Later members of the runs of ``at`` take ``at`` as their base."""
    old = held[cuts[step] : cuts[step + 1]][np.isin(todo[cuts[step] : cuts[step + 1]], at)]
    new_base = dict(zip(old.tolist(), at.tolist(), strict=True))
    later = np.arange(cuts[step + 1], len(todo))
    hit = later[np.isin(held[later], old)]
    if len(hit):
        held[hit] = [new_base[x] for x in held[hit].tolist()]
    blocked[at] = -1


def consistent_form(df: DataFrame, text: str, keys: list[str], output: str = "text_form") -> DataFrame:
    """``keys`` and the consistent form of column ``text`` as ``output``.

    Texts that print the same get the same form: the kind of blank, blanks at a line's end, the kind of line end,
    invisible characters, character width, joined letters, the encoding of accents and look-alike letters of other
    scripts make no difference.  Case, accents, raised or encircled digits, spelling and the number of blanks do.
    Null gives null, an empty text an empty one.  Other columns are not read; a key named like ``output`` gets the prefix ``in_``.
    """
    names = free_names(keys, [output, "_text"])
    src = df.select(*(F.col(k).alias(names[k]) for k in keys), F.col(text).alias("_text"))
    schema = T.StructType([*(src.schema[names[k]] for k in keys), T.StructField(output, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in byte_chunks(batch, "_text")):
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), canonical_array(b.column("_text"))], names=schema.names)

    return src.mapInArrow(run, schema)


def alike_classes(df: DataFrame, text: str, group: str, number: str) -> DataFrame:
    """One row for each row of a ``group`` whose text prints like another text of the group with other characters.

    Columns: ``group``, ``number``, ``form_id`` (digest of the form), ``text_id`` (digest of the text), ``representative``
    (the least number with this very text), ``variants`` (texts of the class) and ``members`` (rows of the class, each
    once).  Rows with null text, group or number take no part; an empty text is a text.  Repeated rows count once.
    """
    rows = df.where(F.col(text).isNotNull() & F.col(group).isNotNull() & F.col(number).isNotNull())
    rows = rows.select(F.col(group).alias("_g"), F.col(number).alias("_n"), F.col(text).alias("_t"))
    # digests of 128 bits in place of the form and the text
    slim = cut(consistent_form(rows, "_t", ["_g", "_n", "_t"], "_form").select("_g", "_n", F.unhex(F.md5("_form")).alias("_f"), F.unhex(F.md5("_t")).alias("_h")))
    mixed = slim.groupBy("_g", "_f").agg(F.min("_h").alias("_lo"), F.max("_h").alias("_hi")).where("_lo <> _hi").select("_g", "_f")
    part = slim.join(mixed, ["_g", "_f"], "left_semi").distinct()
    texts = part.groupBy("_g", "_f", "_h").agg(F.min("_n").alias("representative"), F.count(F.lit(1)).alias("_m"))
    classes = texts.groupBy("_g", "_f").agg(F.count(F.lit(1)).alias("variants"), F.sum("_m").alias("members"))
    out = part.join(texts.drop("_m"), ["_g", "_f", "_h"]).join(classes, ["_g", "_f"])
    return out.select(F.col("_g").alias(group), F.col("_n").alias(number), F.lower(F.hex("_f")).alias("form_id"), F.lower(F.hex("_h")).alias("text_id"), "representative", "variants", "members")


def alike_pairs(df: DataFrame, text: str, group: str, number: str) -> DataFrame:
    """Pairs of rows of one ``group`` whose texts differ in their characters but print the same: the classes of
    ``alike_classes`` with the pairs between their different texts spelled out.

    Columns: ``<number>_a`` < ``<number>_b``.  Only different texts of a class are joined with each other, by their
    representatives; copies of a text meet through it and never one another.
    """
    part = cut(alike_classes(df, text, group, number).select(F.col(group).alias("_g"), F.col(number).alias("_n"), F.col("form_id").alias("_f"), F.col("representative").alias("_r")))
    texts = part.select("_g", "_f", "_r").distinct()
    links = texts.join(texts.select("_g", "_f", F.col("_r").alias("_r2")), ["_g", "_f"]).where("_r < _r2")
    pairs = links.join(part, ["_g", "_f", "_r"]).join(part.select("_g", "_f", F.col("_n").alias("_n2"), F.col("_r").alias("_r2")), ["_g", "_f", "_r2"])
    return pairs.where("_n <> _n2").select(F.least("_n", "_n2").alias(f"{number}_a"), F.greatest("_n", "_n2").alias(f"{number}_b")).distinct()
