"""Oversized texts cut into overlapping pieces at natural boundaries.

Cuts are balanced: from the least number of pieces follow evenly spaced targets, each of which moves to the strongest
boundary nearby that keeps every limit; pieces are added until the text's boundaries allow their number.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirestack.operators.nested import byte_chunks
from quirestack.session import free_names

LIMIT, OVERLAP = 1600, 160
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, FORCED = 5, 4, 3, 2, 1, 0
#: What the kinds of boundary are called, by strength.
KINDS = ("forced", "word", "clause", "sentence", "line", "paragraph")

_SPACE = np.array([cp for cp in range(0x3001) if chr(cp).isspace()], np.uint32)
_STOP = np.array([ord(c) for c in ".!?…。！？؟।"], np.uint32)
_PAUSE = np.array([ord(c) for c in ",;:—–،、，；：)]"], np.uint32)
_CLOSER = np.array([ord(c) for c in "\"'”’»)]*_"], np.uint32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def longest_run(points: np.ndarray) -> int:
    """Length of the longest stretch without white space."""
    at = np.flatnonzero(np.isin(points, _SPACE))
    return int(np.diff(np.r_[-1, at, len(points)]).max() - 1)


def boundaries(points: np.ndarray) -> np.ndarray:
    """Strength of a cut before each position; 0 where no white space ends."""
    n = len(points)
    space = np.isin(points, _SPACE)
    strength = np.zeros(n + 1, np.int8)
    # inside a run of white space a cut loses nothing, unless it parts the two halves of a line end
    run = np.flatnonzero(space[1:] & space[:-1] & ~((points[:-1] == 13) & (points[1:] == 10))) + 1
    strength[run] = WORD
    cut = np.flatnonzero(space[:-1] & ~space[1:]) + 1 if n else np.zeros(0, np.int64)
    if not len(cut):
        return strength
    # the run of white space before each cut, and the last sign before it
    last = np.maximum.accumulate(np.where(space, -1, np.arange(n)))[cut - 1]
    newlines = np.r_[0, np.cumsum((points == 10) | ((points == 13) & np.r_[points[1:] != 10, True]))]
    breaks = newlines[cut] - newlines[last + 1]
    before = np.where(last >= 0, points[last], 0)
    inner = np.where(np.isin(before, _CLOSER) & (last > 0), points[np.maximum(last - 1, 0)], before)
    level = np.full(len(cut), WORD, np.int8)
    level[np.isin(before, _PAUSE)] = CLAUSE
    level[np.isin(inner, _STOP)] = SENTENCE
    level[breaks == 1] = LINE
    level[breaks > 1] = PARAGRAPH
    strength[cut] = level
    return strength


def _forced_places(points: np.ndarray, start: int, end: int, room: int) -> list[int]:
    """Evenly spaced cuts for a stretch without white space, none before a combining mark, no two further apart than ``room``."""
    out = []
    while end - start > room:
        left = -(-(end - start) // room)
        at = start + -(-(end - start) // left)
        while at > start + 1 and unicodedata.category(chr(points[at]))[0] == "M":
            at -= 1
        if at == start + 1 and unicodedata.category(chr(points[at]))[0] == "M":
            at = start + room  # nothing but marks for a whole piece
        out.append(at)
        start = at
    return out


def _places(points: np.ndarray, strength: np.ndarray, room: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """All places where a cut may be, and the farthest that each can reach: the last boundary within ``room``, or a forced
    place where a whole piece's length has no boundary.  The first place is where the first piece's own room begins."""
    n = len(points)
    cuts = np.flatnonzero(strength[:n])
    cuts = np.r_[overlap, cuts[cuts > overlap]]
    gaps = np.flatnonzero(np.diff(np.r_[cuts, n]) > room)
    ends = np.r_[cuts[1:], n]
    forced = [x for g in gaps for x in _forced_places(points, int(cuts[g]), int(ends[g]), room)]
    at = np.sort(np.r_[cuts, np.array(forced, np.int64)]).astype(np.int64)
    # the last boundary in reach; a forced place only where there is none
    free = np.flatnonzero(~np.isin(at, forced)) if forced else np.arange(len(at))
    last = free[np.searchsorted(at[free], at + room, "right") - 1]
    return at, np.where(last > np.arange(len(at)), last, np.minimum(np.arange(len(at)) + 1, len(at) - 1))


def cut_points(points: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[int], np.ndarray]:
    """Where to cut, and the strength of a cut before each position; no cut if the text is within the limit.

    Starting from the least number of pieces that the length allows, pieces are added until the boundaries allow that
    number; then every cut is snapped to the strongest boundary near its even target that leaves the rest feasible.
    """
    n = len(points)
    strength = boundaries(points)
    if n <= limit:
        return [], strength
    room = limit - overlap
    at, reach = _places(points, strength, room, overlap)
    # earliest[k]: the first place from which k + 1 pieces reach the end
    earliest = [int(np.searchsorted(at, n - room))]
    while earliest[-1] > 0:
        earliest.append(int(np.searchsorted(reach, earliest[-1])))
    pieces = len(earliest)
    forced = strength[np.minimum(at, n)] == FORCED
    cuts: list[int] = []
    here, prev = 0, overlap
    for left in range(pieces - 1, 0, -1):
        target = prev + (n - prev) // (left + 1)
        low, high = max(here + 1, earliest[left - 1]), int(reach[here])
        span = np.arange(low, high + 1)
        span = span[~forced[span]] if not forced[high] else span[-1:]
        pull = np.abs(at[span] - target) / max(1, limit // 4)
        here = int(span[np.argmax(strength[at[span]] - 2.0 * pull)])
        prev = int(at[here])
        cuts.append(prev)
    return cuts, strength


def split_texts(df: DataFrame, text: str, keys: list[str], limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """The pieces of each text: at most ``limit`` characters (code points), each after the first beginning with the last
    ``overlap`` characters of the one before, cut after white space whenever a piece's length has some.

    Columns: ``keys``, ``piece_no`` (from 0), ``piece_count``, ``start_char`` (with the overlap), ``end_char``, ``cut_kind``
    (how the piece ends: paragraph, line, sentence, clause, word, forced, or end), ``item_chars``, ``longest_run`` (longest
    stretch without white space) and, with ``with_text``, ``piece_text``.  A text within the limit is one piece; an empty
    one is one empty piece; null has none.  Repeated rows give repeated pieces.  A key named like an output column gets
    the prefix ``in_``.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    own = {"piece_no": "int", "piece_count": "int", "start_char": "int", "end_char": "int", "cut_kind": "string", "item_chars": "int", "longest_run": "int"} | ({"piece_text": "string"} if with_text else {})
    names = free_names(keys, [*own, "_text"])
    src = df.where(F.col(text).isNotNull()).select(*(F.col(k).alias(names[k]) for k in keys), F.col(text).alias("_text"))
    made = T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in own.items()))
    schema = T.StructType([*(src.schema[names[k]] for k in keys), *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in byte_chunks(batch, "_text")):
            row, cols = [], [[] for _ in own]
            for i, text in enumerate(b.column("_text").to_pylist()):
                points = code_points(text)
                n = len(points)
                cuts, strength = cut_points(points, limit, overlap)
                longest = longest_run(points)
                for k, (a, z) in enumerate(zip([0, *(c - overlap for c in cuts)], [*cuts, n], strict=True)):
                    row.append(i)
                    values = (k, len(cuts) + 1, a, z, KINDS[strength[z]] if z < n else "end", n, longest, text[a:z])
                    for c, v in zip(cols, values, strict=False):
                        c.append(v)
            take = pa.array(row, pa.int64())
            arrays = [pa.array(c, pa.string() if k in ("cut_kind", "piece_text") else pa.int32()) for c, k in zip(cols, own, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(len(keys))), *arrays], names=schema.names)

    return src.mapInArrow(run, schema)
