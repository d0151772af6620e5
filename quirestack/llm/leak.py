"""Held-out passages inside a corpus, by greedy string tiling.

Texts become arrays of word hashes, made for a whole batch at once.  Runs of SEED shared words (rolling hashes, joined
with those of the held-out texts) name the pairs to compare; in each pair the longest shared runs that do not overlap
are marked again and again, and the tiles' coverage shows passages whose parts come in another order.  Along the
diagonals of all shared runs the longest passages with at most one other word in WINDOW are sought.
"""

from __future__ import annotations

import functools
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirestack.llm.canon import canonical_points
from quirestack.operators.nested import byte_chunks
from quirestack.session import cut, free_names

WINDOW, OTHERS = 12, 1
#: A window with one other word has at least so many shared words in a row.
SEED = (WINDOW - OTHERS + 1) // (OTHERS + 1)
#: Characters of held-out text whose index every executor holds at most; more are joined by a shuffle of their seeds.
PASS_CHARS = 20_000_000
#: Tiles that cover this share of a held-out text are a leak in whatever order they come.
COVERED = 0.8
#: The filter of held-out seeds has 2 to this power bits (32 MB).
SIEVE_BITS = 28

_MIX = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _lower() -> np.ndarray:
    """Lower-case code point by code point; 0 for what is no letter, digit or mark, 1 for white space."""
    n = 0x110000
    out = np.zeros(n, np.uint32)
    for a, b in ((0, 0x3400), (0xA000, 0xAC00), (0xF900, 0x20000)):
        for cp in range(a, b):
            ch = chr(cp)
            if ch.isspace():
                out[cp] = 1
            elif unicodedata.category(ch)[0] in "LNM":
                low = ch.lower()
                out[cp] = ord(low[0])
    for a, b in ((0x3400, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x32000)):
        out[a:b] = np.arange(a, b)
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and where each text's words begin.

    Words are what white space separates, regardless of case, punctuation, emphasis marks and invisible characters; a
    word without a letter or digit is none.  Null has no words.
    """
    n = len(texts)
    points, ends = canonical_points(texts)
    low = _lower()[points]
    # white space and the starts of texts part words; other characters vanish
    gap = low == 1
    part = np.cumsum(gap)
    keep = low > 1
    chars, owner = low[keep].astype(np.uint64), part[keep]
    text_of = (np.searchsorted(ends, np.flatnonzero(keep), "right") - 1).astype(np.int64)
    if not len(chars):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    first = np.r_[True, (owner[1:] != owner[:-1]) | (text_of[1:] != text_of[:-1])]
    start = np.flatnonzero(first)
    place = np.arange(len(chars)) - np.repeat(start, np.diff(np.r_[start, len(chars)]))
    x = (chars + (place.astype(np.uint64) << np.uint64(21)) + np.uint64(1)) * _MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    hashes = np.add.reduceat(x, start)
    return hashes, np.searchsorted(text_of[start], np.arange(n + 1))


def rolling(words: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin value of each run of ``length`` words."""
    n = len(words) - length + 1
    out = np.zeros(max(0, n), np.uint64)
    for k in range(length):
        out = out * _MIX + words[k : k + max(0, n)]
    return out


def runs(doc: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """The longest shared runs of at least ``least`` words, which may overlap: (length, place in doc, place in item)."""
    a, b = rolling(doc, least), rolling(item, least)
    if not len(a) or not len(b):
        return []
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    count = hi - lo
    i = np.repeat(np.arange(len(a)), count)
    j = order[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    if not len(i):
        return []
    by = np.lexsort((i, i - j))
    i, j = i[by], j[by]
    cut = np.flatnonzero(np.r_[True, (np.diff(i - j) != 0) | (np.diff(i) != 1)])
    return [(int(z - s + least - 1), int(i[s]), int(j[s])) for s, z in zip(cut, np.r_[cut[1:], len(i)], strict=True)]


def tiles(doc: np.ndarray, item: np.ndarray, shared: list[tuple[int, int, int]], least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling over the ``shared`` runs: (place in doc, place in item, length), longest first, none overlapping in either text."""
    heap = [(-n, p, q) for n, p, q in shared]
    heapq.heapify(heap)
    in_doc, in_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    out = []
    while heap:
        n, p, q = heapq.heappop(heap)
        n = -n
        taken = in_doc[p : p + n] | in_item[q : q + n]
        if not taken.any():
            in_doc[p : p + n] = in_item[q : q + n] = True
            out.append((p, q, int(n)))
            continue
        at = np.flatnonzero(np.r_[True, taken, True])
        for s, z in zip(at[:-1], at[1:], strict=True):  # the free stretches between marked words
            if z - s - 1 >= least:
                heapq.heappush(heap, (-int(z - s - 1), int(p + s), int(q + s)))
    return out


def reproduced(doc: np.ndarray, item: np.ndarray, shared: list[tuple[int, int, int]], window: int = WINDOW, others: int = OTHERS) -> int:
    """Words of the longest stretch along a shared run's diagonal in which every ``window`` words hold at most ``others`` others; 0 if none is that long."""
    best = 0
    for shift in {p - q for _, p, q in shared}:
        a, b = max(0, shift), max(0, -shift)
        n = min(len(doc) - a, len(item) - b)
        if n < window:
            continue
        same = np.r_[0, np.cumsum(doc[a : a + n] == item[b : b + n])]
        good = same[window:] - same[:-window] >= window - others
        if good.any():
            edge = np.flatnonzero(np.diff(np.r_[False, good, False].astype(np.int8)))
            best = max(best, int((edge[1::2] - edge[::2]).max()) + window - 1)
    return best


def judged(doc: np.ndarray, item: np.ndarray, coverage: float) -> tuple[int, int, int, int] | None:
    """(copied_words, tile_count, covered_words, item_words) of a pair that leaks, None of any other."""
    shared = runs(doc, item)
    copied, tiled = reproduced(doc, item, shared), tiles(doc, item, shared)
    covered = sum(n for _, _, n in tiled)
    if copied or (covered >= WINDOW and covered >= coverage * len(item)):
        return copied, len(tiled), covered, len(item)
    return None


FOUND = "copied_words int, tile_count int, covered_words int, item_words int"


def leaks(docs: DataFrame, text: str, key: str, items: DataFrame, item_key: str, parts: list[str], pass_chars: int = PASS_CHARS, coverage: float = COVERED) -> DataFrame:
    """Documents that reproduce a held-out text: at least WINDOW consecutive words of it, at most OTHERS in WINDOW being
    another, or, in whatever order, tiles that cover the share ``coverage`` of it and WINDOW words.

    Columns: ``key``, ``item_key``, ``item_part`` (which of the columns ``parts``), ``copied_words`` (longest passage of
    consecutive words; 0 where only the coverage counts), ``tile_count``, ``covered_words`` and ``item_words``.  Items
    that share a text all get the row.  Null and empty texts and texts below WINDOW words match nothing.  Repeated rows
    count once.  Held-out texts of together at most ``pass_chars`` characters are indexed on every executor; more are
    joined by their seeds, after a filter of fixed size has dropped the documents' seeds that no held-out text has.
    """
    doc_name, item_name = key, free_names([item_key], [key, "item_part", "copied_words", "tile_count", "covered_words", "item_words"])[item_key]
    long = items.select(F.col(item_key).alias("_id"), F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.col(p).cast("string").alias("text")) for p in parts))).alias("_p")).where("_p.text is not null").select("_id", F.col("_p.part").alias("_part"), F.col("_p.text").alias("_held"))
    long = long.distinct().withColumn("_item", F.md5("_held"))
    held = long.select("_item", "_held").distinct()
    src = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_doc"), F.col(text).alias("_text"))
    size = held.agg(F.sum(F.length("_held"))).first()[0] or 0
    found = _indexed(src, held, coverage) if size <= pass_chars else _by_seeds(src, held, coverage)
    rows = found.join(long.drop("_held"), "_item").select(F.col("_doc").alias(doc_name), F.col("_id").alias(item_name), F.col("_part").alias("item_part"), "copied_words", "tile_count", "covered_words", "item_words")
    return rows.distinct()


def _seeds(words: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The seeds of texts in a row, and the text of each."""
    seeds = rolling(words, SEED)
    owner = np.searchsorted(start, np.arange(len(seeds)), "right") - 1
    fits = np.arange(len(seeds)) + SEED <= start[owner + 1] if len(seeds) else np.zeros(0, bool)
    return seeds[fits], owner[fits]


def _indexed(src: DataFrame, held: DataFrame, coverage: float) -> DataFrame:
    """The pairs that leak, with an index of all held-out texts on every executor."""
    session = src.sparkSession
    block = held.toArrow().combine_chunks()
    codes = block.column("_item").to_pylist()
    words, start = word_hashes(block.column("_held").combine_chunks())
    seeds, owner = _seeds(words, start)
    order = np.argsort(seeds, kind="stable")
    shared = session.sparkContext.broadcast((seeds[order], owner[order], words, start, codes))
    schema = T.StructType([src.schema["_doc"], *T.StructType.fromDDL("_item string, " + FOUND)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, owner, words, begin, codes = shared.value
        for batch in batches:
            for part in byte_chunks(batch, "_text"):
                got, at = word_hashes(part.column("_text"))
                mine = rolling(got, SEED)
                if not len(mine) or not len(seeds):
                    continue
                lo = np.searchsorted(seeds, mine)
                where = np.flatnonzero(seeds[np.minimum(lo, len(seeds) - 1)] == mine)
                row = np.searchsorted(at, where, "right") - 1
                inside = where + SEED <= at[row + 1]
                where, row = where[inside], row[inside]
                lo, hi = lo[where], np.searchsorted(seeds, mine[where], "right")
                count = hi - lo
                who = owner[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
                pairs = np.unique(np.repeat(row, count) * np.int64(len(codes)) + who)
                rows = []
                for r, k in zip((pairs // len(codes)).tolist(), (pairs % len(codes)).tolist(), strict=True):
                    if (verdict := judged(got[at[r] : at[r + 1]], words[begin[k] : begin[k + 1]], coverage)) is not None:
                        rows.append((r, codes[k], *verdict))
                if rows:
                    r, code, *numbers = map(list, zip(*rows, strict=True))
                    arrays = [part.column(0).take(pa.array(r, pa.int64())), pa.array(code, pa.string()), *(pa.array(c, pa.int32()) for c in numbers)]
                    yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return src.mapInArrow(run, schema)


def _seed_rows(texts: DataFrame, code: str, text: str, sieve: Broadcast | None) -> DataFrame:
    """The distinct seeds of each text under its code; with ``sieve``, those whose slot is set in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_chunks(batch, text):
                seeds, owner = _seeds(*word_hashes(part.column(text)))
                if sieve is not None:
                    slot = seeds >> np.uint64(64 - SIEVE_BITS)
                    hit = sieve.value[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1) > 0
                    seeds, owner = seeds[hit], owner[hit]
                yield pa.RecordBatch.from_arrays([part.column(code).take(pa.array(owner)), pa.array(seeds.view(np.int64))], names=[code, "_seed"])

    return texts.select(code, text).mapInArrow(run, f"{code} string, _seed long").distinct()


def _by_seeds(src: DataFrame, held: DataFrame, coverage: float) -> DataFrame:
    """The pairs that leak, by a join on seeds; hot seeds are split by the join's skew handling, copies of a text are compared once."""
    session = src.sparkSession
    theirs = cut(_seed_rows(held, "_item", "_held", None))
    # one bit for each slot that some held-out seed falls into; never more than 2 ** SIEVE_BITS bits
    slot = F.shiftrightunsigned("_seed", 64 - SIEVE_BITS)
    bits = theirs.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_seed, {64 - SIEVE_BITS}) & 63 as int))")).alias("b")).toArrow()
    sieve = np.zeros(1 << (SIEVE_BITS - 6), np.uint64)
    sieve[bits.column("w").to_numpy()] = bits.column("b").to_numpy().view(np.uint64)
    texts = src.withColumn("_code", F.md5("_text"))
    ours = _seed_rows(texts, "_code", "_text", session.sparkContext.broadcast(sieve))
    pairs = cut(ours.join(theirs, "_seed").select("_code", "_item").distinct())
    bodies = texts.join(pairs.select("_code").distinct(), "_code", "left_semi").groupBy("_code").agg(F.first("_text").alias("_text"))
    full = pairs.join(bodies, "_code").join(held, "_item").select("_code", "_item", "_text", "_held")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_chunks(batch, "_text"):
                (a, at), (b, begin) = word_hashes(part.column("_text")), word_hashes(part.column("_held"))
                judgements = [judged(a[at[i] : at[i + 1]], b[begin[i] : begin[i + 1]], coverage) for i in range(part.num_rows)]
                keep = [i for i, x in enumerate(judgements) if x is not None]
                numbers = [pa.array([judgements[i][k] for i in keep], pa.int32()) for k in range(4)]
                some = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("_code").take(some), part.column("_item").take(some), *numbers], names=["_code", "_item", *(x.split()[0] for x in FOUND.split(", "))])

    good = full.mapInArrow(run, "_code string, _item string, " + FOUND)
    return texts.select("_doc", "_code").join(good, "_code").drop("_code")
