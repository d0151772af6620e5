"""Nested JSON records to flat, linked rows.

The structure of a whole batch of records is found at once: bitmaps of quotes,
brackets and delimiters over the batch's bytes, nesting depth by prefix sums,
and object spans and parent links by one stable sort on depth.  No record is
parsed by itself, except that text serialised more than once is unwrapped first.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirestack.session import free_names

CHUNK_BYTES = 4 << 20

OPEN_OBJ, CLOSE_OBJ, OPEN_ARR, CLOSE_ARR, COLON, COMMA, STRING, ATOM = range(8)

_KIND = np.full(256, 255, np.uint8)
for _c, _k in zip(b"{}[]:,", range(6), strict=True):
    _KIND[_c] = _k
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r")] = True
_ESCAPABLE = np.zeros(256, bool)
_ESCAPABLE[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_ATOM_RE = r"^(-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?|true|false|null)$"

_NEWLINE, _NOTHING, _SLASH = (pa.scalar(x, pa.large_string()) for x in ("\n", "", "/"))

_VALUE_START = np.zeros(8, bool)
_VALUE_START[[OPEN_OBJ, OPEN_ARR, STRING, ATOM]] = True
_VALUE_END = np.zeros(8, bool)
_VALUE_END[[CLOSE_OBJ, CLOSE_ARR, STRING, ATOM]] = True


def _unwrap(texts: pa.Array) -> pa.Array:
    """Texts that are one JSON string are replaced by what the string holds, as often as needed."""
    wrapped = pc.match_substring_regex(texts, r'^[ \t\r\n]*"').to_numpy(zero_copy_only=False)
    if not wrapped.any():
        return texts
    out = texts.to_pylist()
    for i in np.flatnonzero(wrapped):
        x = out[i]
        try:
            while x.lstrip(" \t\r\n").startswith('"'):
                x = json.loads(x)
        except ValueError:
            x = ""
        out[i] = x.encode("utf-8", "replace").decode("utf-8")
    return pa.array(out, texts.type)


def _spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges [start, end) as an Arrow string array."""
    n = end - start
    off = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=off[1:])
    at = np.arange(off[-1]) + np.repeat(start - off[:-1], n)
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(off), pa.py_buffer(data[at].tobytes()))


def index_objects(texts: pa.Array, with_text: bool = False) -> dict:
    """Nested objects of each record of ``texts`` (strings without nulls).

    Gives arrays: ``row`` (the record), ``parent`` and ``path`` (JSON Pointers), ``depth`` (number of enclosing
    objects), ``element`` (position in the array that holds the object, -1 if a field holds it) and, if wanted,
    ``text``.  A record that is not one complete JSON object has no rows; a record's own object is no row.
    """
    empty = {"row": np.zeros(0, np.int64), "parent": pa.array([], pa.large_string()), "path": pa.array([], pa.large_string()), "depth": np.zeros(0, np.int32), "element": np.zeros(0, np.int32), "text": pa.array([], pa.large_string())}
    texts = _unwrap(texts.cast(pa.large_string()))
    rows = np.arange(len(texts))
    keep = pc.match_substring_regex(texts, r"^[ \t\r\n]*\{[\s\S]*\}[ \t\r\n]*$").to_numpy(zero_copy_only=False)
    while True:
        texts, rows = texts.filter(pa.array(keep)), rows[keep]
        if not len(rows):
            return empty
        ended = pc.binary_join_element_wise(texts, _NEWLINE, _NOTHING)  # no run of backslashes reaches the next record
        off = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset : ended.offset + len(ended) + 1]
        data = np.frombuffer(ended.buffers()[2], np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        # quote bitmap: a quote counts unless an odd run of backslashes precedes it
        escaped = np.zeros(len(data) + 1, bool)
        slash = np.flatnonzero(data == 0x5C)
        if len(slash):
            first = np.r_[True, slash[1:] != slash[:-1] + 1]
            run = np.cumsum(first) - 1
            nth = slash - slash[first][run]
            lead = slash[nth % 2 == 0]  # these begin an escape
            escaped[lead + 1] = True
        else:
            lead = slash
        escaped = escaped[:-1]
        quote = (data == 0x22) & ~escaped
        keep = np.add.reduceat(quote, off[:-1], dtype=np.int64) % 2 == 0
        if keep.all():
            break
    inside = np.bitwise_xor.accumulate(quote.view(np.uint8)).view(bool)  # from an opening quote up to before its closing one
    bad_at = [np.flatnonzero(inside & (data < 0x20))]
    if len(lead):
        bad_at.append(lead[~inside[lead] | ~_ESCAPABLE[data[np.minimum(lead + 1, len(data) - 1)]]])
        four = lead[data[np.minimum(lead + 1, len(data) - 1)] == ord("u")]
        digits = np.minimum(four[:, None] + np.arange(2, 6), len(data) - 1)
        bad_at.append(four[~_HEX[data[digits]].all(1)])
    qpos = np.flatnonzero(quote)
    kind_at = _KIND[data]
    outside = ~inside & ~quote
    atom = outside & (kind_at == 255) & ~_BLANK[data]
    a_start = np.flatnonzero(atom & ~np.r_[False, atom[:-1]])
    a_end = np.flatnonzero(atom & ~np.r_[atom[1:], False]) + 1
    if len(a_start):
        fine = pc.match_substring_regex(_spans(data, a_start, a_end), _ATOM_RE).to_numpy(zero_copy_only=False)
        bad_at.append(a_start[~fine])
    s_pos = np.flatnonzero(outside & (kind_at < 6))
    pos = np.concatenate([s_pos, qpos[::2], a_start])
    kind = np.concatenate([kind_at[s_pos], np.full(len(qpos) // 2, STRING, np.uint8), np.full(len(a_start), ATOM, np.uint8)])
    close_quote = np.concatenate([np.zeros(len(s_pos), np.int64), qpos[1::2], np.zeros(len(a_start), np.int64)])
    order = np.argsort(pos, kind="stable")
    pos, kind, close_quote = pos[order], kind[order], close_quote[order]
    rec = np.searchsorted(off, pos, "right") - 1
    n = len(pos)
    is_open, is_close = (kind == OPEN_OBJ) | (kind == OPEN_ARR), (kind == CLOSE_OBJ) | (kind == CLOSE_ARR)
    total = np.cumsum(is_open.astype(np.int64) - is_close)
    first = np.searchsorted(rec, np.arange(len(rows)))
    last = np.r_[first[1:], n] - 1
    base = np.where(first > 0, total[first - 1], 0)
    depth = total - base[rec]
    ok = np.ones(len(rows), bool)
    ok[rec[(depth < 1) & (np.arange(n) != last[rec])]] = False
    ok &= depth[last] == 0
    for b in bad_at:
        ok[np.searchsorted(off, b, "right") - 1] = False
    # only balanced records take part in the sort on depth
    live = ok[rec]
    pos, kind, close_quote, rec, depth = pos[live], kind[live], close_quote[live], rec[live], depth[live]
    is_open, is_close = is_open[live], is_close[live]
    n = len(pos)
    if not n:
        return empty
    by_depth = np.argsort(depth.astype(np.int32), kind="stable")
    holder = np.full(n, -1, np.int64)  # the open bracket that encloses the place after each token
    sel = by_depth[depth[by_depth] > 0]
    # each depth begins with an opening bracket, so what is filled in stays within the depth
    holder[sel] = sel[np.maximum.accumulate(np.where(is_open[sel], np.arange(len(sel)), -1))]
    before = np.r_[-1, holder[:-1]]  # what encloses the place before each token
    begins = np.r_[True, rec[1:] != rec[:-1]]
    before[begins] = -1
    in_obj = (before >= 0) & (kind[before] == OPEN_OBJ)
    prev = np.r_[255, kind[:-1]].astype(np.uint8)
    prev[begins] = 255
    is_key = (kind == STRING) & in_obj & ((prev == OPEN_OBJ) | (prev == COMMA))
    after_key = np.r_[False, is_key[:-1]] & ~begins
    good = np.zeros(n, bool)
    for p, allowed in (
        (255, kind == OPEN_OBJ),
        (OPEN_OBJ, (kind == STRING) | (kind == CLOSE_OBJ)),
        (OPEN_ARR, _VALUE_START[kind] | (kind == CLOSE_ARR)),
        (COLON, _VALUE_START[kind]),
        (COMMA, np.where(in_obj, kind == STRING, _VALUE_START[kind])),
    ):
        good |= (prev == p) & allowed
    ends = _VALUE_END[np.minimum(prev, 7)] & (prev != 255) & ~after_key
    good |= ends & np.where(in_obj, (kind == COMMA) | (kind == CLOSE_OBJ), (kind == COMMA) | (kind == CLOSE_ARR)) & (before >= 0)
    good |= after_key & (kind == COLON)
    good[after_key & (kind != COLON)] = False
    ok[rec[~good]] = False

    opens = np.flatnonzero(is_open & ok[rec])
    if not len(opens):
        return empty
    number = np.full(n, -1, np.int64)
    number[opens] = np.arange(len(opens))
    up = np.where(before[opens] >= 0, number[before[opens]], -1)
    level = depth[opens]
    is_obj = kind[opens] == OPEN_OBJ
    by_level = np.argsort(level, kind="stable")
    edges = np.searchsorted(level[by_level], np.arange(1, level.max() + 2))
    groups = [by_level[edges[k] : edges[k + 1]] for k in range(len(edges) - 1)]
    needed = is_obj.copy()
    for g in reversed(groups[1:]):
        g = g[needed[g]]
        needed[up[g]] = True
    commas = np.zeros(n, np.int64)
    commas[by_depth] = np.cumsum(kind[by_depth] == COMMA)
    element = np.full(len(opens), -1, np.int64)
    inner = np.flatnonzero(up >= 0)
    arr = inner[~is_obj[up[inner]]]
    element[arr] = commas[opens[arr] - 1] - commas[opens[up[arr]]]

    slot = np.zeros(len(opens), np.int64)
    near = np.full(len(opens), -1, np.int64)
    n_obj = np.zeros(len(opens), np.int64)
    paths = pa.array([""] * len(groups[0]), pa.large_string())
    slot[groups[0]] = np.arange(len(groups[0]))
    all_paths, all_nodes = [paths], [groups[0]]
    for g in groups[1:]:
        g = g[needed[g]]
        if not len(g):
            break
        u = up[g]
        near[g] = np.where(is_obj[u], u, near[u])
        n_obj[g] = n_obj[u] + is_obj[u]
        field = element[g] < 0
        key_tok = opens[g[field]] - 2
        keys = _spans(data, pos[key_tok] + 1, close_quote[key_tok])
        step = np.empty(len(g), object)
        step[~field] = element[g[~field]].astype(str)
        step[field] = _pointer_steps(keys)
        paths = pc.binary_join_element_wise(paths.take(pa.array(slot[u])), pa.array(step, pa.large_string()), _SLASH)
        slot[g] = np.arange(len(g))
        all_paths.append(paths)
        all_nodes.append(g)
    nodes = np.concatenate(all_nodes)
    path = pa.concat_arrays(all_paths)
    place = np.full(len(opens), -1, np.int64)
    place[nodes] = np.arange(len(nodes))
    out = np.flatnonzero(is_obj[nodes] & (up[nodes] >= 0))
    node = nodes[out]
    found = {"row": rows[rec[opens[node]]], "parent": path.take(pa.array(place[near[node]])), "path": path.take(pa.array(out)), "depth": n_obj[node].astype(np.int32), "element": element[node].astype(np.int32)}
    if with_text:
        closes = np.flatnonzero(is_close & ok[rec])
        end = np.zeros(n, np.int64)
        end[before[closes]] = pos[closes] + 1
        found["text"] = _spans(data, pos[opens[node]], end[opens[node]])
    return found


def _pointer_steps(keys: pa.Array) -> list[str]:
    """Field names as steps of a JSON Pointer."""
    if pc.any(pc.match_substring(keys, "\\")).as_py():
        keys = pa.array([json.loads(f'"{k}"').encode("utf-8", "replace").decode() if "\\" in k else k for k in keys.to_pylist()], pa.large_string())
    return pc.replace_substring(pc.replace_substring(keys, "~", "~0"), "/", "~1").to_pylist()


def byte_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` in which ``column`` has about ``limit`` bytes, so that memory stays bounded."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // limit
    cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def nested_objects(df: DataFrame, text: str, keys: list[str], with_text: bool = False) -> DataFrame:
    """One row for each object nested at any depth below the top-level object of column ``text``.

    Columns: ``keys``, then ``parent_path`` and ``object_path`` (JSON Pointers; the top-level object's is the empty
    string), ``object_depth`` (enclosing objects), ``array_position`` (null if a field holds the object) and, with
    ``with_text``, ``object_text`` (the object as written).  Null, blank, damaged and non-object texts have no rows.
    Text serialised more than once is read through.  Repeated input rows give repeated output rows.  Columns other
    than these are not read; a key named like an output column gets the prefix ``in_``.
    """
    own = ["parent_path", "object_path", "object_depth", "array_position", "object_text"][: 5 if with_text else 4]
    names = free_names(keys, [*own, "_text"])
    src = df.where(F.col(text).isNotNull()).select(*(F.col(k).alias(names[k]) for k in keys), F.col(text).alias("_text"))
    fields = [src.schema[names[k]] for k in keys]
    schema = T.StructType([*fields, T.StructField("parent_path", T.StringType()), T.StructField("object_path", T.StringType()), T.StructField("object_depth", T.IntegerType()), T.StructField("array_position", T.IntegerType()), *([T.StructField("object_text", T.StringType())] if with_text else [])])

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_chunks(batch, "_text"):
                found = index_objects(part.column("_text"), with_text)
                if not len(found["row"]):
                    continue
                take = pa.array(found["row"])
                cols = [part.column(i).take(take) for i in range(len(keys))]
                cols += [found["parent"].cast(pa.string()), found["path"].cast(pa.string()), pa.array(found["depth"]), pa.array(found["element"], mask=found["element"] < 0)]
                cols += [found["text"].cast(pa.string())] if with_text else []
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return src.mapInArrow(flatten, schema)
