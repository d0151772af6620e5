"""Token ids by a public byte-level BPE vocabulary.

Texts are cut into words by the vocabulary's pattern; each distinct word is merged once per batch.  Words of similar
length are merged together: a segment tree over the byte positions of each word holds the leftmost pair of least rank,
and one merge updates the tree at the merged position and its live neighbours, for all words at once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirestack.operators.nested import byte_chunks
from quirestack.session import free_names

#: Fixed value: how the vocabulary's words are found.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int64(1) << 40
LONG = 256
KEPT_WORDS = 400_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public vocabulary lies; a parameter of every caller."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Merger:
    """Merges words of bytes by the ranks of a vocabulary file's bytes (one base64 token and its rank on each line)."""

    def __init__(self, ranks: bytes) -> None:
        pairs = (line.split() for line in ranks.splitlines() if line)
        rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.byte_ids = np.array([rank[bytes([b])] for b in range(256)], np.int64)
        found = [(rank[t[:k]] << 32 | rank[t[k:]], r) for t, r in rank.items() for k in range(1, len(t)) if t[:k] in rank and t[k:] in rank]
        found.sort()
        self.key = np.array([k for k, _ in found], np.int64)
        self.rank = np.array([r for _, r in found], np.int64)
        self.table = dict(found)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE)

    def words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        size = np.array([len(w) for w in words])
        group = np.maximum(1, np.ceil(np.log2(np.maximum(size, 1)))).astype(int)
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            if 1 << g > LONG:
                for i in at:
                    out[i] = self._long(words[i])
                continue
            for part in np.array_split(at, -(-len(at) * (2 << g) // 2_000_000)):
                for i, ids in zip(part, self._together([words[i] for i in part], 1 << g), strict=True):
                    out[i] = ids
        return out

    def _together(self, words: list[bytes], width: int) -> list[np.ndarray]:
        """Words of at most ``width`` bytes, a power of two; position ``width`` stands for none."""
        count = len(words)
        rows = np.arange(count)
        size = np.array([len(w) for w in words])
        held = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(count, width)
        token = np.full((count, width + 1), -1, np.int64)
        token[:, :width] = np.where(np.arange(width) < size[:, None], self.byte_ids[held], -1)
        after = np.minimum(np.tile(np.arange(1, width + 2), (count, 1)), size[:, None])
        after[:, :width][after[:, :width] >= size[:, None]] = width
        before = np.tile(np.arange(-1, width), (count, 1))
        before[:, 0] = width
        # node k has children 2k and 2k + 1; a leaf holds rank * width + position, so the least is the leftmost
        tree = np.full((count, 2 * width), NONE * width, np.int64)
        leaf = self.pair_rank(token[:, :-1], np.where(token[:, 1:] < 0, (1 << 31) - 1, token[:, 1:]))
        tree[:, width:] = leaf * width + np.arange(width)
        for k in range(width - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        live = rows[tree[:, 1] < NONE * width]
        while len(live):
            top = tree[live, 1]
            left = top % width
            right = after[live, left]
            token[live, left] = top // width
            token[live, right] = -1
            far = after[live, right]
            after[live, left] = far
            before[live, far] = left
            far_token = np.where(far < width, token[live, np.minimum(far, width)], (1 << 31) - 1)
            self._set(tree, live, left, self.pair_rank(token[live, left], far_token), width)
            self._set(tree, live, right, np.full(len(live), NONE), width)
            near = before[live, left]
            has = near < width
            some, at = live[has], near[has]
            self._set(tree, some, at, self.pair_rank(token[some, at], token[some, left[has]]), width)
            live = live[tree[live, 1] < NONE * width]
        alive = token[:, :width] >= 0
        flat = token[:, :width][alive]
        return np.split(flat, np.cumsum(alive.sum(1))[:-1])

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, rank: np.ndarray, width: int) -> None:
        node = at + width
        tree[rows, node] = rank * width + at
        while width > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            width >>= 1

    def _long(self, word: bytes) -> np.ndarray:
        """The same for one long word, on plain lists."""
        n = len(word)
        width = 1 << (n - 1).bit_length()
        none = int(NONE)
        token = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n))
        table = self.table
        tree = [none] * (2 * width)
        first = self.pair_rank(np.array(token[:-1]), np.array(token[1:]))
        tree[width : width + n - 1] = np.where(first < NONE, first * width + np.arange(n - 1), none).tolist()
        for k in range(width - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

        def put(at: int, value: int) -> None:
            k = at + width
            tree[k] = value
            while k > 1:
                a, b = tree[k], tree[k ^ 1]
                k >>= 1
                low = a if a < b else b
                if tree[k] == low:
                    break
                tree[k] = low

        none_yet = none
        while tree[1] < none_yet:
            rank, left = divmod(tree[1], width)
            right = after[left]
            far = after[right]
            token[left], token[right] = rank, -1
            after[left] = far
            if far < n:
                before[far] = left
            put(right, none)
            r = table.get(rank << 32 | token[far]) if far < n else None
            put(left, none if r is None else r * width + left)
            near = before[left]
            if near >= 0:
                r = table.get(token[near] << 32 | rank)
                put(near, none if r is None else r * width + near)
        return np.array([t for t in token if t >= 0], np.int64)


class Encoder:
    """Ids of whole texts; words are kept between batches, and forgotten when they are too many."""

    def __init__(self, ranks: bytes) -> None:
        self.merger = Merger(ranks)
        self.find = regex.compile(PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin."""
        found = [self.find(t) for t in texts]
        number = self.number
        if len(number) > KEPT_WORDS:
            self.forget()
            number = self.number
        new = list({w for words in found for w in words if w not in number})
        if new:
            ids = self.merger.words([w.encode("utf-8", "surrogatepass") for w in new])
            number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
            size = np.array([len(x) for x in ids], np.int64)
            self.start = np.r_[self.start, len(self.flat) + np.r_[0, np.cumsum(size)[:-1]]]
            self.size = np.r_[self.size, size]
            self.flat = np.r_[self.flat, np.concatenate(ids).astype(np.int32)]
        words = np.fromiter((number[w] for f in found for w in f), np.int64, sum(map(len, found)))
        size = self.size[words]
        ends = np.r_[0, np.cumsum(size)]
        flat = self.flat[np.arange(ends[-1]) + np.repeat(self.start[words] - ends[:-1], size)]
        return flat, ends[np.cumsum([0, *map(len, found)])]


def encode_corpus(df: DataFrame, text: str, keys: list[str], path: str | None = None, output: str = "ids") -> DataFrame:
    """``keys`` and the token ids of column ``text`` as ``output`` (array<int>), without special tokens.

    A null or empty text has an empty list.  Marker-like strings are ordinary text.  ``path`` names the vocabulary file
    (ranks); its bytes, below 1 MB, go to the executors.  Repeated rows are encoded as often as they come.  A key named
    like ``output`` gets the prefix ``in_``.
    """
    with open(path or vocabulary_path(), "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    names = free_names(keys, [output, "_text"])
    src = df.select(*(F.col(k).alias(names[k]) for k in keys), F.col(text).alias("_text"))
    schema = T.StructType([*(src.schema[names[k]] for k in keys), T.StructField(output, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value)
        for batch in batches:
            for part in byte_chunks(batch, "_text"):
                flat, start = encoder.encode(part.column("_text").fill_null("").to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keys))), ids], names=schema.names)

    return src.mapInArrow(run, schema)


_ENCODERS: dict[int, Encoder] = {}


def _encoder(ranks: bytes) -> Encoder:
    """One encoder for each vocabulary and worker process."""
    key = hash(ranks)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks)
    return _ENCODERS[key]
