"""Text of scanned pages put right: page furniture, words broken over lines, wrongly recognised characters.

Furniture and line joins are decided by classifiers on pairs of lines; replacements for unknown words are retrieved
through an inverted join on character q-grams and ranked by gradient boosting.  All three learn from the corpus itself:
from the blocks that the parser did mark as furniture, from known words broken on purpose, and from known words in which
characters were confused on purpose.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from quirestack.llm.boost import Boost
from quirestack.llm.canon import canonical_array
from quirestack.operators.nested import byte_chunks
from quirestack.session import bounded, cut

# What a scanner reads (left) for what is printed (right).
CONFUSIONS = "c:e e:c 0:o o:a a:o f:t t:f 5:s ri:n !:i 1:l 1:i l:i i:l cl:d d:cl ii:u u:ii rn:m m:rn 6:b b:6 b:h h:b q:g g:q 9:g m:in in:m vv:w w:vv h:li li:h n:ri |:l nn:m 8:b 2:z 0:c w:vi"
READ_AS = [tuple(x.split(":")) for x in CONFUSIONS.split()]
#: What a letter may be read as besides.
STRANGE = "abcdefghijklmnopqrstuvwxyz0123456789!|@"
#: Block types that are furniture by themselves, those that admit to it, and those that hold no prose unless their text says so.
FURNITURE_TYPES = ("header", "footer", "page_number")
ADMITTED = (*FURNITURE_TYPES, "title")
NO_PROSE = ("code", "algorithm", "equation", "inline_equation")
#: What the classifiers are fitted on at most: blocks of each kind, known words, words misread on purpose, and their pairs.
BLOCK_SAMPLE, WORD_SAMPLE, RANK_SAMPLE, PAIR_SAMPLE = 5_000, 4_000, 1_500, 100_000
#: Corrections up to so many go to every executor; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 300_000
GRAM = 3
#: Two usual misreadings spoil at most so many of a word's grams, so one of its rarest is left.
RAREST = 2 * (GRAM + 1) + 1
#: Edits that two usual misreadings make at most.
EDITS = 4
#: Places in the reading order that one task looks through for the next block at a time.
STRETCH = 4_096
#: A line printed on so many pages of its paper counts as recurring.
RECURS = 3
KNOWN = 3
#: A word is looked at if a word one usual confusion away is so many times as common in clean text, and not taken for known if RARER times.
FAR, RARER = 20, 100

_BREAK = re.compile("^(.*?)(\\S*[^\\W\\d_])([-­‐‑¬])[ \t]*$")
_EDGE = re.compile(r"^(?:(?![!|][^\W_])[\W_])+|[\W_]+$")  # a leading ! or | may be a letter
_HANGS = re.compile("[^\\W\\d_][-‐‑]$")
_PAGE = re.compile(r"^(?:[\[(]\s*(\w+)\s*[\])]|[-–—~]\s*(\w+)\s*[-–—~]|(?:page|pagina|página|seite|p\.|pg\.?|s\.)\s*(\w+)(?:\s*(?:of|/|von|de|sur)\s*\w+)?|(\w+)\s*(?:/|of|von|de|sur)\s*\w+|(\w+))$", re.I)
_FOLD_PAIRS = (("rn", "m"), ("in", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("li", "h"))
_FOLD = str.maketrans("eao0t51!l|b6q9", "cooofsiiiihhgg")


def lines_of(text: str) -> list[str]:
    """The lines of a text; all kinds of line end count."""
    return re.split(r"\r\n|\n|\r", text)


def plain(word: str) -> str:
    """A word in lower case without surrounding punctuation."""
    return _EDGE.sub("", word).lower()


def skeleton(line: str) -> str:
    """What is left of a line when case, accents, page numbers, signs and what scanners confuse make no difference."""
    s = line.lower()
    if not s.isascii():
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    s = re.sub(r"^[\W_]*(?:p\.?|page)?\s*\d+[\W_]+|[\W_]+(?:p\.?|page)?\s*\d+[\W_]*$", "", s)
    s = re.sub(r"[^\w!|]+", "", s)
    for a, b in _FOLD_PAIRS:
        s = s.replace(a, b)
    return s.translate(_FOLD)


def _grams(s: str) -> set[str]:
    return {s[i : i + GRAM] for i in range(len(s) - GRAM + 1)}


def _roman(s: str) -> int:
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    if not s or any(c not in value for c in s):
        return 0
    total = 0
    for a, b in zip(s, [*s[1:], ""], strict=True):
        total += -value[a] if b and value[a] < value[b] else value[a]
    return total


def page_number(line: str) -> int:
    """The number of a line that is nothing but a page number, else -1."""
    m = _PAGE.match(line.strip()) if len(line) < 60 else None
    if not m:
        return -1
    x = next(g for g in m.groups() if g is not None).lower()
    if re.search(r"\d", x):
        x = x.translate(str.maketrans("loi!|sbqg", "101115699"))
        return int(x) if x.isdecimal() and len(x) < 7 else -1
    return _roman(x) or -1


class Templates:
    """The running headers of one paper, for comparison."""

    def __init__(self, skeletons: list[str]) -> None:
        self.exact = set(skeletons)
        self.grams = [(len(s), _grams(s)) for s in self.exact if len(s) >= 8]

    def likeness(self, s: str) -> float:
        """How like one of them the skeleton of a line is."""
        if len(s) < 5:
            return 0.0
        if s in self.exact:
            return 1.0
        best, mine = 0.0, None
        for n, g in self.grams:
            if abs(n - len(s)) <= max(2, n // 8):
                mine = _grams(s) if mine is None else mine
                best = max(best, len(g & mine) / max(1, len(g | mine)))
        return best


@functools.lru_cache(maxsize=512)
def _templates(skeletons: tuple[str, ...]) -> Templates:
    """Blocks of a paper mostly come together, so its templates are made once."""
    return Templates(list(skeletons))


def line_features(lines: list[str], i: int, page: int, templates: Templates, shares: dict[str, float], sort: int, own: str | None = None) -> tuple[float, ...]:
    """What a line and its neighbours say about its being furniture; ``shares`` has the recurring lines, ``sort`` what the block's type says, ``own`` the line's skeleton if it is known."""
    line = lines[i].strip()
    before = lines[i - 1].rstrip() if i else ""
    after = lines[i + 1].lstrip() if i + 1 < len(lines) else ""
    number, own = page_number(line), skeleton(line) if own is None else own
    return (templates.likeness(own), float(number >= 0), float(number == page + 1), float(bool(before) and before[-1] not in ".!?:"), float(bool(after) and after[:1].islower()), float(len(lines) == 1), shares.get(own, 0.0), float(sort))


LINE_FEATURES = 8


def type_sort(kind: str) -> int:
    """0: prose, 1: a table's cell, 2: code or formulas."""
    return 1 if kind == "table_cell" else 2 if kind in NO_PROSE else 0


_WORD = re.compile("^[(\"'“„«]*[^\\W\\d_][\\w'’-]*[)\"'”’».,;:!?­¬‐-]*$")


def reads_as_prose(kind: str, lines: list[str]) -> bool:
    """Whether joins and words are sought in a block: always but for code and formulas, whose text has to consist of words."""
    if kind not in NO_PROSE:
        return True
    parts = " ".join(lines).split()
    return len(parts) >= 8 and sum(bool(_WORD.match(x)) for x in parts) >= 0.85 * len(parts)


def _with_skeletons(blocks: DataFrame) -> DataFrame:
    """``blocks`` with the skeletons of each text's lines, and of the text as one line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in byte_chunks(batch, "text")):
            texts = [lines_of(t) for t in b.column("text").to_pylist()]
            bones = pa.array([[skeleton(x) for x in lines] for lines in texts], pa.list_(pa.string()))
            whole = pa.array([skeleton(" ".join(lines)) if len(lines) > 1 else None for lines in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, bones, whole], names=[*b.schema.names, "skeletons", "whole"])

    return blocks.mapInArrow(run, T.StructType([*blocks.schema.fields, T.StructField("skeletons", T.ArrayType(T.StringType())), T.StructField("whole", T.StringType())]))


SCAN_SCHEMA = "block_no long, paper_id string, generation int, doc_order int, body boolean, gone boolean, furniture array<int>, breaks array<struct<left:string,right:string,mark:string>>, tail_word string, tail_mark string, head_word string, words array<string>"


def _page_sample(blocks: DataFrame) -> Boost:
    """The furniture classifier, fitted on lines that the parser placed: those of headers and page numbers against all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, hosts, marked = [], [], []
            for text, kind, page, known, often in zip(*(b.column(c).to_pylist() for c in ("text", "block_type", "page_index", "templates", "recurring")), strict=True):
                t, lines, shares = _templates(tuple(known or ())), lines_of(text), dict(often or [])
                if kind in FURNITURE_TYPES:
                    for x in filter(str.strip, lines):
                        marked.append((x, page or 0, t, shares))
                        # how like the paper's other headers it is, without itself
                        rest = Templates([k for k in known or [] if k != skeleton(x)])
                        if rest.likeness(skeleton(x)) > 0.5:
                            marked.append((x, page or 0, rest, shares))
                        if skeleton(x) in shares:  # as if the parser had marked none
                            marked.append((x, page or 0, Templates([]), shares))
                elif len(lines) > 2 and type_sort(kind) == 0:
                    hosts.append(lines)
                for i in range(len(lines)):
                    sort = type_sort(kind)
                    f = line_features(lines, i, page or 0, t, shares, sort)
                    # lines elsewhere that look just like furniture may be furniture, so they teach nothing; numbers in cells are none
                    if lines[i].strip() and (kind in FURNITURE_TYPES or not (f[0] > 0.9 or (f[2] and not sort))):
                        rows.append((int(kind in FURNITURE_TYPES), f))
            for k, (line, page, t, shares) in enumerate(marked if hosts else []):  # the same lines between the lines of a paragraph
                host = hosts[k % len(hosts)]
                at = 1 + k % (len(host) - 1)
                rows += 2 * [(1, line_features([*host[:at], line, *host[at:]], at, page, t, shares, 0))]
                # in blocks of a wrong type a head is one, but a number alone is a value
                if t.likeness(skeleton(line)) > 0.9:
                    rows += [(1, line_features(x, i, page, t, shares, 1 + k % 2)) for x, i in (([line], 0), ([*host[:at], line, *host[at:]], at))]
                elif page_number(line) >= 0:
                    rows += [(0, line_features([line], 0, page, t, shares, sort)) for sort in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([list(r[1]) for r in rows], pa.list_(pa.float64()))], names=["mark", "features"])

    # a bounded number of blocks of each kind, by hash
    near = blocks.where(F.col("block_type") != "title").withColumn("mark", F.col("block_type").isin(*FURNITURE_TYPES))
    parts = [bounded(near.where(cond), BLOCK_SAMPLE, "block_no").drop("mark") for cond in ("mark", "not mark")]
    found = parts[0].union(parts[1]).coalesce(1).mapInArrow(run, "mark int, features array<double>").toArrow()
    return Boost(_matrix(found.column("features"), LINE_FEATURES), found.column("mark").to_numpy(), trees=40, depth=3)


def _scan(blocks: DataFrame, model: Boost) -> DataFrame:
    """For each block its furniture lines, its broken words and its other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            cols = [b.column(c).to_pylist() for c in ("block_no", "paper_id", "generation", "doc_order", "flow_kind", "block_type", "page_index", "text", "skeletons", "templates", "recurring")]
            asked, slots = [], []
            texts = []
            for k, (kind, page, text, bones, known, often) in enumerate(zip(*cols[5:], strict=True)):
                lines = lines_of(text or "")
                texts.append(lines)
                if kind in ADMITTED:
                    continue
                t, shares, sort = _templates(tuple(known or ())), dict(often or []), type_sort(kind)
                for i, line in enumerate(lines):
                    if line.strip():
                        asked.append(line_features(lines, i, page or 0, t, shares, sort, bones[i]))
                        slots.append((k, i))
            odd: dict[int, set[int]] = {}
            if asked:
                for (k, i), p in zip(slots, model.predict(np.array(asked)), strict=True):
                    if p > 0.5:
                        odd.setdefault(k, set()).add(i)
            for k, (no, paper, gen, order, flow, kind, *_) in enumerate(zip(*cols, strict=True)):
                furniture = odd.get(k, set())
                lines = [x for i, x in enumerate(texts[k]) if i not in furniture and x.strip()]
                gone = kind in FURNITURE_TYPES or not lines
                breaks, words, tail, mark, head = [], [], None, None, None
                carry = ""
                if not gone and reads_as_prose(kind, lines):
                    for i, line in enumerate(lines):
                        parts = line.split()
                        if carry:
                            breaks.append({"left": carry, "right": parts[0], "mark": mark})
                            parts = parts[1:]
                            carry, mark = "", None
                        elif i == 0:
                            head = parts[0]
                            parts = parts[1:]
                        m = _BREAK.match(line.rstrip())
                        if m and parts:
                            carry, mark = m[2], m[3]
                            parts = parts[:-1]
                        words += parts
                    tail = carry or None
                bare = sorted({w for w in map(plain, words) if w})
                out.append((no, paper, gen, order, flow == "body", gone, sorted(i + 1 for i in furniture), breaks, tail, mark if tail else None, head, bare))
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.struct([("left", pa.string()), ("right", pa.string()), ("mark", pa.string())])), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
            names = [x.split()[0] for x in re.sub(r"<[^ ]*>", "", SCAN_SCHEMA).split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    return blocks.mapInArrow(run, SCAN_SCHEMA)


def vocabulary(texts: DataFrame, column: str) -> DataFrame:
    """``word`` (lower case, no surrounding punctuation) and ``clean`` (how often it is printed) over all texts.

    A word printed with a hyphen behind it counts once more under its form with the hyphen.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for b in (part for batch in batches for part in byte_chunks(batch, column)):
            for text in canonical_array(b.column(column)).to_pylist():
                if text:
                    count.update(text.split())
            if len(count) > 200_000:
                yield _counted(count)
                count = Counter()
        yield _counted(count)

    return texts.select(column).mapInArrow(run, "word string, clean long").groupBy("word").agg(F.sum("clean").alias("clean"))


def _counted(count: Counter) -> pa.RecordBatch:
    bare: Counter = Counter()
    for w, n in count.items():
        if p := plain(w):
            bare[p] += n
            if _HANGS.search(w):
                bare[p + "-"] += n
    return pa.RecordBatch.from_arrays([pa.array(list(bare), pa.string()), pa.array(list(bare.values()), pa.int64())], names=["word", "clean"])


def _join_features(c: list[float], left: str, right: str, mark: str) -> tuple[float, ...]:
    """c: how often the closed word, the hyphenated word, the left and the right part are printed."""
    low = [float(np.log1p(x)) for x in c[:4]]
    return (*low, low[0] - low[1], float(len(left)), float(len(right)), float(right[:1].isupper()), float(mark == "-"), float("-" in left))


PAIR = ["left", "right", "mark"]


def _told(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Each distinct pair of parts with how often its closed form, its hyphenated form, its parts, and its left part with a hanging hyphen are printed."""
    forms = (F.concat("left", "right"), F.concat_ws("-", "left", "right"), F.col("left"), F.col("right"), F.concat("left", F.lit("-")))
    long = pairs.select(*PAIR, F.explode(F.array(*(F.struct(F.lit(i).alias("i"), w.alias("word")) for i, w in enumerate(forms)))).alias("f")).select(*PAIR, "f.i", "f.word")
    return long.join(words, "word", "left").groupBy(*PAIR).agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("clean", F.lit(0)).alias("n")))).alias("c"))


def _join_model(sample: list[tuple[str, int]], words: DataFrame) -> Boost:
    """The classifier of line pairs: does the word that is broken there have a hyphen of its own."""
    rng = np.random.default_rng(5)
    made: dict[tuple[str, str, str], int] = {}
    hard: set[tuple[str, str, str]] = set()
    taken = {w for w, _ in sample if len(w) > 2}
    heads = sorted({w.split("-")[0] for w, _ in sample if "-" in w and w.split("-")[0]}) or ["pre", "post"]
    for w, _ in sample:
        if not w.replace("-", "").isalpha() or len(w) < 5:
            continue
        at = [i for i, c in enumerate(w) if c == "-" and 0 < i < len(w) - 1]
        for i in at:
            made[w[:i], w[i + 1 :], "-"] = 1
        for k in range(2, len(w) - 2):  # breaks that leave a known word are the ones to take care of
            if w[k:] in taken and "-" not in w[k - 1 : k + 1]:
                made.setdefault((w[:k], w[k:], "-"), 0)
                hard.add((w[:k], w[k:], "-"))
        for _ in range(2):
            k = int(rng.integers(2, len(w) - 1))
            if "-" not in w[k - 1 : k + 1]:
                made.setdefault((w[:k], w[k:], "-\u00ad\u00ac\u2010"[int(rng.integers(0, 4))]), 0)
        if not at and rng.random() < 0.2:  # a compound that may be new
            made.setdefault((heads[int(rng.integers(0, len(heads)))], w, "-"), 1)
    x, own = [], []
    pairs = words.sparkSession.createDataFrame(sorted(made), "left string, right string, mark string")
    for r in _told(pairs, words).select(*PAIR, F.transform("c", lambda e: e["n"]).alias("c")).toArrow().to_pylist():
        left, right, mark, c = r["left"], r["right"], r["mark"], r["c"]
        x.append(_join_features(c, left, right, mark))
        own.append(made[left, right, mark])
        if (left, right, mark) not in hard:  # as if the whole were not known
            x.append(_join_features([0, 0, *c[2:4]], left, right, mark))
            own.append(made[left, right, mark])
    return Boost(np.array(x, float).reshape(-1, 10), np.array(own, float), trees=40, depth=4)


#: Words before which a hyphen may hang ("pre- and post-"), if the whole ("enc-oder") is not what clean text prints.
HANGING = frozenset("and or und oder et ou y o e u bis to".split())


def undone(word: str) -> Iterator[str]:
    """The forms that one usual confusion may have turned into ``word``; some may come twice."""
    return (word[:i] + p + word[i + len(r) :] for r, p in READ_AS for i in range(len(word)) if word.startswith(r, i))


def _undone(words: DataFrame) -> DataFrame:
    """``word`` and each ``form`` that may have been misread as it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs, size = [], 0
            for w in b.column("word").to_pylist():
                for f in undone(w):
                    pairs.append((w, f))
                    size += len(w) + len(f) + 100
                    if size > 4_000_000:
                        yield made(pairs)
                        pairs, size = [], 0
            yield made(pairs)

    def made(pairs: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.string()) for i in (0, 1)], names=["word", "form"])

    return words.select("word").mapInArrow(run, "word string, form string")


def _rivals(vocabulary: DataFrame) -> DataFrame:
    """The vocabulary with ``rival``: how often the commonest word one usual confusion away is printed, where that is FAR times as often."""
    words = vocabulary.where(F.col("word").rlike("^[\\p{L}\\p{N}!|][\\p{L}\\p{N}!|'’-]*$") & ~F.col("word").endswith("-") & (F.length("word") > 2))
    common = vocabulary.where((F.col("clean") >= FAR) & ~F.col("word").endswith("-")).select(F.col("word").alias("form"), F.col("clean").alias("n"))
    # a form is at most one character longer or shorter, so words far longer than any common one need no forms
    lengths = common.select(F.explode(F.sequence(F.length("form") - 1, F.length("form") + 1)).alias("size")).distinct()
    words = words.join(F.broadcast(lengths), F.length("word") == F.col("size"), "left_semi")
    best = _undone(words).join(common, "form").groupBy("word").agg(F.max("n").alias("rival"))
    return vocabulary.join(best, "word", "left").withColumn("rival", F.when(F.col("rival") >= FAR * F.col("clean"), F.col("rival")))


def pair_features(word: str, known: str, clean: float, seen: float, shared: float, own: float) -> tuple[float, ...]:
    """What speaks for ``known`` (printed ``clean`` times) being what is printed where ``word`` (printed ``own`` times) was read."""
    n = min(len(word), len(known))
    a = 0
    while a < n and word[a] == known[a]:
        a += 1
    z = 0
    while z < n - a and word[-1 - z] == known[-1 - z]:
        z += 1
    read, printed = word[a : len(word) - z], known[a : len(known) - z]
    usual = _usual(read, printed, word[max(0, a - 1) : a], word[len(word) - z : len(word) - z + 1])
    sign = any(c.isdigit() or c in "!|" for c in read)
    return (usual, float(max(len(read), len(printed))), float(len(word) - len(known)), float(sign), float(np.log1p(clean)), float(np.log1p(seen)), float(np.log1p(clean) - np.log1p(seen)), shared, float(len(known)), float(a == 0), float(sorted(word) == sorted(known)), float(np.log1p(own)), float(np.log1p(clean) - np.log1p(own)))


_USUAL = set(READ_AS)


def _usual(read: str, printed: str, before: str, after: str) -> float:
    """1 if the difference is one usual confusion, also where it shares a character with its neighbours; 0.5 for two."""
    forms = {(read, printed), (before + read, before + printed), (read + after, printed + after)}
    if forms & _USUAL:
        return 1.0
    if len(read) >= 2 and len(printed) >= 2:
        for a, b in READ_AS:
            if read.startswith(a) and printed.startswith(b):
                r, p = read[len(a) :], printed[len(b) :]
                for c, d in READ_AS:
                    if r.endswith(c) and p.endswith(d) and r[: len(r) - len(c)] == p[: len(p) - len(d)]:
                        return 0.5
    return 0.0


def _candidates(words: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (word, known) that share one of the word's rarest q-grams at about the same place.

    Any word of which at most two stretches were misread as usual shares one: the grams, places and lengths that two
    such misreadings can change are allowed for.  Both sides are shuffled by gram, so hot grams are split as skew.
    """
    padded = lambda c: F.concat(F.lit("^"), F.col(c), F.lit("$"))
    grams = lambda df, c: df.select("*", F.posexplode(F.transform(F.sequence(F.lit(1), F.length(padded(c)) - (GRAM - 1)), lambda i: F.substring(padded(c), i, F.lit(GRAM)))).alias("at", "gram"))
    posts = cut(grams(known.select("known", "clean"), "known"))
    rare = posts.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    own = grams(words, "word").join(rare, "gram")
    few = own.groupBy("word", "seen", "own").agg(F.slice(F.sort_array(F.collect_list(F.struct("df", "gram", "at"))), 1, RAREST).alias("few"))
    probe = few.select("word", "seen", "own", F.explode("few").alias("g")).select("word", "seen", "own", F.col("g.gram").alias("gram"), F.col("g.at").alias("at_w"))
    near = (F.abs(F.col("at") - F.col("at_w")) <= 2) & (F.abs(F.length("known") - F.length("word")) <= 2) & (F.col("word") != F.col("known"))
    pairs = probe.join(posts, "gram").where(near).groupBy("word", "seen", "own", "known", "clean").agg(F.count(F.lit(1)).alias("shared"))
    return pairs.where(F.levenshtein("word", "known", EDITS) >= 0)


def _rank(pairs: DataFrame, model: Boost) -> DataFrame:
    """The best replacement of each word, where one is more likely than not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("word", "known", "clean", "seen", "shared", "own")]
            x = np.array([pair_features(*r) for r in zip(*cols, strict=True)], float).reshape(-1, 13)
            p = model.predict(x)
            good = p > 0.5
            keep = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([b.column("word").take(keep), b.column("known").take(keep), b.column("clean").take(keep), pa.array(p[good])], names=["word", "known", "clean", "p"])

    best = pairs.mapInArrow(run, "word string, known string, clean long, p double")
    return best.groupBy("word").agg(F.max(F.struct("p", "clean", "known")).alias("b")).select("word", F.col("b.known").alias("right"), F.col("b.p").alias("sureness"))


def _rank_model(known: DataFrame, sample: list[tuple[str, int]]) -> Boost:
    """Fitted on known words: half are misread on purpose, the other half are taken for unknown as they are."""
    rng = np.random.default_rng(11)
    truth: dict[str, str] = {}
    printed: dict[str, int] = {}
    for k, (w, n) in enumerate(sample[:: max(1, len(sample) // RANK_SAMPLE)]):
        if len(w) < 4:
            continue
        if k % 3 == 2:
            truth.setdefault(w, "")
            continue
        fits = [(i, r, p) for r, p in READ_AS for i in range(len(w)) if w.startswith(p, i)]
        if k % 12 in (1, 7):  # now and then a misreading of no usual kind: any letter or sign in place of one letter
            i = int(rng.integers(0, len(w)))
            fits = [(i, r, w[i]) for r in STRANGE[int(rng.integers(0, len(STRANGE)))] if r != w[i]]
        if fits:
            i, r, p = fits[int(rng.integers(0, len(fits)))]
            made = w[:i] + r + w[i + len(p) :]
            truth[made], printed[made] = w, n // int(rng.integers(RARER, 10 * RARER))
    real = dict(sample)
    # misread words also as if clean text had the misreading now and then, real words also with what clean text has
    rows = sorted({(w, 1, own) for w, t in truth.items() if not t or w not in real for own in (0, printed[w] if t else real[w])})
    probes = known.sparkSession.createDataFrame(rows, "word string, seen long, own long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("word", "known", "clean", "seen", "shared", "own")]
            x = [pair_features(*r) for r in zip(*cols, strict=True)]
            y = [float(truth.get(w) == k) for w, k in zip(*cols[:2], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float32())), pa.array(y, pa.float32())], names=["x", "y"])

    # wrong candidates grow with the vocabulary; a bounded number is enough to learn from
    found = bounded(cut(_candidates(probes, known)), PAIR_SAMPLE, "word", "known").mapInArrow(run, "x array<float>, y float").toArrow()
    x, y = _matrix(found.column("x"), 13), found.column("y").to_numpy()
    return Boost(x, y, trees=60, depth=4)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    flat = pa.compute.list_flatten(column).to_numpy()
    return flat.reshape(-1, width).astype(float)


def _commonest(known: DataFrame, most: int) -> pa.Table:
    """The ``most`` words printed most often.  Counts by steps of a logarithmic scale name the cut, so that little more than
    these words leaves the executors."""
    step = F.floor(F.log2("clean") * 64)
    counts = known.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("step", ascending=False)
    enough = counts[counts["n"].cumsum() >= most]
    words = known.where(step >= int(enough["step"].iloc[0])) if len(enough) else known
    return words.select("known", "clean").toArrow().sort_by([("clean", "descending"), ("known", "ascending")]).slice(0, most)


class Repair:
    """What is found in the scanned blocks of one table: ``furniture``, ``joins`` and ``corrections``, and the words they apply to."""

    def __init__(self, blocks: DataFrame) -> None:
        keep = ["block_no", "paper_id", "generation", "page_index", "block_type", "flow_kind", "doc_order", "text"]
        own = blocks.where((F.col("source_kind") == "ocr") & F.col("text").isNotNull() & F.col("block_no").isNotNull()).select(*keep).dropDuplicates(["block_no"])
        own = cut(_with_skeletons(own))
        heads = F.filter(F.concat("skeletons", F.array("whole")), lambda x: F.length(x) >= 5)
        shown = own.where(F.col("block_type").isin("header", "footer", "title")).select("paper_id", F.explode(heads).alias("s"))
        templates = shown.groupBy("paper_id").agg(F.collect_set("s").alias("templates"))
        # lines that recur over the pages of a paper, with the share of its pages, whether or not the parser marked any
        pages = own.groupBy("paper_id", "generation").agg(F.count_distinct("page_index").alias("pages"))
        lines = own.select("paper_id", "generation", "page_index", F.explode("skeletons").alias("s")).where("length(s) >= 5").distinct()
        often = lines.groupBy("paper_id", "generation", "s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= RECURS).join(pages, ["paper_id", "generation"])
        often = often.groupBy("paper_id", "generation").agg(F.map_from_entries(F.collect_list(F.struct("s", F.col("n") / F.col("pages")))).alias("recurring"))
        self.blocks = cut(own.drop("whole").join(templates, "paper_id", "left").join(often, ["paper_id", "generation"], "left"))
        self.scan = cut(_scan(self.blocks, _page_sample(self.blocks)))
        clean = blocks.where((F.col("source_kind") != "ocr") & F.col("text").isNotNull())
        self.vocabulary = cut(_rivals(cut(vocabulary(clean, "text"))))
        # a misreading that clean text has now and then grows with the corpus, but stays rare beside the right word
        self.known = self.vocabulary.where((F.col("clean") >= KNOWN) & (F.coalesce("rival", F.lit(0)) < RARER * F.col("clean")) & F.col("word").rlike("^[\\p{L}\\p{N}'’-]+$") & F.col("word").rlike("\\p{L}") & ~F.col("word").endswith("-")).withColumnRenamed("word", "known")
        # half of the sample are the commonest words, half any words
        half = [_commonest(self.known, WORD_SAMPLE // 2), bounded(self.known.select("known", "clean"), WORD_SAMPLE // 2, "known").toArrow()]
        sample = sorted({(r["known"], r["clean"]) for t in half for r in t.to_pylist()})
        self.joins = cut(self._joins(sample))
        bare = F.pandas_udf(lambda s: s.map(plain), "string")
        # a block's first word is a word of its own unless it ends one of the block before
        heads = self.scan.where(F.col("head_word").isNotNull()).select("block_no", bare("head_word").alias("word"))
        heads = heads.join(self.joins.select(F.col("next_no").alias("block_no")).where("block_no is not null").distinct(), "block_no", "left_anti")
        inner = self.scan.where(~F.col("gone")).select("block_no", F.explode("words").alias("word"))
        self.words = inner.union(heads).union(self.joins.select("block_no", F.col("joined").alias("word")))
        self.corrections = cut(self._corrections(sample))

    def furniture(self) -> DataFrame:
        """``block_no`` and ``line_no`` of each furniture line of a block that does not admit to it."""
        return self.scan.select("block_no", F.explode("furniture").alias("line_no"))

    def _breaks(self) -> DataFrame:
        """All broken words: within blocks, and from a block's end to the next body block."""
        inner = self.scan.select("block_no", F.explode("breaks").alias("b")).select("block_no", "b.left", "b.right", "b.mark")
        # the next body block that is neither furniture nor without words; papers of any size are cut into stretches, whose
        # first such blocks are looked through where a stretch has none left
        body = self.scan.where(F.col("body") & F.col("doc_order").isNotNull()).withColumn("stretch", F.floor(F.col("doc_order") / STRETCH))
        body = body.withColumn("stop", F.when(~F.col("gone") & F.col("head_word").isNotNull(), F.struct("head_word", "block_no")))
        body = body.select("paper_id", "generation", "stretch", "doc_order", "block_no", "stop", "tail_word", "tail_mark")
        paper = ["paper_id", "generation"]
        within = W.partitionBy(*paper, "stretch").orderBy("doc_order", "block_no").rowsBetween(1, W.unboundedFollowing)
        beyond = W.partitionBy(*paper).orderBy("stretch").rowsBetween(1, W.unboundedFollowing)
        heads = body.groupBy(*paper, "stretch").agg(F.min(F.when(F.col("stop").isNotNull(), F.struct("doc_order", "block_no", "stop")))["stop"].alias("first"))
        heads = heads.withColumn("later", F.first("first", ignorenulls=True).over(beyond)).drop("first")
        ahead = body.withColumn("next", F.first("stop", ignorenulls=True).over(within)).where(F.col("tail_word").isNotNull())
        found = ahead.join(heads, [*paper, "stretch"]).withColumn("next", F.coalesce("next", "later")).where(F.col("next").isNotNull())
        found = found.select("block_no", F.col("tail_word").alias("left"), F.col("next.head_word").alias("right"), F.col("tail_mark").alias("mark"), F.col("next.block_no").alias("next_no"))
        return inner.withColumn("next_no", F.lit(None).cast("long")).union(found)

    def _joins(self, sample: list[tuple[str, int]]) -> DataFrame:
        """``block_no``, the two parts as they stand, and ``joined``: the whole word."""
        own = _join_model(sample, self.vocabulary)
        bare = F.pandas_udf(lambda s: s.map(plain), "string")
        rows = self._breaks().select("block_no", bare("left").alias("left"), F.col("right").alias("raw_right"), bare("right").alias("right"), "mark", "next_no").where("left <> '' and right <> ''")
        rows = cut(rows.where(F.col("right").rlike("^\\p{L}")))
        told = _told(rows.select(*PAIR).distinct(), self.vocabulary).withColumn("word", F.concat("left", "right"))
        # a whole that is not printed may be a misread one that is
        misread = _undone(told.where(F.col("right").isin(*HANGING) & (F.col("c")[0].n + F.col("c")[1].n == 0)).select("word").distinct())
        misread = misread.join(self.known.select(F.col("known").alias("form")), "form", "left_semi").select("word", F.lit(True).alias("misread")).distinct()
        told = told.join(misread, "word", "left")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                left, right, mark, c, misread = (b.column(x).to_pylist() for x in ("left", "right", "mark", "c", "misread"))
                n = np.array([[e["n"] for e in x] for x in c], float).reshape(-1, 5)
                x = np.array([_join_features(k, a, z, m) for a, z, m, k in zip(left, right, mark, n, strict=True)], float).reshape(-1, 10)
                hanging = np.isin(np.array(right, str), list(HANGING))
                hyphen = (own.predict(x) > 0.5) & (~hanging | (n[:, 1] > 0))
                # before "and" the whole counts where it is printed more often than the left part with a hanging hyphen
                whole = ~hanging | (n[:, 0] + n[:, 1] > n[:, 4]) | np.array([bool(m) for m in misread], bool)
                words = [(f"{a}-{z}" if h else a + z) if w else None for a, z, h, w in zip(left, right, hyphen, whole, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("left"), b.column("right"), b.column("mark"), pa.array(words, pa.string())], names=["left", "right", "mark", "joined"])

        decided = told.mapInArrow(run, "left string, right string, mark string, joined string").where("joined is not null")
        return rows.join(decided, ["left", "right", "mark"]).select("block_no", "left", "right", "raw_right", "joined", "next_no")

    def _corrections(self, sample: list[tuple[str, int]]) -> DataFrame:
        """``word`` as read and ``right`` as printed, for words of the scanned blocks that clean text does not have, or has far less often than a word easily taken for them."""
        read = self.words.where(F.col("word").rlike("^[\\p{L}\\p{N}!|][\\p{L}\\p{N}!|'’-]*$") & F.col("word").rlike("\\p{L}") & (F.length("word") > 2))
        odd = read.groupBy("word").agg(F.count(F.lit(1)).alias("seen")).join(self.vocabulary, "word", "left").where((F.coalesce("clean", F.lit(0)) * 20 < F.col("seen")) | F.col("rival").isNotNull()).select("word", "seen", F.coalesce("clean", F.lit(0)).alias("own"))
        # a compound that no clean text has is put right part by part
        parts = cut(odd.where("word like '%-%'").select(F.col("word").alias("whole"), F.posexplode(F.split("word", "-")).alias("at", "word")))
        # a part that compounds of clean text have is a word of its own
        held = self.vocabulary.where("word like '%-%'").select(F.explode(F.split("word", "-")).alias("word"), "clean").groupBy("word").agg(F.sum("clean").alias("inside"))
        more = parts.where(F.length("word") > 2).groupBy("word").agg(F.count(F.lit(1)).alias("seen")).join(self.vocabulary, "word", "left").join(held, "word", "left")
        more = more.withColumn("own", F.coalesce("clean", F.lit(0)) + F.coalesce("inside", F.lit(0))).where("own * 20 < seen or rival is not null").select("word", "seen", "own")
        best = cut(_rank(_candidates(cut(odd.union(more).groupBy("word").agg(F.max("seen").alias("seen"), F.max("own").alias("own"))), self.known), _rank_model(self.known, sample)))
        put = parts.join(best, "word", "left").groupBy("whole").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("right", "word").alias("w")))).alias("p"), F.min("sureness").alias("sureness"))
        compounds = put.where("sureness is not null").select(F.col("whole").alias("word"), F.array_join(F.transform("p", lambda e: e["w"]), "-").alias("right"), "sureness")
        return best.union(compounds.join(best, "word", "left_anti"))

    def _fix(self) -> DataFrame:
        few = self.corrections.count() <= BROADCAST_ROWS
        return F.broadcast(self.corrections) if few else self.corrections

    def joined_words(self) -> DataFrame:
        """``block_no`` and ``joined_word``, put right."""
        fixed = self._fix().select("word", F.col("right").alias("fixed"))
        return self.joins.select("block_no", F.col("joined").alias("word")).join(fixed, "word", "left").select("block_no", F.coalesce("fixed", "word").alias("joined_word"))

    def corrected_words(self) -> DataFrame:
        """``block_no``, ``read_word`` and ``right_word`` of each misread word outside furniture."""
        return self.words.join(self._fix().select("word", "right"), "word").select("block_no", F.col("word").alias("read_word"), F.col("right").alias("right_word"))


    def paragraphs(self) -> DataFrame:
        """``block_no``, ``block_type``, ``paragraph_text`` and ``continued_in``: each block as continuous text.

        Furniture is gone, broken words are whole, misread words are put right, lines are joined by blanks.  A word that
        is broken over two blocks stands in the first, which names the second.  Blocks that are all furniture have no
        row; code and formulas keep their lines.
        """
        fixes = self.corrected_words().groupBy("block_no").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("read_word", "right_word")))).alias("fixes"))
        whole = self.joins.groupBy("block_no").agg(F.collect_set(F.struct("left", "right", "raw_right", "joined")).alias("joins"), F.max("next_no").alias("continued_in"))
        taken = self.joins.where("next_no is not null").select(F.col("next_no").alias("block_no"), F.lit(True).alias("headless")).distinct()
        src = self.blocks.select("block_no", "block_type", "text").join(self.scan.where(~F.col("gone")).select("block_no", "furniture"), "block_no").join(fixes, "block_no", "left").join(whole, "block_no", "left").join(taken, "block_no", "left")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = [_continuous(*r) for r in zip(*(b.column(c).to_pylist() for c in ("block_type", "text", "furniture", "fixes", "joins", "continued_in", "headless")), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("block_no"), b.column("block_type"), pa.array(made, pa.string()), b.column("continued_in")], names=["block_no", "block_type", "paragraph_text", "continued_in"])

        return src.mapInArrow(run, "block_no long, block_type string, paragraph_text string, continued_in long")


def _put_right(token: str, fixes: dict[str, str]) -> str:
    """The token with its word replaced; what surrounds the word and its capital stay."""
    bare = plain(token)
    right = fixes.get(bare)
    at = token.lower().find(bare)
    if right is None or at < 0:
        return token
    kept = token[at : at + len(bare)]
    if kept.isupper() and len(kept) > 1:
        right = right.upper()
    elif kept[:1].isupper():
        right = right[:1].upper() + right[1:]
    return token[:at] + right + token[at + len(bare) :]


def _continuous(kind: str, text: str, furniture: list[int] | None, fixes: list | None, joins: list | None, continued: int | None, headless: bool | None) -> str:
    gone, fixed = set(furniture or []), dict(fixes or [])
    whole = {(j["left"], j["right"]): j["joined"] for j in joins or []}
    lines = [x for i, x in enumerate(lines_of(text), 1) if i not in gone and x.strip()]
    if not reads_as_prose(kind, lines):
        return "\n".join(x for i, x in enumerate(lines_of(text), 1) if i not in gone) if gone else text
    out: list[str] = []
    carry = ""
    for i, line in enumerate(lines):
        parts = line.split()
        if headless and i == 0:
            parts = parts[1:]
        if carry and parts:
            joined = whole.get((plain(carry), plain(parts[0])))
            out += [_merged(carry, parts[0], joined)] if joined else [carry + "-", parts[0]]
            parts = parts[1:]
        elif carry:
            out.append(carry + "-")
        carry = ""
        m = _BREAK.match(line.rstrip())
        if m and parts:
            carry = m[2]
            parts = parts[:-1]
        out += parts
    if carry:
        over = next((j for j in joins or [] if continued is not None and j["left"] == plain(carry)), None)
        out.append(_merged(carry, over["raw_right"], over["joined"]) if over else carry + "-")
    return " ".join(_put_right(t, fixed) for t in out)


def _merged(left: str, right: str, joined: str) -> str:
    """The whole word with the signs before its first part and after its second, and the capital it had."""
    before = left[: max(0, left.lower().find(plain(left)))]
    bare = plain(right)
    after = right[right.lower().find(bare) + len(bare) :]
    return before + (joined[:1].upper() + joined[1:] if left[len(before) : len(before) + 1].isupper() else joined) + after


def noise(blocks: DataFrame) -> DataFrame:
    """Distinct rows (block_no, noise_kind, found_value) for the scanned blocks of ``blocks``.

    Blocks of other sources, with null text or without a number have no rows; an empty text has none.  Repeated rows
    count once.  Other columns are not read.
    """
    r = Repair(blocks)
    parts = (
        r.joined_words().select("block_no", F.lit("joined_word").alias("noise_kind"), F.col("joined_word").alias("found_value")),
        r.corrected_words().select("block_no", F.lit("corrected_word").alias("noise_kind"), F.col("right_word").alias("found_value")),
        r.furniture().select("block_no", F.lit("furniture_line").alias("noise_kind"), F.col("line_no").cast("string").alias("found_value")),
    )
    return parts[0].union(parts[1]).union(parts[2]).distinct()
