"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of whole documents of a megabyte or so inside a task.  Its
words are numbered by the benchmark's vocabulary; a word outside it can be in
no window, so the shard's sequence holds the runs of vocabulary words that are
long enough for the shortest window, each ended by a symbol of its own.  The
sequence is suffix-sorted, its Burrows-Wheeler transform kept as a wavelet
matrix, and all windows are searched backwards at once by its ranks.  Rows of
found intervals walk back to sampled suffix positions, the occurrences mark
words, and runs of marked words become the removal spans.

The benchmark is the query set: it is searched in blocks of ``BLOCK_BYTES``,
one after another within the same pass over the documents; there is no shuffle
and nothing is gathered from the documents.

Words are runs of 0-9, a-z (A-Z are lower-cased) and code points from U+0080.
A window is ``window`` consecutive words of an item, or all words of a shorter
item.  Defined results: a null or empty text has no words, spans or items and
is not contaminated; a null item text or item id is ignored; repeated rows are
judged each by itself; an empty benchmark marks nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from revel.llm import arrays as A
from revel.llm.jobs import lean, schema

WORD = A.table(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))
BLOCK_BYTES = 8 << 20
SAMPLE = 16
FOUND = "_n_words long, _n_hit long, _items array<string>, _spans array<struct<start:int,end:int>>"


def hashed_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, hash, at)`` of the words of each text."""
    start, end = A.spans(WORD[buf], off)
    return start, end, A.slice_hash(A.prefix_hash(A.LOWER[buf]), start, end), np.searchsorted(start, off)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Sorted suffixes by prefix doubling; only suffixes not yet told apart are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    first = np.flatnonzero(A.distinct(symbols[order]))
    rank[order] = np.repeat(first, np.diff(first, append=n))
    size = np.diff(first, append=n)
    open_ = np.flatnonzero(np.repeat(size > 1, size))
    step = 1
    while len(open_):
        at = order[open_]
        key = rank[at] * (n + 1) + rank[np.minimum(at + step, n)] + 1
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[open_] = at
        new = A.distinct(key)
        head = np.flatnonzero(new)
        size = np.diff(head, append=len(key))
        rank[at] = np.repeat(open_[head], size)
        open_ = open_[np.repeat(size > 1, size)]
        step *= 2
    return order


class FMIndex:
    """Index of a sequence of symbols 1..top in segments; ``segment_ends`` are the
    places of the end symbols (0 in ``symbols``)."""

    def __init__(self, symbols: np.ndarray, top: int):
        ends = symbols == 0
        n_ends = int(ends.sum())
        unique = symbols + n_ends
        unique[ends] = np.arange(n_ends)
        sa = suffix_array(unique)
        self.n = len(symbols)
        bwt = symbols[sa - 1]
        counts = np.bincount(symbols, minlength=top + 1)
        self.first = A.bounds(counts)[:-1]
        # wavelet matrix: ranks of ones on every level, zeros moved to the front
        self.levels: list[tuple[int, np.ndarray, int]] = []
        row, zero = bwt, np.zeros(top + 1, np.int64)
        for shift in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bit = (row >> shift) & 1
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            zeros = self.n - int(ones[-1])
            self.levels.append((shift, ones, zeros))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.base = self._down(np.arange(top + 1), zero)
        start = np.zeros(self.n, bool)
        start[0] = True
        start[1:] = ends[:-1]
        sampled = start[sa] | (sa % SAMPLE == 0)
        self.sampled = np.zeros(self.n + 1, np.int64)
        np.cumsum(sampled, out=self.sampled[1:])
        self.positions = sa[sampled]

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, ones, zeros in self.levels:
            r = ones[i]
            i = np.where((symbol >> shift) & 1, zeros + r, i - r)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` in the first ``i`` places of the transform."""
        return self._down(symbol, i) - self.base[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of right-aligned patterns (0 left of shorter ones)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            go = live[c > 0]
            c = c[c > 0]
            lo[go], hi[go] = self.first[c] + self.rank(c, lo[go]), self.first[c] + self.rank(c, hi[go])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled suffix."""
        out, steps = np.empty(len(rows), np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            known = self.sampled[rows + 1] > self.sampled[rows]
            out[open_[known]] = self.positions[self.sampled[rows[known]]] + steps
            open_, rows = open_[~known], rows[~known]
            i, symbol = rows, np.zeros(len(rows), np.int64)
            for shift, ones, zeros in self.levels:
                bit = ones[i + 1] > ones[i]
                symbol |= bit.astype(np.int64) << shift
                i = np.where(bit, zeros + ones[i], i - ones[i])
            rows = self.first[symbol] + i - self.base[symbol]
            steps += 1
        return out


@dataclass
class Windows:
    """Distinct windows of a block of items, right-aligned word numbers."""

    vocabulary: np.ndarray  # sorted word hashes; number 1 is the first
    patterns: np.ndarray
    lengths: np.ndarray
    item_at: np.ndarray     # pattern p stands in items item_of[item_at[p]:item_at[p+1]]
    item_of: np.ndarray
    items: list[str]


def windows(items: list[tuple[str, str]], window: int) -> Windows:
    buf, off = A.utf8(pa.array([t for _, t in items], pa.string()))
    _, _, h, at = hashed_words(buf, off)
    vocabulary = A.uniq(h)
    number = np.searchsorted(vocabulary, h) + 1
    n = np.diff(at)
    each = np.where(n >= window, n - window + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(items)), each)
    start = A.ragged(at[:-1], each)
    length = np.minimum(n, window)[owner]
    patterns = np.zeros((len(start), window), np.int64)
    for k in range(window):
        from_end = window - k
        has = from_end <= length
        patterns[has, k] = number[(start + length)[has] - from_end]
    kinds, kind = np.unique(patterns, axis=0, return_inverse=True) if len(patterns) else (patterns, np.zeros(0, np.int64))
    kind = kind.ravel()
    by = np.argsort(kind, kind="stable")
    return Windows(vocabulary, kinds, (kinds > 0).sum(axis=1), np.searchsorted(kind[by], np.arange(len(kinds) + 1)), owner[by],
                   [i for i, _ in items])


def occurrences(w: Windows, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(pattern, word)``: each window's occurrences in a shard of hashed words."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(h) or not len(w.patterns):
        return none
    place = np.minimum(np.searchsorted(w.vocabulary, h), len(w.vocabulary) - 1)
    known = w.vocabulary[place] == h
    start, end = A.spans(known, at)
    enough = end - start >= w.lengths.min()
    start, size = start[enough], (end - start)[enough]
    if not len(start):
        return none
    words = A.ragged(start, size)
    ends = np.cumsum(size + 1) - 1
    symbols = np.zeros(int(size.sum()) + len(size), np.int64)
    inside = np.ones(len(symbols), bool)
    inside[ends] = False
    symbols[inside] = place[words] + 1
    word_of = np.zeros(len(symbols), np.int64)
    word_of[inside] = words
    index = FMIndex(symbols, len(w.vocabulary))
    lo, hi = index.search(w.patterns)
    rows = A.ragged(lo, hi - lo)
    return np.repeat(np.arange(len(lo)), hi - lo), word_of[index.locate(rows)]


def _search(rows: DataFrame, w: Windows, keep: Sequence[str], first: bool) -> DataFrame:
    """Add a block's items and spans to those that ``rows`` already has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = A.utf8(batch.column(len(keep)))
            for i, j, b, o in A.chunks(buf, off):
                start, end, h, at = hashed_words(b, o)
                pattern, word = occurrences(w, h, at)
                marks = np.zeros(len(h) + 1, np.int64)
                np.add.at(marks, word, 1)
                np.subtract.at(marks, word + w.lengths[pattern], 1)
                hit = np.cumsum(marks[:-1]) > 0
                doc = np.searchsorted(at, word, side="right") - 1
                n = w.item_at[pattern + 1] - w.item_at[pattern]
                pairs = np.unique(np.repeat(doc, n) * len(w.items) + w.item_of[A.ragged(w.item_at[pattern], n)])
                found: list[set[str]] = [set() for _ in range(j - i)]
                for p in pairs.tolist():
                    found[p // len(w.items)].add(w.items[p % len(w.items)])
                if not first:
                    old = batch.slice(i, j - i)
                    for k, (items, spans) in enumerate(zip(old.column(len(keep) + 3).to_pylist(), old.column(len(keep) + 4).to_pylist())):
                        found[k].update(items)
                        for s in spans:
                            a, e = np.searchsorted(start, [o[k] + s["start"], o[k] + s["end"]])
                            hit[a:e] = True
                s, e = A.spans(hit, at)
                s_at = np.searchsorted(s, at)
                base = np.repeat(o[:-1], np.diff(s_at))
                spans = pa.StructArray.from_arrays([pa.array((start[s] - base).astype(np.int32)), pa.array((end[e - 1] - base).astype(np.int32))],
                                                   ["start", "end"])
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(i, j - i) for c in range(len(keep) + 1)), pa.array(np.diff(at)), pa.array(A.total(hit, at)),
                    pa.array([sorted(f) for f in found], pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(s_at.astype(np.int32)), spans)],
                    out.names)

    out = schema({c: rows.schema[c].dataType for c in [*keep, "_scanned"]}, FOUND)
    return rows.mapInArrow(lean(run), out)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 13, text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of each document and ``_n_words, _n_hit, _items, _spans``
    (items with occurring windows, as sorted strings; merged spans of hit words, in UTF-8 bytes)."""
    items = benchmark.select(F.col(item_col).cast("string").alias("_i"), F.col(item_text_col).alias("_t")).where("_i is not null and _t is not null")
    rows, first = docs.select(*keep, F.col(text_col).alias("_scanned")), True
    block: list[tuple[str, str]] = []
    size = 0
    for r in items.toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if size >= BLOCK_BYTES:
            rows, first, block, size = _search(rows, windows(block, window), keep, first), False, [], 0
    if block or first:
        rows = _search(rows, windows(block, window), keep, first)
    return rows.drop("_scanned")


#: Hit words are 5 in 100 of all words, or more.
CONTAMINATED = "_n_hit > 0 and 20 * _n_hit >= _n_words"


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    found = scan(docs, benchmark, keep=[id_col])
    return found.select(id_col, F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"),
                        F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
                        F.expr(CONTAMINATED).alias("contaminated"))


def cut(rows: DataFrame, text_col: str = "text", spans_col: str = "_spans") -> DataFrame:
    """``rows`` with the spans taken out of the text; without the span column."""
    place = {c: k for k, c in enumerate(rows.columns)}
    names = [c for c in rows.columns if c != spans_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = (batch.column(place[c]).to_pylist() for c in (text_col, spans_col))
            for k, own in enumerate(spans):
                if own:
                    raw, out, last = texts[k].encode(), [], 0
                    for s in own:
                        out.append(raw[last:s["start"]])
                        last = s["end"]
                    texts[k] = b"".join([*out, raw[last:]]).decode()
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if c == text_col else batch.column(place[c]) for c in names], names)

    return rows.mapInArrow(lean(run), StructType([rows.schema[c] for c in names]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated documents; from the others the hit spans are taken out."""
    found = scan(docs, benchmark, text_col=text_col, keep=docs.columns)
    return cut(found.where(f"not ({CONTAMINATED})").select(*docs.columns, "_spans"), text_col)
