"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point.  An
n-gram is bound from its letters' vectors, each permuted (rotated) by its place:
``roll(v(a), 2) * roll(v(b), 1) * v(c)``.  A text's profile bundles (sums) its
n-gram vectors, a language's prototype bundles all texts of that language, and
a text takes the language whose prototype has the largest cosine with it.

Bundling is linear, so the prototypes of *all* training texts are computed from
n-gram counts per language: tasks count, Spark sums the counts, and only one
vector per language reaches the driver.  Prediction reads each text once and
shuffles nothing.

Letters are code points of Unicode category L, lower-cased; anything else is a
gap, and gaps in a row are one.  N-grams have a letter in their middle, so none
crosses a text's ends.

Defined results: a null text and one without a letter get ``und`` and score 0;
with no training text every text gets ``und``; ties between languages go to the
first in name order; texts whose language is null train nothing; repeated rows
are predicted each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revel.llm import arrays as A
from revel.llm.jobs import lean, schema

DIMENSIONS = 1024
SEED = 20240607
GAP = 0
#: n-grams whose vectors a task keeps (float32: 4 kB each)
KEPT_GRAMS = 12_000
DOCS_AT_ONCE = 256

_fold: np.ndarray | None = None
_letters: dict[int, np.ndarray] = {}


def fold_table() -> np.ndarray:
    """Code point -> lower-case letter, or the gap."""
    global _fold
    if _fold is None:
        t = np.zeros(0x110000, np.int32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                t[c] = ord(low) if len(low := s.lower()) == 1 else c
        _fold = t
    return _fold


def letter_vector(code: int, dims: int, seed: int) -> np.ndarray:
    if (v := _letters.get((code, dims, seed))) is None:
        v = np.random.Generator(np.random.PCG64([seed, code])).integers(0, 2, dims, dtype=np.int8) * np.int8(2) - np.int8(1)
        _letters[code, dims, seed] = v
    return v


def gram_vectors(grams: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """Bound vectors of packed trigrams, one row each."""
    parts = [(grams >> s) & 0x1FFFFF for s in (42, 21, 0)]
    out = np.ones((len(grams), dims), np.int8)
    for part, turn in zip(parts, (2, 1, 0)):
        kinds = A.uniq(part)
        vectors = np.stack([np.roll(letter_vector(int(c), dims, seed), turn) for c in kinds]) if len(kinds) else out
        out *= vectors[np.searchsorted(kinds, part)]
    return out


def trigrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(document, packed trigram)`` of every trigram with a letter in its middle."""
    points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
    at = lead[off]
    letter = fold_table()[points]
    # a gap before every document and one after the last
    doc = np.repeat(np.arange(len(off) - 1), np.diff(at))
    place = np.arange(len(letter)) + doc + 1
    seq = np.zeros(len(letter) + len(off), np.int64)
    seq[place] = letter
    owner = np.zeros(len(seq), np.int64)
    owner[place] = doc
    keep = np.ones(len(seq), bool)
    keep[1:] = (seq[1:] != GAP) | (seq[:-1] != GAP)
    seq, owner = seq[keep], owner[keep]
    mid = np.flatnonzero(seq[1:-1] != GAP) + 1
    return owner[mid], (seq[mid - 1] << 42) | (seq[mid] << 21) | seq[mid + 1]


def count_grams(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``lang, gram, n`` over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]

        def merged():
            lang, gram, n = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((gram, lang))
            lang, gram, n = lang[order], gram[order], n[order]
            first = np.flatnonzero(A.distinct(gram) | A.distinct(lang))
            return lang[first], gram[first], np.add.reduceat(n, first) if len(first) else n

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for x in langs:
                if x not in names:
                    names.append(x)
            code = np.array([names.index(x) for x in langs], np.int64)
            buf, off = A.utf8(batch.column(1))
            for i, j, b, o in A.chunks(buf, off):
                doc, gram = trigrams(b, o)
                lang = code[i:j][doc]
                for k in set(code[i:j].tolist()):
                    own = np.sort(gram[lang == k])
                    first = np.flatnonzero(A.distinct(own))
                    held.append((np.full(len(first), k), own[first], np.diff(first, append=len(own))))
                if sum(len(x[0]) for x in held) > 4_000_000:
                    held[:] = [merged()]
        lang, gram, n = merged()
        for s in range(0, len(lang), 100_000):
            e = slice(s, s + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in lang[e]], pa.string()), pa.array(gram[e]), pa.array(n[e])],
                                             ["lang", "gram", "n"])

    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = texts.where("lang is not null and text is not null").mapInArrow(lean(count), "lang string, gram long, n long")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Profiles:
    names: tuple[str, ...]
    vectors: np.ndarray  # unit length, one row a language
    dims: int
    seed: int


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dims: int = DIMENSIONS, seed: int = SEED) -> Profiles:
    """Prototypes of all languages of ``docs``: one vector a language comes to the driver."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist(), object)
            gram, n = (batch.column(k).to_numpy() for k in (1, 2))
            for name in set(lang):
                for s in range(0, len(own := np.flatnonzero(lang == name)), 4096):
                    i = own[s:s + 4096]
                    sums[name] = sums.get(name, 0) + n[i] @ gram_vectors(gram[i], dims, seed).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([k for k in sums for _ in range(dims)]), pa.array(list(range(dims)) * len(sums), pa.int32()),
                                              pa.array(np.concatenate(list(sums.values())))], ["lang", "dim", "v"])

    parts = count_grams(docs, text_col, lang_col).mapInArrow(lean(bundle), "lang string, dim int, v long")
    whole = parts.groupBy("lang", "dim").agg(F.sum("v").alias("v")).groupBy("lang")
    rows = sorted(whole.agg(F.array_sort(F.collect_list(F.struct("dim", "v"))).getField("v").alias("v")).collect())
    if not rows:
        return Profiles((), np.zeros((0, dims), np.float32), dims, seed)
    v = np.array([r.v for r in rows], np.float64)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
    return Profiles(tuple(r.lang for r in rows), v.astype(np.float32), dims, seed)


class _Vectors:
    """Vectors of the n-grams seen by a task, up to ``KEPT_GRAMS`` of them."""

    def __init__(self, profiles: Profiles):
        self.p, self.grams, self.rows = profiles, np.zeros(0, np.int64), np.zeros((0, profiles.dims), np.float32)

    def of(self, grams: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.grams, grams), max(0, len(self.grams) - 1))
        new = grams if not len(self.grams) else grams[self.grams[place] != grams]
        if len(new):
            if len(self.grams) + len(new) > KEPT_GRAMS:
                return gram_vectors(grams, self.p.dims, self.p.seed).astype(np.float32)
            both = np.concatenate([self.grams, new])
            order = np.argsort(both)
            self.rows = np.concatenate([self.rows, gram_vectors(new, self.p.dims, self.p.seed).astype(np.float32)])[order]
            self.grams = both[order]
        if len(grams) == len(self.grams):
            return self.rows
        return self.rows[np.searchsorted(self.grams, grams)]


def profile(doc: np.ndarray, gram: np.ndarray, n_docs: int, vectors: _Vectors) -> np.ndarray:
    """Bundled vector of each document, a block of n-grams at a time."""
    out = np.zeros((n_docs, vectors.p.dims), np.float32)
    kinds = A.uniq(gram)
    column = np.searchsorted(kinds, gram)
    for s in range(0, len(kinds), KEPT_GRAMS):
        part = kinds[s:s + KEPT_GRAMS]
        own = (column >= s) & (column < s + len(part)) if len(kinds) > KEPT_GRAMS else slice(None)
        counts = np.bincount(doc[own] * len(part) + column[own] - s, minlength=n_docs * len(part))
        out += counts.reshape(n_docs, len(part)).astype(np.float32) @ vectors.of(part)
    return out


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text",
            keep: Sequence[str] = ()) -> DataFrame:
    """``id, lang_pred, score``: the best language and its cosine, cut to 0..1.
    With ``keep``, these columns of ``docs`` and then ``_lang_pred, _score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = _Vectors(profiles)
        names = pa.array(profiles.names, pa.string())
        for batch in batches:
            buf, off = A.utf8(batch.column(batch.num_columns - 1))
            lang, score = [], []
            for i, j, b, o in A.chunks(buf, off):
                doc, gram = trigrams(b, o)
                at = np.searchsorted(doc, np.arange(j - i + 1))
                for s in range(0, j - i, DOCS_AT_ONCE):
                    e = min(j - i, s + DOCS_AT_ONCE)
                    own = slice(at[s], at[e])
                    has = np.diff(at[s:e + 1]) > 0
                    if not profiles.names:
                        lang.append(pa.array(["und"] * (e - s)))
                        score.append(np.zeros(e - s))
                        continue
                    bundle = profile(doc[own] - s, gram[own], e - s, vectors)
                    cos = bundle @ profiles.vectors.T / np.maximum(np.linalg.norm(bundle, axis=1, keepdims=True), 1e-30)
                    best = cos.argmax(axis=1)
                    lang.append(pa.compute.if_else(pa.array(has), names.take(pa.array(best)), "und"))
                    score.append(np.where(has, np.clip(cos.max(axis=1), 0, 1), 0.0))
            if lang:
                own = [batch.column(k) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.concat_arrays(lang), pa.array(np.concatenate(score).astype(np.float64))], names_out)

    own = list(keep) or [id_col]
    found = ["_lang_pred", "_score"] if keep else ["lang_pred", "score"]
    names_out = [*own, *found]
    out = schema({c: docs.schema[c].dataType for c in own}, f"{found[0]} string, {found[1]} double")
    return docs.select(*own, F.col(text_col).alias("_text_in")).mapInArrow(lean(run), out)


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text leaves 2 when divided by 4; a null id is an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2
