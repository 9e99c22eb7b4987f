"""Quality rules by line sequence labelling.

The lines of a document form a chain; a linear-chain conditional random field
with two labels (content, boilerplate) scores binned line features and label
transitions, and Viterbi decoding labels every line.  A document is retained
when enough of its words stand on content lines, and when it passes the base
rules (long enough, not mostly repeated 8-word windows).

Training is weakly supervised: every line of a labelled document takes the
document's quality as its label.  The fit uses a bounded sample
(``sample_docs`` documents, half of either quality, ``sample_lines`` lines of
each); scoring reads all documents once, without a shuffle.

Defined results: a null or empty text has no words and no lines, fails the
base rules and is not kept; repeated rows are scored each by itself; a null id
is passed through; labels that are null or name no document are ignored; with
no labelled document of one of the qualities every line counts as content.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revel.llm import arrays as A

SYMBOL = A.table(b"#*$%&|<>")
DIGIT = A.table(b"0123456789")
UPPER = A.table(bytes(range(65, 91)))
STOP = A.table(b".!?:;\"')")
LETTER = A.table(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))

#: Lower bounds of the bins of each line feature (the first bin is below all).
BINS = {
    "symbols_per_word": (1e-9, 0.05, 0.2, 0.5, 0.9),
    "letter_share": (0.3, 0.5, 0.65, 0.72, 0.76, 0.8, 0.84),
    "digit_share": (1e-9, 0.02, 0.1, 0.3),
    "word_length": (2.5, 3.5, 4.5, 5.0, 5.5, 6.0, 7.0, 9.0),
    "same_as_previous": (1e-9, 0.05, 0.2, 0.5),
    "distinct_words": (0.1, 0.3, 0.5, 0.65, 0.8, 0.95),
    "short_words": (0.02, 0.08, 0.15, 0.25, 0.35, 0.45, 0.6),
    "words": (2, 4, 8, 16, 32, 64),
    "upper_starts": (1e-9, 0.05, 0.15, 0.4, 0.8),
    "stop_at_end": (0.5,),
    "seen_before": (0.5,),
}
SIZES = [len(b) + 1 for b in BINS.values()]
FIRST = np.concatenate([[0], np.cumsum(SIZES)]).astype(np.int64)

OUTPUT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "kept boolean, n_lines long, n_content_lines long, content_share double, line_labels string")


@dataclass(frozen=True)
class LineModel:
    """Weights of label "content" against "boilerplate" (whose emissions are 0)."""

    weights: np.ndarray  # one for each bin of each feature
    move: np.ndarray     # 2 x 2, from label to label; label 1 is content
    start: np.ndarray    # 2

    @staticmethod
    def neutral() -> LineModel:
        w = np.zeros(FIRST[-1])
        return LineModel(w, np.zeros((2, 2)), np.array([0.0, 1.0]))


@dataclass
class Lines:
    """Lines with at least a word; document i has lines ``at[i] .. at[i+1]``."""

    at: np.ndarray
    bins: np.ndarray
    n_words: np.ndarray
    number: np.ndarray  # place of the line among all lines of its document


def _ratio(a, b):
    return a / np.maximum(b, 1)


def read_lines(buf: np.ndarray, off: np.ndarray) -> tuple[Lines, dict[str, np.ndarray]]:
    """Line features and the documents' base counts of one chunk."""
    ws, we, wat = A.words(buf, off)
    prefix = A.prefix_hash(buf)
    wh = A.slice_hash(prefix, ws, we)
    # all lines, blank ones too: a document's text splits after every \n
    nl = np.flatnonzero(buf == 10)
    doc_of_nl = np.searchsorted(off, nl, side="right") - 1
    start = np.concatenate([off[:-1], nl + 1])
    order = np.lexsort((np.concatenate([np.zeros(len(off) - 1), np.ones(len(nl))]), start,
                        np.concatenate([np.arange(len(off) - 1), doc_of_nl])))
    start = start[order]
    doc = np.concatenate([np.arange(len(off) - 1), doc_of_nl])[order]
    end = np.empty_like(start)
    if len(start):
        end[:-1] = start[1:] - 1
        last = np.ones(len(start), bool)
        last[:-1] = doc[1:] != doc[:-1]
        end[last] = off[doc[last] + 1]
    first_of_doc = np.searchsorted(doc, np.arange(len(off) - 1))
    number = np.arange(len(start)) - first_of_doc[doc]
    w0, w1 = np.searchsorted(ws, start), np.searchsorted(ws, end)
    has = w1 > w0
    start, end, doc, number, w0, w1 = (x[has] for x in (start, end, doc, number, w0, w1))
    at = np.searchsorted(doc, np.arange(len(off)))
    nw = w1 - w0

    # a line equal to an earlier line of its document
    lh = A.slice_hash(prefix, start, end)
    by = np.lexsort((np.arange(len(lh)), lh, doc))
    seen = np.zeros(len(lh), bool)
    if len(by):
        seen[by[1:]] = (lh[by][1:] == lh[by][:-1]) & (doc[by][1:] == doc[by][:-1])

    def share(mask):
        c = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return c[end] - c[start]

    lead = (buf & 0xC0) != 0x80
    in_word = ~A.BLANK[buf]
    chars = share(lead & in_word)
    size = we - ws
    wc = np.zeros(len(ws) + 1, np.int64)

    def word_sum(values):
        np.cumsum(values, out=wc[1:])
        return wc[w1] - wc[w0]

    same = np.zeros(len(ws), bool)
    same[1:] = wh[1:] == wh[:-1]
    same[w0] = False
    line_of = np.repeat(np.arange(len(nw)), nw)
    key = A.mix(wh ^ (line_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) if len(wh) == len(line_of) else None
    order = np.argsort(key, kind="stable")
    new = A.distinct(key[order])
    kinds = np.bincount(line_of[order[new]], minlength=len(nw))
    values = {
        "symbols_per_word": _ratio(share(SYMBOL[buf]), nw),
        "letter_share": _ratio(share(LETTER[buf] & lead), share(lead)),
        "digit_share": _ratio(share(DIGIT[buf]), share(lead)),
        "word_length": _ratio(chars, nw),
        "same_as_previous": _ratio(word_sum(same), nw),
        "distinct_words": _ratio(kinds, nw),
        "short_words": _ratio(word_sum(size <= 3), nw),
        "words": nw,
        "upper_starts": _ratio(word_sum(UPPER[buf[ws]] if len(ws) else size), nw),
        "stop_at_end": STOP[buf[we[w1 - 1] - 1]] if len(w1) else nw,
        "seen_before": seen,
    }
    bins = np.stack([np.searchsorted(BINS[k], v.astype(np.float64), side="right") + FIRST[i]
                     for i, (k, v) in enumerate(values.items())], axis=1) if len(nw) else np.zeros((0, len(BINS)), int)

    # words of 8-word windows that occur twice or more in their document
    repeat = np.zeros(len(ws) + 1, np.int64)
    g = A.gram_hash(wh, 8)
    wdoc = np.repeat(np.arange(len(off) - 1), np.diff(wat))
    whole = np.flatnonzero(wdoc[:len(g)] == wdoc[len(wdoc) - len(g):]) if len(g) else np.zeros(0, int)
    if len(whole):
        key = A.mix(g[whole] ^ (wdoc[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        by = np.argsort(key, kind="stable")
        same_key = key[by][1:] == key[by][:-1]
        twice = np.zeros(len(by), bool)
        twice[1:] |= same_key
        twice[:-1] |= same_key
        hit = whole[by[twice]]
        repeat[hit] += 1
        np.subtract.at(repeat, hit + 8, 1)
    base = {
        "n_words": np.diff(wat),
        "word_chars": A.total(lead & in_word, off),
        "n_symbols": A.total(SYMBOL[buf], off),
        "n_dup_lines": A.total(seen, at),
        "n_repeat_words": A.total(np.cumsum(repeat[:-1]) > 0, wat),
    }
    return Lines(at, bins, nw, number), base


def _steps(at: np.ndarray):
    """Documents with lines, longest first, and how many have a t-th line."""
    n = np.diff(at)
    docs = np.argsort(-n, kind="stable")
    docs = docs[: int((n > 0).sum())]
    longest = int(n.max()) if len(n) else 0
    active = np.searchsorted(-n[docs], -np.arange(longest), side="left")
    return docs, active


def viterbi(model: LineModel, lines: Lines) -> np.ndarray:
    """Best label (1: content) of every line."""
    e = model.weights[lines.bins].sum(axis=1)
    docs, active = _steps(lines.at)
    first, label = lines.at[docs], np.zeros(len(e), np.int8)
    back = np.zeros((len(e), 2), np.int8)
    score = np.tile(model.start, (len(docs), 1))
    for t, m in enumerate(active):
        i = first[:m] + t
        if t:
            via = score[:m, :, None] + model.move
            back[i] = via.argmax(axis=1)
            score[:m] = via.max(axis=1)
        score[:m, 1] += e[i]
    state = score.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        i = first[:m] + t
        # a document enters at its own last line with its final state
        label[i] = state[:m]
        state[:m] = back[i, state[:m]]
    return label


def _soft(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def fit_chain(lines: Lines, truth: np.ndarray, rounds: int = 120, ridge: float = 1e-3, rate: float = 0.15) -> LineModel:
    """Maximum conditional likelihood by gradient steps; marginals from forward-backward."""
    docs, active = _steps(lines.at)
    first, n = lines.at[docs], len(truth)
    p = np.zeros(FIRST[-1] + 6)
    m1, m2 = np.zeros_like(p), np.zeros_like(p)
    y, last = truth.astype(np.int64), first + np.diff(lines.at)[docs] - 1
    goal_move = np.zeros((2, 2))
    for t, m in enumerate(active[1:], 1):
        np.add.at(goal_move, (y[first[:m] + t - 1], y[first[:m] + t]), 1)
    goal_start = np.bincount(y[first], minlength=2).astype(float)
    for step in range(1, rounds + 1):
        w, move, start = p[:-6], p[-6:-2].reshape(2, 2), p[-2:]
        e = np.zeros((n, 2))
        e[:, 1] = w[lines.bins].sum(axis=1)
        f, b = np.zeros((n, 2)), np.zeros((n, 2))
        for t, m in enumerate(active):
            i = first[:m] + t
            f[i] = e[i] + (_soft(f[i - 1][:, :, None] + move, 1) if t else start)
        for t in range(len(active) - 1, 0, -1):
            i = first[:active[t]] + t
            b[i - 1] = _soft(move + (e[i] + b[i])[:, None, :], 2)
        z = np.zeros(n)
        z[first] = _soft(f[last], 1)
        size = np.diff(lines.at)[docs]
        z_of = np.zeros(n)
        z_of[A.ragged(first, size)] = np.repeat(z[first], size)
        marginal = np.exp(f + b - z_of[:, None])
        got_move = np.zeros((2, 2))
        inner = np.ones(n, bool)
        inner[first] = False
        i = np.flatnonzero(inner)
        if len(i):
            got_move = np.exp(f[i - 1][:, :, None] + move + (e[i] + b[i])[:, None, :] - z_of[i][:, None, None]).sum(axis=0)
        grad = np.zeros_like(p)
        grad[:-6] = np.bincount(lines.bins.ravel(), np.repeat(y - marginal[:, 1], lines.bins.shape[1]), FIRST[-1])
        grad[-6:-2] = (goal_move - got_move).ravel()
        grad[-2:] = goal_start - marginal[first].sum(axis=0)
        grad = grad / n - ridge * p
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        p = p + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
    return LineModel(p[:-6].copy(), p[-6:-2].reshape(2, 2).copy(), p[-2:].copy())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality",
        sample_docs: int = 3000, sample_lines: int = 200) -> LineModel:
    """Fit on at most ``sample_docs`` labelled documents, chosen by a hash of
    the id, and ``sample_lines`` lines of each."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(quality_col).cast("int").alias("_q"))
    known = known.where("_id is not null and _q in (0, 1)").groupBy("_id").agg(F.min("_q").alias("_q"))
    half = [known.where(F.col("_q") == q).orderBy(F.xxhash64("_id"), "_id").limit(sample_docs // 2) for q in (0, 1)]
    sample = half[0].unionByName(half[1])
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    rows = rows.select("_q", "_text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = A.utf8(batch.column(1))
            q = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, b, o in A.chunks(buf, off):
                lines, _ = read_lines(b, o)
                out = [lines.bins[s:min(e, s + sample_lines)].astype(np.uint8).tobytes() for s, e in zip(lines.at, lines.at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(q[i:j], pa.int32()), pa.array(out, pa.binary())], ["q", "bins"])

    # sorted: the sum of gradients then runs in the same order on any partitioning; repeated ids are cut to the bound
    got = sorted(rows.mapInArrow(features, "q int, bins binary").limit(2 * sample_docs).collect())
    bins = [np.frombuffer(r.bins, np.uint8).reshape(-1, len(BINS)).astype(np.int64) for r in got]
    kept = [(b, r.q) for b, r in zip(bins, got) if len(b)]
    if {q for _, q in kept} != {0, 1}:
        return LineModel.neutral()
    at = A.bounds(np.array([len(b) for b, _ in kept]))
    truth = np.repeat([q for _, q in kept], np.diff(at))
    return fit_chain(Lines(at, np.concatenate([b for b, _ in kept]), np.ones(at[-1]), np.zeros(at[-1])), truth)


def label_documents(docs: DataFrame, model: LineModel, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20,
                    repeat_percent: int = 30, min_content: float = 0.5) -> DataFrame:
    """One row for each row of ``docs``: its id, base counts, the verdict, and
    ``line_labels`` with a letter for each line (C content, B boilerplate, - no word)."""
    names = [c.split()[0] for c in OUTPUT.split(", ")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = A.utf8(batch.column(1))
            for i, j, b, o in A.chunks(buf, off):
                lines, out = read_lines(b, o)
                label = viterbi(model, lines)
                content = A.total_of(np.where(label == 1, lines.n_words, 0), lines.at)
                share = content / np.maximum(out["n_words"], 1)
                failed = (out["n_words"] < min_words) | (100 * out["n_repeat_words"] > repeat_percent * out["n_words"])
                marks = []
                n_lines = A.total(b == 10, o) + 1
                for k in range(j - i):
                    row = np.full(n_lines[k], ord("-"), np.uint8)
                    s, e = lines.at[k], lines.at[k + 1]
                    row[lines.number[s:e]] = np.where(label[s:e] == 1, ord("C"), ord("B"))
                    marks.append(row.tobytes().decode("ascii") if o[k + 1] > o[k] else "")
                out |= {"base_failed": failed, "kept": ~failed & (share >= min_content), "n_lines": np.diff(lines.at),
                        "n_content_lines": A.total(label == 1, lines.at), "content_share": share, "line_labels": marks}
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *[pa.array(out[n]) for n in names]], [id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(score, f"`{id_col}` {kind}, {OUTPUT}")
