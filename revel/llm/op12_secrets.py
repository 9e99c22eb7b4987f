"""Secret scan by a linear-chain conditional random field.

Three patterns (assignments, access keys, long hexadecimal strings) give the
base spans of every text.  A chain then tags the tokens of the whole text as
outside, begin or inside of a secret and is decoded by Viterbi; what it finds
beside the base spans is added with the kind ``crf``.

*Tokens* are runs of letters, digits and ``_-+/``, and runs of other marks.
*Features* are binned: shape (length, kinds of characters, share of digits,
changes between kinds, distinct characters, hexadecimal), neighbouring words
(kinds of the two tokens before and of the next one, whether they touch) and
the file (marks, digits and assignments among its tokens, its length).

*Training* is weakly supervised by the base spans, on a bounded sample:
``sample_docs`` documents, half of them chosen among those with a word or shape
that may begin a secret, by a hash of the id, and ``sample_tokens`` tokens of
each, about its first span.  Every sequence of the sample with a span is used a
second time without the features of its neighbours, so that a shape can also
speak for itself.

*Decoding* is exact for a text of any length: chains are cut into blocks, each
block gives its best score from every entry to every exit label (all blocks of
a batch at once), the blocks of a text are composed, and labels are traced back.

Defined results: a null or empty text has no spans; a null id is passed through
(and not sampled); repeated rows are scanned each by itself; with no base span
in the sample every token is outside; an empty table gives no rows.  Places are
code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revel.llm import arrays as A
from revel.llm.jobs import batch_bytes, schema

#: Base patterns, over bytes; a match fails if its group has fewer characters (fixed values).
BASE = (
    ("assign", re.compile(rb"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 6),
    ("access", re.compile(rb"(AKIA[A-Z0-9]+)"), 20),
    ("hex", re.compile(rb"([0-9a-f]+)"), 24),
)
KINDS = [k for k, _, _ in BASE]
ADDED = "crf"
#: Where a sample may look for positive documents (a rough filter for Spark's scan).
LIKELY = r"(?i)password|passwd|secret|token|api_?key|AKIA[A-Z0-9]{4}|[0-9a-f]{24}"

#: Words that announce a secret.
KEYWORDS = ["password", "passwd", "pwd", "passphrase", "secret", "token", "key", "apikey", "api_key", "access_key", "secret_key", "private_key",
            "auth", "authorization", "bearer", "credential", "credentials", "login"]

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
NEVER = -1e4

DIGIT = A.table(b"0123456789")
LOWER = A.table(bytes(range(97, 123)))
UPPER = A.table(bytes(range(65, 91)))
HEX = A.table(b"0123456789abcdefABCDEF")
OTHER = A.table(b"_-+/")
WORD = DIGIT | LOWER | UPPER | OTHER | A.table(bytes(range(128, 256)))
QUOTE = A.table(b"\"'`")
#: 0 digit, 1 lower case, 2 upper case, 3 other word characters, 4 marks
KIND = np.select([DIGIT, LOWER, UPPER, WORD], [0, 1, 2, 3], 4).astype(np.int8)

#: Lower bounds of the bins of numeric features (the first bin is below all).
BINS = {
    "length": (3, 6, 10, 16, 32, 64, 200),
    "digits": (1e-9, 0.15, 0.35, 0.6, 0.99),
    "changes": (0.05, 0.15, 0.25, 0.4, 0.6),
    "distinct": (0.2, 0.35, 0.5, 0.7, 0.9),
    "file_marks": (0.02, 0.1, 0.25),
    "file_digits": (0.01, 0.05, 0.2),
    "file_length": (20, 200, 2000),
}
#: Features that are bins already, with their number of bins; the last four look at neighbours.
CODES = {"shape": 32, "hex": 2, "file_assigns": 2, "own_word": 2, "before": 12, "two_before": 12, "after": 12, "touch": 4}
NEIGHBOURS = ("before", "two_before", "after", "touch")
NAMES = [*BINS, *CODES]
SIZES = [len(b) + 1 for b in BINS.values()] + list(CODES.values())
FIRST = np.concatenate([[0], np.cumsum(SIZES)]).astype(np.int64)
BLOCK = 128


@dataclass(frozen=True)
class SecretModel:
    """Weights of each bin and of moves between labels (outside, begin, inside); row 3 of ``move`` is the start."""

    weights: np.ndarray  # bins x 3
    move: np.ndarray     # 4 x 3

    @staticmethod
    def neutral() -> SecretModel:
        w = np.zeros((FIRST[-1], 3))
        w[:, OUTSIDE] = 1.0
        return SecretModel(w, _allowed(np.zeros((4, 3))))


def _allowed(move: np.ndarray) -> np.ndarray:
    out = move.copy()
    out[[OUTSIDE, 3], INSIDE] = NEVER
    return out


@dataclass
class Tokens:
    """Tokens of a chunk; document i has tokens ``at[i] .. at[i+1]``."""

    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bins: np.ndarray


def base_spans(buf: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
    """``(document, start, kind, end)`` of every base match, in bytes of the chunk, sorted."""
    n = len(off) - 1
    # a zero byte after each document keeps matches inside it
    doc = np.repeat(np.arange(n), np.diff(off))
    apart = np.zeros(len(buf) + n, np.uint8)
    apart[np.arange(len(buf)) + doc] = buf
    raw, starts = apart.tobytes(), off[:-1] + np.arange(n)
    out = []
    for kind, (_, pattern, least) in enumerate(BASE):
        for m in pattern.finditer(raw):
            if m.end(1) - m.start(1) >= least:
                d = int(np.searchsorted(starts, m.start(), side="right")) - 1
                out.append((d, m.start() - d, kind, m.end() - d))
    return sorted(out)


def _secret_part(raw: bytes, start: int, kind: int, end: int) -> tuple[int, int]:
    """The part of a base match that is the secret itself."""
    m = BASE[kind][1].match(raw, start, end)
    return m.span(1)


def read_tokens(buf: np.ndarray, off: np.ndarray) -> Tokens:
    n_docs = len(off) - 1
    word = WORD[buf]
    ws, we = A.spans(word, off)
    ms, me = A.spans(~word & ~A.BLANK[buf], off)
    start = np.concatenate([ws, ms])
    by = np.argsort(start, kind="stable")
    start, end = start[by], np.concatenate([we, me])[by]
    is_word = by < len(ws)
    at = np.searchsorted(start, off)
    n = len(start)
    if not n:
        return Tokens(at, start, end, np.zeros((0, len(NAMES)), np.int64))
    size = (end - start).astype(np.int64)
    kind = KIND[buf]

    def count(mask: np.ndarray) -> np.ndarray:
        c = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, out=c[1:])
        return c[end] - c[start]

    digits, lower, upper, other = count(kind == 0), count(kind == 1), count(kind == 2), count(kind == 3)
    change = np.zeros(len(buf), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[start] = False
    # distinct bytes of tokens of 8 bytes or more; shorter ones count as all distinct
    distinct = np.ones(n)
    long = np.flatnonzero(is_word & (size >= 8))
    if len(long):
        token = np.repeat(np.arange(len(long)), size[long])
        pair = np.sort(token * 256 + buf[A.ragged(start[long], size[long])])
        distinct[long] = np.bincount(pair[A.distinct(pair)] >> 8, minlength=len(long)) / size[long]
    shape = (digits > 0) * 1 + (lower > 0) * 2 + (upper > 0) * 4 + (other > 0) * 8 + (~is_word) * 16
    # a word that only begins in upper case is of its own shape
    shape[(upper == 1) & UPPER[buf[start]] & (digits == 0) & (other == 0) & (lower > 0)] = 30

    low = A.LOWER[buf]
    prefix = A.prefix_hash(low)
    keys = np.array([k.encode() for k in KEYWORDS], dtype=object)
    known = []
    for k in keys:
        b = np.frombuffer(k, np.uint8)
        known.append(A.slice_hash(A.prefix_hash(b), np.array([0]), np.array([len(b)]))[0])
    short = np.flatnonzero(is_word & (size <= max(map(len, KEYWORDS))))
    keyword = np.zeros(n, bool)
    keyword[short] = np.isin(A.slice_hash(prefix, start[short], end[short]), np.array(known, np.uint64))

    equals, colon, quoted = count(buf == ord("=")) > 0, count(buf == ord(":")) > 0, count(QUOTE[buf]) > 0
    # kinds of a token as a neighbour: 0 none, 1 keyword, 2 '=', 3 ':', 4 quote, 5 other marks, 6 to 11 words by shape and length
    own = np.select([keyword, ~is_word & equals, ~is_word & colon, ~is_word & quoted, ~is_word], [1, 2, 3, 4, 5],
                    6 + (digits > 0) * 1 + np.where(size >= 16, 4, np.where(size >= 8, 2, 0)))

    def neighbour(values: np.ndarray, step: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        i = np.arange(max(0, n - abs(step)))
        a, b = (i + abs(step), i) if step < 0 else (i, i + step)
        out[a] = values[b]
        doc = np.repeat(np.arange(n_docs), np.diff(at))
        out[a[doc[a] != doc[b]]] = 0
        return out

    touch = np.zeros(n, np.int64)
    touch[1:] += (start[1:] == end[:-1])
    touch[:-1] += 2 * (end[:-1] == start[1:])
    assigns = np.zeros(n, bool)
    assigns[1:] = keyword[:-1] & (equals | colon)[1:] & ~is_word[1:]
    tokens = np.diff(at)

    def of_file(values: np.ndarray) -> np.ndarray:
        return np.repeat(A.total_of(values, at) / np.maximum(tokens, 1), tokens)

    values = {
        "length": size, "digits": digits / size, "changes": count(change) / size, "distinct": distinct,
        "file_marks": of_file((~is_word).astype(np.int64)), "file_digits": of_file((digits > 0).astype(np.int64)), "file_length": np.repeat(tokens, tokens),
    }
    codes = {"shape": shape, "hex": (count(HEX[buf]) == size) & (size >= 8), "file_assigns": of_file(assigns.astype(np.int64)) > 0, "own_word": keyword,
             "before": neighbour(own, -1), "two_before": neighbour(own, -2), "after": neighbour(own, 1), "touch": touch}
    bins = np.empty((n, len(NAMES)), np.int64)
    for f, name in enumerate(NAMES):
        bins[:, f] = (np.searchsorted(BINS[name], values[name], side="right") if name in BINS else codes[name]) + FIRST[f]
    return Tokens(at, start, end, bins)


def emissions(model: SecretModel, bins: np.ndarray) -> np.ndarray:
    e = np.zeros((len(bins), 3))
    for f in range(bins.shape[1]):
        e += model.weights[bins[:, f]]
    return e


def viterbi(e: np.ndarray, at: np.ndarray, move: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Best label of every token; chain i has tokens ``at[i] .. at[i+1]``, decoded in blocks."""
    label = np.zeros(len(e), np.int8)
    n = np.diff(at)
    per = -(-n // block)
    total = int(per.sum())
    if not total:
        return label
    chain = np.repeat(np.arange(len(n)), per)
    nth = np.arange(total) - np.repeat(np.cumsum(per) - per, per)
    first = at[chain] + nth * block
    size = np.minimum(block, at[chain + 1] - first)
    # longest first: the blocks with a t-th token are then the first ones
    by = np.argsort(-size, kind="stable")
    head = first[by]
    active = np.searchsorted(-size[by], -np.arange(block), side="left")
    score = move[None, :, :] + e[head][:, None, :]      # block x entry x label
    back = np.zeros((len(e), 4, 3), np.int8)
    for t in range(1, int(size.max())):
        m = active[t]
        i = head[:m] + t
        via = [score[:m, :, y, None] + move[y] for y in range(3)]
        best = np.maximum(np.maximum(via[0], via[1]), via[2])
        back[i] = np.where(via[0] == best, 0, np.where(via[1] == best, 1, 2))
        score[:m] = best + e[i][:, None, :]
    place = np.empty(total, np.int64)
    place[by] = np.arange(total)
    # compose the blocks of each chain
    chains = np.argsort(-per, kind="stable")
    chains = chains[:int((per > 0).sum())]
    block_of = (np.cumsum(per) - per)[chains]
    left = np.searchsorted(-per[chains], -np.arange(int(per.max())), side="left")
    now = np.full((len(chains), 4), -np.inf)
    now[:, 3] = 0
    enter = np.zeros((total, 3), np.int8)
    for k, m in enumerate(left):
        b = place[block_of[:m] + k]
        via = now[:m, :, None] + score[b]
        enter[b] = via.argmax(axis=1)
        now[:m, :3], now[:m, 3] = via.max(axis=1), -np.inf
    last = now[:, :3].argmax(axis=1)
    leave, came = np.zeros(total, np.int64), np.zeros(total, np.int64)
    for k in range(len(left) - 1, -1, -1):
        m = left[k]
        b = place[block_of[:m] + k]
        leave[b] = last[:m]
        came[b] = enter[b, last[:m]]
        last[:m] = came[b]
    for t in range(int(size.max()) - 1, -1, -1):
        m = active[t]
        i = head[:m] + t
        label[i] = leave[:m]
        if t:
            leave[:m] = back[i, came[:m], leave[:m]]
    return label


def _soft(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def fit_chain(bins: np.ndarray, at: np.ndarray, truth: np.ndarray, rounds: int = 60, ridge: float = 2e-4, rate: float = 0.2) -> SecretModel:
    """Maximum conditional likelihood by gradient steps; marginals from forward-backward over all sequences at once.
    A negative bin is a feature left out."""
    size = np.diff(at)
    by = np.argsort(-size, kind="stable")
    by = by[:int((size > 0).sum())]
    head, size = at[by], size[by]
    active = np.searchsorted(-size, -np.arange(int(size.max())), side="left")
    n, width = len(truth), FIRST[-1]
    known = bins >= 0
    flat = np.where(known, bins, width)
    y = truth.astype(np.int64)
    inner = np.ones(n, bool)
    inner[head] = False
    inner = np.flatnonzero(inner)
    goal = np.zeros((4, 3))
    np.add.at(goal, (y[inner - 1], y[inner]), 1)
    np.add.at(goal, (np.full(len(head), 3), y[head]), 1)
    one = np.eye(3)[y]
    w, move = np.zeros((width + 1, 3)), np.zeros((4, 3))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(move), np.zeros_like(move)]
    for step in range(1, rounds + 1):
        e = np.zeros((n, 3))
        for f in range(flat.shape[1]):
            e += w[flat[:, f]]
        free = _allowed(move)
        a, b = np.zeros((n, 3)), np.zeros((n, 3))
        for t, m in enumerate(active):
            i = head[:m] + t
            a[i] = e[i] + (_soft(a[i - 1][:, :, None] + free[:3], 1) if t else free[3])
        for t in range(len(active) - 1, 0, -1):
            i = head[:active[t]] + t
            b[i - 1] = _soft(free[:3] + (e[i] + b[i])[:, None, :], 2)
        z = np.zeros(n)
        z[A.ragged(head, size)] = np.repeat(_soft(a[head + size - 1], 1), size)
        marginal = np.exp(a + b - z[:, None])
        got = np.zeros((4, 3))
        got[3] = marginal[head].sum(axis=0)
        got[:3] = np.exp(a[inner - 1][:, :, None] + free[:3] + (e[inner] + b[inner])[:, None, :] - z[inner][:, None, None]).sum(axis=0)
        gap = one - marginal
        grad = np.stack([np.bincount(flat.ravel(), np.repeat(gap[:, k], flat.shape[1]), width + 1) for k in range(3)], axis=1)
        grad[width] = 0
        for p, g, (s1, s2) in ((w, grad, state[:2]), (move, goal - got, state[2:])):
            g = g / n - ridge * p
            s1 *= 0.9
            s1 += 0.1 * g
            s2 *= 0.99
            s2 += 0.01 * g**2
            p += rate * (s1 / (1 - 0.9**step)) / (np.sqrt(s2 / (1 - 0.99**step)) + 1e-9)
    return SecretModel(w[:width].copy(), _allowed(move))


def truth_of(buf: np.ndarray, off: np.ndarray, tokens: Tokens) -> np.ndarray:
    """Weak labels: the tokens of the secret part of each base match."""
    raw = buf.tobytes()
    y = np.zeros(len(tokens.start), np.int8)
    parts = sorted(_secret_part(raw, s, k, e) for _, s, k, e in base_spans(buf, off))
    done = 0
    for s, e in parts:
        i, j = int(np.searchsorted(tokens.end, s, side="right")), int(np.searchsorted(tokens.start, e))
        if i < j and i >= done:  # of overlapping matches the first one labels
            y[i:j] = INSIDE
            y[i] = BEGIN
            done = j
    return y


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 600, sample_tokens: int = 96) -> SecretModel:
    """Fit on at most ``sample_docs`` documents and ``sample_tokens`` tokens of each."""
    ids = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    order = [F.xxhash64("_id"), F.col("_id")]
    half = [part.select("_id").distinct().orderBy(*order).limit(sample_docs // 2) for part in (ids.where(F.col("_text").rlike(LIKELY)), ids)]
    sample = half[0].unionByName(half[1]).distinct()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = A.utf8(batch.column(0))
            for _, _, b, o in A.chunks(buf, off):
                tokens = read_tokens(b, o)
                y = truth_of(b, o, tokens)
                out = []
                for s, e in zip(tokens.at.tolist(), tokens.at[1:].tolist()):
                    hit = np.flatnonzero(y[s:e])
                    s = max(s, min(s + (int(hit[0]) if len(hit) else 0) - sample_tokens // 2, e - sample_tokens))
                    e = min(e, s + sample_tokens)
                    own = y[s:e].copy()
                    if len(own) and own[0] == INSIDE:
                        own[0] = BEGIN
                    out.append((tokens.bins[s:e].astype(np.int16).tobytes(), own.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["bins", "truth"])

    # sorted: sums of gradients then run in the same order on any partitioning; repeated ids are cut to the bound
    rows = ids.join(F.broadcast(sample), "_id").select("_text").mapInArrow(features, "bins binary, truth binary")
    got = sorted((r.bins, r.truth) for r in rows.limit(sample_docs).collect())
    bins = [np.frombuffer(b, np.int16).reshape(-1, len(NAMES)).astype(np.int64) for b, _ in got]
    truth = [np.frombuffer(t, np.int8) for _, t in got]
    pairs = [(b, t) for b, t in zip(bins, truth) if len(t)]
    if not any(t.any() for _, t in pairs):
        return SecretModel.neutral()
    around = [NAMES.index(c) for c in NEIGHBOURS]
    for b, t in list(pairs):
        if t.any():
            alone = b.copy()
            alone[:, around] = -1
            pairs.append((alone, t))
    return fit_chain(np.concatenate([b for b, _ in pairs]), A.bounds(np.array([len(t) for _, t in pairs])), np.concatenate([t for _, t in pairs]))


def scan_chunk(model: SecretModel, buf: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
    """``(document, start, kind, end)`` of all spans of a chunk in bytes, sorted; kind ``len(BASE)`` is added by the chain."""
    found = base_spans(buf, off)
    tokens = read_tokens(buf, off)
    label = viterbi(emissions(model, tokens.bins), tokens.at, model.move)
    first = np.flatnonzero(label == BEGIN)
    if not len(first):
        return found
    after = np.append(label, OUTSIDE)
    stops = np.flatnonzero(after != INSIDE)
    last = stops[np.searchsorted(stops, first + 1)] - 1
    doc = np.searchsorted(tokens.at, first, side="right") - 1
    base_start = np.array([x[1] for x in found], np.int64)
    top = np.maximum.accumulate(np.array([x[3] for x in found], np.int64)) if found else base_start
    s, e = tokens.start[first], tokens.end[last]
    # base spans stay; a span that meets one is not added (base spans are sorted, so the greatest end before a place tells)
    before = np.searchsorted(base_start, e)
    free = (before == 0) | (np.append(top, 0)[before - 1] <= s)
    return sorted(found + [(int(d), int(a), len(BASE), int(b)) for d, a, b in zip(doc[free], s[free], e[free])])


def _scanned(model: SecretModel, column: pa.Array) -> Iterator[tuple[int, int, list[list[tuple[int, int, int]]], np.ndarray, np.ndarray]]:
    """``(first row, end row, spans of each row in code points, bytes, offsets)`` by chunks of a text column."""
    buf, off = A.utf8(column)
    for i, j, b, o in A.chunks(buf, off):
        points = np.zeros(len(b) + 1, np.int64)
        np.cumsum((b & 0xC0) != 0x80, out=points[1:])
        rows: list[list] = [[] for _ in range(j - i)]
        for d, s, kind, e in scan_chunk(model, b, o):
            base = points[o[d]]
            rows[d].append((int(points[s] - base), kind, int(points[e] - base)))
        yield i, j, rows, b, o


def scan(docs: DataFrame, model: SecretModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, found`` of every row of ``docs``: all spans as ``(kind, start, end)``, by start, then by kind (base kinds first)."""
    names = [*KINDS, ADDED]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, rows, _, _ in _scanned(model, batch.column(1)):
                own = [[{"kind": names[k], "start": s, "end": e} for s, k, e in r] for r in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(own, pa.list_(span))], [id_col, "found"])

    batch_bytes(docs.sparkSession)
    out = schema({id_col: docs.schema[id_col].dataType}, "found array<struct<kind: string, start: long, end: long>>")
    return docs.select(id_col, text_col).mapInArrow(find, out)


def redacted(docs: DataFrame, model: SecretModel, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets (overlapping spans by the first one's); a null text stays null."""
    names = [*KINDS, ADDED]
    place, columns = docs.columns.index(text_col), docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for i, _, rows, _, _ in _scanned(model, batch.column(place)):
                for k, spans in enumerate(rows, i):
                    if not spans:
                        continue
                    out, done = [], 0
                    for s, kind, e in spans:
                        if s >= done:
                            out += [texts[k][done:s], f"[{names[kind]}]"]
                        done = max(done, e)
                    texts[k] = "".join(out) + texts[k][done:]
            own = [batch.column(c) for c in range(len(columns))]
            own[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(own, columns)

    batch_bytes(docs.sparkSession)
    return docs.mapInArrow(clean, docs.schema)


def report(docs: DataFrame, model: SecretModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_assign, n_access, n_hex, base_sha256, spans`` and ``n_added`` of every row of ``docs``."""
    def joined(of: str) -> Column:
        return F.expr(f"array_join(transform({of}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")

    def count(kind: str) -> Column:
        return F.expr(f"cast(size(filter(found, s -> s.kind = '{kind}')) as bigint)")

    base = f"filter(found, s -> s.kind != '{ADDED}')"
    return scan(docs, model, id_col, text_col).select(id_col, *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"),
                                                      joined("found").alias("spans"), count(ADDED).alias("n_added"))
