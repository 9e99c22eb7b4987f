"""Suffix-array dedup of repeated byte strings, by bucket-pointer refinement.

Every byte of a document that a ``length``-byte string covers goes, if the
string also starts in a document with a smaller id.

Sorting the suffixes of a whole corpus would shuffle each byte many times, so
the suffixes are first dealt to buckets that can hold equal ones:

0. *Copies.*  A text equal to that of a smaller document is a repeat throughout;
   it is known by its hash and takes no part in what follows.
1. *Anchors.*  Of the ``GRAM``-byte strings inside a window of ``length`` bytes the
   one with the least hash is its anchor (the leftmost, of equals).  Equal
   windows have equal anchors at equal places, and one position in fifteen is
   an anchor.  Anchors are shuffled by the first bits of their hash, seven more
   than it takes to number them; those that only one document has are done with.
2. *Suffix sorting.*  The windows of each remaining anchor (a *block* of bytes
   around it) are dealt by the anchor's hash.  Within a task the suffixes at
   the windows' starts are sorted by bucket-pointer refinement: the initial
   buckets are the q-gram codes, and a bucket is refined by sorting on the
   bucket identifiers of its suffixes at later offsets, until ``length`` bytes
   are told apart; buckets of one suffix leave early.
3. In each final bucket the windows of all but the smallest document are
   removed; their spans go back to the documents.

An anchor that very many documents share costs a task one shuffled row and one
block of each kind for a run of documents, not one for each document: copies
met within the run are known to be repeats there.  Texts are shuffled once,
compressed (the exchange is shared by steps 1, 2 and 3).

Defined results: a null text is empty; texts shorter than ``length`` bytes lose
nothing; rows with one id are one document (equal strings in them remove
nothing from each other); a null id is never smaller than another and loses
nothing; an empty table gives no rows.  Strings are known by 64-bit codes,
whole texts by 96 bits and the length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revel.llm import arrays as A
from revel.llm.jobs import text_bytes

LENGTH, GRAM = 50, 20
#: bytes of text whose anchors are compared before they are shuffled
RUN_BYTES = 16 << 20
#: blocks that are suffix-sorted at once (more only if one anchor has more)
SORT_BLOCKS = 60_000
#: blocks of an output batch
SENT_BLOCKS = 50_000
SALTS = 1021


def _slide(x: np.ndarray, width: int, least) -> np.ndarray:
    """``least`` over each ``width`` consecutive values."""
    n, k, y = len(x) - width + 1, 1, x
    while 2 * k <= width:
        y = least(y[:-k], y[k:])
        k *= 2
    return least(y[:n], y[width - k:width - k + n])


def anchors(buf: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(place, hash, first, end)``: anchors in order of place, and the window starts ``first .. end-1`` of each."""
    none = np.zeros(0, np.int64)
    inner = length - GRAM + 1
    if len(buf) < length:
        return none, none.astype(A.U64), none, none
    at = np.arange(len(buf) - GRAM + 1)
    h = A.slice_hash(A.prefix_hash(buf), at, at + GRAM)
    low = _slide(h, inner, np.minimum)
    starts = A.ragged(off[:-1], np.maximum(np.diff(off) - length + 1, 0))
    if not len(starts):
        return none, none.astype(A.U64), none, none
    # the leftmost place of the least hash of each window: the next place where it is not less than the window's
    least = low[starts]
    valid = np.zeros(len(low) + 2 * (inner - 1), A.U64)
    valid[starts + inner - 1] = least
    place = np.flatnonzero(_slide(valid, inner, np.maximum) == h)
    own = np.searchsorted(place, starts)
    open_ = np.flatnonzero(h[place[own]] != least)
    while len(open_):
        own[open_] += 1
        open_ = open_[h[place[own[open_]]] != least[open_]]
    # windows of one anchor stand together; equal hashes in one window may leave gaps, which split the run
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    first = starts[head]
    return place[own[head]], h[place[own[head]]], first, first + np.diff(head, append=len(own))


def _runs(buf: np.ndarray, off: np.ndarray, ids: np.ndarray, length: int):
    """Anchors of a batch: ``(row, hash, first, end)`` by chunk, rows as numbers in the batch."""
    for i, _, b, o in A.chunks(buf, off):
        place, h, first, end = anchors(b, o, length)
        row = np.searchsorted(o, first, side="right") - 1
        yield i + row, h, first + off[i], end + off[i]


def hash_bits(text_bytes: int) -> int:
    """Bits by which anchors are compared: one in about a hundred is then taken
    for shared by chance, which costs work, not correctness."""
    return min(63, max(16, (text_bytes // 16).bit_length() + 7))


def shared_anchors(docs: DataFrame, length: int, bits: int) -> DataFrame:
    """``id, grams``: the anchor hashes (first bits) of each document that another document has too."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            buf, off = unpacked(batch.column(1))
            for row, h, first, _ in _runs(buf, off, ids, length):
                held.append(((h >> A.U64(64 - bits)).view(np.int64), ids[row]))
                size += len(h)
                if size * 16 >= RUN_BYTES:
                    yield from compared(held)
                    held, size = [], 0
        yield from compared(held)

    def compared(held):
        if not held:
            return
        h, doc = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        one = A.distinct(h) | A.distinct(doc)
        h, doc = h[one], doc[one]
        first = np.flatnonzero(A.distinct(h))
        several = np.repeat(np.diff(first, append=len(h)) > 1, np.diff(first, append=len(h)))
        salt = np.where(several, 1 + doc % SALTS, 0).astype(np.int16)
        # one mark stands for all documents of the run that share an anchor
        mark = first[several[first]]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h, h[mark]])), pa.array(np.concatenate([salt, np.full(len(mark), -1, np.int16)])),
                                          pa.array(np.concatenate([doc, doc[mark]]))], ["gram", "salt", "id"])

    # null ids are left out in the task: a filter here would keep Spark from sharing the exchange of the texts
    rows = docs.mapInArrow(emit, "gram long, salt short, id long")
    rows = rows.withColumn("part", F.greatest("salt", F.lit(0).cast("short")))
    group = Window.partitionBy("gram", "part")
    rows = rows.withColumns({"a": F.min("id").over(group), "b": F.max("id").over(group), "m": F.min("salt").over(group)})
    found = rows.where("salt > 0 or (salt = 0 and (a != b or m < 0))")
    return found.groupBy("id").agg(F.collect_list("gram").alias("grams"))


def packed(docs: DataFrame) -> DataFrame:
    """``id, text`` with the text compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(3)
        for batch in batches:
            buf, off = A.utf8(batch.column(1))
            raw = buf.tobytes()
            texts = [zip_.compress(raw[a:b]) if b > a else None for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["id", "text"])

    return docs.mapInArrow(run, "id long, text binary")


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of compressed texts."""
    unzip = zstandard.ZstdDecompressor()
    texts = [unzip.decompress(x) if x else b"" for x in column.to_pylist()]
    return np.frombuffer(b"".join(texts), np.uint8), A.bounds(np.array([len(x) for x in texts], np.int64))


def blocks(texts: DataFrame, length: int, bits: int) -> DataFrame:
    """``gram, id, start, windows, block`` of the shared anchors (rows ``id, text, grams``).

    Within a run of documents the copies of a block of a smaller document are
    settled: they have no block and are dealt by their document."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.compute.fill_null(batch.column(0), 0).to_numpy()
            buf, off = unpacked(batch.column(1))
            lists = batch.column(2)
            grams, at = lists.flatten().to_numpy().view(A.U64), A.bounds(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0), np.int64))
            found = [wanted(b, o, off[i], i, grams[at[i]:at[j]], np.diff(at[i:j + 1])) for i, j, b, o in A.chunks(buf, off) if at[j] > at[i]]
            if not found:
                continue
            row, h, first, windows, code = (np.concatenate(x) for x in zip(*found))
            doc = ids[row]
            order = np.lexsort((doc, code))
            new = np.flatnonzero(A.distinct(code[order]))
            copy = np.zeros(len(h), bool)
            copy[order] = doc[order] > np.repeat(doc[order][new], np.diff(new, append=len(order)))
            size = np.where(copy, 0, windows + length - 1)
            gram = np.where(copy, A.mix(doc.astype(A.U64)) >> A.U64(64 - bits), h).view(np.int64)
            for k in range(0, len(h), SENT_BLOCKS):
                e = slice(k, k + SENT_BLOCKS)
                raw = pa.py_buffer(np.ascontiguousarray(buf[A.ragged(first[e], size[e])]))
                binary = pa.Array.from_buffers(pa.binary(), len(h[e]), [None, pa.py_buffer(A.bounds(size[e]).astype(np.int32)), raw])
                yield pa.RecordBatch.from_arrays([pa.array(gram[e]), pa.array(doc[e]), pa.array((first - off[row])[e].astype(np.int32)),
                                                  pa.array(windows[e].astype(np.int32)), binary], names)

    def wanted(b, o, base, i, grams, each):
        """Row, hash, first window, windows and content code of the anchors asked for in a chunk."""
        _, h, first, end = anchors(b, o, length)
        h = h >> A.U64(64 - bits)
        row = np.searchsorted(o, first, side="right") - 1
        ask = A.uniq(A.mix(grams ^ A.mix(np.repeat(np.arange(len(each)), each).astype(A.U64) + A.U64(1))))
        own = A.mix(h ^ A.mix(row.astype(A.U64) + A.U64(1)))
        hit = ask[np.minimum(np.searchsorted(ask, own), len(ask) - 1)] == own
        h, first, end, row = h[hit], first[hit], end[hit], row[hit]
        code = A.slice_hash(A.prefix_hash(b), first, end + length - 1)
        return i + row, h, base + first, end - first, code

    names = ["gram", "id", "start", "windows", "block"]
    return texts.mapInArrow(emit, "gram long, id long, start int, windows int, block binary")


def refined(code: np.ndarray, at: np.ndarray, offsets: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Suffix sort to a fixed depth by bucket-pointer refinement.

    ``code`` is the q-gram bucket of every place; the suffixes at ``at`` are
    sorted on the bucket at their place, then each bucket on those at later
    ``offsets``.  Returns the numbers of the suffixes that share their final
    bucket with another, in bucket order, and the bucket heads."""
    live = np.arange(len(at))
    bucket = code[at]
    for step in [0, *offsets]:
        if step:
            bucket = A.mix(bucket * A.U64(0x9FB21C651E98DF25) + code[at[live] + step])
        order = np.argsort(bucket, kind="stable")
        live, bucket = live[order], bucket[order]
        head = np.flatnonzero(A.distinct(bucket))
        size = np.diff(head, append=len(bucket))
        more = np.repeat(size > 1, size)
        live, bucket = live[more], bucket[more]
    return live, np.flatnonzero(A.distinct(bucket)) if len(bucket) else np.zeros(0, np.int64)


def repeated_windows(doc: np.ndarray, windows: np.ndarray, buf: np.ndarray, off: np.ndarray, length: int) -> np.ndarray:
    """Mask over all windows of the blocks (one block after another): a smaller document has it too."""
    out = np.zeros(int(windows.sum()), bool)
    if not len(buf):
        return out
    where = np.arange(len(buf) - GRAM + 1)
    code = A.slice_hash(A.prefix_hash(buf), where, where + GRAM)
    at = A.ragged(off[:-1], windows)
    offsets = [*range(GRAM, length - GRAM, GRAM), length - GRAM]
    live, head = refined(code, at, offsets)
    if len(live):
        owner = np.repeat(doc, windows)[live]
        least = np.repeat(np.minimum.reduceat(owner, head), np.diff(head, append=len(live)))
        out[live] = owner > least
    return out


def copies(docs: DataFrame) -> DataFrame:
    """``id, n_bytes`` of documents whose text a smaller one has too (of ids with one text)."""
    keyed = docs.where("id is not null and text is not null").select("id", F.xxhash64("text").alias("h"), F.hash("text").alias("g"),
                                                                          F.octet_length("text").alias("n"))
    key = ["h", "g", "n"]
    first = keyed.groupBy(*key).agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first != last")
    one = keyed.groupBy("id").agg(*(F.min(c).alias(c) for c in key), F.max("h").alias("h2"), F.max("g").alias("g2"), F.max("n").alias("n2"))
    one = one.where("h = h2 and g = g2 and n = n2")
    return one.join(first, key).where("id > first").select("id", F.col("n").cast("long").alias("n_bytes"))


def repeated_spans(found: DataFrame, length: int) -> DataFrame:
    """``id, span``: byte spans to remove, each packed as ``start << 32 | size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            if held.num_rows >= SORT_BLOCKS:
                # blocks of the last anchor may go on in the next batch
                gram = held.column(0).to_numpy()
                cut = int(np.searchsorted(gram, gram[-1]))
                if cut:
                    yield spans(held.slice(0, cut))
                    held = pa.concat_batches([held.slice(cut)])
        if held is not None and held.num_rows:
            yield spans(held)

    def spans(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, start, windows = (batch.column(k).to_numpy() for k in (1, 2, 3))
        buf, off = A.utf8(batch.column(4))
        done = np.diff(off) == 0
        open_ = ~done
        gone = np.ones(int(windows.sum()), bool)
        gone[np.repeat(open_, windows)] = repeated_windows(doc[open_], windows[open_], buf, np.append(off[:-1][open_], len(buf)), length)
        at = A.bounds(windows)
        a, e = A.spans(gone, at)
        row = np.searchsorted(at, a, side="right") - 1
        first = start[row] + (a - at[row])
        return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array((first << 32) | (e - a + length - 1))], ["id", "span"])

    return found.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "id long, span long")


def removed(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, spans`` of every row, texts compressed; spans may overlap."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bits, texts = hash_bits(text_bytes(docs, "text")), packed(docs)
    again = copies(docs)
    grams = shared_anchors(texts.join(again, "id", "left_anti"), length, bits)
    wanted = texts.join(grams, "id", "left").select("id", "text", "grams")
    spans = repeated_spans(blocks(wanted, length, bits), length)
    spans = spans.unionByName(again.where(F.col("n_bytes") >= length).select("id", F.col("n_bytes").alias("span")))
    return texts.join(spans.groupBy("id").agg(F.collect_list("span").alias("spans")), "id", "left").select("id", "text", "spans")


def dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, the remaining bytes) of every row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = unpacked(batch.column(1))
            out: list[list] = [[] for _ in names[1:]]
            lists = batch.column(2)
            spans, at = lists.flatten().to_numpy(), A.bounds(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0), np.int64))
            for k in range(batch.num_rows):
                own = buf[off[k]:off[k + 1]]
                n, gone, runs = len(own), 0, 0
                if at[k + 1] > at[k]:
                    s = spans[at[k]:at[k + 1]]
                    mark = np.zeros(n + 1, np.int32)
                    np.add.at(mark, s >> 32, 1)
                    np.subtract.at(mark, (s >> 32) + (s & 0xFFFFFFFF), 1)
                    hit = np.cumsum(mark[:-1]) > 0
                    gone, runs = int(hit.sum()), int(hit[0]) + int((hit[1:] & ~hit[:-1]).sum())
                    own = own[~hit]
                raw = own.tobytes()
                for c, v in zip(out, (n, gone, runs, hashlib.sha256(raw).hexdigest(), raw)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, types))], names)

    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    out_schema = f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return removed(docs, length, id_col, text_col).mapInArrow(cut, out_schema)


#: The 50-byte strings of a text are hex strings of its bytes here.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 100)) AS s FROM d, (SELECT unnest(range(greatest(n - 49, 0))) AS p) u),
f AS (SELECT s, min(doc_id) AS a FROM w GROUP BY s HAVING count(*) > 1),
g AS (SELECT w.doc_id, w.p, lag(w.p) OVER (PARTITION BY w.doc_id ORDER BY w.p) AS q FROM w JOIN f ON w.s = f.s WHERE f.a < w.doc_id),
h AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM g),
r AS (SELECT doc_id, r, min(p) AS a, max(p) + 50 AS e FROM h GROUP BY doc_id, r),
k AS (SELECT doc_id, count(*) AS n_spans, sum(e - a) AS n_removed, list(a ORDER BY a) AS starts, list(e ORDER BY a) AS ends FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(k.n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN k.doc_id IS NULL THEN d.x ELSE array_to_string(list_transform(range(0, len(k.starts) + 1), lambda i:
         substr(d.x, 2 * (CASE WHEN i = 0 THEN 0 ELSE k.ends[i] END) + 1,
                2 * ((CASE WHEN i = len(k.starts) THEN d.n ELSE k.starts[i + 1] END) - (CASE WHEN i = 0 THEN 0 ELSE k.ends[i] END)))), '') END)) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
