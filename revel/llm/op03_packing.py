"""Pattern packing of token sequences by non-negative least squares.

The work on lengths uses their histogram alone, whose size is bounded by the
sequence length, however many pieces there are:

1. lengths fall in ``BINS`` bins; *patterns* of up to ``PARTS`` bins that fill
   a sequence exactly are enumerated;
2. non-negative least squares finds how often each pattern is to be repeated
   for the patterns together to use up the histogram; counts are rounded down;
3. each pattern takes the longest lengths left in its bins; what stays over is
   packed by best fit, longest first, into the room left or new sequences.

Sequences with equal contents form one group (a count and a first sequence
id), so the plan is a short table: the pieces of a length with ranks ``from``
to ``to`` go to sequences ``first`` and on, at ``offset``.

Spark counts the histogram, ranks the pieces of each length, and looks the
ranks up.  Ranks are counted in buckets of hashed ids, so that pieces of one
length are never together in a task.

Defined results: a null or empty text is one piece with the end id; repeated
rows are pieces of their own; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revel.llm import arrays as A
from revel.llm import tokens
from revel.llm.jobs import batch_bytes, lean, partitions, schema, written

BINS, PARTS, ROUNDS = 64, 4, 400
#: pieces that a bucket of the ranking holds, about
BUCKET_ROWS = 500_000
#: bytes of texts that a task encodes at once
ENCODED_BYTES = 512 << 10


def patterns(bins: int, parts: int) -> np.ndarray:
    """One row a pattern: how many pieces it takes from bin 1 .. ``bins``
    (a piece of bin b is at most b/bins of a sequence long)."""
    found = []

    def extend(chosen: list[int], left: int, most: int) -> None:
        if left == 0:
            found.append(np.bincount(chosen, minlength=bins + 1)[1:])
        elif len(chosen) < parts:
            for b in range(min(most, left), math.ceil(left / (parts - len(chosen))) - 1, -1):
                extend([*chosen, b], left - b, b)

    extend([], bins, bins)
    return np.array(found)


def nnls(a: np.ndarray, h: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 with a least squared difference of ``a.T @ x`` from ``h``, by accelerated projected gradient steps."""
    a = a.astype(np.float64)
    scale = max(1.0, float(h.max(initial=0)))
    goal, x = h / scale, np.zeros(len(a))
    step, y, t = 1.0 / np.linalg.norm(a, 2) ** 2, x, 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * (a @ (a.T @ y - goal)))
        t, old = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        y, x = new + (old - 1) / t * (new - x), new
    return x * scale


def plan(histogram: dict[int, int], most: int) -> list[tuple[int, int, int, int, int]]:
    """``(length, first_rank, count, first_sequence, offset)`` rows for pieces of the given lengths."""
    left = {n: c for n, c in histogram.items() if c > 0}
    taken = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    n_sequences = 0

    def place(length: int, count: int, first: int, offset: int) -> None:
        rows.append((length, taken[length], count, first, offset))
        taken[length] += count
        left[length] -= count

    # patterns, as often as rounding down and the lengths left allow
    width = most / BINS
    in_bin: dict[int, list[int]] = {}
    for n in sorted(left):
        in_bin.setdefault(math.ceil(n / width), []).append(n)
    held = np.array([sum(left[n] for n in in_bin.get(b, [])) for b in range(1, BINS + 1)], np.float64)
    shapes = patterns(BINS, PARTS)
    repeats = np.floor(nnls(shapes, held) + 1e-6).astype(np.int64)
    room: dict[int, list[tuple[int, int]]] = {}  # tokens left in a sequence -> (first sequence, count)
    for j in np.argsort(-repeats, kind="stable"):
        need = shapes[j]
        count = min([int(repeats[j]), *(int(held[b]) // int(need[b]) for b in np.flatnonzero(need))])
        if count <= 0:
            continue
        groups = [(n_sequences, count, 0)]
        n_sequences += count
        for b in itertools.chain.from_iterable([b] * int(need[b]) for b in np.flatnonzero(need)[::-1]):
            held[b] -= count
            filled = []
            for first, size, used in groups:
                while size:
                    length = in_bin[b + 1][-1]
                    k = min(size, left[length])
                    place(length, k, first, used)
                    filled.append((first, k, used + length))
                    first, size = first + k, size - k
                    if not left[length]:
                        in_bin[b + 1].pop()
            groups = filled
        for first, size, used in groups:
            room.setdefault(most - used, []).append((first, size))

    # the rest: best fit, longest first
    sizes = sorted(room)

    def keep(space: int, first: int, count: int) -> None:
        if space and count:
            if space not in room:
                insort(sizes, space)
            room.setdefault(space, []).append((first, count))

    for length in sorted((n for n, c in left.items() if c), reverse=True):
        while left[length]:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                space = sizes[at]
                first, size = room[space].pop()
                if not room[space]:
                    del room[space], sizes[at]
                k = min(size, left[length])
                place(length, k, first, most - space)
                keep(space, first + k, size - k)
                keep(space - length, first, k)
            else:
                each = most // length
                full, rest = divmod(left[length], each)
                for count, pieces in ((full, each), (1, rest)):
                    if count and pieces:
                        for p in range(pieces):
                            place(length, count, n_sequences, p * length)
                        keep(most - pieces * length, n_sequences, count)
                        n_sequences += count
    return rows


def pieces(docs: DataFrame, most: int, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text",
           end_id: int = tokens.END_ID, with_ids: bool = False) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` (and ``ids``): each text's tokens, cut after every ``most``."""
    tokenizer = tokenizer or tokens.default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer)
        for batch in batches:
            buf, off = A.utf8(batch.column(1))
            for i, j, b, o in A.chunks(buf, off, ENCODED_BYTES):
                ids, at = enc.encode(b, o, end_id)
                n = -(-np.diff(at) // most)
                doc = np.repeat(np.arange(j - i), n)
                piece = np.arange(len(doc)) - np.repeat(A.bounds(n)[:-1], n)
                start = piece * most
                begin = at[doc] + start
                end = np.minimum(begin + most, at[doc + 1])
                raw = ids.view(np.uint8)
                crc = [zlib.crc32(raw[4 * x:4 * y]) for x, y in zip(begin.tolist(), end.tolist())]
                out = [batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(end - begin),
                       pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)).astype(np.int32)), pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(out, out_schema.names)

    out_schema = schema({id_col: docs.schema[id_col].dataType},
                        "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)
    batch_bytes(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(lean(cut, keep_encoders=True), out_schema)


def pack(parts: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """``parts`` (``id, piece, start, length, ids_crc32``) with ``sequence_id`` and ``offset``.

    ``parts`` is read several times: it should be a table."""
    names = [id_col, "piece", "start", "length", "ids_crc32"]
    spark = parts.sparkSession
    # at most one row for each length from 1 to ``most``
    histogram = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}
    buckets = max(partitions(spark), math.ceil(sum(histogram.values()) / BUCKET_ROWS))
    rows = parts.select(*names, F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(buckets)).alias("_bucket"))
    cells = rows.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("length", "_bucket").orderBy(id_col, "piece", "ids_crc32")
    ranked = rows.withColumn("_rank", F.row_number().over(order) - 1).join(cells, ["length", "_bucket"])
    ranked = ranked.select(*names, (F.col("_rank") + F.col("_before")).alias("_rank"))

    table = np.array(sorted(plan(histogram, most)), np.int64).reshape(-1, 5)
    key = (table[:, 0] << 48) + table[:, 1]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
                at = np.searchsorted(key, (length << 48) + rank, side="right") - 1
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])],
                                                 out_schema.names)

    out_schema = schema({c: parts.schema[c].dataType for c in names}, "sequence_id long, offset long")
    return ranked.mapInArrow(lean(look_up), out_schema)


def pack_documents(docs: DataFrame, most: int = 4096, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack: one row a piece."""
    return pack(written(pieces(docs, most, tokenizer, id_col, text_col), "pieces"), most, id_col)
