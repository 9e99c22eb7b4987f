"""Vocabulary and token-id operators (replaces the pretrained WordPiece
vocabulary, which is a per-row library the reference downloads).

Token ids: 0 PAD, 1 UNK, 2 START, 3 END, then the vocabulary by descending
frequency (ties by token).  The vocabulary is bounded by its size parameter, so
the driver reads it once and ships it with the task: text -> ids and back are
Arrow lookups over whole batches of tokens in one narrow stage, without a
shuffle of rows or tokens.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revel.functions.text import tokens as token_expr

# Reserved ids.
PAD, UNK, START, END = 0, 1, 2, 3
N_SPECIAL = 4


def build_vocab(df: DataFrame, text_cols: list[str], size: int, counted: bool = False) -> DataFrame:
    """``token, cnt, id``: the ``size - 4`` most frequent tokens, ids from 4.

    Counting is a partial aggregation; the top-k keeps ``k`` rows per task,
    so only ``k`` rows per task reach the final merge (k is a parameter).
    ``counted=True`` takes the rows of :func:`heads` that count the tokens of ``text_cols``."""
    if counted:
        toks = df.where(F.col("_of").isin(text_cols)).select(F.col("_token").alias("token"), F.col("_cnt").alias("n"))
    else:
        all_tokens = F.concat(*[token_expr(c) for c in text_cols]) if len(text_cols) > 1 else token_expr(text_cols[0])
        toks = df.select(F.explode(all_tokens).alias("token"), F.lit(1).alias("n"))
    counts = toks.groupBy("token").agg(F.sum("n").alias("cnt"))
    top = counts.orderBy(F.desc("cnt"), F.asc("token")).limit(size - N_SPECIAL)
    w = Window.orderBy(F.desc("cnt"), F.asc("token"))  # over at most `size` rows
    return top.select("token", "cnt", (F.row_number().over(w) + (N_SPECIAL - 1)).cast("long").alias("id"))


#: different tokens that a task counts before it hands their counts on
KEPT_TOKENS = 200_000


def heads(df: DataFrame, texts: dict[str, int]) -> DataFrame:
    """``df`` with each column of ``texts`` as the array of its first tokens (as many as the number says), and beside these rows
    counts of *all* tokens of those columns, a few a task: ``_of, _token, _cnt``, null in the others.  Each text is
    read and cut into tokens once, and a caller who writes the result writes no whole texts."""
    rows = df.select(*[(token_expr(c) if c in texts else F.col(c)).alias(c) for c in df.columns])
    place = {c: rows.columns.index(c) for c in texts}
    shape = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields]
                         + [T.StructField("_of", T.StringType()), T.StructField("_token", T.StringType()), T.StructField("_cnt", T.LongType())])

    def run(batches):
        counts: dict[str, dict[str, int]] = {c: {} for c in texts}
        names, kinds = shape.names, None

        def counted(c: str) -> pa.RecordBatch:
            own, counts[c] = counts[c], {}
            of, token, n = pa.array([c] * len(own), pa.string()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(own), k) for k in kinds), of, token, n], names)

        for batch in batches:
            columns = list(batch.columns)
            for c, at in place.items():
                own = counts[c]
                tokens, n = pa.compute.list_flatten(columns[at]).value_counts().flatten()
                for token, k in zip(tokens.to_pylist(), n.to_pylist()):
                    own[token] = own.get(token, 0) + k
                columns[at] = pa.compute.list_slice(columns[at], 0, texts[c])
            kinds = [x.type for x in columns]
            none = [pa.nulls(batch.num_rows, k) for k in (pa.string(), pa.string(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *none], names)
            for c in texts:
                if len(counts[c]) > KEPT_TOKENS:
                    yield counted(c)
        for c in texts:
            if counts[c]:
                yield counted(c)

    return rows.mapInArrow(run, shape)


def narrow_ids(ids, size: int) -> Column:
    """Ids under ``size`` as bytes, two or four an id: they cross a shuffle in a fraction of an array of longs."""
    kind = np.uint16 if size <= 1 << 16 else np.uint32

    @F.arrow_udf(T.BinaryType())
    def to_bytes(lists: pa.Array) -> pa.Array:
        values, sizes = _flat(lists)
        raw = values.to_numpy(zero_copy_only=False).astype(kind)
        at = np.concatenate([[0], np.cumsum(sizes * raw.itemsize)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(raw)])

    return to_bytes(ids)


def wide_ids(narrow, size: int, length: int) -> Column:
    """The ids of :func:`narrow_ids`, padded to ``length``."""
    kind = np.uint16 if size <= 1 << 16 else np.uint32

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def to_lists(packed: pa.Array) -> pa.Array:
        out = np.full((len(packed), length), PAD, np.int64)
        for row, raw in zip(out, packed.to_pylist()):
            own = np.frombuffer(raw, kind)
            row[:len(own)] = own
        return _lists(pa.array(out.ravel()), np.arange(0, out.size + 1, length))

    return to_lists(narrow)


def _lists(values: pa.Array, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``(values, sizes)`` of a list array; a null list has no values."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0)
    return pa.compute.list_flatten(lists), sizes.to_numpy(zero_copy_only=False).astype(np.int64)


def _rows_of(vocab: DataFrame) -> tuple[list[str], list[int]]:
    """Tokens and ids; as many as the vocabulary's size parameter allows."""
    rows = vocab.select("id", "token").orderBy("id").collect()
    return [r.token for r in rows], [r.id for r in rows]


def encode(df: DataFrame, key: str, text_col: str, vocab: DataFrame, max_length: int, out: str = "ids",
           pad: bool = True, oov: str = "unk", vocab_size: int | None = None) -> DataFrame:
    """Text -> ``[START] tokens[:max_length-2] [END]`` ids, padded with 0 to ``max_length``.

    Unknown tokens map to UNK (``oov='unk'``), or with ``oov='clamp'`` to the
    last id ``vocab_size - 1`` -- the reference's clamping, where out-of-range
    ids collide on one id.  ``text_col`` may also be an array of tokens (:func:`heads`).
    """
    if oov not in ("unk", "clamp") or (oov == "clamp" and not vocab_size):
        raise ValueError("oov must be 'unk', or 'clamp' with vocab_size")
    unknown = UNK if oov == "unk" else vocab_size - 1
    known, ids = _rows_of(vocab)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def to_ids(tokens: pa.Array) -> pa.Array:
        values, sizes = _flat(tokens)
        place = pa.compute.index_in(values, value_set=pa.array(known, pa.string()))
        found = pa.array(ids, pa.int64()).take(place).fill_null(unknown).to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(np.full(len(sizes), max_length) if pad else sizes + 2)])
        out = np.full(at[-1], PAD, np.int64)
        out[at[:-1]] = START
        out[at[:-1] + sizes + 1] = END
        inner = np.arange(len(found)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(at[:-1], sizes) + 1 + inner] = found
        return _lists(pa.array(out), at)

    words = F.col(text_col) if isinstance(df.schema[text_col].dataType, T.ArrayType) else token_expr(text_col)
    return df.withColumn(out, to_ids(F.slice(words, 1, max_length - 2)))


def clamp(ids, vocab_size: int) -> Column:
    """Clamp ids into [0, vocab_size - 1] (the reference's out-of-range rule)."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.transform(c, lambda x: F.least(F.greatest(x, F.lit(0)), F.lit(vocab_size - 1)))


def decode(df: DataFrame, key: str, ids_col: str, vocab: DataFrame, out: str = "text") -> DataFrame:
    """Ids -> text: special and unknown ids dropped, tokens joined by one blank."""
    known, place = _rows_of(vocab)

    @F.arrow_udf(T.StringType())
    def to_text(lists: pa.Array) -> pa.Array:
        values, sizes = _flat(lists)
        words = pa.array(known, pa.string()).take(pa.compute.index_in(values.cast(pa.int64()), value_set=pa.array(place, pa.int64())))
        here = np.asarray(words.is_valid())
        row = np.repeat(np.arange(len(sizes)), sizes)[here]
        at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))])
        return pa.compute.binary_join(_lists(words.filter(pa.array(here)), at), " ")

    return df.withColumn(out, to_text(ids_col))


def shift(ids) -> tuple[Column, Column]:
    """Teacher forcing: (input = all but last, target = all but first)."""
    c = F.col(ids) if isinstance(ids, str) else ids
    n = F.size(c)
    return F.slice(c, 1, n - 1), F.slice(c, 2, n - 1)


def non_pad_length(ids) -> Column:
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.size(F.filter(c, lambda x: x != PAD))


def ids_text(ids) -> Column:
    """Ids as a blank-separated string (for reports and comparisons)."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.array_join(c.cast("array<string>"), " ")


# Ship the lookups by value, as the metric functions are: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
