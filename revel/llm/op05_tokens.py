"""Token ids as Parquet list columns.

``write`` tokenizes whole texts and writes one row per document in ascending
id order: delta-encoded numbers (id, place in the file, token count) beside a
dictionary-encoded list of token ids, in row groups and pages of set size with
page indexes.  So a reader of the numbers never touches the token pages, and a
look-up by id reads only the pages whose index covers it.

Documents are dealt by id ranges and sorted in each; a row knows its place in
its own file (``file_start``), and a file's place in the whole is the sum of
the earlier files' token counts, taken from the number columns alone.

Defined results: a null or empty text is the end id alone; rows with one id
stand together in order of their text (of equal texts in any order); rows with
a null id come first; an empty table gives files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revel.llm import arrays as A
from revel.llm import tokens
from revel.llm.jobs import schema

FORMAT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#file_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "512",
}


def write(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text",
          end_id: int = tokens.END_ID) -> None:
    """Files of ``doc_id, file, file_start, n_tokens, ids``."""
    tokenizer = tokenizer or tokens.default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, start = tokens.encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            buf, off = A.utf8(batch.column(1))
            for i, j, b, o in A.chunks(buf, off, tokens.CHUNK_BYTES):
                ids, at = enc.encode(b, o, end_id)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), pa.array(np.full(j - i, part, np.int32)), pa.array(start + at[:-1]),
                    pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view(np.int32)))], names)
                start += int(at[-1])

    names = ["doc_id", "file", "file_start", "n_tokens", "ids"]
    out = schema({"doc_id": docs.schema[id_col].dataType}, "file int, file_start long, n_tokens long, ids array<int>")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.repartitionByRange("_id").sortWithinPartitions("_id", "_text")
    rows.mapInArrow(encode, out).write.options(**FORMAT).parquet(path)


def numbers(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens`` of every row: reads no token page."""
    rows = spark.read.parquet(path).select("doc_id", "file", "file_start", "n_tokens")
    return rows.join(F.broadcast(_file_starts(rows)), "file").select("doc_id", _start(), "n_tokens")


def _file_starts(rows: DataFrame) -> DataFrame:
    """One row a file: the tokens of all files before it."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    total = rows.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    return total.select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))


def _start():
    return (F.col("_before") + F.col("file_start")).alias("start")


def read(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """``doc_id, ids``, of the ids from ``first`` to ``last`` if given."""
    rows = spark.read.parquet(path).select("doc_id", "ids")
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    return rows if last is None else rows.where(F.col("doc_id") <= last)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files' own ids."""
    rows = spark.read.parquet(path)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = list_crc32(batch.column(3))
            n = pa.array(np.diff(batch.column(3).offsets.to_numpy()).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], n, pa.array(crc)], names)

    names = ["doc_id", "file", "file_start", "n_tokens", "ids_crc32"]
    out = schema({c: rows.schema[c].dataType for c in names[:3]}, "n_tokens long, ids_crc32 long")
    got = rows.select("doc_id", "file", "file_start", "ids").mapInArrow(sums, out)
    return got.join(F.broadcast(_file_starts(rows)), "file").select("doc_id", _start(), "n_tokens", "ids_crc32")


def list_crc32(lists: pa.ListArray) -> np.ndarray:
    values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).view(np.uint8)
    at = lists.offsets.to_numpy() * 4
    return np.array([zlib.crc32(values[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], np.int64)
