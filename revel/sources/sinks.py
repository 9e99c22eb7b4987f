"""Writers: CSV, the explanation report, Parquet stages and JSON-array shards.

Every writer is one narrow stage over the input partitions (no shuffle);
each task writes its own part file, so a lost executor only redoes its tasks.
"""

from __future__ import annotations

import logging
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from revel.functions.text import format_record
from revel.sources.readers import REPORT_SEPARATOR

log = logging.getLogger(__name__)


#: The codec of texts that a job stages or hands on.
PACKED = "gzip"
#: Rows of one such file: a packed file is read by one task.
ROWS_PER_FILE = 50_000


def _text_writer(df: DataFrame, mode: str, compression: str | None) -> DataFrameWriter:
    w = df.write.mode(mode)
    return _packed(w, compression).option("maxRecordsPerFile", ROWS_PER_FILE) if compression else w


def _packed(w: DataFrameWriter, compression: str) -> DataFrameWriter:
    return w.option("compression", compression).option("zlib.compress.level", "BEST_SPEED")


def write_lines(df: DataFrame, path: str, mode: str = "overwrite", compression: str | None = None) -> None:
    """One text a row; with ``compression`` in files of at most ``ROWS_PER_FILE`` rows."""
    _text_writer(df, mode, compression).text(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", skip_empty: bool = True, compression: str | None = None) -> bool:
    """CSV with a header, no index; quotes doubled; white space kept as is;
    with ``compression`` in files of at most ``ROWS_PER_FILE`` rows.

    Returns False (and writes nothing) for an empty table, like the reference's
    "No data to write" warning.
    """
    # take(1) reads whole rows (isEmpty() could prune a JSON scan down to its
    # corrupt-record column, which Spark refuses).
    if skip_empty and not df.take(1):
        log.warning("No data to write to %s", path)
        return False
    (_text_writer(df, mode, compression).option("header", True).option("escape", '"').option("quote", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))
    return True


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_report(df: DataFrame, path: str, reference: str = "reference", generated: str = "generated",
                 mode: str = "overwrite") -> None:
    """Explanation report: one ``Ground Truth / Generated`` record per pair,
    each followed by 40 dashes and a newline; pairs whose generated text is
    empty are skipped."""
    body = (df.where(F.col(generated).isNotNull() & (F.col(generated) != ""))
            .select(format_record(F.col(reference), F.col(generated)).alias("value")))
    body.write.mode(mode).option("lineSep", REPORT_SEPARATOR).text(path)


def _frame_json_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: '[' before the first record, ',' between records, ']' after the last."""
    first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        json = batch.column(0)
        marks = pa.concat_arrays([pa.array(["[" if first else ","], json.type), pa.repeat(pa.scalar(",", json.type), batch.num_rows - 1)])
        first = False
        yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(marks, json, pa.scalar("", json.type))], ["value"])
    if not first:
        yield pa.RecordBatch.from_pydict({"value": ["]"]})


# Ship the framing function by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def write_json_array(df: DataFrame, path: str, mode: str = "overwrite", compression: str | None = None) -> None:
    """Each partition becomes one part file holding a single JSON array.

    The JSON text of every row is made JVM-side (``to_json``); Python only adds
    the bracket and comma framing, streaming batch by batch.
    """
    js = df.select(F.to_json(F.struct(*df.columns)).alias("json"))
    w = js.mapInArrow(_frame_json_array, "value string").write.mode(mode)
    (_packed(w, compression) if compression else w).text(path)
