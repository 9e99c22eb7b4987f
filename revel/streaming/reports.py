"""Explanation reports scored as they arrive (Structured Streaming).

The reference evaluates one report file at a time; here a folder of report
files is a file stream: each new file's records are parsed, scored per pair
(the same expressions as the batch path) and appended to a Parquet table,
with exactly-once bookkeeping in a checkpoint under the shared folder.
``trigger(availableNow=True)`` processes what is there and stops, so the
same code serves batch back-fills and continuous runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revel.operators.metrics import nonempty_pairs, pair_scores
from revel.session import scratch_dir
from revel.sources.readers import REPORT_SEPARATOR, report_pairs


def report_stream(spark: SparkSession, in_dir: str, max_files_per_trigger: int = 100) -> DataFrame:
    """Streaming DataFrame of (file, reference, generated) records."""
    raw = (spark.readStream.format("text").option("lineSep", REPORT_SEPARATOR)
           .option("maxFilesPerTrigger", max_files_per_trigger).load(in_dir))
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"))
    return report_pairs(raw).select("file", "reference", "generated")


def score_reports(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str | None = None,
                  available_now: bool = True):
    """Start the scoring stream; returns the StreamingQuery."""
    scored = pair_scores(nonempty_pairs(report_stream(spark, in_dir)))
    checkpoint = checkpoint or scratch_dir(spark, "report-stream") + "/_checkpoint"
    w = scored.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint)
    w = w.outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
