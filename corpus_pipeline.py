"""Corpus pipeline: each stage's output is written and read by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revel.llm import op02_language as language
from revel.llm import op03_packing as packing
from revel.llm import op04_decontaminate as decontaminate
from revel.llm import op09_lines as lines
from revel.llm import op10_jaccard as jaccard
from revel.llm.jobs import read, written

#: a text of this many characters whose best cosine is lower is in none of the
#: learned languages; shorter texts say too little to be rejected by it
LEAST_SCORE, LONG_ENOUGH = 0.25, 500
SEQUENCE = 4096


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; the profiles are learned from all documents that name one."""
    profiles = language.fit(docs)
    found = language.predict(docs, profiles, keep=docs.columns)
    strange = (F.length("text") >= LONG_ENOUGH) & (F.col("_score") < LEAST_SCORE)
    return found.where((F.col("_lang_pred") != "und") & ~strange).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites stay in their first document only; a document that loses all its lines goes."""
    found = lines.dedup_lines(docs).where("_ld_removed = 0 or _ld_removed < _ld_lines")
    return _sized(found, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, once."""
    return jaccard.first_rows(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from others the words of benchmark windows are cut out."""
    return _sized(decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark")), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, SEQUENCE)


def _sized(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with the length of the new text."""
    return found.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express hyperdimensional profiles or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
