"""One thin query per operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revel.llm import op01_quality as quality
from revel.llm import op02_language as language
from revel.llm import op03_packing as packing
from revel.llm import op04_decontaminate as decontaminate
from revel.llm import op05_tokens as token_files
from revel.llm import op06_warc as warc
from revel.llm import op07_shards as shards
from revel.llm import op08_substrings as substrings
from revel.llm import op09_lines as lines
from revel.llm import op10_jaccard as jaccard
from revel.llm import op11_trie as prefix_trie
from revel.llm import op12_secrets as secrets
from revel.llm import op13_fim as fim
from revel.llm.jobs import read, shared_path

#: ``pages`` has no fetch date.
FETCHED = "2024-01-01T00:00:00Z"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.label_documents(docs, model)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language.held_out()
    profiles = language.fit(docs.where(~out))
    return language.predict(docs, profiles).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), 4096)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_files.write(read(spark, sf_dir, "documents"), path)
    return token_files.digests(spark, path)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derive(warc.responses(read(spark, sf_dir, "pages"), FETCHED))
    return records.withColumn("record", warc.serialized(records)).drop("block")


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(read(spark, sf_dir, "documents"), 16)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(read(spark, sf_dir, "documents"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    clean = lines.dedup_lines(docs)
    return clean.selectExpr("doc_id", "_ld_lines as n_lines", "_ld_removed as n_removed", "text")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(read(spark, sf_dir, "conversations")))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return secrets.report(docs, secrets.fit(docs))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_language, op3_packing, op4_decontaminate, op5_token_files, op6_warc, op7_shards,
                                   op8_substrings, op9_lines, op10_jaccard, op11_trie, op12_secrets, op13_fim)}

#: The other operators have no SQL: they train models, use a tokenizer, crc32 or a digest of many rows, or close a graph.
ORACLE: dict[str, str] = {
    "op6_warc": warc.oracle_sql(FETCHED),
    "op8_substrings": substrings.ORACLE_SQL,
    "op9_lines": lines.ORACLE_SQL,
}
