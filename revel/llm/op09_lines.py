"""Line dedup by distinct-site spread, in DataFrame functions.

Every line (blanks around it taken off) is known by 96 hash bits.  One
aggregation merges a HyperLogLog sketch of the sites of each line and finds
the first document (smallest id) that has it.  Lines whose estimate is near
the threshold get an exact distinct count.  A line on ``sites`` or more sites
is boilerplate: it stays in its first document and goes from all others.

A line on very many pages costs a task one sketch, not its rows; what goes back
to the documents is the set of removed line hashes of each document, so texts
are shuffled once at most, and lines never.

Defined results: a null text stays null and has no lines; lines without a word
stay and are not counted; a null site counts for no spread; a null id never
comes first and its text is left as it is; rows with one id are one document,
each with its own text; an empty table gives no rows.  Column names that start
with ``_ld`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revel.llm.jobs import written

SITES, LG_K = 10, 12
#: Six standard errors of a sketch with 2^LG_K registers: beyond, no exact count is needed.
MARGIN = 6 * 1.04 / 2 ** (LG_K / 2)
BLANK = " \t\r\x0b\x0c"


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    each = docs.select(F.col(id_col).alias("_ld_id"), F.col(site_col).cast("string").alias("_ld_site"),
                       F.explode(F.split(F.col(text_col), "\n", -1)).alias("_ld_line"))
    line = _key(F.col("_ld_line"))
    return each.where(line != "").select("_ld_id", "_ld_site", F.xxhash64(line).alias("_ld_h"), F.hash(line).alias("_ld_g"))


def boilerplate(docs: DataFrame, sites: int = SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``_ld_h, _ld_g, _ld_first``: lines on ``sites`` or more distinct sites and the first document of each."""
    key = ["_ld_h", "_ld_g"]
    lines = _lines(docs, id_col, text_col, site_col)
    spread = lines.groupBy(*key).agg(F.hll_sketch_agg("_ld_site", LG_K).alias("_ld_s"), F.min("_ld_id").alias("_ld_first"))
    spread = spread.select(*key, "_ld_first", F.hll_sketch_estimate("_ld_s").alias("_ld_n"))
    wide = written(spread.where(F.col("_ld_n") >= sites * (1 - MARGIN)), "spread")
    sure = wide.where(F.col("_ld_n") > sites * (1 + MARGIN)).select(*key, "_ld_first")
    near = wide.where(F.col("_ld_n") <= sites * (1 + MARGIN)).select(*key, "_ld_first")
    seen = lines.where("_ld_site is not null").join(near, key).groupBy(*key, "_ld_first", "_ld_site").agg(F.lit(1))
    exact = seen.groupBy(*key, "_ld_first").agg(F.count(F.lit(1)).alias("_ld_n")).where(F.col("_ld_n") >= sites)
    return sure.unionByName(exact.select(*key, "_ld_first"))


def dedup_lines(docs: DataFrame, sites: int = SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and ``_ld_lines``,
    ``_ld_removed``: lines with a word, and how many of them went."""
    found = boilerplate(docs, sites, id_col, text_col, site_col)
    hits = _lines(docs, id_col, text_col, site_col).join(found, ["_ld_h", "_ld_g"]).where(F.col("_ld_id") > F.col("_ld_first"))
    gone = hits.groupBy("_ld_id").agg(F.collect_set("_ld_h").alias("_ld_gone"))
    rows = docs.join(gone, docs[id_col] == gone["_ld_id"], "left")
    split = F.split(F.col(text_col), "\n", -1)
    hashes = F.transform(split, lambda x: F.when(_key(x) != "", F.xxhash64(_key(x))))
    rows = rows.withColumn("_ld_split", split).withColumn("_ld_hash", hashes)
    stays = F.when(F.col("_ld_gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(
        F.col("_ld_split"), lambda x, i: ~F.coalesce(F.array_contains(F.col("_ld_gone"), F.get(F.col("_ld_hash"), i)), F.lit(False))), "\n"))
    n = F.size(F.filter("_ld_hash", lambda h: h.isNotNull()))
    lost = F.size(F.filter("_ld_hash", lambda h: F.coalesce(F.array_contains(F.col("_ld_gone"), h), F.lit(False))))
    return rows.select(*[stays.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
                       F.when(F.col("_ld_hash").isNull(), 0).otherwise(n).cast("long").alias("_ld_lines"),
                       F.when(F.col("_ld_gone").isNull() | F.col("_ld_hash").isNull(), 0).otherwise(lost).cast("long").alias("_ld_removed"))


ORACLE_SQL = f"""
WITH l AS (
  SELECT doc_id, source, u.pos, u.line, trim(u.line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS k
  FROM documents, (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos) u),
b AS (SELECT k, min(doc_id) AS f FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= {SITES}),
j AS (SELECT l.*, b.k IS NOT NULL AND l.doc_id > b.f AS gone FROM l LEFT JOIN b ON l.k = b.k),
s AS (SELECT doc_id, count(*) FILTER (k <> '') AS n_lines, count(*) FILTER (gone) AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
      FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n_lines, 0) AS n_lines, coalesce(s.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN s.text END AS text
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id
"""
