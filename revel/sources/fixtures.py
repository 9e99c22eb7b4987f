"""Fixture views derived from the driver tables (see FIXTURES.md section 2).

Each view stands in for one input of the reference (reviews, explanation
records, text pairs, predictions, epoch losses).  They are plain lazy
DataFrames over the Parquet tables, so Catalyst prunes columns and pushes
filters into the scans; work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _user_item(e: DataFrame):
    return (
        F.concat(F.lit("u"), e.user_id.cast("string")).alias("user_key"),
        F.concat(F.lit("i"), F.regexp_extract(e.props, "([0-9]+)", 1)).alias("item_key"),
    )


#: The six sub-ratings of a review: absent where ``pos`` divides by the first
#: number, else one to five by the second.
SUB_RATINGS = {"sub_value": (4, 2), "sub_location": (6, 3), "sub_sleep_quality": (7, 5), "sub_rooms": (9, 7),
               "sub_cleanliness": (10, 11), "sub_service": (3, 13)}


def _sub_rating_sql(name: str, div: str) -> str:
    absent, step = SUB_RATINGS[name]
    return (f"CASE WHEN pos % {absent} = 0 THEN NULL ELSE cast(1 + (pos {div} {step}) % 5 AS double) END AS {name}")


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of the review side without its texts: pos, user_key, item_key, rating.
    The rating comes from the event's value, not from what picks the text."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("pos"), *_user_item(e),
                    (1 + F.round(F.col("value") * 100).cast("long") % 5).cast("double").alias("rating"))


def _rows_in(df: DataFrame) -> int:
    return max(1, df.count())


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review side: pos, user_key, item_key, text, rating and six sub-ratings.
    Events walk through all documents, again and again."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    ev = keys(spark, sf_dir).withColumn("_doc", F.col("pos") % _rows_in(d))
    joined = ev.join(d, ev._doc == d.doc_id, "inner")
    return joined.select("pos", "user_key", "item_key", "text", "rating",
                         *[F.expr(_sub_rating_sql(n, "div")) for n in SUB_RATINGS])


def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explanation records: pos, user_key, item_key, rating, explanation (NULL = malformed), attribute.
    Events walk through all benchmark texts; a few records name a user without reviews."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("event_type").alias("attribute"), "user_id", "props",
                                              (1 + F.round(F.col("value") * 100).cast("long") % 5).cast("double").alias("rating"))
    user, item = _user_item(e)
    unknown = F.concat(F.lit("x"), F.col("user_id").cast("string"))
    ev = e.select("pos", F.when(F.col("pos") % 11 == 5, unknown).otherwise(user).alias("user_key"), item, "rating", "attribute",
                  (F.col("pos") % _rows_in(b)).alias("_bench"))
    return (
        ev.join(b, ev._bench == b.item_id, "inner")
        .select(
            "pos", "user_key", "item_key", "rating",
            F.when(F.col("pos") % 50 == 0, F.lit(None).cast("string")).otherwise(F.col("text")).alias("explanation"),
            "attribute",
        )
    )


def templated_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explanation records in the reference's shape: template = array(attr, 'x', sentence, '1'),
    only three items where the sentence is missing (a malformed template)."""
    ex = explanations(spark, sf_dir)
    template = F.when(
        F.col("explanation").isNull(), F.array(F.col("attribute"), F.lit("x"), F.lit("1"))
    ).otherwise(F.array(F.col("attribute"), F.lit("x"), F.col("explanation"), F.lit("1")))
    return ex.select("pos", "user_key", "item_key", "rating", template.alias("template"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(reference, generated) text pairs: a user turn and the assistant turn after it."""
    c = table(spark, sf_dir, "conversations")
    a = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("reference"))
    b = c.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("b_conv"), F.col("turn").alias("b_turn"), F.col("text").alias("generated"))
    return (
        a.join(b, (b.b_conv == a.conv_id) & (b.b_turn == a.turn + 1), "inner")
        .select((F.col("conv_id") * 1000000 + F.col("turn")).alias("pair_id"), "reference", "generated")
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rating truth / prediction pairs: pos, truth, pred, grp."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("pos"),
        (1 + F.col("event_id") % 5).cast("double").alias("truth"),
        ((1 + (F.col("event_id") * 3) % 9).cast("double") / 2.0).alias("pred"),
        F.col("event_type").alias("grp"),
    )


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation loss per (run, epoch): five runs of thirty epochs.

    The loss is the mean value rounded half-up to 4 places in integer
    arithmetic (sum of cents, integer division), so both engines agree even
    on exact half-way means, where rounding a double differs between them.
    """
    e = table(spark, sf_dir, "events")
    g = e.groupBy(F.col("event_type").alias("run"), F.dayofmonth("ts").cast("long").alias("epoch")).agg(
        F.sum(F.round(F.col("value") * 100).cast("long")).alias("_cents"), F.count(F.lit(1)).alias("_n"))
    e4 = F.expr("(_cents * 200 + _n) div (2 * _n)")
    return g.select("run", "epoch", (e4 / 10000.0).alias("val_loss"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, vec ARRAY<DOUBLE>."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


# The same views as SQL text for the DuckDB oracle (valid in both engines).
FIXTURE_SQL = {
    "keys": """
SELECT event_id AS pos, concat('u', cast(user_id AS string)) AS user_key,
       concat('i', regexp_extract(props, '([0-9]+)', 1)) AS item_key,
       cast(1 + cast(round(value * 100) AS bigint) % 5 AS double) AS rating
FROM events""",
    "interactions": f"""
SELECT k.*, d.text, {", ".join(_sub_rating_sql(n, "//") for n in SUB_RATINGS)}
FROM (SELECT event_id AS pos, concat('u', cast(user_id AS string)) AS user_key,
             concat('i', regexp_extract(props, '([0-9]+)', 1)) AS item_key,
             cast(1 + cast(round(value * 100) AS bigint) % 5 AS double) AS rating FROM events) k
JOIN documents d ON d.doc_id = k.pos % (SELECT count(*) FROM documents)""",
    "explanations": """
SELECT e.event_id AS pos, concat(CASE WHEN e.event_id % 11 = 5 THEN 'x' ELSE 'u' END, cast(e.user_id AS string)) AS user_key,
       concat('i', regexp_extract(e.props, '([0-9]+)', 1)) AS item_key,
       cast(1 + cast(round(e.value * 100) AS bigint) % 5 AS double) AS rating,
       CASE WHEN e.event_id % 50 = 0 THEN NULL ELSE b.text END AS explanation,
       e.event_type AS attribute
FROM events e JOIN benchmark b ON b.item_id = e.event_id % (SELECT count(*) FROM benchmark)""",
    "pairs": """
SELECT a.conv_id * 1000000 + a.turn AS pair_id, a.text AS reference, b.text AS generated
FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
WHERE a.role = 'user' AND b.role = 'assistant'""",
    "predictions": """
SELECT event_id AS pos, cast(1 + event_id % 5 AS double) AS truth,
       cast(1 + (event_id * 3) % 9 AS double) / 2.0 AS pred, event_type AS grp
FROM events""",
    "epochs": """
SELECT event_type AS run, day(ts) AS epoch,
       ((sum(cast(round(value * 100) AS BIGINT)) * 200 + count(*)) // (2 * count(*))) / 10000.0::DOUBLE AS val_loss
FROM events GROUP BY event_type, day(ts)""",
    "vectors": """
SELECT vec_id, label, list_transform(embedding, lambda x: cast(x AS double)) AS vec FROM embeddings""",
}


def with_fixtures(sql: str, *names: str, ctes: str | None = None, recursive: bool = False) -> str:
    """Prefix an oracle query with the fixture views it uses (and extra CTEs)."""
    parts = [f"{n} AS ({FIXTURE_SQL[n].strip()})" for n in names]
    if ctes:
        parts.append(ctes.strip())
    head = "WITH RECURSIVE" if recursive else "WITH"
    return f"{head} {',\n'.join(parts)}\n{sql.strip()}"
