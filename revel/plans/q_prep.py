"""Queries for sources, sinks, projections, filters, joins, dedup and the
three preparation jobs (SURVEY sections 2.1-2.6, 2.15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revel.operators import prep as P
from revel.plans.catalog import register
from revel.plans.jobs import (
    HOTEL_REVIEW_SCHEMA_POS,
    MOVIE_FIELDS,
    hotel_reviews,
    movie_review_lines,
    prepare_hotels,
    prepare_movies,
    prepare_restaurants,
    stage_json_array,
    stage_json_lines,
)
from revel.session import scratch_dir, staged_input
from revel.sources import fixtures as fx
from revel.sources import readers as R
from revel.sources import sinks as S
from revel.sources.fixtures import with_fixtures

# ---------------------------------------------------------------- shared views


def _reviews(spark, sf_dir) -> DataFrame:
    i = fx.interactions(spark, sf_dir)
    return i.select(F.col("pos").alias("r_pos"), F.col("user_key").alias("user"), F.col("item_key").alias("item"),
                    "text", "rating")


def _expl(spark, sf_dir) -> DataFrame:
    e = fx.explanations(spark, sf_dir)
    return e.select(F.col("pos").alias("e_pos"), F.col("user_key").alias("user"), F.col("item_key").alias("item"),
                    "explanation")


_CRITERIA_SQL = ", ".join(f"coalesce(sub_{c}, 0) AS {c}" for c in P.HOTEL_CRITERIA_COLUMNS)
_REV_SQL = "rev AS (SELECT pos AS r_pos, user_key AS \"user\", item_key AS item, text, rating FROM interactions)"
_EXP_SQL = "ex AS (SELECT pos AS e_pos, user_key AS \"user\", item_key AS item, explanation FROM explanations)"

# ---------------------------------------------------------------- sources


@register("src_json_array", with_fixtures(
    "SELECT pos, user_key AS userID, item_key AS hotelID, text AS reviewText, rating, "
    "sub_value AS value, sub_location AS location, sub_sleep_quality AS sleep_quality, sub_rooms AS rooms, "
    "sub_cleanliness AS cleanliness, sub_service AS service FROM interactions", "interactions"))
def src_json_array(spark, sf_dir):
    """Hotel reviews written as JSON-array shards, read back with an explicit schema."""
    df = R.read_json_array(spark, stage_json_array(spark, hotel_reviews(spark, sf_dir), ("hotels", sf_dir)),
                           schema=HOTEL_REVIEW_SCHEMA_POS)
    return df.select("pos", "userID", "hotelID", "reviewText", "rating",
                     *[F.col("subRatings")[k].alias(c) for k, c in zip(P.HOTEL_SUBRATINGS, P.HOTEL_CRITERIA_COLUMNS)])


@register("src_json_lines", with_fixtures(
    "SELECT pos, user_key AS reviewerID, item_key AS asin, text AS reviewText, rating AS overall FROM interactions",
    "interactions"))
def src_json_lines(spark, sf_dir):
    """Movie reviews as JSON lines; all fields read as text, then converted."""
    path = stage_json_lines(spark, movie_review_lines(spark, sf_dir), ("movies", sf_dir))
    return R.good_lines(R.read_json_lines(spark, path, MOVIE_FIELDS))


@register("src_json_bad_lines", with_fixtures(
    "SELECT pos % 97 = 0 AS is_bad, count(*) AS n, count(CASE WHEN pos % 97 <> 0 THEN pos END) AS n_parsed "
    "FROM interactions GROUP BY 1", "interactions"))
def src_json_bad_lines(spark, sf_dir):
    """JSON lines where every 97th record is cut short: parsed vs reported lines."""
    path = stage_json_lines(spark, movie_review_lines(spark, sf_dir, break_every=97), ("movies", sf_dir, 97))
    raw = R.read_json_lines(spark, path, MOVIE_FIELDS)
    return (raw.groupBy(F.col("_corrupt_record").isNotNull().alias("is_bad"))
            .agg(F.count(F.lit(1)).alias("n"), F.count("pos").alias("n_parsed")))


_DOC_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                            T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                            T.StructField("n_chars", T.LongType())])


@register("src_csv", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def src_csv(spark, sf_dir):
    """Documents through CSV (header, quotes, commas and line breaks inside text)."""
    path = staged_input(spark, ("documents-csv", sf_dir),
                        lambda p: S.write_csv(fx.table(spark, sf_dir, "documents"), p, compression=S.PACKED))
    return R.read_csv(spark, path, _DOC_SCHEMA)


@register("src_explanations", with_fixtures(
    "SELECT user_key AS \"user\", item_key AS item, rating, CAST(CASE WHEN explanation IS NULL THEN 3 ELSE 4 END AS BIGINT) AS n_items, "
    "coalesce(explanation, '1') AS explanation FROM explanations", "explanations"))
def src_explanations(spark, sf_dir):
    """Explanation records (template arrays) staged as Parquet and read back."""
    t = fx.templated_explanations(spark, sf_dir)
    records = t.select(F.col("user_key").alias("user"), F.col("item_key").alias("item"), "template", "rating")
    path = staged_input(spark, ("explanations", sf_dir), lambda p: S.write_parquet(records, p))
    e = R.read_explanations(spark, path)
    return e.select("user", "item", "rating", F.size("template").cast("long").alias("n_items"),
                    P.template_item("template", strict=False).alias("explanation"))


# ---------------------------------------------------------------- sinks


@register("sink_csv", with_fixtures(
    "SELECT pos, user_key AS \"user\", item_key AS item, text, rating, sub_value FROM interactions", "interactions"))
def sink_csv(spark, sf_dir):
    """Review table written as CSV (header, no index) and read back."""
    path = scratch_dir(spark, "sinkcsv") + "/reviews"
    i = fx.interactions(spark, sf_dir).select("pos", F.col("user_key").alias("user"), F.col("item_key").alias("item"),
                                              "text", "rating", "sub_value")
    S.write_csv(i, path, compression=S.PACKED)
    return R.read_csv(spark, path, i.schema)


@register("sink_parquet", with_fixtures("SELECT * FROM explanations", "explanations"))
def sink_parquet(spark, sf_dir):
    """Stage output as Parquet and read back."""
    path = scratch_dir(spark, "sinkpq") + "/explanations"
    S.write_parquet(fx.explanations(spark, sf_dir), path)
    return spark.read.parquet(path)


@register("json_to_csv", with_fixtures(
    "SELECT pos, user_key AS reviewerID, item_key AS asin, text AS reviewText, rating AS overall "
    "FROM interactions WHERE pos % 97 <> 0", "interactions"))
def json_to_csv(spark, sf_dir):
    """JSON lines (with broken lines) -> CSV conversion job, read back."""
    src = stage_json_lines(spark, movie_review_lines(spark, sf_dir, break_every=97), ("movies", sf_dir, 97))
    good = R.good_lines(R.read_json_lines(spark, src, MOVIE_FIELDS))
    path = scratch_dir(spark, "j2c") + "/reviews"
    S.write_csv(good, path, compression=S.PACKED)
    return R.read_csv(spark, path, good.schema)


# ---------------------------------------------------------------- projections


@register("prj_rename", with_fixtures(
    "SELECT user_key AS \"user\", item_key AS item, text, rating FROM interactions", "interactions"))
def prj_rename(spark, sf_dir):
    """Per-source field names -> user, item, text, rating."""
    raw = fx.interactions(spark, sf_dir).select(
        F.col("user_key").alias("reviewerID"), F.col("item_key").alias("asin"),
        F.col("text").alias("reviewText"), F.col("rating").alias("overall"))
    return P.rename(raw, P.MOVIE_RENAME)


@register("prj_drop_if_exists", with_fixtures(
    "SELECT pos, user_key, item_key, text, rating, sub_value, sub_location, sub_sleep_quality, sub_rooms, sub_cleanliness FROM interactions",
    "interactions"))
def prj_drop_if_exists(spark, sf_dir):
    """Drop columns when present; absent names are ignored."""
    return P.drop_if_exists(fx.interactions(spark, sf_dir), "Unnamed: 0", "predicted", "overall", "sub_service")


@register("prj_select_order", with_fixtures(
    "SELECT user_key AS \"user\", item_key AS item, text, rating FROM interactions", "interactions"))
def prj_select_order(spark, sf_dir):
    """Final column selection and order."""
    i = P.rename(fx.interactions(spark, sf_dir), {"user_key": "user", "item_key": "item"})
    return P.select_order(i, ["user", "item", "text", "rating"])


@register("prj_align_criteria", with_fixtures(
    f"SELECT pos, {_CRITERIA_SQL} FROM interactions",
    "interactions"))
def prj_align_criteria(spark, sf_dir):
    """Sub-rating map -> six criteria columns, 0 where a key is absent."""
    h = P.align_criteria(hotel_reviews(spark, sf_dir))
    return h.select("pos", *P.HOTEL_CRITERIA_COLUMNS)


@register("prj_get_default", """
SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS k,
       coalesce(try_cast(json_extract_string(props, '$.missing') AS BIGINT), -1) AS missing
FROM events""")
def prj_get_default(spark, sf_dir):
    """dict.get(key, default) on a JSON field."""
    e = fx.table(spark, sf_dir, "events")
    return e.select("event_id", P.json_field("props", "k", 0, "bigint").alias("k"),
                    P.json_field("props", "missing", -1, "bigint").alias("missing"))


@register("prj_template_item", with_fixtures(
    "SELECT pos, explanation AS strict_item, coalesce(explanation, '1') AS loose_item FROM explanations",
    "explanations"))
def prj_template_item(spark, sf_dir):
    """Third template item: strict (exactly four items) and loose (any length)."""
    t = fx.templated_explanations(spark, sf_dir)
    return t.select("pos", P.template_item("template", strict=True).alias("strict_item"),
                    P.template_item("template", strict=False).alias("loose_item"))


@register("prj_template_string", with_fixtures("SELECT pos, explanation FROM explanations", "explanations"))
def prj_template_string(spark, sf_dir):
    """Template stored as text (JSON, or a tuple with a number, None and both
    kinds of quotes), parsed as data, never evaluated."""
    t = fx.templated_explanations(spark, sf_dir)
    quoted = F.replace(F.replace(F.replace(F.col("template")[2], F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n"))
    four = F.concat(F.lit('("x", None, \''), quoted, F.lit("', "), (F.col("pos") % 5).cast("string"), F.lit(")"))
    three = F.lit("('x', 1.5, True)")
    tuple_form = F.when(F.size("template") == 4, four).otherwise(three)
    t = t.select("pos", F.when(F.col("pos") % 2 == 0, F.to_json("template")).otherwise(tuple_form).alias("template"))
    return t.select("pos", P.template_item(P.parse_template_string("template")).alias("explanation"))


@register("prj_criteria_vector", with_fixtures(
    "SELECT pos, array_to_string([CAST(x AS BIGINT) FOR x IN [coalesce(sub_value, 0), coalesce(sub_location, 0), "
    "coalesce(sub_sleep_quality, 0), coalesce(sub_rooms, 0), coalesce(sub_cleanliness, 0)]], ' ') AS criteria, rating AS overall "
    "FROM interactions", "interactions"))
def prj_criteria_vector(spark, sf_dir):
    """Pack (value, location, sleep_quality, rooms, cleanliness, rating); unpack by slice."""
    h = P.align_criteria(hotel_reviews(spark, sf_dir))
    v = P.criteria_vector(h)
    crit, overall = P.criteria_parts("criteria")
    return v.select("pos", F.array_join(F.transform(crit, lambda x: x.cast("bigint").cast("string")), " ").alias("criteria"),
                    overall.alias("overall"))


@register("prj_coalesce_text", with_fixtures("SELECT pos, coalesce(explanation, '') AS explanation FROM explanations",
                                             "explanations"))
def prj_coalesce_text(spark, sf_dir):
    """NULL text -> '' before tokenising."""
    e = fx.explanations(spark, sf_dir)
    return e.select("pos", P.coalesce_text("explanation").alias("explanation"))


# ---------------------------------------------------------------- filters


@register("flt_ascii_text",
          "SELECT doc_id FROM documents WHERE regexp_full_match(text, '[\\x09-\\x0d\\x20-\\x2f\\x3a-\\x7e]*')")
def flt_ascii_text(spark, sf_dir):
    """Documents made only of ASCII letters, white space and punctuation."""
    return P.ascii_text(fx.table(spark, sf_dir, "documents"), "text").select("doc_id")


@register("flt_valid_template", with_fixtures("SELECT pos FROM explanations WHERE explanation IS NOT NULL",
                                              "explanations"))
def flt_valid_template(spark, sf_dir):
    """Keep only four-item templates."""
    return P.valid_templates(fx.templated_explanations(spark, sf_dir)).select("pos")


# ---------------------------------------------------------------- joins and dedup


@register("join_inner_reviews", with_fixtures(
    "SELECT e_pos, r_pos, \"user\", item, explanation, text, rating FROM ex JOIN rev USING (\"user\", item)",
    "interactions", "explanations", ctes=_REV_SQL + ",\n" + _EXP_SQL))
def join_inner_reviews(spark, sf_dir):
    """Explanations joined to reviews on (user, item); fan-out kept."""
    return P.join_on_keys(_expl(spark, sf_dir), _reviews(spark, sf_dir), hashed=True).select(
        "e_pos", "r_pos", "user", "item", "explanation", "text", "rating")


@register("join_left_text", with_fixtures(
    "SELECT e_pos, r_pos, \"user\", item, text FROM ex LEFT JOIN rev USING (\"user\", item)",
    "interactions", "explanations", ctes=_REV_SQL + ",\n" + _EXP_SQL))
def join_left_text(spark, sf_dir):
    """Explanations left-joined to review texts; unmatched keys keep NULL text."""
    r = _reviews(spark, sf_dir).select("r_pos", "user", "item", "text")
    return P.join_on_keys(_expl(spark, sf_dir), r, how="left", hashed=True).select("e_pos", "r_pos", "user", "item", "text")


@register("join_null_safe", with_fixtures(
    "SELECT e_pos, r_pos FROM "
    "(SELECT e_pos, CASE WHEN e_pos % 97 = 0 THEN NULL ELSE \"user\" END AS u, item FROM ex) a JOIN "
    "(SELECT r_pos, CASE WHEN r_pos % 89 = 0 THEN NULL ELSE \"user\" END AS u, item FROM rev) b "
    "ON a.u IS NOT DISTINCT FROM b.u AND a.item = b.item",
    "interactions", "explanations", ctes=_REV_SQL + ",\n" + _EXP_SQL))
def join_null_safe(spark, sf_dir):
    """pandas-style join where NULL keys match NULL keys."""
    e = _expl(spark, sf_dir).select("e_pos", F.when(F.col("e_pos") % 97 == 0, None).otherwise(F.col("user")).alias("user"),
                                     "item")
    r = _reviews(spark, sf_dir).select("r_pos", F.when(F.col("r_pos") % 89 == 0, None).otherwise(F.col("user")).alias("user"),
                                       "item")
    return P.join_on_keys(e, r, null_safe=True).select("e_pos", "r_pos")


@register("dedup_full_row", with_fixtures(
    "SELECT DISTINCT user_key AS \"user\", item_key AS item, text, rating FROM interactions", "interactions"))
def dedup_full_row(spark, sf_dir):
    """Drop identical rows."""
    i = fx.interactions(spark, sf_dir).select(F.col("user_key").alias("user"), F.col("item_key").alias("item"),
                                              "text", "rating")
    return P.distinct_rows(i)


@register("dedup_first_by_key", with_fixtures("""
SELECT e_pos, r_pos, "user", item, explanation, text, rating FROM (
  SELECT *, row_number() OVER (PARTITION BY "user", item ORDER BY e_pos, r_pos) AS rn
  FROM ex JOIN rev USING ("user", item)) WHERE rn = 1""",
    "interactions", "explanations", ctes=_REV_SQL + ",\n" + _EXP_SQL))
def dedup_first_by_key(spark, sf_dir):
    """First row per (user, item) after the join: smallest explanation position, then review position."""
    return P.first_pairs(_expl(spark, sf_dir), _reviews(spark, sf_dir), "e_pos", "r_pos").select(
        "e_pos", "r_pos", "user", "item", "explanation", "text", "rating")


@register("distinct_entities", with_fixtures(
    "SELECT DISTINCT 'user' AS kind, user_key AS key FROM keys "
    "UNION ALL SELECT DISTINCT 'item' AS kind, item_key AS key FROM keys", "keys"))
def distinct_entities(spark, sf_dir):
    """Distinct users and distinct items."""
    i = fx.keys(spark, sf_dir)
    u = P.distinct_values(i, "user_key").select(F.lit("user").alias("kind"), F.col("user_key").alias("key"))
    it = P.distinct_values(i, "item_key").select(F.lit("item").alias("kind"), F.col("item_key").alias("key"))
    return u.unionByName(it)


@register("count_entities", with_fixtures(
    "SELECT count(DISTINCT user_key) AS num_users, count(DISTINCT item_key) AS num_items FROM keys",
    "keys"))
def count_entities(spark, sf_dir):
    """num_users, num_items."""
    i = fx.keys(spark, sf_dir).select(F.col("user_key").alias("user"), F.col("item_key").alias("item"))
    return P.count_entities(i)


# ---------------------------------------------------------------- jobs

_HOTEL_ORACLE = f"""
SELECT "user", item, explanation, text, rating, value, location, sleep_quality, rooms, cleanliness, service FROM (
  SELECT *, row_number() OVER (PARTITION BY "user", item ORDER BY e_pos, r_pos) AS rn FROM (
    SELECT e.pos AS e_pos, e.user_key AS "user", e.item_key AS item, coalesce(e.explanation, '1') AS explanation,
           i.pos AS r_pos, i.text, i.rating, {_CRITERIA_SQL}
    FROM explanations e JOIN interactions i ON e.user_key = i.user_key AND e.item_key = i.item_key))
WHERE rn = 1"""


@register("job_prepare_hotels", with_fixtures(_HOTEL_ORACLE, "interactions", "explanations"))
def job_prepare_hotels(spark, sf_dir):
    """JSON-array reviews + explanation records -> aligned, joined, first per key -> CSV."""
    return prepare_hotels(spark, sf_dir)


_MOVIE_ORACLE = """
SELECT "user", item, text, explanation, rating FROM (
  SELECT *, row_number() OVER (PARTITION BY "user", item ORDER BY e_pos, r_pos) AS rn FROM (
    SELECT e.pos AS e_pos, e.user_key AS "user", e.item_key AS item, e.explanation, e.rating, r.r_pos, r.text
    FROM explanations e LEFT JOIN (
      SELECT user_key, item_key, text, min(pos) AS r_pos FROM interactions
      WHERE pos % 97 <> 0 GROUP BY user_key, item_key, text, rating) r
    ON e.user_key = r.user_key AND e.item_key = r.item_key))
WHERE rn = 1 AND explanation IS NOT NULL"""


@register("job_prepare_movies", with_fixtures(_MOVIE_ORACLE, "interactions", "explanations"))
def job_prepare_movies(spark, sf_dir):
    """JSON lines -> dedup; explanations left-join review text, first per key, strict templates."""
    return prepare_movies(spark, sf_dir)


_RESTAURANT_ORACLE = """
SELECT e.user_key AS "user", e.item_key AS item, coalesce(e.explanation, '') AS explanation, i.text, i.rating
FROM explanations e JOIN interactions i ON e.user_key = i.user_key AND e.item_key = i.item_key"""


@register("job_prepare_restaurants", with_fixtures(_RESTAURANT_ORACLE, "interactions", "explanations"))
def job_prepare_restaurants(spark, sf_dir):
    """Explanations (invalid template -> '') inner-joined to reviews; no dedup."""
    return prepare_restaurants(spark, sf_dir)
