"""Composite jobs: the three corpus preparations (hotels, movies/TV,
restaurants), each one lazy plan from raw files to a written table.

The raw inputs are staged from the driver tables into the shared scratch
folder in the reference's raw formats (JSON-array shards, JSON lines with
broken lines, explanation records), so the jobs exercise the real readers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revel.operators import prep as P
from revel.session import scratch_dir, staged_input
from revel.sources import fixtures as fx
from revel.sources import readers as R
from revel.sources import sinks as S

# Fields kept from a movie review line and their types.
HOTEL_REVIEW_SCHEMA_POS = T.StructType(R.HOTEL_REVIEW_SCHEMA.fields + [T.StructField("pos", T.LongType())])
MOVIE_FIELDS = {"pos": "bigint", "reviewerID": "string", "asin": "string", "reviewText": "string", "overall": "double"}
MOVIE_NAMES = ("reviewerID", "asin", "reviewText", "overall")
RESTAURANT_NAMES = ("user_id", "business_id", "text", "stars")
# Fields kept from a restaurant review line and their types.
RESTAURANT_FIELDS = {"pos": "bigint", "user_id": "string", "business_id": "string", "text": "string", "stars": "double"}


def hotel_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hotel-shaped reviews: userID, hotelID, reviewText, rating, subRatings map (only present keys), pos."""
    i = fx.interactions(spark, sf_dir)
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"sub_{c}").alias("value"))
                        for k, c in zip(P.HOTEL_SUBRATINGS, P.HOTEL_CRITERIA_COLUMNS)])
    sub = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return i.select(F.col("user_key").alias("userID"), F.col("item_key").alias("hotelID"),
                    F.col("text").alias("reviewText"), "rating", sub.alias("subRatings"), "pos")


def movie_review_lines(spark: SparkSession, sf_dir: str, break_every: int | None = None,
                       names: tuple[str, str, str, str] = MOVIE_NAMES) -> DataFrame:
    """One JSON text per review (movie field names by default); every
    ``break_every``-th record is cut short so it no longer parses."""
    i = fx.interactions(spark, sf_dir)
    u, it, t, r = names
    js = F.to_json(F.struct(F.col("pos"), F.col("user_key").alias(u), F.col("item_key").alias(it),
                            F.col("text").alias(t), F.col("rating").alias(r)))
    base = i.select("pos", js.alias("_js"))
    value = F.col("_js")
    if break_every:
        value = F.when(F.col("pos") % break_every == 0, F.expr("substring(_js, 1, length(_js) - 1)")).otherwise(value)
    return base.select(value.alias("value"))


def stage_json_array(spark: SparkSession, df: DataFrame, key: tuple) -> str:
    """Raw hotel reviews as packed JSON-array shards."""
    return staged_input(spark, ("jsonarray", *key), lambda path: S.write_json_array(df, path, compression=S.PACKED))


def stage_json_lines(spark: SparkSession, lines: DataFrame, key: tuple) -> str:
    """Raw JSON-lines text in packed files."""
    return staged_input(spark, ("jsonl", *key), lambda path: S.write_lines(lines, path, compression=S.PACKED))


def _sink_and_reload(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write the prepared table as packed CSV (the reference's output) and read it back."""
    path = scratch_dir(spark, name) + "/prepared"
    S.write_csv(df, path, skip_empty=False, compression=S.PACKED)
    return R.read_csv(spark, path, df.schema)


# ---------------------------------------------------------------- the jobs on any inputs
# Each takes DataFrames as the readers return them plus the name of an order
# column on each side ("first" per key needs an explicit order).


def prepare_hotels_frames(reviews: DataFrame, explanations: DataFrame, review_order: str,
                          explanation_order: str) -> DataFrame:
    """Hotel reviews (``userID, hotelID, reviewText, rating, subRatings``) and
    explanation records (``user, item, template``) -> the prepared table
    ``user, item, explanation, text, rating, value, ..., service``: loose
    template item, criteria aligned (0 where absent), first pair per key."""
    rv = P.align_criteria(P.rename(reviews, P.HOTEL_RENAME)).withColumnRenamed(review_order, "r_pos")
    rv = rv.select("r_pos", "user", "item", "text", "rating", *P.HOTEL_CRITERIA_COLUMNS)
    ex = explanations.select(F.col(explanation_order).alias("e_pos"), "user", "item",
                             P.template_item("template", strict=False).alias("explanation"))
    first = P.first_pairs(ex, rv, "e_pos", "r_pos")
    return P.select_order(first, ["user", "item", "explanation", "text", "rating"] + P.HOTEL_CRITERIA_COLUMNS)


def prepare_movies_frames(reviews: DataFrame, explanations: DataFrame, review_order: str,
                          explanation_order: str, on_invalid: str = "drop") -> DataFrame:
    """Movie reviews (``reviewerID, asin, reviewText, overall``) and explanation
    records (``user, item|asin, template`` as array or text, ``rating``) ->
    ``user, item, text, explanation, rating``: explanations left-join review text, first pair
    per key, strict four-item templates (``on_invalid`` for the rest)."""
    # the first review of a key is the first of its identical rows too
    rv = P.rename(reviews, P.MOVIE_RENAME).withColumnRenamed(review_order, "r_pos")
    ex = P.drop_if_exists(P.rename(explanations, {"asin": "item"}), "Unnamed: 0", "predicted", "overall")
    ex = ex.select(F.col(explanation_order).alias("e_pos"), "user", "item", "template", "rating")
    first = P.first_pairs(ex, rv.select("user", "item", "text", "r_pos"), "e_pos", "r_pos", how="left")
    first = P.explanation_from_template(first, "template", on_invalid=on_invalid, strict=True).drop("template")
    return P.select_order(first, ["user", "item", "text", "explanation", "rating"])


def prepare_restaurants_frames(reviews: DataFrame, explanations: DataFrame, dedup: bool = False,
                               review_order: str | None = None, explanation_order: str | None = None) -> DataFrame:
    """Restaurant reviews (``user_id, business_id, text, stars``) and explanation
    records (``user, item, template``) -> ``user, item, explanation, text,
    rating``: invalid templates give '', the join fan-out is kept unless
    ``dedup`` (then first pair per key by the two order columns)."""
    ex = P.explanation_from_template(P.drop_if_exists(explanations, "predicted"), "template", on_invalid="empty",
                                     strict=True)
    ex = ex.select(*([F.col(explanation_order).alias("e_pos")] if dedup else []), "user", "item", "explanation")
    rv = P.rename(reviews, P.RESTAURANT_RENAME)
    rv = rv.select(*([F.col(review_order).alias("r_pos")] if dedup else []), "user", "item", "text", "rating")
    joined = P.first_pairs(ex, rv, "e_pos", "r_pos") if dedup else P.join_on_keys(ex, rv, hashed=True)
    return P.select_order(joined, ["user", "item", "explanation", "text", "rating"])


# ---------------------------------------------------------------- the jobs on the driver tables


def _explanation_records(spark: SparkSession, sf_dir: str, template_as_text: bool = False) -> DataFrame:
    t = fx.templated_explanations(spark, sf_dir)
    tpl = F.to_json("template") if template_as_text else F.col("template")
    return t.select("pos", F.col("user_key").alias("user"), F.col("item_key").alias("item"), tpl.alias("template"),
                    "rating")


def prepare_hotels(spark: SparkSession, sf_dir: str, sink: bool = True) -> DataFrame:
    reviews = R.read_json_array(spark, stage_json_array(spark, hotel_reviews(spark, sf_dir), ("hotels", sf_dir)),
                                schema=HOTEL_REVIEW_SCHEMA_POS)
    out = prepare_hotels_frames(reviews, _explanation_records(spark, sf_dir), "pos", "pos")
    return _sink_and_reload(spark, out, "hotels") if sink else out


def prepare_movies(spark: SparkSession, sf_dir: str, sink: bool = True) -> DataFrame:
    # reviews: JSON lines (broken lines skipped); the conversion to CSV is a job of its own (json_to_csv)
    lines = movie_review_lines(spark, sf_dir, break_every=97)
    reviews = R.good_lines(R.read_json_lines(spark, stage_json_lines(spark, lines, ("movies", sf_dir, 97)), MOVIE_FIELDS))
    # explanation templates arrive as text (their string form) and are parsed as data
    out = prepare_movies_frames(reviews, _explanation_records(spark, sf_dir, template_as_text=True), "pos", "pos")
    return _sink_and_reload(spark, out, "movies") if sink else out


def prepare_restaurants(spark: SparkSession, sf_dir: str, sink: bool = True, dedup: bool = False) -> DataFrame:
    """Explanations (invalid template -> '') joined to reviews.  The fan-out is
    kept like the reference; ``dedup=True`` keeps the first pair per
    (user, item) by explanation, then review position."""
    lines = movie_review_lines(spark, sf_dir, names=RESTAURANT_NAMES)
    reviews = R.good_lines(R.read_json_lines(spark, stage_json_lines(spark, lines, ("restaurants", sf_dir)), RESTAURANT_FIELDS))
    expl = _explanation_records(spark, sf_dir).drop("rating")
    out = prepare_restaurants_frames(reviews, expl, dedup, "pos", "pos")
    return _sink_and_reload(spark, out, "restaurants") if sink else out
