"""Queries for vectors and contrastive alignment, rating
prediction (2.10), run logs (2.1 src_run_log) and the training-table,
aspect and rating jobs (2.15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revel.operators import index as X
from revel.operators import metrics as M
from revel.operators import prep as P
from revel.operators import fold_in as FI
from revel.operators import rating as RT
from revel.operators import tokens as TK
from revel.operators import vectors as V
from revel.plans.catalog import register, register_values, round6
from revel.plans.jobs import hotel_reviews
from revel.plans.vector_sql import BATCH, LOSS as _LOSS, PERM as _PERM, VEC as _VEC
from revel.plans.q_index import _TOKRE, SEED, _split_sql, tok_sql
from revel.session import materialized, scratch_dir
from revel.sources import fixtures as fx
from revel.sources import readers as R
from revel.sources import sinks as S
from revel.sources.fixtures import with_fixtures

TEXT_DIMS = 16
SRC_VOCAB, SRC_LEN = 30522, 128
TGT_VOCAB, TGT_LEN = 20000, 256

# ---------------------------------------------------------------- vectors

def _long(df: DataFrame, key: list[str], vec: str, out: str = "value") -> DataFrame:
    """Vector column -> rows ``key..., dim, value`` (rounded)."""
    ex = df.select(*key, F.posexplode(vec).alias("dim", out))
    return ex.select(*key, F.col("dim").cast("long").alias("dim"), F.round(out, 6).alias(out))


def _centroids(spark, sf_dir) -> DataFrame:
    return V.mean_pool(fx.vectors(spark, sf_dir), ["label"], "vec", "cvec")


@register("vec_mean_pool", with_fixtures("SELECT label, i AS dim, round(m, 6) AS value FROM cen", "vectors",
                                         ctes=_VEC))
def vec_mean_pool(spark, sf_dir):
    """Mean vector per label, in long form (label, dim, value)."""
    return _long(_centroids(spark, sf_dir), ["label"], "cvec")


@register("vec_l2_normalize", with_fixtures(
    "SELECT ve.vec_id, ve.i AS dim, round(ve.x / greatest(vn.n, 1e-12), 6) AS value FROM ve JOIN vn USING (vec_id)",
    "vectors", ctes=_VEC))
def vec_l2_normalize(spark, sf_dir):
    """Unit-length vectors (norm floored at 1e-12), long form."""
    return _long(V.l2_normalize(fx.vectors(spark, sf_dir), "vec", "unit"), ["vec_id"], "unit")


def _with_own_centroid(spark, sf_dir) -> DataFrame:
    return fx.vectors(spark, sf_dir).join(_centroids(spark, sf_dir), "label")


_COS_OWN = """
SELECT ve.vec_id, round(sum(ve.x * cen.m) / greatest(vn.n * cn.n, 1e-8), 6) AS cos
FROM ve JOIN cen ON cen.label = ve.label AND cen.i = ve.i JOIN vn USING (vec_id) JOIN cn ON cn.label = ve.label
GROUP BY ve.vec_id, vn.n, cn.n"""


@register("vec_cosine", with_fixtures(_COS_OWN, "vectors", ctes=_VEC))
def vec_cosine(spark, sf_dir):
    """Cosine of every vector with its label's centroid."""
    v = _with_own_centroid(spark, sf_dir)
    return v.select("vec_id", F.round(V.cosine("vec", "cvec"), 6).alias("cos"))


def _aspects(spark, sf_dir) -> DataFrame:
    c = _centroids(spark, sf_dir)
    return c.select(F.lit("fixture").alias("domain"), F.col("label").alias("aspect_id"), F.col("cvec").alias("vec"))


@register("vec_aspect_affinity", with_fixtures("""
SELECT ve.vec_id, cen.label AS aspect_id, round(sum(ve.x * cen.m) / greatest(vn.n * cn.n, 1e-8), 6) AS score
FROM ve JOIN cen ON cen.i = ve.i JOIN vn USING (vec_id) JOIN cn ON cn.label = cen.label
GROUP BY ve.vec_id, cen.label, vn.n, cn.n""", "vectors", ctes=_VEC))
def vec_aspect_affinity(spark, sf_dir):
    """Review x aspect cosine matrix (aspects = centroids of all labels)."""
    r = fx.vectors(spark, sf_dir).select("vec_id", "vec", F.lit("fixture").alias("domain"))
    aff = V.aspect_affinity(r, "vec_id", "vec", _aspects(spark, sf_dir))
    return aff.select("vec_id", F.col("aspect_id").cast("int").alias("aspect_id"), F.round("score", 6).alias("score"))


def _permuted(spark, sf_dir) -> DataFrame:
    v = fx.vectors(spark, sf_dir).select("vec_id", F.expr(f"vec_id div {BATCH}").alias("batch_id"))
    return V.permuted_partner(v, "vec_id", "batch_id", SEED)


@register("vec_permute_negatives", with_fixtures("SELECT vec_id, batch_id, neg_key FROM perm", "vectors",
                                                 ctes=_VEC + "," + _PERM))
def vec_permute_negatives(spark, sf_dir):
    """Seeded permutation of rows within each batch of 64 (negative partners)."""
    return _permuted(spark, sf_dir)


def _terms(spark, sf_dir) -> DataFrame:
    cen = _centroids(spark, sf_dir)
    v = fx.vectors(spark, sf_dir)
    perm = _permuted(spark, sf_dir).join(v.select(F.col("vec_id").alias("neg_key"), F.col("label").alias("neg_label")),
                                         "neg_key")
    cen = materialized(cen, "centroids")  # one row per label, joined twice
    rows = v.join(perm, "vec_id").join(cen, "label")
    rows = rows.join(cen.select(F.col("label").alias("neg_label"), F.col("cvec").alias("nvec")), "neg_label")
    scored = rows.select("vec_id", "batch_id", V.cosine("vec", "cvec").alias("pos_score"),
                         V.cosine("vec", "nvec").alias("neg_score"))
    return scored.select("*", V.contrastive_term("pos_score", "neg_score").alias("loss"))


@register("vec_contrastive_loss", with_fixtures(
    "SELECT batch_id, count(*) AS n, round(avg(loss), 6) AS loss FROM terms GROUP BY batch_id", "vectors", ctes=_LOSS))
def vec_contrastive_loss(spark, sf_dir):
    """Per batch: mean ln(1 + exp((neg - pos) / 0.1)); positive = own label centroid,
    negative = centroid of the permuted partner's label."""
    t = _terms(spark, sf_dir)
    return round6(t.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.avg("loss").alias("loss")), {"loss"})


@register("job_aspects", with_fixtures("""
SELECT count(*) AS n_vectors, round(avg(pos_score), 6) AS mean_pos_score, round(avg(neg_score), 6) AS mean_neg_score,
       round(avg(loss), 6) AS mean_loss FROM terms""", "vectors", ctes=_LOSS))
def job_aspects(spark, sf_dir):
    """Aspect vectors (label centroids) -> affinity -> contrastive loss summary."""
    t = _terms(spark, sf_dir)
    return round6(t.agg(F.count(F.lit(1)).alias("n_vectors"), F.avg("pos_score").alias("mean_pos_score"),
                        F.avg("neg_score").alias("mean_neg_score"), F.avg("loss").alias("mean_loss")),
                  {"mean_pos_score", "mean_neg_score", "mean_loss"})


@register("vec_concat", with_fixtures("""
SELECT ve.vec_id, count(*) + 64 AS n_dims, round(sum(ve.x) + max(cs.s), 6) AS total
FROM ve JOIN (SELECT label, sum(m) AS s FROM cen GROUP BY label) cs ON cs.label = ve.label GROUP BY ve.vec_id""",
    "vectors", ctes=_VEC))
def vec_concat(spark, sf_dir):
    """Vector concatenated with its label centroid: size and element sum."""
    v = _with_own_centroid(spark, sf_dir).select("vec_id", V.concat_vectors("vec", "cvec").alias("cat"))
    return v.select("vec_id", F.size("cat").cast("long").alias("n_dims"),
                    F.round(F.aggregate("cat", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


_TEXT_VEC = """
tk_{n} AS (SELECT {key}, unnest(regexp_extract_all(lower(coalesce({text}, '')), '{re}')) AS t FROM {src}),
tb_{n} AS (SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT % {dims} AS b, count(*) AS c FROM tk_{n} GROUP BY ALL),
tv_{n} AS (SELECT d.{key}, list(coalesce(tb.c, 0) / greatest(sqrt(coalesce(nn.n, 0)), 1e-12) ORDER BY r.i) AS vec
  FROM (SELECT {key} FROM {src}) d CROSS JOIN (SELECT unnest(range({dims})) AS i) r
  LEFT JOIN tb_{n} tb ON tb.{key} = d.{key} AND tb.b = r.i
  LEFT JOIN (SELECT {key}, sum(c * c) AS n FROM tb_{n} GROUP BY {key}) nn ON nn.{key} = d.{key} GROUP BY d.{key})"""


def _text_vec_sql(n: str, src: str, key: str, text: str) -> str:
    return _TEXT_VEC.format(n=n, src=src, key=key, text=text, re=_TOKRE, dims=TEXT_DIMS).strip()


_SHOWN = "array_to_string(list_transform({v}, lambda x: CAST(CAST(round(x * 10000) AS BIGINT) AS VARCHAR)), ' ')"


def _shown(vec):
    """A vector as text, in ten-thousandths."""
    return F.array_join(F.transform(vec, lambda x: F.round(x * 10000).cast("bigint").cast("string")), " ")


@register("vec_embed_text", f"WITH {_text_vec_sql('d', 'documents', 'doc_id', 'text')} SELECT doc_id, {_SHOWN.format(v='vec')} AS vec FROM tv_d")
def vec_embed_text(spark, sf_dir):
    """Document text -> unit-length hashed bag of words (no fit, no shuffle)."""
    docs = fx.table(spark, sf_dir, "documents")
    return docs.select("doc_id", _shown(V.hashed_text("text", TEXT_DIMS)).alias("vec"))


_ASPECT_SQL = ", ".join(f"('{d}', {i}, '{a}', '{d}{i}')" for d, names in V.ASPECTS.items() for i, a in enumerate(names))


@register("vec_aspect_embed", f"""
WITH asp AS (SELECT * FROM (VALUES {_ASPECT_SQL}) v(domain, aspect_id, aspect, k)),
{_text_vec_sql('a', 'asp', 'k', 'aspect')},
near AS (SELECT asp.domain, asp.aspect_id, asp.aspect, tv_a.vec FROM asp JOIN tv_a USING (k)),
{_text_vec_sql('d', 'documents', 'doc_id', 'text')}
SELECT domain, aspect_id, aspect, {_SHOWN.format(v='any_value(near.vec)')} AS vec, round(avg(list_dot_product(near.vec, tv_d.vec)), 6) AS mean_cosine
FROM near, tv_d GROUP BY domain, aspect_id, aspect""")
def vec_aspect_embed(spark, sf_dir):
    """Aspect phrases as hashed vectors, staged as Parquet, with their mean cosine over all documents
    (the mean of dot products is the dot product with the documents' mean vector)."""
    asp = V.aspect_phrases(spark)
    path = scratch_dir(spark, "aspects") + "/aspects"
    S.write_parquet(asp.withColumn("vec", V.hashed_text("aspect", TEXT_DIMS)), path)
    docs = fx.table(spark, sf_dir, "documents").select(F.lit(1).alias("g"), V.hashed_text("text", TEXT_DIMS).alias("dvec"))
    mean = docs.groupBy("g").agg(*[F.avg(F.get("dvec", F.lit(i))).alias(f"m{i}") for i in range(TEXT_DIMS)])
    mean = mean.select(F.array(*[f"m{i}" for i in range(TEXT_DIMS)]).alias("mean"))
    emb = spark.read.parquet(path).withColumn("mean", mean.select("mean").scalar())
    return emb.select("domain", "aspect_id", "aspect", _shown(F.col("vec")).alias("vec"), F.round(V.dot("vec", "mean"), 6).alias("mean_cosine"))


# ---------------------------------------------------------------- rating


def _rating_frame(spark, sf_dir, use_text=True):
    """Interactions with dense ids, split, hotel criteria and, if asked for, the text's vector, written once.
    A text is turned into a vector once, however many rows have it.  Texts are gathered as grouping keys, which hash
    aggregation holds (``first`` of a text would sort all rows with their texts), and the vectors join last, so that
    ids and split shuffle narrow rows."""
    h = P.align_criteria(hotel_reviews(spark, sf_dir)).select(
        "pos", F.col("userID").alias("user"), F.col("hotelID").alias("item"), "rating", *P.HOTEL_CRITERIA_COLUMNS,
        *([F.xxhash64("reviewText").alias("_h1"), F.unhex(F.md5(F.coalesce("reviewText", F.lit("")))).alias("_h2"), "reviewText"] if use_text else []))
    if use_text:
        texts = h.select("_h1", "_h2", "reviewText").distinct()
        texts = materialized(texts.select("_h1", "_h2", V.hashed_text("reviewText", TEXT_DIMS).alias("text_vec")), "text-vectors")
        h = h.drop("reviewText")
    ids = X.first_seen_indexes(fx.keys(spark, sf_dir).withColumnsRenamed({"user_key": "user", "item_key": "item"}), ["user", "item"], "pos")
    h = X.lookup_join(X.lookup_join(h, ids["user"], "user"), ids["item"], "item")
    h = h.join(X.exact_split(fx.keys(spark, sf_dir).select("pos"), "pos", SEED), "pos")
    if use_text:
        h = h.join(texts, ["_h1", "_h2"]).drop("_h1", "_h2")
    return materialized(h, "ratings")


def _factors(df):
    return RT.fit_factors(df.where("split = 'train'"))


_TRAIN_IDS = f"""
sp AS ({_split_sql('keys')}),
ui AS (SELECT user_key, row_number() OVER (ORDER BY m, user_key) - 1 AS idx FROM (SELECT user_key, min(pos) AS m FROM keys GROUP BY user_key)),
ii AS (SELECT item_key, row_number() OVER (ORDER BY m, item_key) - 1 AS idx FROM (SELECT item_key, min(pos) AS m FROM keys GROUP BY item_key)),
tr AS (SELECT ui.idx AS u, ii.idx AS i, k.rating FROM keys k JOIN sp USING (pos) JOIN ui USING (user_key) JOIN ii USING (item_key) WHERE sp.split = 'train'),
te AS (SELECT k.* FROM keys k JOIN sp USING (pos) WHERE sp.split = 'test')"""


@register_values("rate_user_item_factors_values")
def rate_user_item_factors_values(spark, sf_dir):
    """ALS latent factors (rank 8) of every user and item of the training split."""
    als = _factors(_rating_frame(spark, sf_dir, use_text=False))
    return RT.all_factors(als).select("kind", F.col("id").cast("long").alias("idx"), F.col("features").cast("array<double>").alias("features"))


@register("rate_user_item_factors", with_fixtures("""
SELECT 'user' AS kind, u AS idx, 8::BIGINT AS rank, true AS finite FROM tr GROUP BY u
UNION ALL SELECT 'item', i, 8, true FROM tr GROUP BY i""", "keys", ctes=_TRAIN_IDS))
def rate_user_item_factors(spark, sf_dir):
    """ALS latent factors (rank 8) of every user and item of the training split:
    size, and whether all values are finite (the values have no SQL)."""
    return rate_user_item_factors_values(spark, sf_dir).select(
        "kind", "idx", F.size("features").cast("long").alias("rank"),
        F.forall("features", lambda x: ~F.isnan(x) & (F.abs(x) < 1e6)).alias("finite"))


def _test_frame(df, als, use_text=True):
    feats = RT.factor_features(df, als)
    train = feats.where("split = 'train'")
    model = RT.fit_rating(train, use_text=use_text)
    mean = df.where("split = 'train'").agg(F.avg("rating")).scalar()  # global-mean fallback, same plan
    return RT.predict(model, feats.where("split = 'test'"), use_text=use_text, fallback=mean).select("pos", F.col("rating").alias("truth"), "pred")


#: Predictions have no SQL; what must hold of them has: the test rows, their truth, finite values near the rating scale.
_TEST_SQL = "SELECT pos, rating AS truth, true AS sound FROM te"


def _checked(pred):
    return pred.select("pos", "truth", (~F.isnan("pred") & F.col("pred").between(-1.0, 7.0)).alias("sound"))


@register_values("rate_predict_values")
def rate_predict_values(spark, sf_dir):
    """``pos, truth, pred``: rating from user/item factors and the review text vector, over the test split."""
    df = _rating_frame(spark, sf_dir)
    return _test_frame(df, _factors(df))


@register_values("rate_test_frame_values")
def rate_test_frame_values(spark, sf_dir):
    """``pos, truth, pred`` over the test split, factors only (no review text)."""
    df = _rating_frame(spark, sf_dir, use_text=False)
    return _test_frame(df, _factors(df), use_text=False)


@register_values("rate_criteria_values")
def rate_criteria_values(spark, sf_dir):
    """``pos`` and ``pred_<criterion>`` of five sub-ratings predicted at once, over the test split."""
    out = _criteria_frame(spark, sf_dir)
    return out.select("pos", *[F.get("pred_criteria", F.lit(i)).alias(f"pred_{c}") for i, c in enumerate(P.CRITERIA_ORDER[:5])])


@register_values("rate_outputs_values")
def rate_outputs_values(spark, sf_dir):
    """``outputs, pos, truth, pred``, ``pred_<criterion>`` (for ``criteria``) and ``aspect_rep`` (for ``aspect``) over the test split,
    for each choice of outputs; the rating and all criteria are fitted in one pass."""
    df = _rating_frame(spark, sf_dir)
    feats = RT.factor_features(df, _factors(df))
    criteria = P.CRITERIA_ORDER[:5]
    heads = RT.fit_outputs(feats.where("split = 'train'"), criteria)
    test = feats.where("split = 'test'")
    frames = []
    for outputs in RT.OUTPUTS:
        out = RT.predict_outputs(heads, test, outputs)
        own = [F.get("pred_criteria", F.lit(i)) if outputs == "criteria" else F.lit(None).cast("double") for i in range(len(criteria))]
        rep = F.col("aspect_rep") if outputs == "aspect" else F.lit(None).cast("array<double>")
        frames.append(out.select(F.lit(outputs).alias("outputs"), "pos", F.col("rating").alias("truth"), "pred",
                                 *(c.alias(f"pred_{n}") for c, n in zip(own, criteria)), rep.alias("aspect_rep")))
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@register_values("rate_cold_start_values")
def rate_cold_start_values(spark, sf_dir):
    """``pos, truth, pred, mean`` of the test rows of users that the factors were not fitted on (a hashed fifth of all users):
    their factors are folded in from their own training rows; ``mean`` is the training mean, and the prediction where a user
    has no such rows or the item has no factors."""
    df = _rating_frame(spark, sf_dir, use_text=False)
    new = X.hash_unit(F.lit(SEED), F.col("user_idx")) < 0.2
    train = df.where(F.col("split") == "train")
    als = RT.fit_factors(train.where(~new))
    users = FI.with_new(als.userFactors, FI.fold_in(train.where(new), als.itemFactors, als.rank))
    mean = train.where(~new).agg(F.avg("rating")).scalar()
    asked = df.where((F.col("split") == "test") & new)
    out = FI.dot_predictions(asked, users, als.itemFactors, mean)
    return out.select("pos", F.col("rating").alias("truth"), "pred", mean.alias("mean"))


@register_values("job_rating_eval_values")
def job_rating_eval_values(spark, sf_dir):
    """fit -> predict -> n, MSE / RMSE / MAE, with and without the review text."""
    return _rating_errors(_rating_frame(spark, sf_dir))


@register("rate_predict", with_fixtures(_TEST_SQL, "keys", ctes=_TRAIN_IDS))
def rate_predict(spark, sf_dir):
    """Rating from user/item factors and the review text vector (linear head), over the test split:
    whether it is finite and near the scale (the values are in ``rate_predict_values``)."""
    return _checked(rate_predict_values(spark, sf_dir))


@register("rate_test_frame", with_fixtures(_TEST_SQL, "keys", ctes=_TRAIN_IDS))
def rate_test_frame(spark, sf_dir):
    """(truth, prediction) over the test split, factors only (no review text):
    whether it is finite and near the scale (the values are in ``rate_test_frame_values``)."""
    return _checked(rate_test_frame_values(spark, sf_dir))


def _criteria_frame(spark, sf_dir):
    df = _rating_frame(spark, sf_dir)
    feats = RT.factor_features(df, _factors(df))
    models = RT.fit_criteria(feats.where("split = 'train'"), P.CRITERIA_ORDER[:5])
    return RT.predict_criteria(models, feats.where("split = 'test'"))


@register("rate_criteria", with_fixtures("SELECT pos, 5::BIGINT AS n_criteria, true AS sound FROM te", "keys", ctes=_TRAIN_IDS))
def rate_criteria(spark, sf_dir):
    """Five sub-ratings predicted at once (one ridge head per criterion, all from one pass), over the test split:
    how many, and whether they are finite and near the scale (the values are in ``rate_criteria_values``)."""
    out = _criteria_frame(spark, sf_dir)
    return out.select("pos", F.size("pred_criteria").cast("long").alias("n_criteria"),
                      F.forall("pred_criteria", lambda x: ~F.isnan(x) & x.between(-2.0, 7.0)).alias("sound"))


def _rating_errors(df):
    als = _factors(df)
    out = [M.rating_errors(_test_frame(df, als, text)).withColumn("use_review_text", F.lit(text)) for text in (True, False)]
    return out[0].unionByName(out[1]).select("use_review_text", "n", "mse", "rmse", "mae")


@register("job_rating_eval", with_fixtures("""
SELECT use_review_text, (SELECT count(*) FROM te) AS n, true AS sound FROM (VALUES (true), (false)) v(use_review_text)""",
                                           "keys", ctes=_TRAIN_IDS))
def job_rating_eval(spark, sf_dir):
    """fit -> predict -> MSE / RMSE / MAE, with and without the review text:
    sound if RMSE is under 1.15 times that of the training mean, and MAE under RMSE
    (the errors are in ``job_rating_eval_values``)."""
    df = _rating_frame(spark, sf_dir)
    mean = df.where("split = 'train'").agg(F.avg("rating").alias("m")).first()[0]
    base = df.where("split = 'test'").agg(F.sqrt(F.avg((F.col("rating") - F.lit(mean)) ** 2))).first()[0]
    sound = (F.col("rmse") <= 1.15 * base) & (F.col("mae") <= F.col("rmse"))
    return _rating_errors(df).select("use_review_text", "n", sound.alias("sound"))


# ---------------------------------------------------------------- training table


_TRAIN_TABLE = f"""
ex AS (SELECT pos AS e_pos, user_key AS "user", item_key AS item, explanation FROM explanations),
rv AS (SELECT pos AS r_pos, user_key AS "user", item_key AS item, text, rating, coalesce(sub_value, 0) + coalesce(sub_location, 0)
              + coalesce(sub_sleep_quality, 0) + coalesce(sub_rooms, 0) + coalesce(sub_cleanliness, 0) AS value
       FROM interactions),
fj AS (SELECT * FROM (
         SELECT ex.*, rv.r_pos, rv.text, rv.rating, rv.value,
                row_number() OVER (PARTITION BY ex."user", ex.item ORDER BY ex.e_pos, rv.r_pos) AS rn
         FROM ex JOIN rv USING ("user", item)) WHERE rn = 1),
ui AS (SELECT "user", row_number() OVER (ORDER BY mp, "user") - 1 AS user_idx
       FROM (SELECT "user", min(e_pos) AS mp FROM fj GROUP BY "user")),
ii AS (SELECT item, row_number() OVER (ORDER BY mp, item) - 1 AS item_idx
       FROM (SELECT item, min(e_pos) AS mp FROM fj GROUP BY item)),
{tok_sql("fj", "e_pos", "text", SRC_VOCAB, SRC_LEN, p="s_")},
{tok_sql("fj", "e_pos", "explanation", TGT_VOCAB, TGT_LEN, p="t_")},
sp AS ({_split_sql("fj", "e_pos")}),
sh AS (SELECT e_pos, split, (row_number() OVER (PARTITION BY split ORDER BY md5('{SEED}:0:' || e_pos), e_pos) - 1)
                     // {BATCH} AS batch_id FROM sp)"""

_TRAIN_TABLE_SELECT = """
SELECT fj.e_pos, ui.user_idx, ii.item_idx, array_to_string(s.ids, ' ') AS src_ids, array_to_string(t.ids, ' ') AS tgt_ids,
       round(fj.value + fj.rating, 6) AS criteria_sum, fj.rating, sh.split, sh.batch_id
FROM fj JOIN ui USING ("user") JOIN ii USING (item) JOIN s_enc s USING (e_pos) JOIN t_enc t USING (e_pos)
JOIN sh USING (e_pos)"""


@register("job_training_table", with_fixtures(_TRAIN_TABLE_SELECT, "interactions", "explanations",
                                              ctes=_TRAIN_TABLE))
def job_training_table(spark, sf_dir):
    """Explanations with review text -> dense ids, source / target token ids,
    criteria, 80/10/10 split and shuffled batches of 64 inside each split
    (arrays shown as text; criteria by their sum)."""
    t = training_table(spark, sf_dir)
    return t.select("e_pos", "user_idx", "item_idx", TK.ids_text("src_ids").alias("src_ids"),
                    TK.ids_text("tgt_ids").alias("tgt_ids"),
                    F.round(F.aggregate("criteria", F.lit(0.0), lambda a, x: a + x), 6).alias("criteria_sum"),
                    "rating", "split", "batch_id")


def training_table(spark, sf_dir, fit_ids_on: str = "all") -> DataFrame:
    """The training table of the rating / explanation models.

    ``fit_ids_on='all'`` numbers users and items over every row (the
    reference's behaviour: test-only users get ids never trained);
    ``'train'`` numbers them on the training split only (unseen -> NULL).
    """
    ex = fx.explanations(spark, sf_dir).select(F.col("pos").alias("e_pos"), F.col("user_key").alias("user"),
                                               F.col("item_key").alias("item"), "explanation")
    rev = P.align_criteria(hotel_reviews(spark, sf_dir)).select(
        F.col("pos").alias("r_pos"), F.col("userID").alias("user"), F.col("hotelID").alias("item"),
        F.col("reviewText").alias("text"), "rating", *P.HOTEL_CRITERIA_COLUMNS)
    # the joined, deduplicated base feeds split, ids, two vocabularies, two encodings and the batches: materialise it once in the
    # shared checkpoint folder, with what these need of the texts (the first tokens, and the counts of all)
    base = TK.heads(P.first_pairs(ex, rev, "e_pos", "r_pos"), {"text": SRC_LEN - 2, "explanation": TGT_LEN - 2})
    base = materialized(base, "first-pairs", compression="zstd")
    first = base.where("_token is null")
    # split, ids and batches are joined without the tokens, which stay where they are until they are ids
    rows = first.select("e_pos", "user", "item")
    sp = X.exact_split(rows.select("e_pos"), "e_pos", SEED)
    rows = rows.join(sp, "e_pos")
    basis = rows if fit_ids_on == "all" else rows.where(F.col("split") == "train")
    ids = X.first_seen_indexes(basis, ["user", "item"], "e_pos")
    rows = X.lookup_join(X.lookup_join(rows, ids["user"], "user"), ids["item"], "item")
    # epoch-0 shuffle inside each split, then batches of 64 consecutive rows
    order = sp.select("e_pos", "split", X.hash_order(SEED, 0, F.col("e_pos")).alias("_h"))
    pos_in_split = X.dense_index_within(order, ["split"], ["_h", "e_pos"], "shuffle_idx").select("e_pos", "shuffle_idx")
    rows = X.assign_batches(rows.join(pos_in_split, "e_pos"), "shuffle_idx", BATCH)
    src_vocab = materialized(TK.build_vocab(base, ["text"], SRC_VOCAB, counted=True), "vocabulary")
    tgt_vocab = materialized(TK.build_vocab(base, ["explanation"], TGT_VOCAB, counted=True), "vocabulary")
    t = TK.encode(first, "e_pos", "text", src_vocab, SRC_LEN, "src_ids", pad=False)
    t = TK.encode(t, "e_pos", "explanation", tgt_vocab, TGT_LEN, "tgt_ids", pad=False)
    t = P.criteria_vector(t).select("user", "item", "criteria", "rating", TK.narrow_ids("src_ids", SRC_VOCAB).alias("_src"),
                                    TK.narrow_ids("tgt_ids", TGT_VOCAB).alias("_tgt"))
    # a key has one first row
    out = rows.join(t, ["user", "item"])
    return out.select("e_pos", "user_idx", "item_idx", TK.wide_ids("_src", SRC_VOCAB, SRC_LEN).alias("src_ids"),
                      TK.wide_ids("_tgt", TGT_VOCAB, TGT_LEN).alias("tgt_ids"), "criteria", "rating", "split", "batch_id")


# ---------------------------------------------------------------- run logs


@register("src_run_log", with_fixtures("SELECT run, epoch, val_loss + 0.5 AS train_loss, val_loss FROM epochs", "epochs"))
def src_run_log(spark, sf_dir):
    """Run logs written from the epoch table (both epoch spellings, noise lines) and parsed back."""
    e = fx.epochs(spark, sf_dir)
    epoch_txt = F.when(F.col("epoch") % 2 == 0, F.format_string("Epoch: %d", "epoch")).otherwise(
        F.format_string("Epoch %d", "epoch"))
    line = F.format_string("%s, Train Loss: %.4f, Val Loss: %.4f", epoch_txt, F.col("val_loss") + 0.5, "val_loss")
    noise = F.format_string("Early stopping counter: %d/3", F.col("epoch") % 4)
    lines = e.select("run", "epoch", F.explode(F.array(line, noise)).alias("value"))
    path = scratch_dir(spark, "runlog") + "/logs"
    (lines.repartition("run").sortWithinPartitions("run", "epoch").select("run", "value")
     .write.partitionBy("run").text(path))
    parsed = R.read_run_log(spark, path, run_pattern=r"run=([^/]+)/")
    return parsed.select("run", "epoch", "train_loss", "val_loss")
