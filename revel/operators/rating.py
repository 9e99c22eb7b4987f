"""Rating prediction re-aimed at MLlib (the neural rating head is not built).

* ``fit_factors``: ALS latent user / item factors from (user, item, rating);
  unseen users or items predict NaN (cold start), replaced by the global mean.
* ``fit_rating`` / ``predict``: a Pipeline of features (normalised factors,
  optionally the review text's hashed vector ``text_vec``) and a regressor.
* ``fit_criteria`` / ``fit_outputs``: a ridge head per sub-rating (and the
  rating) over the same features, all solved from one pass (``operators.heads``);
  ``predict_outputs`` chooses between ``plain``, ``criteria`` and ``aspect``.

All fitting is distributed MLlib; only fitted coefficients live on the driver.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revel.operators.heads import Heads, fit_heads, predicted
from revel.operators.vectors import l2_normalize
from revel.session import materialized


def fit_factors(train: DataFrame, user: str = "user_idx", item: str = "item_idx", rating: str = "rating",
                rank: int = 8, max_iter: int = 8, reg: float = 0.1, seed: int = 1702):
    als = ALS(userCol=user, itemCol=item, ratingCol=rating, rank=rank, maxIter=max_iter, regParam=reg, seed=seed,
              coldStartStrategy="nan", checkpointInterval=4)
    data = train.select(F.col(user).cast("int").alias(user), F.col(item).cast("int").alias(item),
                        F.col(rating).cast("float").alias(rating))
    # same data -> same partitions in the same order -> the same factors
    return als.fit(data.repartition(user, item).sortWithinPartitions(user, item, rating))


def all_factors(model) -> DataFrame:
    """``kind, id, features`` of users and items."""
    return model.userFactors.select(F.lit("user").alias("kind"), "id", "features").unionByName(
        model.itemFactors.select(F.lit("item").alias("kind"), "id", "features"))


def factor_features(df: DataFrame, model, user: str = "user_idx", item: str = "item_idx") -> DataFrame:
    """Attach unit-length user and item factor arrays (NULL when unseen).  The factors are written once, so Spark
    knows their bytes and need not shuffle the rows where they are small."""
    uf = l2_normalize(model.userFactors.select(F.col("id").alias(user), "features"), "features", "uf").drop("features")
    itf = l2_normalize(model.itemFactors.select(F.col("id").alias(item), "features"), "features", "if_").drop("features")
    uf, itf = materialized(uf, "user-factors"), materialized(itf, "item-factors")
    out = df.join(uf, user, "left").join(itf, item, "left")
    return out.withColumns({c: F.transform(c, lambda x: x.cast("double")) for c in ("uf", "if_")})


def _assemble(df: DataFrame, use_text: bool) -> DataFrame:
    """Rows whose user and item both have factors, with their feature vector."""
    parts = ["uf", "if_"] + (["text_vec"] if use_text else [])
    return df.where("uf is not null and if_ is not null").select("*", array_to_vector(F.concat(*parts)).alias("features"))


def fit_rating(train_features: DataFrame, label: str = "rating", use_text: bool = True, reg: float = 0.01,
               regressor: str = "linear", seed: int = 1702):
    """Regression on [user factors, item factors(, text vector)]:
    ``regressor='linear'`` (default) or ``'gbt'`` (gradient-boosted trees)."""
    data = _assemble(train_features, use_text)
    if regressor == "linear":
        head = LinearRegression(featuresCol="features", labelCol=label, predictionCol="pred", regParam=reg)
    elif regressor == "gbt":
        head = GBTRegressor(featuresCol="features", labelCol=label, predictionCol="pred", maxIter=20, seed=seed)
    else:
        raise ValueError(regressor)
    return Pipeline(stages=[head]).fit(data)


def predict(model, features: DataFrame, use_text: bool = True, fallback=None) -> DataFrame:
    """Predictions; NaN / NULL (cold start) replaced by ``fallback`` (a number
    or a Column, e.g. the training mean as a scalar subquery)."""
    out = model.transform(_assemble(features, use_text)).drop("features")
    unseen = features.where("uf is null or if_ is null").withColumn("pred", F.lit(None).cast("double"))
    out = out.unionByName(unseen)
    if fallback is not None:
        fb = fallback if isinstance(fallback, Column) else F.lit(fallback)
        out = out.withColumn("pred", F.when(F.isnan("pred") | F.col("pred").isNull(), fb).otherwise(F.col("pred")))
    return out


def joint_features(features: DataFrame, use_text: bool = True) -> DataFrame:
    """``features`` with the array column ``joint``: both factors (and the text vector); null for an unseen user or item."""
    parts = ["uf", "if_"] + (["text_vec"] if use_text else [])
    return features.withColumn("joint", F.concat(*parts))


def fit_criteria(train_features: DataFrame, criteria: list[str], use_text: bool = True, reg: float = 0.01) -> Heads:
    """A head for each criterion over the same features, all from one pass."""
    return fit_heads(joint_features(train_features, use_text), criteria, "joint", reg)


def predict_criteria(heads: Heads, features: DataFrame, use_text: bool = True) -> DataFrame:
    """``pred_criteria``: all criteria in order; an unseen user or item gets the training means."""
    out = joint_features(features, use_text)
    return out.withColumn("pred_criteria", F.array(*(predicted(heads, t, "joint") for t in heads.targets))).drop("joint")


#: what a prediction returns beside the rating
OUTPUTS = ("plain", "criteria", "aspect")


def fit_outputs(train_features: DataFrame, criteria: list[str], rating: str = "rating", use_text: bool = True, reg: float = 0.01) -> Heads:
    """The rating's head and those of the criteria, all from one pass."""
    return fit_criteria(train_features, [rating, *(c for c in criteria if c != rating)], use_text, reg)


def predict_outputs(heads: Heads, features: DataFrame, outputs: str = "plain", use_text: bool = True) -> DataFrame:
    """``features`` with ``pred``, the first head's rating, and by ``outputs`` with

    * ``plain``: nothing more,
    * ``criteria``: ``pred_criteria``, the other heads in order,
    * ``aspect``: ``aspect_rep``, the review's text vector at unit length, to be compared with aspect vectors
      (a zero vector stays zero).

    An unseen user or item gets the training means."""
    if outputs not in OUTPUTS:
        raise ValueError(f"outputs: one of {', '.join(OUTPUTS)}")
    out = joint_features(features, use_text).withColumn("pred", predicted(heads, heads.targets[0], "joint"))
    if outputs == "criteria":
        out = out.withColumn("pred_criteria", F.array(*(predicted(heads, t, "joint") for t in heads.targets[1:])))
    if outputs == "aspect":
        norm = F.sqrt(F.aggregate("text_vec", F.lit(0.0), lambda a, x: a + x * x))
        out = out.withColumn("_norm", norm)
        out = out.withColumn("aspect_rep", F.transform("text_vec", lambda x: F.when(F.col("_norm") > 0, x / F.col("_norm")).otherwise(0.0))).drop("_norm")
    return out.drop("joint")
