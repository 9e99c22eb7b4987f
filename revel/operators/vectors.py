"""Dense-vector operators on ``ARRAY<DOUBLE>`` columns: pooling, norms,
cosine, aspect affinity, permuted negatives and the contrastive loss.

Element-wise work is built-in higher-order functions (``zip_with``,
``aggregate``, ``transform``) in one narrow stage.  Pooling is
``posexplode`` + a partial aggregation on ``(group, dim)``, then one ordered
regroup of ``dim`` values per group (bounded by the dimension).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revel.operators.index import hash_order

COS_EPS = 1e-8       # fixed value: cosine denominator floor
NORM_EPS = 1e-12     # fixed value: l2-normalise denominator floor
TEMPERATURE = 0.1    # fixed value: contrastive temperature

# The six aspect phrases of each domain.
ASPECTS = {
    "trip": ["Service", "Room Size", "Location", "Cleanliness", "Sleep Quality", "Value"],
    "yelp": ["Service", "Food Quality", "Ambience", "Cleanliness", "Price", "Menu Variety"],
    "amzMT": ["Plot", "Acting", "Visuals", "Sound Quality", "Genre", "Authenticity"],
}


def aspect_phrases(spark, domains=None) -> DataFrame:
    """``domain, aspect_id, aspect`` for the given domains (all by default);
    an unknown domain raises, as the reference's aspect script does."""
    domains = list(ASPECTS) if domains is None else list(domains)
    unknown = [d for d in domains if d not in ASPECTS]
    if unknown:
        raise ValueError(f"unknown aspect domain(s) {unknown}; choose from {sorted(ASPECTS)}")
    rows = [(d, i, a) for d in domains for i, a in enumerate(ASPECTS[d])]
    return spark.createDataFrame(rows, "domain string, aspect_id int, aspect string")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: a column that an inner lambda
    names is computed again for each element, a lambda variable is not."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hashed_text(text, dims: int) -> Column:
    """Unit-length hashed bag of a text's words: the md5 bucket of each token,
    counted over ``dims`` buckets (all zero for a text without tokens)."""
    from revel.functions.text import tokens

    buckets = F.transform(tokens(text), lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % dims)
    counts = once(buckets, lambda b: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)),
                                                 lambda i: F.size(F.filter(b, lambda x: x == i)).cast("double")))
    return once(counts, lambda c: once(norm(c), lambda n: F.transform(c, lambda x: x / F.greatest(n, F.lit(NORM_EPS)))))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a, b) -> Column:
    """Cosine similarity with the denominator floored at 1e-8."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(COS_EPS))


def concat_vectors(*vs) -> Column:
    return F.concat(*[_c(v) for v in vs])


def l2_normalize(df: DataFrame, vec: str, out: str) -> DataFrame:
    """Unit-length copy of ``vec`` (norm floored at 1e-12).  The norm is the
    variable of an outer lambda, so it is computed once for each row."""
    return df.select("*", once(norm(vec), lambda n: F.transform(vec, lambda x: x / F.greatest(n, F.lit(NORM_EPS)))).alias(out))


def mean_pool(df: DataFrame, group: list[str], vec: str, out: str = "vec") -> DataFrame:
    """Element-wise mean vector per group."""
    ex = df.select(*group, F.posexplode(vec).alias("_i", "_x"))
    per_dim = ex.groupBy(*group, "_i").agg(F.avg("_x").alias("_m"))
    regroup = per_dim.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_s"))
    return regroup.select(*group, F.transform("_s", lambda s: s["_m"]).alias(out))


def aspect_affinity(df: DataFrame, key: str, vec: str, aspects: DataFrame, domain: str = "domain",
                    aspect_id: str = "aspect_id", aspect_vec: str = "vec", out: str = "score") -> DataFrame:
    """Review x aspect cosine matrix in long form: ``key, aspect_id, score``.

    Every review meets every aspect of its domain: an equi-join on ``domain``,
    whose small side Spark broadcasts by its bytes."""
    a = aspects.select(F.col(domain), F.col(aspect_id), F.col(aspect_vec).alias("_avec"), norm(aspect_vec).alias("_an"))
    r = df.select(F.col(domain), key, F.col(vec).alias("_rvec"), norm(vec).alias("_rn"))
    score = dot("_rvec", "_avec") / F.greatest(F.col("_rn") * F.col("_an"), F.lit(COS_EPS))
    return r.join(a, domain).select(key, aspect_id, score.alias(out))


def permuted_partner(df: DataFrame, key: str, batch: str, seed: int, out: str = "neg_key") -> DataFrame:
    """A seeded random permutation of the rows inside each batch: each row gets
    the key of the row at its permuted position (the negatives)."""
    by_key = Window.partitionBy(batch).orderBy(key)
    by_hash = Window.partitionBy(batch).orderBy(hash_order(seed, F.col(key)), key)
    ranked = df.select(key, batch, F.row_number().over(by_key).alias("_r"),
                       F.row_number().over(by_hash).alias("_h"))
    perm = ranked.select(batch, F.col("_h").alias("_r"), F.col(key).alias(out))
    return ranked.join(perm, [batch, "_r"]).select(key, batch, out)


def contrastive_term(pos_score, neg_score, temperature: float = TEMPERATURE) -> Column:
    """``-ln(e^{p/t} / (e^{p/t} + e^{n/t})) = ln(1 + e^{(n - p)/t})`` (the stable form)."""
    return F.log1p(F.exp((_c(neg_score) - _c(pos_score)) / temperature))


def embed_batches(df: DataFrame, text: str, encoder, dim: int, out: str = "vec") -> DataFrame:
    """Pluggable text encoder: ``encoder(list[str]) -> sequence of dim-d float
    vectors`` runs on Arrow batches inside the tasks (``mapInPandas``), e.g. a
    local sentence-embedding model.  The default text vectors are
    :func:`hashed_text`; this hook is for encoders Spark lacks."""
    from pyspark.sql import types as T

    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for pdf in batches:
            texts = pdf[text].fillna("").astype(str).tolist()
            vecs = encoder(texts)
            pdf[out] = [[float(x) for x in v][:dim] for v in vecs]
            yield pdf

    return df.mapInPandas(run, schema)
