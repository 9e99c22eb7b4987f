"""Queries for dense ids, splits, shuffles, batches and tokens (SURVEY 2.5
join_index_lookup, 2.7, 2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from revel.operators import index as X
from revel.operators import tokens as TK
from revel.plans.catalog import register
from revel.session import materialized
from revel.sources import fixtures as fx
from revel.sources.fixtures import with_fixtures

SEED = 1702
BATCH = 64
VOCAB_SIZE = 20_000
MAX_LEN = 256
CLAMP_TO = 50

_FIRST_SEEN = """
SELECT 'user' AS kind, key, row_number() OVER (ORDER BY first_pos, key) - 1 AS idx
FROM (SELECT user_key AS key, min(pos) AS first_pos FROM keys GROUP BY user_key)
UNION ALL
SELECT 'item' AS kind, key, row_number() OVER (ORDER BY first_pos, key) - 1 AS idx
FROM (SELECT item_key AS key, min(pos) AS first_pos FROM keys GROUP BY item_key)"""


@register("idx_first_seen", with_fixtures(_FIRST_SEEN, "keys"))
def idx_first_seen(spark, sf_dir):
    """Dense 0-based user and item ids in order of first appearance."""
    ids = X.first_seen_indexes(fx.keys(spark, sf_dir), ["user_key", "item_key"], "pos")
    u = ids["user_key"].select(F.lit("user").alias("kind"), F.col("user_key").alias("key"),
                               F.col("user_key_idx").alias("idx"))
    it = ids["item_key"].select(F.lit("item").alias("kind"), F.col("item_key").alias("key"),
                                F.col("item_key_idx").alias("idx"))
    return u.unionByName(it)


@register("join_index_lookup", with_fixtures("""
SELECT i.pos, u.idx AS user_idx, t.idx AS item_idx
FROM keys i JOIN ids u ON u.kind = 'user' AND u.key = i.user_key
                    JOIN ids t ON t.kind = 'item' AND t.key = i.item_key""", "keys",
    ctes=f"ids AS ({_FIRST_SEEN})"))
def join_index_lookup(spark, sf_dir):
    """Map every interaction's user and item to its dense id ."""
    i = fx.keys(spark, sf_dir)
    ids = X.first_seen_indexes(i, ["user_key", "item_key"], "pos")
    out = X.lookup_join(X.lookup_join(i.select("pos", "user_key", "item_key"), ids["user_key"], "user_key"),
                        ids["item_key"], "item_key")
    return out.select("pos", F.col("user_key_idx").alias("user_idx"), F.col("item_key_idx").alias("item_idx"))


def _split_sql(table: str = "keys", key: str = "pos") -> str:
    return f"""
SELECT {key}, CASE WHEN rk < n_train THEN 'train' WHEN rk < n_train + n_val THEN 'val' ELSE 'test' END AS split
FROM (
  SELECT {key}, rk, n - h AS n_train, h - ceil(0.5::DOUBLE * h) AS n_val FROM (
    SELECT {key}, row_number() OVER (ORDER BY md5('{SEED}:' || {key}), {key}) - 1 AS rk, count(*) OVER () AS n,
           ceil(0.2::DOUBLE * count(*) OVER ()) AS h
    FROM {table}))"""


@register("split_80_10_10", with_fixtures(_split_sql(), "keys"))
def split_80_10_10(spark, sf_dir):
    """Seeded exact 80/10/10 split: hold-out ceil(0.2n), of it test ceil(h/2)."""
    return X.exact_split(fx.keys(spark, sf_dir).select("pos"), "pos", SEED)


@register("split_fraction", with_fixtures(f"""
SELECT pos, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.8 + 0.1 THEN 'val' ELSE 'test' END AS split
FROM (SELECT pos, ('0x' || substr(md5('{SEED}:' || pos), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM keys)""",
    "keys"))
def split_fraction(spark, sf_dir):
    """Seeded split by hash thresholds (no sort, approximate sizes)."""
    return X.fraction_split(fx.keys(spark, sf_dir).select("pos"), "pos", SEED)


@register("shuffle_rows", with_fixtures(f"""
SELECT pos, row_number() OVER (ORDER BY md5('{SEED}:3:' || pos), pos) - 1 AS shuffle_idx FROM keys""",
    "keys"))
def shuffle_rows(spark, sf_dir):
    """Reproducible shuffle order for epoch 3."""
    return X.shuffle_order(fx.keys(spark, sf_dir).select("pos"), "pos", SEED, epoch=3)


@register("batch_assign", with_fixtures(f"""
SELECT pos, (row_number() OVER (ORDER BY md5('{SEED}:0:' || pos), pos) - 1) // {BATCH} AS batch_id
FROM keys""", "keys"))
def batch_assign(spark, sf_dir):
    """Batches of 64 rows over the epoch-0 shuffle; the last batch may be short."""
    s = X.shuffle_order(fx.keys(spark, sf_dir).select("pos"), "pos", SEED, epoch=0)
    return X.assign_batches(s, "shuffle_idx", BATCH).select("pos", "batch_id")


# ---------------------------------------------------------------- tokens
_TOKRE = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"
def tok_sql(src: str, key: str, text: str, vocab_size: int, max_len: int, p: str = "", extra: str = "") -> str:
    """CTEs ``{p}vocab`` and ``{p}enc(key, ids, words{extra})`` encoding ``text`` of ``src``."""
    x = f", {extra}" if extra else ""
    return f"""
{p}tl AS (SELECT {key}{x}, regexp_extract_all(lower(coalesce({text}, '')), '{_TOKRE}') AS t FROM {src}),
{p}tk AS (SELECT {key}, unnest(t) AS token, generate_subscripts(t, 1) AS p FROM {p}tl),
{p}vocab AS (SELECT token, cnt, row_number() OVER (ORDER BY cnt DESC, token) + 3 AS id FROM (
          SELECT token, count(*) AS cnt FROM {p}tk GROUP BY token ORDER BY cnt DESC, token LIMIT {vocab_size - 4})),
{p}body AS (SELECT tk.{key}, list(coalesce(v.id, 1) ORDER BY tk.p) AS b,
                list(v.token ORDER BY tk.p) FILTER (WHERE v.token IS NOT NULL) AS words
         FROM {p}tk tk LEFT JOIN {p}vocab v ON v.token = tk.token WHERE tk.p <= {max_len - 2} GROUP BY tk.{key}),
{p}seq AS (SELECT tl.{key}{"".join(", tl." + c.strip() for c in extra.split(",")) if extra else ""},
                list_concat([2], coalesce(body.b, []), [3]) AS s, body.words
        FROM {p}tl tl LEFT JOIN {p}body body ON body.{key} = tl.{key}),
{p}enc AS (SELECT {key}{x}, words,
               list_concat(s, list_transform(range(0, {max_len} - len(s)), lambda z_: 0)) AS ids FROM {p}seq)"""


_TOK_CTES = tok_sql("explanations", "pos", "explanation", VOCAB_SIZE, MAX_LEN, extra="attribute")


def _encoded(spark, sf_dir):
    e = fx.explanations(spark, sf_dir)
    vocab = materialized(TK.build_vocab(e, ["explanation"], VOCAB_SIZE), "vocabulary")
    return TK.encode(e.select("pos", "attribute", "explanation"), "pos", "explanation", vocab, MAX_LEN), vocab


@register("tok_vocab", with_fixtures("SELECT token, cnt, id FROM vocab", "explanations", ctes=_TOK_CTES))
def tok_vocab(spark, sf_dir):
    """Vocabulary of the explanation texts: top 19,996 tokens by count, ids from 4."""
    return TK.build_vocab(fx.explanations(spark, sf_dir), ["explanation"], VOCAB_SIZE)


@register("tok_encode", with_fixtures("SELECT pos, array_to_string(ids, ' ') AS ids FROM enc", "explanations",
                                      ctes=_TOK_CTES))
def tok_encode(spark, sf_dir):
    """Explanation text -> START, ids, END, padded to 256."""
    enc, _ = _encoded(spark, sf_dir)
    return enc.select("pos", TK.ids_text("ids").alias("ids"))


@register("tok_clamp", with_fixtures(
    f"SELECT pos, array_to_string(list_transform(ids, lambda x_: least(greatest(x_, 0), {CLAMP_TO - 1})), ' ') AS ids "
    "FROM enc", "explanations", ctes=_TOK_CTES))
def tok_clamp(spark, sf_dir):
    """Ids clamped into [0, 49] (out-of-range ids collapse on the last id)."""
    enc, _ = _encoded(spark, sf_dir)
    return enc.select("pos", TK.ids_text(TK.clamp("ids", CLAMP_TO)).alias("ids"))


@register("tok_decode", with_fixtures("SELECT pos, coalesce(array_to_string(words, ' '), '') AS text FROM enc",
                                      "explanations", ctes=_TOK_CTES))
def tok_decode(spark, sf_dir):
    """decode(encode(text)): in-vocabulary tokens of the truncated text, specials dropped."""
    enc, vocab = _encoded(spark, sf_dir)
    return TK.decode(enc.select("pos", "ids"), "pos", "ids", vocab).select("pos", "text")


@register("tok_shift", with_fixtures(
    "SELECT pos, array_to_string(ids[1:len(ids) - 1], ' ') AS input_ids, "
    "array_to_string(ids[2:len(ids)], ' ') AS target_ids FROM enc", "explanations", ctes=_TOK_CTES))
def tok_shift(spark, sf_dir):
    """Teacher forcing: decoder input = all but last id, target = all but first."""
    enc, _ = _encoded(spark, sf_dir)
    inp, tgt = TK.shift("ids")
    return enc.select("pos", TK.ids_text(inp).alias("input_ids"), TK.ids_text(tgt).alias("target_ids"))


@register("tok_lengths", with_fixtures(f"""
SELECT attribute, count(*) AS n_rows, round(avg(l), 6) AS avg_len, max(l) AS max_len,
       CAST(count_if(l = {MAX_LEN}) AS BIGINT) AS n_truncated
FROM (SELECT attribute, len(list_filter(ids, lambda x_: x_ <> 0)) AS l FROM enc) GROUP BY attribute""",
    "explanations", ctes=_TOK_CTES))
def tok_lengths(spark, sf_dir):
    """Padding / truncation audit per attribute, from the non-pad mask."""
    enc, _ = _encoded(spark, sf_dir)
    l = TK.non_pad_length("ids").cast("long")
    return (enc.select("attribute", l.alias("l")).groupBy("attribute")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("l"), 6).alias("avg_len"),
                 F.max("l").alias("max_len"), F.count_if(F.col("l") == MAX_LEN).alias("n_truncated")))


@register("flt_not_padding", with_fixtures(
    "SELECT pos, array_to_string(list_filter(ids, lambda x_: x_ <> 0), ' ') AS ids FROM enc", "explanations",
    ctes=_TOK_CTES))
def flt_not_padding(spark, sf_dir):
    """Token ids with padding (id 0) removed, as loss and attention ignore them."""
    enc, _ = _encoded(spark, sf_dir)
    return enc.select("pos", TK.ids_text(F.filter("ids", lambda x: x != TK.PAD)).alias("ids"))
