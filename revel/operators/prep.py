"""Preparation operators: projections, templates, joins and deduplication.

These rebuild the three preparation scripts of the reference (hotel,
movie/TV and restaurant corpora) as one lazy plan each:
``read -> project -> join on (user, item) -> keep first -> write``.

Scale notes
* Joins are plain equi-joins on ``(user, item)``; Catalyst/AQE choose
  broadcast or sort-merge from runtime sizes, and AQE splits skewed keys.
* "Keep first per key" is ``groupBy(keys).agg(min_by(payload, order))``:
  partial aggregation runs map-side, so a hot key costs one row per task
  on the wire, never a whole group in one task.  Where both sides of a join
  are reduced so (``first_pairs``), rows that a task can drop go before the
  shuffle without a sort, and long texts cross it packed.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revel.session import materialized

# The hotel sub-rating keys and the column each one becomes.
HOTEL_SUBRATINGS = ["Value", "Location", "Sleep Quality", "Rooms", "Cleanliness", "Service"]
HOTEL_CRITERIA_COLUMNS = ["value", "location", "sleep_quality", "rooms", "cleanliness", "service"]
# Fixed value: the criteria tuple fed to the criteria head (service is left out), then the overall rating.
CRITERIA_ORDER = ["value", "location", "sleep_quality", "rooms", "cleanliness", "rating"]

# Per-source field names of the raw reviews -> user, item, text, rating.
MOVIE_RENAME = {"reviewerID": "user", "asin": "item", "reviewText": "text", "overall": "rating"}
RESTAURANT_RENAME = {"user_id": "user", "business_id": "item", "stars": "rating"}
HOTEL_RENAME = {"userID": "user", "hotelID": "item", "reviewText": "text"}

# One item of a literal tuple or list: a quoted string with escapes, or a bare
# word (number, None, True, False); possessive, so long strings cost no stack.
LITERAL_ITEM = r"""(?:'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^\s,'"()\[\]{}]++)"""
LITERAL_ROW = rf"(?s)^\s*[(\[]\s*(?:{LITERAL_ITEM}\s*(?:,\s*{LITERAL_ITEM}\s*)*+,?\s*)?[)\]]\s*$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- projections
def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename columns that exist; others are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def drop_if_exists(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def select_order(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def align_criteria(df: DataFrame, map_col: str = "subRatings", keys: Sequence[str] = HOTEL_SUBRATINGS,
                   names: Sequence[str] = HOTEL_CRITERIA_COLUMNS, default: float = 0.0,
                   drop_map: bool = True) -> DataFrame:
    """Every listed sub-rating as its own column, ``default`` where absent."""
    cols = [F.coalesce(F.col(map_col)[k], F.lit(default)).cast("double").alias(n) for k, n in zip(keys, names)]
    out = df.select("*", *cols)
    return out.drop(map_col) if drop_map else out


def get_default(c, default) -> Column:
    """``dict.get(key, default)`` for a nullable field."""
    return F.coalesce(_col(c), F.lit(default))


def json_field(json_col, key: str, default=None, typ: str = "string") -> Column:
    """A top-level field of a JSON text column, converted, with a default."""
    v = F.get_json_object(_col(json_col), f"$.{key}")
    v = v if typ == "string" else v.try_cast(typ)
    return v if default is None else F.coalesce(v, F.lit(default).cast(typ))


def template_item(template, strict: bool = True, index: int = 2) -> Column:
    """Explanation sentence of a template array.

    strict: the third of exactly four items, else NULL (the movie and
    restaurant scripts).  loose: item ``index`` of any length, NULL if too
    short (the hotel script).  ``get`` never raises out of bounds.
    """
    t = _col(template)
    if strict:
        return F.when(F.size(t) == 4, F.get(t, index))
    return F.get(t, index)


def parse_template_string(text) -> Column:
    """Template stored as text -> ARRAY<STRING>, without evaluating anything.

    JSON form ``["a", 1, null]`` via ``from_json``; a Python tuple or list of
    strings, numbers, ``None`` and booleans ``('a', None, "it's", 5)`` by one
    pattern, items as text and ``None`` as NULL; anything else is NULL.
    """
    t = _col(text)
    js = F.when(t.rlike(r"^\s*\["), F.from_json(t, "array<string>"))

    def value(raw: Column) -> Column:
        body = F.substring(raw, F.lit(2), F.length(raw) - 2)
        for escape, char in (("\\\\", "\x00"), ("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ("\\'", "'"), ('\\"', '"'), ("\x00", "\\")):
            body = F.replace(body, F.lit(escape), F.lit(char))
        return F.when(raw.rlike("^['\"]"), body).when(raw != "None", raw)

    items = F.transform(F.regexp_extract_all(t, F.lit(LITERAL_ITEM), 0), value)
    return F.coalesce(js, F.when(t.rlike(LITERAL_ROW), items))


def explanation_from_template(df: DataFrame, col: str = "template", on_invalid: str = "drop",
                              strict: bool = True, out: str = "explanation") -> DataFrame:
    """Extract the sentence; malformed templates per ``on_invalid``:
    'drop' the row, 'empty' -> '' (restaurant script), 'fail' -> error."""
    src = F.col(col)
    if dict(df.dtypes).get(col) == "string":
        src = parse_template_string(src)
    e = template_item(src, strict=strict)
    res = df.select("*", e.alias(out))
    if on_invalid == "drop":
        return res.where(F.col(out).isNotNull())
    if on_invalid == "empty":
        return res.withColumn(out, F.coalesce(F.col(out), F.lit("")))
    if on_invalid == "fail":
        return res.withColumn(out, F.coalesce(F.col(out), F.raise_error(F.lit("invalid template"))))
    raise ValueError(on_invalid)


def valid_templates(df: DataFrame, col: str = "template") -> DataFrame:
    """Only well-formed (four-item) templates."""
    return df.where(F.size(col) == 4)


def criteria_vector(df: DataFrame, cols: Sequence[str] = CRITERIA_ORDER, out: str = "criteria") -> DataFrame:
    """Pack the five criteria and the overall rating in their fixed order."""
    return df.select("*", F.array(*[F.col(c).cast("double") for c in cols]).alias(out))


def criteria_parts(v) -> tuple[Column, Column]:
    """(first five criteria, overall rating) of a packed criteria vector."""
    v = _col(v)
    return F.slice(v, 1, 5), F.get(v, 5)


def coalesce_text(c) -> Column:
    """NULL text -> '' before tokenising (never the word 'nan')."""
    return F.coalesce(_col(c), F.lit(""))


def ascii_text(df: DataFrame, col: str) -> DataFrame:
    from revel.functions.text import is_ascii_text

    return df.where(is_ascii_text(col))


# ---------------------------------------------------------------- joins
def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("user", "item"),
                 how: str = "inner", null_safe: bool = False, hashed: bool = False) -> DataFrame:
    """Equi-join on ``keys``; non-key columns must already be owned by one side.

    ``null_safe=True`` matches NULL keys with NULL keys (pandas ``merge``
    behaviour); the default never matches NULLs (SQL behaviour).
    ``hashed=True`` looks rows up in hash tables of the left side, whose rows
    must be the shorter ones, so that neither side is sorted; long texts of the
    right side cross the shuffle packed.
    """
    keys = list(keys)
    texts = [f.name for f in right.schema.fields if hashed and f.dataType == T.StringType() and f.name not in keys]
    if hashed:
        left, right = left.hint("shuffle_hash"), right.withColumns({c: _packed(c) for c in texts})
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns on both sides, rename first: {sorted(clash)}")
    if not null_safe:
        return left.join(right, keys, how).withColumns({c: _unpack(c) for c in texts})
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    j = left.join(r, cond, how)
    for k in keys:
        j = j.withColumn(k, F.coalesce(F.col(k), F.col(f"_r_{k}")) if how in ("right", "full") else F.col(k))
    return j.drop(*[f"_r_{k}" for k in keys]).withColumns({c: _unpack(c) for c in texts})


def suffix_columns(df: DataFrame, suffix: str, keep: Iterable[str] = ("user", "item")) -> DataFrame:
    """Rename every non-key column with a suffix (the ``_x`` / ``_y`` rule)."""
    keep = set(keep)
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(f"{c}{suffix}") for c in df.columns])


# ---------------------------------------------------------------- dedup
def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key by an explicit order (ties broken by the order columns).

    ``min_by(struct(payload), struct(order))`` aggregates partially map-side;
    NULLs in an order column sort last.
    """
    keys, order = list(keys), list(order)
    payload = [c for c in df.columns if c not in keys]
    # Null flags first so that NULL order values sort after every real one.
    okey = F.struct(*[x for i, c in enumerate(order) for x in (F.col(c).isNull().alias(f"_n{i}"), F.col(c).alias(f"_o{i}"))])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in payload]), okey).alias("_first"))
    return best.select(*keys, *[F.col("_first")[c].alias(c) for c in payload])


#: texts of fewer bytes cross a shuffle as they are
PACKED_FROM = 512
#: keys that a task remembers at a time
KEPT_KEYS = 200_000


def _pack(texts: pa.Array) -> pa.Array:
    """Each text as four bytes and itself: zeros before a short one, else its size before the packed text."""
    codec = pa.Codec("zstd", 1)
    return pa.array([v if v is None else b"\0\0\0\0" + v if len(v) < PACKED_FROM
                     else len(v).to_bytes(4, "little") + codec.compress(v, asbytes=True)
                     for v in texts.cast(pa.binary()).to_pylist()], pa.binary())


@F.arrow_udf(T.BinaryType())
def _packed(texts: pa.Array) -> pa.Array:
    return _pack(texts)


@F.arrow_udf(T.StringType())
def _unpack(packed: pa.Array) -> pa.Array:
    codec = pa.Codec("zstd", 1)
    return pa.array([v if v is None else codec.decompress(v[4:], int.from_bytes(v[:4], "little"), asbytes=True) if v[:4] != b"\0\0\0\0"
                     else v[4:] for v in packed.to_pylist()], pa.binary()).view(pa.string())


def _plain(kind: T.DataType) -> bool:
    """Whether Python compares two values of this type as Spark does."""
    return kind == T.StringType() or isinstance(kind, (T.IntegralType, T.BooleanType, T.DateType))


def _packed_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """:func:`keep_first` with its texts packed, and the names of these.

    A task drops rows of which it has seen an earlier one of the key (it remembers ``KEPT_KEYS`` keys at a time),
    so nothing is sorted before the shuffle; the rest is sorted, packed, behind it."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    packed = [c for c in df.columns if c not in (*keys, *order) and kinds[c] == T.StringType()]
    key_at, order_at, packed_at = ([df.columns.index(c) for c in names] for names in (keys, order, packed))
    drops = all(_plain(kinds[c]) for c in (*keys, *order))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, tuple] = {}
        for batch in batches:
            if drops and batch.num_rows:
                ks, os = (zip(*[batch.column(i).to_pylist() for i in at]) for at in (key_at, order_at))
                early = []
                for i, (k, o) in enumerate(zip(ks, os)):
                    o = tuple((x is None, x) for x in o)
                    if (best := seen.get(k)) is not None and best <= o:
                        continue
                    if len(seen) >= KEPT_KEYS:
                        seen.clear()
                    seen[k] = o
                    early.append(i)
                batch = batch.take(pa.array(early, pa.int32()))
            yield pa.RecordBatch.from_arrays([_pack(c) if i in packed_at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    shape = T.StructType([T.StructField(c, T.BinaryType() if c in packed else k) for c, k in kinds.items()])
    # shuffled before it is grouped: rows are sorted by key once, behind the shuffle
    return keep_first(df.mapInArrow(thin, shape).repartition(*keys), keys, order), packed


def first_pairs(left: DataFrame, right: DataFrame, left_order: str, right_order: str, keys: Sequence[str] = ("user", "item"),
                how: str = "inner") -> DataFrame:
    """First row per key of the join of two sides, by ``(left_order, right_order)``.

    That row pairs the first of each side, so both sides are reduced before
    they are joined one to one; a key with n and m rows never gives n x m."""
    (a, a_texts), (b, b_texts) = _packed_first(left, keys, [left_order]), _packed_first(right, keys, [right_order])
    # both sides lie sorted by key; estimates of packed inputs are far too small, so none of them may pick a broadcast of texts
    both = join_on_keys(a.hint("merge"), b, keys, how)
    return both.select(*[_unpack(c).alias(c) if c in (*a_texts, *b_texts) else c for c in both.columns])


def distinct_rows(df: DataFrame) -> DataFrame:
    """Distinct rows.  Only rows whose hash stands more than once are compared whole; the others have no copy
    and stay where they are.  ``df`` is read twice and must be the same both times."""
    rows = df.select("*", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("_hash"))
    # written once, so Spark knows its bytes and need not shuffle the rows where it is small
    again = materialized(rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash"), "repeated-hashes")
    alone = rows.join(again, "_hash", "left_anti").drop("_hash")
    return alone.unionByName(rows.join(again, "_hash", "left_semi").drop("_hash").distinct())


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def count_entities(df: DataFrame, user: str = "user", item: str = "item") -> DataFrame:
    """``num_users, num_items`` (exact distinct counts)."""
    return df.agg(F.count_distinct(user).alias("num_users"), F.count_distinct(item).alias("num_items"))


# Ship the packing by value, as the token lookups are: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
