"""Global row numbering without a single-partition window, and what is built
on it: dense first-seen ids, exact seeded splits, seeded shuffles, batches.

``dense_index`` (SURVEY section 4.3): range-partition on a *total* order,
sort within partitions, number rows inside each partition, then add the
partition's offset (prefix sum of the per-partition counts: one number per
partition, summed on the driver and broadcast back).  The numbered table is checkpointed to the
shared checkpoint folder first, so the counts and the final numbering see
the same layout, lineage is cut, and a lost executor never renumbers rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revel.session import ensure_checkpoint_dir

_LOCAL_BITS = 33  # monotonically_increasing_id = partition << 33 | row-in-partition


def _cols(cs) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def dense_index(df: DataFrame, order: Sequence, out: str = "idx", num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based rank of each row under ``order`` (must be a total order).

    Cost: one range shuffle + one checkpoint write; no single-partition
    exchange on data-sized input.
    """
    return counted_index(df, order, out, num_partitions)[0]


def counted_index(df: DataFrame, order: Sequence, out: str = "idx", num_partitions: int | None = None) -> tuple[DataFrame, int]:
    """:func:`dense_index` and the row count, which the numbering knows anyway."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ocols = _cols(order)
    # Without an explicit count AQE sizes the range partitions at runtime;
    # coalescing merges neighbouring ranges, so partition order stays the
    # row order and the numbering below holds either way.
    ranged = df.repartitionByRange(num_partitions, *ocols) if num_partitions else df.repartitionByRange(*ocols)
    ranged = ranged.sortWithinPartitions(*ocols)
    mid = F.monotonically_increasing_id()
    tagged = ranged.select("*", F.shiftright(mid, _LOCAL_BITS).alias("_pid"),
                           mid.bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)).alias("_local"))
    tagged = tagged.checkpoint(eager=True)
    # one count per partition (at most n numbers) -> prefix sums on the driver
    counts = sorted((r["_pid"], r["_n"]) for r in tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")).collect())
    offsets, run = [], 0
    for pid, cnt in counts:
        offsets.append((pid, run))
        run += cnt
    off = spark.createDataFrame(offsets, "_pid long, _off long")
    res = tagged.join(F.broadcast(off), "_pid")
    return res.select(*[F.col(c) for c in df.columns], (F.col("_off") + F.col("_local")).alias(out)), run


def dense_index_within(df: DataFrame, group: Sequence[str], order: Sequence, out: str = "idx") -> DataFrame:
    """0-based rank of each row inside its ``group`` under ``order``: one global
    numbering ordered by (group, order), minus the group's first number (one
    row per group, joined back)."""
    g = list(group)
    ranked = dense_index(df, [*g, *order], "_gidx")
    starts = ranked.groupBy(*g).agg(F.min("_gidx").alias("_start"))
    res = ranked.join(starts, g)
    return res.select(*[F.col(c) for c in df.columns], (F.col("_gidx") - F.col("_start")).alias(out))


def first_seen_index(df: DataFrame, key: str, order: str, out: str | None = None) -> DataFrame:
    """Dense 0-based id per distinct ``key`` in order of first appearance (``order``).

    Returns ``key, out``.  The distinct keys come from a partial aggregation
    (``min(order)`` per key), so a hot key costs nothing extra.
    """
    out = out or f"{key}_idx"
    first = df.groupBy(key).agg(F.min(order).alias("_first"))
    return dense_index(first, ["_first", key], out).select(key, out)


def first_seen_indexes(df: DataFrame, keys: Sequence[str], order: str) -> dict[str, DataFrame]:
    """:func:`first_seen_index` for several key columns in one numbering pass:
    ``{key: DataFrame(key, key + '_idx')}``.  The keys are stacked as
    ``(kind, value)`` and numbered within their kind, so one range shuffle and
    one checkpoint serve all of them."""
    stacked = None
    for k in keys:
        part = df.groupBy(F.col(k).cast("string").alias("_v")).agg(F.min(order).alias("_first"))
        part = part.select(F.lit(k).alias("_kind"), "_v", "_first")
        stacked = part if stacked is None else stacked.unionByName(part)
    numbered = dense_index_within(stacked, ["_kind"], ["_first", "_v"], "_idx")
    out = {}
    for k in keys:
        dtype = df.schema[k].dataType
        out[k] = numbered.where(F.col("_kind") == k).select(F.col("_v").cast(dtype).alias(k),
                                                           F.col("_idx").alias(f"{k}_idx"))
    return out


def hash_unit(*parts) -> Column:
    """Seeded uniform value in [0, 1) from md5 of the parts joined by ':'
    (the same number in Spark and DuckDB)."""
    s = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def hash_draw(*parts) -> Column:
    """Seeded integer draw in [0, 2**32): the first 32 bits of md5 of the parts
    joined by ':' (the same integer in Spark and DuckDB)."""
    s = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def hash_order(*parts) -> Column:
    """Seeded order key: md5 of the parts joined by ':'."""
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def split_sizes(n: int, holdout: float = 0.2, test_of_holdout: float = 0.5) -> tuple[int, int, int]:
    """(train, val, test) sizes of two successive shuffle splits: hold-out
    ``ceil(holdout * n)``, of it test ``ceil(test_of_holdout * h)``."""
    h = math.ceil(holdout * n)
    t = math.ceil(test_of_holdout * h)
    return n - h, h - t, t


#: rows of a hash bucket that are few enough to be ordered on the driver
FEW = 10_000


def _histogram(rows: DataFrame, start: int) -> list:
    """``(bucket, n)`` in order, by the four hex digits of ``_h`` after ``start`` of them: at most 65,536 rows."""
    return sorted(map(tuple, rows.groupBy(F.substring("_h", start + 1, 4).alias("bucket")).count().collect()))


def _cut(rows: DataFrame, histogram: list, rank: int) -> tuple | None:
    """``(_h, key)`` of the row with this rank in the order of ``_h, key``; None if the row before it is equal.

    Only the bucket that holds the rank is looked at again, by its next digits, until it has few rows."""
    digits = ""
    while True:
        for bucket, n in histogram:
            if rank < n:
                break
            rank -= n
        digits += bucket
        rows = rows.where(F.substring("_h", len(digits) - len(bucket) + 1, len(bucket)) == bucket)
        if n <= FEW:
            own = [tuple(r) for r in rows.orderBy("_h", "_k").collect()]
            return None if rank and own[rank - 1] == own[rank] else own[rank]
        if len(digits) == 32:  # equal hashes: repeated keys
            return None
        histogram = _histogram(rows, len(digits))


def exact_split(df: DataFrame, key: str, seed: int = 1702, out: str = "split") -> DataFrame:
    """Seeded 80/10/10 split with exact sizes, by the rank of md5(seed:key), then key.

    The two cut points are found by counts of hash buckets, so no row is sorted or
    shuffled: two comparisons tell a row's part.  ``key`` must give the same values each
    time it is read.  Only where a cut falls between rows with equal keys are all rows ranked."""
    label = split_label(df, key, seed)
    return _ranked_split(df, key, seed, out) if label is None else df.select(*df.columns, label.alias(out))


def split_label(df: DataFrame, key: str, seed: int = 1702) -> Column | None:
    """The part of a row in :func:`exact_split` of ``df``, told from ``key`` alone, so that other tables with this key can be cut
    alike before a join; None where a cut falls between rows with equal keys."""
    rows = df.select(hash_order(seed, F.col(key)).alias("_h"), F.col(key).alias("_k"))
    histogram = _histogram(rows, 0)
    n = sum(c for _, c in histogram)
    n_train, n_val, _ = split_sizes(n)
    label = F.lit("train")
    for rank, name in ((n_train, "val"), (n_train + n_val, "test")):
        if rank >= n:
            continue
        at = _cut(rows, histogram, rank)
        if at is None:
            return None
        h, k = hash_order(seed, F.col(key)), F.col(key)
        tied = F.lit(True) if at[1] is None else F.coalesce(k >= F.lit(at[1]), F.lit(False))
        label = F.when((h > at[0]) | ((h == at[0]) & tied), name).otherwise(label)
    return label


def _ranked_split(df: DataFrame, key: str, seed: int, out: str) -> DataFrame:
    """The split by the ranks of all rows; rows with equal keys are told apart by their place."""
    ranked, n = counted_index(df.withColumn("_h", hash_order(seed, F.col(key))), ["_h", key], "_rank")
    n_train, n_val, _ = split_sizes(n)
    label = (F.when(F.col("_rank") < n_train, "train")
             .when(F.col("_rank") < n_train + n_val, "val").otherwise("test"))
    return ranked.select(*df.columns, label.alias(out))


def fraction_split(df: DataFrame, key: str, seed: int = 1702, train: float = 0.8, val: float = 0.1,
                   out: str = "split") -> DataFrame:
    """Seeded split by a hash threshold: no sort, no count, approximate sizes."""
    u = hash_unit(seed, F.col(key))
    label = F.when(u < train, "train").when(u < train + val, "val").otherwise("test")
    return df.select("*", label.alias(out))


def sample_fraction(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Seeded sample: rows whose hash value falls below ``fraction``."""
    return df.where(hash_unit(seed, F.col(key)) < fraction)


def shuffle_order(df: DataFrame, key: str, seed: int, epoch: int = 0, out: str = "shuffle_idx") -> DataFrame:
    """Reproducible shuffle: position of each row in md5(seed:epoch:key) order."""
    h = df.withColumn("_h", hash_order(seed, epoch, F.col(key)))
    return dense_index(h, ["_h", key], out).drop("_h")


def assign_batches(df: DataFrame, index_col: str, batch_size: int, out: str = "batch_id") -> DataFrame:
    """``ceil(n / b)`` batches of ``b`` consecutive positions; the last may be short."""
    return df.withColumn(out, F.expr(f"`{index_col}` div {int(batch_size)}"))


def lookup_join(df: DataFrame, index: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Attach dense ids from an index table; Spark picks the join by its bytes."""
    return df.join(index, key, how)
