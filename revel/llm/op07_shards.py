"""Sharding by jump consistent hashing, in DataFrame functions.

A key walks through the bucket counts at which it would move: a linear
congruential generator seeded with the key gives the next such count, and the
last one below the shard count is the key's shard.  No ring table is kept, the
shard depends on the key and the count alone, and with one more shard only the
keys that the new shard takes are moved.  One walk gives both shards, of the
count and of one more.

Law: ``key``.  Slots number a shard's rows from 0 by ascending key; they come
from one range shuffle of the keys (never one task for a shard).

Defined results: a null text has size 1 and crc32 0; a null key walks as key 0;
equal keys share a shard, their slots in order of size and crc32; an empty
table gives no rows.  Integer keys seed the generator as they are, others by
their 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revel.operators.index import dense_index

#: The generator's multiplier and the powers of two of the published algorithm (fixed values).
MULTIPLIER = "2862933555777941757BD"
TWO_64, TWO_33, TWO_31 = "18446744073709551616BD", "8589934592BD", "2147483648D"


def jump(seed: str, shards: int) -> Column:
    """Struct ``shard`` (of ``shards``) and ``grown`` (of one more) of a long column.

    The products stay under 38 decimal digits, so decimals hold them exactly
    where a long would overflow."""
    return F.expr(f"""
        aggregate(
          sequence(0, {shards}),
          named_struct('key', cast({seed} + if({seed} < 0, {TWO_64}, 0BD) as decimal(38,0)), 'next', 0L, 'shard', 0L, 'grown', 0L),
          (w, i) -> if(w.next > {shards}, w, transform(
            array(cast((w.key * {MULTIPLIER} + 1BD) % {TWO_64} as decimal(38,0))),
            k -> named_struct(
              'key', k,
              'next', cast(floor((w.next + 1) * ({TWO_31} / cast((k div {TWO_33}) + 1 as double))) as bigint),
              'shard', if(w.next < {shards}, w.next, w.shard),
              'grown', w.next))[0]),
          w -> named_struct('shard', cast(w.shard as int), 'grown', cast(w.grown as int)))""")


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, size, text_crc32, law, shard, slot, grown_shard``."""
    kind = docs.schema[id_col].dataType.typeName()
    seed = F.col(id_col).cast("long") if kind in ("byte", "short", "integer", "long") else F.xxhash64(id_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), F.coalesce(seed, F.lit(0)).alias("_seed"), (F.octet_length(text).cast("long") + 1).alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows = rows.withColumn("_to", jump("_seed", shards))
    rows = rows.select(id_col, "size", "text_crc32", F.col("_to.shard").alias("shard"), F.col("_to.grown").alias("grown_shard"))
    placed = dense_index(rows, ["shard", id_col, "size", "text_crc32"], "_place")
    # one row a shard
    first = placed.groupBy("shard").agg(F.min("_place").alias("_first"))
    slots = placed.join(F.broadcast(first), "shard")
    return slots.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard",
                        (F.col("_place") - F.col("_first")).alias("slot"), "grown_shard")
