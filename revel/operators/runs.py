"""Training-run tracking as window and aggregate operators over metric tables.

A run's epochs are one small window partition (epochs per run are bounded
by the training schedule), so these windows shuffle by ``run`` only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_so_far(df: DataFrame, run: str = "run", epoch: str = "epoch", val: str = "val_loss") -> DataFrame:
    """Adds ``prev_best`` (strict running minimum before this epoch) and
    ``is_best`` (val < prev_best; the first epoch is always best)."""
    w = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    prev = F.min(val).over(w)
    return df.select("*", prev.alias("prev_best"), (prev.isNull() | (F.col(val) < prev)).alias("is_best"))


def patience_counter(df: DataFrame, run: str = "run", epoch: str = "epoch") -> DataFrame:
    """Adds ``counter``: epochs since the last improvement (0 on an improvement).
    Needs ``is_best`` (see :func:`best_so_far`)."""
    order = Window.partitionBy(run).orderBy(epoch)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    staged = df.select("*", F.row_number().over(order).alias("_n"))
    last_best = F.max(F.when(F.col("is_best"), F.col("_n"))).over(upto)
    return staged.select("*", (F.col("_n") - last_best).cast("long").alias("counter")).drop("_n")


def early_stop(df: DataFrame, patience: int = 3, run: str = "run", epoch: str = "epoch") -> DataFrame:
    """Adds ``stop_epoch`` (first epoch whose counter reaches ``patience``) and
    keeps only the epochs a run actually saw (up to and including it)."""
    stop = F.min(F.when(F.col("counter") >= patience, F.col(epoch))).over(Window.partitionBy(run))
    staged = df.select("*", stop.alias("stop_epoch"))
    return staged.where(F.col("stop_epoch").isNull() | (F.col(epoch) <= F.col("stop_epoch")))


def track(df: DataFrame, patience: int = 3, run: str = "run", epoch: str = "epoch", val: str = "val_loss") -> DataFrame:
    """best-so-far -> patience counter -> early stop, in one pass per run."""
    return early_stop(patience_counter(best_so_far(df, run, epoch, val), run, epoch), patience, run, epoch)


def best_epoch(tracked: DataFrame, run: str = "run", epoch: str = "epoch", val: str = "val_loss") -> DataFrame:
    """Per run: the epoch whose state is restored (lowest loss, earliest on ties)."""
    return tracked.groupBy(run).agg(
        F.min_by(F.col(epoch), F.struct(F.col(val), F.col(epoch))).alias("best_epoch"),
        F.min(val).alias("best_val"), F.count(F.lit(1)).alias("epochs_seen"))


def epoch_means(df: DataFrame, group: list[str], batch: str, loss: str) -> DataFrame:
    """Both epoch losses: the mean of batch means (the reference's, where the
    short last batch weighs as much as a full one) and the row-weighted mean."""
    per_batch = df.groupBy(*group, batch).agg(F.avg(loss).alias("_bm"), F.count(F.lit(1)).alias("_bn"),
                                              F.sum(loss).alias("_bs"))
    return per_batch.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_batches"), F.avg("_bm").alias("mean_of_batch_means"),
        (F.sum("_bs") / F.sum("_bn")).alias("row_weighted_mean"))


def weighted_sum(components: dict[str, float]) -> Column:
    """``sum(w * component)``, e.g. ``{"xe": 1.0, "rating_mse": 0.5, "criteria_mse": 1.0}``."""
    total = F.lit(0.0)
    for name, w in components.items():
        total = total + F.lit(float(w)) * F.col(name)
    return total
