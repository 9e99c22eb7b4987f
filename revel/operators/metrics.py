"""Metric operators: per-pair text scores, report averages, rating errors.

Per-pair scores are narrow column expressions (one stage, no shuffle); the
averages are one global aggregation with map-side partial sums, so only one
small row per task crosses the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revel.functions.metrics import (
    bleu_count_stages,
    bleu_from_counts,
    lcs_length,
    rouge_l,
    rouge_n,
    rouge_scorable,
    rouge_words,
    set_lcs,
    union_lcs,
)
from revel.functions.text import split_sentences, words

ROUGE_KEYS = ("rouge_1", "rouge_2", "rouge_l", "rouge_l_set")
TEXT_METRICS = ("bleu1", "bleu4") + tuple(f"{k}_{s}" for k in ROUGE_KEYS for s in ("f", "p", "r"))
SET_METRICS = tuple(m for m in TEXT_METRICS if "_set_" in m)


def nonempty_pairs(df: DataFrame, reference: str = "reference", generated: str = "generated") -> DataFrame:
    """Keep pairs where both texts are non-empty (after stripping)."""
    return df.where((F.col(reference) != "") & (F.col(generated) != ""))


def bleu_scores(df: DataFrame, reference: str = "reference", generated: str = "generated",
                orders: tuple[int, ...] = (1, 4), smooth: bool = True) -> DataFrame:
    """Adds ``bleu{n}`` (percent) for each order in ``orders``."""
    n_max = max(orders)
    out = df.select("*", words(F.col(generated)).alias("_hw"), words(F.col(reference)).alias("_rw"))
    added = ["_hw", "_rw"]
    for stage in bleu_count_stages("_hw", "_rw", n_max):
        out = out.select("*", *[c.alias(k) for k, c in stage.items()])
        added += list(stage)
    out = out.select("*", *[bleu_from_counts(n, smooth).alias(f"bleu{n}") for n in orders])
    return out.drop(*added)


def rouge_scores(df: DataFrame, reference: str = "reference", generated: str = "generated",
                 rouge_l_mode: str = "length") -> DataFrame:
    """Adds ``scorable`` and ROUGE-1/2/L p, r, f (percent; NULL where not scorable).

    ``rouge_l_mode``: 'length' (LCS over all words, default) or 'summary'
    (union-LCS over sentences, ROUGE paper definition) for ``rouge_l``;
    ``rouge_l_set`` always has the scoring package's word sets."""
    staged = df.select(
        "*",
        rouge_words(F.col(generated)).alias("_hw"),
        rouge_words(F.col(reference)).alias("_rw"),
        rouge_scorable(F.col(generated), F.col(reference)).alias("scorable"),
    )
    if rouge_l_mode == "length":
        lcs = lcs_length(F.col("_rw"), F.col("_hw"))
    elif rouge_l_mode == "summary":
        lcs = union_lcs(split_sentences(F.col(reference)), split_sentences(F.col(generated)))
    else:
        raise ValueError(rouge_l_mode)
    sets = set_lcs(split_sentences(F.col(reference)), split_sentences(F.col(generated)))
    staged = staged.select("*", lcs.alias("_lcs"), sets.alias("_sets"))
    cols: list[Column] = []
    for key, n in (("rouge_1", 1), ("rouge_2", 2)):
        prf = rouge_n("_hw", "_rw", n)
        cols += [F.when(F.col("scorable"), prf[s]).alias(f"{key}_{s}") for s in ("f", "p", "r")]
    distinct = {c: F.array_distinct(c) for c in ("_hw", "_rw")}
    for key, common, hyp, ref in (("rouge_l", "_lcs", F.col("_hw"), F.col("_rw")), ("rouge_l_set", "_sets", distinct["_hw"], distinct["_rw"])):
        prf = rouge_l(hyp, ref, F.col(common))
        cols += [F.when(F.col("scorable"), prf[s]).alias(f"{key}_{s}") for s in ("f", "p", "r")]
    return staged.select("*", *cols).drop("_hw", "_rw", "_lcs", "_sets")


def pair_scores(df: DataFrame, reference: str = "reference", generated: str = "generated",
                rouge_l_mode: str = "length") -> DataFrame:
    """BLEU-1, BLEU-4 and ROUGE-1/2/L for every pair (one narrow stage)."""
    return rouge_scores(bleu_scores(df, reference, generated), reference, generated, rouge_l_mode)


def safe_avg(c) -> Column:
    """Average, 0 when there is nothing to average."""
    return F.coalesce(F.avg(c), F.lit(0.0))


def text_report(scored: DataFrame, group_by: list[str] | None = None) -> DataFrame:
    """Averages of every text metric plus both denominators: ``n_pairs`` (BLEU
    is averaged over all pairs) and ``n_scorable`` (ROUGE only over pairs the
    package accepts)."""
    aggs = [F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("scorable")).alias("n_scorable")]
    aggs += [safe_avg(m).alias(m) for m in TEXT_METRICS]
    if group_by:
        return scored.groupBy(*group_by).agg(*aggs)
    return scored.agg(*aggs)


def rating_errors(df: DataFrame, truth: str = "truth", pred: str = "pred",
                  group_by: list[str] | None = None) -> DataFrame:
    """MSE, RMSE, MAE and the row count."""
    d = F.col(pred) - F.col(truth)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(d * d).alias("mse"),
            F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae")]
    return df.groupBy(*group_by).agg(*aggs) if group_by else df.agg(*aggs)
