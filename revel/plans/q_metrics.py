"""Queries for the report round trip, string helpers and metric operators
(SURVEY sections 2.1 src_report, 2.2 sink_report, 2.3 str_*, 2.4 pair
filters, 2.12 metrics)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revel.functions import text as TX
from revel.operators import metrics as M
from revel.plans import oracle_sql as O
from revel.plans.catalog import register, round6
from revel.session import scratch_dir
from revel.sources import fixtures as fx
from revel.sources.fixtures import with_fixtures
from revel.sources.readers import read_report
from revel.sources.sinks import write_report

METRIC_COLS = set(M.TEXT_METRICS)
BLOB_RECORDS = 8  # records per multi-record text in str_extract_pairs


def staged_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs -> report file (sink_report) -> parsed records (src_report)."""
    path = scratch_dir(spark, "report") + "/report"
    pairs = fx.pairs(spark, sf_dir)
    write_report(pairs.select(F.col("reference"), F.col("generated")), path)
    return read_report(spark, path)


def stripped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs with both texts stripped and empty ones dropped (the report's view of them)."""
    p = fx.pairs(spark, sf_dir).where(F.col("generated") != "")
    p = p.select("pair_id", TX.strip("reference").alias("reference"), TX.strip("generated").alias("generated"))
    return M.nonempty_pairs(p)


# SQL of the same view.
_STRIPPED = f"""sp AS (
  SELECT pair_id, {O.strip('reference')} AS reference, {O.strip('generated')} AS generated
  FROM pairs WHERE generated <> ''),
src AS (SELECT * FROM sp WHERE reference <> '' AND generated <> '')"""


# ---------------------------------------------------------------- flagship
@register("met_text_report", with_fixtures(O.report_agg_sql(), "pairs",
                                            ctes=_STRIPPED + ",\n" + O.pair_scores_sql("src")))
def met_text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation script end to end: report -> pairs -> BLEU/ROUGE -> averages with both counts."""
    rep = M.nonempty_pairs(staged_report(spark, sf_dir))
    return round6(M.text_report(M.pair_scores(rep)), METRIC_COLS)


def _per_pair(spark, sf_dir, cols, bleu=True, rouge=True, smooth=True):
    p = stripped_pairs(spark, sf_dir)
    if bleu:
        p = M.bleu_scores(p, orders=(1, 4), smooth=smooth)
    if rouge:
        p = M.rouge_scores(p)
    return round6(p.select("pair_id", *cols), METRIC_COLS)


def _per_pair_sql(cols, bleu=True, rouge=True, smooth=True):
    sel = ", ".join(["pair_id"] + [c if c == "scorable" else f"round({c}, 6) AS {c}" for c in cols])
    return with_fixtures(f"SELECT {sel} FROM scored", "pairs",
                         ctes=_STRIPPED + ",\n" + O.pair_scores_sql("src", bleu=bleu, rouge=rouge, smooth=smooth))


@register("met_bleu_1", _per_pair_sql(["bleu1"], rouge=False))
def met_bleu_1(spark, sf_dir):
    """Sentence BLEU-1 per pair (percent)."""
    return _per_pair(spark, sf_dir, ["bleu1"], rouge=False)


@register("met_bleu_4", _per_pair_sql(["bleu4"], rouge=False))
def met_bleu_4(spark, sf_dir):
    """Sentence BLEU-4 per pair, smoothing method 4 (percent)."""
    return _per_pair(spark, sf_dir, ["bleu4"], rouge=False)


@register("met_bleu_unsmoothed", _per_pair_sql(["bleu1", "bleu4"], rouge=False, smooth=False))
def met_bleu_unsmoothed(spark, sf_dir):
    """BLEU-1 and BLEU-4 without smoothing."""
    return _per_pair(spark, sf_dir, ["bleu1", "bleu4"], rouge=False, smooth=False)


for _key, _name in (("met_rouge_1", "rouge_1"), ("met_rouge_2", "rouge_2"), ("met_rouge_l", "rouge_l")):
    _cols = ["scorable", f"{_name}_f", f"{_name}_p", f"{_name}_r"]
    if _name == "rouge_l":
        _cols += ["rouge_l_set_f", "rouge_l_set_p", "rouge_l_set_r"]

    def _make(cols=_cols, name=_name):
        def q(spark, sf_dir):
            return _per_pair(spark, sf_dir, cols, bleu=False)
        q.__name__ = f"met_{name}"
        q.__doc__ = f"{name.upper()} precision / recall / F per pair (percent; NULL if not scorable)."
        return q

    register(_key, _per_pair_sql(_cols, bleu=False))(_make())


@register("met_ngrams", with_fixtures(f"""
SELECT pair_id, n, len(g) AS n_grams, len(list_distinct(g)) AS n_distinct FROM (
  SELECT pair_id, o.n, {O.ngrams('w', 'o.n')} AS g
  FROM (SELECT pair_id, {O.words('generated')} AS w FROM src), (SELECT unnest(range(1, 5)) AS n) o)""",
    "pairs", ctes=_STRIPPED))
def met_ngrams(spark, sf_dir):
    """n-gram counts (all and distinct) of each generated text, n = 1..4."""
    p = stripped_pairs(spark, sf_dir).select("pair_id", TX.words("generated").alias("_w"))
    per_n = [F.struct(F.lit(n).cast("long").alias("n"), TX.ngrams("_w", n).alias("g")) for n in range(1, 5)]
    ex = p.select("pair_id", F.inline(F.array(*per_n)))
    return ex.select("pair_id", "n", F.size("g").cast("long").alias("n_grams"),
                     F.size(F.array_distinct("g")).cast("long").alias("n_distinct"))


def _turn_scored(spark, sf_dir):
    p = M.pair_scores(stripped_pairs(spark, sf_dir))
    return p.withColumn("turn", F.col("pair_id") % 1000)


_TURN_SCORED = _STRIPPED + ",\n" + O.pair_scores_sql("src") + ",\nts AS (SELECT *, pair_id % 1000 AS turn FROM scored)"


@register("met_safe_average", with_fixtures("""
SELECT turn, CAST(count_if(scorable) AS BIGINT) AS n_scorable,
       round(coalesce(avg(rouge_l_f) FILTER (WHERE rouge_l_f >= 10.0), 0), 6) AS rouge_l_f_high
FROM ts GROUP BY turn""", "pairs", ctes=_TURN_SCORED))
def met_safe_average(spark, sf_dir):
    """Average that is 0 (not NULL) on an empty set: mean ROUGE-L F of the pairs
    scoring at least 10, per turn position; turns with no such pair give 0."""
    s = _turn_scored(spark, sf_dir)
    hi = F.when(F.col("rouge_l_f") >= 10.0, F.col("rouge_l_f"))
    return round6(s.groupBy("turn").agg(F.count_if("scorable").alias("n_scorable"),
                                        M.safe_avg(hi).alias("rouge_l_f_high")), {"rouge_l_f_high"})


@register("met_by_group", with_fixtures(O.report_agg_sql("ts", group="turn"), "pairs", ctes=_TURN_SCORED))
def met_by_group(spark, sf_dir):
    """The full text report per group (turn position of the pair)."""
    return round6(M.text_report(_turn_scored(spark, sf_dir), group_by=["turn"]), METRIC_COLS)


def _rating_sql(metric_sql: str, name: str) -> str:
    return with_fixtures(f"SELECT grp, count(*) AS n, round({metric_sql}, 6) AS {name} FROM predictions GROUP BY grp",
                         "predictions")


def _rating_q(name):
    def q(spark, sf_dir):
        e = M.rating_errors(fx.predictions(spark, sf_dir), group_by=["grp"])
        return e.select("grp", "n", F.round(name, 6).alias(name))
    q.__name__ = f"met_{name}"
    q.__doc__ = f"{name.upper()} of predicted vs true rating, per group."
    return q


register("met_mse", _rating_sql("avg((pred - truth) * (pred - truth))", "mse"))(_rating_q("mse"))
register("met_rmse", _rating_sql("sqrt(avg((pred - truth) * (pred - truth)))", "rmse"))(_rating_q("rmse"))
register("met_mae", _rating_sql("avg(abs(pred - truth))", "mae"))(_rating_q("mae"))


# ---------------------------------------------------------------- report I/O and strings
@register("src_report", with_fixtures("SELECT reference, generated FROM sp", "pairs", ctes=_STRIPPED))
def src_report(spark, sf_dir):
    """Report file -> (reference, generated) records, texts stripped."""
    return staged_report(spark, sf_dir)


@register("sink_report", with_fixtures(
    "SELECT concat('Ground Truth: ', reference, chr(10), 'Generated: ', generated, chr(10)) AS value "
    "FROM pairs WHERE generated <> ''", "pairs"))
def sink_report(spark, sf_dir):
    """Records as written: one per pair with a generated text, separator excluded."""
    from revel.sources.readers import REPORT_SEPARATOR

    path = scratch_dir(spark, "sink-report") + "/report"
    write_report(fx.pairs(spark, sf_dir), path)
    return spark.read.option("lineSep", REPORT_SEPARATOR).text(path)


@register("flt_generated_nonempty", with_fixtures("SELECT pair_id FROM pairs WHERE generated <> ''", "pairs"))
def flt_generated_nonempty(spark, sf_dir):
    """Pairs that have a generated text (the report skips the others)."""
    return fx.pairs(spark, sf_dir).where(F.col("generated") != "").select("pair_id")


@register("flt_nonempty_pair", with_fixtures("SELECT pair_id, reference, generated FROM src", "pairs", ctes=_STRIPPED))
def flt_nonempty_pair(spark, sf_dir):
    """Pairs whose stripped texts are both non-empty."""
    return stripped_pairs(spark, sf_dir)


@register("flt_scorable_pair", with_fixtures(f"""
SELECT pair_id, {O.rouge_sentence_count('reference')} > 0 AND {O.rouge_sentence_count('generated')} > 0 AS scorable
FROM src""", "pairs", ctes=_STRIPPED))
def flt_scorable_pair(spark, sf_dir):
    """Flag pairs the ROUGE package would reject (a side with no sentence)."""
    from revel.functions.metrics import rouge_scorable

    return stripped_pairs(spark, sf_dir).select("pair_id", rouge_scorable("generated", "reference").alias("scorable"))


@register("str_strip", with_fixtures(f"""
SELECT pair_id, {O.strip('reference')} AS reference, {O.strip('generated')} AS generated FROM pairs""", "pairs"))
def str_strip(spark, sf_dir):
    """Strip white space at both ends of both texts."""
    p = fx.pairs(spark, sf_dir)
    return p.select("pair_id", TX.strip("reference").alias("reference"), TX.strip("generated").alias("generated"))


@register("str_words", with_fixtures(f"""
SELECT pair_id, len({O.words('reference')}) AS n_words, array_to_string({O.words('reference')}, '|') AS words_joined
FROM pairs""", "pairs"))
def str_words(spark, sf_dir):
    """str.split() of the reference text: count and the words joined by '|'."""
    p = fx.pairs(spark, sf_dir).select("pair_id", TX.words("reference").alias("_w"))
    return p.select("pair_id", F.size("_w").cast("long").alias("n_words"),
                    F.array_join("_w", "|").alias("words_joined"))


@register("str_word_count", with_fixtures(f"""
SELECT pair_id, greatest(2, len({O.words('reference')})) AS target_length FROM pairs""", "pairs"))
def str_word_count(spark, sf_dir):
    """Generation length rule: max(2, words of the ground truth)."""
    p = fx.pairs(spark, sf_dir)
    return p.select("pair_id", TX.target_length("reference").cast("long").alias("target_length"))


@register("str_format_record", with_fixtures(
    "SELECT pair_id, concat('Ground Truth: ', reference, chr(10), 'Generated: ', generated, chr(10)) AS record "
    "FROM pairs", "pairs"))
def str_format_record(spark, sf_dir):
    """The report record of every pair."""
    p = fx.pairs(spark, sf_dir)
    return p.select("pair_id", TX.format_record("reference", "generated").alias("record"))


_EXTRACT_SQL = f"""
SELECT conv_id, {O.strip('r0')} AS reference, {O.strip('g0')} AS generated FROM (
  SELECT conv_id, unnest(regexp_extract_all(blob, '{TX.PAIR_PATTERN}', 1)) AS r0,
         unnest(regexp_extract_all(blob, '{TX.PAIR_PATTERN}', 2)) AS g0
  FROM (SELECT pair_id // 1000 AS conv_id,
               string_agg(concat('Ground Truth: ', reference, chr(10), 'Generated: ', generated, chr(10),
                                 repeat('-', 40), chr(10)), '' ORDER BY pair_id) AS blob
        FROM pairs GROUP BY pair_id // 1000, (pair_id % 1000) // {2 * BLOB_RECORDS}))"""


@register("str_extract_pairs", with_fixtures(_EXTRACT_SQL, "pairs"))
def str_extract_pairs(spark, sf_dir):
    """Multi-match extraction of (ground truth, generated) from a text holding
    several records: the records of one conversation, at most 8 per string
    (chunked by turn, so no conversation becomes one unbounded row)."""
    p = fx.pairs(spark, sf_dir)
    rec = p.select((F.col("pair_id") / 1000).cast("long").alias("conv_id"), "pair_id",
                   ((F.col("pair_id") % 1000) / (2 * BLOB_RECORDS)).cast("long").alias("chunk"),
                   F.concat(TX.format_record("reference", "generated"), F.lit("-" * 40 + "\n")).alias("rec"))
    blobs = rec.groupBy("conv_id", "chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pair_id", "rec"))), lambda s: s["rec"]), "")
        .alias("blob"))
    return TX.extract_pairs(blobs, "blob").select("conv_id", "reference", "generated")
