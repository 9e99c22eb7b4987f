"""Small file fixtures (FIXTURES.md section 3): readers, writers, templates, joins."""

import json
import os

import pytest
from pyspark.sql import functions as F

from revel.operators import prep as P
from revel.sources import readers as R
from revel.sources import sinks as S


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_json_array_align_default_zero(spark, tmp_dir):
    data = [
        {"userID": "u1", "hotelID": "h1", "reviewText": "a", "rating": 5,
         "subRatings": {k: 4 for k in P.HOTEL_SUBRATINGS}},
        {"userID": "u2", "hotelID": "h1", "reviewText": "b", "rating": 3, "subRatings": {"Value": 2}},
        {"userID": "u3", "hotelID": "h2", "reviewText": "c", "rating": 1},
    ]
    path = _write(f"{tmp_dir}/reviews/reviews.json", json.dumps(data, indent=2))
    df = P.align_criteria(R.read_json_array(spark, os.path.dirname(path)))
    rows = {r.userID: r for r in df.collect()}
    assert [rows["u1"][c] for c in P.HOTEL_CRITERIA_COLUMNS] == [4.0] * 6
    assert rows["u2"].value == 2.0 and rows["u2"].service == 0.0
    assert [rows["u3"][c] for c in P.HOTEL_CRITERIA_COLUMNS] == [0.0] * 6


def test_json_array_writer_round_trip(spark, tmp_dir):
    df = spark.range(0, 1000, numPartitions=4).select(F.col("id"), F.concat(F.lit("t"), F.col("id")).alias("s"))
    S.write_json_array(df, f"{tmp_dir}/arr")
    back = spark.read.schema("id long, s string").option("multiLine", True).json(f"{tmp_dir}/arr")
    assert sorted(r.id for r in back.collect()) == list(range(1000))
    for f in os.listdir(f"{tmp_dir}/arr"):
        if f.startswith("part-"):
            json.load(open(f"{tmp_dir}/arr/{f}"))  # each part file is one valid JSON array


def test_json_lines_bad_line_kept_apart(spark, tmp_dir):
    lines = [
        '{"reviewerID": "u1", "asin": "i1", "reviewText": "good", "overall": 5.0}',
        '{"reviewerID": "u2", "asin": "i2", "reviewText": "broken", "overall": ',
        '{"reviewerID": "u3", "asin": "i3", "overall": 4.0}',
        '{"reviewerID": "u4", "asin": "i4", "reviewText": "typed", "overall": "five"}',
        '{"reviewerID": null, "asin": "i5", "reviewText": "nullkey", "overall": 2.0}',
    ]
    _write(f"{tmp_dir}/jl/reviews.jsonl", "\n".join(lines) + "\n")
    fields = {"reviewerID": "string", "asin": "string", "reviewText": "string", "overall": "double"}
    raw = R.read_json_lines(spark, f"{tmp_dir}/jl", fields)
    good = {r.asin: r for r in R.good_lines(raw).collect()}
    assert set(good) == {"i1", "i3", "i4", "i5"}
    assert R.bad_lines(raw).count() == 1
    assert good["i3"].reviewText is None          # missing field -> NULL, row kept
    assert good["i4"].overall is None             # wrong type -> NULL, row kept
    assert good["i5"].reviewerID is None


def test_csv_round_trip_quotes_commas_newlines(spark, tmp_dir):
    rows = [(1, 'He said "hi", then left'), (2, "line one\nline two, with comma"), (3, ""), (4, None),
            (5, "  padded  "), (6, "None")]
    df = spark.createDataFrame(rows, "id long, text string")
    S.write_csv(df, f"{tmp_dir}/csv")
    back = {r.id: r.text for r in R.read_csv(spark, f"{tmp_dir}/csv", df.schema).collect()}
    assert back == dict(rows)


def test_csv_empty_table_not_written(spark, tmp_dir):
    df = spark.createDataFrame([], "id long")
    assert S.write_csv(df, f"{tmp_dir}/none") is False
    assert not os.path.exists(f"{tmp_dir}/none")


def test_missing_ok(spark, tmp_dir):
    df = R.read_json_array(spark, f"{tmp_dir}/does-not-exist", missing_ok=True)
    assert df.count() == 0 and "userID" in df.columns
    with pytest.raises(Exception):
        R.read_json_array(spark, f"{tmp_dir}/does-not-exist").collect()


def test_templates_strict_loose_and_string_forms(spark):
    rows = [(1, ["a", "b", "four", "d"]), (2, ["a", "b", "three"]), (3, ["a", "b", "five", "d", "e"]), (4, None)]
    df = spark.createDataFrame(rows, "id int, template array<string>")
    out = {r.id: r for r in df.select("id", P.template_item("template").alias("s"),
                                       P.template_item("template", strict=False).alias("l")).collect()}
    assert out[1].s == "four" and out[2].s is None and out[3].s is None and out[4].s is None
    assert out[2].l == "three" and out[3].l == "five"

    texts = [(1, '["a", "b", "json form", "d"]'), (2, "('a', 'b', \"it's here\", 'd')"),
             (3, "__import__('os').system('echo hi')"), (4, None), (5, "('only', 'three', 'items')")]
    sdf = spark.createDataFrame(texts, "id int, template string")
    parsed = {r.id: r.e for r in sdf.select("id", P.template_item(P.parse_template_string("template")).alias("e")).collect()}
    assert parsed == {1: "json form", 2: "it's here", 3: None, 4: None, 5: None}

    # on_invalid modes
    assert P.explanation_from_template(sdf, on_invalid="drop").count() == 2
    empties = {r.id: r.explanation for r in P.explanation_from_template(sdf, on_invalid="empty").collect()}
    assert empties[3] == "" and empties[1] == "json form"


def test_null_safe_join(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "user string, l int")
    right = spark.createDataFrame([("a", 8), (None, 9)], "user string, r int")
    assert P.join_on_keys(left, right, ["user"]).count() == 1
    assert P.join_on_keys(left, right, ["user"], null_safe=True).count() == 2


def test_join_refuses_ambiguous_columns(spark):
    left = spark.createDataFrame([("a", 1)], "user string, rating int")
    right = spark.createDataFrame([("a", 2)], "user string, rating int")
    with pytest.raises(ValueError):
        P.join_on_keys(left, right, ["user"])
    j = P.join_on_keys(P.suffix_columns(left, "_x", ["user"]), P.suffix_columns(right, "_y", ["user"]), ["user"])
    assert set(j.columns) == {"user", "rating_x", "rating_y"}


def test_keep_first_explicit_order(spark):
    df = spark.createDataFrame([("u", "i", 3, "c"), ("u", "i", 1, "a"), ("u", "i", 2, "b"), ("v", "i", None, "n")],
                               "user string, item string, pos int, payload string")
    out = {(r.user, r.item): r.payload for r in P.keep_first(df, ["user", "item"], ["pos"]).collect()}
    assert out == {("u", "i"): "a", ("v", "i"): "n"}


def test_report_round_trip(spark, tmp_dir):
    pairs = spark.createDataFrame(
        [("the room was clean", "the room was dirty"), ("first line\nsecond line", "multi\nline too"),
         ("any", "..."), ("kept", "")], "reference string, generated string")
    S.write_report(pairs, f"{tmp_dir}/rep")
    back = sorted((r.reference, r.generated) for r in R.read_report(spark, f"{tmp_dir}/rep").collect())
    assert back == sorted([("the room was clean", "the room was dirty"), ("first line\nsecond line", "multi\nline too"),
                           ("any", "...")])


@pytest.mark.parametrize("text, want", [
    ("Report of run 3\nGround Truth: a\nGenerated: b\n" + "-" * 40 + "\n", [("a", "b")]),
    ("Ground Truth: a\nGenerated: b\n" + "-" * 40, [("a", "b")]),
    ("Ground Truth: a\nGenerated: b\n" + "-" * 30 + "\nGround Truth: c\nGenerated: d\n" + "-" * 40 + "\n", [("a", "b"), ("c", "d")]),
    ("Ground Truth: a\nGenerated: b\n- bullet\n" + "-" * 40 + "\n", [("a", "b")]),
])
def test_report_finds_the_pairs_of_the_record_pattern(spark, tmp_dir, text, want):
    import re

    from revel.functions.text import PAIR_PATTERN

    assert [(a.strip(), b.strip()) for a, b in re.findall(PAIR_PATTERN, text)] == want
    _write(f"{tmp_dir}/rep/report.txt", text)
    assert sorted(tuple(r) for r in R.read_report(spark, f"{tmp_dir}/rep").collect()) == want


def test_missing_report_and_log(spark, tmp_dir):
    assert R.read_report(spark, f"{tmp_dir}/none", missing_ok=True).count() == 0
    assert R.read_run_log(spark, f"{tmp_dir}/none", missing_ok=True).count() == 0
    with pytest.raises(Exception):
        R.read_report(spark, f"{tmp_dir}/none").count()


def test_any_literal_tuple_is_read_as_data(spark):
    import ast

    texts = ["('a', \"it's\", 'x', 1)", "('a', None, 'good', 5)", "['a', True, 'line\\nbreak \\\\ and \\'q\\'', -1.5e3]", '["j", 1, null, true]',
             "()", "('a',)", "('a', ['nested'])", "open('x')", "('a' 'b')"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r.v for r in df.select("id", P.parse_template_string("t").alias("v")).collect()}
    for k in (0, 1, 2, 4, 5):
        assert got[k] == [None if x is None else str(x).replace("1500.0", "1.5e3") for x in ast.literal_eval(texts[k])], texts[k]
    assert got[3] == ["j", "1", None, "true"] and got[6] is None and got[7] is None and got[8] is None


def test_fixtures_reach_every_document_and_benchmark_text(spark):
    from revel.sources import fixtures as fx

    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        docs, bench = (fx.table(spark, sf, t) for t in ("documents", "benchmark"))
        assert fx.keys(spark, sf).selectExpr(f"count(DISTINCT pos % {docs.count()})").first()[0] == docs.count()
        assert fx.keys(spark, sf).selectExpr(f"count(DISTINCT pos % {bench.count()})").first()[0] == bench.count()
    sf = "/root/testdata/sf0.01"
    docs = fx.table(spark, sf, "documents")
    assert fx.interactions(spark, sf).select("text").distinct().count() == docs.select("text").distinct().count()
    assert fx.explanations(spark, sf).where("explanation is not null").select("explanation").distinct().count() == \
        fx.table(spark, sf, "benchmark").select("text").distinct().count()


def test_run_log_both_spellings(spark, tmp_dir):
    log = "\n".join([
        "Loading data", "Epoch 1, Train Loss: 5.1000, Val Loss: 5.0000", "Best model saved!",
        "Epoch: 2, Train Loss: 4.2, Val Loss: 4.0", "Early stopping counter: 1/3",
        "Epoch: 3, Train Loss: 4.0, Val Loss: 4.5",
    ])
    _write(f"{tmp_dir}/logs/run_a.log", log + "\n")
    _write(f"{tmp_dir}/logs/run_b.log", "Epoch 1, Train Loss: 1.0, Val Loss: 2.0\n")
    df = R.read_run_log(spark, f"{tmp_dir}/logs")
    rows = sorted((r.run, r.epoch, r.val_loss) for r in df.collect())
    assert rows == [("run_a.log", 1, 5.0), ("run_a.log", 2, 4.0), ("run_a.log", 3, 4.5), ("run_b.log", 1, 2.0)]


def test_ascii_predicate(spark):
    df = spark.createDataFrame([("",), ("Nice room!",), ("Room 12",), ("café",), ("tab\tand\nnewline",)], "t string")
    from revel.functions.text import is_ascii_text

    got = [r.ok for r in df.select(is_ascii_text("t").alias("ok")).collect()]
    assert got == [True, True, False, False, True]


def test_words_unicode_whitespace(spark):
    from revel.functions.text import strip, words

    df = spark.createDataFrame([("a b  c\t",)], "t string")
    r = df.select(words("t").alias("w"), strip("t").alias("s")).first()
    assert r.w == "a b  c\t".split() and r.s == "a b  c\t".strip()


def test_streaming_report_scoring_matches_batch(spark, tmp_dir):
    from revel.operators import metrics as M
    from revel.streaming.reports import score_reports

    pairs = spark.createDataFrame([("the room was clean", "the room was dirty"), ("clean room", "clean"),
                                   ("good food", "bad service")], "reference string, generated string")
    S.write_report(pairs.limit(2), f"{tmp_dir}/in/a")
    S.write_report(pairs.exceptAll(pairs.limit(2)), f"{tmp_dir}/in/b")
    q = score_reports(spark, f"{tmp_dir}/in/*", f"{tmp_dir}/out", f"{tmp_dir}/ckpt")
    q.awaitTermination(120)
    out = spark.read.parquet(f"{tmp_dir}/out")
    got = sorted((r.reference, round(r.bleu4, 6)) for r in out.collect())
    want = sorted((r.reference, round(r.bleu4, 6)) for r in M.pair_scores(pairs).collect())
    assert got == want


def test_run_log_segments_runs_within_one_file(spark, tmp_dir):
    log = "\n".join(["Epoch 1, Train Loss: 3.0, Val Loss: 3.0", "Epoch 2, Train Loss: 2.0, Val Loss: 2.5",
                     "Early stopping triggered.", "Epoch: 1, Train Loss: 9.0, Val Loss: 8.0",
                     "Epoch: 2, Train Loss: 7.0, Val Loss: 6.0", "Epoch: 3, Train Loss: 5.0, Val Loss: 4.0"])
    _write(f"{tmp_dir}/nl/all_runs.out", log + "\n")
    rows = sorted((r.segment, r.epoch, r.val_loss) for r in R.read_run_log(spark, f"{tmp_dir}/nl").collect())
    assert rows == [(1, 1, 3.0), (1, 2, 2.5), (2, 1, 8.0), (2, 2, 6.0), (2, 3, 4.0)]


def test_cli_eval_report(spark, tmp_dir, capsys):
    from revel.__main__ import main

    sep = "-" * 40 + "\n"
    _write(f"{tmp_dir}/rep/report.txt", "Ground Truth: the room was clean\nGenerated: the room was dirty\n" + sep
           + "Ground Truth: clean room\nGenerated: clean\n" + sep)
    assert main(["eval-report", f"{tmp_dir}/rep"]) == 0
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["n_pairs"] == 2 and out["bleu1"] == pytest.approx((75 + 36.787944) / 2, abs=1e-3)


def test_tuple_template_unescapes_quotes(spark):
    value = 'it\'s "quoted"'  # both quote kinds: repr escapes one of them
    text = repr(("a", "b", value, "d"))
    df = spark.createDataFrame([(1, text)], "id int, template string")
    got = df.select(P.template_item(P.parse_template_string("template")).alias("e")).first().e
    assert got == value


def _parts(path):
    return [f for f in os.listdir(path) if f.startswith("part-")]


def test_packed_texts_come_back_whole_from_bounded_files(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(S, "ROWS_PER_FILE", 100)
    df = spark.range(0, 1000, numPartitions=2).select("id", F.concat(F.lit('a "q",\n b'), F.col("id")).alias("s"))
    want = sorted(map(tuple, df.collect()))
    S.write_csv(df, f"{tmp_dir}/csv", compression=S.PACKED)
    S.write_json_array(df, f"{tmp_dir}/arr", compression=S.PACKED)
    S.write_lines(df.select(F.to_json(F.struct("id", "s"))), f"{tmp_dir}/lines", compression=S.PACKED)
    assert sorted(map(tuple, R.read_csv(spark, f"{tmp_dir}/csv", df.schema).collect())) == want
    arrays = R.read_json_array(spark, f"{tmp_dir}/arr", df.schema)
    assert sorted(map(tuple, arrays.collect())) == want
    lines = R.good_lines(R.read_json_lines(spark, f"{tmp_dir}/lines", {"id": "bigint", "s": "string"}))
    assert sorted(map(tuple, lines.collect())) == want
    assert len(_parts(f"{tmp_dir}/csv")) == len(_parts(f"{tmp_dir}/lines")) == 10
    for kind in ("csv", "arr", "lines"):
        assert all(f.endswith(".gz") for f in _parts(f"{tmp_dir}/{kind}"))


def test_jobs_stage_packed_texts(spark):
    from revel.plans import jobs

    df = spark.range(0, 100, numPartitions=2).select(F.col("id"), F.lit("text").alias("s"))
    staged = [jobs.stage_json_lines(spark, df.select(F.to_json(F.struct("id", "s")).alias("value")), ("t",)), jobs.stage_json_array(spark, df, ("t",))]
    back = jobs._sink_and_reload(spark, df, "t")
    assert back.count() == 100
    for path in (*staged, back.inputFiles()[0].rsplit("/", 1)[0]):
        path = path.removeprefix("file:")
        assert _parts(path) and all(f.endswith(".gz") for f in _parts(path))


def test_each_json_line_is_parsed_once(spark, tmp_dir):
    from revel.sources import readers as R

    lines = ['{"a": 1, "b": "x"}', ' \t{"a": "2"}', '{"a": 3', "[1]", '"s"', "7", "null", "  ", '{"a": {"c": 1}, "b": 5} ', "{}"]
    path = f"{tmp_dir}/lines"
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    read = R.read_json_lines(spark, path, {"a": "bigint", "b": "string"})
    good = R.good_lines(read)
    assert sorted(map(str, good.collect())) == sorted(map(str, spark.createDataFrame(
        [(1, "x"), (2, None), (None, "5"), (None, None)], "a bigint, b string").collect()))
    assert sorted(r[0] for r in R.bad_lines(read).collect()) == sorted(['{"a": 3', "[1]", '"s"', "7", "null"])
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") + plan.count("parse_json") == 1
