"""Physical-plan checks: pushdown, pruning, and no extra exchanges."""

from revel.operators import prep as P
from revel.sources import fixtures as fx
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_fixture_scan_pushes_filter_and_prunes_columns(spark):
    plan = _plan(fx.explanations(spark, SF_SMALL).where("attribute = 'click'").select("pos", "item_key"))
    assert "EqualTo(event_type,click)" in plan
    events_scan = [line for line in plan.splitlines() if "events.parquet" in line or "ReadSchema" in line]
    assert all("value" not in line and "ts:" not in line for line in events_scan)


def test_first_pairs_of_a_hot_key_stay_linear(spark):
    left = spark.range(10_000).selectExpr("id AS e_pos", "'u' AS user", "'i' AS item")
    right = spark.range(10_000).selectExpr("id + 5 AS r_pos", "'u' AS user", "'i' AS item", "cast(id AS string) AS text")
    out = P.first_pairs(left, right, "e_pos", "r_pos")
    assert [tuple(r) for r in out.select("e_pos", "r_pos", "text").collect()] == [(0, 5, "0")]
    plan = _plan(out)
    assert plan.index("Join") < plan.index("Aggregate")  # the join stands above: it sees one row a key


def test_first_pairs_pack_texts_and_sort_none_before_the_shuffle(spark):
    long = "Ünïted 'tëxt' " * 200
    left = spark.createDataFrame([("u", "i", 3, "c"), ("u", "i", 1, None), ("v", "i", None, "n"), ("w", "i", 5, long), ("w", "i", 5, long),
                                  (None, "i", 0, "x")], "user string, item string, e_pos int, explanation string")
    right = spark.createDataFrame([("u", "i", 9, "late", 1.0), ("u", "i", 2, long, 2.0), ("v", "i", 4, None, None), ("v", "i", None, "z", 3.0),
                                   ("w", "i", 7, "", 4.0), (None, "i", 0, "x", 5.0)], "user string, item string, r_pos int, text string, rating double")
    out = P.first_pairs(left.repartition(3), right.repartition(3), "e_pos", "r_pos").select("user", "e_pos", "explanation", "r_pos", "text", "rating")
    assert sorted(map(tuple, out.collect())) == [("u", 1, None, 2, long, 2.0), ("v", None, "n", 4, None, None), ("w", 5, long, 7, "", 4.0)]
    plan = _plan(P.first_pairs(left, right, "e_pos", "r_pos"))
    below = plan[plan.rindex("Exchange hashpartitioning"):]
    assert "Aggregate" not in below and "MapInArrow" in below
    kept = P.KEPT_KEYS
    try:
        P.KEPT_KEYS = 2  # a task that forgets keys passes more rows on, and the result is the same
        many = spark.range(600, numPartitions=1).selectExpr("id AS e_pos", "cast(id % 7 AS string) AS user", "'i' AS item", "repeat('t', cast(id AS int)) AS a")
        other = many.withColumnsRenamed({"e_pos": "r_pos", "a": "b"})
        got = P.first_pairs(many, other, "e_pos", "r_pos").select("user", "e_pos", "r_pos", "a", "b").collect()
        assert sorted(map(tuple, got)) == [(str(k), k, k, "t" * k, "t" * k) for k in range(7)]
    finally:
        P.KEPT_KEYS = kept


def test_no_forced_shuffle_in_text_metrics(spark):
    from revel.plans.catalog import QUERIES

    assert "RoundRobinPartitioning" not in _plan(QUERIES["met_bleu_4"](spark, SF_SMALL))
    enc = _plan(QUERIES["tok_encode"](spark, SF_SMALL))
    assert "REPARTITION" not in enc


def test_keep_first_reuses_join_partitioning(spark):
    prev = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(0, 1000).selectExpr("id AS e_pos", "cast(id % 37 AS string) AS user",
                                              "cast(id % 11 AS string) AS item", "'x' AS explanation")
        right = spark.range(0, 1000).selectExpr("id AS r_pos", "cast(id % 37 AS string) AS user",
                                               "cast(id % 11 AS string) AS item", "'t' AS text")
        out = P.keep_first(P.join_on_keys(left, right), ["user", "item"], ["e_pos", "r_pos"])
        plan = _plan(out)
        assert plan.count("Exchange hashpartitioning") == 2  # the two join inputs only
    finally:
        for k, v in prev.items():
            spark.conf.set(k, v)


def test_heads_keep_first_tokens_and_count_all(spark):
    from revel.operators import tokens as TK

    df = spark.createDataFrame([(1, "a b c a", None), (2, None, "x"), (3, "b b", "x y")], "k long, text string, other string").coalesce(1)
    kept = TK.KEPT_TOKENS
    try:
        TK.KEPT_TOKENS = 1
        out = TK.heads(df, {"text": 2, "other": 5}).collect()
    finally:
        TK.KEPT_TOKENS = kept
    assert [(r.k, r.text, r.other) for r in out if r._token is None] == [(1, ["a", "b"], []), (2, [], ["x"]), (3, ["b", "b"], ["x", "y"])]
    counted = TK.heads(df.repartition(3), {"text": 2, "other": 5})
    for c in ("text", "other"):
        want = sorted(map(tuple, TK.build_vocab(df, [c], 10).collect()))
        assert sorted(map(tuple, TK.build_vocab(counted, [c], 10, counted=True).collect())) == want


def test_narrow_ids_come_back_padded(spark):
    from pyspark.sql import functions as F

    from revel.operators import tokens as TK

    for size in (65536, 70000):
        df = spark.createDataFrame([([2, size - 1, 3],), ([2, 3],)], "ids array<long>").coalesce(1)
        out = df.select(TK.narrow_ids("ids", size).alias("n")).select(F.length("n").alias("bytes"), TK.wide_ids("n", size, 4).alias("ids")).collect()
        each = 2 if size == 65536 else 4
        assert [tuple(r) for r in out] == [(3 * each, [2, size - 1, 3, 0]), (2 * each, [2, 3, 0, 0])]


def test_training_table_writes_no_whole_text(spark, monkeypatch):
    from revel.plans import q_vectors as Q

    written = {}
    keep = Q.materialized
    monkeypatch.setattr(Q, "materialized", lambda df, name, **kw: written.setdefault(name, keep(df, name, **kw)) if name == "first-pairs" else keep(df, name, **kw))
    Q.training_table(spark, SF_SMALL)
    longest = written["first-pairs"].selectExpr("max(size(text))").first()[0]
    assert 0 < longest <= Q.SRC_LEN - 2


def _joined_lines(spark, tmp_dir):
    """Packed review lines, whose file says little of their size, and explanation records."""
    from revel.plans import jobs as J
    from revel.sources import readers as R
    from revel.sources import sinks as S

    text = "a review 'of' some words " * 40
    lines = spark.range(300).selectExpr(f"""to_json(named_struct('pos', id, 'reviewerID', concat('u', id % 100), 'asin', 'i', 'reviewText', concat(id, '{text.replace("'", "")}'),
        'user_id', concat('u', id % 100), 'business_id', 'i', 'text', concat(id, ' text'), 'overall', 1.0D, 'stars', 2.0D)) AS value""")
    S.write_lines(lines, f"{tmp_dir}/lines", compression=S.PACKED)
    expl = spark.range(150).selectExpr("id AS pos", "concat('u', id) AS user", "'i' AS item", "array('a', 'x', concat('e', id), '1') AS template", "3.0D AS rating")
    return lambda fields: R.good_lines(R.read_json_lines(spark, f"{tmp_dir}/lines", fields)), expl, J


def test_prepare_movies_broadcasts_no_texts(spark, tmp_dir):
    reviews, expl, jobs = _joined_lines(spark, tmp_dir)
    out = jobs.prepare_movies_frames(reviews(jobs.MOVIE_FIELDS), expl, "pos", "pos")
    assert "Broadcast" not in _plan(out)
    rows = {r.user: r for r in out.collect()}
    assert len(rows) == 150 and rows["u7"].text.startswith("7a review") and rows["u120"].text is None


def test_prepare_restaurants_broadcasts_no_texts(spark, tmp_dir):
    reviews, expl, jobs = _joined_lines(spark, tmp_dir)
    out = jobs.prepare_restaurants_frames(reviews(jobs.RESTAURANT_FIELDS), expl)
    assert "Broadcast" not in _plan(out)
    rows = sorted((r.user, r.text) for r in out.collect())
    assert len(rows) == 300 and rows[0] == ("u0", "0 text") and rows[1] == ("u0", "100 text")


def test_hashed_join_carries_long_texts_packed(spark):
    long = "Ünïted 'tëxt' " * 200
    left = spark.createDataFrame([("u", 1, "e"), ("u", 2, None), ("v", 3, "f"), (None, 4, "g")], "user string, e_pos int, explanation string")
    right = spark.createDataFrame([("u", 5, long), ("u", 6, None), ("w", 7, "x"), (None, 8, "y"), ("u", 9, "")], "user string, r_pos int, text string")
    rows = lambda how: sorted(((r.e_pos, r.r_pos, r.explanation, r.text) for r in P.join_on_keys(left, right, ["user"], how, hashed=True).collect()), key=str)
    inner = [(e, r, x, t) for e, x in ((1, "e"), (2, None)) for r, t in ((5, long), (6, None), (9, ""))]
    assert rows("inner") == sorted(inner, key=str)
    assert rows("left") == sorted([*inner, (3, None, "f", None), (4, None, "g", None)], key=str)
    plan = _plan(P.join_on_keys(left, right, ["user"], hashed=True))
    assert "ShuffledHashJoin" in plan and "ArrowEvalPython [_packed" in plan[plan.rindex("Exchange hashpartitioning"):]
