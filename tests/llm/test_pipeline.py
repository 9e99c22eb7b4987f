import random

import pytest
from common import edge_texts, empty
from test_text_operators import components, hits

import corpus_pipeline as pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    r = random.Random(4)
    en = ["the", "house", "is", "by", "water", "and", "they", "walked", "with", "others", "through", "morning"]
    fr = ["le", "chat", "dans", "maison", "avec", "une", "petite", "fleur", "bleue", "sous", "arbre", "qui"]
    prose = lambda v, k: " ".join(r.choice(v) + str(r.randrange(90)) if r.random() < 0.2 else r.choice(v) for _ in range(k))
    texts = [(prose(en, r.randint(30, 200)), "en") for _ in range(30)] + [(prose(fr, r.randint(30, 200)), "fr") for _ in range(30)]
    texts = [(t + "\nfooter of all the sites", lang) if i % 2 else (t, lang) for i, (t, lang) in enumerate(texts)]
    texts += [(texts[3][0] + " more", "en"), (texts[3][0], "en"), (None, "en"), ("", "en"), ("123 ... 456", "en"), ("footer of all the sites", "en"),
              ("жшщ " * 200, "en"), ("house", "en")]
    bench = [(1, " ".join(texts[8][0].split(" ")[5:40])), (2, prose(en, 50))]
    docs = [(i, t, lang, f"s{i % 20}", len(t or "")) for i, (t, lang) in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, bench


def test_each_stage_on_what_the_last_kept(spark, folder):
    path, texts, bench = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    by_name = dict(pipeline.STAGES)

    def run(name, docs):
        out = by_name[name](spark, docs, path).checkpoint()
        if name != "best-fit packing":
            assert out.columns == columns and dict(out.dtypes) == dict(docs.dtypes)
            assert all(r.n_chars == len(r.text) for r in out.collect())
        return out, {r.doc_id: r for r in out.collect()}

    docs, kept = run("language ID", docs)
    assert set(range(60)) <= set(kept) and not {62, 63, 64} & set(kept)

    docs, lines = run("line dedup", docs)
    assert set(kept) - set(lines) == {65}
    for k, r in lines.items():
        want = kept[k].text
        assert r.text == (want if k == 1 else "\n".join(x for x in want.split("\n") if x != "footer of all the sites"))

    docs, first = run("n-gram Jaccard join", docs)
    ids = sorted(lines)
    assert sorted(first) == sorted({ids[c] for _, c in components([lines[k].text for k in ids])})

    docs, clean = run("benchmark decontamination", docs)
    for k, r in first.items():
        n, hit, _, _ = hits(r.text, bench)
        assert (k in clean) == (not (hit and 20 * hit >= n))
        if not hit:
            assert clean[k].text == r.text

    packed, _ = run("best-fit packing", docs)
    assert {r.doc_id for r in packed.collect()} == set(clean)
    whole = sorted(map(tuple, pipeline.run(spark, path).select("doc_id", "piece", "length", "ids_crc32").collect()))
    assert whole == sorted(map(tuple, packed.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_pipeline_of_nothing(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").where("false")
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, path)
        assert out.count() == 0


def test_stages_keep_repeated_and_odd_rows(spark, folder):
    path, _, _ = folder
    docs = spark.createDataFrame([(i % 50, t, "en", None, 0) for i, t in enumerate(edge_texts())],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, path)
        assert out.count() > 0, name
        if out.columns == docs.columns:
            docs = out.checkpoint()
    assert empty(spark).count() == 0
