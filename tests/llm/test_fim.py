import hashlib

import pytest
from common import edge_texts, empty, frame, rows_of

from revel.llm import op13_fim as fim

ODD = ["a<P>b", "x<", "<S", "S>" * 50, "<<<<P<M" * 30, "é😀" * 3000, "P><M<S>"]


def brute(key, text):
    """The contract, on one whole text."""
    text = text or ""
    n, d = len(text), hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(d[8 * k:8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return {"n": n, "form": "plain", "prefix_chars": None, "middle_chars": None}, text
    a, e = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        form, out = "spm", "<S>" + text[e:] + "<P>" + text[:a] + "<M>" + text[a:e]
    else:
        form, out = "psm", "<P>" + text[:a] + "<S>" + text[e:] + "<M>" + text[a:e]
    return {"n": n, "form": form, "prefix_chars": a, "middle_chars": e - a}, out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("chunk", [3, 2048])
def test_digests_and_outputs_match_brute_force(spark, chunk):
    texts = edge_texts() + ODD
    docs = frame(spark, texts)
    got = rows_of(fim.digests(docs, chunk=chunk))
    out = rows_of(fim.restored(fim.outputs(docs, chunk=chunk)))
    assert len(got) == len(out) == len(texts)
    forms = set()
    for k, t in enumerate(texts):
        want, text = brute(k, t)
        assert got[k] == {"doc_id": k, **want, "output_sha256": sha(text), "restored_sha256": sha(t or "")}
        assert (out[k]["output"], out[k]["restored"]) == (text, t or "")
        forms.add(want["form"])
    assert forms == {"plain", "psm", "spm"}


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = frame(spark, edge_texts()).select("doc_id", "text")
    twice = docs.unionByName(docs).unionByName(docs.where("doc_id < 10"))
    assert fim.digests(twice).groupBy("doc_id").count().where("doc_id >= 10 and count != 2 or doc_id < 10 and count != 3").count() == 0
    odd = spark.createDataFrame([(None, None), (None, "abc"), (7, "one"), (7, "two")], "doc_id long, text string")
    got = sorted(r.restored_sha256 for r in fim.digests(odd).collect())
    assert got == sorted(sha(t) for t in ("", "abc", "one", "two"))
    assert fim.digests(empty(spark)).count() == fim.outputs(empty(spark)).count() == 0


def test_reader_finds_sentinels_across_chunks():
    text = "<P>ab<<S>cd<M<M>e>"
    for size in range(1, len(text) + 1):
        reader, got = fim.Reader("psm"), {0: b"", 1: b"", 2: b""}
        for i in range(0, len(text), size):
            for place, run in reader.feed(text[i:i + size].encode()):
                got[place] += run
        for place, run in reader.close():
            got[place] += run
        assert got == {0: b"ab<", 1: b"e>", 2: b"cd<M"}


def test_one_exchange_carries_the_pieces(spark):
    plan = fim.digests(frame(spark, ["a b c"]).select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(k1") == 1
