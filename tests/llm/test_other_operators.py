import hashlib
import zlib

import pytest
from common import edge_texts, empty, frame, rows_of

from revel.llm import op06_warc as warc
from revel.llm import op07_shards as shards


def jump(key, n):
    key %= 1 << 64
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one(spark):
    texts = edge_texts()
    docs = frame(spark, texts * 8)
    got = rows_of(shards.assign(docs, 16))
    for k, t in enumerate(texts * 8):
        raw = (t or "").encode()
        r = got[k]
        assert (r["shard"], r["grown_shard"], r["size"], r["text_crc32"], r["law"]) == (jump(k, 16), jump(k, 17), len(raw) + 1, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 16)
    for s in range(16):
        own = sorted((r["slot"], k) for k, r in got.items() if r["shard"] == s)
        assert [x for x, _ in own] == list(range(len(own))) and [k for _, k in own] == sorted(k for _, k in own)


def test_sharding_edges(spark):
    assert shards.assign(empty(spark), 16).count() == 0
    df = spark.createDataFrame([(None, None), (-5, "a"), (-5, "a"), (2**63 - 1, "b"), (-(2**63), "")], "doc_id long, text string")
    got = shards.assign(df, 16).collect()
    assert len(got) == 5 and all(r.shard == jump(r.doc_id or 0, 16) for r in got)
    names = spark.createDataFrame([("x", "a"), ("y", "b")], "doc_id string, text string")
    assert shards.assign(names, 4).count() == 2


def test_sharding_runs_no_python(spark):
    plan = shards.assign(frame(spark, ["a"]), 16)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


PAGE = """<!DOCTYPE html><html lang="en"><head><title> A &amp;
 B </title><style>p{}</style></head><body><script>var t="</p>";</script><!-- no --><p>One&nbsp;two &lt;3 &amp;lt; &#233;&#x1F600;&#0;&#x;</p>
<a class="x" href="/q?a=1">link</a><br>5 < 6<div>end</div></body></html>"""


def test_records_refer_to_their_response(spark):
    pages = spark.createDataFrame([(1, "http://a/", PAGE), (2, None, None), (3, "http://b/", "")], "page_id long, url string, html string")
    source = rows_of(warc.responses(pages, "2024-01-01T00:00:00Z"), "page_id")
    df = warc.derive(warc.responses(pages, "2024-01-01T00:00:00Z"))
    got = {(r.page_id, r.warc_type): r for r in df.withColumn("record", warc.serialized(df)).collect()}
    assert len(got) == 6
    for (page, kind), r in got.items():
        other = got[page, "conversion" if kind == "metadata" else "metadata"]
        assert r.refers_to == source[page]["record_id"] and r.concurrent_to == other.record_id
        assert r.source_payload_digest == "sha256:" + hashlib.sha256(source[page]["payload"].encode()).hexdigest()
        head, _, rest = r.record.partition("\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.split("\r\n")[1:])
        raw = rest.encode()[:int(fields["Content-Length"])]
        assert rest.encode()[len(raw):] == b"\r\n\r\n" and raw.decode() == r.block
        assert fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(raw).hexdigest() and fields["WARC-Refers-To"] == r.refers_to
        assert fields.get("WARC-Target-URI") == source[page]["target_uri"]
    text = got[1, "conversion"].block
    assert text == "One two <3 &lt; é😀�&#x;\nlink\n5 < 6\nend"
    meta = got[1, "metadata"].block.split("\r\n")
    assert "title: A &amp; B" in meta and "language: en" in meta and "outlink: /q?a=1" in meta and "http-header: Content-Type: text/html; charset=utf-8" in meta
    assert f"source-block-digest: {source[1]['block_digest']}" in meta and "http-status: 200" in meta
    assert got[2, "conversion"].block == ""


@pytest.mark.parametrize("n", [0])
def test_warc_of_no_pages(spark, n):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.derive(warc.responses(pages, "d")).count() == n


def test_pages_are_stripped_once_and_references_resolved(spark):
    """Tags are taken out in one expression, and the digests read the strings as they are."""
    cases = {"&&amp;;&;x&lt": "&&;&;x&lt", "&#38;lt; &amp;lt; &amp;amp;": "< &lt; &amp;", "&l&nbsp;t; &Copy; &copy;c &hellip": "&l t; &Copy; ©c &hellip",
             "a \t b\r\n\n c&nbsp;&nbsp;d\x0ce": "a b\nc d e", "&é;&euro;&#0;&#x41;": "&é;€�A"}
    pages = spark.createDataFrame([(k, "u", html) for k, html in enumerate(cases)], "page_id long, url string, html string")
    df = warc.derive(warc.responses(pages, "d"))
    got = {r.page_id: r.block for r in df.where("warc_type = 'conversion'").collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("<head") == 1 and "encode(" not in plan
