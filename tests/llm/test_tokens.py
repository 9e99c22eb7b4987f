import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from common import edge_texts, empty, frame

from revel.llm import arrays as A
from revel.llm import op03_packing as packing
from revel.llm import op05_tokens as files
from revel.llm import tokens


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_units_give_the_ids_of_whole_texts(whole):
    r = random.Random(5)
    chars = "abcXYZéßÉ日本 \t\n.,;:!?|'\"<>()[]0123-_/\\́  Σς😀@#$%^&*~`"
    texts = edge_texts(3) + ["".join(r.choice(chars) for _ in range(r.randint(0, 200))) for _ in range(500)]
    marks = ["<|ENDOFTEXT|>", "<|endoftext|>", "<|EndOfText|>", "<|STARTOFTEXT|>", "<|startoftext|>", "<|startofTEXT|>", "<|", "|>", "a", "B ", " ", "."]
    texts += ["<|ENDOFTEXT|> b"] + ["".join(r.choice(marks) for _ in range(r.randint(1, 8))) for _ in range(400)]
    buf, off = A.utf8(pa.array([t or "" for t in texts]))
    ids, at = tokens.encoder(tokens.default_path()).encode(buf, off)
    for k, t in enumerate(texts):
        assert ids[at[k]:at[k + 1]].tolist() == whole(t), repr(t)[:200]


def crc(ids):
    return zlib.crc32(np.array(ids, np.uint32).tobytes())


def test_token_files_round_trip(spark, whole, tmp_dir):
    texts = edge_texts()
    files.write(frame(spark, texts), f"{tmp_dir}/t")
    got = sorted(files.digests(spark, f"{tmp_dir}/t").collect())
    start = 0
    for (doc, s, n, c), (k, t) in zip(got, enumerate(texts), strict=True):
        ids = whole(t)
        assert (doc, s, n, c) == (k, start, len(ids), crc(ids))
        start += len(ids)
    assert [tuple(r) for r in sorted(files.numbers(spark, f"{tmp_dir}/t").collect())] == [tuple(r[:3]) for r in got]
    assert [r.ids for r in files.read(spark, f"{tmp_dir}/t", 3, 5).orderBy("doc_id").collect()] == [whole(t) for t in texts[3:6]]


def test_token_files_have_indexes_and_asked_encodings(spark, tmp_dir):
    import glob

    import pyarrow.parquet as pq

    files.write(frame(spark, edge_texts(), 1), f"{tmp_dir}/t")
    meta = pq.ParquetFile(glob.glob(f"{tmp_dir}/t/*.parquet")[0]).metadata.row_group(0)
    col = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in col["doc_id"].encodings and "DELTA_BINARY_PACKED" in col["file_start"].encodings
    assert any("DICTIONARY" in e for e in col["ids.list.element"].encodings)
    assert col["doc_id"].has_column_index and col["ids.list.element"].has_offset_index


def test_numbers_read_no_token_page(spark, tmp_dir):
    files.write(frame(spark, edge_texts(), 1), f"{tmp_dir}/t")
    plan = files.numbers(spark, f"{tmp_dir}/t")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_empty_tables(spark, tmp_dir):
    files.write(empty(spark), f"{tmp_dir}/t")
    assert files.digests(spark, f"{tmp_dir}/t").count() == 0
    assert packing.pack_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("most", [16, 4096])
def test_packing_is_gapless_and_whole(spark, whole, most):
    texts = edge_texts()
    got = packing.pack_documents(frame(spark, texts), most).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert len(by_doc) == len(texts)
    for k, t in enumerate(texts):
        ids = whole(t)
        parts = sorted(by_doc[k], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(-(-len(ids) // most)))
        for p in parts:
            own = ids[p.piece * most:(p.piece + 1) * most]
            assert (p.start, p.length, p.ids_crc32) == (p.piece * most, len(own), crc(own))
    for parts in by_seq.values():
        place = 0
        for p in sorted(parts, key=lambda r: r.offset):
            assert p.offset == place
            place += p.length
        assert place <= most
    if most == 16:
        total = sum(r.length for r in got)
        assert len(by_seq) <= total / most * 1.05 + 2


def test_repeated_rows_are_pieces_of_their_own(spark):
    df = frame(spark, ["a b c"] * 5)
    got = packing.pack_documents(df.unionByName(df), 8).collect()
    assert len(got) == 10 and len({(r.sequence_id, r.offset) for r in got}) == 10


def test_plan_is_near_the_bound_and_uses_patterns():
    rng = np.random.default_rng(0)
    length = np.clip(rng.lognormal(6, 1.2, 50_000).astype(int), 1, 4096)
    n, c = np.unique(length, return_counts=True)
    rows = packing.plan(dict(zip(n.tolist(), c.tolist())), 4096)
    assert sum(r[2] for r in rows) == len(length)
    sequences = max(r[3] + r[2] for r in rows)
    assert sequences <= length.sum() / 4096 * 1.01 + 1
    shapes = packing.patterns(8, 3)
    assert all((p * np.arange(1, 9)).sum() == 8 and p.sum() <= 3 for p in shapes) and len(shapes) == 10
    x = packing.nnls(shapes, (shapes.T @ np.arange(10)).astype(float), 3000)
    assert (x >= 0).all() and np.allclose(shapes.T @ x, shapes.T @ np.arange(10), atol=0.05)


def test_packing_encodes_texts_in_small_chunks(monkeypatch):
    import pyarrow as pa
    from pyspark.sql import types as T

    from revel.llm import op03_packing as packing
    from revel.llm import tokens

    class Docs:
        """Takes the task's function out of ``pieces``."""
        sparkSession = type("S", (), {"conf": {"spark.sql.execution.arrow.maxBytesPerBatch": "1b"}})()
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
        select = lambda self, *c: self
        mapInArrow = lambda self, task, shape: task

    seen = []
    encode = tokens.Encoder.encode
    monkeypatch.setattr(tokens.Encoder, "encode", lambda self, buf, off, end: (seen.append(len(buf)), encode(self, buf, off, end))[1])
    texts = [f"word{i} other words " * 1000 for i in range(100)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(100)), "text": texts})
    out = pa.Table.from_batches(packing.pieces(Docs(), 4096)(iter([batch])))
    assert max(seen) <= 512 << 10 and sum(seen) == sum(map(len, texts))
    enc = tokens.encoder(tokens.default_path())
    assert (enc.known[0][1:] > enc.known[0][:-1]).all() and len(enc.code) == enc.known.shape[1]
    whole = [len(enc.tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in texts]
    sizes = out.group_by("doc_id").aggregate([("length", "sum")]).sort_by("doc_id")
    assert sizes.column("length_sum").to_pylist() == whole
