"""Fill-in-middle transformation by secondary-sort assembly.

A document is cut at two hashed places into prefix, middle and suffix, and is
written out again with sentinels in another order.  No task builds the new text
in one piece: the scan emits bounded chunks of code points (units) keyed by
document and output position, one exchange deals them by document and sorts
them by position (repartition and sort within partitions, the DataFrame form of
a secondary sort), and a task streams them past an incremental digest.  The
same stream is read back as a consumer would read the output: the sentinels are
found in the running bytes, each run between them becomes a piece of its source
segment, and a second sort within the same partitions (no further exchange)
brings the pieces into source order for the digest of the restored text.  A
task holds one Arrow batch of chunks, whatever the length of a document.

Forms: ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, ``spm`` is
``<S>`` suffix ``<P>`` prefix ``<M>`` middle, ``plain`` is the text itself.

Defined results: a null or empty text is empty and plain; a text that holds a
sentinel is plain; a null id is hashed as the empty string; repeated rows give
equal rows, one for each; an empty table gives no rows.  Pieces are keyed by
128 bits of the id and the text and by the scan's partition, so copies of one
row in many partitions are dealt to as many keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revel.llm.jobs import batch_bytes, schema

#: Sentinels before prefix, suffix and middle (fixed values).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1"
PLAIN_FROM, SPM_BELOW = 90, 20
#: Code points of a chunk.
CHUNK = 2048

KEY = ["k1", "k2", "part"]
_KEY_DDL = "k1 long, k2 long, part int"
_OUT = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long"}
#: What follows each sentinel of a form, as places in the source: 0 prefix, 1 middle, 2 suffix.
_ORDER = {"plain": (), "psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}


def plans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, plain_from: int = PLAIN_FROM,
          spm_below: int = SPM_BELOW) -> DataFrame:
    """``k1, k2, part, id, text, n, form, prefix_chars, middle_chars`` of every row: its cuts and form, from built-in functions."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.xxhash64(id_col, text_col).alias("k1"), F.xxhash64(text_col, F.lit(13), id_col).alias("k2"),
                       F.spark_partition_id().alias("part"), F.col(id_col).alias("id"), text.alias("text"), F.sha2(name, 256).alias("d"))
    draw = [F.conv(F.substring("d", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    rows = rows.select(*KEY, "id", "text", F.char_length("text").cast("long").alias("n"), *(x.alias(f"h{k + 1}") for k, x in enumerate(draw)))
    held = F.lit(False)
    for s in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains("text", F.lit(s))
    plain = (F.col("n") == 0) | held | (F.col("h3") % 100 >= plain_from)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < spm_below, "spm").otherwise("psm"))
    one, two = (F.col(h) % (F.col("n") + 1) for h in ("h1", "h2"))
    cut = F.col("form") != "plain"
    return rows.select(*KEY, "id", "text", "n", "form", F.when(cut, F.least(one, two)).alias("prefix_chars"),
                       F.when(cut, F.abs(one - two)).alias("middle_chars"))


def _cut(text: str, form: str, prefix: int | None, middle: int | None, chunk: int) -> list[str]:
    """The output of one text as chunks of at most ``chunk`` code points and a sentinel."""
    if form == "plain":
        return [text[i:i + chunk] for i in range(0, max(1, len(text)), chunk)]
    ends = (0, prefix, prefix + middle, len(text))
    out = []
    for sentinel, place in _ORDER[form]:
        a, e = ends[place], ends[place + 1]
        out.append(sentinel + text[a:min(e, a + chunk)])
        out += [text[i:min(e, i + chunk)] for i in range(a + chunk, e, chunk)]
    return out


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, **parameters) -> DataFrame:
    """``k1, k2, part, at, id, n, form, prefix_chars, middle_chars, piece``: the chunks of every output, by position ``at``.

    Only the first chunk of a document carries its id and counts."""
    kind = docs.schema[id_col].dataType
    names = [*KEY, "at", "id", *_OUT, "piece"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_cut(*row, chunk) for row in zip(*(batch.column(c).to_pylist() for c in ("text", "form", "prefix_chars", "middle_chars")))]
            size = np.array([len(x) for x in own], np.int64)
            row = np.repeat(np.arange(len(own)), size)
            at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            key = [batch.column(c).take(pa.array(row)) for c in KEY]
            head = [batch.column(c).take(pa.array(row, mask=at > 0)) for c in ("id", *_OUT)]
            yield pa.RecordBatch.from_arrays([*key, pa.array(at), *head, pa.array([x for c in own for x in c], pa.string())], names)

    out = schema({}, _KEY_DDL + ", at long")
    out = out.add("id", kind)
    out = schema({f.name: f.dataType for f in out}, ", ".join(f"{c} {t}" for c, t in _OUT.items()) + ", piece string")
    batch_bytes(docs.sparkSession)
    return plans(docs, id_col, text_col, **parameters).mapInArrow(emit, out)


def in_output_order(cut: DataFrame) -> DataFrame:
    """Chunks dealt by document, in order of output position."""
    return cut.repartition(*KEY).sortWithinPartitions(*KEY, "at")


class Reader:
    """Reads one output, chunk by chunk: gives ``(source segment, bytes)`` runs without the sentinels."""

    def __init__(self, form: str):
        self.coming = [(s.encode(), place) for s, place in _ORDER[form]]
        self.place, self.kept = 0, b""

    def feed(self, piece: bytes) -> Iterator[tuple[int, bytes]]:
        data = self.kept + piece
        self.kept = b""
        while self.coming:
            mark, place = self.coming[0]
            j = data.find(mark)
            if j < 0:
                # a sentinel may go on in the next chunk
                self.kept, data = data[max(0, len(data) - len(mark) + 1):], data[:max(0, len(data) - len(mark) + 1)]
                break
            if j:
                yield self.place, data[:j]
            self.coming, self.place, data = self.coming[1:], place, data[j + len(mark):]
        if data:
            yield self.place, data

    def close(self) -> Iterator[tuple[int, bytes]]:
        if self.kept:
            yield self.place, self.kept


def _rows(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _sent(rows: Iterator[tuple], out: pa.Schema, most_rows: int = 4096, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches bounded by rows and bytes (of their last column)."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or b"")
        if len(held) >= most_rows or size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), out)], schema=out)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), out)], schema=out)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` of every row of ``docs``."""
    kind = docs.schema[id_col].dataType
    cut = pieces(docs, id_col, text_col, **parameters)
    columns = cut.columns

    # segment 3 ends a document: its id, counts, number of copies and the digest of the output
    middle = schema({}, _KEY_DDL + ", segment int, at long")
    middle = middle.add("id", kind)
    middle = schema({f.name: f.dataType for f in middle}, ", ".join(f"{c} {t}" for c, t in _OUT.items()) + ", copies int, piece binary")
    middle_arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in middle])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs() -> Iterator[tuple]:
            now, last = None, -1
            head, sha, reader, copies, sent = (), None, None, 0, 0
            none = (None,) * 6

            def ended() -> Iterator[tuple]:
                nonlocal sent
                for place, data in reader.close():
                    yield (*now, place, sent, *none, data)
                    sent += 1
                yield (*now, 3, 0, *head, copies, sha.digest())

            for k1, k2, part, at, *meta, piece in _rows(batches, columns):
                if (k1, k2, part) != now:
                    if now is not None:
                        yield from ended()
                    now, last, copies, sent = (k1, k2, part), -1, 0, 0
                    head, sha, reader = tuple(meta), hashlib.sha256(), Reader(meta[2])
                copies += at == 0
                if at == last:
                    continue  # the same chunk of an equal row
                last, data = at, piece.encode()
                sha.update(data)
                for place, run in reader.feed(data):
                    yield (*now, place, sent, *none, run)
                    sent += 1
            if now is not None:
                yield from ended()

        yield from _sent(runs(), middle_arrow)

    out = schema({id_col: kind}, ", ".join(f"{c} {t}" for c, t in _OUT.items()) + ", output_sha256 string, restored_sha256 string")
    out_arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in out])
    read = [*KEY, "segment", "id", *_OUT, "copies", "piece"]

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def documents() -> Iterator[tuple]:
            sha = hashlib.sha256()
            for *_, segment, key, n, form, prefix, mid, copies, piece in _rows(batches, read):
                if segment < 3:
                    sha.update(piece)
                    continue
                row = (key, n, form, prefix, mid, piece.hex(), sha.hexdigest())
                sha = hashlib.sha256()
                for _ in range(copies):
                    yield row

        yield from _sent(documents(), out_arrow)

    assembled = in_output_order(cut).mapInArrow(assemble, middle)
    return assembled.sortWithinPartitions(*KEY, "segment", "at").mapInArrow(restore, out)


def outputs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output``: the transformed texts, each put together from its sorted chunks."""
    cut = pieces(docs, id_col, text_col, **parameters)
    columns = cut.columns
    out = schema({id_col: docs.schema[id_col].dataType}, ", ".join(f"{c} {t}" for c, t in _OUT.items()) + ", output string")
    out_arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in out])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def documents() -> Iterator[tuple]:
            now, head, copies, own, last = None, (), 0, [], -1
            for k1, k2, part, at, *meta, piece in _rows(batches, columns):
                if (k1, k2, part) != now:
                    for _ in range(copies):
                        yield (*head, "".join(own))
                    now, head, copies, own, last = (k1, k2, part), tuple(meta), 0, [], -1
                copies += at == 0
                if at != last:
                    own.append(piece)
                    last = at
            for _ in range(copies):
                yield (*head, "".join(own))

        yield from _sent(documents(), out_arrow)

    return in_output_order(cut).mapInArrow(join, out)


def restored(found: DataFrame, form_col: str = "form", output_col: str = "output") -> DataFrame:
    """``found`` with ``restored``: the text read back from output and form alone, in built-in functions."""
    output = F.col(output_col)
    body = F.substring(output, F.lit(4), F.length(output))
    first, rest = (lambda s: F.substring_index(body, s, 1)), (lambda s: F.expr(f"substr({output_col}, 4 + instr(substr({output_col}, 4), '{s}') + 2)"))
    psm = F.concat(first(SUFFIX), F.substring_index(rest(SUFFIX), MIDDLE, -1), F.substring_index(rest(SUFFIX), MIDDLE, 1))
    spm = F.concat(F.substring_index(rest(PREFIX), MIDDLE, 1), F.substring_index(rest(PREFIX), MIDDLE, -1), first(PREFIX))
    return found.withColumn("restored", F.when(F.col(form_col) == "psm", psm).when(F.col(form_col) == "spm", spm).otherwise(output))
