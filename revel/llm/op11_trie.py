"""Conversation prefix trie by depth-band rollup.

Every distinct sequence of first turns of the conversations is a node, from the
root (no turn) on.  Depth is counted in bands of ``height`` turns:

* Turns are numbered by one range sort of all turns (a conversation of very
  many turns spreads over many tasks).  A node's key is the 128-bit exclusive or
  of position-dependent turn hashes; it is summed up inside a band, then over
  bands, then over bands of bands, so no task ever holds more than ``height``
  turns of a conversation.
* Equal keys aggregate to a node, which keeps the keys of its ancestors *within
  its band*.  It explodes to those only: at most ``height`` rows, summed before
  and after the shuffle.
* The root of a band then holds the total of its subtree inside the band.  Band
  roots form a trie of their own, a ``height``-th as deep, whose totals are
  found in the same way; a completed total is then added to all nodes of the
  band above that lead to it.  So the number of rounds is the logarithm of the
  greatest depth to the base ``height``.
* The ids of the conversations that end at a node are sorted by one range
  exchange, cut into blocks, and only the blocks of nodes that reach over a
  task's edge or a block's size are streamed past a digest by node.

Defined results: turns are ordered by number (null first), equal numbers by
role, then by hashes of the turn; a null role or text is empty; rows with a
null conversation id belong to no conversation and are left out; repeated rows
are turns of their own; an empty table gives no rows (not even a root).
Remainders are Spark's: those of a negative id are negative.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revel.llm.jobs import written
from revel.operators.index import dense_index

HEIGHT = 32
#: Ids of a block, in bytes of their decimal text.
BLOCK = 1 << 16

_KEY = ["kx", "ky"]


def _turns(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``c, i, x, y, chars``: every turn with its place ``i`` among all turns, two hashes and its code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("x"),
        F.xxhash64(text, F.lit(11), role).alias("y"), F.char_length(text).cast("long").alias("chars"))
    return dense_index(rows, ["c", "turn", "role", "x", "y"], "i").select("c", "i", "x", "y", "chars")


def rebuilt(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
            group: int = 100, heads: int = 6) -> DataFrame:
    """``c, len, e, x, y, chars``: the turns ``e`` (1 to ``len``) of every rebuilt conversation, and a row with ``e`` 0 for each.

    Conversation ``c`` takes its first ``h`` turns from conversation ``c - c % group`` and the rest from itself, where ``h`` is
    the crc32 of its decimal id modulo ``heads``."""
    turns = _turns(conversations, id_col, turn_col, role_col, text_col)
    own = turns.groupBy("c").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n"))
    own = written(own.withColumn("h", F.crc32(F.encode(F.col("c").cast("string"), "UTF-8")) % heads), "conversations")
    # at most heads - 1 turns of the first conversation of each group
    lead = turns.join(own.where(F.col("c") % group == 0).select("c", "first"), "c").where(F.col("i") - F.col("first") < heads - 1)
    lead = lead.groupBy(F.col("c").alias("base")).agg(F.sort_array(F.collect_list(F.struct("i", "x", "y", "chars"))).alias("lead"))
    convs = own.withColumn("base", F.col("c") - F.col("c") % group).join(lead, "base", "left")
    k = F.least("h", F.coalesce(F.array_size("lead"), F.lit(0)).cast("long"))
    convs = convs.withColumn("k", k).withColumn("len", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = written(convs.select("c", "first", "n", "h", "k", "len", F.slice("lead", 1, F.col("k").cast("int")).alias("lead")), "rebuilt")
    root = F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"),
                    F.lit(0).cast("long").alias("chars"))
    front = convs.select("c", "len", F.posexplode(F.concat(F.array(root), F.coalesce("lead", F.array()))).alias("e", "t"))
    front = front.select("c", "len", F.col("e").cast("long").alias("e"), "t.x", "t.y", "t.chars")
    rest = turns.join(convs.where("n > h").select("c", "first", "h", "k", "len"), "c").where("i - first >= h")
    return front.unionByName(rest.select("c", "len", F.expr("k + i - first - h + 1").alias("e"), "x", "y", "chars"))


def _running(name: str) -> str:
    """SQL: running exclusive or of ``x, y`` over the array of structs ``name``."""
    return f"""aggregate({name}, cast(array() as array<struct<e: bigint, kx: bigint, ky: bigint, chars: bigint>>),
        (done, t) -> concat(done, array(named_struct('e', t.e, 'kx', coalesce(try_element_at(done, -1).kx, 0L) ^ t.x,
                                                     'ky', coalesce(try_element_at(done, -1).ky, 0L) ^ t.y, 'chars', t.chars))))"""


def _entries(totals: DataFrame, height: int, deepest: int) -> DataFrame:
    """``c, band, ex, ey``: the exclusive or of a conversation's ``totals`` (``c, band, x, y``) of bands before each."""
    listed = totals.select("c", F.expr(f"band div {height}").alias("g"), F.struct(F.col("band").alias("e"), "x", "y", F.lit(0).cast("long").alias("chars")).alias("t"))
    groups = listed.groupBy("c", "g").agg(F.sort_array(F.collect_list("t")).alias("own")).withColumn("own", F.expr(_running("own")))
    if deepest < height:
        groups = groups.withColumns({"ex": F.lit(0).cast("long"), "ey": F.lit(0).cast("long")})
    else:
        groups = written(groups, "groups")
        upper = groups.select("c", F.col("g").alias("band"), F.element_at("own", -1).kx.alias("x"), F.element_at("own", -1).ky.alias("y"))
        groups = groups.join(_entries(upper, height, deepest // height).withColumnRenamed("band", "g"), ["c", "g"], "left").withColumns(
            {k: F.coalesce(k, F.lit(0).cast("long")) for k in ("ex", "ey")})
    before = {k: F.expr(f"e{k[1]} ^ coalesce(try_element_at(own, p).{k}, 0L)") for k in _KEY}
    rows = groups.select("c", "ex", "ey", "own", F.posexplode("own").alias("p", "t")).where("p > 0 or ex != 0 or ey != 0")
    # element p (from 1) is the one before place p (from 0)
    rows = rows.withColumns({k: F.when(F.col("p") == 0, F.col(f"e{k[1]}")).otherwise(before[k]) for k in _KEY})
    return rows.select("c", F.col("t.e").alias("band"), F.col("kx").alias("ex"), F.col("ky").alias("ey"))


def banded(steps: DataFrame, height: int, deepest: int) -> DataFrame:
    """``c, len, band, ex, ey, own``: a conversation's nodes in each band, as ``(e, kx, ky, chars)`` in order, and the key of the
    node before the band."""
    # the same turn at another depth has another hash; the root has none
    marked = {"x": F.when(F.col("e") > 0, F.xxhash64("e", "x", "y")).otherwise(0), "y": F.when(F.col("e") > 0, F.xxhash64("y", "e", "x")).otherwise(0)}
    listed = steps.select("c", "len", F.expr(f"e div {height}").alias("band"), F.struct("e", marked["x"].alias("x"), marked["y"].alias("y"), "chars").alias("t"))
    bands = listed.groupBy("c", "band").agg(F.first("len").alias("len"), F.sort_array(F.collect_list("t")).alias("own"))
    bands = bands.withColumn("own", F.expr(_running("own")))
    if deepest < height:
        return written(bands.withColumns({"ex": F.lit(0).cast("long"), "ey": F.lit(0).cast("long")}), "bands")
    bands = written(bands, "bands")
    end = F.element_at("own", -1)
    totals = bands.where(f"len >= {height}").select("c", "band", end.kx.alias("x"), end.ky.alias("y"))
    bands = bands.join(_entries(totals, height, deepest // height), ["c", "band"], "left").withColumns(
        {k: F.coalesce(k, F.lit(0).cast("long")) for k in ("ex", "ey")})
    return written(bands.withColumn("own", F.expr(
        "transform(own, t -> named_struct('e', t.e, 'kx', t.kx ^ ex, 'ky', t.ky ^ ey, 'chars', t.chars))")), "keyed-bands")


def _path(place: str) -> str:
    """SQL: the keys of the elements of ``own`` before ``place`` (from 0)."""
    return f"transform(slice(own, 1, {place}), t -> named_struct('kx', t.kx, 'ky', t.ky))"


def _nodes(bands: DataFrame) -> DataFrame:
    """``kx, ky, e, conv_id, n_convs, n_ends, chars, path, ux, uy`` of every distinct key: ``path`` has its ancestors in its band,
    ``ux, uy`` is its parent."""
    rows = bands.select("c", "len", "ex", "ey", "own", F.posexplode("own").alias("p", "t"))
    rows = rows.select("t.kx", "t.ky", "t.e", "t.chars", "c", (F.col("t.e") == F.col("len")).cast("long").alias("end"), "ex", "ey", F.expr(_path("p")).alias("path"))
    # all rows of a key agree on what stands before it
    nodes = rows.groupBy(*_KEY).agg(F.first("e").alias("e"), F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("end").alias("n_ends"),
                                    F.first("chars").alias("chars"), F.first("path").alias("path"), F.first("ex").alias("ex"), F.first("ey").alias("ey"))
    parent = {k: F.coalesce(F.expr(f"try_element_at(path, -1).{k}"), F.col(f"e{k[1]}")) for k in _KEY}
    return nodes.select(*_KEY, "e", "conv_id", "n_convs", "n_ends", "chars", "path", parent["kx"].alias("ux"), parent["ky"].alias("uy"))


def _summed(rows: DataFrame, sums: list[str]) -> DataFrame:
    return rows.groupBy(*_KEY).agg(*(F.sum(s).alias(s) for s in sums))


def rollup(nodes: DataFrame, bands: DataFrame, sums: list[str], height: int, deepest: int) -> DataFrame:
    """``kx, ky`` and the ``sums`` over each node's whole subtree, from the nodes' own (``kx, ky, path`` and ``sums``)."""
    each = F.explode(F.concat("path", F.array(F.struct(*_KEY)))).alias("to")
    inner = _summed(nodes.select(each, *sums).select("to.*", *sums), sums)
    if deepest < height:
        return inner
    inner = written(inner, "inner")
    # band roots: the first node of each band, and the nodes of the band above it, which all lead to it
    deep = bands.where(f"len >= {height}")
    tops = deep.select("c", F.expr(f"len div {height}").alias("len"), "band", F.expr("own[0].kx").alias("kx"), F.expr("own[0].ky").alias("ky"))
    upper = tops.groupBy("c", F.expr(f"band div {height}").alias("g")).agg(F.first("len").alias("len"), F.sort_array(F.collect_list(
        F.struct(F.col("band").alias("e"), *_KEY, F.lit(0).cast("long").alias("chars")))).alias("own")).withColumnRenamed("g", "band")
    upper = written(upper, "band-roots")
    rows = upper.select("own", F.posexplode("own").alias("p", "t")).select("t.kx", "t.ky", F.expr(_path("p")).alias("path"))
    roots = rows.groupBy(*_KEY).agg(F.first("path").alias("path")).join(inner, _KEY)
    done = rollup(written(roots, "roots"), upper, sums, height, deepest // height)
    above = deep.select("c", (F.col("band") + 1).alias("band"), F.expr(_path("size(own)")).alias("above"))
    above = tops.join(above, ["c", "band"]).groupBy(*_KEY).agg(F.first("above").alias("above"))
    carried = above.join(done, _KEY).select(F.explode("above").alias("to"), *sums).select("to.*", *sums)
    return _summed(inner.unionByName(_summed(carried, sums)), sums)


def ends_digest(ends: DataFrame) -> DataFrame:
    """``kx, ky, ends_sha256`` of the ids ``c`` of each key, ascending and joined by commas."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # ids of a key in blocks; a key inside the task whose ids fit one block is closed here
        out, size, edge = [], 0, True
        now, first, ids, held, opened = None, 0, [], 0, False

        def block(last: bool) -> None:
            nonlocal size
            text = ",".join(ids)
            whole = not (opened or edge or last)
            out.append((*now, first, hashlib.sha256(text.encode()).hexdigest() if whole else None, None if whole else text))
            size += 64 if whole else len(text)

        for batch in batches:
            for kx, ky, c in zip(*(batch.column(k).to_pylist() for k in (*_KEY, "c"))):
                if (kx, ky) != now:
                    if now is not None:
                        block(False)
                        edge = False
                    now, first, ids, held, opened = (kx, ky), c, [], 0, False
                elif held >= BLOCK:
                    opened = True
                    block(False)
                    first, ids, held = c, [], 0
                text = str(c)
                ids.append(text)
                held += len(text) + 1
                if size >= 4 << 20 or len(out) >= 8192:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], blocks)
                    out, size = [], 0
        if now is not None:
            block(True)
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], blocks)

    names = [*_KEY, "first", "sha", "ids"]
    blocks = pa.schema([*((n, pa.int64()) for n in names[:3]), ("sha", pa.string()), ("ids", pa.string())])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, known = None, None, None
        for batch in batches:
            done: list[tuple] = []
            for kx, ky, whole, ids in zip(*(batch.column(k).to_pylist() for k in (*_KEY, "sha", "ids"))):
                if (kx, ky) != now:
                    if now is not None:
                        done.append((*now, known or sha.hexdigest()))
                    now, sha, known = (kx, ky), None, whole
                if whole is None:
                    if sha is None:
                        sha = hashlib.sha256()
                    else:
                        sha.update(b",")
                    sha.update(ids.encode())
            yield digests(done)
        if now is not None:
            yield digests([(*now, known or sha.hexdigest())])

    def digests(rows: list[tuple]) -> pa.RecordBatch:
        kx, ky, text = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(kx, pa.int64()), pa.array(ky, pa.int64()), pa.array(text, pa.string())], [*_KEY, "ends_sha256"])

    order = [*_KEY, "c"]
    dealt = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.mapInArrow(cut, "kx long, ky long, first long, sha string, ids string")
    dealt = dealt.repartition(*_KEY).sortWithinPartitions(*_KEY, "first")
    return dealt.mapInArrow(close, "kx long, ky long, ends_sha256 string")


def trie(steps: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Nodes of the trie of ``steps`` (see :func:`rebuilt`): ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``."""
    steps = written(steps, "steps")
    # one number
    deepest = steps.agg(F.max("len")).first()[0] or 0
    bands = banded(steps, height, deepest)
    nodes = written(_nodes(bands), "nodes")
    valued = nodes.select(*_KEY, "path", (F.col("n_ends") == F.col("n_convs")).cast("long").alias("n_leaves"),
                          ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    totals = rollup(valued, bands, ["n_leaves", "saved_tokens"], height, deepest)
    children = nodes.where("e > 0").groupBy(F.col("ux").alias("kx"), F.col("uy").alias("ky")).agg(F.count(F.lit(1)).alias("n_children"))
    last = F.element_at("own", -1)
    ends = ends_digest(bands.where(f"band = len div {height}").select(last.kx.alias("kx"), last.ky.alias("ky"), "c"))
    whole = nodes.drop("path", "chars", "n_ends").join(totals, _KEY).join(children, _KEY, "left").join(ends, _KEY, "left")
    parents = nodes.select(F.col("kx").alias("ux"), F.col("ky").alias("uy"), F.col("conv_id").alias("parent_conv_id"))
    whole = whole.join(parents, ["ux", "uy"])
    return whole.select(
        "conv_id", F.col("e").alias("depth"), F.when(F.col("e") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
