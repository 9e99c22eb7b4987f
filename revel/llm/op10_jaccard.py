"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct word shingles, as 64-bit hashes.  Equal
sets form a class; the join works on classes.

*Order.*  Shingles are ordered from rare to common by how many classes hold
them, counted exactly: shingles and classes are dealt to buckets by the hash of
the shingle, in as many buckets as the input needs, and each bucket is sorted
and counted on its own.  A shingle of one class can link nothing and comes first;
counts go back to the classes only for the others.  Counts are rounded to sixteen
steps a doubling, ties go by hash.  The few shingles that stand on very many sets
(``HOT``, told by a table of 2^21 counters over all documents) are not dealt to
a bucket: they come last, ordered by their counter.

*Prefixes.*  Of ``n`` shingles a similar set shares at least ``a = ceil(t n)``;
so two similar sets share ``l`` or more of the first ``n - a + l`` of each.
Every set takes the ``l`` (1 to ``MOST_MATCHES``) with the least estimated cost
of looking up its prefix's lists and verifying what shares ``l`` of them (a
share of the entries that falls with the square of ``l``); a pair is verified when it shares as many prefix shingles as the lesser ``l`` of
its two sides asks.  A set whose prefix holds no shared shingle links with nothing.

*No pairs within a component.*  Near copies would give all pairs of their group,
so the join takes rounds.  First, each set is compared only with the smallest
class of each of its prefix shingles, and the verified links are closed to
components.  Then the sets of different components on a prefix shingle are
compared by their sketches, inside the task that holds the shingle's list: only
pairs that may be links leave it (in the first such round the nearest one of each
two components, in the last all that are left).  A list of more than ``MEMBERS``
sets is cut into blocks, and each two blocks meet in a task of their own.  Every
link either is verified or joins two sets that verified links already connect,
so the components are exact.

*Sketches.*  Before whole texts are compared, a pair's parity sketches are: bit
``h mod 2^k`` of a set's sketch is the parity of its shingles with that hash
bits.  The exclusive or of two sketches is the sketch of the symmetric
difference, so its set bits never outnumber that difference; pairs with more
set bits than a link allows are no links.  A sketch has 2 to 4 bits a shingle,
so near copies just under the threshold are told apart without their texts; the
lists carry sketches folded to ``SHORT`` bits, the pairs that are left are held
against the whole ones.

A shingle on very many sets is dealt to ``SALTS`` groups, each with its own
smallest class, and these are compared with the smallest of all.

Defined results: a null text and one without words have no shingles and link
with nothing; a text of fewer words than a shingle is one shingle; repeated
rows are equal sets; a null id takes no part in the choice of a component's
id; an empty table gives no rows.  Hashes stand for shingles (64 bits) and
sets (64 bits and the size).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revel.llm import arrays as A
from revel.llm.components import components
from revel.llm.jobs import batch_bytes, lean, pieces_for, release, schema, trim, written

WORDS, PERCENT = 5, 80
COUNTER_BITS, WIDTH = 21, 64
MOST_MATCHES = 4
#: cost of verifying a candidate, in looked-up list entries
VERIFY = 20.0
#: steps of a shingle's count for each doubling
STEPS = 16
#: shingles of a bucket, on average, and those a task holds before it deals them out
BUCKET, HELD = 2_000_000, 2_000_000
#: estimated sets from which a shingle's list is salted, and into how many parts
HOT, SALTS = 20_000, 64
#: shingles of a side of a block of pairs, in all of its sets
BLOCK_SHINGLES = 1_000_000
#: Arrow batches of this many bytes
BATCH = 4 << 20
#: sets of a list that meet in one task, and bits of the sketches they are compared by
MEMBERS, SHORT = 1000, 2048
#: rounds over lists: only the nearest pair of each two components, or all pairs
NEAREST = (True, False)


def shingle_sets(buf: np.ndarray, off: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    start, end, at = A.words(buf, off)
    h = A.slice_hash(A.prefix_hash(A.LOWER[buf]), start, end)
    g = A.gram_hash(h, words)
    whole = A.fold(h, at)
    for k, (a, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        if e - a >= words:
            yield A.uniq(g[a:e - words + 1])
        else:
            yield whole[k:k + 1] if e > a else whole[:0]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def count_table(docs: DataFrame, text_col: str = "text", words: int = WORDS) -> np.ndarray:
    """How many sets hold a shingle, by the first bits of its hash, over all documents."""
    n = 1 << COUNTER_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n, np.int64)
        for batch in batches:
            buf, off = A.utf8(batch.column(0))
            for _, _, b, o in A.chunks(buf, off):
                s = np.concatenate([*shingle_sets(b, o, words), np.zeros(0, A.U64)])
                np.add.at(sums, (s >> A.U64(64 - COUNTER_BITS)).astype(np.int64), 1)
        if sums.any():
            table = sums.reshape(-1, WIDTH)
            block = np.flatnonzero(table.any(axis=1))
            for s in range(0, len(block), 4096):
                own = block[s:s + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *(pa.array(c) for c in table[own].T)], names)

    names = ["block", *(f"c{k}" for k in range(WIDTH))]
    parts = docs.select(text_col).mapInArrow(lean(count), "block int, " + ", ".join(f"c{k} long" for k in range(WIDTH)))
    # 2^21 numbers, whatever the input
    sums = parts.groupBy("block").agg(*(F.sum(c).alias(c) for c in names[1:])).toArrow()
    out = np.zeros((n // WIDTH, WIDTH), np.int64)
    for k, name in enumerate(names[1:]):
        out[sums.column(0).to_numpy(), k] = sums.column(name).to_numpy()
    return out.ravel().astype(np.int32) if out.max(initial=0) < 1 << 31 else out.ravel()


def hot_from(counts: np.ndarray) -> float:
    """The counter from which a shingle is hot: ``HOT`` sets above what shared counters show for a rare one."""
    middle = float(np.median(counts))
    return middle + 4 * middle**0.5 + HOT


def _counted(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return counts[(s >> A.U64(64 - COUNTER_BITS)).astype(np.int64)]


def _place(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a hash, by its first 32 bits."""
    return (((h >> A.U64(32)) * A.U64(buckets)) >> A.U64(32)).astype(np.int32)


def _parcels(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
    """One row for each bucket, each column its own values as bytes."""
    order = np.argsort(bucket, kind="stable")
    own, start = np.unique(bucket[order], return_index=True)
    cut = [*start.tolist(), len(order)]
    out = {"bucket": pa.array(own, pa.int32())}
    for name, values in columns.items():
        values = values[order]
        out[name] = pa.array([values[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())
    return pa.table(out)


def _values(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([*(np.frombuffer(v, kind) for v in column.to_pylist() if v), np.zeros(0, kind)])


def occurrences(docs: DataFrame, counts: np.ndarray, buckets: int, text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``bucket, shingle, class``: the shingles that are not hot, each with its class, packed for the bucket of the shingle.
    A task sends a class it has met no second time."""
    hot = hot_from(counts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def packed() -> list[pa.RecordBatch]:
            h, c = (np.concatenate(x) for x in zip(*held))
            held.clear()
            return _parcels(_place(h, buckets), {"shingle": h, "class": c}).to_batches()

        for batch in batches:
            buf, off = A.utf8(batch.column(0))
            for _, _, b, o in A.chunks(buf, off):
                sets = list(shingle_sets(b, o, words))
                n = np.array([len(s) for s in sets], np.int64)
                h = np.concatenate([*sets, np.zeros(0, A.U64)])
                code = A.fold(h, A.bounds(n)).view(np.int64)
                new = np.zeros(len(sets), bool)
                for k, key in enumerate(zip(code.tolist(), n.tolist())):
                    if key not in met:
                        met.add(key)
                        new[k] = True
                keep = np.repeat(new, n) & (_counted(h, counts) < hot)
                held.append((h[keep], np.repeat(code, n)[keep]))
                if sum(len(x) for x, _ in held) >= HELD:
                    yield from packed()
        if held:
            yield from packed()

    return docs.select(text_col).mapInArrow(lean(deal), "bucket int, shingle binary, class binary")


def shared_shingles(occurring: DataFrame, buckets: int) -> DataFrame:
    """``bucket, class, shingle, level``: the occurrences of shingles of two or more classes, packed for the bucket of the class;
    the level is the count in ``STEPS`` a doubling (of occurrences: a class that several tasks have sent counts for each)."""

    def count(table: pa.Table) -> pa.Table:
        h, c = _values(table.column("shingle"), A.U64), _values(table.column("class"), np.int64)
        order = np.argsort(h)
        h, c = h[order], c[order]
        start = np.flatnonzero(A.distinct(h))
        size = np.diff(np.append(start, len(h)))
        two = np.zeros(0, bool) if not len(h) else np.minimum.reduceat(c, start) != np.maximum.reduceat(c, start)
        level = np.minimum(STEPS * np.log2(np.maximum(size, 1)), 255).astype(np.uint8)
        keep = np.repeat(two, size)
        h, c, level = h[keep], c[keep], np.repeat(level, size)[keep]
        order = np.argsort(c)
        h, c, level = h[order], c[order], level[order]
        out = _parcels(_place(c.view(A.U64), buckets), {"class": c, "shingle": h, "level": level})
        trim()
        return out

    return occurring.groupBy("bucket").applyInArrow(count, "bucket int, class binary, shingle binary, level binary")


class Prefixes(NamedTuple):
    """``class_``, the ``matches`` it asks for, how many of its ``hot`` shingles its prefix takes, and the others that are shared:
    ``size`` of them in ``shingle``, one class after another."""

    class_: np.ndarray
    matches: np.ndarray
    hot: np.ndarray
    size: np.ndarray
    shingle: np.ndarray


def prefixes(c: np.ndarray, h: np.ndarray, level: np.ndarray, class_: np.ndarray, n: np.ndarray, hot: np.ndarray, percent: int) -> Prefixes:
    """The prefixes of classes (``class_`` with their ``n`` shingles, ``hot`` of these hot) from their shared shingles (``c, h, level``)."""
    order = np.lexsort((h, level, c))
    c, h, level = c[order], h[order], level[order]
    once = np.ones(len(c), bool)
    once[1:] = (c[1:] != c[:-1]) | (h[1:] != h[:-1])
    c, h, level = c[once], h[once], level[once]
    start = np.searchsorted(c, class_)
    shared = np.searchsorted(c, class_, side="right") - start
    # what a list holds beside the class itself
    upto = np.zeros(len(c) + 1)
    np.cumsum(np.exp2(level / STEPS) - 1, out=upto[1:])
    least = -(-percent * n // 100)
    cost, sizes, hots = [], [], []
    for matches in range(1, MOST_MATCHES + 1):
        end = n - least + matches
        size = np.clip(end - (n - hot - shared), 0, shared)
        warm = np.clip(end - (n - hot), 0, hot)
        entries = upto[start + size] - upto[start] + warm * float(HOT)
        cost.append(np.where(matches <= np.maximum(least, 1), size + warm + entries + VERIFY * entries / matches**2, np.inf))
        sizes.append(size)
        hots.append(warm)
    best = np.argmin(cost, axis=0)
    every = np.arange(len(n))
    size, warm = np.array(sizes)[best, every], np.array(hots)[best, every]
    any_ = size + warm > 0
    return Prefixes(class_[any_], best[any_] + 1, warm[any_], size[any_], h[A.ragged(start[any_], size[any_])])


def chosen(common: DataFrame, classes: DataFrame, buckets: int, percent: int) -> DataFrame:
    """``class, n, matches, warm, prefix`` of each class whose prefix holds a shared shingle, from :func:`shared_shingles` and
    the ``class, n, hot`` of all classes."""

    def choose(shared: pa.Table, own: pa.Table) -> pa.Table:
        class_, n, hot = (own.column(k).to_numpy() for k in ("class", "n", "hot"))
        found = prefixes(_values(shared.column("class"), np.int64), _values(shared.column("shingle"), A.U64),
                         _values(shared.column("level"), np.uint8), class_, n, hot, percent)
        order = np.argsort(class_)
        lists = pa.ListArray.from_arrays(pa.array(A.bounds(found.size).astype(np.int32)), pa.array(found.shingle.view(np.int64)))
        trim()
        return pa.table({"class": found.class_, "n": n[order][np.searchsorted(class_[order], found.class_)],
                         "matches": found.matches.astype(np.int32), "warm": found.hot.astype(np.int32), "prefix": lists})

    place = F.shiftright(F.shiftrightunsigned("class", 32) * F.lit(buckets).cast("long"), 32).cast("int")
    own = classes.select(place.alias("bucket"), "class", "n", F.col("hot").cast("long"))
    return common.groupBy("bucket").cogroup(own.groupBy("bucket")).applyInArrow(
        choose, "class long, n long, matches int, warm int, prefix array<long>")


def sketch(s: np.ndarray) -> bytes:
    """Parity of the shingles by their last hash bits, in 64-bit words: a power of two of bits, at least two a shingle."""
    bits = max(64, 1 << int(2 * len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount((s & A.U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Set bits of the exclusive or of the sketches of each pair (bytes and offsets of both sides), the wider folded to the narrower."""
    sizes = [np.diff(off) // 8 for _, off in (a, b)]
    width = np.minimum(*sizes)
    both = np.zeros(int(width.sum()), A.U64)
    for (buf, off), size in zip((a, b), sizes):
        words, start = np.frombuffer(buf.tobytes(), A.U64), off[:-1] // 8
        for k in range(int((size // np.maximum(width, 1)).max(initial=0))):
            wide = size > k * width
            part = words[A.ragged(np.where(wide, start + k * width, start), width)]
            both ^= np.where(np.repeat(wide, width), part, A.U64(0))
    return A.total_of(np.bitwise_count(both).astype(np.int64), A.bounds(width))


def folded(sketches: np.ndarray, bits: int) -> np.ndarray:
    """Sketches (a row of words each) with the parities of ``bits`` bits."""
    while sketches.shape[1] * 64 > bits:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def near_pairs(n: np.ndarray, label: np.ndarray, side: np.ndarray, marks: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, differing)`` of the pairs of a list that sizes and sketches do not rule out and whose labels differ: all pairs of
    a list on one side, those between the sides of a list on two."""
    width = np.array([len(m) for m in marks])
    found = []
    for w in np.unique(width).tolist():
        # similar sets have sketches of one width or of neighbouring ones
        one, other = np.flatnonzero(width == w), np.flatnonzero((width == w) | (width == 2 * w))
        small = folded(np.frombuffer(b"".join(marks[k] for k in one), A.U64).reshape(len(one), -1), 8 * w)
        large = np.zeros((len(other), w // 8), A.U64)
        for own in (w, 2 * w):
            rows = np.flatnonzero(width[other] == own)
            if len(rows):
                large[rows] = folded(np.frombuffer(b"".join(marks[k] for k in other[rows]), A.U64).reshape(len(rows), -1), 8 * w)
        step = max(1, (1 << 19) // large.size)
        for s in range(0, len(one), step):
            i = one[s:s + step, None]
            j = other[None, :]
            may = (label[i] != label[j]) & ((width[i] != width[j]) | (i < j)) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            if side.any():
                may &= side[i] != side[j]
            at, to = np.nonzero(may)
            if len(at):
                bits = np.bitwise_count(small[s + at] ^ large[to]).sum(axis=1, dtype=np.int64)
                at, to = one[s + at], other[to]
                near = (100 + percent) * bits <= (100 - percent) * (n[at] + n[to])
                found.append((at[near], to[near], bits[near]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([*x, none]) for x in (zip(*found) if found else ((), (), ())))


def met_in_lists(members: DataFrame, marks: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """``a, b, shingle`` of pairs of ``members`` (``shingle, class, label, n``) that may be links of different components; with
    ``nearest`` one pair of each two components on a list."""
    cuts = members.groupBy("shingle").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("cuts"))
    rows = members.join(cuts, "shingle").join(marks, "class").withColumn("own", F.pmod(F.xxhash64("class"), F.col("cuts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    rows = rows.select("shingle", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                       (F.col("own") > F.col("other")).cast("byte").alias("side"), "class", "label", "n", "sketch")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            shingle, side, class_, label, n = (table.column(k).to_numpy() for k in ("shingle", "side", "class", "label", "n"))
            i, j, bits = near_pairs(n, label, side, table.column("sketch").to_pylist(), percent)
            if nearest and len(i):
                low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
                order = np.lexsort((np.minimum(class_[i], class_[j]), np.maximum(class_[i], class_[j]), bits / (n[i] + n[j]), high, low))
                first = A.distinct(low[order]) | A.distinct(high[order])
                i, j = i[order[first]], j[order[first]]
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(class_[i], class_[j])), pa.array(np.minimum(class_[i], class_[j])),
                                               pa.array(shingle[i])], ["a", "b", "shingle"])

        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            start = np.flatnonzero(np.append(True, (group[1:] != group[:-1]).any(axis=1))).tolist()
            for s, e in zip(start, [*start[1:], batch.num_rows]):
                if held and tuple(group[s]) != now:
                    yield pairs(held)
                    held = []
                now = tuple(group[s])
                held.append(batch.slice(s, e - s))
        if held:
            yield pairs(held)

    keys = ["shingle", "low", "high"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(compare), "a long, b long, shingle long")


def signatures(docs: DataFrame, counts: np.ndarray, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
               percent: int = PERCENT) -> DataFrame:
    """``id, class, n, hot, hots``: how many of a set's shingles are hot, and the first of these as far as a prefix may reach
    (null where it cannot, and for a class the task has met)."""
    least_hot = hot_from(counts)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        for batch in batches:
            buf, off = A.utf8(batch.column(1))
            for i, j, b, o in A.chunks(buf, off):
                sets = list(shingle_sets(b, o, words))
                n = np.array([len(s) for s in sets], np.int64)
                at, h = A.bounds(n), np.concatenate([*sets, np.zeros(0, A.U64)])
                code = A.fold(h, at).view(np.int64)
                count = _counted(h, counts)
                hot = A.total(count >= least_hot, at)
                reach = hot - -(-percent * n // 100) + MOST_MATCHES
                hots: list[np.ndarray | None] = [None] * (j - i)
                for k in np.flatnonzero((hot > 0) & (reach > 0)).tolist():
                    if (key := (int(code[k]), int(n[k]))) not in met:
                        met.add(key)
                        c = count[at[k]:at[k + 1]]
                        warm = np.flatnonzero(c >= least_hot)
                        hots[k] = sets[k][warm[np.lexsort((sets[k][warm], c[warm]))][:reach[k]]].view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(code, mask=n == 0), pa.array(n), pa.array(hot),
                                                  pa.array(hots, pa.list_(pa.int64()))], names)

    names = ["id", "class", "n", "hot", "hots"]
    out = schema({"id": docs.schema[id_col].dataType}, "class long, n long, hot long, hots array<long>")
    return _texts(docs, id_col, text_col).mapInArrow(lean(sign), out)


def sketches(texts: DataFrame, words: int) -> DataFrame:
    """``class, sketch, short`` of ``class, text``: the whole sketch and the one of at most ``SHORT`` bits."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = A.utf8(batch.column(1))
            for i, j, b, o in A.chunks(buf, off):
                marks = [sketch(s) for s in shingle_sets(b, o, words)]
                short = [folded(np.frombuffer(m, A.U64).reshape(1, -1), SHORT).tobytes() for m in marks]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(marks, pa.binary()), pa.array(short, pa.binary())],
                                                 ["class", "sketch", "short"])

    return texts.select("class", "text").mapInArrow(lean(mark), "class long, sketch binary, short binary")


def classed(docs: DataFrame, text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``docs`` with the class ``_class`` (null without shingles) and the size ``_n`` of each row's set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = A.utf8(batch.column(place))
            for i, j, b, o in A.chunks(buf, off):
                sets = list(shingle_sets(b, o, words))
                n = np.array([len(s) for s in sets], np.int64)
                code = A.fold(np.concatenate([*sets, np.zeros(0, A.U64)]), A.bounds(n)).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(code, mask=n == 0), pa.array(n)], names)

    place, names = docs.columns.index(text_col), [*docs.columns, "_class", "_n"]
    return docs.mapInArrow(lean(sign), schema({f.name: f.dataType for f in docs.schema}, "_class long, _n long"))


def class_texts(docs: DataFrame, text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``class, text``: a text of each class a task meets; all texts of a class have equal sets."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            new = []
            for k, c in enumerate(batch.column(1).to_pylist()):
                if c is not None and c not in met:
                    met.add(c)
                    new.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0)], ["class", "text"]).take(pa.array(new, pa.int64()))

    own = classed(docs.select(F.col(text_col).alias("text")), "text", words)
    return own.select("text", "_class").mapInArrow(lean(once), "class long, text string")


def _similar_sizes(percent: int):
    return F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent


def sketched(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a, b, shingle, na, nb``) whose sketches do not rule a link out."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (100 - percent) * (batch.column(3).to_numpy() + batch.column(4).to_numpy())
            found = differing(A.utf8(batch.column(5)), A.utf8(batch.column(6)))
            yield batch.select(range(5)).filter(pa.array((100 + percent) * found <= most))

    for side in "ab":
        pairs = pairs.join(sketches.select(F.col("class").alias(side), F.col("sketch").alias(f"sketch_{side}")), side)
    return pairs.select("a", "b", "shingle", "na", "nb", "sketch_a", "sketch_b").mapInArrow(lean(check), "a long, b long, shingle long, na long, nb long")


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``a, b, linked`` of each pair of classes (``a, b, shingle, na, nb``), from the whole texts.

    Pairs are dealt in blocks: those of one shingle, cut into blocks of about
    ``BLOCK_SHINGLES`` a side where its sets hold more.  A text goes to a block once,
    not once for each of its pairs."""
    sides = pairs.select("shingle", F.col("a").alias("class"), F.col("na").alias("n")).unionByName(
        pairs.select("shingle", F.col("b").alias("class"), F.col("nb").alias("n")))
    cuts = sides.distinct().groupBy("shingle").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("cuts"))
    cut = {c: F.pmod(F.xxhash64(c), F.col("cuts")) for c in "ab"}
    dealt = pairs.join(cuts, "shingle").select(F.xxhash64("shingle", F.least(cut["a"], cut["b"]), F.greatest(cut["a"], cut["b"])).alias("block"), "a", "b")
    needed = dealt.select("block", F.col("a").alias("class")).unionByName(dealt.select("block", F.col("b").alias("class"))).distinct()
    sent = needed.join(texts, "class").select("block", F.col("class").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    rows = sent.unionByName(dealt.withColumn("text", F.lit(None).cast("string")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of a block: its texts, then its pairs
        kept: dict[int, np.ndarray] = {}
        now = None
        for batch in batches:
            block, a = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            b = batch.column(2)
            is_text = np.asarray(b.is_null())
            b = pa.compute.fill_null(b, 0).to_numpy()
            buf, off = A.utf8(batch.column(3).filter(pa.array(is_text)))
            sets = iter([x for _, _, t, o in A.chunks(buf, off) for x in shingle_sets(t, o, words)])
            linked = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                if block[k] != now:
                    kept, now = {}, block[k]
                if is_text[k]:
                    kept[int(a[k])] = next(sets)
                    continue
                s, t = kept[int(a[k])], kept[int(b[k])]
                both = np.concatenate([s, t])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                linked[k] = 100 * common >= percent * (len(both) - common)
            pair = ~is_text
            yield pa.RecordBatch.from_arrays([pa.array(a[pair]), pa.array(b[pair]), pa.array(linked[pair])], ["a", "b", "linked"])

    return rows.repartition("block").sortWithinPartitions("block", F.col("b").asc_nulls_first()).mapInArrow(lean(check), "a long, b long, linked boolean")


def _relabelled(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """``class, label`` after the linked pairs have joined their components."""
    links = pairs.where("linked").join(labels.select(F.col("class").alias("a"), F.col("label").alias("la")), "a")
    links = links.join(labels.select(F.col("class").alias("b"), F.col("label").alias("lb")), "b")
    merged = components(links.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    new = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    return written(new.select("class", F.coalesce("to", "label").alias("label")), "labels")


class Components(NamedTuple):
    """``rows``: the set of each row of the documents (``id, class, n``); ``classes``: ``class, n, rep, copies, label``,
    with a class's smallest id and its component's label (null if the class shares no prefix shingle)."""

    rows: DataFrame
    classes: DataFrame


def linked_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> Components:
    batch_bytes(docs.sparkSession, BATCH)
    release(docs.sparkSession)
    counts = count_table(docs, text_col, words)
    # buckets by the number of shingles: a bucket is one task's sort
    buckets = pieces_for(docs.sparkSession, int(counts.sum(dtype=np.int64)), BUCKET)
    signed = written(signatures(docs, counts, id_col, text_col, words, percent), "signatures")
    classes = signed.where("class is not null").groupBy("class", "n").agg(
        F.min("id").alias("rep"), F.max("hot").alias("hot"), F.max("hots").alias("hots"), F.count(F.lit(1)).alias("copies"))
    common = shared_shingles(occurrences(docs, counts, buckets, text_col, words), buckets)
    own = written(chosen(common, classes.select("class", "n", "hot"), buckets, percent), "prefixes")
    release(docs.sparkSession)

    # prefix shingles of two or more classes
    rows = own.select(F.explode("prefix").alias("shingle"), "class", F.lit(0).cast("byte").alias("salt"))
    warm = own.where("warm > 0").select("class", "n", "warm").join(classes.select("class", "n", "hots"), ["class", "n"])
    warm = warm.select(F.explode(F.slice("hots", F.lit(1), F.col("warm"))).alias("shingle"), "class",
                       (F.pmod("class", F.lit(SALTS)) + 1).cast("byte").alias("salt"))
    group = Window.partitionBy("shingle", "salt")
    rows = rows.unionByName(warm).withColumns({"first": F.min("class").over(group), "last": F.max("class").over(group)})
    shared = written(rows.where("first != last or salt > 0").select("shingle", "class", "salt", "first"), "shared")
    info = written(own.select("class", "n", "matches").join(shared.select("class").distinct(), "class", "left_semi"), "classes")
    # by class, not by id: ids may be null or stand on several texts
    texts = class_texts(docs, text_col, words).join(info.select("class"), "class", "left_semi").groupBy("class").agg(F.min("text").alias("text"))
    texts = written(texts, "texts")
    marks = written(sketches(texts, words), "sketches")
    release(docs.sparkSession)
    sizes = {side: info.select(F.col("class").alias(side), F.col("n").alias(f"n{side}"), F.col("matches").alias(f"m{side}")) for side in "ab"}

    def candidates(pairs: DataFrame, matched: bool = True) -> DataFrame:
        """``a, b, shingle`` (their least) of pairs (one row for each common prefix shingle) that match often enough, if that is asked."""
        counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.min("shingle").alias("shingle"))
        sized = counted.join(sizes["a"], "a").join(sizes["b"], "b").where(_similar_sizes(percent))
        if matched:
            sized = sized.where(F.col("common") >= F.least("ma", "mb"))
        # written once: the verification reads them for the sizes of blocks, for the texts and for the pairs
        return written(sketched(sized.select("a", "b", "shingle", "na", "nb"), marks.select("class", "sketch"), percent), "likely")

    # first pass: every class against the smallest one of each of its prefix shingles
    stars = shared.where("class != first").select(F.col("class").alias("a"), F.col("first").alias("b"), "shingle")
    heads = shared.where("salt > 0").groupBy("shingle", "first").agg(F.lit(1).alias("one"))
    tops = heads.groupBy("shingle").agg(F.min("first").alias("b"))
    heads = heads.join(tops, "shingle").where("first != b").select(F.col("first").alias("a"), "b", "shingle")
    tried = written(verified(candidates(stars.unionByName(heads)), texts, words, percent), "tried")
    labels = _relabelled(info.select("class", F.col("class").alias("label")), tried)

    release(docs.sparkSession)

    # then: common prefix shingles of different components
    short = marks.select("class", F.col("short").alias("sketch"))
    for nearest in NEAREST:
        members = shared.select("shingle", "class").join(labels, "class").join(info.select("class", "n"), "class")
        mixed = members.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("shingle")
        members = written(members.join(mixed, "shingle", "left_semi"), "members")
        if members.isEmpty():
            break
        # the nearest pairs differ from list to list, so how many lists show one says nothing
        pairs = candidates(met_in_lists(members, short, percent, nearest), matched=not nearest)
        new = written(verified(pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti"), texts, words, percent), "tried")
        labels = _relabelled(labels, new)
        tried = tried.unionByName(new)
        release(docs.sparkSession)

    return Components(signed, classes.join(labels, "class", "left"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``id, n_shingles, component_id`` of every row of ``docs``."""
    signed, linked = linked_classes(docs, id_col, text_col, words, percent)
    # the smallest document of each component
    known = linked.where("label is not null or copies > 1").select("class", "n", "rep", F.coalesce("label", "class").alias("label"))
    least = known.where("label is not null").groupBy("label").agg(F.min("rep").alias("component"))
    known = known.join(least, "label").select("class", "n", "component")
    out = signed.select("id", "class", "n").join(known, ["class", "n"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def first_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` of each component: the smallest id's (a null id only where all are null), of several its least text;
    rows without shingles are kept, each id and text once."""
    _, linked = linked_classes(docs, id_col, text_col, words, percent)
    order = F.struct(F.col("rep").isNull().alias("none"), "rep", "class", "n")
    least = linked.groupBy(F.coalesce("label", "class").alias("label")).agg(F.min(order).alias("least"))
    least = least.select(F.col("least.class").alias("_class"), F.col("least.n").alias("_n"), F.col("least.rep").alias("_rep"))
    rows = classed(docs, text_col, words)
    own, id_ = rows.where("_class is not null"), F.col(f"`{id_col}`")
    own = own.join(least, ["_class", "_n"]).where(id_.eqNullSafe(F.col("_rep"))).groupBy("_class", "_n")
    bare = rows.where("_class is null").groupBy(id_.alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    columns = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    own = own.agg(F.min_by(columns, f"`{text_col}`").alias("_row")).select("_row.*")
    return own.unionByName(bare.agg(F.first(columns).alias("_row")).select("_row.*"))
