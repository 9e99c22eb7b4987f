import hashlib
import itertools
import re

import numpy as np
import pytest
from common import WORDS, edge_texts, empty, frame, rows_of

from revel.llm import arrays as A
from revel.llm import op01_quality as quality
from revel.llm import op02_language as language
from revel.llm import op04_decontaminate as clean
from revel.llm import op08_substrings as substrings
from revel.llm import op09_lines as lines
from revel.llm import op10_jaccard as jaccard

# ---- quality


def base_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    own = [x for x in text.split("\n")]
    seen, dup = set(), 0
    for x in own:
        if WORDS.search(x):
            dup += x in seen
            seen.add(x)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i:i + 8]), []).append(i)
    hit = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup,
            "n_repeat_words": len(hit), "base_failed": len(words) < 20 or 100 * len(hit) > 30 * len(words)}


def test_base_counts_and_verdict(spark):
    texts = edge_texts() + ["w # * $ | < >\nw # * $ | < >\n" * 9]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, len(texts), 2)], "doc_id long, quality int")
    docs = frame(spark, texts)
    got = rows_of(quality.label_documents(docs, quality.fit(docs, labels)))
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        want = base_counts(t)
        assert {c: got[k][c] for c in want} == want
        assert not (want["base_failed"] and got[k]["kept"])
        marks = [m for m in got[k]["line_labels"]]
        assert len(marks) == (len(t.split("\n")) if t else 0)


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(1)
    at = np.array([0, 1, 1, 6, 9])
    n = at[-1]
    bins = np.stack([rng.integers(0, s, n) + f for s, f in zip(quality.SIZES, quality.FIRST[:-1])], axis=1)
    model = quality.LineModel(rng.normal(size=quality.FIRST[-1]), rng.normal(size=(2, 2)), rng.normal(size=2))
    got = quality.viterbi(model, quality.Lines(at, bins, np.ones(n), np.arange(n)))
    for a, e in zip(at, at[1:]):
        emit = model.weights[bins[a:e]].sum(axis=1)

        def score(y, emit=emit):
            return model.start[y[0]] + sum(x for x, v in zip(emit, y) if v) + sum(model.move[p, q] for p, q in zip(y, y[1:]))

        if e > a:
            best = max(itertools.product((0, 1), repeat=e - a), key=score)
            assert score(tuple(got[a:e])) == pytest.approx(score(best))


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = frame(spark, ["some words " * 30])
    model = quality.fit(docs, none)
    assert rows_of(quality.label_documents(docs, model))[0]["content_share"] == 1.0
    assert quality.label_documents(empty(spark), model).count() == 0


def test_quality_verdict_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    got = quality.label_documents(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    right, n = got.selectExpr("sum(if(kept = (quality = 1), 1, 0))", "count(*)").first()
    assert right >= 0.9 * n


# ---- language


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.held_out()
    got = language.predict(docs, language.fit(docs.where(~out))).join(docs.where(out).select("doc_id", "lang"), "doc_id")
    right, n = got.selectExpr("sum(if(lang = lang_pred, 1, 0))", "count(*)").first()
    assert right >= 0.98 * n


def test_language_edge_cases(spark):
    texts = [None, "", "123 ... \n", "l", "le chat et la souris " * 9, "der Hund und die Katze " * 9, "😀 !", "le chat"]
    docs = frame(spark, texts)
    train = spark.createDataFrame([("fr", "le chat et la souris " * 20), ("de", "der Hund und die Katze " * 20), (None, "x"), ("fr", None)],
                                  "lang string, text string")
    got = rows_of(language.predict(docs, language.fit(train)))
    assert [got[i]["lang_pred"] for i in range(8)][:3] == ["und"] * 3 and got[6]["lang_pred"] == "und"
    assert (got[4]["lang_pred"], got[5]["lang_pred"], got[7]["lang_pred"]) == ("fr", "de", "fr")
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[0]["score"] == 0
    nothing = language.fit(train.where("false"))
    assert {r["lang_pred"] for r in rows_of(language.predict(docs, nothing)).values()} == {"und"}
    assert language.predict(empty(spark), nothing).count() == 0


def test_gram_vector_binds_rotated_letters():
    v = [language.letter_vector(ord(c), 64, 3).astype(int) for c in "abc"]
    gram = (ord("a") << 42) | (ord("b") << 21) | ord("c")
    assert (language.gram_vectors(np.array([gram]), 64, 3)[0] == np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]).all()


# ---- decontamination


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def hits(text, items):
    words = ITEM_WORD.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        w = ITEM_WORD.findall(lower(t))
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            for p in range(len(words) - n + 1):
                if words[p:p + n] == w[s:s + n]:
                    hit.update(range(p, p + n))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_decontamination_against_all_windows(spark):
    texts = [t for t in edge_texts() if t is None or len(t) < 20_000]
    items = [(1, " ".join((texts[-10]).split(" ")[20:60])), (2, texts[40]), (10, "alpha, BETA"), (3, ""), (4, None), (5, texts[75]), (6, "nowhere " * 14),
             (7, texts[75])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows_of(clean.report(frame(spark, texts), bench))
    for k, t in enumerate(texts):
        n, h, i, sha = hits(t, items)
        assert (got[k]["n_words"], got[k]["n_hit"], got[k]["n_items"], got[k]["items_sha256"]) == (n, h, i, sha), k
        assert got[k]["contaminated"] == (h > 0 and 20 * h >= n)


def test_blocks_of_items_give_the_same_result(spark, monkeypatch):
    texts = [t for t in edge_texts() if t is None or len(t) < 20_000]
    bench = spark.createDataFrame([(i, texts[i]) for i in (20, 40, 75, 76, 79)], "item_id long, text string")
    want = rows_of(clean.report(frame(spark, texts), bench))
    monkeypatch.setattr(clean, "BLOCK_BYTES", 10)
    assert rows_of(clean.report(frame(spark, texts), bench)) == want


def test_removal_spans_and_empty_benchmark(spark):
    words = [f"w{i}" for i in range(400)]
    item = " ".join(words[100:113])
    docs = frame(spark, [" ".join(words), item, "é. " + item.upper().replace(" ", ", ") + " é", None])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = rows_of(clean.decontaminate(docs, bench))
    assert sorted(got) == [0, 3] and got[0]["text"] == " ".join([*words[:100], "", *words[113:]]) and got[3]["text"] is None
    assert sorted(rows_of(clean.decontaminate(docs, bench.where("false")))) == [0, 1, 2, 3]
    assert clean.report(empty(spark), bench).count() == 0


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(2)
    s = np.concatenate([*(np.append(rng.integers(1, 4, n), 0) for n in (40, 1, 7, 200, 200)), [1, 2, 3] * 30, [0]])
    index = clean.FMIndex(s, 5)
    for k in range(1, 6):
        pats = rng.integers(1, 6, (50, k))
        lo, hi = index.search(np.hstack([np.zeros((50, 5 - k), int), pats]))
        for p, a, e in zip(pats, lo, hi):
            want = [i for i in range(len(s) - k + 1) if (s[i:i + k] == p).all()]
            assert sorted(index.locate(np.arange(a, e)).tolist()) == want


# ---- repeated byte strings


def removed(texts, n=50):
    raw = [(t or "").encode() for t in texts]
    first = {}
    for k, x in enumerate(raw):
        for p in range(len(x) - n + 1):
            first.setdefault(x[p:p + n], k)
    out = []
    for k, x in enumerate(raw):
        mark = bytearray(len(x))
        for p in range(len(x) - n + 1):
            if first[x[p:p + n]] < k:
                mark[p:p + n] = b"\1" * n
        kept = bytes(c for c, m in zip(x, mark) if not m)
        out.append((len(x), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_substrings_against_all_windows(spark, monkeypatch, parts):
    texts = edge_texts()[:-1] + ["x" * 500, "y" + "x" * 300, "ab" * 300 + "c", "q" * 49, "q" * 50, "q" * 50 + "!"]
    monkeypatch.setattr(substrings, "SORT_BLOCKS", 50)
    got = rows_of(substrings.dedup(frame(spark, texts, parts)))
    for k, want in enumerate(removed(texts)):
        r = got[k]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want, k


def test_substrings_edges(spark):
    assert substrings.dedup(empty(spark)).count() == 0
    df = spark.createDataFrame([(1, "z" * 60), (1, "z" * 60), (None, "z" * 60), (2, "z" * 60)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in substrings.dedup(df).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 60)]


def test_refinement_tells_suffixes_apart():
    buf = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz" * 4, np.uint8)
    where = np.arange(len(buf) - substrings.GRAM + 1)
    code = A.slice_hash(A.prefix_hash(buf), where, where + substrings.GRAM)
    live, head = substrings.refined(code, np.array([0, 1, 26, 30, 52]), [20, 30])
    assert sorted(live.tolist()) == [0, 2, 4] and len(head) == 1


# ---- line dedup


def test_lines_against_exact_spread(spark):
    common, rare = "shared footer line", "on four sites"
    texts = []
    for i in range(40):
        texts.append(f"own {i}\n  {common} \n\n" + (f"{rare}\n" if i % 10 < 4 else "") + f"end {i}")
    texts += [None, "", common, f"{common}\n{common}", " \n "]
    df = frame(spark, texts).drop("source")
    df = df.selectExpr("*", "if(doc_id = 44, null, concat('s', doc_id % 10)) as source")
    for sites in (4, 5, 10, 11):
        got = rows_of(lines.dedup_lines(df, sites))
        gone = {k for k, n in ((common, 10), (rare, 4)) if n >= sites}
        for k, t in enumerate(texts):
            keep = None if t is None else "\n".join(x for x in t.split("\n") if not (x.strip() in gone and k > 0))
            assert got[k]["text"] == keep, (sites, k)
            own = [x.strip() for x in (t or "").split("\n") if x.strip()]
            assert got[k]["_ld_lines"] == len(own) and got[k]["_ld_removed"] == (sum(x in gone for x in own) if k else 0)
    assert lines.dedup_lines(empty(spark)).count() == 0


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(i, f"line {k}", f"site{i % (1995 + k)}") for k in range(10) for i in range(4010)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    found = {r._ld_h for r in lines.boilerplate(df, 2000).collect()}
    want = {r[0] for r in df.where("cast(substr(text, 6) as int) >= 5").selectExpr("xxhash64(text)").distinct().collect()}
    assert found == want


# ---- near duplicates


def components(texts, words=5, percent=80):
    sets = []
    for t in texts:
        w = WORDS.findall(lower(t))
        sets.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            label[b] = a
    return [(len(s), find(k)) for k, s in enumerate(sets)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_components_against_all_pairs(spark, monkeypatch, seed):
    import random

    r = random.Random(seed)
    texts = edge_texts(seed)
    names = [f"n{i}" for i in range(3000)]
    for _ in range(8):  # chains of slowly drifting copies, around the threshold
        w = [r.choice(names) for _ in range(r.randint(8, 120))]
        for _ in range(10):
            texts.append(" ".join(w))
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                w[r.randrange(len(w))] = r.choice(names)
    if seed == 2:
        monkeypatch.setattr(jaccard, "HOT", 3)
        monkeypatch.setattr(jaccard, "SALTS", 4)
        monkeypatch.setattr(jaccard, "MEMBERS", 3)
    if seed == 3:
        monkeypatch.setattr(jaccard, "VERIFY", 1e6)
    got = rows_of(jaccard.near_duplicates(frame(spark, texts)))
    for k, want in enumerate(components(texts)):
        assert (got[k]["n_shingles"], got[k]["component_id"]) == want, (k, texts[k])


def test_jaccard_edges(spark):
    assert jaccard.near_duplicates(empty(spark)).count() == 0
    df = spark.createDataFrame([(5, "a b"), (5, "a b"), (2, "A  B"), (7, None), (8, None)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.near_duplicates(df).collect())) == [(2, 1, 2), (5, 1, 2), (5, 1, 2), (7, 0, 7), (8, 0, 8)]


def _null_and_repeated_ids(seed):
    """``(id, text)``: near copies on null ids, and ids that stand on several texts."""
    import random

    r = random.Random(seed)
    names = [f"n{i}" for i in range(2000)]
    rows = []
    for k in range(12):
        w = [r.choice(names) for _ in range(60)]
        for _ in range(4):
            v = list(w)
            v[r.randrange(60)] = r.choice(names)
            rows.append((None if k % 3 == 0 else r.choice([None, r.randrange(12)]), " ".join(v)))
    one = " ".join(names[:40])
    return rows + [(None, one), (90, one.replace("n20 ", "other ")), (None, None), (None, ""), (7, "")]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_null_ids_and_ids_with_several_texts(spark, seed):
    rows = _null_and_repeated_ids(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = components([t for _, t in rows])
    least = {}
    for (i, _), (_, c) in zip(rows, found):
        least[c] = min([x for x in (i, least.get(c)) if x is not None], default=None)
    want = [(i, n, least[c]) for (i, _), (n, c) in zip(rows, found)]
    assert sorted(map(tuple, jaccard.near_duplicates(df).collect()), key=repr) == sorted(want, key=repr)
    # one row of each component: that of its least id
    kept = [tuple(x) for x in jaccard.first_rows(df).collect()]
    group = {row: c for row, (_, c) in zip(rows, found)}
    assert sorted(group[k] for k in kept) == sorted({c for _, c in found})
    assert all(k[0] == least[group[k]] for k in kept)


@pytest.mark.parametrize("seed", [1, 2])
def test_prefixes_of_similar_sets_share_enough(seed):
    rng = np.random.default_rng(seed)
    # common shingles stand on many sets, each set has some of its own, some of both are hot
    names = rng.integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2)
    sets = []
    for _ in range(60):
        s = np.unique(np.concatenate([rng.choice(names, int(rng.integers(0, 90))), rng.integers(0, 1 << 63, int(rng.integers(1, 90))).astype(np.uint64)]))
        k = int(rng.integers(0, len(s) // 9 + 1))
        sets += [s, np.unique(np.concatenate([s[k:], rng.integers(0, 1 << 63, k).astype(np.uint64)]))]
    hot = set(names[:60].tolist()) if seed == 2 else set()
    held = {}
    for k, s in enumerate(sets):
        for h in s.tolist():
            held.setdefault(h, []).append(k)
    entries = [(k, h, min(255, int(16 * np.log2(len(v))))) for h, v in held.items() if len(v) > 1 and h not in hot for k in v]
    entries += entries[::7]  # sent by two tasks
    n, warm = (np.array(x) for x in ([len(s) for s in sets], [len(hot & set(s.tolist())) for s in sets]))
    c, h, level = (np.array(x, t) for x, t in zip(zip(*entries), (np.int64, np.uint64, np.uint8)))
    found = jaccard.prefixes(c, h, level, np.arange(len(sets)), n, warm, 80)
    at = np.cumsum([0, *found.size])
    got = {}
    for k, i in enumerate(found.class_.tolist()):
        own = found.shingle[at[k]:at[k + 1]].tolist() + sorted(hot & set(sets[i].tolist()))[:found.hot[k]]
        assert len(own) == len(set(own))
        got[i] = set(own), int(found.matches[k])
    linked = 0
    for i, s in enumerate(sets):
        for j, t in enumerate(sets[:i]):
            both = len(np.intersect1d(s, t))
            if 100 * both >= 80 * (len(s) + len(t) - both):
                linked += 1
                assert len(got[i][0] & got[j][0]) >= min(got[i][1], got[j][1])
    assert linked > 20


@pytest.mark.parametrize("sides", [1, 2])
def test_lists_lose_no_link(sides):
    rng = np.random.default_rng(sides)
    sets = []
    for _ in range(40):
        s = rng.integers(0, 1 << 63, int(rng.integers(1, 1500))).astype(np.uint64)
        for _ in range(3):
            k = int(rng.integers(0, len(s) // 6 + 1))
            sets.append(np.unique(np.concatenate([s[k:], rng.integers(0, 1 << 63, int(rng.integers(0, k + 1))).astype(np.uint64)])))
    n, label, side = np.array([len(s) for s in sets]), np.arange(len(sets)) // 2, np.arange(len(sets)) % sides
    marks = [jaccard.folded(np.frombuffer(jaccard.sketch(s), np.uint64).reshape(1, -1), jaccard.SHORT).tobytes() for s in sets]
    i, j, _ = jaccard.near_pairs(n, label, side, marks, 80)
    got = set(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist()))
    assert len(got) == len(i)
    links = 0
    for x in range(len(sets)):
        for y in range(x):
            both = len(np.intersect1d(sets[x], sets[y]))
            if label[x] != label[y] and (sides == 1 or side[x] != side[y]) and 100 * both >= 80 * (n[x] + n[y] - both):
                links += 1
                assert (y, x) in got
    assert links and len(got) < 4 * links + 20


@pytest.mark.parametrize("seed", [1, 2])
def test_sketches_never_rule_out_a_link(seed):
    rng = np.random.default_rng(seed)
    pairs, truth = [], []
    for _ in range(300):
        n, extra = int(rng.integers(1, 900)), int(rng.integers(0, 120))
        common = rng.integers(0, 1 << 63, n).astype(np.uint64)
        s, t = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, k).astype(np.uint64)])) for k in (extra, int(rng.integers(0, 120))))
        pairs.append((s, t))
        truth.append(len(np.setxor1d(s, t)))
    sides = []
    for k in (0, 1):
        marks = [jaccard.sketch(p[k]) for p in pairs]
        sides.append((np.frombuffer(b"".join(marks), np.uint8), np.cumsum([0, *map(len, marks)])))
    found = jaccard.differing(*sides)
    assert (found <= truth).all() and (found % 2 == np.array(truth) % 2).all()
    # and they tell most of the difference
    assert found.sum() > 0.8 * sum(truth)
    # folded over any ratio of widths
    wide, narrow = np.arange(5000, dtype=np.uint64), np.arange(3, dtype=np.uint64)
    one = [(np.frombuffer(m, np.uint8), np.array([0, len(m)])) for m in map(jaccard.sketch, (wide, narrow))]
    assert jaccard.differing(*one)[0] <= 4997
    none = (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    assert len(jaccard.differing(none, none)) == 0
