import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from revel.llm import op11_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, group=100, heads=6):
    """The contract, with whole conversations in memory."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    length = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        seq = own.get(c - c % group, [])[:h] + v[h:]
        length[c] = len(seq)
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, leaves, saved = {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) if children[p] else 1
        saved[p] = sum(saved[q] for q in children[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        ends = ",".join(map(str, sorted(c for c in members[p] if length[c] == len(p))))
        out[min(members[p]), len(p)] = (min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p],
                                        hashlib.sha256(ends.encode()).hexdigest())
    return out


def found(df):
    rows = df.collect()
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(got) == len(rows)
    return got


def talks(seed=3, convs=330, most=9):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(700), convs):
        for turn in range(r.randint(1, most)):
            rows.append((c, turn * 3, r.choice(["user", "user", None]), r.choice(["é", "b" * 7, None, "long 日本 text"])))
    # no first conversation of a group, nulls, gaps, one conversation of very many turns and copies of it
    rows = [x for x in rows if x[0] != 300]
    rows += [(900, None, "user", "first"), (900, 5, "user", "second"), (None, 1, "user", "nobody"), (901, 0, None, None)]
    for c in (1000, 1001, 1037, 1099):
        rows += [(c, k, "user", f"t{k if c != 1099 or k < 60 else -k}") for k in range(75)]
    return rows


@pytest.mark.parametrize("height", [3, 32])
def test_nodes_match_brute_force(spark, height):
    rows = talks()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as c", "'x' as len", "1 as e", "0 as kx", "'x' as path", "7 as depth").repartition(5)
    assert found(trie.trie(trie.rebuilt(df), height)) == brute(rows)


def test_repeated_rows_and_empty_tables(spark):
    rows = [(c, t, "user", f"w{t}") for c in (0, 1, 2, 50) for t in range(3)] * 2
    got = found(trie.trie(trie.rebuilt(spark.createDataFrame(rows, SCHEMA))))
    assert got == brute(rows)
    assert trie.trie(trie.rebuilt(spark.createDataFrame([], SCHEMA))).count() == 0


def test_one_conversation_without_turns_is_a_lone_root(spark):
    rows = [(c, 0, "user", "only") for c in range(1, 40) if zlib.crc32(str(c).encode()) % 6 > 0]
    got = found(trie.trie(trie.rebuilt(spark.createDataFrame(rows, SCHEMA))))
    assert got == brute(rows) and list(got) == [(min(r[0] for r in rows), 0)]


def test_digest_of_ids_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 40)
    ends = spark.range(3000).selectExpr("id % 3 * (id % 7) as kx", "id % 2 as ky", "id - 900 as c").repartition(4)
    want = defaultdict(list)
    for r in ends.collect():
        want[r.kx, r.ky].append(r.c)
    got = {(r.kx, r.ky): r.ends_sha256 for r in trie.ends_digest(ends).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}
