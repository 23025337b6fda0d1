import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np

from veridale.llm import convtrie
from veridale.llm.queries import op11_conversation_trie


def brute(rows):
    """Nodes of rows (conv_id, turn, role, text), from dicts of whole paths."""
    conv, members, kids = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            conv[c].append((turn is not None, turn or 0, r, hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest(), t))
    conv = {c: [(x[2], x[4]) for x in sorted(turns)] for c, turns in conv.items()}
    built = {}
    for c, turns in conv.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(conv.get(c - c % 20, [])[:h] + turns[h:])
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len([w for w in re.split(r"[\x20\x09-\x0D]+", p[-1][1]) if w]) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
    ends = {p: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest() for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -99, len(m), len(kids[p]), leaves[p], saved[p], ends[p]) for p, m in members.items())


def listed(found):
    return sorted(tuple(-99 if v is None else v for v in r) for r in found.collect())


def test_op11_matches_brute_force(spark, small):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{small}/conversations.parquet").collect()]
    assert listed(op11_conversation_trie(spark, small)) == brute(rows)


def test_shards_and_heavy_levels_of_any_size(spark):
    rng = random.Random(5)
    turn = lambda: (rng.choice(["user", "assistant"]), " ".join("ab"[rng.random() < 0.3] for _ in range(rng.randrange(4))))
    rows = [(c, k, *(("user", "hello you") if k == 0 and c % 3 else turn())) for c in range(0, 400) for k in range(rng.randrange(1, 6))]
    rows += [(1000 + c, k, "user", f"copy {k}") for c in range(60) for k in range(5)] + [(2000, k, "user", f"long {k % 7}") for k in range(1200)]
    want = brute(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for shard in (1, 7, 100, 10**6):
        assert listed(convtrie.trie(turns, shard)) == want, shard


def test_odd_turns(spark):
    rows = [
        (3, None, None, None), (3, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "user", "\t b\x0bc  "), (23, 5, None, ""), (23, 5, "user", None), (-5, 0, "a", "x" * 300000), (-20, 0, "é\U0001f600", "y"), (None, 0, "user", "z"),
        (20, 0, "user", "head"), (20, 0, "assistant", "tie"), (2**62, 1, "u", "ser: 1"), (2**62 + 1, 1, "us", "er: 1")]
    turns = spark.createDataFrame([(*r, "x", "x") for r in rows], "conv_id long, turn long, role string, text string, id string, depth string")
    assert listed(convtrie.trie(turns)) == brute(rows) == listed(convtrie.trie(turns, 2))
    assert convtrie.trie(turns.limit(0)).count() == 0
    # 3's own turn is before its h: nothing is left of it but the root
    alone = next(c for c in range(20, 40) if zlib.crc32(str(c).encode()) % 4 and c % 20)
    rows = [(alone, 0, "user", "gone")]
    out = listed(convtrie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert out == brute(rows) and len(out) == 1 and out[0][5] == 1


def test_many_ends_of_one_node(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "IDS", 8)
    ids = [c for c in range(-40, 400) if c % 7]
    members = spark.createDataFrame([(b"n", c) for c in ids] + [(b"m", 9)], "id binary, conv_id long")
    out = {bytes(r.id): r.ends_sha256 for r in convtrie.ends(members).collect()}
    assert out == {b"n": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), b"m": hashlib.sha256(b"9").hexdigest()}


def test_bits_are_the_tree():
    ids = np.array([b"a", b"b", b"c", b"d", b"e"], "S16")
    trie = convtrie.Louds(ids, np.array([b"", b"a", b"a", b"c", b""], "S16"), np.array([4, 5, 5, 6, 1]))
    assert "".join("01"[int(b)] for b in trie.bits) == "110" + "110" + "0" + "0" + "10" + "0"
    assert list(trie.labels) == [b"a", b"e", b"b", b"c", b"d"] and list(trie.parents()) == [0, 0, 1, 1, 4] and list(trie.degrees()) == [2, 2, 0, 0, 1, 0]
    assert trie.levels() == [(1, 3), (3, 5), (5, 6)]
    assert list(trie.rolled_up(np.array([0, 1, 1, 1, 1, 1]))[0]) == [5, 4, 1, 1, 2, 1]
    empty = convtrie.Louds(ids[:0], ids[:0], np.zeros(0, int))
    assert empty.levels() == [] and list(empty.bits) == [False]
