import hashlib
import random

import numpy as np

from veridale.llm import suffix
from veridale.llm.queries import op4_suffix_dedup


def brute(texts):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256), documents in the order of ids."""
    seen, out = set(), {}
    for d in sorted(texts):
        b = (texts[d] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def test_op4_matches_brute_force(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r[1:]) for r in op4_suffix_dedup(spark, small).collect()}
    assert got == brute(texts)


def test_odd_texts(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé \0") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(5)]
    texts = [None, "", "a" * 99, "a" * 100, "a" * 300, "ab" * 400, "a" * 101, passages[0], passages[0]]
    for _ in range(60):
        p = rng.choice(passages)
        i, j = sorted(rng.sample(range(len(p)), 2))
        texts.append(word() + p[i:j] + word() + rng.choice(passages)[: rng.randint(50, 250)])
    want = brute(dict(enumerate(texts)))
    rows = [(d, t, 0) for d, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string, at int")
    got = suffix.without_repeats(docs).collect()
    assert len(got) == len(texts) + 1
    assert {r.doc_id: tuple(r[1:]) for r in got} == want
    assert suffix.without_repeats(docs.limit(0)).count() == 0


def test_shared_prefixes():
    rng = random.Random(5)
    for _ in range(20):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60))) for _ in range(20)]
        text = np.concatenate([np.append(np.frombuffer(s, dtype=np.uint8).astype(np.int64) + 1, 0) for s in strings])
        order, border = suffix.shared_prefixes(text, 12)
        groups, k = {}, 0
        for at, b in zip(order, border):
            k += b
            groups[at] = k
        t = text.tolist()
        whole = [i for i in range(len(t)) if len(t[i : i + 12]) == 12]
        first = {}
        for i in whole:
            assert first.setdefault(tuple(t[i : i + 12]), groups[i]) == groups[i]
        assert len(set(first.values())) == len(first)


def test_removed_windows_and_long_documents():
    import pandas as pd

    rng = np.random.default_rng(1)
    seg = [bytes(rng.integers(97, 99, 150, dtype=np.uint8)) for _ in range(4)]
    seg.append(seg[0][:120] + seg[1][:30])
    block = pd.DataFrame({"h": 1, "doc": range(5), "d2": 0, "at": [51] * 5, "bytes": seg})
    assert suffix._removed_windows(block).values.tolist() == [[4, 0, 21]]
    data = bytes(rng.integers(97, 123, 3 * suffix.PIECE + 50, dtype=np.uint8))
    batch = pd.DataFrame({"doc": [1], "d2": [0], "data": [data]})
    found = pd.concat(suffix._segments(iter([batch])))
    assert (found["at"] & suffix.MASK).sum() == len(data) - 99


def test_large_grams_are_split_and_settled_alike(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(80))
    texts = {k: f"{word()} {word()} {passage[rng.randint(0, 40) :]} {word()}" for k in range(60)}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    docs = docs.unionByName(docs.limit(3))
    assert {r.doc_id: tuple(r[1:]) for r in suffix.without_repeats(docs).collect()} == brute(texts)
    monkeypatch.setattr(suffix, "BLOCK", 100)  # of the plan; tasks keep theirs
    held = []
    monkeypatch.setattr(suffix, "_of_large_grams", lambda cut, own=suffix._of_large_grams: held.append(cut.count()) or own(cut))
    assert {r.doc_id: tuple(r[1:]) for r in suffix.without_repeats(docs).collect()} == brute(texts)
    assert held and held[0] > 4


def test_a_block_of_one_window_keeps_its_earliest_copy(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(suffix, "BLOCK", 1000)
    one, two, three = (bytes([97 + k]) * 60 + b"x" * 40 for k in range(3))
    rows = [(1, 1, d, 0, 1, one) for d in range(500)] + [(2, 2, 7, 0, 1, two), (2, 2, 9, 0, 1, three), (2, 2, 11, 0, 1, two)] + [(3, 3, d, 0, 1, b"%0100d" % d) for d in range(40)]
    frame = pd.DataFrame(rows, columns=["k", "g", "doc", "d2", "at", "bytes"])
    batches = [frame.iloc[k : k + 37] for k in range(0, len(frame), 37)]
    out = [(r.k, r.doc, r.gone) for r in pd.concat(suffix._first_windows(iter(batches))).itertuples()]
    assert len(out) == len(frame)
    assert [d for k, d, gone in out if k == 1 and not gone] == [0] and [d for k, d, gone in out if k == 2 and gone] == [11] and not any(gone for k, _, gone in out if k == 3)


def test_rows_of_one_id_with_different_texts(spark):
    a, b = "abcdefghij" * 30, "".join(chr(97 + (k * k) % 26) for k in range(400))
    docs = spark.createDataFrame([(1, a), (1, b), (None, b), (2, a[:150])], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffix.without_repeats(docs).collect()), key=repr)
    assert [(d, n) for d, n, _ in got] == [(1, 300), (1, 400), (2, 150), (None, 400)]
    removed = {(d, n): x for d, n, x in got}
    assert removed[2, 150] == 150 and removed[1, 400] == 400


def test_hashes_that_collide_change_no_result(spark, monkeypatch):
    """Only the digests of bytes decide: with grams and windows hashed to a few values, and with common grams met by digest."""
    from pyspark import cloudpickle

    strong = suffix._Hasher

    class Weak(strong):
        def of(self, start, end):
            return strong.of(self, start, end) & np.uint64(3)

        def grams(self, n):
            return strong.grams(self, n) & np.uint64(0x3000000000000000)

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(60))
    texts = {k: f"{word()} {passage[rng.randint(0, 40) : rng.randint(150, 300)]} {word()}" for k in range(30)} | {40: passage, 41: passage}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(3)
    want = brute(texts)
    assert {r.doc_id: tuple(r[1:]) for r in suffix.without_repeats(docs).collect()} == want
    monkeypatch.setattr(suffix, "COMMON", 2)
    assert {r.doc_id: tuple(r[1:]) for r in suffix.without_repeats(docs).collect()} == want
    monkeypatch.setattr(suffix, "_Hasher", Weak)
    cloudpickle.register_pickle_by_value(suffix)  # tasks get what is patched
    try:
        assert {r.doc_id: tuple(r[1:]) for r in suffix.without_repeats(docs).collect()} == want
        monkeypatch.setattr(suffix, "BLOCK", 500)
        assert {r.doc_id: tuple(r[1:]) for r in suffix.without_repeats(docs).collect()} == want
    finally:
        cloudpickle.unregister_pickle_by_value(suffix)


def test_copies_within_a_piece_need_no_partner():
    """A later copy, and what a document repeats itself, is a run of its own; rows of one document aren't earlier than each other."""
    import pandas as pd

    rng = np.random.default_rng(4)
    a, b = (bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (700, 400))
    batch = pd.DataFrame({"doc": [5, 3, 3, 9], "d2": [0, 0, 0, 0], "data": [a, a, a, b + a[:300]]})
    found = pd.concat(suffix._segments(iter([batch])))
    late = found[found["later"]]
    assert late[late["doc"] == 5]["at"].tolist() == [601]
    assert not (late["doc"] == 3).any() and (found["doc"] == 3).sum() % 2 == 0
    own = late[late["doc"] == 9]["at"].tolist()
    assert len(own) == 1 and own[0] >> suffix.SHIFT >= 400
