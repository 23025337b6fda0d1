import random
import re

import xxhash

from veridale.llm import simhash
from veridale.llm.queries import op1_simhash


def brute_fp(text):
    t = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def brute_components(fps):
    """doc_id -> smallest doc_id reachable."""
    distinct = sorted(set(fps.values()))
    parent = {f: f for f in distinct}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for d, f in fps.items():
        least[root(f)] = min(d, least.get(root(f), d))
    return {d: least[root(f)] for d, f in fps.items()}


def test_op1_matches_brute_force(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op1_simhash(spark, small).collect()}
    fps = {d: brute_fp(t) for d, t in texts.items()}
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{f:016x}" for d, f in fps.items()}
    assert {d: r.component_id for d, r in got.items()} == brute_components(fps)


def test_odd_texts(spark):
    odd = [None, "", " \n", "A", "a", "a B", "a b c", "É é \x85 \x1c", "w " * 70000]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(odd)] + [(3, "A", "x")], "doc_id long, text string, fp string")
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(odd) + 1
    for r in rows:
        assert r.fp % (1 << 64) == brute_fp(odd[r.doc_id])
    assert {r.component_id for r in rows if r.doc_id < 3} == {0}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_links_sparse_and_dense(spark):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for seed in (rng.getrandbits(64), 0):  # many close to one another: postings over SMALL
        group = [seed]
        for _ in range(150):
            f = rng.choice(group)
            for _ in range(rng.choice((1, 2, 2, 3))):
                f ^= 1 << rng.randrange(64)
            group.append(f)
        for _ in range(120):  # all in the same two bytes
            group.append(seed ^ (rng.getrandbits(8) << 8) ^ (rng.getrandbits(8) << 56))
        fps |= set(group)
    signed = {d: (f - (1 << 64) if f >> 63 else f) for d, f in enumerate(sorted(fps))}
    frame = spark.createDataFrame([(f,) for f in signed.values()], "fp long")
    from veridale.operators.graph import components

    of = {r.node: r.component for r in components(simhash.links(frame).toDF("from", "to")).collect()}
    want = brute_components({d: f % (1 << 64) for d, f in signed.items()})
    groups = {}
    for d, f in signed.items():
        groups.setdefault(of.get(f, f), set()).add(want[d])
    assert all(len(v) == 1 for v in groups.values()) and len(groups) == len(set(want.values()))


def test_the_tally_counts_shared_bytes_and_prunes(spark):
    rng = random.Random(4)
    fps = []
    for _ in range(60):
        f = rng.getrandbits(64)
        # one to four other bytes: four keep a common prefix at most
        fps += [f, *(f ^ sum(rng.randrange(1, 256) << 8 * p for p in rng.sample(range(8), n)) for n in (1, 2, 3, 4))]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    from pyspark.sql import functions as F

    fours = F.array(*[F.lit(simhash._mask(s)) for s in simhash.FOURS])
    posted = simhash._posted(frame, fours)
    pairs = {(r.a % (1 << 64), r.b % (1 << 64)): r.shared for r in simhash.tallied(posted).collect()}
    shared = lambda a, b: sum((a ^ b) >> 8 * p & 255 == 0 for p in range(8))
    assert pairs and all(n == shared(a, b) for (a, b), n in pairs.items())
    close = {p for p, n in pairs.items() if n >= simhash.NEEDED}
    assert len(close) < len(pairs)
    assert {frozenset(p) for p in close} == {frozenset((a, b)) for i, a in enumerate(fps) for b in fps[i + 1 :] if shared(a, b) >= simhash.NEEDED}
