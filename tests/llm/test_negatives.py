import math
import random

import numpy as np

from veridale.llm import negatives
from veridale.llm.queries import op12_hard_negatives

SCHEMA = "vec_id long, label int, embedding array<float>, q string"


def brute(rows):
    """Rows (vec_id, label, vector) against all others, one by one."""
    part = [(v, (l + 1) % 10 if v is not None and v % 7 == 0 else l, [math.floor(256 * x) for x in e]) for v, l, e in rows if l is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    id_order, out = lambda v: (v is None, v or 0), []
    for a, (vec, label, q) in enumerate(part):
        if vec is None or vec % 100:
            continue
        others = sorted(((-sum(x * y for x, y in zip(q, r)), id_order(v), b, l) for b, (v, l, r) in enumerate(part) if b != a and len(r) == len(q)))
        for p in [o for o in others if o[3] == label][:5]:
            fits = [o for o in others if o[3] != label and 30 * -p[0] <= 100 * -o[0] <= 90 * -p[0]][:10]
            out += [(vec, part[p[2]][0], k + 1, part[o[2]][0], -p[0], -o[0]) for k, o in enumerate(fits)]
    return sorted(out, key=str)


def listed(found):
    return sorted(map(tuple, found.collect()), key=str)


def test_op12_matches_brute_force(spark, small):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert listed(op12_hard_negatives(spark, small)) == brute(rows)


def test_blocks_ties_and_a_hot_label(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 3)
    monkeypatch.setattr(negatives, "STEP", 50)
    rng = random.Random(2)
    vector = lambda: [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(6)]
    rows = [(k, 1 if k % 3 == 0 else k % 10, vector()) for k in range(1500)]
    rows += [(k, 2, rows[5][2]) for k in range(2000, 2300)]  # copies
    found = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5)
    assert listed(negatives.mined(found)) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.25]), (2, 2, [0.5, 0.5]), (None, 5, [0.5, 0.5]), (3, None, [1.0, 1.0]), (4, 2, None), (5, 2, [nan, 1.0]), (6, 2, [inf, 1.0]), (8, 2, [None, 1.0]), (9, 2, []), (100, 1, []), (101, 1, []), (200, 3, [0.1]), (201, 3, [0.3]), (202, 4, [0.1]),
            (300, 2, [0.7, 0.7]), (300, 2, [0.7, 0.7]), (302, 2, [0.9, 0.1]), (303, 9, [0.3, 0.4]), (303, 9, [0.3, 0.4]), (-100, 2, [0.0, 0.0])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    want = brute([(v, l, None if e is None else [None if x is None else float(np.float32(x)) for x in e]) for v, l, e in rows])
    assert listed(negatives.mined(frame)) == want and any(r[3] is None for r in want)
    assert negatives.mined(frame.limit(0)).count() == 0
    assert negatives.mined(frame.where("vec_id = 1")).count() == 0


def test_components_that_doubles_cannot_multiply_exactly(spark):
    rows = [(0, 1, [3e5, 1.0]), (1, 1, [2.9e5 + 1 / 256, -3.0]), (3, 1, [2.9e5, 3.0]), (2, 2, [1e5, 2.0]), (5, 2, [1e5, 2.0 + 1 / 256]), (4, 2, [9e4, 1.0])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA.replace("float", "double"))
    assert listed(negatives.mined(frame)) == brute(rows)
    huge = spark.createDataFrame([(0, 1, [1e300], "x"), (1, 1, [1e300], "x"), (2, 2, [1e306], "x")], SCHEMA.replace("float", "double"))
    assert negatives.mined(huge).count() == 0  # all scores are at a long's limit, outside the bands


def test_brackets_leave_rows_out(spark, monkeypatch):
    """Near a pivot most rows are settled without being multiplied out."""
    seen = []
    real = negatives._products
    monkeypatch.setattr(negatives, "_products", lambda a, x, most: seen.append(len(x)) or real(a, x, most))
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16))
    x = np.repeat(centres / np.linalg.norm(centres, axis=1)[:, None], 250, axis=0) + rng.normal(size=(2000, 16)) / 100
    rows = spark.createDataFrame([(k, k // 250, [float(v) for v in e], "x") for k, e in enumerate(x)], SCHEMA).coalesce(1)
    scaled = negatives.scaled(rows).collect()
    q, norm = np.array([r.q for r in scaled]), np.array([r.norm for r in scaled])
    pivots = negatives._pivots(negatives.scaled(rows), norm.max())
    near = negatives._distances(q, np.sqrt(norm.max() - norm), pivots)

    class Sent:
        value = negatives.Block(np.array([0]), np.array([scaled[0].label]), q[:1], negatives._distances(q[:1], np.zeros(1), pivots), norm.max(), 5)

    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"row": np.arange(2000), "vec_id": np.arange(2000), "label": np.array([r.label for r in scaled]), "q": list(q), "near": list(near)})
    found = next(negatives._sought(Sent)([batch.slice(at, 50) for at in range(0, 2000, 50)])).to_pandas()
    order = sorted((-int(q[0] @ q[k]), k) for k in range(1, 2000) if scaled[k].label == scaled[0].label)[:5]
    assert [(-s, k) for s, k in order] == list(zip(found["score"], found["vec_id"]))
    assert sum(seen) < 600
