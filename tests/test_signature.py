"""Signature pictures against plain versions."""

import math
import random
import statistics

from veridale.operators import signature as sg

SCHEMA = "id long, signer string, width int, height int, pixels binary, first_id string"


def plain_similarity(a, b, w, h):
    """Every window on its own."""
    out = []
    for r in range(h - 6):
        for c in range(w - 6):
            x, y = ([p[(r + i) * w + c + j] for i in range(7) for j in range(7)] for p in (a, b))
            mx, my = sum(x) / 49, sum(y) / 49
            cov = sum((p - mx) * (q - my) for p, q in zip(x, y)) / 48
            out.append((2 * mx * my + 6.5025) * (2 * cov + 58.5225) / ((mx * mx + my * my + 6.5025) * (statistics.variance(x) + statistics.variance(y) + 58.5225)))
    return sum(out) / len(out)


def plain_hash(p):
    """Of a picture of 32 x 32, by the sum over all pixels for each frequency."""
    low = [round(sum(4 * p[i * 32 + j] * math.cos(math.pi * (2 * i + 1) * u / 64) * math.cos(math.pi * (2 * j + 1) * v / 64) for i in range(32) for j in range(32)), 6) for u in range(8) for v in range(8)]
    middle = statistics.median(low)
    return f"{int(''.join('01'[x > middle] for x in low), 2):016x}"


def test_against_plain_versions(spark):
    rng = random.Random(4)
    first = [rng.randrange(256) for _ in range(1024)]
    rows = [(5, "a", 32, 32, bytes(first), None)]
    for k, noise in enumerate((0, 5, 40, 255)):
        rows.append((6 + k, "a", 32, 32, bytes(min(255, max(0, p + rng.randint(-noise, noise))) for p in first), "x"))
    got = {r.id: r for r in sg.compared(spark.createDataFrame(rows, SCHEMA).repartition(3), None, None).collect()}
    assert sorted(got) == [6, 7, 8, 9]
    for k, _, w, h, pixels, _ in rows[1:]:
        want = plain_similarity(pixels, first, w, h)
        assert abs(got[k].similarity - want) < 1e-9 and got[k].hash == plain_hash(pixels)
        assert got[k].hash_distance == bin(int(plain_hash(pixels), 16) ^ int(plain_hash(first), 16)).count("1")
        assert got[k].verdict == ("pass" if want >= 0.85 else "suspect" if want >= 0.7 else "forged")
    assert got[6].similarity == 1.0 and got[9].verdict == "forged"


def test_sizes_and_odd_rows(spark):
    flat = lambda w, h, v: bytes([v]) * (w * h)
    stroke = lambda w, h: bytes(0 if abs(x * h - y * w) < w * h / 8 else 255 for y in range(h) for x in range(w))
    rows = [(1, "s", 64, 32, stroke(64, 32), None), (2, "s", 256, 128, stroke(256, 128), None), (3, "s", 64, 32, flat(64, 32, 255), None), (4, "s", 64, 32, b"short", None), (5, "s", 64, 32, None, None), (None, "s", 1, 1, b"x", None), (7, None, 1, 1, b"x", None), (8, "t", 3, 3, flat(3, 3, 9), None), (9, "t", 3, 3, flat(3, 3, 9), None), (10, "s", 64, 32, stroke(64, 32), None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: r for r in sg.compared(frame).collect()}
    assert sorted(got) == [2, 3, 9, 10]
    assert got[2].verdict == "pass" and got[10].similarity == 1.0 and got[3].verdict == "forged"
    assert got[9].similarity == 1.0 and got[9].hash_distance == 0
    small = {r.id: r for r in sg.compared(frame, None, None).collect()}
    assert small[9].similarity is None and small[9].verdict is None
    assert sg.compared(frame.limit(0)).count() == 0


def test_resizing_keeps_means_and_levels():
    w = sg.weights(10, 4)
    assert abs(w.sum(1) - 1).max() < 1e-12 and (w >= 0).all()
    up = sg.weights(2, 4) @ [[0.0], [8.0]]
    assert up.ravel().tolist() == [0.0, 2.0, 6.0, 8.0]
