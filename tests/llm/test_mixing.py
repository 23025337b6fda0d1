from collections import defaultdict
from fractions import Fraction

from veridale.llm import mixing
from veridale.llm.queries import op8_mixing
from veridale.operators import graph


def targets(sizes):
    """source -> target, by resharing the excess until none is above."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    left, stopped = Fraction(sum(sizes.values())), {}
    while True:
        open_ = [s for s in order if s not in stopped]
        per = left / sum(weight[s] for s in open_) if open_ else 0
        above = [s for s in open_ if per * weight[s] > 3 * sizes[s]]
        if not above:
            return {s: float(stopped.get(s, per * weight[s])) for s in order}
        for s in above:
            stopped[s] = Fraction(3 * sizes[s])
            left -= stopped[s]


def test_op8_meets_targets_and_repeats(spark):
    d = "/root/testdata/sf0.01"
    rows = op8_mixing(spark, d).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        text = docs[r.doc_id].text or ""
        assert r.size == len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w])
        assert 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * want[r.source]
    for s in want:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s], s
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in op8_mixing(spark, d).collect()}


def test_small_sources_stop_and_odd_rows(spark):
    made = [(k, "w " * 100, "big", "x") for k in range(60)] + [(100 + k, "a b c", "a", None) for k in range(4)] + [(200, None, None, None), (None, "q r", None, None), (201, "  ", "empty", "")] + [(300, "same text", "rep", "")] * 5
    docs = spark.createDataFrame(made, "doc_id long, text string, source string, size string")
    rows = mixing.mixed(docs).collect()
    assert len(rows) == len(made)
    sizes, taken, got = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        got[r.source] = r.target
    want = targets(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)
    assert taken["a"] == 3 * sizes["a"] and taken["empty"] == 0 and taken["rep"] == 3 * sizes["rep"]
    assert abs(taken["big"] - want["big"]) <= 50
    assert mixing.mixed(docs.limit(0)).count() == 0


def plain_draw(rows, most):
    """The first `most` by random odds over inclusion odds, of rows with p and u."""
    return sorted(rows, key=lambda r: r["u"] / (1 - r["u"]) / (r["p"] / (1 - r["p"])))[:most]


def test_the_draw_is_pareto_order_sampling(spark, monkeypatch):
    made = [(k % 90 if k % 7 else None, " ".join(["w"] * (20 + 13 * (k % 40))), "ab"[k % 3 == 0]) for k in range(400)] + [(1000 + k, "x " * (30 + k), "c") for k in range(300)]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string")
    of = mixing.ranked(docs).withColumn("u", mixing._uniform(42)).collect()
    of = [r.asDict() for r in of]
    numbers = {(r["source"], r["class"]): r["most"] for r in mixing._numbers(mixing.ranked(docs), 42).collect()}
    classes = defaultdict(list)
    for r in of:
        if r["class"] is not None:
            classes[r["source"], r["class"]].append(r)
    assert set(numbers) == set(classes) and all(0 <= n <= len(classes[k]) for k, n in numbers.items())
    name = lambda r: (r["source"], r["doc_id"], r["digest"], r["copy"])
    want = {name(r) for k, rows in classes.items() for r in plain_draw(rows, numbers[k])}
    for edge, buckets, least in ((mixing.EDGE, mixing.BUCKETS, graph.LEAST), (2, 4, 10)):  # with one depth of buckets and with many, with one task a source and with several
        monkeypatch.setattr(graph, "LEAST", least)
        monkeypatch.setattr(mixing, "EDGE", edge)
        monkeypatch.setattr(mixing, "BUCKETS", buckets)
        got = mixing.drawn(mixing.ranked(docs).where("class is not null"), mixing._numbers(mixing.ranked(docs), 42)).collect()
        assert len(got) == sum(map(len, classes.values())) and {name(r.asDict()) for r in got if r.extra} == want


def test_documents_are_drawn_with_their_odds(spark):
    lengths = [40, 40, 45, 60, 60, 75, 90, 120, 150, 200, 260, 400]
    docs = spark.range(30 * 25 * len(lengths)).selectExpr("id as doc_id", f"repeat('w ', array({','.join(map(str, lengths))})[int(id % {len(lengths)})]) as text", f"concat('s', lpad(string(id div {25 * len(lengths)}), 3, '0')) as source")
    rows = mixing.mixed(docs, seed=7).collect()
    odds = {(r.source, r["size"]): (r.p, r.certain) for r in mixing.ranked(docs, seed=7).collect()}
    per = defaultdict(list)
    for r in rows:
        p, certain = odds[r.source, r["size"]]
        per[r["size"], round(p, 6)].append(r.copies - certain)
    assert len(per) > 20 and all(set(v) <= {0, 1} for v in per.values())
    for (size, p), got in per.items():
        assert len(got) >= 250 and abs(sum(got) / len(got) - p) < 0.09, (size, p, sum(got) / len(got))
    assert sum(abs(sum(got) / len(got) - p) for (_, p), got in per.items()) < 0.03 * len(per)


def test_rows_without_ids_are_drawn_one_by_one(spark):
    made = [(None, f"{'w ' * 50}{k}", "a") for k in range(200)] + [(None, "same words " * 30, "b")] * 300 + [(5, "z " * 30_000, "c")]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string")
    rows = mixing.mixed(docs).collect()
    assert len(rows) == len(made)
    for s in "ab":
        copies = {r.copies for r in rows if r.source == s}
        assert len(copies) > 1
