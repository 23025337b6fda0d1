"""What is kept up to date, added once, numbered over ranges or evaluated together, against plain versions."""

import collections
import datetime
import random

import pytest
from pyspark.sql import functions as F

from veridale.operators import catalog, folds, numbering, rules
from veridale.sources import store
from veridale.streaming import trials

ROWS = "id long, name string"


def test_batches_are_added_once(spark, tmp_path):
    to = str(tmp_path / "log")
    frame = lambda *ids: spark.createDataFrame([(i, f"n{i}") for i in ids], ROWS)
    got = lambda **o: sorted(r.id for r in store.read(spark, to, ROWS, **o).collect())
    assert got() == [] and store.entries(spark, to) == []
    assert store.append(frame(1, 2), to, "a") and not store.append(frame(1, 2), to, "a")
    dead = store.stage(frame(3), to)  # fails between data and entry
    assert got() == [1, 2]
    assert store.append(frame(3), to, "b/with odd: name") and got() == [1, 2, 3]
    assert not store.commit(spark, to, "b/with odd: name", dead)
    assert got(after=1) == [3] and got(upto=1) == [1, 2] and store.append(frame().limit(0), to, "empty")
    assert store.swept(spark, to) == 1 and got() == [1, 2, 3]


def test_of_two_entries_of_a_batch_the_first_counts(spark, tmp_path):
    to = str(tmp_path)
    one, two = (store.stage(spark.createDataFrame([(i, "x")], ROWS), to) for i in (1, 2))
    at = store.Folder(spark, to)
    assert at.published("log/00000000000000000007.json", f'{{"batch": "a", "attempt": "{one}"}}')
    assert not at.published("log/00000000000000000007.json", "lost")
    assert at.published("log/00000000000000000009.json", f'{{"batch": "a", "attempt": "{two}"}}')
    assert [r.id for r in store.read(spark, to, ROWS).collect()] == [1]


def plain_stats(rows):
    hits, false, audits, last = collections.Counter(), collections.Counter(), collections.defaultdict(set), {}
    for kind, rule, audit, ts in rows:
        if kind == "hit":
            hits[rule] += 1
            audits[rule].add(audit)
            last[rule] = max(ts, last.get(rule, ts))
        else:
            false[rule] += 1
    return {r: (hits[r], len(audits[r]), false[r], last.get(r)) for r in hits | false}


def test_folds_read_new_logs_only(spark, tmp_path, monkeypatch):
    log, to = str(tmp_path / "log"), str(tmp_path / "stats")
    rng, day = random.Random(1), datetime.datetime(2026, 1, 1)
    made = [[(rng.choice(["hit", "hit", "false_positive"]), f"R{rng.randrange(5)}", f"A{rng.randrange(6)}", day + datetime.timedelta(seconds=rng.randrange(10**6))) for _ in range(60)] for _ in range(4)]
    assert folds.fold(spark, log, to) == 0 and folds.stats(spark, to).count() == 0
    reads = []
    real = store.read
    monkeypatch.setattr(store, "read", lambda *a, **o: reads.append(real(*a, **o)) or reads[-1])
    for k, rows in enumerate(made):
        store.append(spark.createDataFrame(rows, folds.LOG), log, f"day {k}")
        if k == 1:
            continue  # the third run takes two at once
        assert folds.fold(spark, log, to) == (2 if k == 2 else 1)
        seen = {f.rsplit("/", 2)[1] for f in reads[-1].inputFiles()}
        assert len(seen) == (2 if k == 2 else 1)
        got = {r.rule_id: (r.hits, r.reviews, r.false_positives, r.last_hit) for r in folds.stats(spark, to).collect()}
        assert got == plain_stats([x for part in made[: k + 1] for x in part])
    assert folds.fold(spark, log, to) == 0


def test_a_fold_that_fails_or_loses_changes_nothing(spark, tmp_path, monkeypatch):
    log, to = str(tmp_path / "log"), str(tmp_path / "stats")
    row = ("hit", "R", "A", datetime.datetime(2026, 1, 1))
    store.append(spark.createDataFrame([row], folds.LOG), log, "1")
    with monkeypatch.context() as m:
        m.setattr(store.Folder, "published", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            folds.fold(spark, log, to)
    assert folds.stats(spark, to).count() == 0
    with monkeypatch.context() as m:
        m.setattr(store.Folder, "published", lambda *a: False)  # another run was first
        assert folds.fold(spark, log, to) == 0
    assert folds.fold(spark, log, to) == 1 and folds.stats(spark, to).first().hits == 1


def test_each_rule_is_announced_once_over_restarts(spark, tmp_path):
    to = str(tmp_path)
    schema = "test_id long, ts timestamp, rule_id string, project string, hits long, false_positives long"
    at = lambda m: datetime.datetime(2026, 1, 1, 0, m)
    batches = [
        [(1, at(1), "R1", "p1", 5, 0), (2, at(2), "R1", "p1", 3, 1), (3, at(1), "R2", "p1", 30, 1), (4, at(2), "R2", "p2", 1, 0), (5, at(3), "R2", "p3", 1, 0), (6, at(4), "R2", "p4", 0, 9), (7, at(1), None, "p", 1, 0), (8, at(1), "R3", None, 1, 0)],
        [(9, at(9), "R1", "p2", 10, 0), (10, at(8), "R1", "p3", 10, 0), (11, at(9), "R2", "p9", 50, 0), (12, at(9), "R3", "a", None, None), (13, at(10), "R3", "b", 0, 0)],
        [(14, at(11), "R3", "c", 0, 0), (15, at(12), "R1", "p4", 9, 0)]]
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{to}/in")
        found = trials.run(spark.readStream.schema(schema).parquet(f"{to}/in"), to)  # a new query from the same checkpoint
        seen.append(sorted(tuple(r) for r in found.collect()))
    r2 = ("R2", at(3), 32, 1, 3)
    assert seen[0] == [r2] and seen[1] == [("R1", at(9), 28, 1, 3), r2] and seen[2] == [("R1", at(9), 28, 1, 3), r2, ("R3", at(11), 0, 0, 3)]


def test_numbers_of_a_hot_key(spark):
    rng = random.Random(2)
    rows = [("hot", 5 if k % 3 else rng.randrange(900), k) for k in range(3000)] + [(None, k, k) for k in range(50)] + [("b", 1, 1), ("b", 0, 2)]
    frame = spark.createDataFrame(rows, "key string, ts int, id int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = numbering.numbered(frame, ["key"], ["ts", "id"], "k")
        assert out.columns == ["key", "ts", "id", "k"]
        got = out.collect()
        spread = numbering.numbered(frame, ["key"], ["ts"], "k").where("key = 'hot'").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {}
    for key in ("hot", None, "b"):
        want |= {(key, ts, i): n for n, (ts, i) in enumerate(sorted((ts, i) for k, ts, i in rows if k == key), 1)}
    assert {(r.key, r.ts, r.id): r.k for r in got} == want and len(got) == len(rows)
    assert spread > 1
    copies = numbering.numbered(spark.createDataFrame([("a", 1)] * 40, "key string, ts int"), ["key"], ["ts"], "k")
    assert sorted(r.k for r in copies.collect()) == list(range(1, 41))
    assert numbering.numbered(frame.limit(0), ["key"], ["ts"], "k").count() == 0


def test_pair_rules_together_are_pair_rules_one_by_one(spark):
    rng = random.Random(3)
    names = sorted({k for r in catalog.pair_rules() for k in r.join_keys})
    parties = []
    for _ in "ab":
        rows = [(*[rng.choice([None, "1", "2", "3"]) for _ in names], rng.choice([None, *range(6)])) for _ in range(150)]
        parties.append(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + ", v int"))
    a, b = parties
    checked = [r for r in catalog.pair_rules() if "unix_timestamp" not in r.check]
    got = rules.reconciled_together(a, b, checked, lambda r: "max(v)", lambda r: "min(v)")
    got = collections.Counter(tuple(r) for r in got.select("rule_id", "key", "side", "severity").collect())
    want = collections.Counter()
    for r in checked:
        one = rules.reconciled(a.groupBy(*r.join_keys).agg(F.max("v").alias("field_a")), b.groupBy(*r.join_keys).agg(F.min("v").alias("field_b")), r)
        want.update((r.rule_id, x.key, x.side, x.severity) for x in one.where("severity is not null").collect())
    assert got == want and len({side for _, _, side, _ in got}) == 3


def test_suspects_meet_items_on_grams_only(spark):
    from veridale.operators import review

    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    items = [(d, i, word(rng.randrange(0, 9)), float(i)) for d in range(6) for i in range(40)]
    suspects = [(d, s, word(rng.randrange(0, 7))) for d in range(7) for s in range(10)]
    frame = spark.createDataFrame([(*x, x[3], x[3], x[3]) for x in items], "doc_id int, item int, text string, x1 double, y1 double, x2 double, y2 double")
    asked = spark.createDataFrame(suspects, "doc_id int, suspect int, value string")
    got = {(r.doc_id, r.suspect): r.box.x1 + 20 if r.box else None for r in review.located_suspects(asked, frame).collect()}
    want = {(d, s): min((x for e, _, t, x in items if e == d and t and (v in t or t in v)), default=None) for d, s, v in suspects}
    assert got == want and any(x is None for x in want.values())
    pairs = {(r.doc_id, r.suspect, r["item"]) for r in review.may_hold(asked, frame).collect()}
    near = {(d, s, i) for d, s, v in suspects for e, i, t, _ in items if e == d and t and v and (v in t or t in v)}
    assert near <= pairs and len(pairs) < 0.6 * sum(1 for d, _, v in suspects for e, _, t, _ in items if e == d)


@pytest.mark.parametrize("direct", [0, 6, 1 << 20])
def test_suspects_and_items_meet_without_broadcasts(spark, monkeypatch, direct):
    """By grams, by both ways and by pairs; narrow sides are shuffled too."""
    from veridale.operators import review

    monkeypatch.setattr(review, "DIRECT", direct)
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    items = [(d, i, word(rng.randrange(0, 7)), float(i)) for d in range(6) for i in range(4 + 20 * (d % 2))]
    suspects = [(d, s, None if s == 7 else word(rng.randrange(0, 5))) for d in range(7) for s in range(8)]
    frame = spark.createDataFrame([(*x, x[3], x[3], x[3]) for x in items], "doc_id int, item int, text string, x1 double, y1 double, x2 double, y2 double")
    found = review.located_suspects(spark.createDataFrame(suspects, "doc_id int, suspect int, value string"), frame)
    got = [(r.doc_id, r.suspect, r.value, r.box.x1 + 20 if r.box else None) for r in found.collect()]
    want = {(d, s, v, min((x for e, _, t, x in items if e == d and v is not None and t and (v in t or t in v)), default=None)) for d, s, v in suspects}
    assert len(got) == len(suspects) and set(got) == want
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().sparkPlan().toString()


def test_cells_and_columns_by_their_form(spark):
    from veridale.operators import layout

    cells = {"2415": "Z415", "2.415": "Z415", "242O": "Z42D", "Z420": "Z42D", "415": "Z415", "241I": "Z41", "21l3,S": "2113.5", "2OB4.I": "2084.1", "10;35": "10:35", " 12.30 ": "12:30", "2103.72": "2103.72", "x": "x"}
    frame = spark.createDataFrame([(k,) for k in cells], "t string")
    assert {r.t: r.c for r in frame.select("t", layout.corrected_text(F.col("t"), True).alias("c")).collect()} == cells
    outside = {r.t: r.c for r in frame.select("t", layout.corrected_text(F.col("t")).alias("c")).collect()}
    assert outside["2415"] == "2415" and outside["2OB4.I"] == "2084.1" and outside["10;35"] == "10:35"
    item = "doc_id string, page int, item int, text string, x1 double, y1 double, x2 double, y2 double"
    rows = [("a", 1, 1, "number", 90.0, 0.0, 100.0, 9.0), ("a", 1, 2, "p x", 5.0, 0.0, 15.0, 9.0), ("b", 1, 1, "p far", 2.0, 0.0, 9.0, 9.0), ("b", 1, 2, "p 1", 20.0, 0.0, 40.0, 9.0), ("b", 1, 3, "p 2", 1.0, 0.0, 11.0, 9.0), ("c", 1, 1, "p", 80.0, 0.0, 90.0, 9.0)]
    got = {r.doc_id: (r.left, r.right) for r in layout.located_column(spark.createDataFrame(rows, item), ["^number$"], "p", 100.0).collect()}
    assert got == {"a": (88.0, 100.0), "b": (0.0, 15.0)}
