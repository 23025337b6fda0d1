"""Files, logs, lifecycle, layout and clusters on small cases."""

import json

from pyspark.sql import functions as F

from veridale.operators import classify, cluster, events, layout, lifecycle
from veridale.sources import files


def test_scan_and_incremental(spark, tmp_path):
    for name in ("a.txt", "b.pdf", "~$c.txt", "out/d.txt", "sub/e.MD", "f.xyz"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(f"text of {name}\nline 2")
    found = files.scan(spark, str(tmp_path), "out")
    names = lambda f: sorted(r.path.rsplit("/", 1)[1] for r in f.collect())
    assert names(found) == ["a.txt", "b.pdf", "e.MD"]
    assert names(files.scan(spark, str(tmp_path), "out", recursive=True, include_all=True)) == ["a.txt", "b.pdf", "e.MD", "f.xyz"]
    index = found.where("path like '%a.txt'").withColumn("status", F.lit("completed"))
    assert names(files.changed(found, index)) == ["b.pdf", "e.MD"]
    assert files.texts(spark, str(tmp_path / "a.txt")).first().text == "text of a.txt\nline 2"
    got = files.extracted(spark.read.format("binaryFile").load(str(tmp_path / "a.txt")), "path string, page int, text string", lambda p, c: [(p, k, t) for k, t in enumerate(c.decode().split("\n"))])
    assert [(r.page, r.text) for r in got.collect()] == [(0, "text of a.txt"), (1, "line 2")]


def test_json_stores(spark, tmp_path):
    rules = tmp_path / "rules"
    rules.mkdir()
    (rules / "a.json").write_text(json.dumps({"rule_id": "R1", "level": "L1"}, indent=1))
    (rules / "b.json").write_text(json.dumps({"other": 1}))
    (rules / "c.json").write_text("{broken")
    assert [r.rule_id for r in files.json_records(spark, str(rules), "rule_id string, level string", "rule_id").collect()] == ["R1"]
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([("2026-07-31", "E1"), ("2026-08-01", "E2")], "date string, event_id string")
    files.append_lines(rows, log)
    files.append_lines(rows.limit(1), log)
    assert files.json_lines(spark, log, "event_id string, date date").count() == 3
    assert "<td>3</td>" in files.html_report(spark.createDataFrame([(3,)], "n int"), "t")


def test_numbers_continue(spark):
    new = spark.createDataFrame([("2026-01-01", 5), ("2026-01-01", 6)], "date string, ts int").withColumn("date", F.col("date").cast("date"))
    last = spark.createDataFrame([("2026-01-01", 999)], "date string, last_number int").withColumn("date", F.col("date").cast("date"))
    assert sorted(r.event_id for r in events.numbered(new, "EVT", last).collect()) == ["EVT-20260101-1000", "EVT-20260101-1001"]


def test_trials_and_downgrades(spark):
    rows = spark.createDataFrame([("R", "a", 5, 0), ("R", "b", 3, 1), ("S", "a", 30, 1), ("S", "b", 1, 0), ("S", "c", 1, 0)], "rule_id string, project string, hits int, false_positives int")
    assert {r.rule_id: (r.hits, r.fp_rate, r.eligible) for r in lifecycle.trials(rows).collect()} == {"R": (8, 0.125, False), "S": (32, 0.03125, True)}
    rules = spark.createDataFrame([(f"R{k}", f"L{k}", "active", "1.0.0") for k in (1, 2, 3)], "rule_id string, level string, status string, version string")
    got = {r.rule_id: (r.level, r.status, r.version) for r in lifecycle.downgraded(rules, rules).collect()}
    assert got == {"R1": ("L1", "active", "1.0.0"), "R2": ("L3", "active", "1.0.1"), "R3": ("L3", "deprecated", "1.0.1")}


def test_layout(spark):
    items = spark.createDataFrame(
        [("d", 1, 1, "a", 0.9, 0.0, 0.0, 10.0, 10.0), ("d", 1, 2, "a", 0.8, 1.0, 1.0, 10.0, 10.0), ("d", 1, 3, "b", 0.7, 20.0, 3.0, 30.0, 12.0), ("d", 1, 4, "c", 0.7, 0.0, 40.0, 10.0, 50.0)],
        "doc_id string, page int, item long, text string, confidence double, x1 double, y1 double, x2 double, y2 double")
    kept = layout.without_overlaps(items)
    assert sorted(r.item for r in kept.collect()) == [1, 3, 4]
    rows = layout.text_rows(kept)
    assert {r.item: r.text_row for r in rows.collect()} == {1: 0, 3: 0, 4: 1}
    assert layout.table_text(rows).first().text == "a  b\nc"


def test_clusters(spark):
    base = "pile length is wrong on page".split()
    sets = spark.createDataFrame([(1, base), (2, base + ["one"]), (3, base + ["two"]), (4, ["other", "words", "here"]), (5, [])], "id long, tokens array<string>")
    pairs = cluster.similar_pairs(sets, 0.7)
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(1, 2), (1, 3), (2, 3)]
    assert {r.id: r.cluster for r in cluster.dbscan(sets, 0.7, 3).collect()} == {1: 1, 2: 1, 3: 1, 4: -1, 5: -1}
    assert {r.id: r.cluster for r in cluster.greedy(sets, 0.7, 2).collect()} == {1: 1, 2: 1, 3: 1, 4: -1, 5: -1}


def test_classify(spark):
    f = spark.createDataFrame([("spec/GB50.pdf",), ("跑道 记录.pdf",), ("log.txt",), ("竣工图.dwg",)], "path string")
    got = {r.path: (r.label, r.source) for r in classify.classified(f, {"pavement": ["跑道"]}, {"weak": ["记录"]}, ["gb50"], ["readme"]).collect()}
    assert got == {"spec/GB50.pdf": (None, "reference"), "跑道 记录.pdf": ("pavement", "core"), "log.txt": ("general", "default"), "竣工图.dwg": ("general", "default")}
    assert f.where("path like '%dwg'").select(classify.drawing_type(F.col("path")).alias("k")).first().k == "as_built"


def test_small_files_are_packed_into_fewer_tasks(spark, tmp_path, monkeypatch):
    from veridale.sources import files

    monkeypatch.setattr(files, "TASKS", 3)
    for k in range(300):
        (tmp_path / f"{k}.txt").write_text(f"text {k}")
    raw = spark.read.format("binaryFile").load(str(tmp_path))
    found = files.extracted(files.packed(raw), "path string, text string", lambda path, content: [(path, content.decode())])
    assert raw.rdd.getNumPartitions() > 3 and found.rdd.getNumPartitions() == 3
    assert sorted(r.text for r in found.collect()) == sorted(f"text {k}" for k in range(300))


def test_files_are_made_in_slices():
    """A batch of any size is made into files a slice at a time, with nothing lost."""
    import pandas as pd
    from veridale.plans import source_queries as sq

    got = [*sq._cut(iter([pd.DataFrame({"a": range(300)}), pd.DataFrame({"a": range(300, 303)})]))]
    assert max(map(len, got)) <= sq.FILES < 300 and [x for g in got for x in g["a"]] == [*range(303)]


def _filled(spark, folder, n, folders):
    """n files of three suffixes in numbered folders, with one that a failed task left."""
    name = F.concat(F.col("id").cast("string"), F.lit("."), F.get(F.array(F.lit("txt"), F.lit("pdf"), F.lit("xyz")), (F.col("id") % 3).cast("int")))
    contents = spark.range(0, n, 1, 3).select(name.alias("name"), F.encode(F.concat(F.lit("text ö "), F.col("id").cast("string")), "utf-8").alias("content"))
    for _ in range(2):  # a task that runs again
        assert files.saved(contents, folder, folders).distinct().count() == n
    return [f"{k}.{('txt', 'pdf', 'xyz')[k % 3]}" for k in range(n)]


def test_many_files_are_dealt_to_folders_that_tasks_list(spark, tmp_path):
    """No folder has all files, no more tasks than folders read them, and the scan is that of Spark's reader."""
    names = _filled(spark, str(tmp_path), 600, 8)
    (tmp_path / "0" / ".left").write_text("half")
    found = [sorted(p.name for p in at.iterdir() if p.name != ".left") for at in tmp_path.iterdir()]
    assert sorted(x for at in found for x in at) == sorted(names) and len(found) == 8 and max(map(len, found)) < 150
    for every in (False, True):
        dealt = files.scan(spark, str(tmp_path), include_all=every, folders=8)
        rows = lambda f: sorted(tuple(r) for r in f.withColumn("path", F.regexp_replace("path", "^file:", "")).withColumn("modified", F.unix_millis("modified")).collect())
        assert dealt.rdd.getNumPartitions() <= 8
        assert rows(dealt) == rows(files.scan(spark, str(tmp_path), include_all=every)) and dealt.count() == (600 if every else 400)


def test_content_is_handed_on_in_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "BYTES", 50)
    _filled(spark, str(tmp_path), 90, 2)
    got = files.with_content(files.listed(spark, str(tmp_path), 2), str(tmp_path)).collect()
    assert sorted(bytes(r.content).decode() for r in got) == sorted(f"text ö {k}" for k in range(90)) and all(r.length == len(r.content) for r in got)


def test_texts_of_many_folders(spark, tmp_path):
    """The texts of dealt files are read by no more tasks than there are folders, and are those of Spark's reader, which passes over empty files."""
    _filled(spark, str(tmp_path), 200, 4)
    files.saved(spark.createDataFrame([("200.md", bytearray(b"a\r\nb\n")), ("201.md", bytearray()), ("202.mdx", bytearray(b"no"))], "name string, content binary"), str(tmp_path), 4).count()
    got = files.texts(spark, str(tmp_path), 4)
    rows = lambda f: sorted((r.path.rsplit("/", 1)[1], r.text) for r in f.collect())
    assert got.rdd.getNumPartitions() <= 4 and ("200.md", "a\r\nb\n") in rows(got)
    assert rows(got) == sorted([*rows(files.texts(spark, str(tmp_path))), ("201.md", "")]) and got.count() == 69


def test_documents_without_text_are_files_too(spark, tmp_path):
    from hashlib import sha256

    from veridale import plans

    texts = {1: None, 2: "", 5: "a\r\nö\n", 7: "no known suffix", 8: " "}
    spark.createDataFrame([*texts.items()], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, plans.QUERIES["sc6_texts"](spark, str(tmp_path)).collect())) == [(k, x or "") for k, x in texts.items()]
    want = [(k, "pdf" if k == 2 else "text", len((x or "").encode()), sha256((x or "").encode()).hexdigest()) for k, x in texts.items() if k != 7]
    assert sorted(map(tuple, plans.QUERIES["sc4_batch_sniff"](spark, str(tmp_path)).collect())) == want


def test_tf_idf_counts_repeated_and_odd_ids(spark, monkeypatch):
    """Against a plain version: ids in several rows, no id, no text, single letters, letters whose lower case is ASCII, a slice for each few texts."""
    import math
    import re
    from collections import Counter, defaultdict

    monkeypatch.setattr(cluster, "TEXT", 20)
    odd = [(1, "ab ab a b_c"), (2, None), (3, ""), (4, "x y z"), (5, "AB\u212aö_9 ab\nab"), (None, "ab no id"), (None, "cd"), (1, "ab again"), (7, "ö"), (8, "end zz")]
    for rows in (odd, [(k, x) for k, (_, x) in enumerate(odd)], odd[1:4]):
        counts = defaultdict(Counter)
        for k, x in rows:
            counts[k].update(re.findall("[a-z0-9_]{2,}", (x or "").lower()))
        df = Counter(w for c in counts.values() for w in c)
        want = {(k, w): tf * (math.log((len(rows) + 1) / (df[w] + 1)) + 1) for k, c in counts.items() for w, tf in c.items()}
        made = cluster.tf_idf(spark.createDataFrame(rows, "id long, text string").repartition(3)).collect()
        got = {(r.id, r.token): r.weight for r in made}
        assert len(made) == len(want) and got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)


def test_tf_idf_sends_a_token_once_for_many_texts():
    import pyarrow as pa

    low = pa.array([b"some words of a text that all have"] * 500 + [None, b"", b"other words"])
    got = pa.Table.from_batches(cluster._counts(iter([pa.RecordBatch.from_arrays([pa.array(range(503)), low], ["id", "low"])]))).to_pylist()
    assert len(got) == 8 and {r["token"]: r["n"] for r in got} == {w: 500 for w in "some of text that all have".split()} | {"words": 501, "other": 1}
    assert all(len(r["ids"]) == len(r["tfs"]) == r["n"] for r in got)
