"""Worked cases of the detectors."""

import datetime

from pyspark.sql import functions as F

from veridale.functions import text as x
from veridale.operators import quality as q
from veridale.operators import tables as tab


def values(spark, *v):
    return spark.createDataFrame([("d", "c", k, None if a is None else float(a)) for k, a in enumerate(v)], "doc string, col string, row int, v double")


def test_repeats(spark):
    codes = lambda *v: [r.code for r in q.repeats(values(spark, *v)).collect()]
    assert codes(*[0.2, 0.3] * 3) == ["DQ-REPEAT-01"]
    assert codes(1, 1, 1, 2, 2, 2) == ["DQ-REPEAT-02"]
    assert codes(7, 7, 7, 7) == ["DQ-REPEAT-03"]
    assert codes(1, 2, 3, 1, 1, 1, 1, 1, 1, 1, 1) == ["DQ-REPEAT-04"]
    assert codes(1, 1, 1) == []


def test_jumps(spark):
    got = q.jumps(values(spark, 13.7, 13.7, 13.2, 9.0, 9.0, 8.5)).collect()
    assert [(r.from_value, r.to_value, r.severity) for r in got] == [(13.2, 9.0, "medium")] and abs(got[0].change - 0.318) < 1e-3
    assert q.jumps(values(spark, 0, 5)).count() == 0


def test_gaps_and_ids(spark):
    n = spark.createDataFrame([("d", k) for k in (1, 2, 5, 6, 9, 9)], "doc string, n long")
    assert sorted(tuple(r)[1:] for r in q.gaps(n).collect()) == [(3, 4, 2), (7, 8, 2)]
    d = spark.createDataFrame([("d", datetime.date(2026, 4, 1)), ("d", datetime.date(2026, 4, 3))], "doc string, d date")
    assert [tuple(r)[1:] for r in q.date_gaps(d).collect()] == [(datetime.date(2026, 4, 2), datetime.date(2026, 4, 2), 1)]
    ids = spark.createDataFrame([("K0+120",), ("Z370",)], "id string")
    assert [r.n for r in ids.select(x.trailing_number(F.col("id")).alias("n")).collect()] == [None, 370]


def test_confusions(spark):
    ids = spark.createDataFrame([("d", k, i) for k, i in enumerate(("Z370", "Z371", "Z372", "2373"))], "doc string, row int, id string")
    assert [(r.id, r.suspected, r.confidence) for r in q.prefix_confusion(ids, "Z", "2").collect()] == [("2373", "Z373", "high")]
    c = {r.v: r.candidates for r in q.range_confusion(values(spark, 0.96, 1.98, 1.2), 1.0, 1.6).collect()}
    assert c == {0.96: [], 1.98: [1.38]}
    v = spark.createDataFrame([("1O.5l",)], "value string")
    assert sorted(r.suspected for r in q.letters_in_numbers(v).collect()) == ["10.5l", "1O.51"]


def test_row_gate_and_duplicates(spark):
    rows = spark.createDataFrame([("d", "Z1", 1), ("d", "Z2", 2), ("d", "Z1", 3)], "doc string, id string, row int")
    assert [(r.id, r.row) for r in q.duplicates(rows).collect()] == [("Z1", 3)]
    expected = spark.createDataFrame([("d", 6), ("e", 2)], "doc string, expected int")
    assert sorted((r.doc, r.code) for r in q.row_count_check(rows, expected).collect()) == [("d", "DQ-SELF-ROW-01"), ("e", "DQ-SELF-ROW-02")]


def test_cleaning(spark):
    raw = "Ａｂ１​“x”\n\n\n\nMH\n5078 a\nb\nc "
    got = spark.createDataFrame([(raw,)], "t string").select(x.cleaned(F.col("t")).alias("t")).first().t
    assert got == 'Ab1±"x"\n\nMH5078 ab\nc'


def test_tables(spark):
    text = "=== 第 2 页 ===\n桩号  实长  桩顶高程  桩底高程\nZ1  13.7  2103.7  2090.0\nZ2  9.0  2103.7  x\n=== 第 3 页 ===\nZ3  1  2  3"
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    aliases = {"实长": "actual_length", "桩顶高程": "top_elev", "桩底高程": "bottom_elev", "桩号": "pile_no"}
    rows = tab.domain_rows(docs, aliases, "pile_no").orderBy("line_no").collect()
    assert [(r.page, r.line_no, r.cells) for r in rows] == [(2, 2, {"pile_no": "Z1", "actual_length": "13.7", "top_elev": "2103.7", "bottom_elev": "2090.0"}), (2, 3, {"pile_no": "Z2", "actual_length": "9.0", "top_elev": "2103.7", "bottom_elev": "x"})]
    generic = spark.createDataFrame([("g", "Item No Item\nbolt 3 4\nnut 5 6.5\n")], "doc_id string, text string")
    got = tab.generic_rows(generic).orderBy("line_no").collect()
    assert [r.cells for r in got] == [{"Item": "bolt", "No": "3", "Item_2": "4"}, {"Item": "nut", "No": "5", "Item_2": "6.5"}]
    kinds = {(r.name, r.kind) for r in tab.typed_cells(tab.generic_rows(generic)).collect()}
    assert kinds == {("Item", "string"), ("No", "int"), ("Item_2", "int"), ("Item_2", "double")}
    lines = tab.lines(spark.createDataFrame([("h", "Z415 1 2 3 4 x")], "doc_id string, text string"))
    assert [(r.id, r.numbers) for r in tab.heuristic_rows(lines).collect()] == [("Z415", [1.0, 2.0, 3.0, 4.0, None])]
