from veridale.operators import charts


def test_all_of_one_result_is_two_half_rings(spark):
    rows = charts.ring(spark.createDataFrame([(1, "fail"), (2, "fail"), (3, None), (4, "other")], "doc_id long, result string")).orderBy("piece").collect()
    assert [(r.result, r.piece, r.n, r.share, r.start, r.end) for r in rows] == [("fail", 0, 2, 1.0, -90.0, 90.0), ("fail", 1, 2, 1.0, 90.0, 270.0)]
    assert rows[0].path == "M 140.0 10.0 A 130.0 130.0 0 0 1 140.0 270.0 L 140.0 211.5 A 71.5 71.5 0 0 0 140.0 68.5 Z"


def test_ring_goes_round_in_order(spark):
    rows = charts.ring(spark.createDataFrame([("suspicious",), ("pass",), ("pass",), ("pass",)], "result string")).orderBy("start").collect()
    assert [(r.result, r.start, r.end, r.colour) for r in rows] == [("pass", -90.0, 180.0, "#34a853"), ("suspicious", 180.0, 270.0, "#e37400")]
    assert " 0 1 1 " in rows[0].path and " 0 0 1 " in rows[1].path


def test_nothing_to_draw(spark):
    none = spark.createDataFrame([], "unit string, result string")
    assert charts.ring(none).count() == 0 and charts.bars(none, "unit").count() == 0
    assert charts.bars(spark.createDataFrame([("a", "pass")], none.schema), "unit").count() == 0


def test_bars_are_ranked_with_ties_and_long_labels(spark):
    made = [("b", "fail"), ("a", "suspicious"), (None, "fail"), ("a label of many characters", "fail"), ("a label of many characters", "suspicious"), ("c", "pass"), ("d", None)]
    rows = charts.bars(spark.createDataFrame(made, "unit string, result string"), "unit").orderBy("y").collect()
    assert [(r.label, r.shown, r.y) for r in rows] == [("a label of many characters", "a label of …", 20.0), ("-", "-", 54.0), ("a", "a", 88.0), ("b", "b", 122.0)]
    assert [(r.fail_width, r.suspicious_x, r.suspicious_width, r.total_x) for r in rows][:2] == [(210.0, 370.0, 210.0, 586.0), (210.0, 370.0, 0.0, 376.0)]
