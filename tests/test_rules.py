"""Worked cases of the rule engine."""

from veridale.operators import catalog, rules as r

CU = r.Rule("CU-001", "CROSS_UNIT", "L2", "Sanity Check", "try_divide(abs(field_a - field_b), greatest(field_a, field_b)) <= 0.05", join_keys=("pile_no",), field_a="v", field_b="v")


def reconciled(spark, a, b):
    f = lambda rows: spark.createDataFrame(rows, "pile_no string, v double")
    return sorted((x.key, x.side, x.severity) for x in r.reconciled(f(a), f(b), CU).where("severity is not null").collect())


def test_reconcile_cases(spark):
    assert reconciled(spark, [("Z415", 13.0), ("Z417", 13.2)], [("Z415", 13.0), ("Z417", 9.0)]) == [("Z417", "both", "Sanity Check")]
    assert reconciled(spark, [("Z415", 13.0), ("Z999", 1.0)], [("Z415", 13.0)]) == [("Z999", "a", "Best Practice")]
    assert reconciled(spark, [("Z415", 13.0)], [("Z415", 13.0), ("Z9", 1.0)]) == [("Z9", "b", "Best Practice")]
    assert reconciled(spark, [("Z1", 0.0)], [("Z1", 0.0)]) == []
    assert reconciled(spark, [(None, 1.0)], [(None, 1.0)]) == []
    assert reconciled(spark, [("Z1", 5.0)], [("Z1", None)]) == []
    assert len(reconciled(spark, [("Z1", 1.0)], [("Z1", 2.0), ("Z1", 3.0)])) == 2


def test_seeded_reconcile(spark):
    import random

    for n, p in ((1000, 0.1), (6001, 0.1)):
        rng = random.Random(42)
        a, b = [], []
        for k in range(n):
            base = round(rng.uniform(10, 20), 2)
            a.append((f"Z{k:05d}", base))
            b.append((f"Z{k:05d}", base * 0.8 if rng.random() < p else base))
        want = sum(x[1] != y[1] for x, y in zip(a, b))
        assert len(reconciled(spark, a, b)) == want


def test_single_doc_and_missing_fields(spark):
    rows = [("D", 0, "rec", "Z415", 13.7, 2103.7, 2090.0), ("D", 1, "rec", "Z417", 9.0, 2103.7, 2090.0), ("E", 0, "other", "Z1", 9.0, 2103.7, 2090.0), ("D", 2, "rec", "Z418", None, 2103.7, 2090.0)]
    frame = spark.createDataFrame(rows, "doc_id string, row_index int, doc_type string, pile_no string, actual_length double, top_elev double, bottom_elev double")
    got = r.checked_rows(r.derived(frame), catalog.row_rules(("rec",)), context=("pile_no",)).where("rule_id = 'LG-001'").collect()
    assert [(x.doc_id, x.row_index, x.severity, x.context) for x in got] == [("D", 1, "Sanity Check", '{"pile_no":"Z417"}')]
    assert got[0].message.startswith("LG-001: actual_length 9.0")
    few = frame.drop("top_elev")
    assert r.checked_rows(few, catalog.row_rules(("rec",))).where("rule_id = 'LG-001'").count() == 0
    assert r.checked_rows(frame, catalog.row_rules(("*",))).count() == 0


def test_template_and_report(spark):
    frame = spark.createDataFrame([("Z1", None)], "pile_no string, diff double")
    assert frame.select(r.message("{pile_no}: {diff} {x}", frame.columns).alias("m")).first().m == "Z1: {diff} {x}"
    v = spark.createDataFrame([("L2", "Sanity Check")] * 2, "level string, severity string")
    assert {(x.part, x.name): x.n for x in r.report(v).collect()} == {
        ("total", "all"): 2, ("level", "L1"): 0, ("level", "L2"): 2, ("level", "L3"): 0, ("severity", "Fatal"): 0, ("severity", "Sanity Check"): 2, ("severity", "Best Practice"): 0}


def test_catalogue_is_complete():
    rows = catalog.entries()
    assert len(rows) == len({x[0] for x in rows}) == 93


def test_documents_dont_meet_rules_by_type(spark):
    """Documents of few types: rules are broadcast, so no task gets all documents of a type; rules with two types of one document are told once."""
    rules = [r.Rule("A", "SINGLE_DOC", "L1", "Fatal", "true", doc_types=("x", "y")), r.Rule("B", "SINGLE_DOC", "L1", "Fatal", "true", doc_types=("y", "*"))]
    documents = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "x"), (3, "z"), (None, "y"), (4, None)], "doc_id long, doc_type string")
    found = r.matching_type(r.as_frame(spark, rules), documents)
    assert "SortMergeJoin" not in found._jdf.queryExecution().toString()
    assert sorted((x.doc_id or 0, x.rule_id) for x in found.collect()) == [(0, "A"), (0, "B"), (1, "A"), (1, "B"), (2, "A")]
