"""The declared rules, by id: scope, level, severity, status and how each is checked.

Kinds: `process` has no data predicate (metadata only); `row` is a predicate over the columns of a row;
`pair` one over field_a and field_b of two parties joined by keys; any other kind is a function of
`templates` (or of `quality` or `cluster`) applied to the rule's tables.
"""

from __future__ import annotations

from .rules import Rule

# Id, scope, level, severity, kind, predicate or what is compared.
RULES = """
IR-001|SINGLE_DOC|L1|Fatal|process|
IR-002|SINGLE_DOC|L1|Fatal|process|
IR-003|SINGLE_DOC|L1|Fatal|process|
IR-004|SINGLE_DOC|L1|Fatal|process|
IR-005|SINGLE_DOC|L1|Fatal|process|
IR-006|SINGLE_DOC|L1|Fatal|process|
IR-007|SINGLE_DOC|L1|Fatal|process|
IR-008|SINGLE_DOC|L1|Fatal|process|
IR-010|SINGLE_DOC|L1|Fatal|process|
IR-011|SINGLE_DOC|L1|Fatal|process|
IR-015|CROSS_DOC|L1|Fatal|process|
IR-016|SINGLE_DOC|L1|Fatal|process|
IR-017|CROSS_DOC|L1|Fatal|process|
IR-018|SINGLE_DOC|L1|Fatal|process|
IR-019|SINGLE_DOC|L1|Fatal|process|
IR-020|SINGLE_DOC|L1|Fatal|process|
CU-001|CROSS_UNIT|L2|Sanity Check|pair|pile_no: try_divide(abs(field_a - field_b), greatest(field_a, field_b)) <= 0.05
CU-002|CROSS_UNIT|L2|Sanity Check|pair|project_no: field_a >= field_b
CU-003|CROSS_UNIT|L2|Sanity Check|pair|project_no: field_a >= field_b
CU-004|CROSS_UNIT|L2|Sanity Check|pair|project_no: field_a >= field_b
CU-005|CROSS_UNIT|L2|Sanity Check|pair|project_no: field_a >= field_b
CU-006|CROSS_UNIT|L2|Sanity Check|pair|project_no: field_a >= field_b
CU-007|CROSS_UNIT|L2|Sanity Check|pair|project_no, pay_period: field_a >= field_b
CU-008|CROSS_UNIT|L2|Sanity Check|pair|project_no: field_b >= field_a
CU-009|CROSS_UNIT|L2|Sanity Check|pair|project_no, process_name, day: field_a = field_b
CU-010|CROSS_UNIT|L2|Sanity Check|pair|project_no, process_name: (unix_timestamp(field_a) - unix_timestamp(field_b)) / 3600 >= 12
CU-011|CROSS_UNIT|L2|Sanity Check|missing_members|project_no, day
CU-012|CROSS_UNIT|L2|Fatal|pair|project_no, process_name, lot_no: field_a >= field_b
CU-013|CROSS_UNIT|L2|Sanity Check|pair|project_no, trial_no: field_a >= field_b
CU-014|CROSS_UNIT|L2|Sanity Check|pair|project_no, scheme_no: field_a >= field_b
CU-015|CROSS_UNIT|L2|Sanity Check|pair|project_no, lot_no: field_a >= field_b
CU-016|CROSS_UNIT|L2|Sanity Check|pair|project_no, lot_no, batch: field_a >= field_b
CU-017|CROSS_UNIT|L2|Sanity Check|pair|project_no: field_a <= field_b
CU-018|CROSS_UNIT|L2|Sanity Check|pair|project_no, meeting_no, item_no: field_b >= field_a
LG-001|SINGLE_DOC|L2|Sanity Check|row|abs(actual_length - (top_elev - bottom_elev)) <= 0.1
LG-006|SINGLE_DOC|L2|Sanity Check|row|sink_time is not null and trim(sink_time) <> ''
LG-007|SINGLE_DOC|L2|Sanity Check|row|pull_time is not null and trim(pull_time) <> ''
LG-1001|SINGLE_DOC|L2|Sanity Check|row|abs(actual_length - (top_elev - bottom_elev)) <= 0.1
LG-1002|SINGLE_DOC|L2|Sanity Check|row|abs(filling_coeff - try_divide(volume, 3.14159265 * power(diameter / 2, 2) * actual_length)) <= 0.15
LG-1003|SINGLE_DOC|L2|Fatal|row|read_rows = actual_rows
LG-1004|SINGLE_DOC|L2|Fatal|duplicates|pile_no
LG-1005|SINGLE_DOC|L2|Sanity Check|time_order|start_time, end_time
LG-101|CROSS_DOC|L2|Sanity Check|chain|submitted, arrived, inspected
LG-102|CROSS_DOC|L2|Fatal|chain|accepted, next_start
LG-103|CROSS_DOC|L2|Fatal|chain|item_day, section_day, unit_day
LG-104|CROSS_DOC|L2|Sanity Check|chain|notice_day, reply_day, review_day
LG-105|CROSS_DOC|L2|Fatal|chain|approved, executed
LG-106|CROSS_DOC|L2|Sanity Check|without|process_name, day
LG-107|CROSS_DOC|L2|Sanity Check|wide_intervals|point_no, day
LG-108|CROSS_DOC|L3|Best Practice|without|holiday
LG-201|CROSS_DOC|L2|Sanity Check|rollup|item, 0.05
LG-202|CROSS_DOC|L2|Sanity Check|rollup|section, 0.05
LG-203|CROSS_DOC|L2|Sanity Check|rollup|unit, 0.03
LG-204|CROSS_DOC|L2|Fatal|not_above|material
LG-205|CROSS_DOC|L2|Fatal|fewer|lot_no
LG-206|CROSS_DOC|L2|Sanity Check|unless|item_code
LG-301|CROSS_DOC|L2|Sanity Check|different_sets|person
LG-302|CROSS_DOC|L2|Sanity Check|missing_members|person
LG-303|CROSS_DOC|L2|Fatal|missing_members|person
LG-304|CROSS_DOC|L2|Sanity Check|against_first|signer
LG-305|CROSS_DOC|L2|Fatal|missing_members|signer, discipline
LG-306|CROSS_DOC|L2|Fatal|as_of|post
LG-401|CROSS_DOC|L2|Sanity Check|several_values|lot_no, state
LG-402|CROSS_DOC|L2|Fatal|without|defect_no
LG-403|CROSS_DOC|L2|Sanity Check|implies|grade, pass_rate
LG-404|CROSS_DOC|L2|Sanity Check|row|abs(plan_rate - report_rate) <= 0.1 and abs(report_rate - review_rate) <= 0.1
LG-501|CROSS_DOC|L2|Sanity Check|against_first|signer
LG-502|SINGLE_DOC|L2|Sanity Check|row|sign_day is not null and sign_day <> ''
LG-503|SINGLE_DOC|L2|Fatal|row|seal is not null and seal <> ''
LG-504|CROSS_DOC|L2|Fatal|without|signer
LG-601|CROSS_DOC|L2|Fatal|without|defect_no
LG-602|CROSS_DOC|L2|Sanity Check|without|change_no
LG-603|CROSS_DOC|L2|Fatal|without|stop_no
LG-604|CROSS_DOC|L2|Fatal|without|acceptance_no
LG-605|CROSS_DOC|L2|Fatal|unless|pile_no
LG-606|CROSS_DOC|L2|Fatal|several_values|pile_no, actual_length
LG-607|CROSS_DOC|L2|Sanity Check|total_source|doc
LG-701|CROSS_DOC|L2|Sanity Check|several_values|spec, version
LG-702|CROSS_DOC|L3|Best Practice|several_values|spec, format
LG-703|CROSS_DOC|L2|Sanity Check|missing_members|spec, discipline
LG-801|CROSS_DOC|L2|Fatal|different_sets|sample_no
LG-802|CROSS_DOC|L2|Fatal|missing_members|test_item
LG-803|CROSS_DOC|L2|Fatal|unless|report_no
LG-804|CROSS_DOC|L2|Sanity Check|implies|point_no
LG-901|CROSS_DOC|L2|Sanity Check|total_source|doc
LG-902|CROSS_DOC|L2|Sanity Check|total_source|doc
LG-903|CROSS_DOC|L2|Sanity Check|rollup|doc, 0.01
LG-904|SINGLE_DOC|L2|Fatal|row|abs(actual_length - (top_elev - bottom_elev)) <= 0.1
LG-905|SINGLE_DOC|L2|Fatal|total_source|doc
LG-906|SINGLE_DOC|L2|Fatal|row|abs(actual_length - (top_elev - bottom_elev)) <= 0.1 and abs(filling_coeff - try_divide(volume, 3.14159265 * power(diameter / 2, 2) * actual_length)) <= 0.15
BZ-001|SINGLE_DOC|L3|Best Practice|repeats|column
BZ-002|SINGLE_DOC|L3|Best Practice|jumps|column
BZ-003|SINGLE_DOC|L3|Best Practice|formula_mismatch|column
"""
DEPRECATED = ("LG-1001",)


def entries() -> list[tuple[str, str, str, str, str, str]]:
    return [tuple(line.split("|")) for line in RULES.split("\n") if line]


def row_rules(doc_types: tuple[str, ...]) -> list[Rule]:
    """The rules of kind row, for documents of these types."""
    import re

    functions = {"abs", "is", "not", "null", "and", "trim", "try_divide", "power"}
    out = []
    for i, scope, level, severity, kind, check in entries():
        if kind == "row":
            fields = tuple(dict.fromkeys(w for w in re.findall(r"[a-z_]+", check) if w not in functions))
            out.append(Rule(i, scope, level, severity, check, f"{i}: " + ", ".join(f"{f} {{{f}}}" for f in fields), fields, doc_types, "deprecated" if i in DEPRECATED else "active"))
    return out


def pair_rules() -> list[Rule]:
    """The rules of kind pair, over key columns and value columns named field_a and field_b."""
    out = []
    for i, scope, level, severity, kind, check in entries():
        if kind == "pair":
            keys, predicate = check.split(": ", 1)
            out.append(Rule(i, scope, level, severity, predicate, join_keys=tuple(keys.split(", ")), field_a="field_a", field_b="field_b"))
    return out
