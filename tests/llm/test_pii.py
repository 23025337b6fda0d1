import hashlib
import re

from pyspark.sql import functions as F

from veridale.llm import pii
from veridale.llm.queries import op5_pii


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text) if ok(m[0])]


def line(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_op5_base_matches_brute_force(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op5_pii(spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(line(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in want) for kind in pii.KINDS]
        assert set(line(want).split(",")) <= set(r.spans.split(",")) | {""}


ODD = [
    None, "", "a@b.c_d@e.f", "x@y", "a.b@c-d.e..f", "@a.b", "é\U0001f600 a@b.cc", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1.", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111 2", "4111  1111", "4111111111111111x4111111111111112",
    "+1 (771) 555-1655 +49-30-12", "+1", "++12345678901", "+123 45", "1 " * 20000, "a" * 100000 + "@", "9" * 50000, "a." * 20000 + "b@c" + ".d" * 20000, "000.0000000000000000000001.2.3", "12345678901234567890123 4111111111111111", "+1 2" * 3000]


def test_odd_texts(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(ODD)] * 2, "doc_id long, text string, base string")
    rows = pii.extracted(docs).collect()
    assert len(rows) == 2 * len(ODD)
    for r in rows:
        assert [(s.kind, s.start, s.end) for s in r.base] == brute(ODD[r.doc_id]), r.doc_id
    assert pii.extracted(docs.limit(0)).count() == 0


def spans_of(spark, rows, make_up=True):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: [(s.kind, s.start, s.end) for s in r.added] for r in pii.extracted(docs, make_up=make_up).collect()}


def test_patterns_find_what_the_checks_miss(spark):
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "378282246310005", "6011111111111117"]
    rows = [(k, f"Paid by visa card {c} today, order 2024.") for k, c in enumerate(cards)]
    rows += [(10, "It was visa card 4111111111111112, he said."), (11, "the weight 4111111111111112 is not one"), (12, "visa card holders"), (13, "serial 9876543210123 here")]
    out = spans_of(spark, rows)
    assert out[10] == [("card", 17, 33)]
    assert out[11] == [("card", 11, 27)]  # known by its text, wherever it stands
    assert all(out[k] == [] for k in (0, 1, 2, 3, 4, 12, 13))


def test_unseen_identifiers_of_other_forms(spark):
    """Forms that no base pattern takes, under contexts that seeds have; other contexts stay alone."""
    said = {
        "email": ("please write to {} if needed", [f"u{k}@mail{k}.org" for k in range(16)], ["root@localhost", "me@intranet:8080"]),
        "phone": ("you can call {} after nine", [f"+1 (555) {100 + k}-77{10 + k}" for k in range(32)], ["555-0199-222", "(212) 555 01 42", "0049 30 901820", "0049 30 90 18 20", "0 0 4 9 3 0 9 0 1 8 2 1"]),
        "ip": ("logged in from {} over ssh", [f"10.2.{k}.7" for k in range(16)], ["10.2.300.7", "10.2.400.12"]),
        "card": ("charged to card {} in full", [next(c for c in (f"41000000{k:04d}000{d}" for d in range(10)) if luhn(c)) for k in range(16)], ["4111 1111 1111 1112", "5500-0055-5555-5550", "41111 11111 11111 1112 11"]),
    }
    rows, want = [], {}
    for kind, (text, seeds, unseen) in said.items():
        for x in seeds + unseen:
            d = len(rows)
            rows.append((d, f"On day {d} " + text.format(x) + "."))
            if x in unseen:
                at = rows[-1][1].index(x)
                want[d] = (kind, at, at + len(x))
    decoys = ["room 5550199333 is free", "the sum of 0049 31 901821 units", "version 10.9.300.7 is out", "see us@nowhere there", "part no 5500-1155-5555-5551 fits"]
    rows += [(1000 + k, t) for k, t in enumerate(decoys)]
    for make_up in (True, False):  # with make-up, and by contexts alone
        out = spans_of(spark, rows, make_up)
        hit = sum(span in out[d] for d, span in want.items())
        assert hit >= 0.9 * len(want), {d: (rows[d][1], out[d]) for d, span in want.items() if span not in out[d]}
        assert all(not added for d, added in out.items() if d not in want)


def test_rounds_go_on_until_nothing_new_is_known(spark):
    """Each context is learned from what the one before it found: there is a chain of them."""
    def number(k, i):
        return f"55{k}{i:02d}-{k}{i:02d}77-{'ab'[i % 2]}{k}x{i}"

    rows = [(k, f"first desk +1 555 000 {1000 + k} end") for k in range(60)] + [(60 + i, f"first desk {number(0, i)} last") for i in range(12)]
    new = {}
    for k in range(1, 4):
        for c in range(4):  # a context with 12 numbers of the level before, and 3 of the next
            texts = [number(k - 1, i) for i in range(12)] + [number(k, 3 * c + j) for j in range(3)]
            for j, x in enumerate(texts):
                if j >= 12:
                    new[len(rows)] = x
                rows.append((len(rows), f"word step{'abcd'[k]}{'abcd'[c]} {x} tail"))
    out = spans_of(spark, rows)
    assert len(new) == 36 and all(out[d] for d in new), [rows[d] for d in new if not out[d]]


def test_held_out_identifiers_are_found_again(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    hide = lambda t: F.pmod(F.xxhash64(t), F.lit(10)) == 0
    name = lambda r, spans: {(r.doc_id, s.kind, s.start, s.end) for s in spans}
    full = {x for r in pii.extracted(docs).collect() for x in name(r, r.base)}
    part = pii.extracted(docs, hide).collect()
    hidden = full - {x for r in part for x in name(r, r.base)}
    found = {x for r in part for x in name(r, r.added)}
    assert len(hidden) >= 5 and len(hidden & found) >= 0.9 * len(hidden)


def test_many_spans_in_one_text(spark):
    """8,000 addresses and 8,000 numbers in one text are settled in one pass, and runs are free exactly where no base span is."""
    import time

    text = " ".join(f"u{k}@host{k % 7}.org +1 555 {100000 + k} w{k % 3}" for k in range(8000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pii.found(docs.select(F.lit(0).alias("doc_id"), F.lit("a@b.c +1 555 000 1111 x").alias("text"))).collect()
    began = time.time()
    row = pii.found(docs).select(F.size("base").alias("n"), F.size("others").alias("m")).first()
    assert row.n == 16000 and time.time() - began < 60, time.time() - began
    small = " ".join(["a1@b.c", "12345678", "+1 (555) 123-4567", "x", "10.0.0.1", "999.1.1.1 22 333", "4111 1111 1111 1111 2", "7 7 7 7 7 7 7"] * 5)
    row = pii.found(spark.createDataFrame([(1, small)], "doc_id long, text string")).first()
    over = lambda a, b: a.start < b.end and b.start < a.end
    words = pii.found(spark.createDataFrame([(1, small)], "doc_id long, text string"), lambda t: F.lit(True)).first()
    assert {(w.start, w.end) for w in row.others} == {(w.start, w.end) for w in words.others if not any(over(w, b) for b in row.base)}
    assert any(w.text.count(" ") > 4 for w in row.others)
