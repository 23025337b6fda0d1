from veridale.llm import contamination
from veridale.llm.queries import op6_contamination


TRIM = set("\"'`.,;:!?()[]{}<>«»„“”‘’…*_|#&$%")
UNITS = set("mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr hours hour minutes minute seconds second days day weeks week months month years year usd eur gbp dollars dollar euros euro cents cent percent % ° °c °f k hz khz mhz ghz w kw v a kb mb gb tb mph kmh km/h m/s".split())


def is_number(w):
    """[+-] [currency] digit, then digits and marks, then an ordinal ending or %; read from the left."""
    k = 1 if w[:1] in ("+", "-") else 0
    k += w[k : k + 1] in ("$", "€", "£") and w[k : k + 1] != ""
    if not w[k : k + 1].isdecimal():
        return False
    while k < len(w) and (w[k].isdecimal() or w[k] in ".,:/"):
        k += 1
    return w[k:] in ("", "st", "nd", "rd", "th", "%")


def plain_template(text):
    """[(kind, value)]: value is empty for a plain word."""
    out, first = [], True
    for raw in text.split():
        lo, hi = 0, len(raw)
        while lo < hi and raw[lo] in TRIM:
            lo += 1
        while hi > lo and raw[hi - 1] in TRIM:
            hi -= 1
        word, stop = raw[lo:hi], raw[-1] in ".!?:|"
        if not word:
            first |= stop
            continue
        if is_number(word):
            out.append(("#", word.lower()))
        elif word.lower() in UNITS and out and out[-1][0] == "#":
            out.append(("unit", word.lower()))
        elif word[0].isupper() and not word.isupper() and not first:
            out.append(("Name", word.lower()))
        else:
            out.append((f"word {word.lower()}", ""))
        first = stop
    return out


def brute(docs, items):
    """(doc_id, item_id): windows by dicts of tuples, every alignment by its definition."""
    out = set()
    for i, item in items.items():
        want = plain_template(item or "")
        n = min(5, len(want))
        if not n:
            continue
        own = {}
        for k in range(len(want) - n + 1):
            own.setdefault(tuple(x for x, _ in want[k : k + n]), []).append(k)
        for d, text in docs.items():
            said = plain_template(text or "")
            held = {}
            for k in range(len(said) - n + 1):
                held.setdefault(tuple(x for x, _ in said[k : k + n]), []).append(k)
            both = own.keys() & held.keys()
            if len(both) < 0.8 * len(own):
                continue
            if n < 5 and all(v for _, v in want):
                ok = any(said[k : k + n] == want for k in held[next(iter(both))])
            else:
                ok = not any(v for w in both for k in own[w] for _, v in want[k : k + n])
                for shift in {p - k for w in both for k in own[w] for p in held[w]}:
                    seen = {}
                    for w in both:
                        for k in own[w]:
                            p = min(held[w], key=lambda p: (abs(p - k - shift), p))
                            for (_, a), (_, b) in zip(want[k : k + n], said[p : p + n]):
                                if a:
                                    seen.setdefault(a, set()).add(b)
                    ok |= sum(len(v) == 1 for v in seen.values()) >= 0.8 * sum(map(len, seen.values()))
            if ok:
                out.add((d, i))
    return out


def test_op6_matches_brute_force_and_catches_copies(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in op6_contamination(spark, small).collect()}
    planted = {(d, i) for d, t in docs.items() for i, b in items.items() if t and b in t}
    assert planted <= got == brute(docs, items) and len(planted) > 2
    assert {d for d, _ in got} - {d for d, _ in planted} == set()


ITEM = "A train leaves the old station at 9 and travels 120 km with Maria before it stops for 30 min near the river where Maria walks home"


def test_slots(spark):
    other = ITEM.replace("120 km", "75 mi").replace("Maria", "Ahmed").replace("30 min", "4 h")
    mixed = ITEM.replace("with Maria", "with Ahmed").replace("120", "30").replace("at 9", "at 7").replace("30 min", "7 min").replace("Maria walks", "Bob walks")
    docs = [(1, f"Some words before. {ITEM}, and some after."), (2, other), (3, mixed), (4, "A train leaves the old station at 9 and nothing else happens to it that day"), (5, None), (6, ""), (1, ITEM), (7, "x " * 50000)]
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, window int")
    bench = spark.createDataFrame([(10, ITEM, 1), (11, None, 1), (12, "", 1), (13, "two words", 1)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in contamination.matches(frame, bench).collect()}
    assert got == {(1, 10), (2, 10)}
    assert sorted(r.doc_id for r in contamination.clean(frame, bench).collect()) == [3, 4, 5, 6, 7]
    assert contamination.clean(frame, bench).columns == frame.columns
    assert contamination.matches(frame.limit(0), bench).count() == 0 and contamination.matches(frame, bench.limit(0)).count() == 0


def test_copies_after_passages_that_share_windows(spark):
    early = "A train leaves the old station at 7 and travels 80 km to the sea. "
    docs = [(1, early + ITEM), (2, early + ITEM.replace("30 min", "4 h").replace("with Maria before", "with Maria well before")), (3, early * 3 + "It stops."), (4, f"{ITEM} {early}")]
    short = [(5, "As they say, two words are enough here."), (6, "We met in 1999 at the sea, far away"), (7, "two other words and so on and on"), (8, "the 42 of them went home again"), (9, "the 43 of them went home again")]
    frame = spark.createDataFrame(docs + short, "doc_id long, text string")
    bench = spark.createDataFrame([(10, ITEM), (11, "Two words"), (12, "Met in 1999"), (13, "42")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in contamination.matches(frame, bench).collect()}
    assert set(got) == {(1, 10), (2, 10), (4, 10), (5, 11), (6, 12), (8, 13)}
    assert got[1, 10].consistent == got[4, 10].consistent == 1.0 and got[1, 10].n_matched == got[1, 10].n_windows


def test_matches_brute_force_on_questions_that_share_windows(spark):
    """Questions from few templates, told with other numbers, names and units, cut, mixed and repeated."""
    import random

    rng = random.Random(9)
    frames = ["A train leaves {n} at {v} {u} and meets {m} near the river before it stops for {w} {u}", "If {n} has {v} apples and {m} takes {w} of them how many does {n} keep", "The tank holds {v} {u} of water and loses {w} {u} each day until {n} mends it", "{v} {u}", "met {n} in {v}"]
    fill = lambda f: f.format(n=rng.choice(["Maria", "Ahmed", "Olga"]), m=rng.choice(["Bob", "Li"]), v=rng.randrange(2, 9), w=rng.randrange(10, 14), u=rng.choice(["km", "kg", "h"]))
    items = {k: fill(frames[k % 5]) for k in range(25)}
    docs = {}
    for d in range(120):
        parts = [fill(rng.choice(frames)) for _ in range(rng.randrange(1, 4))]
        words = " and then so it goes. ".join(parts).split()
        if rng.random() < 0.4:
            words[rng.randrange(len(words))] = "odd"
        docs[d] = "He said that " + " ".join(words)
    got = {(r.doc_id, r.item_id) for r in contamination.matches(spark.createDataFrame([*docs.items()], "doc_id long, text string"), spark.createDataFrame([*items.items()], "item_id long, text string")).collect()}
    want = brute(docs, items)
    assert got == want and 50 < len(want) < len(docs) * len(items) / 2


def test_a_window_of_many_items_joins_none_that_have_a_rarer_one(spark):
    """500 items with one opening: documents that hold the opening are candidates of none, and those that hold an item of that item."""
    opening = "the 7 kg of the river water that"
    letters = lambda k: " ".join(f"{c}{k}x" for c in ("qa", "rb", "sc", "td", "ue", "vf", "wg", "xh", "yi", "zj"))
    items = [(k, f"{opening} {letters(k)}") for k in range(500)]
    docs = [(d, f"It is {opening} nobody wants {d}") for d in range(200)] + [(1000 + k, f"Well, {items[k][1]} again") for k in (3, 77)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    windows = contamination.ranked(contamination.item_windows(bench))
    pairs = contamination.candidates(contamination.document_windows(frame, windows), windows, 0.8).collect()
    assert {(r.doc_id, r.item_id) for r in pairs} == {(1003, 3), (1077, 77)}
    assert {(r.doc_id, r.item_id) for r in contamination.matches(frame, bench).collect()} == {(1003, 3), (1077, 77)}
