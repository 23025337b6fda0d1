"""Queries without SQL against plain versions, row by row, on the smallest tables."""

import math
import random
import re
import statistics
from collections import defaultdict

import pytest

from veridale import plans
from veridale.operators import cluster, layout, tables
from veridale.plans import text_queries


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def words(text):
    low = text.lower()
    runs = re.findall("[一-鿿]+", low)
    return set(re.findall("[a-z0-9_]{2,}", low)) | {c for run in runs for c in run} | {run[k : k + 2] for run in runs for k in range(len(run) - 1)}


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def close(sets, threshold):
    """(a, b) -> similarity of all pairs with a < b."""
    ids = sorted(sets)
    return {(a, b): s for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and (s := alike(sets[a], sets[b])) >= threshold}


def plain_dbscan(sets, threshold, least):
    near = defaultdict(set)
    for a, b in close(sets, threshold):
        near[a].add(b)
        near[b].add(a)
    cores = {k for k in sets if sets[k] and len(near[k]) + 1 >= least}
    out = {}
    for k in sorted(cores):
        todo = [k] if k not in out else []
        while todo:
            at = todo.pop()
            if at not in out:
                out[at] = k
                todo += [n for n in near[at] if n in cores]
    return {k: out[k] if k in out else min((out[n] for n in near[k] if n in cores), default=-1) for k in sets}


def plain_greedy(sets, threshold, least):
    """In the order of ids; equal sets follow the first of them."""
    members, of, first = {}, {}, {}
    for k in sorted(sets):
        if not sets[k]:
            continue
        twin = first.setdefault(frozenset(sets[k]), k)
        if twin != k:
            of[k] = of[twin]
            continue
        score = {}
        for cluster_id, own in members.items():
            hit = [s for m in own if (s := alike(sets[k], sets[m])) >= threshold]
            if hit:
                score[cluster_id] = hit[0]
        of[k] = min(score, key=lambda c: (-score[c], c)) if score else k
        members.setdefault(of[k], []).append(k)
    sizes = defaultdict(int)
    for c in of.values():
        sizes[c] += 1
    return {k: of[k] if k in of and sizes[of[k]] >= max(2, least) else -1 for k in sets}


def lc15(texts, **_):
    sets = {k: words(t) for k, t in texts.items()}
    first = {}
    for k in sorted(sets):
        first.setdefault(frozenset(sets[k]), k)
    reps = {k: sets[k] for k in first.values()}
    copies = {(first[frozenset(s)], k): 1.0 for k, s in sets.items() if s and first[frozenset(s)] != k}
    return {(a, b, round(s, 9)) for (a, b), s in (close(reps, 0.7) | copies).items()}


def lc19(texts, **_):
    return set(plain_dbscan({k: words(t) for k, t in texts.items()}, 0.7, 3).items())


def lc20(texts, **_):
    return set(plain_greedy({k: words(t) for k, t in texts.items()}, 0.7, 2).items())


def lc24(texts, **_):
    groups = defaultdict(list)
    for k, c in plain_dbscan({k: words(t) for k, t in texts.items()}, 0.7, 2).items():
        groups[c].append(k)
    return {(c, len(v), k) for c, v in groups.items() if c >= 0 and len(v) >= 2 for k in v}


def pr19(texts, **_):
    out = set()
    for d, text in texts.items():
        rows, header, no = [], None, 0
        for line in (x.strip(" ") for x in text.split("\n")):
            if not line:
                continue
            no += 1
            wide = [x for x in re.split(r"[ \t]{2,}", line) if x]
            tokens = wide if len(wide) >= 3 else [x for x in re.split(r"[ \t]+", line) if x]
            said = [bool(re.search("[一-龥]", x) or re.search("^[a-zA-Z]+$", x)) and not re.match(r"[0-9]{4}[-/年][0-9]{1,2}", x) for x in tokens]
            if header is None and len(tokens) >= 3 and sum(said) >= max(2, len(tokens) / 2):
                header = [x if tokens[:k].count(x) == 0 else f"{x}_{tokens[:k].count(x) + 1}" for k, x in enumerate(tokens)]
            elif header and len(tokens) >= 2:
                rows.append((d, 1, no, tuple(sorted(zip(header, tokens)))))
        if len(rows) >= 2:
            out.update(rows)
    return out


def boxes(spark, small):
    pages = defaultdict(list)
    for r in text_queries._items(lambda t: spark.read.parquet(f"{small}/{t}.parquet")).collect():
        pages[r.doc_id].append(r)
    return pages


def ly4(spark, small, **_):
    out = set()
    for page in boxes(spark, small).values():
        kept = []
        for r in sorted(page, key=lambda r: (-r.confidence, r.y1, r.x1, r["item"])):
            def clash(k):
                inter = max(0, min(r.x2, k.x2) - max(r.x1, k.x1)) * max(0, min(r.y2, k.y2) - max(r.y1, k.y1))
                a, b = ((x.x2 - x.x1) * (x.y2 - x.y1) for x in (r, k))
                return inter > 0.5 * (a + b - inter) or inter > 0.8 * min(a, b)

            if not any(map(clash, kept)):
                kept.append(r)
        out |= {(r.doc_id, r["item"]) for r in kept}
    return out


def ly5(spark, small, **_):
    out = set()
    for page in boxes(spark, small).values():
        heights = sorted(r.y2 - r.y1 for r in page)
        n = len(heights)
        near, rows = max(8.0, 0.5 * (heights[(n - 1) // 2] + heights[n // 2]) / 2), []
        for r in sorted(page, key=lambda r: ((r.y1 + r.y2) / 2, r.x1, r["item"])):
            c = (r.y1 + r.y2) / 2
            if not rows or abs(c - sum(rows[-1]) / len(rows[-1])) > near:
                rows.append([])
            rows[-1].append(c)
            out.add((r.doc_id, r["item"], len(rows) - 1))
    return out


def parts(text):
    m = re.fullmatch("Z?([0-9]+)([A-D]?)", text)
    return m and (int(m[1]), m[2])


def fill(page):
    """item -> inferred id, for (item, text) in order."""
    whole = lambda t: re.fullmatch("Z[4-9][0-9]{1,2}[A-D]?", t)
    found = [parts(t) for _, t in page if whole(t)]
    if len(found) < 2:
        return {}
    steps = [b[0] - a[0] for a, b in zip(found, found[1:]) if a[1] == b[1] and len(str(a[0])) == len(str(b[0])) and abs(b[0] - a[0]) == 1]
    long_ = [f for f in found if f[0] >= 100]
    ends = long_ if len(long_) >= 2 else found
    up = sum(s > 0 for s in steps) * 2 >= len(steps) if steps else ends[-1][0] > ends[0][0]
    d, now, out = 1 if up else -1, [t for _, t in page], {}

    def apart(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    fits = lambda raw, n: raw in str(n) or str(n) in raw or apart(raw, str(n))
    for k, (item, text) in enumerate(page):
        before = next((parts(t) for t in reversed(now[:k]) if whole(t)), None)
        after = next((parts(t) for t in now[k + 1 :] if whole(t)), None)
        between = (before[0] + 1, before[1]) if before and after and after[0] - before[0] == 2 and before[1] == after[1] else None
        if text and not re.fullmatch("[Z2\\d.,;:\\-A-Da-d]+", text):
            continue
        own = parts(text)
        digits = str(own[0]) if own else re.sub("[^0-9]", "", text)
        if whole(text):
            guess = between[0] if between else after[0] - d if after else None
            if not (len(digits) < 3 and (any(digits in str(f[0]) and f[0] >= 100 for f in found) or (guess is not None and fits(digits, guess)))):
                continue
        choices = [between] if between else [(after[0] - d, after[1])] if after and fits(digits, after[0] - d) else [(before[0] + d, before[1])] if before and fits(digits, before[0] + d) else []
        for n, suffix in choices:
            out[item] = now[k] = f"Z{n}{suffix}"
    return out


def ly13(got, **_):
    pages = defaultdict(list)
    for r in got:
        pages[r.doc_id].append((r["item"], r.text))
    out = set()
    for d, rows in pages.items():
        made = fill(sorted(rows))
        out |= {(d, item, made.get(item)) for item, _ in rows}
    return out


#: name -> plain version, columns to compare.
def rv21_hash(small, spark, **_):
    """Pictures of 8 x 8 at 32 x 32 by weights of neighbours, and every frequency by its own sum."""
    import math
    import statistics

    def wide(values):
        out = []
        for k in range(32):
            at = (k + 0.5) / 4 - 0.5
            w = [max(0.0, 1 - abs(i - at)) for i in range(8)]
            out.append(sum(x * y for x, y in zip(w, values)) / sum(w))
        return out

    cos = [[math.cos(math.pi * (2 * i + 1) * u / 64) for i in range(32)] for u in range(8)]
    hashes, first = {}, {}
    for r in sorted(spark.read.parquet(f"{small}/embeddings.parquet").collect()):
        grey = [min(255, max(0, math.floor((x + 1) * 127.5))) for x in r.embedding]
        rows = list(zip(*[wide(c) for c in zip(*[wide(grey[k * 8 : k * 8 + 8]) for k in range(8)])]))
        rows = [[round(x) for x in row] for row in rows]
        half = [[sum(c * x for c, x in zip(cos[v], row)) for row in rows] for v in range(8)]
        low = [round(4 * sum(c * x for c, x in zip(cos[u], half[v])), 6) for u in range(8) for v in range(8)]
        hashes[r.vec_id] = (r.label, int("".join("01"[x > statistics.median(low)] for x in low), 2))
        first.setdefault(r.label, r.vec_id)
    return {(i, label, f"{h:016x}", (h ^ hashes[first[label]][1]).bit_count()) for i, (label, h) in hashes.items() if i != first[label]}


PLAIN = {
    "rv21_hash": (rv21_hash, lambda r: (r.id, r.signer, r.hash, r.hash_distance)),
    "lc15_jaccard": (lc15, lambda r: (r.a, r.b, round(r.similarity, 9))), "lc19_dbscan": (lc19, lambda r: (r.id, r.cluster)), "lc20_greedy": (lc20, lambda r: (r.id, r.cluster)),
    "lc24_analysis": (lc24, lambda r: (r.cluster, r.n, r.id)), "pr19_generic_rows": (pr19, lambda r: (r.doc_id, r.page, r.line_no, tuple(sorted(r.cells.items())))),
    "ly4_without_overlaps": (ly4, lambda r: (r.doc_id, r["item"])), "ly5_text_rows": (ly5, lambda r: (r.doc_id, r["item"], r.text_row)), "ly13_filled": (ly13, lambda r: (r.doc_id, r["item"], r.inferred)),
}


def test_every_query_has_sql_or_a_plain_version():
    assert set(plans.QUERIES) - set(plans.SQL) == set(PLAIN)


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_plain(spark, small, texts, name):
    plain, row = PLAIN[name]
    got = plans.QUERIES[name](spark, small).collect()
    want = plain(texts=texts, spark=spark, small=small, got=got)
    rows = [row(r) for r in got]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_ids_are_filled_in_by_the_page_s_direction(spark):
    pages = {"up": ["Z430", "", "Z432", "", "Z435", "Z43", "x"], "down": ["Z440", "Z439", "", "", "Z436", "2435", "??"], "one": ["Z430", "", ""], "short": ["Z41", "Z412", "Z413", "Z4I4", "Z415"]}
    rows = [(d, 1, k, t) for d, v in pages.items() for k, t in enumerate(v)]
    got = {(r.doc_id, r["item"]): r.inferred for r in layout.filled_ids(spark.createDataFrame(rows, "doc_id string, page int, item int, text string")).collect()}
    assert got == {(d, k): fill(list(enumerate(v))).get(k) for d, v in pages.items() for k in range(len(v))}
    assert (got["up", 1], got["up", 3], got["up", 6]) == ("Z431", "Z434", None) and got["down", 2] == "Z437"


def test_clusters_of_chains_and_copies(spark):
    base = "abcdefghij"
    sets = {k: {base[(k // 2 + j) % 10] for j in range(4)} for k in range(24)} | {30: set(), 31: set("xyz"), 32: set("xyz"), 33: set("xyw")}
    frame = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id long, tokens array<string>")
    for threshold in (0.5, 0.6, 0.9):
        for least in (2, 3):
            assert {r.id: r.cluster for r in cluster.greedy(frame, threshold, least).collect()} == plain_greedy(sets, threshold, least)
            assert {r.id: r.cluster for r in cluster.dbscan(frame, threshold, least).collect()} == plain_dbscan(sets, threshold, least)


def test_greedy_by_batches_and_by_rounds(spark, monkeypatch):
    """A chain of 2,000 sets, in one batch; the same in rounds, shorter."""
    def chain(n):
        return {k: {f"c{j}" for j in range(k, k + 4)} for k in range(n)} | {n + k: {f"d{j}" for j in range(k % 7, k % 7 + 5)} for k in range(40)}

    frame = lambda sets: spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id long, tokens array<string>")
    tracker, jobs = spark.sparkContext.statusTracker(), []
    real = cluster._between
    monkeypatch.setattr(cluster, "_between", lambda *a: (real(*a), spark.sparkContext.setJobGroup("greedy", "greedy"))[0])
    long = chain(2000)
    assert {r.id: r.cluster for r in cluster.greedy(frame(long), 0.6, 2).collect()} == plain_greedy(long, 0.6, 2)
    jobs = tracker.getJobIdsForGroup("greedy")
    spark.sparkContext.setJobGroup("other", "other")
    assert len(jobs) < 20
    monkeypatch.setattr(cluster, "BATCH", 12)
    short = chain(20)
    assert {r.id: r.cluster for r in cluster.greedy(frame(short), 0.6, 2).collect()} == plain_greedy(short, 0.6, 2)


def test_greedy_of_large_components_takes_few_rounds(spark, monkeypatch):
    """120 near copies are all linked, so the longest chain has 120 sets; and components of several clusters, dense and sparse, in blocks."""
    tracker = spark.sparkContext.statusTracker()
    frame = lambda sets: spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id long, tokens array<string>")
    real = cluster._between
    monkeypatch.setattr(cluster, "_between", lambda *a: (real(*a), spark.sparkContext.setJobGroup("dense", "dense"))[0])
    monkeypatch.setattr(cluster, "BATCH", 128)
    common = {f"c{j}" for j in range(30)}
    near = {k: common | {f"u{k}"} for k in range(5, 125)} | {0: {f"c{j}" for j in range(27)} | {"x", "y"}, 1: {f"c{j}" for j in range(3, 30)} | {"v", "w"}}
    assert {r.id: r.cluster for r in cluster.greedy(frame(near), 0.75, 2).collect()} == plain_greedy(near, 0.75, 2)
    jobs = len(tracker.getJobIdsForGroup("dense"))
    spark.sparkContext.setJobGroup("other", "other")
    assert jobs < 130
    rng = random.Random(3)
    for batch in (3, 20):
        monkeypatch.setattr(cluster, "BATCH", batch)
        for size, many in ((6, 9), (5, 30)):
            sets = {k * 3: {f"t{rng.randrange(many)}" for _ in range(size)} for k in range(90)}
            want = plain_greedy(sets, 0.5, 2)
            assert len(set(want.values())) > 3
            assert {r.id: r.cluster for r in cluster.greedy(frame(sets), 0.5, 2).collect()} == want, (batch, size)


def test_pairs_of_sets_at_the_threshold(spark):
    sets = {k: {f"t{j}" for j in range(10)} - {f"t{j}" for j in range(k % 5)} | {f"u{k}_{j}" for j in range(k // 5)} for k in range(20)}
    frame = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id long, tokens array<string>")
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    assert len({len(v) for v in sets.values()}) > 3 and any(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) == 0.7 for a, b in want)
    assert {(r.a, r.b) for r in cluster.similar_pairs(frame, 0.7).collect()} == want


def test_pairs_with_long_lists_split(spark, monkeypatch):
    """Lists of common tokens in many parts, at several thresholds, against all pairs."""
    rng = random.Random(6)
    sets = {}
    for k in range(90):
        base = sets[rng.randrange(k)] if k and rng.random() < 0.6 else {f"t{rng.randrange(14)}" for _ in range(rng.randint(1, 14))}
        sets[k] = (base - {f"t{rng.randrange(14)}"}) | ({f"v{rng.randrange(3)}"} if rng.random() < 0.5 else set()) or {"t0"}
    first = {}
    for k, v in sets.items():
        first.setdefault(frozenset(v), k)
    frame = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id long, tokens array<string>")
    monkeypatch.setattr(cluster, "LIST", 4)
    for threshold in (0.3, 0.6, 0.8, 1.0):
        got = [(r.a, r.b) for r in cluster.similar_pairs(frame, threshold).collect()]
        ids = sorted(first.values())
        want = {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}
        want |= {(first[frozenset(v)], k) for k, v in sets.items() if first[frozenset(v)] != k}
        assert len(got) == len(set(got)) and set(got) == want, threshold


def shuffled(spark):
    """Bytes that all stages so far have shuffled."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_pairs_shuffle_less_than_their_sets(spark):
    """600 sets of 200 tokens, the last 100 near copies: what is shuffled is less than three times the tokens' characters."""
    rng = random.Random(8)
    sets = {k: {f"{rng.randrange(10**8):08d}" for _ in range(200)} for k in range(500)}
    sets |= {500 + k: {*sorted(sets[k])[:-9]} for k in range(100)}
    frame = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id long, tokens array<string>")
    before = shuffled(spark)
    assert {(r.a, r.b) for r in cluster.similar_pairs(frame, 0.7).collect()} == {(k, 500 + k) for k in range(100)}
    assert shuffled(spark) - before < 3 * 600 * 200 * 8


def test_rows_and_plain_lines_in_one_pass(spark):
    """A document has its table or its plain lines, told in one pass: no join; page marks, tabs at an end and repeated names included."""
    texts = {1: "no  size  no\n1  2  3\n4  5  6", 2: "no  size  no\n1  2  3", 3: "12 34\n\tab  cd  ef\n=== 第 7 页 ===\n= 8 =\nx y z\n1 2", 4: "=== 第 99999999999 页 ===\nq"}
    docs = spark.createDataFrame([(k, v, "other") for k, v in texts.items()], "doc_id long, text string, doc_type string")
    found = tables.rows_by_type(docs, {"no": "no"}, "no", "pile")
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.doc_id, r.page, r.line_no): r.cells for r in found.collect()}
    assert {k[1:]: v for k, v in got.items() if k[0] == 1} == {(1, 2): {"no": "1", "size": "2", "no_2": "3"}, (1, 3): {"no": "4", "size": "5", "no_2": "6"}}
    plain = lambda *lines: {k: {"raw_text": v} for k, v in lines}
    assert {k: v for k, v in got.items() if k[0] > 1} == plain(((2, 1, 1), "no  size  no"), ((2, 1, 2), "1  2  3"), ((3, 1, 1), "12 34"), ((3, 1, 2), "\tab  cd  ef"), ((3, 7, 3), "= 8 ="), ((3, 7, 4), "x y z"), ((3, 7, 5), "1 2"), ((4, 1, 1), "=== 第 99999999999 页 ==="), ((4, 1, 2), "q"))


def test_pages_of_any_size_as_a_stream(spark, monkeypatch):
    """Small and large pages, cut by batches of 7 rows, with nulls: as page by page; and no call for each page."""
    rng = random.Random(4)
    rows = []
    for d in [None, *range(60)]:
        for k in range(rng.choice((1, 2, 3, 5, 9, 20))):
            x, y = rng.randrange(40) * 1.0, rng.randrange(60) * 1.0
            rows.append((d, 1, (1 << 60) + k, "t", None if rng.random() < 0.05 else rng.randrange(6) / 8, x, y, x + rng.randint(5, 30), None if rng.random() < 0.05 else y + rng.randint(5, 30)))
    items = spark.createDataFrame(rows, "doc_id long, page int, item long, text string, confidence double, x1 double, y1 double, x2 double, y2 double")
    pages = defaultdict(list)
    for r in items.collect():
        pages[r.doc_id].append(r)
    kept, in_row = set(), set()
    for d, page in pages.items():
        best = []
        for r in sorted(page, key=lambda r: (r.confidence is None, -(r.confidence or 0), r.y1, r.x1, r["item"])):
            def clash(k):
                if None in (r.y2, k.y2):
                    return False
                inter = max(0, min(r.x2, k.x2) - max(r.x1, k.x1)) * max(0, min(r.y2, k.y2) - max(r.y1, k.y1))
                a, b = ((x.x2 - x.x1) * (x.y2 - x.y1) for x in (r, k))
                return inter > 0.5 * (a + b - inter) or inter > 0.8 * min(a, b)

            if not any(map(clash, best)):
                best.append(r)
        kept |= {(d, r["item"]) for r in best}
        heights = [r.y2 - r.y1 for r in page if r.y2 is not None]
        near, row, n, mean = max(8.0, 0.5 * statistics.median(heights)) if heights else math.nan, -1, 0, 0.0
        for r in sorted(page, key=lambda r: (r.y2 is None, (r.y1 + (r.y2 or 0)) / 2 if r.y2 is not None else 0, r.x1, r["item"])):
            c = math.nan if r.y2 is None else (r.y1 + r.y2) / 2
            if row < 0 or abs(c - mean) > near:
                row, mean, n = row + 1, c, 1
            else:
                mean, n = (mean * n + c) / (n + 1), n + 1
            in_row.add((d, r["item"], row))
    monkeypatch.setattr(layout, "SMALL", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = layout.without_overlaps(items)
        assert sorted((r.doc_id or -1, r["item"]) for r in found.collect()) == sorted((d or -1, k) for d, k in kept)
        assert {(r.doc_id, r["item"], r.text_row) for r in layout.text_rows(items).collect()} == in_row
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for frame in (found, layout.text_rows(items)):
        assert "FlatMapGroupsIn" not in frame._jdf.queryExecution().toString()
