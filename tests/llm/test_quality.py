import re
from collections import Counter

from veridale.llm import quality
from veridale.llm.queries import op9_quality_rules


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_statistics_match_brute_force(spark, small):
    odd = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x x x x x", "\x1c \x85 é ü", "l\nl\n \nl", "# * | <>", "a b c d a b c e a b c " * 40, "z" * 50000]
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-k - 1, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = quality.statistics(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[n] for n in quality.COUNTS) == brute(texts[r.doc_id]), r.doc_id


def test_repeated_windows_are_the_same_looked_up_and_sorted(spark, monkeypatch, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, "a b c d " * 3000), (-2, "x y " * 5 + "z " * 9), (-3, "long words here " * 100_000)], "doc_id long, text string"))
    both = []
    for lookups in (0, 1 << 60):
        monkeypatch.setattr(quality, "LOOKUPS", lookups)
        both.append({r.doc_id: r.n_repeat_words for r in quality.statistics(docs.where("doc_id > -3 or %d = 0" % lookups)).collect()})
    assert all(both[0][d] == n for d, n in both[1].items()) and both[0][-3] == 300_000 and both[0][-1] == 12_000


def rejected(rules, stats):
    """The number of the first rule that all conditions of hold, by comparing numbers row by row."""
    for k, rule in enumerate(rules.rules, 1):
        if all((stats[c.name] > c.threshold) == c.above for c in rule.conditions):
            return k
    return None


def test_kept_is_what_the_list_says(spark, small):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.learned(docs, labels)
    assert rules.rules
    rows = [r.asDict() for r in quality.judged(docs, rules).collect()]
    for r in rows:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert (r["base_failed"], r["rule"], r["kept"]) == (failed, rejected(rules, r), not failed and rejected(rules, r) is None)
    # what covering and pruning promise: each rule is right on its share of the pruning rows that reach it
    by_id = {r["doc_id"]: r for r in rows}
    prune = [(by_id[r.doc_id], r.bad) for r in quality.labelled(docs, labels).withColumn("part", quality.F.expr("pmod(xxhash64(doc_id, 'part'), 3)")).where("part = 0").collect()]
    for k, rule in enumerate(rules.rules, 1):
        hit = [bad for r, bad in prune if rejected(rules, r) == k]
        assert (sum(hit), len(hit) - sum(hit)) == (rule.rejected, rule.wrong) and sum(hit) >= quality.MIN_PRECISION * len(hit)


def test_list_keeps_clean_documents(spark):
    d = "/root/testdata/sf0.01"
    quality_of = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = op9_quality_rules(spark, d).collect()
    seen = [(quality_of[r.doc_id], r.kept) for r in rows if r.doc_id in quality_of and not r.base_failed]
    clean, junk = [k for q, k in seen if q], [k for q, k in seen if not q]
    assert sum(clean) >= 0.97 * len(clean) and sum(junk) <= 0.3 * len(junk)


def test_no_labels_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "w " * 60, "x", 3), (1, "w " * 60, "x", 3), (2, None, None, None)], "doc_id long, text string, source string, n_words long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rules = quality.learned(docs, labels)
    assert rules.rules == []
    out = quality.judged(docs, rules).collect()
    assert sorted((r.doc_id, r.n_words, r.kept) for r in out) == [(1, 60, False), (1, 60, False), (2, 0, False)]
    assert quality.judged(docs.limit(0), rules).count() == 0
