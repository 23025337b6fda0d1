import math
import random
import zlib
from collections import Counter, defaultdict

from veridale.llm import langid
from veridale.llm.queries import op13_language_id

SCHEMA = "doc_id long, text string, lang string, ce string"


def symbols(text):
    out = [" "] * 3
    for ch in text:
        s = ch.lower()[0] if ch.isalpha() else " "
        s = s if ord(s) < 0xFFFF else "￿"
        if s != " " or out[-1] != " ":
            out.append(s)
    return "".join(out)


class Plain:
    """An interpolated model straight from the formula, with dicts of strings."""

    def __init__(self, texts, n_symbols):
        self.n, top = n_symbols, Counter()
        for t in texts:
            s = symbols(t)
            top.update(s[i - 3 : i + 1] for i in range(3, len(s)))
        self.c = {4: top}
        for k in (3, 2, 1):
            self.c[k] = Counter(g[1:] for g in self.c[k + 1])
        self.d, self.of, self.kinds = {}, defaultdict(int), defaultdict(int)
        for k, counts in self.c.items():
            n1, n2 = (sum(v == m for v in counts.values()) for m in (1, 2))
            self.d[k] = max(0.05, min(0.95, n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.95))
            for g, v in counts.items():
                self.of[k, g[:-1]] += v
                self.kinds[k, g[:-1]] += 1

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / self.n
        lower, of = self.p(gram[1:]), self.of.get((k, gram[:-1]), 0)
        return lower if not of else max(self.c[k].get(gram, 0) - self.d[k], 0) / of + self.d[k] * self.kinds[k, gram[:-1]] / of * lower

    def ce(self, text):
        s = symbols(text)
        return -sum(math.log(self.p(s[i - 3 : i + 1])) for i in range(3, len(s))) / (len(s) - 3)


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def corpus():
    rng, out = random.Random(3), []
    for k in range(240):
        lang = ("aa", "bb", "cc")[k % 3]
        pool = {"aa": ["the", "THere", "then", "nth"], "bb": ["der", "dre", "é\U00010330r", "und"], "cc": ["la", "al", "lla", "ñal"]}[lang]
        out.append((k, ", ".join(rng.choice(pool) for _ in range(rng.randrange(1, 30))) + rng.choice(["", "...", " 12"]), lang))
    return out


def check(spark, rows):
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    got = {r.doc_id: r for r in langid.predicted(frame).collect()}
    learn = [(t, lang) for d, t, lang in rows if not held_out(d) and t is not None and lang is not None]
    n = len({g[-1] for t, _ in learn for s in [symbols(t)] for g in (s[i - 3 : i + 1] for i in range(3, len(s)))}) + 1
    models = {lang: Plain([t for t, x in learn if x == lang], n) for lang in sorted({lang for _, lang in learn})}
    for d, text, _ in rows:
        r = got[d]
        assert r.held_out == held_out(d) and 0 <= r.score <= 1
        if text is None or not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            ces = {lang: m.ce(text) for lang, m in models.items()}
            best = min(ces, key=ces.get)
            assert abs(r.cross_entropy - ces[best]) < 1e-9 and ces[r.lang_pred] < ces[best] + 1e-9
    return got


def test_matches_plain_models(spark):
    rows = corpus() + [(500, None, "aa"), (501, "", "bb"), (502, "123 !? ", None), (503, "zzz qqq", None), (504, "퟿日本 the", "aa"), (505, "é" * 5000 + " der", None)]
    got = check(spark, rows)
    assert got[503].rejected  # no language's texts look like that
    right = [got[d].lang_pred == lang for d, _, lang in corpus() if held_out(d)]
    assert sum(right) >= 0.95 * len(right)


def test_pieces_pools_and_segments_give_the_same(spark, monkeypatch):
    rows = corpus()
    want = check(spark, rows)
    for name, least in (("PIECE", 7), ("POOL", 20), ("SEGMENT", 100)):
        monkeypatch.setattr(langid, name, least)
    got = check(spark, rows)
    assert {d: (r.lang_pred, r.score, r.rejected) for d, r in got.items()} == {d: (r.lang_pred, r.score, r.rejected) for d, r in want.items()}


def test_odd_tables(spark):
    frame = spark.createDataFrame([(None, "abc", "x", "c"), (None, None, None, "c"), (7, "abc", "x", "c"), (7, "abc", "x", "c")], SCHEMA)
    rows = langid.predicted(frame).collect()
    assert sorted(r.lang_pred for r in rows) == ["und", "x", "x", "x"]
    assert langid.predicted(frame.limit(0)).count() == 0
    nothing = langid.predicted(frame.withColumn("lang", frame["ce"].substr(9, 1)).selectExpr("doc_id", "text", "nullif(lang, '') as lang"))
    assert {(r.lang_pred, r.score) for r in nothing.collect()} == {("und", 0.0)}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in op13_language_id(spark, folder).collect() if r.held_out]
    assert len(rows) > 250 and sum(r.lang_pred == langs[r.doc_id] for r in rows) >= 0.98 * len(rows)
    assert sum(r.rejected for r in rows) <= 0.03 * len(rows)
