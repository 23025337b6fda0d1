from collections import Counter, defaultdict

import corpus_pipeline as p
from veridale.sources.scratch import written

from .test_contamination import brute as contaminated
from .test_mixing import targets
from .test_simhash import brute_components, brute_fp


def test_stages_against_plain_versions(spark, small):
    columns = spark.read.parquet(f"{small}/documents.parquet").columns
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = [docs.collect()]
    for name, stage in p.STAGES:
        docs = written(stage(spark, docs, small), name)
        seen.append(docs.collect())
        if name != "sharding":
            assert docs.columns == columns
    start, good, single, clean, mixed, placed = seen
    assert 0.5 * len(start) < len(good) < len(start)
    assert all(len((r.text or "").split()) >= 50 for r in good)
    groups = brute_components({r.doc_id: brute_fp(r.text) for r in good})
    assert sorted(r.doc_id for r in single) == sorted(set(groups.values()))
    items = {r.item_id: r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    bad = {d for d, _ in contaminated({r.doc_id: r.text for r in single}, items)}
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in single if r.doc_id not in bad)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in clean:
        sizes[r.source] += len(r.text.split())
    for r in mixed:
        taken[r.source] += len(r.text.split())
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3
    want = targets(sizes)
    assert abs(sum(taken.values()) - sum(want.values())) < 0.1 * sum(want.values())
    assert Counter(r.doc_id for r in placed) == Counter(r.doc_id for r in mixed)
    counts = Counter(r.shard for r in placed)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(40)) <= 1


def test_run_and_odd_rows(spark, small):
    assert p.run(spark, small).count() > 0
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(20)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "w " * 80, None, "s", 1), (5, "", "en", None, None)], docs.schema)
    both = docs.unionByName(docs).unionByName(odd)
    for name, stage in p.STAGES:
        more = both.withColumn("slots", both.n_chars).withColumns({c: both.lang for c in ("_id", "_k", "_text", "_t", "_w", "_again", "digest", "n", "copies", "class", "rank", "a.b")})
        out = stage(spark, more, small)
        assert out.count() > 0
        if name != "sharding":
            assert out.columns == more.columns, name
        assert stage(spark, both.limit(0), small).count() == 0, name


def test_rows_without_ids_are_judged_each(spark, small):
    schema = spark.read.parquet(f"{small}/documents.parquet").schema
    item = spark.read.parquet(f"{small}/benchmark.parquet").orderBy("item_id").first().text
    said = ["".join(f"{w}{k}q " for w in "abcdefghijklmnopqrstuvwxyz" for _ in "12") for k in ("one", "two", "three", "four")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in [*[(None, t) for t in said], (None, said[0]), (7, said[0]), (7, "another text " * 40), (7, item), (None, item + " and so on")]], schema)
    single = p.near_dedup(spark, docs, small)
    kept = {(r.doc_id, r.text) for r in single.collect()}
    assert {(None, t) for t in said[1:]} | {(7, said[0]), (7, "another text " * 40)} <= kept and (None, said[0]) not in kept
    assert single.count() == len(kept)
    five = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in zip((None, None, 7, 7, 9), [*said, "five " * 9 + "other words"])], schema)
    assert p.near_dedup(spark, five, small).count() == 5
    many = p.mix(spark, spark.createDataFrame([(3, said[0], "en", "a", 1)] * 40 + [(None, said[1], "en", "b", 1)] * 10, schema), small)
    assert 30 <= many.count() <= 90 and many.columns == five.columns
    clean = {(r.doc_id, r.text) for r in p.decontamination(spark, docs, small).collect()}
    assert clean == {(None, t) for t in said} | {(7, said[0]), (7, "another text " * 40)}
    halves = item.split()
    parts = [" ".join(halves[: len(halves) // 2]), " ".join(halves[len(halves) // 2 - 4 :])]
    apart = spark.createDataFrame([(None, t, "en", "s", 1) for t in parts], schema)
    assert p.decontamination(spark, apart, small).count() == 2
    mixed = {r.text for r in p.mix(spark, spark.createDataFrame([(None, t, "en", k, 1) for t, k in zip(said, "abba")], schema), small).collect()}
    assert mixed <= set(said) and len(mixed) > 1
