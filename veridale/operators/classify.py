"""Classification of files by keywords, subdivision and packing of review tasks.

Keyword tables are configuration of bounded size; documents are tested against all of them in one
expression each row, without a join of every document with every keyword.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Terms = dict[str, list[str]]


def hits(name: Column, terms: Terms) -> Column:
    """array<struct<label,n>> of the labels with keywords in the name, in the order of the terms."""
    each = [F.struct(F.lit(label).alias("label"), sum([name.contains(k).cast("int") for k in words[1:]], name.contains(words[0]).cast("int")).alias("n")) for label, words in terms.items() if words]
    return F.filter(F.array(*each), lambda h: h["n"] > 0)


def any_of(name: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | name.contains(w)
    return out


def classified(files: DataFrame, core: Terms, weak: Terms, reference: list[str], generic: list[str], excluded: list[str] = (), default: str = "general") -> DataFrame:
    """files (path, ..) with label, role, source, confidence.

    In turn: excluded, reference keyword, generic keyword, one core label (.9), several (.6, the first), one weak
    label (.6), several (.4), default (.3).
    """
    name = F.lower("path")
    c, w = F.col("_core"), F.col("_weak")
    ladder = [
        (F.col("path").isin(*excluded) if excluded else F.lit(False), None, "excluded", "excluded", 1.0),
        (any_of(name, reference), None, "reference", "reference", 0.9), (any_of(name, generic), None, "general", "generic", 0.9),
        (F.size(c) == 1, c[0]["label"], "audited", "core", 0.9), (F.size(c) > 1, c[0]["label"], "audited", "core", 0.6),
        (F.size(w) == 1, w[0]["label"], "audited", "weak", 0.6), (F.size(w) > 1, w[0]["label"], "audited", "weak", 0.4),
    ]
    out = F.struct(F.lit(default).alias("label"), F.lit("general").alias("role"), F.lit("default").alias("source"), F.lit(0.3).alias("confidence"))
    for when, label, role, source, confidence in reversed(ladder):
        label = F.lit(None).cast("string") if label is None else label
        out = F.when(when, F.struct(label.alias("label"), F.lit(role).alias("role"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))).otherwise(out)
    found = files.withColumn("_core", hits(name, core)).withColumn("_weak", hits(name, weak))
    return found.withColumn("_c", out).select(*files.columns, "_c.*")


def ladder(name: Column, steps: list[tuple[str, str]], default: str) -> Column:
    """The value of the first step whose keyword is in the name."""
    out = F.lit(default)
    for word, value in reversed(steps):
        out = F.when(name.contains(word), value).otherwise(out)
    return out


def best_label(doc_words: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, code, n: the code with most keyword hits among (doc_id, word), the first on ties (ord); none without a hit."""
    counts = doc_words.join(terms, "word").groupBy("doc_id", "code", "ord").agg(F.count(F.lit(1)).alias("n"))
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "ord"))
    return counts.withColumn("k", k).where("k = 1").select("doc_id", "code", "n")


def assigned(docs: DataFrame, exact: dict[str, str], contained: dict[str, str], keyword: DataFrame) -> DataFrame:
    """docs (doc_id, doc_type, ..) with code: by type, else by a part of the type, else by best_label()."""
    by_type, by_part = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, v in exact.items():
        by_type = F.when(F.col("doc_type") == k, v).otherwise(by_type)
    for k, v in reversed([*contained.items()]):
        by_part = F.when(F.col("doc_type").contains(k), v).otherwise(by_part)
    return docs.join(keyword.select("doc_id", F.col("code").alias("_code")), "doc_id", "left").withColumn("code", F.coalesce(by_type, by_part, "_code")).drop("_code")


def tasks(docs: DataFrame, most: int = 10) -> DataFrame:
    """task, n_docs, docs, checks: documents (doc_id, professional, sub, item, checks) by professional and sub, by item where a sub has over `most`; without a sub: unassigned."""
    n = F.count(F.lit(1)).over(Window.partitionBy("professional", "sub"))
    key = F.when(F.col("sub").isNull(), "unassigned").when(n > most, F.concat_ws("/", "professional", "sub", "item")).otherwise(F.concat_ws("/", "professional", "sub"))
    return docs.withColumn("task", key).groupBy("task").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sort_array(F.collect_list("doc_id")).alias("docs"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("checks")))).alias("checks"))


def tree(dim: DataFrame) -> DataFrame:
    """professional, subs array<struct<code,label>> of (professional, code, label)."""
    return dim.groupBy("professional").agg(F.sort_array(F.collect_list(F.struct("code", "label"))).alias("subs"))


def new_terms(corrections: DataFrame, known: DataFrame) -> DataFrame:
    """keyword, label of corrections that aren't known yet, once each, as candidates."""
    return corrections.select("keyword", "label").dropDuplicates().join(known, ["keyword", "label"], "left_anti").withColumn("status", F.lit("candidate"))


def drawing_type(name: Column) -> Column:
    """as_built, process_sketch or design_basis of a drawing's file name, else null."""
    is_drawing = name.contains("图") | name.rlike(r"(?i)\.(dwg|dxf)$")
    return F.when(is_drawing, F.when(name.contains("竣工"), "as_built").when(name.contains("示意") | name.contains("方案"), "process_sketch").otherwise("design_basis"))


def drawing_role(kind: Column, stage: Column, role: Column) -> Column:
    final = stage.contains("竣工") | stage.contains("移交")
    return F.when(kind.isNull(), role).when((kind != "process_sketch") & final, "audited").otherwise("reference")


def all_terms(table: DataFrame, rule_types: DataFrame, aliases: DataFrame) -> DataFrame:
    """keyword, label, strength: the term table, types of rules by profession (no *), aliases (weak); the strongest of each once."""
    union = (
        table.where("status is null or status = 'active'").select("keyword", "label", "strength")
        .unionByName(rule_types.where("keyword <> '*' and label <> '*'").select("keyword", "label", F.lit("core").alias("strength")))
        .unionByName(aliases.select("keyword", "label", F.lit("weak").alias("strength")))
    )
    return union.groupBy("keyword", "label").agg(F.min("strength").alias("strength"))


def checklists(tasks_: DataFrame, by_code: DataFrame, by_professional: DataFrame) -> DataFrame:
    """task, items: by code, else by professional."""
    return tasks_.join(by_code.withColumnRenamed("items", "_a"), "code", "left").join(by_professional.withColumnRenamed("items", "_b"), "professional", "left").select("task", F.coalesce("_a", "_b", F.array().cast("array<string>")).alias("items"))
