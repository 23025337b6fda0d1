"""Tables out of lines: page and line numbering, headers, rows.

Texts are exploded into lines once; a header holds for the lines after it on its page, carried by
last(ignoreNulls) over the lines of a document and page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TIME, coerced, is_text_token, line_tokens

#: Page marks of extracted texts: === 第 N 页 ===
PAGE_MARK = r"^=+ *第 *([0-9]+) *页 *=+$"
MIN_DOMAIN_COLUMNS = 4


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, page, line_no (from 1, over pages), line (trimmed) of the lines that aren't empty or page marks."""
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "raw"))
    number = F.regexp_extract("raw", PAGE_MARK, 1)
    mark = F.when(F.col("raw").startswith("=") & (number != ""), number.try_cast("int"))  # a cast that fails takes longer than all else here
    w = Window.partitionBy("doc_id").orderBy("k")
    each = each.withColumn("mark", mark).withColumn("page", F.coalesce(F.last("mark", ignorenulls=True).over(w), F.lit(1)))
    kept = each.withColumn("line", F.btrim("raw")).where((F.col("line") != "") & F.col("mark").isNull())
    return kept.withColumn("line_no", F.row_number().over(w)).select("doc_id", "page", "line_no", "line")


def pages(docs: DataFrame, separator: str = "\f") -> DataFrame:
    """doc_id, page (from 1), text of each page."""
    return docs.select("doc_id", F.posexplode(F.split("text", separator)).alias("k", "text")).select("doc_id", (F.col("k") + 1).alias("page"), "text")


def header_slots(aliases: dict[str, str]) -> Column:
    """Of the column `tokens`: a slot or null for each token, by the first alias that the token contains."""

    def slot(token: Column) -> Column:
        out = F.lit(None).cast("string")
        for alias, name in reversed([*aliases.items()]):
            out = F.when(token.contains(alias), name).otherwise(out)
        return out

    return F.transform("tokens", slot)


def domain_rows(docs: DataFrame, aliases: dict[str, str], id_slot: str) -> DataFrame:
    """doc_id, page, line_no, cells map<slot,string> of lines under a header of MIN_DOMAIN_COLUMNS known slots, with an id."""
    each = lines(docs).withColumn("tokens", line_tokens(F.col("line")))
    slots = header_slots(aliases)
    known = F.size(F.array_distinct(F.filter(slots, lambda s: s.isNotNull())))
    named = lambda name: F.greatest(F.lit(0), *[F.col("line").contains(a).cast("int") for a, n in aliases.items() if n == name])
    may = sum((named(n) for n in dict.fromkeys(aliases.values())), F.lit(0)) >= MIN_DOMAIN_COLUMNS  # tokens are looked at only in lines that have enough aliases
    each = _under(each.withColumn("header", F.when(may, F.when(known >= MIN_DOMAIN_COLUMNS, _header(slots)))))
    return each.where("is_row").select("doc_id", "page", "line_no", "tokens", _cells().alias("cells")).where(F.coalesce(F.col("cells")[id_slot], F.lit("")) != "")


def generic_header(tokens: Column) -> Column:
    """3 tokens or more, at least half and two of them text."""
    texts = F.size(F.filter(tokens, is_text_token))
    return (F.size(tokens) >= 3) & (texts * 2 >= F.size(tokens)) & (texts >= 2)


def header_confidence(tokens: Column) -> Column:
    return F.least(0.5 + 0.3 * F.size(F.filter(tokens, is_text_token)) / F.size(tokens), F.lit(0.95))


def unique_names(names: Column) -> Column:
    """Repeated names with _2, _3, ... in order."""
    return F.transform(names, lambda n, i: F.when(
        F.size(F.filter(F.slice(names, 1, i), lambda m: m == n)) > 0,
        F.concat(n, F.lit("_"), (F.size(F.filter(F.slice(names, 1, i), lambda m: m == n)) + 1).cast("string"))).otherwise(n))


#: Lines without this have no text tokens: letters between blanks, or a Han character.
MAY_HAVE_TEXT = r"(^|[ \t])[a-zA-Z]+([ \t]|$)|[一-龥]"


def _generic(docs: DataFrame) -> DataFrame:
    """The lines of documents with their tokens, the header they are under, is_row, and n, how many rows their document has."""
    each = lines(docs).withColumn("tokens", line_tokens(F.col("line")))
    each = each.withColumn("is_header", F.col("line").rlike(MAY_HAVE_TEXT) & generic_header(F.col("tokens")))
    upto = Window.partitionBy("doc_id", "page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.sum(F.col("is_header").cast("int")).over(upto) == 1
    each = each.withColumn("first", first).withColumn("header", F.when(F.col("is_header") & F.col("first"), _header(unique_names(F.col("tokens")))))
    rows = _under(each).withColumn("is_row", F.col("is_row") & (F.size("tokens") >= 2))
    return rows.withColumn("n", F.sum(F.col("is_row").cast("int")).over(Window.partitionBy("doc_id")))


def generic_rows(docs: DataFrame) -> DataFrame:
    """As domain_rows, under the first line of a page that looks like a header; documents with 2 rows or more."""
    return _generic(docs).where("is_row and n >= 2").select("doc_id", "page", "line_no", _cells().alias("cells"))


def _header(names: Column) -> Column:
    """struct(names, plain): plain if no name is null or there twice; told once a header, not once a row."""
    return F.struct(names.alias("names"), (F.forall(names, lambda n: n.isNotNull()) & (F.size(F.array_distinct(names)) == F.size(names))).alias("plain"))


def _under(each: DataFrame) -> DataFrame:
    """under: the last header before a line on its page; is_row: whether a line that is no header has one."""
    w = Window.partitionBy("doc_id", "page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    under = each.withColumn("under", F.last("header", ignorenulls=True).over(w))
    return under.withColumn("is_row", F.col("under").isNotNull() & F.col("header").isNull())


def _cells() -> Column:
    """The tokens by the names they are under."""
    names, many = F.col("under.names"), F.least(F.size("under.names"), F.size("tokens"))
    name, value = F.slice(names, 1, many), F.slice("tokens", 1, many)
    pairs = F.filter(F.arrays_zip(name.alias("name"), value.alias("value")), lambda p: p["name"].isNotNull())
    return F.when(F.col("under.plain"), F.map_from_arrays(name, value)).otherwise(F.map_from_entries(F.array_distinct(F.transform(pairs, lambda p: F.struct(p["name"], p["value"])))))


def typed_cells(rows: DataFrame) -> DataFrame:
    """doc_id, page, line_no, name, kind, number, string: a row for each cell, coerced."""
    each = rows.select("doc_id", "page", "line_no", F.explode("cells").alias("name", "raw"))
    return each.select("doc_id", "page", "line_no", "name", coerced(F.col("raw")).alias("c")).select("doc_id", "page", "line_no", "name", "c.*")


def heuristic_rows(each: DataFrame, id_pattern: str = "^[Zz2][0-9A-Za-z-]*$") -> DataFrame:
    """Lines of 6 tokens or more whose first is an id: doc_id, page, line_no, id, numbers (of the other tokens, null if not one)."""
    tokens = line_tokens(F.col("line"))
    rows = each.withColumn("tokens", tokens).where((F.size("tokens") >= 6) & F.col("tokens")[0].rlike(id_pattern))
    return rows.select("doc_id", "page", "line_no", F.col("tokens")[0].alias("id"), F.transform(F.slice("tokens", 2, 100), lambda v: v.try_cast("double")).alias("numbers"))


def column_features(cells: DataFrame) -> DataFrame:
    """doc_id, name, numeric, time (shares), passes: whether a column is at least 70 % numbers or 60 % times."""
    value = F.coalesce("string", F.col("number").cast("string"))
    shares = cells.groupBy("doc_id", "name").agg(F.avg(F.col("number").isNotNull().cast("double")).alias("numeric"), F.avg(value.rlike(TIME).cast("double")).alias("time"))
    return shares.withColumn("passes", (F.col("numeric") >= 0.7) | (F.col("time") >= 0.6))


def chain_holds(rows: DataFrame, length: str, top: str, bottom: str, tolerance: float = 0.1, least: int = 3) -> DataFrame:
    """doc, n, share, passes: how often length = top - bottom among the complete rows."""
    ok = F.abs(F.col(length) - (F.col(top) - F.col(bottom))) <= tolerance + 1e-9
    out = rows.where(ok.isNotNull()).groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.avg(ok.cast("double")).alias("share"))
    return out.withColumn("passes", F.when(F.col("n") >= least, F.col("share") >= 0.7))


def inferred_chain(values: DataFrame, length: str, tolerance: float = 0.1) -> DataFrame:
    """doc, top, bottom: the pair of columns of (doc, row, col, v) whose difference is the column `length` in 80 % of 3 or more rows, with the least mean error.

    The pairs of a row's columns are few: a row has a bounded number of columns.
    """
    v = values.where("v is not null")
    target = v.where(F.col("col") == length).select("doc", "row", F.col("v").alias("want"))
    a, b = (v.where(F.col("col") != length).select("doc", "row", F.col("col").alias(n), F.col("v").alias(f"v_{n}")) for n in ("top", "bottom"))
    pairs = a.join(b, ["doc", "row"]).where("top <> bottom").join(target, ["doc", "row"])
    error = F.abs(F.col("want") - (F.col("v_top") - F.col("v_bottom")))
    scored = pairs.groupBy("doc", "top", "bottom").agg(F.count(F.lit(1)).alias("n"), F.avg((error <= tolerance).cast("double")).alias("share"), F.avg(error).alias("error"))
    best = Window.partitionBy("doc").orderBy("error", "top", "bottom")
    return scored.where("n >= 3 and share >= 0.8").withColumn("k", F.row_number().over(best)).where("k = 1").select("doc", "top", "bottom", "share", "error")


def header_fusion(features: Column, chain: Column, inferred: Column) -> Column:
    """struct(confidence, needs_human)."""
    confidence = F.least(F.lit(1.0), 0.5 + 0.3 * F.coalesce(features, F.lit(0.5)) + 0.2 * F.when(inferred, F.greatest(F.coalesce(chain, F.lit(0.6)), F.lit(0.7))).otherwise(F.coalesce(chain, F.lit(0.6))))
    return F.struct(confidence.alias("confidence"), (confidence < 0.7).alias("needs_human"))


def expected_rows(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, expected: as known by name, else 20 rows a page of a pdf, 15 of others."""
    guess = F.col("pages") * F.when(F.col("file_type") == "pdf", 20).otherwise(15)
    return docs.join(known.select("name", F.col("rows").alias("_rows")), "name", "left").select("doc_id", F.coalesce("_rows", guess).alias("expected"))


def row_gate(actual: Column, expected: Column) -> Column:
    """Whether 80 % of the expected rows are there; unknown passes."""
    return F.coalesce(F.try_divide(actual, expected) >= 0.8, F.lit(True))


def candidate_lines(each: DataFrame, noise: list[str]) -> DataFrame:
    """doc_id, page, raw: lines that hold none of the noise marks."""
    bad = F.lit(False)
    for mark in noise:
        bad = bad | F.col("line").contains(mark)
    return each.where(~bad).select("doc_id", "page", F.col("line").alias("raw"))


def rows_by_type(docs: DataFrame, aliases: dict[str, str], id_slot: str, domain: str) -> DataFrame:
    """doc_id, page, line_no, cells: domain rows for documents whose type matches `domain`, generic tables for the others, lines where there is no table."""
    is_domain = F.coalesce(F.col("doc_type").rlike(domain), F.lit(False))
    first = domain_rows(docs.where(is_domain), aliases, id_slot).select("doc_id", "page", "line_no", "cells")
    others = _generic(docs.where(~is_domain)).where("is_row or n < 2")  # a document has a table or plain lines: one pass for both
    cells = F.when(F.col("n") >= 2, _cells()).otherwise(F.create_map(F.lit("raw_text"), F.col("line")))
    return first.unionByName(others.select("doc_id", "page", "line_no", cells.alias("cells")))


def slot_schema(aliases: DataFrame) -> DataFrame:
    """slot, aliases, of (alias, slot, status) with learned ones that are active."""
    return aliases.where("status is null or status = 'active'").groupBy("slot").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
