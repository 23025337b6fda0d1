"""Text cleaning, parsing and comparison as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PRIVATE_USE = "".join(map(chr, range(0xE000, 0xE012)))
PRIVATE_USE_AS = "—·×÷℃±≤≥≠≈∑∏∫√∞∠∥⊥"
PUNCTUATION = "“”‘’–— 　"
PUNCTUATION_AS = "\"\"''--  "
BRACKETS, BRACKETS_AS = "（）【】", "()[]"
INVISIBLE = r"[​-‏ -  -⁯﻿]"

#: U+FF01 to U+FF5E and what is 0xFEE0 below.
FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F)))
HALF_WIDTH = "".join(map(chr, range(0x21, 0x7F)))


def half_width(c: Column) -> Column:
    return F.translate(c, FULL_WIDTH, HALF_WIDTH)


def private_use_replaced(c: Column) -> Column:
    return F.translate(c, PRIVATE_USE, PRIVATE_USE_AS)


def invisible_removed(c: Column) -> Column:
    return F.regexp_replace(c, INVISIBLE, "")


def punctuation_normalised(c: Column, keep_brackets: bool = True) -> Column:
    more = ("", "") if keep_brackets else (BRACKETS, BRACKETS_AS)
    return F.translate(c, PUNCTUATION + more[0], PUNCTUATION_AS + more[1])


def hard_breaks_joined(c: Column) -> Column:
    """A newline between two ASCII letters or digits goes; pairs don't overlap."""
    return F.regexp_replace(c, "([A-Za-z0-9])\n([A-Za-z0-9])", "$1$2")


def blank_lines_collapsed(c: Column) -> Column:
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def cleaned(c: Column, **off: bool) -> Column:
    """The steps in order; a step is left out by step=False."""
    steps = {
        "invisible": invisible_removed, "private_use": private_use_replaced, "full_width": half_width,
        "punctuation": punctuation_normalised, "hard_breaks": hard_breaks_joined, "blank_lines": blank_lines_collapsed,
    }
    for name, step in steps.items():
        if off.get(name, True):
            c = step(c)
    return F.btrim(c, F.lit(" \t\n\r"))


def line_tokens(line: Column) -> Column:
    """Tokens between runs of 2 or more blanks; between any blanks if there are under 3.

    Tokens are extracted, as a pattern to split by is compiled for every row. A single tab at an end stays with its token.
    """
    line = F.btrim(line)
    wide = F.regexp_extract_all(line, F.lit(r"(?:^[ \t](?=[^ \t]))?[^ \t]+(?:[ \t][^ \t]+)*(?:[ \t]\z)?"), F.lit(0))
    return F.when(line.rlike(r"(?s)[ \t]{2,}[^ \t].*[ \t]{2,}") & (F.size(wide) >= 3), wide).otherwise(F.regexp_extract_all(line, F.lit(r"[^ \t]+"), F.lit(0)))


NUMBER = r"^-?[0-9][0-9,]*(\.[0-9]+)?$"
TIME = r"^[0-9]{1,2}:[0-9]{2}$"


def is_text_token(t: Column) -> Column:
    """Letters only, or anything with a Han character, that is no number, time or date."""
    data = t.rlike(r"^[0-9.,\-]+$") | t.rlike(TIME) | t.rlike(r"^[0-9]{4}[-/年][0-9]{1,2}")
    return t.rlike(r"^[a-zA-Z]+$") | (t.rlike("[一-龥]") & ~data)


def coerced(raw: Column) -> Column:
    """struct(kind, number, string): '' as null, a number with a dot as a double, else an integer, else a string."""
    s = F.btrim(raw)
    number = F.regexp_replace(s, ",", "").try_cast("double")
    kind = F.when(s == "", "null").when(number.isNull(), "string").when(s.contains("."), "double").otherwise("int")
    return F.struct(kind.alias("kind"), F.when(kind.isin("double", "int"), number).alias("number"), F.when(kind == "string", s).alias("string"))


def first_date(text: Column) -> Column:
    """The first YYYY-M-D (also / . or 年月日), else the first 8 digits, as a date; null if there is none or it isn't one."""
    pattern = r"([0-9]{4})[-/.年]([0-9]{1,2})[-/.月]([0-9]{1,2})"
    part = lambda k: F.regexp_extract(text, pattern, k)
    dashed = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    digits = F.regexp_extract(text, "([0-9]{4})([0-9]{2})([0-9]{2})", 0)
    solid = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))
    return F.when(part(1) != "", dashed).when(digits != "", solid).try_cast("date")


def trailing_number(raw: Column) -> Column:
    """The digits at the end as a number; null for chainages such as K0+120."""
    return F.when(~raw.rlike(r"(?i)^k[0-9]+\+"), F.regexp_extract(raw, "([0-9]+)[^0-9]*$", 1)).try_cast("long")


def tokens(text: Column) -> Column:
    """Distinct ASCII words of 2 or more characters, Han pairs and Han characters."""
    low = F.lower(text)
    ascii_ = F.regexp_extract_all(low, F.lit("[a-z0-9_]{2,}"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit("[一-鿿]+"), F.lit(0))
    grams = lambda n: F.flatten(F.transform(runs, lambda r: F.when(F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.length(r) - (n - 1)), lambda i: F.substr(r, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(ascii_, grams(2), grams(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers; 0 if either is zero."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def one_character_apart(a: Column, b: Column) -> Column:
    """Same length and exactly one place differs."""
    chars = lambda c: F.split(c, "")
    apart = F.aggregate(F.zip_with(chars(a), chars(b), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, v: s + v)
    return (F.length(a) == F.length(b)) & (F.length(a) > 0) & (apart == 1)
