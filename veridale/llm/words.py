"""Column helpers on texts that several operators share. All are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of other characters than these six.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def whole(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text that isn't null."""
    return F.array_remove(F.split(text, SPACE_RUN), "")


def count_of(text: Column, chars: str) -> Column:
    """How often any of these one-byte characters occurs."""
    gone = [F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c))) for c in chars]
    return sum(gone[1:], gone[0]).cast("long")


def n_words(text: Column) -> Column:
    """Number of words, without an array of them: each word but the last ends before a space run."""
    one_line = F.btrim(text, F.lit(SPACES))
    return F.when(one_line == "", 0).otherwise(F.size(F.split(one_line, SPACE_RUN))).cast("long")


def unsigned_hex(value: Column) -> Column:
    """16 lowercase hex digits of a long."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))
