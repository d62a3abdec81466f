"""Words as column expressions: runs of anything but the six ASCII white-space characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BLANKS = " \t\n\x0b\f\r"
SPLIT = r"[ \t-\r]+"
#: The same words in DuckDB.
SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def words(text: Column) -> Column:
    """Array of the words of ``text``, empty for null and blank texts."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed != "", F.split(trimmed, SPLIT)).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """Number of words as a long, 0 for null."""
    return F.size(words(text)).cast("long")


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once for each row, however often they are used afterwards.

    A plain projection may be merged into later ones, and a later filter pushed below it; the expression is then evaluated again, inside
    a lambda even once for each element. Values that come out of a generator stay where they are."""
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names with so many underscores in front that no column of ``taken`` has one of them."""
    lower = {c.lower() for c in taken}
    front = "_"
    while any(front + w in lower for w in wanted):
        front += "_"
    return [front + w for w in wanted]
