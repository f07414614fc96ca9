"""Column expressions that the operators made of DataFrame functions share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spark's escapes for the six white-space characters of the word definition.
BLANKS = " \t\n\x0b\f\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row: a lambda's variable, which no optimizer rule expands again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blank_words(text: Column) -> Column:
    """The runs of other characters than blanks, in order; none for null and blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_CLASS + "+", -1))


def total(values: Column) -> Column:
    """Sum of an array of whole numbers; 0 if it is empty."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)
