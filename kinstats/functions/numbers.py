"""Numbers in delimited text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Tokens that stand for a missing value.
MISSING = ["", "NA", "nan", "NaN", ".", "-", "NULL"]


def words_of(line: Column) -> Column:
    """Tokens between white space; only lines with several blanks in a row take a pattern."""
    plain = F.trim(F.translate(line, "\t\n\x0b\f\r", " " * 5))
    return F.split(F.when(F.contains(plain, F.lit("  ")), F.regexp_replace(plain, " +", " ")).otherwise(plain), " ")


def number(token: Column) -> Column:
    """The token as a finite double if all of it is a number, else null."""
    value = F.when(token.rlike(NUMBER), token.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def missing_or_number(token: Column) -> Column:
    return F.when(~token.isin(MISSING), number(token))
