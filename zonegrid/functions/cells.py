"""Expressions on cell values."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from zonegrid.header import type_code

_LARGEST = float(2**32 - 1)


def quoted(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def any_nonzero(columns: Iterable[str]) -> Column:
    """Whether a cell of any column is not zero; NaN is not, -0.0 is."""
    return reduce(lambda a, b: a | b, [quoted(c) != F.lit(0.0) for c in columns], F.lit(False))


def _rounded(value: Column, code: str) -> Column:
    power = F.lit(10.0 ** int(code))
    return F.rint(value * power) / power + F.lit(0.0)  # + 0.0 makes -0.0 what a file holds, +0.0


def _misfit(value: Column, code: str) -> Column:
    finite = ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    if code == "S":
        return finite & (F.abs(value.cast("float")) == F.lit(float("inf")).cast("float"))
    return ~finite | (F.abs(F.rint(value * F.lit(10.0 ** int(code)))) > F.lit(_LARGEST))


def quantised(value: Column, code: object, origin: Column | str = "Origin") -> Column:
    """The value as a table of that type code stores it.

    Fixed-point codes round half to even in binary; S goes through float32; D is exact. A row (all of
    an origin's cells of the table) that holds a value which its code can't is stored unrounded, so
    the expression looks at its origin's other rows.
    """
    code = type_code(code)
    if code == "D":
        return value
    stored = value.cast("float").cast("double") if code == "S" else _rounded(value, code)
    misfit = F.max(_misfit(value, code)).over(Window.partitionBy(origin))
    return F.when(misfit, value).otherwise(stored)


def plain_text(value: Column) -> Column:
    """A value as the shortest decimal that gives it back, without an exponent; whole numbers have no fraction."""
    whole = (F.abs(value) < F.lit(float(2**53))) & (value == F.floor(value))
    short = F.abs(value).cast("string")
    first, rest = F.substring(short, 1, 1), F.regexp_replace(F.regexp_extract(short, r"^\d\.(\d+)E", 1), "^0$", "")
    exponent = F.regexp_extract(short, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.concat(first, rest)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    large = F.when(F.length(rest) <= exponent, F.concat(digits, F.repeat(F.lit("0"), exponent - F.length(rest)))).otherwise(F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.length(digits))))
    spelt = F.concat(F.when(value < 0, "-").otherwise(""), F.when(exponent < 0, small).otherwise(large))
    return F.when(whole, value.cast("long").cast("string")).when(short.contains("E"), spelt).otherwise(value.cast("string"))
