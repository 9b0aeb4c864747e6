"""Updates of cells; each gives a new relation. Whether zeros must be there first is said for each."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonegrid.functions.cells import any_nonzero, quoted
from zonegrid.operators.reshape import KEYS, densify, grid


def transformed(frame: DataFrame, changes: Mapping[str, Column | Callable[[Column], Column]], zones: int | None = None) -> DataFrame:
    """Tables replaced by expressions on the old ones. Give zones if an expression makes zero something else."""
    df = densify(frame, zones) if zones is not None else frame
    new = {c: f(quoted(c)) if callable(f) and not isinstance(f, Column) else f for c, f in changes.items()}
    return df.select(*[new[c].alias(c) if c in new else quoted(c) for c in df.columns])


def changed(frame: DataFrame, changes: Mapping[str, Column | Callable[[Column], Column]], zones: int, where: Column | None = None) -> DataFrame:
    """transformed(), with the pairs that frame lacks and whose zeros the expressions make something else.

    `where` bounds the pairs that can change. Expressions that don't look at the zones are tried on one row
    of zeros; only if they give something else, or look at the zones, are the missing pairs gone through.
    """
    spark, tables = frame.sparkSession, [c for c in frame.columns if c not in KEYS]
    zeros = [F.lit(0.0).alias(c) for c in tables]
    try:
        tried = transformed(spark.range(1).select(*zeros), changes).select(F.expr("true").alias("there"), any_nonzero([*changes]).alias("differs"))
        differs = bool(tried.first()["differs"])
    except AnalysisException:  # it looks at the zones
        differs = True
    own = transformed(frame, changes)
    if not differs:
        return own
    pairs = grid(spark, zones)
    missing = (pairs if where is None else pairs.where(where)).join(frame.select(*KEYS), KEYS, "left_anti").select(*KEYS, *zeros)
    return own.unionByName(transformed(missing, changes).where(any_nonzero([*changes])))


def masked(frame: DataFrame, table: str, where: Column, value: Column, zones: int | None = None) -> DataFrame:
    """A table's cells replaced where a condition holds. Give zones if it can hold for zero pairs."""
    return transformed(frame, {table: F.when(where, value).otherwise(quoted(table))}, zones)


def clamped(frame: DataFrame, table: str, low: float) -> DataFrame:
    """Cells below low raised to it; NaN stays. low is 0 or less, or the frame is dense."""
    return transformed(frame, {table: F.greatest(quoted(table), F.lit(float(low)))})


def filled(frame: DataFrame, table: str, value: float, zones: int) -> DataFrame:
    """Every cell of a table set to a value."""
    return transformed(frame, {table: F.lit(float(value))}, zones)


def submatrix(frame: DataFrame, table: str, origins: Sequence[int], destinations: Sequence[int], change: Callable[[Column], Column], zones: int | None = None) -> DataFrame:
    """A table's block of origins by destinations changed."""
    return masked(frame, table, F.col("Origin").isin(list(origins)) & F.col("Destination").isin(list(destinations)), change(quoted(table)), zones)


def _merged(frame: DataFrame, table: str, other: DataFrame, value: Callable[[Column, Column], Column]) -> DataFrame:
    """frame outer-joined with other (Origin, Destination, _new); other tables are 0.0 in new pairs."""
    both = frame.join(other, KEYS, "full")
    cells = [value(quoted(c), F.col("_new")).alias(c) if c == table else F.coalesce(quoted(c), F.lit(0.0)).alias(c) for c in frame.columns if c not in KEYS]
    return both.select(*KEYS, *cells)


def points(frame: DataFrame, table: str, updates: DataFrame) -> DataFrame:
    """Cells set from updates (Origin, Destination, value), pairs that weren't there included."""
    new = updates.select(*KEYS, F.struct(F.col("value").cast("double").alias("v")).alias("_new"))
    return _merged(frame, table, new, lambda old, put: F.when(put.isNotNull(), put["v"]).otherwise(F.coalesce(old, F.lit(0.0))))


def scatter_added(frame: DataFrame, table: str, deltas: DataFrame) -> DataFrame:
    """Amounts of deltas (Origin, Destination, value) added to cells; a pair's amounts all count."""
    new = deltas.groupBy(*KEYS).agg(F.sum(F.col("value").cast("double")).alias("_new"))
    return _merged(frame, table, new, lambda old, more: F.coalesce(old, F.lit(0.0)) + F.coalesce(more, F.lit(0.0)))


def replaced(frame: DataFrame, table: str, cells: DataFrame) -> DataFrame:
    """A whole table set from cells (Origin, Destination, value); pairs that it lacks become 0.0."""
    new = cells.select(*KEYS, F.col("value").cast("double").alias("_new"))
    return _merged(frame, table, new, lambda old, put: F.coalesce(put, F.lit(0.0)))
