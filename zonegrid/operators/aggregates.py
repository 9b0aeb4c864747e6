"""Totals, margins and diagonals; each is one pass with partial sums before any shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonegrid.functions.cells import quoted
from zonegrid.header import TableInfo
from zonegrid.operators.reshape import densify



def _sum(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0.0))


def _on_diagonal(t: TableInfo) -> Column:
    return F.when(F.col("Origin") == F.col("Destination"), quoted(t.column)).otherwise(F.lit(0.0))


def stats(frame: DataFrame, tables: Sequence[TableInfo]) -> DataFrame:
    """(table_index, table, type_code, total, diagonal) of every table, in one aggregation."""
    sums = [e for t in tables for e in (_sum(quoted(t.column)).alias(f"t{t.index}"), _sum(_on_diagonal(t)).alias(f"d{t.index}"))]
    rows = F.array(*[F.struct(F.lit(t.index).alias("table_index"), F.lit(t.name).alias("table"), F.lit(t.code).alias("type_code"), F.col(f"t{t.index}").alias("total"), F.col(f"d{t.index}").alias("diagonal")) for t in tables])
    return frame.agg(*sums).select(F.inline(rows))


def total(frame: DataFrame, table: TableInfo) -> DataFrame:
    return frame.agg(_sum(quoted(table.column)).alias("total"))


def diagonal_total(frame: DataFrame, table: TableInfo) -> DataFrame:
    return frame.where("Origin = Destination").agg(_sum(quoted(table.column)).alias("diagonal"))


def margin(frame: DataFrame, tables: Sequence[TableInfo], axis: str, zones: int | None = None) -> DataFrame:
    """Each table's sums by Origin or Destination; with zones, zones without a pair are there as 0.0."""
    df = frame.groupBy(axis).agg(*[_sum(quoted(t.column)).alias(t.column) for t in tables])
    if zones is None:
        return df
    every = frame.sparkSession.range(1, zones + 1).select(F.col("id").alias(axis))
    return every.join(df, axis, "left").select(axis, *[F.coalesce(quoted(t.column), F.lit(0.0)).alias(t.column) for t in tables])


def diagonal(frame: DataFrame, tables: Sequence[TableInfo], zones: int | None = None) -> DataFrame:
    """(Zone, tables): the cells of each zone with itself; with zones, all zones are there."""
    df = frame.where("Origin = Destination").select(F.col("Origin").alias("Zone"), *[quoted(t.column) for t in tables])
    if zones is None:
        return df
    every = frame.sparkSession.range(1, zones + 1).select(F.col("id").alias("Zone"))
    return every.join(df, "Zone", "left").select("Zone", *[F.coalesce(quoted(t.column), F.lit(0.0)).alias(t.column) for t in tables])


def row_vector(frame: DataFrame, table: TableInfo, origin: int, zones: int) -> DataFrame:
    """(Origin, cells): one origin's cells by destination, all zones."""
    row = densify(frame.where(F.col("Origin") == origin).select("Origin", "Destination", quoted(table.column)), zones).where(F.col("Origin") == origin)
    pairs = F.array_sort(F.collect_list(F.struct("Destination", quoted(table.column).alias("v"))))
    return row.groupBy("Origin").agg(F.transform(pairs, lambda x: x["v"]).alias("cells"))


def pair_counts(frame: DataFrame, zones: int) -> DataFrame:
    """(pairs, missing): distinct pairs and how many of all zones' pairs are not there."""
    return frame.agg(F.count_distinct(F.struct("Origin", "Destination")).alias("pairs")).select("pairs", (F.lit(zones * zones).cast("long") - F.col("pairs")).alias("missing"))
