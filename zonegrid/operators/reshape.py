"""Wide, long, dense and reindexed forms of an origin-destination relation.

The wide relation (Origin, Destination, one DOUBLE a table) is sparse: a pair that is not there is
0.0 in every table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonegrid.errors import od_error
from zonegrid.functions.cells import any_nonzero, quoted
from zonegrid.header import TableInfo

KEYS = ["Origin", "Destination"]
#: Cells up to which a long relation holds zeros by itself.
AUTO_ZEROS = 200_000


def grid(spark: SparkSession, zones: int, origins: int | None = None) -> DataFrame:
    """All pairs of zones, or those of the first `origins`, made in parallel."""
    every = F.sequence(F.lit(1).cast("long"), F.lit(zones).cast("long"))
    return spark.range(1, (zones if origins is None else origins) + 1).select(F.col("id").alias("Origin"), F.explode(every).alias("Destination"))


def densify(wide: DataFrame, zones: int) -> DataFrame:
    """wide with every pair of zones; what is missing is 0.0, NaN stays.

    Rows meet by origin, and each origin's missing destinations are made where its rows are: only what
    is there is shuffled, not the grid.
    """
    tables = [c for c in wide.columns if c not in KEYS]
    cells = [F.coalesce(quoted(c), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(tables)]
    there = wide.groupBy("Origin").agg(F.collect_list(F.struct(F.col("Destination").cast("long").alias("d"), *cells)).alias("there"))
    origins = wide.sparkSession.range(1, zones + 1).select(F.col("id").alias("Origin")).join(there, "Origin", "left")
    every = F.sequence(F.lit(1).cast("long"), F.lit(zones).cast("long"))
    missing = F.array_except(every, F.coalesce(F.transform("there", lambda x: x["d"]), F.array().cast("array<bigint>")))
    zeros = F.transform(missing, lambda d: F.struct(d.alias("d"), *[F.lit(0.0).alias(f"c{i}") for i in range(len(tables))]))
    rows = origins.select("Origin", F.explode(F.when(F.col("there").isNull(), zeros).otherwise(F.concat("there", zeros))).alias("x"))
    return rows.where(F.col("x.d").between(1, zones)).select("Origin", F.col("x.d").alias("Destination"), *[F.col(f"x.c{i}").alias(c) for i, c in enumerate(tables)])


def nonzero(wide: DataFrame, tables: Sequence[str] | None = None) -> DataFrame:
    """The pairs with a cell other than zero in one of the tables."""
    return wide.where(any_nonzero(tables if tables is not None else [c for c in wide.columns if c not in KEYS]))


def checked_base(zone_base: int, most: int = 1) -> int:
    """zone_base, if it is a whole number from 0 to `most`."""
    if isinstance(zone_base, bool) or not isinstance(zone_base, int) or not 0 <= zone_base <= most:
        raise od_error("invalid_od", f"zone_base is from 0 to {most}, not {zone_base!r}")
    return zone_base


def shifted(wide: DataFrame, zone_base: int, most: int = 1) -> DataFrame:
    """Zones counted from zone_base, `most` at the utmost, instead of 1."""
    if checked_base(zone_base, most) == 1:
        return wide
    return wide.select(*[(F.col(c) + F.lit(zone_base - 1)).alias(c) for c in KEYS], *[quoted(c) for c in wide.columns if c not in KEYS])


def renamed(wide: DataFrame, names: Mapping[str, str], origin: str = "Origin", destination: str = "Destination") -> DataFrame:
    """wide with tables and keys renamed; unknown, empty and equal names are errors."""
    tables = [c for c in wide.columns if c not in KEYS]
    for old, new in names.items():
        if old not in tables:
            raise od_error("table_not_found", f"no table {old!r} to rename")
        if not isinstance(new, str) or not new:
            raise od_error("invalid_table_name", f"{new!r}")
    final = [origin, destination, *(names.get(c, c) for c in tables)]
    if not origin or not destination or len(set(final)) < len(final):
        raise od_error("invalid_table_name", f"columns are not distinct: {', '.join(final)}")
    return wide.toDF(*final)


def wide(frame: DataFrame, tables: Sequence[TableInfo], zones: int, *, rename: Mapping[str, str] | None = None, origin: str = "Origin", destination: str = "Destination", zone_base: int = 1, include_zero_rows: bool = False, sort_od: bool = True, most_base: int = 1) -> DataFrame:
    """The wide export: chosen tables in order, zero pairs left out or all pairs, sorted by pair."""
    df = frame.select(*KEYS, *[quoted(t.column).alias(t.column) for t in tables])
    df = densify(df, zones) if include_zero_rows else nonzero(df)
    df = df.orderBy(*KEYS) if sort_od else df
    return renamed(shifted(df, zone_base, most_base), rename or {}, origin, destination)


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """The tables of two wide relations side by side, by pair; a pair that one of them lacks has 0.0 there.

    A table that both have is an error: rename one first.
    """
    tables = [[c for c in df.columns if c not in KEYS] for df in (left, right)]
    if both := {c.lower() for c in tables[0]} & {c.lower() for c in tables[1]}:
        raise od_error("invalid_table_name", f"both sides have {', '.join(sorted(both))}")
    return left.join(right, KEYS, "full").select(*KEYS, *[F.coalesce(quoted(c), F.lit(0.0)).alias(c) for c in (*tables[0], *tables[1])])


def include_zeros(policy: str, tables: int, zones: int, override: bool | None = None) -> bool:
    """Whether a long relation holds zeros: by policy auto, include or exclude, or as said."""
    if override is not None:
        return override
    if policy not in ("auto", "include", "exclude"):
        raise od_error("invalid_od", f"zero_policy is auto, include or exclude, not {policy!r}")
    return policy == "include" or (policy == "auto" and tables * zones * zones <= AUTO_ZEROS)


def long(frame: DataFrame, tables: Sequence[TableInfo], zones: int, *, zeros: bool, zone_base: int = 1, sort: bool = True) -> DataFrame:
    """(table_index from 0, table, origin, destination, value), by table as asked for, then by pair."""
    df = frame.select(*KEYS, *[quoted(t.column).alias(t.column) for t in tables])
    df = shifted(densify(df, zones) if zeros else df, zone_base)
    cells = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(t.index - 1).alias("table_index"), F.lit(t.name).alias("table"), quoted(t.column).alias("value")) for i, t in enumerate(tables)])
    df = df.select(*KEYS, F.inline(cells))
    if not zeros:
        df = df.where("value <> 0")
    if sort:
        df = df.orderBy("place", *KEYS)
    return df.select("table_index", "table", F.col("Origin").cast("int").alias("origin"), F.col("Destination").cast("int").alias("destination"), "value")


def reindexed(frame: DataFrame, keep: Sequence[int], zones: int, basis: str = "zone") -> DataFrame:
    """The zones of keep, numbered from 1 in keep's order, on both axes."""
    if basis not in ("zone", "index"):
        raise od_error("invalid_od", f"basis is zone or index, not {basis!r}")
    ids = list(keep)
    first = 1 if basis == "zone" else 0
    if not ids or any(isinstance(z, bool) or not isinstance(z, int) or not first <= z < zones + first for z in ids) or len(set(ids)) < len(ids):
        raise od_error("invalid_od", "keep needs distinct zones of the matrix, one at least")
    rows = [(z + 1 - first, i) for i, z in enumerate(ids, 1)]
    spark = frame.sparkSession
    places = [spark.createDataFrame(rows, f"{k} long, {k}_new long") for k in KEYS]  # at most as many rows as zones
    tables = [c for c in frame.columns if c not in KEYS]
    return frame.join(places[0], "Origin").join(places[1], "Destination").select(*[F.col(f"{k}_new").alias(k) for k in KEYS], *[quoted(c) for c in tables])
