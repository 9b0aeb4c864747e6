"""Checks that turn a table with origin and destination columns into a matrix.

All that can be said about the rows is gathered in one aggregation; rows are only looked at again
to name examples in an error or warning.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonegrid.errors import ODWarning, od_error
from zonegrid.functions.cells import any_nonzero, quoted
from zonegrid.header import DEFAULT_BANNER, DEFAULT_RUN_ID, MOST_ZONES, ODHeader, TableInfo, table_infos, type_code
from zonegrid.operators.reshape import KEYS, checked_base, grid

PREVIEW = 8


@dataclass(frozen=True)
class IngestOptions:
    """How a table is taken in. on_duplicate_od is error, or last (by the column `ordinal`).

    most_base is the largest zone_base allowed; with whole_zones, zones in text are digits only (no 2.0).
    """

    origin_col: str = "Origin"
    destination_col: str = "Destination"
    table_columns: Sequence[str] | None = None
    drop_extra_columns: bool = True
    rename_columns: Mapping[str, str] = field(default_factory=dict)
    type_codes: Mapping[str, object] = field(default_factory=dict)
    zone_base: int = 1
    most_base: int = 1
    whole_zones: bool = False
    zone_count: int | None = None
    strict_zone_range: bool = True
    include_zero_rows: bool = True
    sort_od: bool = False
    on_duplicate_od: str = "error"
    ordinal: str | None = None
    on_missing_od: str = "warn"
    missing_warning_limit: int = 10
    banner: str = DEFAULT_BANNER
    run_id: str = DEFAULT_RUN_ID


def _one_of(name: str, value: object, allowed: Sequence[object]) -> None:
    if isinstance(value, bool) or value not in allowed:
        raise od_error("invalid_od", f"{name} is one of {', '.join(map(str, allowed))}, not {value!r}")


def _tables(df: DataFrame, o: IngestOptions) -> tuple[list[str], tuple[TableInfo, ...]]:
    """Source columns and tables, by the options."""
    for name in (o.origin_col, o.destination_col):
        if not isinstance(name, str) or not name:
            raise od_error("invalid_od", "key columns need names")
    if o.origin_col == o.destination_col:
        raise od_error("invalid_od", "origin and destination are the same column")
    checked_base(o.zone_base, o.most_base)
    if o.zone_count is not None and (isinstance(o.zone_count, bool) or not isinstance(o.zone_count, int) or o.zone_count < 1):
        raise od_error("invalid_zone_count", f"{o.zone_count!r}")
    _one_of("on_duplicate_od", o.on_duplicate_od, ("error", "last"))
    _one_of("on_missing_od", o.on_missing_od, ("warn", "ignore", "error"))
    if o.on_duplicate_od == "last" and o.ordinal is None:
        raise od_error("invalid_od", "the last of duplicates needs a column that tells the order")
    if len(set(df.columns)) < len(df.columns):
        raise od_error("invalid_od", "column names repeat")
    for name in (o.origin_col, o.destination_col):
        if name not in df.columns:
            raise od_error("invalid_od", f"no column {name!r}")
    others = [c for c in df.columns if c not in (o.origin_col, o.destination_col, o.ordinal)]
    columns = others if o.table_columns is None else list(o.table_columns)
    if any(not isinstance(c, str) for c in columns) or len(set(columns)) < len(columns):
        raise od_error("invalid_table_name", "table columns are distinct strings")
    if missing := [c for c in columns if c not in others]:
        raise od_error("table_not_found", f"no column {missing[0]!r}")
    if not o.drop_extra_columns and set(others) - set(columns):
        raise od_error("invalid_od", f"extra columns: {', '.join(c for c in others if c not in columns)}")
    if not columns:
        raise od_error("invalid_table_count", "no table column")
    if unknown := [c for c in o.rename_columns if c not in columns]:
        raise od_error("table_not_found", f"no table {unknown[0]!r} to rename")
    names = [o.rename_columns.get(c, c) for c in columns]
    if len(set(names)) < len(names):
        raise od_error("invalid_table_name", "two tables have one name")
    if unknown := [c for c in o.type_codes if c not in names and c not in columns]:
        raise od_error("table_not_found", f"no table {unknown[0]!r} for a type code")
    codes = [type_code(o.type_codes.get(n, o.type_codes.get(c, "D"))) for n, c in zip(names, columns)]
    return columns, table_infos(list(zip(names, codes)))


def _zone(column: Column, kind: T.DataType, whole: bool = False) -> tuple[Column, Column]:
    """A zone as a long, and whether it isn't one: whole finite numbers are, in text too (with whole, digits only); booleans are not."""
    if isinstance(kind, T.BooleanType):
        return F.lit(None).cast("long"), F.lit(True)
    if isinstance(kind, T.IntegralType):
        return column.cast("long"), column.isNull()
    if whole and isinstance(kind, T.StringType):
        number = F.when(F.btrim(column).rlike(r"^\+?[0-9]+$"), F.btrim(column)).try_cast("long")
        return number, number.isNull()
    number = column.try_cast("double")
    sound = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float(2**53))) & (number == F.floor(number))
    return F.when(sound, number).cast("long"), ~F.coalesce(sound, F.lit(False))


def _cell(column: Column, kind: T.DataType) -> tuple[Column, Column]:
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return column.cast("double"), column.isNull()
    return column.try_cast("double"), column.try_cast("double").isNull()


def ingest(df: DataFrame, options: IngestOptions = IngestOptions()) -> tuple[ODHeader, DataFrame]:
    """A matrix's header and its sparse wide relation from a table, or an error that says what is wrong.

    sort_od makes no difference, as a relation has no order. A null cell is an error.
    """
    o = options
    columns, tables = _tables(df, o)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    origin, bad_origin = _zone(quoted(o.origin_col), kinds[o.origin_col], o.whole_zones)
    destination, bad_destination = _zone(quoted(o.destination_col), kinds[o.destination_col], o.whole_zones)
    cells = [_cell(quoted(c), kinds[c]) for c in columns]
    shift = F.lit(1 - o.zone_base)
    rows = df.select(
        (origin + shift).alias("Origin"), (destination + shift).alias("Destination"),
        *[v.alias(t.column) for (v, _), t in zip(cells, tables)],
        (bad_origin | bad_destination).alias("_bad_zone"),
        F.array_position(F.array(*[b for _, b in cells]), F.lit(True)).alias("_bad_cell"),
        *([quoted(o.ordinal).alias("_ordinal")] if o.ordinal else []),
    )
    if not o.include_zero_rows:
        rows = rows.where(any_nonzero([t.column for t in tables]) | F.col("_bad_zone") | (F.col("_bad_cell") > 0))
    # One pass by pair; every check and the result come from what it leaves.
    cells_of = F.struct(*[quoted(t.column) for t in tables])
    pairs = _held(rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.col("_bad_zone").cast("long")).alias("_bad_zones"),
        F.max("_bad_cell").alias("_bad_cell"),
        (F.max_by(cells_of, "_ordinal") if o.ordinal else F.first(cells_of)).alias("_cells"),
    ))
    found = pairs.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.sum("_bad_zones").alias("bad_zones"),
        F.max("_bad_cell").alias("bad_cell"),
        F.min(F.least(*KEYS)).alias("low"),
        F.max(F.greatest(*KEYS)).alias("high"),
        F.count(F.lit(1)).alias("pairs"),
    ).first()
    if found["bad_zones"]:
        raise od_error("invalid_od", f"{found['bad_zones']} rows have a zone that isn't a whole number")
    if found["bad_cell"]:
        raise od_error("invalid_od", f"a cell of {columns[found['bad_cell'] - 1]!r} isn't a number")
    if found["rows"] and found["low"] < 1:
        raise od_error("invalid_od", f"zone {found['low'] - 1 + o.zone_base} is below {o.zone_base}")
    if not found["rows"] and o.zone_count is None:
        raise od_error("invalid_zone_count", "no rows to tell the zones from")
    zones = o.zone_count or found["high"]
    if found["rows"] and found["high"] > zones:
        if o.strict_zone_range:
            raise od_error("zone_count_mismatch", f"zone {found['high'] - 1 + o.zone_base} is beyond {zones} zones")
        zones = found["high"]
    if found["pairs"] < found["rows"]:
        if o.on_duplicate_od == "error":
            twice = pairs.where("_n > 1").select(*KEYS).orderBy(*KEYS).limit(PREVIEW + 1).collect()
            shown = ", ".join(f"({r[0] - 1 + o.zone_base}, {r[1] - 1 + o.zone_base})" for r in twice[:PREVIEW])
            raise od_error("duplicate_od", f"pairs occur more than once: {shown}{', ...' if len(twice) > PREVIEW else ''}")
    # Files hold MOST_ZONES zones, a relation as many as its rows name: a write refuses what is beyond.
    header = ODHeader(zones, tables, o.banner, o.run_id)
    replace(header, zone_count=o.zone_count or min(zones, MOST_ZONES)).checked()
    missing = zones * zones - found["pairs"]
    if missing and o.on_missing_od != "ignore":
        message = f"{missing} of {zones * zones} pairs are missing"
        if o.on_missing_od == "warn" and o.missing_warning_limit > 0:
            enough = found["pairs"] + o.missing_warning_limit  # of so many pairs, enough are missing
            some = missing_pairs(pairs, min(zones, enough), min(zones, -(-enough // zones))).limit(o.missing_warning_limit).collect()
            message += ", such as " + ", ".join(f"({r[0] - 1 + o.zone_base}, {r[1] - 1 + o.zone_base})" for r in some)
        if o.on_missing_od == "error":
            raise od_error("missing_od", message)
        warnings.warn(message + "; they are taken as 0", ODWarning, stacklevel=3)
    return header, pairs.select(*KEYS, *[F.col("_cells")[t.column].alias(t.column) for t in tables])


def _held(df: DataFrame) -> DataFrame:
    """df written to the folder for checkpoints where a session has one, so that no later step parses its source again."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None and (folder := sc.getConf().get("spark.checkpoint.dir")):
        sc.setCheckpointDir(folder)
    return df.checkpoint() if sc.getCheckpointDir() is not None else df


def last_of_each(rows: DataFrame, columns: Sequence[str], ordinal: str = "_ordinal") -> DataFrame:
    """One row a pair, the one with the largest ordinal."""
    best = rows.groupBy(*KEYS).agg(F.max_by(F.struct(*[quoted(c) for c in columns]), F.col(ordinal)).alias("_last"))
    return best.select(*KEYS, *[F.col("_last")[c].alias(c) for c in columns])


def duplicate_pairs(rows: DataFrame) -> DataFrame:
    """(Origin, Destination, count) of pairs that occur more than once."""
    return rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("count")).where("count > 1")


def missing_pairs(rows: DataFrame, zones: int, origins: int | None = None) -> DataFrame:
    """The pairs of zones that rows don't have, in order; of the first `origins` alone, if told."""
    return grid(rows.sparkSession, zones, origins).join(rows.select(*KEYS), KEYS, "left_anti").orderBy(*KEYS)


def inferred_zones(rows: DataFrame) -> DataFrame:
    """(zone_count): the largest zone on either axis."""
    return rows.agg(F.max(F.greatest(*KEYS)).alias("zone_count"))
