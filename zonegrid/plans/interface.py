"""Queries over the engine's interface: bytes, rows, frames, reports, commands, constructors, checks and streams."""

from __future__ import annotations

import contextlib
import csv
import io
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonegrid import cli
from zonegrid.capabilities import parquet_engine
from zonegrid.errors import KINDS, ODError, from_text
from zonegrid.header import ODHeader, TypeCode, table, table_infos
from zonegrid.matrix import ODMatrix, info
from zonegrid.operators.ingest import IngestOptions
from zonegrid.plans.queries import _DENSE, _GRID, _K, FULL, SPARSE, query
from zonegrid.plans.relations import NATIONS, event_steps, nation_od, scratch
from zonegrid.sources import matfile, tabular
from zonegrid.sources.rows import RowReader, RowWriter
from zonegrid.streaming.accumulate import running_pairs

_INGEST = IngestOptions(zone_count=NATIONS, on_missing_od="ignore")


def _sparse(spark: SparkSession, sf_dir: str) -> ODMatrix:
    return nation_od(spark, sf_dir, sparse=True)


def _file(spark: SparkSession, sf_dir: str, name: str = "od.mat") -> str:
    path = f"{scratch(spark)}/{name}"
    _sparse(spark, sf_dir).write(path, partitions=2)
    return path


def _exact(df: DataFrame) -> DataFrame:
    """Revenues rounded to the cent, as sums have no fixed order."""
    return df.withColumn("REV", F.round("REV", 2)) if "REV" in df.columns else df


# Bytes and rows


@query(f"{SPARSE} SELECT * FROM od")
def od_from_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ODMatrix.from_bytes(spark, _sparse(spark, sf_dir).to_bytes()).frame


@query(f"""{SPARSE} SELECT {_K}, "TRIPS", "REV" FROM od""")
def od_from_bytes_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ODMatrix.from_bytes(spark, _sparse(spark, sf_dir).to_bytes(), ["REV", "TRIPS"]).frame


_ROWS = f"""{SPARSE}, {_DENSE}, cells AS (SELECT "Origin" AS o, 1 AS t, SUM("TRIPS") AS s FROM dense GROUP BY 1 UNION ALL SELECT "Origin", 2, SUM("QTY") FROM dense GROUP BY 1 UNION ALL SELECT "Origin", 3, SUM("REV") FROM dense GROUP BY 1)
SELECT CAST(o AS INTEGER) AS row_index, CAST(t AS INTEGER) AS table_index, s = 0 AS is_zero_row, round(s + 0.00001, 2) AS total FROM cells"""
_ROW_SCHEMA = "row_index int, table_index int, is_zero_row boolean, total double"


def _told(rows) -> list[tuple]:
    """Rows with their sums, moved off the ties that sums of four decimals have."""
    return [(r.row_index, r.table_index, r.is_zero_row, round(float(r.values.sum()) + 0.00001, 2)) for r in rows]


@query(_ROWS)
def od_rows_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = RowReader(_file(spark, sf_dir))
    return spark.createDataFrame(_told(iter(reader.read_row, None)), _ROW_SCHEMA)


@query(f"{_ROWS} WHERE t = 2")
def od_rows_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = RowReader(_sparse(spark, sf_dir).to_bytes())
    return spark.createDataFrame(_told(iter(lambda: reader.read_table_row("QTY"), None)), _ROW_SCHEMA)


@query(f"{_ROWS} WHERE t <> 2")
def od_rows_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = RowReader(_sparse(spark, sf_dir).to_bytes())
    chosen = reader.prepare_selection(["REV", 1, "REV"])
    return spark.createDataFrame(_told(iter(lambda: reader.read_selected_row(chosen), None)), _ROW_SCHEMA)


@query(f"SELECT CAST(5 AS BIGINT) AS before, CAST({3 * NATIONS} AS BIGINT) AS rows_read, TRUE AS at_end, CAST(0 AS BIGINT) AS left_over, TRUE AS same_row")
def od_rows_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _sparse(spark, sf_dir).to_bytes()
    reader = RowReader(data)
    first = [reader.read_row() for _ in range(5)]
    before = reader.rows_read
    reader.reset()
    again = list(reader.rows())
    at_end = reader.position == len(data)
    return spark.createDataFrame([(before, reader.rows_read, at_end, len(reader.into_inner().read()), first == again[:5])], "before long, rows_read long, at_end boolean, left_over long, same_row boolean")


@query(f"{SPARSE} SELECT * FROM od")
def od_rows_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _sparse(spark, sf_dir)
    stack = m.stack()
    path = f"{scratch(spark)}/rows.mat"
    writer = RowWriter(path, m.header)
    for t in range(3):
        writer.write_next_row(stack[t, 0])
    writer.write_origin(stack[:, 1])
    writer.write_origins(stack[:, 2:5].transpose(1, 0, 2), 3)
    writer.flush()
    writer.write_stack(stack)
    writer.finish().close()
    return ODMatrix.read(spark, path).frame


@query(f"SELECT CAST({NATIONS} AS INTEGER) AS zone_count, CAST(1 AS INTEGER) AS table_count, 'own banner' AS banner, 'R7' AS run_id, CAST(1 AS INTEGER) AS table_index, 'A' AS \"table\", 'S' AS type_code")
def od_banner(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/banner.mat"
    ODMatrix.create(spark, NATIONS, [table("A", "s")], "own banner", "R7").write(path)
    return info(spark, path)


@query(f"SELECT CAST(i AS INTEGER) AS table_index, n AS \"table\", c AS type_code, CAST({NATIONS} AS INTEGER) AS zone_count FROM (VALUES (1, 'TRIPS', '0'), (2, 'QTY', '2'), (3, 'REV', 'D')) v(i, n, c)")
def od_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return info(spark, _file(spark, sf_dir)).select("table_index", "table", "type_code", "zone_count")


# Frames and files


@query(f"{SPARSE} SELECT * FROM od")
def od_pandas_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ODMatrix.from_pandas(spark, _sparse(spark, sf_dir).to_pandas(), _INGEST).frame


_LONG = f"""{SPARSE} SELECT CAST(0 AS INTEGER) AS table_index, 'TRIPS' AS "table", CAST("Origin" AS INTEGER) AS origin, CAST("Destination" AS INTEGER) AS destination, "TRIPS" AS value FROM od
UNION ALL SELECT 1, 'QTY', CAST("Origin" AS INTEGER), CAST("Destination" AS INTEGER), "QTY" FROM od"""
_LONG_SCHEMA = "table_index int, `table` string, origin int, destination int, value double"


@query(_LONG)
def od_long_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_sparse(spark, sf_dir).to_long_pandas(tables=["TRIPS", "QTY"], zero_policy="exclude"), _LONG_SCHEMA)


@query(_LONG)
def od_long_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/long.csv"
    _sparse(spark, sf_dir).to_csv_long(path, one_file=True, tables=["TRIPS", "QTY"], zero_policy="exclude")
    return spark.read.csv(path, header=True, schema=_LONG_SCHEMA)


@query(_LONG)
def od_long_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/long.parquet"
    _sparse(spark, sf_dir).to_parquet_long(path, tables=["TRIPS", "QTY"], zero_policy="exclude")
    return spark.read.parquet(path)


@query(f"""{SPARSE} SELECT row_number() OVER (ORDER BY "Origin", "Destination") AS line, {_K}, "TRIPS" FROM od""")
def od_csv_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of one file, in the order that they stand in."""
    path = f"{scratch(spark)}/order.csv"
    _sparse(spark, sf_dir).to_csv(path, ["TRIPS"], one_file=True)
    with open(path, encoding="utf-8") as f:
        rows = list(csv.reader(f))
    return spark.createDataFrame([(i, int(o), int(d), float(v)) for i, (o, d, v) in enumerate(rows[1:], 1)], "line long, Origin long, Destination long, TRIPS double")


@query(f"""WITH long AS ({_LONG}) SELECT row_number() OVER (ORDER BY table_index, origin, destination) AS line, * FROM long""")
def od_long_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _sparse(spark, sf_dir).long(["TRIPS", "QTY"], zero_policy="exclude").collect()
    return spark.createDataFrame([(i, *r) for i, r in enumerate(got, 1)], "line long, " + _LONG_SCHEMA)


@query(f"""{SPARSE} SELECT {_K}, "QTY" FROM od""")
def od_parquet_one_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/one.parquet"
    _sparse(spark, sf_dir).to_parquet(path, ["QTY"], one_file=True, parquet_engine="spark")
    return ODMatrix.from_parquet(spark, path, _INGEST).frame


@query(f"""{SPARSE} SELECT {_K}, "QTY" AS flow FROM od""")
def od_rename_on_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _sparse(spark, sf_dir).frame
    return ODMatrix.from_dataframe(df, IngestOptions(table_columns=["QTY"], rename_columns={"QTY": "flow"}, zone_count=NATIONS, on_missing_od="ignore")).frame


@query(f"""{FULL} SELECT {_K}, CASE WHEN "TRIPS" % 2 = 0 THEN "TRIPS" ELSE 0.0 END AS "TRIPS" FROM od WHERE "TRIPS" % 2 = 0""")
def od_zero_rows_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = nation_od(spark, sf_dir).frame.select("Origin", "Destination", F.when(F.col("TRIPS") % 2 == 0, F.col("TRIPS")).otherwise(0.0).alias("TRIPS"))
    return ODMatrix.from_dataframe(df, IngestOptions(zone_count=NATIONS, include_zero_rows=False, sort_od=True, on_missing_od="ignore")).frame


@query(f"""{SPARSE}, n AS (SELECT {_K}, "TRIPS", row_number() OVER (ORDER BY "Origin", "Destination") AS line FROM od) SELECT {_K}, "TRIPS" + 1000 AS "TRIPS" FROM n""")
def od_last_wins_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files that repeat every pair: the last by file name and row wins, whatever their sizes."""
    folder, cells = scratch(spark), _sparse(spark, sf_dir).frame.select("Origin", "Destination", "TRIPS").orderBy("Origin", "Destination").toPandas()
    for name, more, copies in (("a", 0, 1), ("b", 500, 20), ("c", 1000, 3)):
        rows = cells.assign(TRIPS=cells.TRIPS + more)
        first = [rows.assign(TRIPS=-1.0 - i) for i in range(copies)]  # superseded by the rows behind them in the same file
        import pandas as pd

        pd.concat([*first, rows]).to_parquet(f"{folder}/{name}.parquet", index=False)
    with contextlib.redirect_stderr(io.StringIO()):
        assert cli.main(["from-parquet", folder, "-o", f"{folder}/out.mat", "--allow-duplicate-od", "--zone-count", str(NATIONS)], spark) == 0
    return ODMatrix.read(spark, f"{folder}/out.mat").frame


# Commands


@query(f"""{SPARSE} SELECT CAST("Origin" + 99 AS VARCHAR) AS o, CAST("Destination" + 99 AS VARCHAR) AS d, CAST(CAST("QTY" AS BIGINT) AS VARCHAR) AS first, CAST(CAST("TRIPS" AS BIGINT) AS VARCHAR) AS second, CAST(CAST("QTY" AS BIGINT) AS VARCHAR) AS again FROM od""")
def od_cli_to_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark, sf_dir)
    assert cli.main(["to-csv", path, "-o", f"{path}.csv", "--table", "QTY", "--table", "TRIPS", "--table", "QTY", "--zone-base", "100", "--origin-col", "o", "--destination-col", "d"], spark) == 0
    with open(f"{path}.csv", encoding="utf-8") as f:
        head, *rows = csv.reader(f)
    assert head == ["o", "d", "QTY", "TRIPS", "QTY"]
    return spark.createDataFrame(rows, "o string, d string, first string, second string, again string")


@query(f"""{SPARSE} SELECT {_K}, "TRIPS" AS trips, "QTY" FROM od""")
def od_cli_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark, sf_dir)
    with contextlib.redirect_stderr(io.StringIO()):
        assert cli.main(["to-csv", path, "-o", f"{path}.csv", "-s", "tab", "--zone-base", "0"], spark) == 0
        assert cli.main(["from-csv", f"{path}.csv", "-o", f"{path}.again", "-s", "tab", "--zone-base", "0", "--zone-count", str(NATIONS), "--table", "TRIPS", "--table", "QTY", "--rename", "TRIPS:trips", "--type-code", "2"], spark) == 0
    return ODMatrix.read(spark, f"{path}.again").frame


@query(f"""{SPARSE} SELECT {_K}, "TRIPS" FROM od""")
def od_cli_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark, sf_dir)
    with contextlib.redirect_stderr(io.StringIO()):
        assert cli.main(["to-parquet", path, "-o", f"{path}.parquet", "--table", "TRIPS", "--compression", "zstd"], spark) == 0
        assert cli.main(["from-parquet", f"{path}.parquet", "-o", f"{path}.again", "--zone-count", str(NATIONS), "--type-code", "TRIPS:0"], spark) == 0
    return ODMatrix.read(spark, f"{path}.again").frame


@query(f"""SELECT 'rows' AS "key", '{3 * NATIONS}' AS value UNION ALL SELECT 'tables', '3' UNION ALL SELECT 'zones', '{NATIONS}'""")
def od_cli_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        assert cli.main(["validate", _file(spark, sf_dir), "--format", "json"], spark) == 0
    return spark.createDataFrame([(k, str(v)) for k, v in json.loads(said.getvalue()).items()], "key string, value string")


_TOTALS = f"""{SPARSE} SELECT CAST(1 AS INTEGER) AS "index", 'TRIPS' AS name, '0' AS type_code, SUM("TRIPS") AS total, SUM(CASE WHEN "Origin" = "Destination" THEN "TRIPS" ELSE 0 END) AS diagonal FROM od
UNION ALL SELECT 2, 'QTY', '2', SUM("QTY"), SUM(CASE WHEN "Origin" = "Destination" THEN "QTY" ELSE 0 END) FROM od
UNION ALL SELECT 3, 'REV', 'D', round(SUM("REV"), 2), round(SUM(CASE WHEN "Origin" = "Destination" THEN "REV" ELSE 0 END), 2) FROM od"""


@query(_TOTALS)
def od_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = json.loads(_sparse(spark, sf_dir).report_json())["tables"]
    return spark.createDataFrame([(t["index"], t["name"], t["type_code"], round(t["total"], 2), round(t["diagonal"], 2)) for t in tables], "index int, name string, type_code string, total double, diagonal double")


@query(f"""WITH t AS ({_TOTALS}) SELECT CAST("index" + 4 AS BIGINT) AS line, concat("index", ' ', name, ' ', type_code, ' total=', printf('%.2f', total), ' diagonal=', printf('%.2f', diagonal)) AS said FROM t
UNION ALL SELECT 1, 'zones {NATIONS}' UNION ALL SELECT 2, 'tables 3'""")
def od_report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals have six decimals; the last four, which depend on the order of the sums, are cut off here."""
    lines = [(i, line) for i, line in enumerate(_sparse(spark, sf_dir).report().split("\n"), 1) if i not in (3, 4)]
    df = spark.createDataFrame(lines, "line long, said string")
    return df.withColumn("said", F.when(F.col("line") > 4, F.concat(F.regexp_extract("said", r"^(\d \w+ \w total=)", 1), F.format_string("%.2f", F.regexp_extract("said", r"total=(\S+)", 1).cast("double")), F.lit(" diagonal="), F.format_string("%.2f", F.regexp_extract("said", r"diagonal=(\S+)", 1).cast("double")))).otherwise(F.col("said")))


# Updates of pairs that are not there


@query(f"""{SPARSE}, {_DENSE} SELECT {_K}, "TRIPS" + 1.0 AS "TRIPS" FROM dense""")
def od_shift_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse(spark, sf_dir).select("TRIPS").transform({"TRIPS": lambda c: c + 1.0}).frame


@query(f"""{SPARSE}, {_DENSE} SELECT {_K}, CASE WHEN "TRIPS" < 3 AND "Origin" <= 10 THEN 7.5 ELSE "TRIPS" END AS "TRIPS", "QTY" FROM dense WHERE "TRIPS" <> 0 OR ("Origin" <= 10)""")
def od_mask_zero_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse(spark, sf_dir).select(["TRIPS", "QTY"]).mask("TRIPS", (F.col("TRIPS") < 3) & (F.col("Origin") <= 10), F.lit(7.5)).frame


@query(f"""{SPARSE}, {_DENSE} SELECT {_K}, CASE WHEN "Origin" IN (2, 4, 6) AND "Destination" IN (1, 2, 3, 4) THEN "TRIPS" * 2 + 1 ELSE "TRIPS" END AS "TRIPS" FROM dense WHERE "TRIPS" <> 0 OR ("Origin" IN (2, 4, 6) AND "Destination" IN (1, 2, 3, 4))""")
def od_submatrix_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse(spark, sf_dir).select("TRIPS").submatrix("TRIPS", [2, 4, 6], [1, 2, 3, 4], lambda c: c * 2 + 1).frame


@query(f"""{SPARSE} SELECT {_K}, "QTY" AS "TRIPS", "TRIPS" AS "QTY" FROM od""")
def od_set_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _sparse(spark, sf_dir).select(["TRIPS", "QTY"])
    return m.set_stack(m.stack(["QTY", "TRIPS"])).frame


# Constructors and what a matrix is


@query(f"WITH {_GRID} SELECT {_K}, 0.0 AS \"A\", 0.0 AS \"B\" FROM grid")
def od_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ODMatrix.create(spark, NATIONS, ["A", ("B", 2)]).wide(include_zero_rows=True)


@query(f"""SELECT i AS "table", CAST(0 AS DOUBLE) AS total FROM (VALUES ('TRIPS'), ('QTY'), ('REV')) v(i)""")
def od_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_od(spark, sf_dir).like().stats().select("table", "total")


@query(f"{FULL} SELECT * FROM od")
def od_copy_and_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ODMatrix.from_parts(*nation_od(spark, sf_dir).copy().into_parts()).frame


@query(f"""{SPARSE} SELECT {_K}, "QTY" * 2 AS "QTY" FROM od""")
def od_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ODMatrix.from_arrays(spark, {"QTY": _sparse(spark, sf_dir).array("QTY") * 2}, {"QTY": 2}).frame


@query("""SELECT * FROM (VALUES ('TRIPS', TRUE), ('trips', FALSE), ('REV', TRUE), ('', FALSE)) v(name, held)""")
def od_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = nation_od(spark, sf_dir)
    assert len(m) == 3 and m.keys() == ["TRIPS", "QTY", "REV"] and [k for k, _ in m.items()] == m.keys()
    return spark.createDataFrame([(n, n in m) for n in ("TRIPS", "trips", "REV", "")], "name string, held boolean")


@query("""SELECT * FROM (VALUES ('0', '0'), ('9', '9'), ('s', 'S'), ('d', 'D'), ('3', '3'), ('7', '7'), ('True', 'invalid_type_code'), ('10', 'invalid_type_code'), ('x', 'invalid_type_code')) v(given, code)""")
def od_type_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def told(code: object) -> str:
        try:
            return table("A", code).code
        except ODError as e:
            return e.kind

    given = [0, "9", "s", TypeCode.float64.lower(), TypeCode.fixed(3), TypeCode.parse(7), True, "10", "x"]
    return spark.createDataFrame([(str(g), told(g)) for g in given], "given string, code string")


def _kind(call) -> str:
    try:
        call()
    except Exception as e:
        found = e if isinstance(e, ODError) else from_text(str(e))
        return found.kind if found is not None else type(e).__name__
    return "ok"


@query("""SELECT * FROM (VALUES ('fine', 'ok'), ('no zones', 'invalid_zone_count'), ('too many zones', 'invalid_zone_count'), ('no tables', 'invalid_table_count'), ('blank', 'invalid_table_name'), ('twice', 'invalid_table_name'), ('engine', 'invalid_od')) v(what, kind)""")
def od_schema_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {
        "fine": lambda: ODMatrix.validate_schema(3, ["A", ("B", 9)]), "no zones": lambda: ODMatrix.validate_schema(0, ["A"]), "too many zones": lambda: ODMatrix.validate_schema(32_001, ["A"]),
        "no tables": lambda: ODMatrix.validate_schema(3, []), "blank": lambda: ODMatrix.validate_schema(3, [" "]), "twice": lambda: ODMatrix.validate_schema(3, ["A", "A"]), "engine": lambda: parquet_engine("other"),
    }
    return spark.createDataFrame([(k, _kind(f)) for k, f in checks.items()], "what string, kind string")


def _damaged() -> dict[str, bytes]:
    """Files of two zones and one table, each with one fault."""
    header = ODHeader(2, table_infos([("A", "2")]))
    writer = RowWriter(io.BytesIO(), header)
    writer.write_stack(np.array([[[1.0, 2.0], [3.0, 4.0]]]))
    good = writer.finish().getvalue()
    at = len(header.to_bytes())
    size = 3 + int.from_bytes(good[at + 3 : at + 5], "little")
    put = lambda place, data: good[:place] + data + good[place + len(data) :]
    return {
        "sound": good, "cut short": good[:-1], "cut in the header": good[:20], "more behind": good + b"x", "record too short": put(0, (3).to_bytes(4, "little")),
        "no zones": good.replace(b"Zones=2", b"Zones=0"), "other table count": good.replace(b"MVR 1", b"MVR 2"), "unknown code": good.replace(b"A=2", b"A=Q"), "no marker": good.replace(b"ROW\0", b"RAW\0"),
        "zone out of range": put(at, b"\x09\x00"), "rows swapped": good[:at] + good[at + size :] + good[at : at + size], "table out of range": put(at + 2, b"\x07"),
        "payload size 1": put(at + 3, b"\x01\x00"), "preamble": put(at + 5, b"\x00\x00"), "descriptor": put(at + 7, b"\x07"), "empty run": put(at + 8, b"\x00\x00"),
    }


@query("""SELECT * FROM (VALUES ('sound', NULL), ('cut short', 'unexpected_eof'), ('cut in the header', 'unexpected_eof'), ('more behind', 'trailing_bytes'), ('record too short', 'invalid_header_length'), ('no zones', 'invalid_par'),
('other table count', 'table_count_mismatch'), ('unknown code', 'invalid_type_code'), ('no marker', 'missing_row_marker'), ('zone out of range', 'invalid_row_index'), ('rows swapped', 'row_order_violation'), ('table out of range', 'table_index_out_of_range'),
('payload size 1', 'invalid_chunk_size'), ('preamble', 'invalid_preamble'), ('descriptor', 'invalid_descriptor'), ('empty run', 'zero_run_count')) v(what, kind)""")
def od_damaged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    names = {}
    for i, (what, data) in enumerate(_damaged().items()):
        names[f"{i:02}.mat"] = what
        with open(f"{folder}/{i:02}.mat", "wb") as f:
            f.write(data)
    told = matfile.validate(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "kind")
    return told.join(spark.createDataFrame(list(names.items()), "file string, what string"), "file").select("what", "kind")


_FAULTS = {
    "get": "invalid_row_index", "table": "table_not_found", "place": "table_index_out_of_range", "twice": "invalid_table_name", "none": "invalid_table_count", "array": "shape_mismatch", "stack": "shape_mismatch",
    "zones": "zone_count_mismatch", "missing": "missing_od", "duplicate": "duplicate_od", "cell": "invalid_od", "finish": "incomplete_matrix", "inside": "writer_position_mismatch", "over": "writer_finished", "file": "io",
}


@query(f"SELECT * FROM (VALUES {', '.join(f'({chr(39)}{a}{chr(39)}, {chr(39)}{b}{chr(39)})' for a, b in _FAULTS.items())}) v(what, kind)")
def od_error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = nation_od(spark, sf_dir)
    rows = lambda *r: spark.createDataFrame(list(r), "Origin string, Destination string, V string")
    header = ODHeader(2, table_infos(["A", "B"]))

    def writer(n: int) -> RowWriter:
        w = RowWriter(io.BytesIO(), header)
        for _ in range(n):
            w.write_next_row([1.0, 2.0])
        return w

    calls = {
        "get": lambda: m.get("TRIPS", 0, 1), "table": lambda: m.table("TRIP"), "place": lambda: m.table(3), "twice": lambda: m.select(["QTY", 1]), "none": lambda: m.select([]),
        "array": lambda: m.replace_table("QTY", np.zeros((2, 2))), "stack": lambda: m.set_stack(np.zeros((1, 2, 2))), "zones": lambda: ODMatrix.from_dataframe(rows(("1", "3", "5")), IngestOptions(zone_count=2)),
        "missing": lambda: ODMatrix.from_dataframe(rows(("1", "2", "5")), IngestOptions(on_missing_od="error")), "duplicate": lambda: ODMatrix.from_dataframe(rows(("1", "1", "5"), ("1", "1", "6"))),
        "cell": lambda: ODMatrix.from_dataframe(rows(("1", "1", "five"))), "finish": lambda: writer(3).finish(), "inside": lambda: writer(1).write_origin(np.zeros((2, 2))), "over": lambda: writer(4).write_next_row([0.0, 0.0]),
        "file": lambda: ODMatrix.read(spark, "/no/such/file.mat"),
    }
    found = [(k, _kind(f)) for k, f in calls.items()]
    assert {k for _, k in found} <= {k for kinds in KINDS.values() for k in kinds}
    return spark.createDataFrame(found, "what string, kind string")


@query("SELECT * FROM (VALUES ('TRIP', 'TRIPS'), ('qty', 'QTY'), ('REVENUE', 'REV')) v(asked, likest)")
def od_likest_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that the error for an unknown name puts first."""
    m, out = nation_od(spark, sf_dir), []
    for asked in ("TRIP", "qty", "REVENUE"):
        try:
            m.table(asked)
        except ODError as e:
            out.append((asked, e.message.rpartition("are ")[2].split(", ")[0]))
    return spark.createDataFrame(out, "asked string, likest string")


# SQL


@query(f"""{SPARSE} SELECT 'stored' AS what, COUNT(*) AS n FROM od UNION ALL SELECT 'all', {NATIONS * NATIONS}""")
def od_count_read_mat(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark, sf_dir)
    matfile.register(spark)
    return spark.sql(f"SELECT 'stored' AS what, COUNT(*) AS n FROM read_mat('{path}') UNION ALL SELECT 'all', COUNT(*) FROM read_mat('{path}', include_zeros => true)")


@query(f"""{SPARSE} SELECT "Origin", SUM("QTY") AS qty FROM od WHERE "Origin" > 20 GROUP BY 1""")
def od_pruned_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view of one of a file's tables: the others are not decoded."""
    matfile.register(spark)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY VIEW od_pruned (Origin BIGINT, Destination BIGINT, QTY DOUBLE) USING odmat OPTIONS (path '{_file(spark, sf_dir)}')""")
    return spark.sql("SELECT Origin, SUM(QTY) AS qty FROM od_pruned WHERE Origin > 20 GROUP BY Origin")


@query(f"""{FULL} SELECT "Origin", "Destination", SUM("TRIPS") AS "TRIPS" FROM od WHERE "Origin" <= 5 AND "Destination" <= 5 GROUP BY ROLLUP ("Origin", "Destination")""")
def od_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_od(spark, sf_dir).frame.where("Origin <= 5 AND Destination <= 5").rollup("Origin", "Destination").agg(F.sum("TRIPS").alias("TRIPS"))


@query(f"""{FULL} SELECT "Origin", "Destination", SUM("QTY") AS "QTY" FROM od GROUP BY GROUPING SETS (("Origin"), ("Destination"), ())""")
def od_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation_od(spark, sf_dir).view("od_sets")
    return spark.sql("SELECT Origin, Destination, SUM(QTY) AS QTY FROM od_sets GROUP BY GROUPING SETS ((Origin), (Destination), ())")


@query(f"""{FULL} SELECT DISTINCT "Origin" % 5 AS class FROM od""")
def od_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_od(spark, sf_dir).frame.select((F.col("Origin") % 5).alias("class")).distinct()


# Streams


@query("""WITH types AS (SELECT event_type, CAST(dense_rank() OVER (ORDER BY event_type) AS BIGINT) AS zone FROM (SELECT DISTINCT event_type FROM events)),
steps AS (SELECT value, zone AS "Origin", lead(zone) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS "Destination" FROM events JOIN types USING (event_type))
SELECT "Origin", "Destination", CAST(COUNT(*) AS DOUBLE) AS "TRIPS", round(SUM(value), 4) AS "VALUE" FROM steps WHERE "Destination" IS NOT NULL GROUP BY 1, 2""")
def od_stream_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs counted by a stream over files of steps, several to a batch; the last batch's table is returned."""
    folder = scratch(spark)
    steps = event_steps(spark, sf_dir).repartition(6)
    steps.write.parquet(f"{folder}/steps")
    stream = spark.readStream.schema(steps.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/steps")
    out = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out")
    running_pairs(stream, value="value").writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").foreachBatch(out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").withColumn("VALUE", F.round("VALUE", 4))
