"""Commands on matrix files: info, validate, stats, to-csv, from-csv, to-parquet, from-parquet."""

from __future__ import annotations

import argparse
import json
import sys
import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from zonegrid.errors import ODError, ODWarning, from_text, od_error
from zonegrid.functions.cells import quoted
from zonegrid.header import DEFAULT_BANNER, DEFAULT_RUN_ID
from zonegrid.matrix import ODMatrix
from zonegrid.operators.ingest import IngestOptions
from zonegrid.sources import matfile, tabular
from zonegrid.sources.rows import RowReader

MOST_BASE = 65_535


def _base(text: str) -> int:
    """Any whole number that 16 bits hold."""
    if not text.isdigit() or int(text) > MOST_BASE:
        raise argparse.ArgumentTypeError(f"{text!r} is not from 0 to {MOST_BASE}")
    return int(text)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="zonegrid", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("info", "stats", "validate"):
        c = commands.add_parser(name)
        c.add_argument("file")
        c.add_argument("--format", choices=("text", "json"), default="text")
        c.add_argument("--quiet", action="store_true")
    for name in ("to-csv", "to-parquet", "from-csv", "from-parquet"):
        c = commands.add_parser(name)
        c.add_argument("file")
        c.add_argument("-o", "--output", required=True)
        c.add_argument("--origin-col", default="Origin")
        c.add_argument("--destination-col", default="Destination")
        c.add_argument("--zone-base", type=_base, default=1)
        c.add_argument("--table", action="append", default=[])
        if name.startswith("to"):
            c.add_argument("--include-zero-rows", action="store_true")
        else:
            c.add_argument("--zone-count", type=int)
            c.add_argument("--type-code", action="append", default=[], help="CODE for all tables, or TABLE:CODE")
            c.add_argument("--rename", action="append", default=[], help="OLD:NEW")
            c.add_argument("--allow-duplicate-od", action="store_true")
            c.add_argument("--strict", action="store_true")
            c.add_argument("--banner", default=DEFAULT_BANNER)
            c.add_argument("--run-id", default=DEFAULT_RUN_ID)
        if name.endswith("csv"):
            c.add_argument("-s", "--separator", default=",")
        else:
            c.add_argument("--compression", choices=tabular.COMPRESSIONS, default="snappy")
    return p


def _pairs(given: Sequence[str], what: str) -> dict[str, str]:
    """OLD:NEW arguments, split at the last colon."""
    out = {}
    for g in given:
        left, colon, right = g.rpartition(":")
        if not colon or not left or not right:
            raise od_error("invalid_od", f"{what} {g!r} isn't two parts with a colon between")
        out[left] = right
    return out


def _import(spark: SparkSession, a: argparse.Namespace, text: bool) -> None:
    codes = [c for c in a.type_code if ":" not in c]
    by_table = _pairs([c for c in a.type_code if ":" in c], "type code")
    renames = _pairs(a.rename, "rename")
    columns = spark.read.option("header", True).option("sep", "\t" if a.separator == "tab" else a.separator).csv(a.file).columns if text else spark.read.parquet(a.file).columns
    tables = a.table or [c for c in columns if c not in (a.origin_col, a.destination_col)]
    renames = {k: v for k, v in renames.items() if k in tables}  # unknown names are let be
    final = [renames.get(t, t) for t in tables]
    if unknown := [t for t in by_table if t not in final]:
        raise od_error("table_not_found", f"no table {unknown[0]!r} for a type code")
    options = IngestOptions(
        a.origin_col, a.destination_col, table_columns=tables, rename_columns=renames,
        type_codes={t: by_table.get(t, codes[-1] if codes else "D") for t in final}, zone_base=a.zone_base, most_base=MOST_BASE, whole_zones=True, zone_count=a.zone_count,
        on_duplicate_od="last" if a.allow_duplicate_od else "error", ordinal=None, on_missing_od="error" if a.strict else "warn", banner=a.banner, run_id=a.run_id,
    )
    m = ODMatrix.from_csv(spark, a.file, options, sep=a.separator) if text else ODMatrix.from_parquet(spark, a.file, options)
    m.write(a.output)


def _repeated(m: ODMatrix, tables: Sequence[str], wide: dict) -> tuple[DataFrame, list[str]]:
    """The wide export with tables in the order asked for, as often as asked for, and the header line's names."""
    once = list(dict.fromkeys(tables)) or list(m.table_names)
    df = m.wide(once if tables else None, **wide)
    keys, asked = df.columns[:2], list(tables) or once
    place = {t: c for t, c in zip(once, df.columns[2:])}
    columns = [quoted(place[t]).alias(f"{t}__{i}" if asked.index(t) < i else place[t]) for i, t in enumerate(asked)] if tables else [quoted(c) for c in df.columns[2:]]
    return df.select(*keys, *columns), [*keys, *(asked if tables else m.table_names)]


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    """Runs a parsed command; 0 if all is well."""
    if a.command == "info":
        h = RowReader(a.file).header
        if a.format == "json":
            print(json.dumps({"zone_count": h.zone_count, "table_count": h.table_count, "banner": h.banner, "run_id": h.run_id, "tables": [{"index": t.index, "name": t.name, "type_code": t.code} for t in h.tables]}))
        else:
            print("\n".join([f"zones {h.zone_count}", f"tables {h.table_count}", f"banner {h.banner}", f"run_id {h.run_id}", *(f"{t.index} {t.name} {t.code}" for t in h.tables)]))
    elif a.command == "stats":
        m = ODMatrix.read(spark, a.file)
        print(m.report_json() if a.format == "json" else m.report())
    elif a.command == "validate":
        r = matfile.validate(spark, a.file).first()
        if r is None or not r["ok"]:
            kind = r["kind"] if r else "unexpected_eof"
            raise od_error(kind, "the file is not sound", r["offset"] if r else 0)
        if not a.quiet:
            print(json.dumps({"zones": r["zones"], "tables": r["tables"], "rows": r["rows"]}) if a.format == "json" else f"ok: {r['zones']} zones, {r['tables']} tables, {r['rows']} rows")
    elif a.command in ("to-csv", "to-parquet"):
        m = ODMatrix.read(spark, a.file, tables=list(dict.fromkeys(a.table)) or None)
        df, names = _repeated(m, a.table, {"origin": a.origin_col, "destination": a.destination_col, "zone_base": a.zone_base, "include_zero_rows": a.include_zero_rows, "most_base": MOST_BASE})
        if a.command == "to-csv":
            tabular.to_csv(df, a.output, sep=a.separator, integral=True, one_file=True, names=names)
        else:  # a repeated table has the suffix of its place, as Parquet's columns differ
            tabular.to_parquet(df, a.output, compression=a.compression, one_file=True)
    else:
        _import(spark, a, a.command == "from-csv")
    return 0


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("zonegrid").getOrCreate()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("always", ODWarning)
            warnings.showwarning = lambda message, *_: print(f"warning: {message}", file=sys.stderr)
            return run(spark, a)
    except ODError as e:
        print(f"error: {e}", file=sys.stderr)
    except Exception as e:
        if (found := from_text(str(e))) is None:
            raise
        print(f"error: {found}", file=sys.stderr)
    return 1


if __name__ == "__main__":
    sys.exit(main())
