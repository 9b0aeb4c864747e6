"""The engine's queries over the business tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonegrid.functions.cells import plain_text, quantised
from zonegrid.header import CODES, ODHeader, table_infos
from zonegrid.matrix import ODMatrix
from zonegrid.operators import aggregates, ingest as checks, reshape
from zonegrid.operators.ingest import IngestOptions
from zonegrid.plans.relations import HOLES, NATION_TABLES, NATIONS, event_od, event_steps, nation_od, scratch, supplier_od, table, trips
from zonegrid.sources import matfile, tabular
from zonegrid.streaming.accumulate import windowed_pairs

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

_TRIPS = """trips AS (
  SELECT CAST(c_nationkey + 1 AS BIGINT) AS "Origin", CAST(s_nationkey + 1 AS BIGINT) AS "Destination", l_quantity AS qty,
         CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS rev, l_quantity, l_returnflag, l_orderkey, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
_CELLS = """SELECT "Origin", "Destination", CAST(COUNT(*) AS DOUBLE) AS "TRIPS", CAST(SUM(qty) AS DOUBLE) AS "QTY", CAST(SUM(rev) AS DOUBLE) AS "REV" FROM trips"""
FULL = f"""WITH {_TRIPS}, od AS ({_CELLS} GROUP BY 1, 2)"""
SPARSE = f"""WITH {_TRIPS}, every AS ({_CELLS} GROUP BY 1, 2), od AS (SELECT * FROM every WHERE {HOLES})"""
_GRID = f"""grid AS (SELECT CAST(o AS BIGINT) AS "Origin", CAST(d AS BIGINT) AS "Destination" FROM range(1, {NATIONS + 1}) a(o), range(1, {NATIONS + 1}) b(d))"""
_DENSE = f"""{_GRID}, dense AS (SELECT g."Origin", g."Destination", coalesce("TRIPS", 0.0) AS "TRIPS", coalesce("QTY", 0.0) AS "QTY", coalesce("REV", 0.0) AS "REV"
  FROM grid g LEFT JOIN od ON g."Origin" = od."Origin" AND g."Destination" = od."Destination")"""
_K = '"Origin", "Destination"'


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        _queries[key] = f
        if sql is not None:
            _sql[key] = sql
        return f

    return add


# Aggregates


@query(f"""{FULL} SELECT CAST(1 AS INTEGER) AS table_index, 'TRIPS' AS "table", '0' AS type_code, SUM("TRIPS") AS total, SUM(CASE WHEN "Origin" = "Destination" THEN "TRIPS" ELSE 0 END) AS diagonal FROM od
UNION ALL SELECT 2, 'QTY', '2', SUM("QTY"), SUM(CASE WHEN "Origin" = "Destination" THEN "QTY" ELSE 0 END) FROM od
UNION ALL SELECT 3, 'REV', 'D', round(SUM("REV"), 2), round(SUM(CASE WHEN "Origin" = "Destination" THEN "REV" ELSE 0 END), 2) FROM od""")
def od_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = nation_od(spark, sf_dir).stats()
    exact = lambda c: F.when(F.col("table") == "REV", F.round(c, 2)).otherwise(F.col(c)).alias(c)
    return got.select("table_index", "table", "type_code", exact("total"), exact("diagonal"))


@query(f"""{FULL} SELECT SUM("QTY") AS total FROM od""")
def od_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.total(nation_od(spark, sf_dir).frame, NATION_TABLES[1])


@query(f"""{FULL} SELECT SUM("QTY") AS diagonal FROM od WHERE "Origin" = "Destination\"""")
def od_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.diagonal_total(nation_od(spark, sf_dir).frame, NATION_TABLES[1])


@query(f"""{SPARSE} SELECT CAST(z AS BIGINT) AS "Origin", coalesce(SUM("TRIPS"), 0.0) AS "TRIPS", coalesce(SUM("QTY"), 0.0) AS "QTY" FROM range(1, {NATIONS + 1}) r(z) LEFT JOIN od ON z = "Origin" GROUP BY 1""")
def od_origin_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_od(spark, sf_dir, sparse=True).select(["TRIPS", "QTY"]).origin_totals()


@query(f"""{SPARSE} SELECT "Destination", SUM("TRIPS") AS "TRIPS", SUM("QTY") AS "QTY" FROM od GROUP BY 1""")
def od_destination_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_od(spark, sf_dir, sparse=True).select(["TRIPS", "QTY"]).destination_totals(dense=False)


@query(f"""{SPARSE} SELECT CAST(z AS BIGINT) AS "Zone", coalesce("TRIPS", 0.0) AS "TRIPS" FROM range(1, {NATIONS + 1}) r(z) LEFT JOIN od ON z = "Origin" AND z = "Destination\"""")
def od_diagonal_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_od(spark, sf_dir, sparse=True).select("TRIPS").diagonal()


@query("""SELECT COUNT(*) AS pairs, SUM("PAIRS") AS total, SUM(CASE WHEN "Origin" = "Destination" THEN "PAIRS" ELSE 0 END) AS diagonal
FROM (SELECT a.l_suppkey + 1 AS "Origin", b.l_suppkey + 1 AS "Destination", CAST(COUNT(*) AS DOUBLE) AS "PAIRS" FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey GROUP BY 1, 2)""")
def od_supplier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = supplier_od(spark, sf_dir)
    return m.frame.agg(F.count(F.lit(1)).alias("pairs"), F.sum("PAIRS").alias("total"), F.sum(F.when(F.col("Origin") == F.col("Destination"), F.col("PAIRS")).otherwise(0.0)).alias("diagonal"))


# Shapes


@query(f"{SPARSE} SELECT * FROM od")
def od_wide_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_od(spark, sf_dir, sparse=True).wide()


@query(f"{SPARSE}, {_DENSE} SELECT * FROM dense")
def od_wide_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_od(spark, sf_dir, sparse=True).wide(include_zero_rows=True)


@query(f"""{SPARSE} SELECT "Origin" - 1 AS "Origin", "Destination" - 1 AS "Destination", "TRIPS", "QTY", "REV" FROM od""")
def od_wide_zone_base0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_od(spark, sf_dir, sparse=True).wide(zone_base=0)


@query(f"""{SPARSE} SELECT "Origin" AS i, "Destination" AS j, "TRIPS" AS flow, "QTY", "REV" FROM od""")
def od_wide_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_od(spark, sf_dir, sparse=True).wide(rename={"TRIPS": "flow"}, origin="i", destination="j")


@query(f"""{FULL} SELECT {_K}, "REV", "TRIPS" FROM od""")
def od_select_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_od(spark, sf_dir).wide(["REV", 0])


@query(f"""{FULL} SELECT {_K}, CASE WHEN "TRIPS" > 10 THEN "TRIPS" ELSE 0.0 END AS "TRIPS" FROM od WHERE "TRIPS" > 10""")
def od_zero_filter_by_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = nation_od(spark, sf_dir).mask("TRIPS", F.col("TRIPS") <= 10, F.lit(0.0))
    return m.wide(["TRIPS"])


@query(f"""{SPARSE} SELECT CAST(0 AS INTEGER) AS table_index, 'TRIPS' AS "table", CAST("Origin" AS INTEGER) AS origin, CAST("Destination" AS INTEGER) AS destination, "TRIPS" AS value FROM od
UNION ALL SELECT 1, 'QTY', CAST("Origin" AS INTEGER), CAST("Destination" AS INTEGER), "QTY" FROM od UNION ALL SELECT 2, 'REV', CAST("Origin" AS INTEGER), CAST("Destination" AS INTEGER), "REV" FROM od""")
def od_long_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_od(spark, sf_dir, sparse=True).long(zero_policy="exclude")


@query(f"""{SPARSE}, {_DENSE} SELECT CAST(1 AS INTEGER) AS table_index, 'QTY' AS "table", CAST("Origin" AS INTEGER) AS origin, CAST("Destination" AS INTEGER) AS destination, "QTY" AS value FROM dense
UNION ALL SELECT 0, 'TRIPS', CAST("Origin" AS INTEGER), CAST("Destination" AS INTEGER), "TRIPS" FROM dense""")
def od_long_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_od(spark, sf_dir, sparse=True).long(["QTY", "TRIPS"])


@query(f"""{SPARSE}, {_DENSE} SELECT {_K}, "QTY" AS value FROM dense WHERE "Origin" IN (1, 7) AND "Destination" = 3""")
def od_cell_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = nation_od(spark, sf_dir, sparse=True).select("QTY")
    return m.dense().where(F.col("Origin").isin(1, 7) & (F.col("Destination") == 3)).select("Origin", "Destination", F.col("QTY").alias("value"))


@query(f"""{SPARSE}, {_DENSE} SELECT "Origin", list("TRIPS" ORDER BY "Destination") AS cells FROM dense WHERE "Origin" = 4 GROUP BY 1""")
def od_row_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_od(spark, sf_dir, sparse=True).row("TRIPS", 4)


@query(f"""{FULL} SELECT * FROM od WHERE "Origin" IN (3, 9, 12)""")
def od_origin_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_od(spark, sf_dir).frame.where(F.col("Origin").isin(3, 9, 12))


@query(f"""{FULL} SELECT CAST(k."Origin" AS BIGINT) AS "Origin", CAST(l."Destination" AS BIGINT) AS "Destination", "TRIPS", "QTY" FROM od
JOIN (VALUES (2, 1), (5, 2), (9, 3)) k(old, "Origin") ON od."Origin" = k.old JOIN (VALUES (2, 1), (5, 2), (9, 3)) l(old, "Destination") ON od."Destination" = l.old""")
def od_reindex_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_od(spark, sf_dir).select(["TRIPS", "QTY"]).reindex_zones([2, 5, 9]).frame


@query(f"""{SPARSE} SELECT {NATIONS + 1} - "Origin" AS "Origin", {NATIONS + 1} - "Destination" AS "Destination", "TRIPS" FROM od""")
def od_reindex_permute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_od(spark, sf_dir, sparse=True).select("TRIPS").reindex_zones(list(range(NATIONS - 1, -1, -1)), basis="index").frame


@query(f"""{FULL}, other AS (SELECT {_K}, "TRIPS" AS "RETURNED" FROM od WHERE {HOLES})
SELECT coalesce(od."Origin", other."Origin") AS "Origin", coalesce(od."Destination", other."Destination") AS "Destination", coalesce("TRIPS", 0.0) AS "TRIPS", coalesce("RETURNED", 0.0) AS "RETURNED"
FROM od FULL JOIN other ON od."Origin" = other."Origin" AND od."Destination" = other."Destination\"""")
def od_align_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_od(spark, sf_dir).select("TRIPS").align(nation_od(spark, sf_dir, sparse=True).select("TRIPS"), {"TRIPS": "RETURNED"}).frame


@query("""SELECT CAST(1 AS INTEGER) AS table_index, 'TRIPS' AS "table", '0' AS type_code UNION ALL SELECT 2, 'QTY', '2' UNION ALL SELECT 3, 'REV', 'D'""")
def od_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_od(spark, sf_dir).catalogue()


# Updates


@query(f"""{FULL} SELECT {_K}, "TRIPS" * 1.5 AS "TRIPS", "QTY" / 4.0 AS "QTY" FROM od""")
def od_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_od(spark, sf_dir).select(["TRIPS", "QTY"]).transform({"TRIPS": lambda c: c * 1.5, "QTY": lambda c: c / 4.0}).frame


@query(f"""{SPARSE}, {_DENSE} SELECT {_K}, "TRIPS" + 0.5 AS "TRIPS" FROM dense""")
def od_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_od(spark, sf_dir, sparse=True).select("TRIPS").transform({"TRIPS": lambda c: c + 0.5}, dense=True).frame


@query(f"""{FULL} SELECT {_K}, CASE WHEN "TRIPS" > 5 THEN "QTY" * 0.5 ELSE "QTY" END AS "QTY", "TRIPS" FROM od""")
def od_mask_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_od(spark, sf_dir).select(["QTY", "TRIPS"]).mask("QTY", F.col("TRIPS") > 5, F.col("QTY") * 0.5).frame


@query(f"""{FULL}, {_DENSE} SELECT {_K}, greatest("QTY" - 200.0, 0.0) AS "QTY" FROM dense""")
def od_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_od(spark, sf_dir).select("QTY").transform({"QTY": lambda c: c - 200.0}).clamp("QTY").frame


@query(f"""{FULL} SELECT {_K}, CASE WHEN "Origin" IN (1, 2, 3) AND "Destination" IN (4, 5) THEN "TRIPS" * 2 ELSE "TRIPS" END AS "TRIPS" FROM od""")
def od_submatrix_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_od(spark, sf_dir).select("TRIPS").submatrix("TRIPS", [1, 2, 3], [4, 5], lambda c: c * 2).frame


@query(f"""{SPARSE}, deltas AS (SELECT {_K}, COUNT(*) * 0.25 AS d FROM trips WHERE l_linenumber = 2 GROUP BY 1, 2)
SELECT coalesce(od."Origin", deltas."Origin") AS "Origin", coalesce(od."Destination", deltas."Destination") AS "Destination", CAST(coalesce("TRIPS", 0.0) + coalesce(d, 0.0) AS DOUBLE) AS "TRIPS"
FROM od FULL JOIN deltas ON od."Origin" = deltas."Origin" AND od."Destination" = deltas."Destination\"""")
def od_scatter_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = trips(spark, sf_dir, F.col("l_linenumber") == 2).select("Origin", "Destination", F.lit(0.25).alias("value"))
    return nation_od(spark, sf_dir, sparse=True).select("TRIPS").scatter_add("TRIPS", deltas).frame


@query(f"""{SPARSE}, new AS (SELECT * FROM (VALUES (1, 1, 7.5), (2, 3, 0.25), (25, 24, 0.0)) v(o, d, v))
SELECT CAST(coalesce("Origin", o) AS BIGINT) AS "Origin", CAST(coalesce("Destination", d) AS BIGINT) AS "Destination", CAST(coalesce(v, "TRIPS") AS DOUBLE) AS "TRIPS", coalesce("QTY", 0.0) AS "QTY"
FROM od FULL JOIN new ON "Origin" = o AND "Destination" = d""")
def od_point_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spark.createDataFrame([(1, 1, 7.5), (2, 3, 0.25), (25, 24, 0.0)], "Origin long, Destination long, value double")
    return nation_od(spark, sf_dir, sparse=True).select(["TRIPS", "QTY"]).points("TRIPS", cells).frame


@query(f"""{SPARSE}, {_DENSE} SELECT {_K}, CAST(3.5 AS DOUBLE) AS "TRIPS", "QTY" FROM dense""")
def od_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_od(spark, sf_dir, sparse=True).select(["TRIPS", "QTY"]).fill("TRIPS", 3.5).frame


@query(f"""{FULL}, part AS (SELECT {_K}, "QTY" AS v FROM od WHERE "Origin" < "Destination")
SELECT od."Origin", od."Destination", coalesce(v, 0.0) AS "TRIPS", "QTY" FROM od LEFT JOIN part ON od."Origin" = part."Origin" AND od."Destination" = part."Destination\"""")
def od_replace_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = nation_od(spark, sf_dir).select(["TRIPS", "QTY"])
    return m.replace_table("TRIPS", m.table("QTY").where("Origin < Destination")).frame


def _quantise_sql(code: str, value: str) -> str:
    if code == "D":
        return f'{FULL} SELECT {_K}, {value} AS value FROM od'
    if code == "S":
        return f'{FULL} SELECT {_K}, CAST(CAST({value} AS FLOAT) AS DOUBLE) AS value FROM od'
    p = f"CAST({10 ** int(code)} AS DOUBLE)"
    return f"""{FULL} SELECT {_K}, CASE WHEN bool_or(abs(round_even({value} * {p}, 0)) > 4294967295) OVER (PARTITION BY "Origin") THEN {value} ELSE round_even({value} * {p}, 0) / {p} + 0.0 END AS value FROM od"""


def _quantise(code: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nation_od(spark, sf_dir).frame.select("Origin", "Destination", quantised(F.col("QTY") / 7.0 - 40.0, code).alias("value"))

    return run


for _code in CODES:
    query(_quantise_sql(_code, '("QTY" / 7.0 - 40.0)'), f"od_quantise_{_code}")(_quantise(_code))


@query(_quantise_sql("2", """(CASE WHEN "Origin" = 3 AND "Destination" = 4 THEN 1e12 ELSE "QTY" / 7.0 END)"""))
def od_quantise_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when((F.col("Origin") == 3) & (F.col("Destination") == 4), F.lit(1e12)).otherwise(F.col("QTY") / 7.0)
    return nation_od(spark, sf_dir).frame.select("Origin", "Destination", quantised(value, "2").alias("value"))


@query("""WITH cells AS (SELECT vec_id + 1 AS "Origin", CAST(generate_subscripts(embedding, 1) AS BIGINT) AS "Destination", CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT "Origin", "Destination", round_even(v * CAST(1000 AS DOUBLE), 0) / CAST(1000 AS DOUBLE) + 0.0 AS value FROM cells""")
def od_array_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("Origin"), F.posexplode("embedding").alias("at", "v"))
    return rows.select("Origin", (F.col("at") + 1).cast("long").alias("Destination"), quantised(F.col("v").cast("double"), "3").alias("value"))


# Checks of ingest


@query(f"""{SPARSE}, {_GRID} SELECT g.* FROM grid g LEFT JOIN od ON g."Origin" = od."Origin" AND g."Destination" = od."Destination" WHERE od."Origin" IS NULL""")
def od_missing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.missing_pairs(nation_od(spark, sf_dir, sparse=True).frame, NATIONS)


@query(f"""{SPARSE} SELECT COUNT(*) AS pairs, CAST({NATIONS * NATIONS} - COUNT(*) AS BIGINT) AS missing FROM od""")
def od_missing_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.pair_counts(nation_od(spark, sf_dir, sparse=True).frame, NATIONS)


@query(f"""WITH {_TRIPS} SELECT {_K}, COUNT(*) AS "count" FROM trips GROUP BY 1, 2 HAVING COUNT(*) > 1""")
def od_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicate_pairs(trips(spark, sf_dir))


_ORDINAL = "(l_orderkey * 100 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT)"


@query(f"""WITH ranked AS (SELECT l_suppkey AS o, l_linenumber AS d, l_quantity AS q, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY {_ORDINAL} DESC) AS r FROM lineitem)
SELECT CAST(o + 1 AS BIGINT) AS "Origin", CAST(d + 1 AS BIGINT) AS "Destination", q AS "QTY" FROM ranked WHERE r = 1""")
def od_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("o"), F.col("l_linenumber").alias("d"), F.col("l_quantity").alias("QTY"), F.expr(_ORDINAL).alias("at"))
    return ODMatrix.from_dataframe(rows, IngestOptions("o", "d", zone_base=0, on_duplicate_od="last", ordinal="at", on_missing_od="ignore")).frame


@query(f"""{SPARSE} SELECT greatest(MAX("Origin"), MAX("Destination")) AS zone_count FROM od""")
def od_infer_zone_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.inferred_zones(nation_od(spark, sf_dir, sparse=True).frame)


# Files


@query(f"{SPARSE} SELECT * FROM od")
def od_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/od.csv"
    nation_od(spark, sf_dir, sparse=True).to_csv(path)
    return ODMatrix.from_csv(spark, path, IngestOptions(zone_count=NATIONS, on_missing_od="ignore")).frame


@query(f"""{FULL} SELECT {_K}, CAST(CAST("TRIPS" AS BIGINT) AS VARCHAR) AS "TRIPS", CASE WHEN "QTY" / 4.0 = floor("QTY" / 4.0) THEN CAST(CAST("QTY" / 4.0 AS BIGINT) AS VARCHAR) ELSE CAST("QTY" / 4.0 AS VARCHAR) END AS "QTY" FROM od""")
def od_csv_integral_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_od(spark, sf_dir).frame.select("Origin", "Destination", plain_text(F.col("TRIPS")).alias("TRIPS"), plain_text(F.col("QTY") / 4.0).alias("QTY"))


@query(f"{FULL} SELECT * FROM od")
def od_parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/od.parquet"
    nation_od(spark, sf_dir).to_parquet(path, compression="zstd")
    return ODMatrix.from_parquet(spark, path, IngestOptions(zone_count=NATIONS, on_missing_od="ignore")).frame


@query(f"{SPARSE} SELECT * FROM od")
def od_mat_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/od.mat"
    nation_od(spark, sf_dir, sparse=True).write(path, partitions=3)
    return ODMatrix.read(spark, path).frame


@query(f"""{SPARSE} SELECT {_K}, "REV" FROM od""")
def od_mat_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/od.mat"
    nation_od(spark, sf_dir, sparse=True).write(path, partitions=2)
    return ODMatrix.read(spark, path, tables=["REV"]).frame


@query(f"""SELECT TRUE AS ok, CAST({NATIONS} AS INTEGER) AS zones, CAST(3 AS INTEGER) AS tables, CAST({3 * NATIONS} AS BIGINT) AS rows""")
def od_mat_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/od.mat"
    nation_od(spark, sf_dir, sparse=True).write(path)
    return matfile.validate(spark, path).select("ok", "zones", "tables", "rows")


@query(f"""{SPARSE} SELECT "Origin", SUM("QTY") AS qty FROM od GROUP BY 1""")
def od_sql_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/od.mat"
    nation_od(spark, sf_dir, sparse=True).write(path)
    matfile.register(spark)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY VIEW od_file USING odmat OPTIONS (path '{path}', tables '["QTY"]')""")
    return spark.sql("SELECT Origin, SUM(QTY) AS qty FROM od_file GROUP BY Origin")


@query(f"""{SPARSE}, {_DENSE} SELECT {_K}, "TRIPS" FROM dense""")
def od_read_mat_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/od.mat"
    nation_od(spark, sf_dir, sparse=True).write(path)
    matfile.register(spark)
    return spark.sql(f"SELECT Origin, Destination, TRIPS FROM read_mat('{path}', tables => array('TRIPS'), include_zeros => true)")


# SQL over matrices


@query(f"""{FULL} SELECT CAST(a.n_regionkey + 1 AS BIGINT) AS "Origin", CAST(b.n_regionkey + 1 AS BIGINT) AS "Destination", SUM("TRIPS") AS "TRIPS", SUM("QTY") AS "QTY"
FROM od JOIN nation a ON "Origin" = a.n_nationkey + 1 JOIN nation b ON "Destination" = b.n_nationkey + 1 GROUP BY 1, 2""")
def od_region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("zone"), (F.col("n_regionkey") + 1).cast("long").alias("region"))
    df = nation_od(spark, sf_dir).frame
    for axis in reshape.KEYS:
        df = df.join(region.withColumnsRenamed({"zone": axis, "region": f"{axis}_region"}), axis)
    by = [F.col(f"{axis}_region").alias(axis) for axis in reshape.KEYS]
    return df.groupBy(*by).agg(F.sum("TRIPS").alias("TRIPS"), F.sum("QTY").alias("QTY"))


@query(f"""{FULL} SELECT {_K}, "QTY" FROM od ORDER BY "QTY" DESC, "Origin", "Destination" LIMIT 10""")
def od_top_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_od(spark, sf_dir).frame.select("Origin", "Destination", "QTY").orderBy(F.desc("QTY"), "Origin", "Destination").limit(10)


@query(f"""{FULL}, r AS (SELECT {_K}, "QTY", CAST(rank() OVER (PARTITION BY "Origin" ORDER BY "QTY" DESC) AS INTEGER) AS place FROM od) SELECT * FROM r WHERE place <= 3""")
def od_rank_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.rank().over(Window.partitionBy("Origin").orderBy(F.desc("QTY")))
    return nation_od(spark, sf_dir).frame.select("Origin", "Destination", "QTY", place.alias("place")).where("place <= 3")


@query(f"""{FULL} SELECT {_K}, round("TRIPS" / SUM("TRIPS") OVER (PARTITION BY "Origin"), 9) AS share FROM od""")
def od_share_of_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.col("TRIPS") / F.sum("TRIPS").over(Window.partitionBy("Origin"))
    return nation_od(spark, sf_dir).frame.select("Origin", "Destination", F.round(share, 9).alias("share"))


_TWO = f"""{FULL}, big AS (SELECT {_K} FROM od WHERE "QTY" > 500), near AS (SELECT {_K} FROM od WHERE abs("Origin" - "Destination") <= 2)"""


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    od = nation_od(spark, sf_dir).frame
    return od.where("QTY > 500").select(*reshape.KEYS), od.where("abs(Origin - Destination) <= 2").select(*reshape.KEYS)


@query(f"{_TWO} SELECT * FROM big UNION SELECT * FROM near")
def od_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir)
    return a.union(b).distinct()


@query(f"{_TWO} SELECT * FROM big INTERSECT SELECT * FROM near")
def od_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir)
    return a.intersect(b)


@query(f"{_TWO} SELECT * FROM big EXCEPT SELECT * FROM near")
def od_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir)
    return a.exceptAll(b)


@query(f"""{FULL} SELECT "Origin", "Destination", SUM("TRIPS") AS "TRIPS" FROM od WHERE "Origin" <= 5 AND "Destination" <= 5 GROUP BY CUBE ("Origin", "Destination")""")
def od_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_od(spark, sf_dir).frame.where("Origin <= 5 AND Destination <= 5").cube(*reshape.KEYS).agg(F.sum("TRIPS").alias("TRIPS"))


_STEPS = """types AS (SELECT event_type, CAST(dense_rank() OVER (ORDER BY event_type) AS BIGINT) AS zone FROM (SELECT DISTINCT event_type FROM events)),
steps AS (SELECT ts, value, zone AS "Origin", lead(zone) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS "Destination" FROM events JOIN types USING (event_type))"""


@query(f"""WITH {_STEPS} SELECT "Origin", "Destination", CAST(COUNT(*) AS DOUBLE) AS "STEPS" FROM steps WHERE "Destination" IS NOT NULL GROUP BY 1, 2""")
def od_event_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_od(spark, sf_dir).frame


@query(f"""WITH {_STEPS} SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS window_start, "Origin", "Destination", CAST(COUNT(*) AS DOUBLE) AS "TRIPS", round(SUM(value), 6) AS "VALUE" FROM steps WHERE "Destination" IS NOT NULL GROUP BY 1, 2, 3""")
def od_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_pairs(event_steps(spark, sf_dir), window="1 day", value="value").withColumn("VALUE", F.round("VALUE", 6)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def queries() -> dict[str, Query]:
    from zonegrid.plans import interface  # noqa: F401  (registers its own)

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return {name: _sql[name] for name in queries() if name in _sql}
