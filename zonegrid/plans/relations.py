"""Origin-destination relations derived from business tables; zones are keys plus 1."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonegrid.errors import od_error
from zonegrid.header import ODHeader, table_infos
from zonegrid.matrix import ODMatrix

NATIONS, REGIONS, EVENTS = 25, 5, 5
#: The pairs that a sparse relation has, at any size of the tables.
HOLES = "(Origin * 7 + Destination * 3) % 5 < 3"
NATION_TABLES = table_infos([("TRIPS", "0"), ("QTY", "2"), ("REV", "D")])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh folder that executors share: beside the checkpoints where their folder is set. It goes when the driver ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared and shared.startswith(("/", "file:")):
        path = f"{shared.removeprefix('file://').removeprefix('file:')}/matrices-{uuid.uuid4().hex}"
        os.makedirs(path)
    elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        path = tempfile.mkdtemp(prefix="matrices-")
    else:
        raise od_error("io", "matrix files need a mounted folder that executors share: set spark.checkpoint.dir to one")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def trips(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    """(Origin, Destination, qty, rev) of each line: customer's nation to supplier's."""
    lines = table(spark, sf_dir, "lineitem")
    lines = lines.where(where) if where is not None else lines
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(
        (F.col("c_nationkey") + 1).cast("long").alias("Origin"), (F.col("s_nationkey") + 1).cast("long").alias("Destination"),
        F.col("l_quantity").alias("qty"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("rev"),
    )


def nation_od(spark: SparkSession, sf_dir: str, sparse: bool = False) -> ODMatrix:
    """TRIPS, QTY and REV between nations, of all lines; sparse leaves two pairs in five out, by HOLES."""
    lines = table(spark, sf_dir, "lineitem")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") + 1).cast("long").alias("Destination"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") + 1).cast("long").alias("Origin"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "Origin")
    rev = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    # Lines meet their orders as sums by order and supplier's nation.
    sums = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey", "Destination").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"), F.sum(rev).alias("rev"))
    cells = sums.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("Origin", "Destination").agg(F.sum("n").cast("double").alias("TRIPS"), F.sum("qty").alias("QTY"), F.sum("rev").cast("double").alias("REV"))
    return ODMatrix(ODHeader(NATIONS, NATION_TABLES), cells.where(HOLES) if sparse else cells)


def supplier_od(spark: SparkSession, sf_dir: str) -> ODMatrix:
    """PAIRS of lines of one order by their suppliers, TRIPS as the square root: a dense matrix of many zones."""
    lines = table(spark, sf_dir, "lineitem")
    zones = table(spark, sf_dir, "supplier").count()
    counts = lines.groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))  # an order's lines by supplier, before they are paired
    left = counts.select("l_orderkey", (F.col("l_suppkey") + 1).alias("Origin"), F.col("n").alias("a"))
    right = counts.select("l_orderkey", (F.col("l_suppkey") + 1).alias("Destination"), F.col("n").alias("b"))
    cells = left.join(right, "l_orderkey").groupBy("Origin", "Destination").agg(F.sum(F.col("a") * F.col("b")).cast("double").alias("PAIRS"))
    return ODMatrix(ODHeader(zones, table_infos([("PAIRS", "0")])), cells)


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, Origin, Destination, value): each event and its user's next one, types numbered by name."""
    events = table(spark, sf_dir, "events")
    number = F.dense_rank().over(Window.orderBy("event_type"))
    types = events.select("event_type").distinct().select("event_type", number.cast("long").alias("zone"))
    rows = events.join(types, "event_type")
    follows = F.lead("zone").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return rows.select("ts", F.col("zone").alias("Origin"), follows.alias("Destination"), "value").where("Destination IS NOT NULL")


def event_od(spark: SparkSession, sf_dir: str) -> ODMatrix:
    cells = event_steps(spark, sf_dir).groupBy("Origin", "Destination").agg(F.count(F.lit(1)).cast("double").alias("STEPS"))
    return ODMatrix(ODHeader(EVENTS, table_infos([("STEPS", "0")])), cells)
