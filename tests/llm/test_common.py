import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonegrid.llm import common


def test_batches_are_bounded(spark):
    """Batches that go to Python end soon after BATCH bytes; a bound that the session has set itself stays."""

    def held(texts: pa.Array) -> pa.Array:
        return pa.array([sum(len(t.as_py()) for t in texts)] * len(texts), pa.int64())

    before = spark.conf.get(common._BATCHES)
    rows = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    try:
        spark.conf.set(common._BATCHES, str(common._WIDE))
        most = rows.select(common.text_udf(held, T.LongType())("text").alias("n")).agg(F.max("n")).first()[0]
        assert 1_000_000 < most <= common.BATCH + 200_000
        spark.conf.set(common._BATCHES, "1234567")
        common.text_udf(held, T.LongType())
        assert spark.conf.get(common._BATCHES) == "1234567"
    finally:
        spark.conf.set(common._BATCHES, before)
