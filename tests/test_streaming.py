from zonegrid.streaming.accumulate import files_as_they_come, running_pairs, windowed_pairs

SCHEMA = "ts timestamp, Origin long, Destination long, value double"


def test_running_and_windowed_pairs(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", 1, 2, 1.0), ("2024-01-01 00:50:00", 1, 2, 2.0), ("2024-01-01 01:10:00", 1, 2, 4.0), ("2024-01-01 00:20:00", 2, 1, 8.0)]
    df = spark.createDataFrame(rows, "ts string, Origin long, Destination long, value double").selectExpr("cast(ts as timestamp) ts", "Origin", "Destination", "value")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    for name, out, mode in (("running", running_pairs(stream, "value"), "complete"), ("windows", windowed_pairs(stream, value="value"), "complete")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(map(tuple, spark.sql("SELECT * FROM running").collect())) == [(1, 2, 3.0, 7.0), (2, 1, 1.0, 8.0)]
    assert sorted(r[1:] for r in spark.sql("SELECT * FROM windows").collect()) == sorted(r[1:] for r in windowed_pairs(df, value="value").collect())


def test_files_as_they_come(spark, tmp_path):
    import numpy as np

    from zonegrid.matrix import ODMatrix
    from zonegrid.sources import matfile

    m = ODMatrix.from_arrays(spark, {"A": np.eye(3)})
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.mat").write_bytes(m.to_bytes())
    folder = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(str(tmp_path / "in"))
    q = files_as_they_come(folder, lambda b: matfile.decode_files(b, m.header, list(m.header.tables), ["A"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
