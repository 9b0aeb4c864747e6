import json
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonegrid.errors import ODError, ODValidationError, ODWarning
from zonegrid.header import ODHeader, table_infos
from zonegrid.matrix import ODMatrix, info
from zonegrid.operators import reshape
from zonegrid.operators.ingest import IngestOptions
from zonegrid.sources import matfile


@pytest.fixture(scope="module")
def small(spark):
    trips, dist = np.zeros((3, 3)), np.zeros((3, 3))
    trips[0, 1], trips[1, 2], dist[0, 2], dist[2, 0] = 10, 20, 5.5, 3.25
    return ODMatrix.from_arrays(spark, {"TRIPS": trips, "DIST": dist}, {"DIST": 2})


@pytest.fixture(scope="module")
def am(spark):
    dist = np.array([[0, 7.5, 12], [8.1, 0, 5.5], [11, 6, 0]])
    time = np.array([[0, 15.3, 25], [20.1, 0, 10], [22, 12, 0]])
    return ODMatrix.from_arrays(spark, {"DIST_AM": dist, "TIME_AM": time}, {"DIST_AM": "S", "TIME_AM": "2"})


def kind(call):
    with pytest.raises(ODError) as e:
        call()
    return e.value.kind


def test_stats(spark):
    a = np.arange(1.0, 10).reshape(3, 3)
    m = ODMatrix.from_arrays(spark, {"T1": a, "T2": a + 9}, {"T1": "2"})
    assert [tuple(r) for r in m.stats().collect()] == [(1, "T1", "2", 45.0, 15.0), (2, "T2", "D", 126.0, 42.0)]
    assert m.total("T1") == 45 and m.diagonal_total(1) == 42
    assert "1 T1 2 total=45.000000 diagonal=15.000000" in m.report()
    assert json.loads(m.report_json())["tables"][1]["total"] == 126


def test_empty_matrix(spark):
    m = ODMatrix.create(spark, 4, [("TABLE1", 0)])
    assert m.total("TABLE1") == 0 and m.wide().count() == 0 and m.wide(include_zero_rows=True).count() == 16
    assert m.get("TABLE1", 4, 4) == 0.0 and m.origin_totals().count() == 4 and m.fill(0, 2.5).total(0) == 40
    assert m.like().frame.count() == 0 and (m.zone_count, m.table_count, m.row_count, len(m)) == (4, 1, 4, 1)


def test_cells(small):
    assert small.get("TRIPS", 1, 2) == 10 and small.get(1, 3, 1) == 3.25 and small.get("DIST", 2, 2) == 0
    assert small.row("TRIPS", 1).first()["cells"] == [0, 10, 0] and small.row("TRIPS", 3).first()["cells"] == [0, 0, 0]
    assert "TRIPS" in small and "trips" not in small and 0 not in small and list(small) == ["TRIPS", "DIST"]
    assert kind(lambda: small.get("TRIPS", 4, 1)) == "invalid_row_index" and kind(lambda: small["X"]) == "table_not_found"
    assert kind(lambda: small[2]) == "table_index_out_of_range" and kind(lambda: small[True]) == "table_not_found"
    assert small.table_defs == (("TRIPS", "D"), ("DIST", "2")) and small.catalogue().count() == 2


def test_selection(small):
    assert small.wide(["DIST", 0]).columns == ["Origin", "Destination", "DIST", "TRIPS"]
    assert small.wide("DIST").count() == 2  # only pairs that the chosen table has
    assert kind(lambda: small.wide(["DIST", 1])) == "invalid_table_name" and kind(lambda: small.wide([])) == "invalid_table_count"


def test_wide(am):
    rows = [tuple(r) for r in am.wide().collect()]
    assert len(rows) == 6 and rows[0] == (1, 2, 7.5, 15.3) and am.wide(include_zero_rows=True).count() == 9
    assert am.wide(zone_base=0).first()[:2] == (0, 1)
    assert am.wide(rename={"DIST_AM": "d"}, origin="o").columns == ["o", "Destination", "d", "TIME_AM"]
    for bad in ({"X": "y"}, {"DIST_AM": "TIME_AM"}, {"DIST_AM": ""}, {"DIST_AM": "Origin"}):
        assert kind(lambda: am.wide(rename=bad)) in ("table_not_found", "invalid_table_name")
    assert kind(lambda: am.wide(zone_base=2)) == "invalid_od"


def test_nan_and_negative_zero(spark):
    m = ODMatrix(ODHeader(2, table_infos(["T"])), spark.createDataFrame([(1, 1, float("nan")), (1, 2, -0.0), (2, 1, 1.0)], "Origin long, Destination long, T double"))
    assert m.wide().count() == 2 and m.long(zero_policy="exclude").count() == 2
    assert np.isnan(m.dense().where("Origin = 1 AND Destination = 1").first()["T"])
    clamped = m.clamp("T", 0.5).array("T")
    assert np.isnan(clamped[0, 0]) and clamped[1, 1] == 0.5


def test_long(small):
    rows = [tuple(r) for r in small.long(zero_policy="exclude").collect()]
    assert rows == [(0, "TRIPS", 1, 2, 10.0), (0, "TRIPS", 2, 3, 20.0), (1, "DIST", 1, 3, 5.5), (1, "DIST", 3, 1, 3.25)]
    assert [r[1] for r in small.long(["DIST", "TRIPS"], include_zeros=False).collect()][0] == "DIST"
    assert small.long().count() == 18 and small.long(zone_base=0).first()[2:4] == (0, 0)
    assert kind(lambda: small.long(zero_policy="some")) == "invalid_od"
    assert not reshape.include_zeros("auto", 2, 1000) and reshape.include_zeros("auto", 2, 1000, True)


def test_reindex(small):
    got = small.reindex_zones([3, 1])
    assert got.zone_count == 2 and got.array("DIST").tolist() == [[0, 3.25], [5.5, 0]]
    assert np.array_equal(small.reindex_zones([2, 1, 0], basis="index").array(0), small.array(0)[::-1, ::-1])
    for bad in ([], [1, 1], [0], [4], [True], [1.0]):
        assert kind(lambda: small.reindex_zones(bad)) == "invalid_od"


def test_updates(spark, small):
    assert small.set("TRIPS", 3, 3, 7).array("TRIPS")[2, 2] == 7 and small.get("TRIPS", 3, 3) == 0
    assert small.set("TRIPS", 3, 3, 7).get("DIST", 3, 3) == 0
    assert small.transform({"TRIPS": lambda c: c + 1}, dense=True).total("TRIPS") == 39
    deltas = spark.createDataFrame([(1, 2, 1.0), (1, 2, 2.0), (3, 3, 4.0)], "Origin long, Destination long, value double")
    assert small.scatter_add("TRIPS", deltas).array("TRIPS").tolist() == [[0, 13, 0], [0, 0, 20], [0, 0, 4]]
    assert small.submatrix("TRIPS", [1], [1, 2], lambda c: c + 1, dense=True).array("TRIPS")[0].tolist() == [1, 11, 0]
    new = np.eye(3)
    assert np.array_equal(small.replace_table("TRIPS", new).array("TRIPS"), new)
    assert kind(lambda: small.replace_table("TRIPS", np.eye(2))) == "shape_mismatch"
    assert small.mask("TRIPS", F.col("DIST") == 0, F.lit(0.0)).total("TRIPS") == 0


def test_quantise_is_what_a_file_holds(spark):
    g = np.random.default_rng(1)
    values = {c: g.normal(0, 1000, (6, 6)) for c in "0123456789SD"}
    values["2"][1, 1], values["S"][2, 2], values["9"][0] = 1e12, 1e300, 0.123456789
    m = ODMatrix.from_arrays(spark, {f"T{c}": v for c, v in values.items()}, {f"T{c}": c for c in values})
    assert np.array_equal(m.quantise().stack(), ODMatrix.from_bytes(spark, m.to_bytes()).stack())


def test_file_round_trip(spark, small, tmp_path):
    path = str(tmp_path / "small.mat")
    small.write(path, partitions=2)
    assert open(path, "rb").read() == small.to_bytes() and len(list(tmp_path.iterdir())) == 1
    got = ODMatrix.read(spark, path)
    assert got.header == small.header and np.array_equal(got.stack(), small.stack())
    one = ODMatrix.read(spark, path, tables=["DIST", "DIST"])
    assert one.table_defs == (("DIST", "2"),) and one.header.tables[0].index == 1 and one.frame.count() == 2
    assert kind(lambda: ODMatrix.read(spark, path, tables=["X"])) == "table_not_found"
    assert kind(lambda: ODMatrix.read(spark, path, tables=[])) == "invalid_table_count"
    assert kind(lambda: ODMatrix.read(spark, path + "x")) == "io"
    assert info(spark, path).count() == 2
    assert ODMatrix.from_bytes(spark, small.to_bytes(), ["DIST"]).total("DIST") == 8.75
    assert ODMatrix.create(spark, 5, ["A"]).to_bytes()[-8:] == b"\x05\0\x01\x05\0\x80\x80\0"


def test_repeated_names(spark, tmp_path):
    header = ODHeader(2, table_infos([("T", "D"), ("t", "D"), ("T", "D")]))
    frame = spark.createDataFrame([(1, 2, 1.0, 2.0, 3.0)], "Origin long, Destination long, T double, t__2 double, T__3 double")
    path = str(tmp_path / "names.mat")
    ODMatrix(header, frame).write(path)
    got = ODMatrix.read(spark, path)
    assert got.header.names == ["T", "t", "T"] and tuple(got.frame.first()) == (1, 2, 1.0, 2.0, 3.0)
    assert got.total("T") == 1 and got.total("t") == 2 and got.total(2) == 3


def test_many_parts_and_filters(spark, tmp_path, monkeypatch):
    a = np.random.default_rng(3).integers(0, 3, (60, 60)).astype(float)
    m = ODMatrix.from_arrays(spark, {"A": a}, {"A": 0})
    path = str(tmp_path / "m.mat")
    m.write(path)
    header, start = matfile.read_header(open(path, "rb"))
    parts = matfile.index(path, header, start, 7)
    assert [p[1:] for p in parts] == [(i, min(i + 6, 60)) for i in range(1, 61, 7)]
    reader = matfile._FilteredReader(path, header, list(header.tables), ["A"], start, False)
    from pyspark.sql.datasource import GreaterThan, LessThanOrEqual

    list(reader.pushFilters([GreaterThan(("Origin",), 50), LessThanOrEqual(("Origin",), 55)]))
    monkeypatch.setattr(matfile, "TASK", 60 * 7)
    chosen = reader.partitions()
    assert [(p.first, p.last) for p in chosen] == [(50, 56)]
    got = np.zeros((60, 60))
    for b in (b for p in chosen for b in reader.read(p)):
        got[np.asarray(b[0]) - 1, np.asarray(b[1]) - 1] = np.asarray(b[2])
    assert np.array_equal(got[50:55], a[50:55]) and not got[:50].any() and not got[55:].any()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert ODMatrix.read(spark, path).frame.where("Origin = 9").count() == np.count_nonzero(a[8])
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_sql(spark, small, tmp_path):
    path = str(tmp_path / "s.mat")
    small.write(path)
    matfile.register(spark)
    assert spark.sql(f"SELECT COUNT(*) AS n FROM read_mat('{path}', include_zeros => true)").first()["n"] == 9
    assert spark.sql(f"SELECT * FROM read_mat('{path}', tables => array('DIST'))").count() == 2
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW v USING odmat OPTIONS (path '{path}', include_zeros 'true')")
    assert spark.sql("SELECT COUNT(*) AS n, SUM(TRIPS) AS t FROM v").first()[:] == (9, 30.0)
    small.view("w")
    assert spark.sql("SELECT COUNT(*) FROM w").first()[0] == 4


def test_broken_files(spark, small, tmp_path):
    data = small.to_bytes()
    for name, content in (("good", data), ("short", data[:-1]), ("long", data + b"x"), ("tiny", b"\0")):
        (tmp_path / name).write_bytes(content)
    got = {r["path"].rsplit("/", 1)[-1]: r for r in matfile.validate(spark, str(tmp_path)).collect()}
    assert got["good"]["ok"] and (got["good"]["zones"], got["good"]["tables"], got["good"]["rows"]) == (3, 2, 6)
    assert {n: got[n]["kind"] for n in ("short", "long", "tiny")} == {"short": "unexpected_eof", "long": "trailing_bytes", "tiny": "unexpected_eof"}
    assert got["long"]["offset"] == len(data)
    with pytest.raises(Exception, match="kind=unexpected_eof"):
        ODMatrix.read(spark, str(tmp_path / "short")).frame.count()


def test_writer_refuses(spark, small, tmp_path):
    outside = ODMatrix(small.header, spark.createDataFrame([(1, 4, 1.0, 1.0)], small.frame.schema))
    with pytest.raises(Exception, match="kind=invalid_row_index"):
        outside.write(str(tmp_path / "x.mat"))
    assert kind(lambda: ODMatrix.create(spark, 2, ["A", "A"])) == "invalid_table_name"
    assert kind(lambda: ODMatrix.create(spark, 2, [" "])) == "invalid_table_name"


def test_csv_and_parquet(spark, am, tmp_path):
    am.to_csv(str(tmp_path / "c"), sep=";", include_zero_rows=True)
    got = ODMatrix.from_csv(spark, str(tmp_path / "c"), sep=";")
    assert np.array_equal(got.stack(), am.stack()) and got.table_defs == (("DIST_AM", "D"), ("TIME_AM", "D"))
    am.to_parquet(str(tmp_path / "p"), include_zero_rows=True, compression="none")
    got = ODMatrix.from_parquet(spark, str(tmp_path / "p"), IngestOptions(table_columns=["TIME_AM"], rename_columns={"TIME_AM": "T"}, type_codes={"T": 2}, on_missing_od="error"))
    assert got.table_defs == (("T", "2"),) and np.array_equal(got.array("T"), am.array("TIME_AM"))
    am.to_csv(str(tmp_path / "i"), integral=True, sep="tab")
    text = "".join(p.read_text() for p in (tmp_path / "i").glob("*.csv"))
    assert "1\t3\t12\t25\n" in text
    am.to_csv_long(str(tmp_path / "l"))
    am.to_parquet_long(str(tmp_path / "q"), zero_policy="exclude")
    assert spark.read.parquet(str(tmp_path / "q")).count() == 12
    assert kind(lambda: am.to_parquet(str(tmp_path / "z"), compression="lzo")) == "invalid_od"
    assert kind(lambda: am.to_csv(str(tmp_path / "z"), sep=",,")) == "invalid_od"
    assert len(am.to_pandas()) == 6 and len(am.to_long_pandas()) == 18


def frame(spark, rows, schema="Origin string, Destination string, V string"):
    return spark.createDataFrame(rows, schema)


def test_ingest_zones_and_values(spark):
    got = ODMatrix.from_dataframe(frame(spark, [("1", "2.0", "10"), ("2", "1", "1e1")]), IngestOptions(on_missing_od="ignore"))
    assert got.array("V").tolist() == [[0, 10], [10, 0]]
    for bad in (("1.5", "1", "1"), ("x", "1", "1"), (None, "1", "1"), ("nan", "1", "1"), ("0", "1", "1"), ("1", "1", ""), ("1", "1", None)):
        assert kind(lambda: ODMatrix.from_dataframe(frame(spark, [bad]))) == "invalid_od"
    zero = ODMatrix.from_dataframe(frame(spark, [("0", "1", "3")]), IngestOptions(zone_base=0, on_missing_od="ignore"))
    assert zero.array("V").tolist() == [[0, 3], [0, 0]]
    assert kind(lambda: ODMatrix.from_dataframe(frame(spark, [(True, True, 1.0)], "Origin boolean, Destination boolean, V double"))) == "invalid_od"


def test_ingest_zone_count(spark):
    df = frame(spark, [("1", "3", "1")])
    assert ODMatrix.from_dataframe(df, IngestOptions(zone_count=5, on_missing_od="ignore")).zone_count == 5
    assert kind(lambda: ODMatrix.from_dataframe(df, IngestOptions(zone_count=2))) == "zone_count_mismatch"
    assert ODMatrix.from_dataframe(df, IngestOptions(zone_count=2, strict_zone_range=False, on_missing_od="ignore")).zone_count == 3
    assert kind(lambda: ODMatrix.from_dataframe(df.limit(0))) == "invalid_zone_count"
    assert ODMatrix.from_dataframe(df.limit(0), IngestOptions(zone_count=2, on_missing_od="ignore")).total("V") == 0
    kept = frame(spark, [("1", "1", "1"), ("1", "3", "0")])
    assert ODMatrix.from_dataframe(kept, IngestOptions(on_missing_od="ignore")).zone_count == 3
    assert ODMatrix.from_dataframe(kept, IngestOptions(include_zero_rows=False, on_missing_od="ignore")).zone_count == 1


def test_ingest_duplicates(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Origin,Destination,V\n1,2,10.0\n1,2,20.0\n2,1,5.0\n")
    with pytest.raises(ODValidationError, match=r"\(1, 2\)") as e:
        ODMatrix.from_csv(spark, str(tmp_path / "d.csv"))
    assert e.value.kind == "duplicate_od"
    last = ODMatrix.from_csv(spark, str(tmp_path / "d.csv"), IngestOptions(on_duplicate_od="last", on_missing_od="ignore"))
    assert last.array("V").tolist() == [[0, 20], [5, 0]]


def test_ingest_missing(spark):
    df = frame(spark, [("1", "2", "1"), ("2", "1", "1")])
    with pytest.warns(ODWarning, match=r"2 of 4 pairs are missing, such as \(1, 1\), \(2, 2\)"):
        ODMatrix.from_dataframe(df)
    assert kind(lambda: ODMatrix.from_dataframe(df, IngestOptions(on_missing_od="error"))) == "missing_od"
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        ODMatrix.from_dataframe(df, IngestOptions(on_missing_od="ignore"))


def test_ingest_more_zones_than_files_hold(spark, tmp_path):
    """A relation may name any zone; only a file's zones are bounded, and a zone count that is asked for."""
    df = frame(spark, [("1", "2", "1"), ("60000", "7", "2")])
    m = ODMatrix.from_dataframe(df, IngestOptions(on_missing_od="ignore"))
    assert m.zone_count == 60_000 and sorted(map(tuple, m.frame.collect())) == [(1, 2, 1.0), (60_000, 7, 2.0)]
    assert kind(lambda: m.write(str(tmp_path / "a.mat"))) == "invalid_zone_count" and kind(m.to_bytes) == "invalid_zone_count"
    assert kind(lambda: ODMatrix.from_dataframe(df, IngestOptions(zone_count=60_000))) == "invalid_zone_count"
    with pytest.warns(ODWarning, match=r"3599999998 of 3600000000 pairs are missing, such as \(1, 1\), \(1, 3\)"):
        ODMatrix.from_dataframe(df)


@pytest.mark.parametrize("options, wanted", [
    (IngestOptions("A"), "invalid_od"), (IngestOptions("", "D"), "invalid_od"), (IngestOptions("Origin", "Origin"), "invalid_od"),
    (IngestOptions(zone_base=2), "invalid_od"), (IngestOptions(zone_base=True), "invalid_od"), (IngestOptions(zone_count=0), "invalid_zone_count"),
    (IngestOptions(on_duplicate_od="first"), "invalid_od"), (IngestOptions(on_duplicate_od="last"), "invalid_od"), (IngestOptions(on_missing_od="x"), "invalid_od"),
    (IngestOptions(table_columns=["W"]), "table_not_found"), (IngestOptions(table_columns=["V", "V"]), "invalid_table_name"), (IngestOptions(table_columns=[]), "invalid_table_count"),
    (IngestOptions(rename_columns={"X": "Y"}), "table_not_found"), (IngestOptions(type_codes={"X": 1}), "table_not_found"), (IngestOptions(type_codes={"V": "Q"}), "invalid_type_code"),
])
def test_ingest_options(spark, options, wanted):
    assert kind(lambda: ODMatrix.from_dataframe(frame(spark, [("1", "1", "1")]), options)) == wanted


def test_extra_columns(spark):
    df = frame(spark, [("1", "1", "1", "x")], "Origin string, Destination string, V string, note string")
    assert ODMatrix.from_dataframe(df, IngestOptions(table_columns=["V"])).table_names == ("V",)
    assert kind(lambda: ODMatrix.from_dataframe(df, IngestOptions(table_columns=["V"], drop_extra_columns=False))) == "invalid_od"


def test_parts_and_capabilities(spark, small):
    from zonegrid import capabilities

    assert ODMatrix.from_parts(*small.into_parts()) == small
    assert kind(lambda: ODMatrix.from_parts(small.header, small.frame.drop("DIST"))) == "shape_mismatch"
    assert capabilities.capabilities()["pandas"] and capabilities.parquet_engine() == capabilities.parquet_engine("spark") == "spark"
    assert kind(lambda: capabilities.parquet_engine("no_such_engine")) == "invalid_od" and kind(lambda: small.to_parquet("x", parquet_engine="pyarrow")) == "invalid_od"
    if capabilities.capabilities()["polars"]:
        assert len(small.to_polars()) == 4
    pdf = small.to_pandas(include_zero_rows=True)
    assert np.array_equal(ODMatrix.from_pandas(spark, pdf).stack(), small.stack())


def test_absent_pairs_change(spark, small):
    """What an expression makes of zero is there afterwards, whether or not the pair was."""
    dense = small.stack()
    assert np.array_equal(small.transform({"TRIPS": lambda c: c + 1}).stack(["TRIPS"])[0], dense[0] + 1)
    assert small.transform({"TRIPS": lambda c: c * 3}).frame.count() == small.frame.count()
    got = small.mask("DIST", F.col("TRIPS") < 5, F.col("DIST") + 2).stack()
    assert np.array_equal(got[1], np.where(dense[0] < 5, dense[1] + 2, dense[1])) and np.array_equal(got[0], dense[0])
    got = small.mask("DIST", F.col("Origin") == F.col("Destination"), F.lit(9.0)).stack(["DIST"])[0]
    assert np.array_equal(got, np.where(np.eye(3), 9.0, dense[1]))
    got = small.submatrix("TRIPS", [1, 3], [2, 3], lambda c: c * 2 + 1).stack(["TRIPS"])[0]
    wanted = dense[0].copy()
    wanted[np.ix_([0, 2], [1, 2])] = wanted[np.ix_([0, 2], [1, 2])] * 2 + 1
    assert np.array_equal(got, wanted)


def test_whole_stacks_and_aligned_tables(spark, small, am):
    assert np.array_equal(small.set_stack(small.stack() + 1).stack(), small.stack() + 1)
    assert kind(lambda: small.set_stack(np.zeros((1, 3, 3)))) == "shape_mismatch"
    both = small.align(am)
    assert both.table_defs == (*small.table_defs, *am.table_defs) and np.array_equal(both.stack(), np.concatenate([small.stack(), am.stack()]))
    assert kind(lambda: small.align(small)) == "invalid_table_name" and small.align(small, {"TRIPS": "T2", "DIST": "D2"}).table_count == 4


def test_one_file(spark, small, tmp_path):
    small.to_csv(str(tmp_path / "one.csv"), one_file=True, include_zero_rows=True)
    lines = (tmp_path / "one.csv").read_text().splitlines()
    assert lines[0] == "Origin,Destination,TRIPS,DIST" and len(lines) == 10 and lines[1:] == sorted(lines[1:])
    small.to_csv(str(tmp_path / "wide.csv"), one_file=True, encoding="utf-16")
    assert (tmp_path / "wide.csv").read_text(encoding="utf-16").splitlines()[0] == lines[0]
    small.to_parquet(str(tmp_path / "one.parquet"), one_file=True)
    assert (tmp_path / "one.parquet").is_file() and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["one.csv", "one.parquet", "wide.csv"]
    assert np.array_equal(ODMatrix.from_parquet(spark, str(tmp_path / "one.parquet"), IngestOptions(on_missing_od="ignore")).stack(), small.stack())


def test_plain_text(spark):
    from zonegrid.functions.cells import plain_text

    values = [0.0, -2.0, 0.5, 12345678.5, -98765432.125, 1e22, 123456789012345680.0, 1.5e-7, -1e-300, 2.0**53, 1234567.25]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(plain_text(F.col("v"))).collect()]
    assert got == ["0", "-2", "0.5", "12345678.5", "-98765432.125", "1" + "0" * 22, "123456789012345680", "0.00000015", "-0." + "0" * 299 + "1", "9007199254740992", "1234567.25"]
    assert [float(g) for g in got] == values


def test_pruned_schema(spark, small, tmp_path):
    path = str(tmp_path / "p.mat")
    small.write(path)
    df = spark.read.schema("Origin long, Destination long, DIST double").format("odmat").load(path=path)
    assert df.columns == ["Origin", "Destination", "DIST"] and df.count() == 2


def test_bytes_of_many_zones(spark):
    """Beyond the zones that an array on the driver may have."""
    m = ODMatrix(ODHeader(5000, table_infos([("A", "2")])), spark.createDataFrame([(1, 5000, 2.5), (4999, 3, 7.0)], "Origin long, Destination long, A double"))
    again = ODMatrix.from_bytes(spark, m.to_bytes())
    assert sorted(map(tuple, again.frame.collect())) == [(1, 5000, 2.5), (4999, 3, 7.0)] and again.zone_count == 5000
