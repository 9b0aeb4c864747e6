import io
import json

import numpy as np
import pytest

from zonegrid import cli
from zonegrid.errors import ODError
from zonegrid.header import ODHeader, table_infos
from zonegrid.matrix import ODMatrix
from zonegrid.sources.rows import RowReader, RowWriter

HEADER = ODHeader(3, table_infos([("A", "2"), ("B", "D")]), "banner", "run")
STACK = np.array([[[1, 2, 3], [0, 0, 0], [7, 8, 9]], [[0.5, 0, 0], [0, 0.25, 0], [0, 0, -1]]])


@pytest.fixture
def data():
    w = RowWriter(io.BytesIO(), HEADER)
    assert w.write_stack(STACK) == 6
    return w.finish().getvalue()


def kind(call):
    with pytest.raises(ODError) as e:
        call()
    return e.value.kind


def test_reading(data):
    r = RowReader(data)
    assert (r.header, r.rows_read) == (HEADER, 0)
    rows = list(r.rows())
    assert [(x.row_index, x.table_index, x.is_zero_row) for x in rows] == [(1, 1, False), (1, 2, False), (2, 1, True), (2, 2, False), (3, 1, False), (3, 2, False)]
    assert all(np.array_equal(x.values, STACK[x.table_index - 1, x.row_index - 1]) for x in rows)
    assert r.read_row() is None and r.rows_read == 6 and r.position == len(data)
    r.reset()
    assert r.read_row() == rows[0] and r.read_table_row("B") == rows[1] and r.read_table_row(2) == rows[3] and r.rows_read == 4
    r.reset()
    chosen = r.prepare_selection(["B", 2, "B"])
    assert [r.read_selected_row(chosen) for _ in range(4)] == [rows[1], rows[3], rows[5], None]
    assert r.read_selected_row(frozenset()) is None
    assert kind(lambda: r.prepare_selection(["C"])) == "table_not_found" and kind(lambda: r.prepare_selection([0])) == "table_index_out_of_range"
    assert kind(lambda: list(RowReader(data[:-1]).rows())) == "unexpected_eof" and kind(lambda: RowReader("/no/such/file")) == "io"


def test_writing(data):
    w = RowWriter(io.BytesIO(), HEADER)
    w.write_next_row([1, 2, 3])
    assert kind(lambda: w.write_origin(STACK[:, 0])) == "writer_position_mismatch" and kind(w.finish) == "incomplete_matrix"
    w.write_next_row(STACK[1, 0])
    w.write_origin(STACK[:, 1])
    assert kind(lambda: w.write_origins(np.zeros(12), 2)) == "writer_finished" and kind(lambda: w.write_origin(np.zeros(5))) == "shape_mismatch"
    assert kind(lambda: w.write_next_row([1, 2])) == "zone_count_mismatch" and kind(lambda: w.write_stack(np.zeros(4))) == "shape_mismatch"
    assert w.write_stack(STACK) == 2 and w.finish().getvalue() == data
    assert kind(lambda: w.write_next_row([1, 2, 3])) == "writer_finished" and kind(lambda: w.write_stack(STACK)) == "writer_finished"


def test_same_bytes_as_spark(spark, data):
    assert ODMatrix.from_arrays(spark, {"A": STACK[0], "B": STACK[1]}, {"A": 2}, banner="banner", run_id="run").to_bytes() == data


def test_commands(spark, data, tmp_path, capsys):
    f = tmp_path / "m.mat"
    f.write_bytes(data)
    call = lambda *a: cli.main([str(x) for x in a], spark)
    assert call("info", f, "--format", "json") == 0 and json.loads(capsys.readouterr().out)["tables"][1] == {"index": 2, "name": "B", "type_code": "D"}
    assert call("info", f) == 0 and "zones 3" in capsys.readouterr().out
    assert call("stats", f) == 0 and "1 A 2 total=30.000000 diagonal=10.000000" in capsys.readouterr().out
    assert call("stats", f, "--format", "json") == 0 and json.loads(capsys.readouterr().out)["tables"][1]["diagonal"] == -0.25
    assert call("validate", f) == 0 and "3 zones, 2 tables, 6 rows" in capsys.readouterr().out
    (tmp_path / "bad.mat").write_bytes(data + b"x")
    assert call("validate", tmp_path / "bad.mat") == 1 and "kind=trailing_bytes" in capsys.readouterr().err
    assert call("to-csv", f, "-o", tmp_path / "c", "--include-zero-rows", "-s", "tab", "--zone-base", 0) == 0
    assert "0\t0\t1\t0.5\n" in (tmp_path / "c").read_text()
    assert call("from-csv", tmp_path / "c", "-o", tmp_path / "n.mat", "-s", "tab", "--zone-base", 0, "--rename", "A:X", "--rename", "no:Y", "--type-code", "X:2", "--strict") == 0
    got = ODMatrix.read(spark, str(tmp_path / "n.mat"))
    assert got.table_defs == (("X", "2"), ("B", "D")) and np.array_equal(got.stack(), STACK)
    assert call("to-parquet", f, "-o", tmp_path / "p", "--table", "B", "--compression", "zstd") == 0
    capsys.readouterr()
    assert call("from-parquet", tmp_path / "p", "-o", tmp_path / "q.mat", "--type-code", "S") == 0 and "6 of 9 pairs are missing" in capsys.readouterr().err
    assert ODMatrix.read(spark, str(tmp_path / "q.mat")).table_defs == (("B", "S"),)
    (tmp_path / "d.csv").write_text("Origin,Destination,V\n1,2,10.0\n1,2,20.0\n2,1,5.0\n")
    assert call("from-csv", tmp_path / "d.csv", "-o", tmp_path / "d.mat") == 1 and "duplicate_od" in capsys.readouterr().err
    assert call("from-csv", tmp_path / "d.csv", "-o", tmp_path / "d.mat", "--allow-duplicate-od") == 0
    assert ODMatrix.read(spark, str(tmp_path / "d.mat")).get("V", 1, 2) == 20
    assert call("from-csv", tmp_path / "d.csv", "-o", tmp_path / "d.mat", "--allow-duplicate-od", "--strict") == 1
    assert call("from-csv", tmp_path / "d.csv", "-o", tmp_path / "d.mat", "--type-code", "W:2") == 1
    assert call("stats", tmp_path / "none.mat") == 1 and "kind=io" in capsys.readouterr().err


def test_command_arguments(spark, data, tmp_path, capsys):
    """Any zone base that 16 bits hold, tables as often as asked for, and zones of digits only."""
    f = tmp_path / "m.mat"
    f.write_bytes(data)
    call = lambda *a: cli.main([str(x) for x in a], spark)
    assert call("to-csv", f, "-o", tmp_path / "c.csv", "--zone-base", 65535, "--table", "B", "--table", "A", "--table", "B") == 0
    lines = (tmp_path / "c.csv").read_text().splitlines()
    assert lines[0] == "Origin,Destination,B,A,B" and lines[1] == "65535,65535,0.5,1,0.5"
    assert call("to-csv", f, "-o", tmp_path / "z.csv", "--zone-base", 100) == 0
    assert call("from-csv", tmp_path / "z.csv", "-o", tmp_path / "z.mat", "--zone-base", 100) == 0
    assert np.array_equal(ODMatrix.read(spark, str(tmp_path / "z.mat")).stack(), STACK)
    for bad in (-1, 65536, "x"):
        with pytest.raises(SystemExit):
            call("to-csv", f, "-o", tmp_path / "c.csv", "--zone-base", bad)
    (tmp_path / "f.csv").write_text("Origin,Destination,V\n1.0,2,10\n")
    capsys.readouterr()
    assert call("from-csv", tmp_path / "f.csv", "-o", tmp_path / "f.mat") == 1 and "kind=invalid_od" in capsys.readouterr().err


def test_sources_come_back(data):
    r = RowReader(data)
    row = r.read_row()
    assert row.row_index == 1 and len(r.into_inner().read()) == len(data) - r.position and r.read_row() is None
    w = RowWriter(io.BytesIO(), HEADER)
    w.write_next_row([1, 2, 3])
    assert w.into_inner().getvalue() == data[: len(w.into_inner().getvalue())]
