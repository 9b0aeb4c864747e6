import io
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from zonegrid import codec
from zonegrid.errors import ODError, ODParseError, ODValidationError, from_text, od_error
from zonegrid.header import CODES, ODHeader, read_header, table_infos, type_code
from zonegrid.sources.matfile import records


def file_bytes(header, arrays):
    rows = [codec.record(o + 1, t.index, codec.encode(arrays[t.index - 1][o], t.code)) for o in range(header.zone_count) for t in header.tables]
    return header.to_bytes() + b"".join(rows)


def decoded(data):
    source = io.BytesIO(data)
    header, at = read_header(source)
    out = np.zeros((header.table_count, header.zone_count, header.zone_count))
    for _, origin, table, payload in records(source, header, at):
        out[table - 1, origin - 1] = codec.decode(payload, header.tables[table - 1].code, header.zone_count)
    return header, out


def raw_header(par=b"PAR Zones=2 M=1\0", mvr=b"MVR 1\0T=2\0", marker=b"ROW\0"):
    return b"".join(struct.pack("<I", len(r) + 4) + r for r in (b"banner\0", b"ID=run\0", par, mvr, marker))


@pytest.mark.parametrize("zones", [2, 3, 127, 128, 129, 255, 256, 257, 1024])
@pytest.mark.parametrize("code", CODES)
def test_round_trip(zones, code):
    g = np.random.default_rng(zones)
    values = np.where(g.random(zones) < 0.4, np.rint(g.normal(0, 50, zones)), 0.0)
    assert np.array_equal(codec.decode(codec.encode(values, code), code, zones), values + 0.0)


@pytest.mark.parametrize("code, value, stored", [
    ("2", 0.005, 0.0), ("2", 0.015, 0.02), ("2", 0.025, 0.02), ("2", 0.035, 0.04), ("2", 1.005, 1.0), ("2", -0.015, -0.02),
    ("2", 0.004, 0.0), ("2", 0.006, 0.01), ("2", 0.575, 0.57), ("3", 0.0005, 0.0), ("3", 0.0015, 0.002), ("3", 0.0025, 0.002),
    ("3", 1.2345, 1.234), ("3", 1.2355, 1.236), ("0", 50_000_000.0, 50_000_000.0), ("2", -255.99, -255.99), ("2", -0.01, -0.01),
])
def test_half_even(code, value, stored):
    assert codec.decode(codec.encode(np.array([value, 1.0]), code), code, 2)[0] == stored


def test_special_values():
    odd = np.array([np.nan, np.inf, -np.inf, -0.0, np.pi, -1e15])
    for code in ("2", "D"):  # a fixed-point row that can't hold one is stored as it is
        got = codec.decode(codec.encode(odd, code), code, 6)
        assert got.tobytes() == odd.tobytes()
    assert codec.encode(np.array([0.0, -0.0]), "D") == b"\x80\x80\x00"
    assert codec.decode(codec.encode(np.array([1e300, 0.1]), "S"), "S", 2).tolist() == [1e300, 0.1]
    assert codec.decode(codec.encode(np.array([5e9, 0.123]), "2"), "2", 2).tolist() == [5e9, 0.123]
    assert codec.decode(codec.encode(np.array([-0.001, 1.0]), "2"), "2", 2)[0].tobytes() == np.float64(0.0).tobytes()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=400), st.integers(1, 200))
def test_planes(cells, stretch):
    plane = np.repeat(np.array(cells, np.uint8), stretch)
    out = np.empty_like(plane)
    data = codec.write_plane(plane)
    assert codec.read_plane(data, 0, out) == len(data) and np.array_equal(out, plane)


def test_runs_longer_than_a_command():
    plane = np.concatenate([np.zeros(70_001, np.uint8), np.arange(40_000) % 251]).astype(np.uint8)
    out = np.empty_like(plane)
    assert codec.read_plane(codec.write_plane(plane), 0, out) and np.array_equal(out, plane)


def test_golden_totals():
    names = [(f"D{i}", str(i)) for i in range(10)] + [("DS", "S"), ("DD", "D")]
    header = ODHeader(20, table_infos(names))
    _, out = decoded(file_bytes(header, np.full((12, 20, 20), 0.123456789)))
    wanted = [0, 40, 48, 49.2, 49.4, 49.384, 49.3828, 49.38272, 49.382716, 49.3827156, 49.38271641731262, 49.3827156]
    assert np.allclose(out.sum(axis=(1, 2)), wanted, rtol=1e-12, atol=1e-6)


def test_header():
    header = ODHeader(10, table_infos([("A=b", "S"), ("a=b", "2"), ("A=b", "0")]), "", "")
    got, _ = read_header(io.BytesIO(header.to_bytes()))
    assert got == header and got.columns == ["A=b", "a=b__2", "A=b__3"]
    assert got.find("A=b").index == 1 and got.find("A=B") is None
    with pytest.raises(ODValidationError, match="the likest are A=b"):
        got.table("A=c")


@pytest.mark.parametrize("code, token", [(3, "3"), ("s", "S"), (" d ", "D")])
def test_codes(code, token):
    assert type_code(code) == token


@pytest.mark.parametrize("code", [10, "10", True, None, "Z", -1, 2.0])
def test_bad_codes(code):
    with pytest.raises(ODValidationError) as e:
        type_code(code)
    assert e.value.kind == "invalid_type_code"


ROW = codec.record(1, 1, codec.encode(np.array([1.0, 2.0]), "2"))
LAST = codec.record(2, 1, codec.encode(np.array([3.0, 4.0]), "2"))


@pytest.mark.parametrize("data, kind", [
    (b"", "unexpected_eof"),
    (b"\x03\0\0\0", "invalid_header_length"),
    (struct.pack("<I", 500) + b"x", "unexpected_eof"),
    (raw_header(par=b"PAR M=1\0"), "invalid_par"),
    (raw_header(par=b"PAR Zones=2\0"), "invalid_par"),
    (raw_header(par=b"PAR Zones=0 M=1\0"), "invalid_par"),
    (raw_header(par=b"PAR Zones=2 M=0\0"), "invalid_par"),
    (raw_header(par=b"PAR Zones=x M=1\0"), "invalid_par"),
    (raw_header(par=b"PAR Zones=2 M=2\0", mvr=b"MVR 3\0A=2\0B=2\0C=2\0"), "table_count_mismatch"),
    (raw_header(mvr=b"MVR 1\0T=Z\0"), "invalid_type_code"),
    (raw_header(mvr=b"MVR 1\0T\0"), "invalid_mvr"),
    (raw_header(mvr=b"MVR 1\0T=2\0U=2\0"), "invalid_mvr"),
    (raw_header(marker=b"DATA"), "missing_row_marker"),
    (raw_header() + b"\x01\0\x01\x01\0", "invalid_chunk_size"),
    (raw_header() + codec.record(1, 1, b"\0\x80\0"), "invalid_preamble"),
    (raw_header() + codec.record(2, 1, b"\x80\x80\0"), "row_order_violation"),
    (raw_header() + codec.record(3, 1, b"\x80\x80\0"), "invalid_row_index"),
    (raw_header() + codec.record(1, 2, b"\x80\x80\0"), "table_index_out_of_range"),
    (raw_header() + codec.record(1, 1, b"\x80\x80\x81"), "invalid_descriptor"),
    (raw_header(mvr=b"MVR 1\0T=S\0") + codec.record(1, 1, b"\x80\x80\x80"), "invalid_descriptor"),
    (raw_header() + codec.record(1, 1, b"\x80\x80\x80\0\0"), "zero_run_count"),
    (raw_header() + codec.record(1, 1, b"\x80\x80\x80\x03\x80\x01"), "plane_size"),
    (raw_header() + codec.record(1, 1, b"\x80\x80\x80\x02\0\x01"), "unexpected_eof"),
    (raw_header() + codec.record(1, 1, b"\x80\x80\0\0"), "trailing_bytes"),
    (raw_header() + codec.record(1, 1, b"\x80"), "unexpected_eof"),
    (raw_header(mvr=b"MVR 1\0T=S\0") + codec.record(1, 1, b"\x80\x80\xf8" + b"\x02\x80\0" * 4 + b"\x02\x80\x01"), "invalid_float32_marker"),
    (raw_header() + ROW + LAST + b"more", "trailing_bytes"),
    ((raw_header() + ROW + LAST)[:-1], "unexpected_eof"),
])
def test_rejected(data, kind):
    with pytest.raises(ODError) as e:
        decoded(data)
    assert e.value.kind == kind


def test_payload_too_large():
    with pytest.raises(ODError) as e:
        codec.encode(np.frombuffer(np.random.default_rng(0).bytes(72_000)), "D")
    assert e.value.kind == "payload_too_large" and e.value.category == "writer"


def test_errors_survive_text_and_pickle():
    import pickle

    e = od_error("plane_size", "5 bytes", 77)
    assert isinstance(e, ODParseError) and pickle.loads(pickle.dumps(e)).offset == 77
    found = from_text(f"Traceback ...\n{e}\n")
    assert (found.kind, found.offset) == ("plane_size", 77) and from_text("kind=nothing") is None


@pytest.mark.parametrize("zones, tables, kind", [
    (0, [("T", "2")], "invalid_zone_count"), (32_001, [("T", "2")], "invalid_zone_count"), (True, [("T", "2")], "invalid_zone_count"),
    (2, [], "invalid_table_count"), (2, [("", "2")], "invalid_table_name"), (2, [("é", "2")], "invalid_table_name"), (2, ["T"] * 256, "invalid_table_count"),
])
def test_what_cannot_be_written(zones, tables, kind):
    with pytest.raises(ODValidationError) as e:
        ODHeader(zones, table_infos(tables)).checked()
    assert e.value.kind == kind
