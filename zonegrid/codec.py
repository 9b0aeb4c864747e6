"""Row payloads: run-length coded byte planes, on numpy arrays of one origin's values."""

from __future__ import annotations

import numpy as np

from zonegrid.errors import od_error

_PREAMBLE = b"\x80\x80"
_ZERO, _FULL, _SINGLE = 0x00, 0xFF, 0xF8
#: Longest run of one command, shortest run worth a constant one, longest payload (fixed by the format).
_RUN, _WORTH, MOST_PAYLOAD = 32_767, 3, 65_533
_LARGEST = float(2**32 - 1)


def read_plane(data: bytes, at: int, out: np.ndarray) -> int:
    """Fills out from the commands at data[at:]; returns where they end."""
    filled, size, end = 0, len(out), len(data)
    while filled < size:
        if at + 2 > end:
            raise od_error("unexpected_eof", "in a plane")
        word = data[at] | data[at + 1] << 8
        at += 2
        count = word & 0x7FFF
        if not count:
            raise od_error("zero_run_count", "")
        if filled + count > size:
            raise od_error("plane_size", f"{filled + count} bytes for {size} zones")
        taken = 1 if word & 0x8000 else count
        if at + taken > end:
            raise od_error("unexpected_eof", "in a run")
        out[filled : filled + count] = data[at] if taken == 1 and word & 0x8000 else np.frombuffer(data, np.uint8, count, at)
        at += taken
        filled += count
    return at


def write_plane(plane: np.ndarray) -> bytes:
    """A plane's commands: runs of three bytes or more are constant, what lies between is literal."""
    edges = np.flatnonzero(plane[1:] != plane[:-1]) + 1
    starts = np.concatenate([[0], edges])
    sizes = np.diff(np.append(starts, len(plane)))
    parts, done = [], 0

    def literal(until: int) -> None:
        for lo in range(done, until, _RUN):
            part = plane[lo : min(lo + _RUN, until)]
            parts.append(len(part).to_bytes(2, "little") + part.tobytes())

    for k in np.flatnonzero(sizes >= _WORTH):
        start, size = int(starts[k]), int(sizes[k])
        literal(start)
        while size:
            run = min(size, _RUN)
            if run < _WORTH:
                break  # the rest of a very long run goes with the next literal
            parts.append((run | 0x8000).to_bytes(2, "little") + plane[start : start + 1].tobytes())
            start, size = start + run, size - run
        done = start
    literal(len(plane))
    return b"".join(parts)


def _planes(data: bytes, at: int, zones: int, present: list[bool]) -> np.ndarray:
    out = np.zeros((len(present), zones), np.uint8)
    for plane, there in zip(out, present):
        if there:
            at = read_plane(data, at, plane)
    if at != len(data):
        raise od_error("trailing_bytes", "behind the planes of a row")
    return out


def decode(payload: bytes, code: str, zones: int) -> np.ndarray:
    """One row's values."""
    if len(payload) < 3:
        raise od_error("unexpected_eof", "in a payload")
    if payload[:2] != _PREAMBLE:
        raise od_error("invalid_preamble", payload[:2].hex())
    kind = payload[2]
    if kind == _ZERO:
        if len(payload) > 3:
            raise od_error("trailing_bytes", "behind a zero row")
        return np.zeros(zones)
    if kind == _FULL or code == "D":
        planes = _planes(payload, 3, zones, [bool(kind >> 7 - i & 1) for i in range(8)])
        return np.ascontiguousarray(planes.T).view("<f8")[:, 0]
    if code == "S":
        if kind != _SINGLE:
            raise od_error("invalid_descriptor", f"{kind:#04x} in a table of type S")
        planes = _planes(payload, 3, zones, [True] * 5)
        wrong = np.flatnonzero(planes[4] != 0xFF)
        if len(wrong):
            raise od_error("invalid_float32_marker", f"{planes[4][wrong[0]]:#04x} at {wrong[0]}")
        return np.ascontiguousarray(planes[:4].T).view("<f4")[:, 0].astype(np.float64)
    if kind & 0x07:
        raise od_error("invalid_descriptor", f"{kind:#04x} in a table of type {code}")
    planes = _planes(payload, 3, zones, [bool(kind >> 7 - i & 1) for i in range(5)])
    values = np.ascontiguousarray(planes[:4].T).view("<u4")[:, 0].astype(np.float64)
    signs = planes[4]
    if kind & 0x08:
        values = values / 10.0 ** (signs >> 4)
        values = np.where(signs & 1, -values, values)
    return values


def _full(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values, "<f8").view(np.uint8).reshape(-1, 8).T
    return _PREAMBLE + bytes([_FULL]) + b"".join(map(write_plane, np.ascontiguousarray(planes)))


def fits(values: np.ndarray, code: str) -> bool:
    """Whether a row can be stored under its type code; if not, it is stored as float64, unrounded."""
    if code == "D":
        return True
    if code == "S":
        with np.errstate(over="ignore", invalid="ignore"):
            return not (np.isfinite(values) & np.isinf(values.astype(np.float32))).any()
    with np.errstate(over="ignore", invalid="ignore"):
        return bool((np.isfinite(values) & (np.abs(np.rint(values * 10.0 ** int(code))) <= _LARGEST)).all())


def encode(values: np.ndarray, code: str) -> bytes:
    """One row's payload."""
    values = np.asarray(values, np.float64)
    if not (values != 0).any():
        out = _PREAMBLE + bytes([_ZERO])
    elif not fits(values, code):
        out = _full(values)
    elif code == "D":
        planes = np.ascontiguousarray(np.ascontiguousarray(values, "<f8").view(np.uint8).reshape(-1, 8).T)
        there = planes.any(axis=1)
        out = _PREAMBLE + bytes([sum(0x80 >> i for i in np.flatnonzero(there))]) + b"".join(write_plane(p) for p, t in zip(planes, there) if t)
    elif code == "S":
        planes = np.ascontiguousarray(values.astype("<f4").view(np.uint8).reshape(-1, 4).T)
        out = _PREAMBLE + bytes([_SINGLE]) + b"".join(map(write_plane, [*planes, np.full(len(values), 0xFF, np.uint8)]))
    else:
        scaled = np.rint(values * 10.0 ** int(code))
        size = np.abs(scaled).astype("<u4")
        planes = list(np.ascontiguousarray(size.view(np.uint8).reshape(-1, 4).T))
        planes.append(np.where(size > 0, int(code) << 4 | (scaled < 0), 0).astype(np.uint8))
        there = [bool(p.any()) for p in planes]
        out = _PREAMBLE + bytes([sum(0x80 >> i for i, t in enumerate(there) if t)]) + b"".join(write_plane(p) for p, t in zip(planes, there) if t)
    if len(out) > MOST_PAYLOAD:
        raise od_error("payload_too_large", f"{len(out)} bytes")
    return out


def record(origin: int, table: int, payload: bytes) -> bytes:
    return origin.to_bytes(2, "little") + bytes([table]) + (len(payload) + 2).to_bytes(2, "little") + payload
