"""Matrix headers: zone count, banner, run id and the catalogue of tables, and their bytes."""

from __future__ import annotations

import difflib
import struct
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from typing import BinaryIO

from zonegrid.errors import od_error

#: Limits of what is written (fixed by the format); readers take any count that the header can hold.
MOST_ZONES, MOST_TABLES, MOST_RECORD = 32_000, 255, 1 << 20
DEFAULT_BANNER, DEFAULT_RUN_ID = "MAT PGM=ZONEGRID VER=1", "ZONEGRID"
_MARKER, _RUN = b"ROW\0", "ID="
#: Type codes: decimals of fixed-point tables, S for float32, D for float64 (fixed values).
CODES = ("0", "1", "2", "3", "4", "5", "6", "7", "8", "9", "S", "D")


def type_code(code: object) -> str:
    """A code's token; ints from 0 to 9 and either case are accepted."""
    token = str(code).strip().upper() if isinstance(code, str) or (isinstance(code, int) and not isinstance(code, bool)) else ""
    if token not in CODES:
        raise od_error("invalid_type_code", f"{code!r} is none of {', '.join(CODES)}")
    return token


@dataclass(frozen=True)
class TableInfo:
    """A table's place (from 1), name and type code, and its column in the wide relation."""

    index: int
    name: str
    code: str
    column: str = ""


class TypeCode:
    """Type codes by what they mean; each is the token that files hold."""

    float32, float64 = "S", "D"
    parse = staticmethod(type_code)

    @staticmethod
    def fixed(decimals: int) -> str:
        """Fixed point with 0 to 9 decimals."""
        if isinstance(decimals, bool) or not isinstance(decimals, int) or not 0 <= decimals <= 9:
            raise od_error("invalid_type_code", f"decimals are from 0 to 9, not {decimals!r}")
        return str(decimals)


@dataclass(frozen=True)
class TableSpec:
    """A table to be made: a name that isn't blank, and a type code's token."""

    name: str
    code: str = "D"

    def __post_init__(self) -> None:
        if not isinstance(self.name, str) or not self.name.strip():
            raise od_error("invalid_table_name", f"{self.name!r} is blank or no string")
        object.__setattr__(self, "code", type_code(self.code))

    def __iter__(self):
        return iter((self.name, self.code))


def table(name: str, code: object = "D") -> TableSpec:
    """A table to be made, by name and type code in any form."""
    return TableSpec(name, code)  # type: ignore[arg-type]


def table_infos(specs: Iterable[object]) -> tuple[TableInfo, ...]:
    """Tables from TableInfos, TableSpecs, (name, code) pairs or names (float64), with columns that Spark can tell apart.

    A name that another one equals but for case gets a suffix: T, T__2.
    """
    pairs = []
    for s in specs:
        if isinstance(s, TableInfo):
            pairs.append((s.name, s.code))
        elif isinstance(s, str):
            pairs.append((s, "D"))
        else:
            name, code = s  # type: ignore[misc]
            pairs.append((name, type_code(code)))
    taken, out = {"origin", "destination"}, []
    for i, (name, code) in enumerate(pairs, 1):
        column, k = name or "table", 2
        while column.lower() in taken:
            column, k = f"{name or 'table'}__{k}", k + 1
        taken.add(column.lower())
        out.append(TableInfo(i, name, code, column))
    return tuple(out)


@dataclass(frozen=True)
class ODHeader:
    """What a matrix is, without its cells."""

    zone_count: int
    tables: tuple[TableInfo, ...]
    banner: str = DEFAULT_BANNER
    run_id: str = DEFAULT_RUN_ID

    @property
    def table_count(self) -> int:
        return len(self.tables)

    @property
    def row_count(self) -> int:
        return self.zone_count * self.table_count

    @property
    def names(self) -> list[str]:
        return [t.name for t in self.tables]

    @property
    def columns(self) -> list[str]:
        return [t.column for t in self.tables]

    def find(self, name: str) -> TableInfo | None:
        """The first table of that name, by case."""
        return next((t for t in self.tables if t.name == name), None)

    def table(self, key: str | int) -> TableInfo:
        """A table by name or by place from 0."""
        if isinstance(key, bool) or not isinstance(key, (str, int)):
            raise od_error("table_not_found", f"tables are named by str or int, not {key!r}")
        if isinstance(key, int):
            if not -self.table_count <= key < self.table_count:
                raise od_error("table_index_out_of_range", f"{key} of {self.table_count} tables")
            return self.tables[key]
        if (found := self.find(key)) is None:
            raise od_error("table_not_found", _unknown(key, self.names))
        return found

    def select(self, keys: Sequence[str | int] | str | int | None) -> list[TableInfo]:
        """Tables in the order asked for; none twice, by name or by place."""
        if keys is None:
            return list(self.tables)
        asked = [keys] if isinstance(keys, (str, int)) else list(keys)
        if not asked:
            raise od_error("invalid_table_count", "no table is selected")
        found = [self.table(k) for k in asked]
        if len({t.index for t in found}) < len(found):
            raise od_error("invalid_table_name", "a table is selected twice")
        return found

    def narrowed(self, names: Sequence[str]) -> tuple[ODHeader, list[TableInfo]]:
        """The header of a load of those tables, renumbered in file order, and the tables in the file."""
        if not names:
            raise od_error("invalid_table_count", "no table is selected")
        wanted = {self.table(n).index for n in names}
        own = [t for t in self.tables if t.index in wanted]
        return replace(self, tables=table_infos(own)), own

    def checked(self) -> ODHeader:
        """Itself, if it can be written."""
        if isinstance(self.zone_count, bool) or not isinstance(self.zone_count, int) or not 1 <= self.zone_count <= MOST_ZONES:
            raise od_error("invalid_zone_count", f"{self.zone_count!r} is not from 1 to {MOST_ZONES}")
        if not 1 <= self.table_count <= MOST_TABLES:
            raise od_error("invalid_table_count", f"{self.table_count} is not from 1 to {MOST_TABLES}")
        for t in self.tables:
            if not t.name or not t.name.isascii():
                raise od_error("invalid_table_name", f"{t.name!r} is empty or not ASCII")
            type_code(t.code)
        return self

    def to_bytes(self) -> bytes:
        """The five header records."""
        tail = lambda s: s if s.endswith(b"\0") else s + b"\0"
        mvr = b"".join(f"{t.name}={t.code}".encode() + b"\0" for t in self.tables)
        records = [
            tail(self.banner.encode()),
            tail((_RUN + self.run_id).encode()),
            f"PAR Zones={self.zone_count} M={self.table_count}\0".encode(),
            f"MVR {self.table_count}\0".encode() + mvr,
            _MARKER,
        ]
        return b"".join(struct.pack("<I", len(r) + 4) + r for r in records)


def _unknown(wanted: str, names: Sequence[str]) -> str:
    """What to say of a name that no table has: the tables by likeness to it, the likest first."""
    likeness = {n: difflib.SequenceMatcher(None, wanted.lower(), n.lower()).ratio() for n in names}
    ranked = sorted(likeness, key=lambda n: (-likeness[n], n))[:5]
    return f"{wanted!r} is none of the {len(names)} tables; the likest are {', '.join(ranked)}"


def _text(payload: bytes) -> str:
    return payload.split(b"\0", 1)[0].decode("utf-8", "replace")


def _number(token: str, most: int, kind: str, what: str) -> int:
    digits = token[1:] if token[:1] == "+" else token
    if not digits.isascii() or not digits.isdigit() or int(digits) > most:
        raise od_error(kind, f"invalid {what}: {token}")
    return int(digits)


def _strict(payload: bytes, kind: str) -> str:
    try:
        return payload.decode()
    except UnicodeDecodeError:
        raise od_error(kind, "not UTF-8") from None


def read_header(source: BinaryIO) -> tuple[ODHeader, int]:
    """The header at the start of source, and the offset of the first row."""
    at, records = 0, []
    for number in range(1, 6):
        size = source.read(4)
        if len(size) < 4:
            raise od_error("unexpected_eof", "in the header", at + len(size))
        total = struct.unpack("<I", size)[0]
        if not 4 <= total <= MOST_RECORD:
            raise od_error("invalid_header_length", f"record {number} has size {total}", at)
        payload = source.read(total - 4)
        if len(payload) < total - 4:
            raise od_error("unexpected_eof", "in the header", at + 4 + len(payload))
        records.append(payload)
        at += total
    zones = tables = None
    for token in _strict(records[2].split(b"\0", 1)[0], "invalid_par").split():
        if token.startswith("Zones="):
            zones = _number(token[6:], 65535, "invalid_par", "Zones")
        elif token.startswith("M="):
            tables = _number(token[2:], 255, "invalid_par", "M")
    if not zones or not tables:
        raise od_error("invalid_par", "Zones and M must be there, and above 0")
    tokens = [t for t in records[3].split(b"\0") if t]
    if not tokens or not tokens[0].startswith(b"MVR "):
        raise od_error("invalid_mvr", "no MVR prefix")
    count = _number(_strict(tokens[0][4:], "invalid_mvr"), 255, "invalid_mvr", "count")
    if count != tables:
        raise od_error("table_count_mismatch", f"PAR has {tables} tables, MVR {count}")
    if len(tokens) - 1 != tables:
        raise od_error("invalid_mvr", f"{len(tokens) - 1} tables instead of {tables}")
    pairs = []
    for token in tokens[1:]:
        name, equals, code = _strict(token, "invalid_mvr").rpartition("=")
        if not equals:
            raise od_error("invalid_mvr", f"no = in {code!r}")
        if code.upper() not in CODES:
            raise od_error("invalid_type_code", f"{code!r}")
        pairs.append((name, code))
    if records[4] != _MARKER:
        raise od_error("missing_row_marker", "")
    run = _text(records[1])
    return ODHeader(zones, table_infos(pairs), _text(records[0]), run[len(_RUN) :] if run.startswith(_RUN) else run), at
