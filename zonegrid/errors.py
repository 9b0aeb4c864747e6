"""Errors: one class for each category, each carrying a stable kind and, where known, a byte offset."""

from __future__ import annotations

import re

#: Kinds by category (fixed values).
KINDS = {
    "io": ["io"],
    "parse": [
        "invalid_header_length", "invalid_par", "invalid_mvr", "missing_row_marker", "table_count_mismatch",
        "invalid_row_index", "row_order_violation", "invalid_preamble", "invalid_descriptor", "plane_size",
        "zero_run_count", "invalid_float32_marker", "invalid_chunk_size", "trailing_bytes", "unexpected_eof",
    ],
    "validation": [
        "invalid_type_code", "table_not_found", "table_index_out_of_range", "invalid_zone_count",
        "invalid_table_count", "zone_count_mismatch", "shape_mismatch", "invalid_table_name",
        "invalid_od", "duplicate_od", "missing_od",
    ],
    "writer": ["payload_too_large", "writer_finished", "writer_position_mismatch", "incomplete_matrix"],
}


class ODError(Exception):
    """A matrix can't be read, checked or written; kind says why, offset where in the file."""

    category = ""

    def __init__(self, kind: str, message: str = "", offset: int | None = None) -> None:
        self.kind, self.message, self.offset = kind, message, offset
        where = "" if offset is None else f" offset={offset}"
        super().__init__(f"kind={kind}{where}: {message}" if message else f"kind={kind}{where}")

    def __reduce__(self) -> tuple:
        return type(self), (self.kind, self.message, self.offset)


class ODIoError(ODError):
    category = "io"


class ODParseError(ODError):
    category = "parse"


class ODValidationError(ODError):
    category = "validation"


class ODWriterError(ODError):
    category = "writer"


class ODWarning(UserWarning):
    """Something that ingest puts right by itself, such as missing pairs."""


_CLASSES = {c.category: c for c in (ODIoError, ODParseError, ODValidationError, ODWriterError)}
_CATEGORY = {kind: category for category, kinds in KINDS.items() for kind in kinds}


def od_error(kind: str, message: str = "", offset: int | None = None) -> ODError:
    """The error of the class that its kind belongs to."""
    return _CLASSES[_CATEGORY[kind]](kind, message, offset)


def from_text(text: str) -> ODError | None:
    """The first error that a task's message tells of."""
    found = re.search(r"kind=(\w+)(?: offset=(\d+))?(?:: ([^\n]*))?", text)
    if not found or found[1] not in _CATEGORY:
        return None
    return od_error(found[1], found[3] or "", None if found[2] is None else int(found[2]))
