"""What optional parts an installation has."""

from __future__ import annotations

from importlib.util import find_spec

from zonegrid.errors import od_error

#: Libraries whose frames a matrix can be made from or turned into.
FRAMES = ("pandas", "polars")
#: What reads and writes Parquet here: Spark itself, under either name.
ENGINES = ("auto", "spark")


def capabilities() -> dict[str, bool]:
    """Each optional library, and whether it is installed."""
    return {name: find_spec(name) is not None for name in FRAMES}


def parquet_engine(engine: str = "auto") -> str:
    """The engine that will be used; one that is not Spark is an error."""
    if engine not in ENGINES:
        raise od_error("invalid_od", f"Parquet goes through Spark; the engine is {' or '.join(ENGINES)}, not {engine!r}")
    return "spark"
