"""Oracle SQL in the output layout of the registered queries."""
from __future__ import annotations

from oracle.tables import with_tables

BODIES: dict[str, str] = {}


def body(name: str, sql: str) -> None:
    BODIES[name] = sql.strip()


def _cell(name: str, kind: str) -> str:
    q = f'"{name}"'
    if kind == "d":
        return f"strftime(CAST({q} AS DATE), '%Y-%m-%d') AS {q}"
    if kind == "i":
        return f"CAST({q} AS BIGINT) AS {q}"
    if kind == "b":
        return f"CAST({q} AS BOOLEAN) AS {q}"
    if kind:
        # Adding zero turns -0.0 into 0.0.
        return f"round(CAST({q} AS DOUBLE), {kind}) + 0.0 AS {q}"
    return f"CAST({q} AS VARCHAR) AS {q}"


def render(name: str, fields: list[tuple[str, str]]) -> str:
    cells = ", ".join(_cell(n, k) for n, k in fields)
    return with_tables(f"SELECT {cells} FROM ({BODIES[name]}) AS result")
