import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from monthloom.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def shared_dir(tmp_path_factory):
    return tmp_path_factory.mktemp("shared")


@pytest.fixture(scope="session")
def spark(shared_dir):
    session = local_session(8, "4g", {"spark.checkpoint.dir": f"file://{shared_dir}"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Table from rows and a DDL schema; ISO text becomes a date where the schema says so."""

    def build(rows, schema):
        kinds = [part.split()[-1].upper() for part in schema.split(",")]
        fixed = [
            tuple(dt.date.fromisoformat(v) if k == "DATE" and isinstance(v, str) else v
                  for v, k in zip(r, kinds, strict=True))
            for r in rows
        ]
        return spark.createDataFrame(fixed, schema)

    return build


@pytest.fixture(scope="session")
def rows_of():
    """Collect a table as a dict from key to value(s)."""

    def collect(df, key, value):
        def pick(row, names):
            if isinstance(names, str):
                v = row[names]
                return v.isoformat() if isinstance(v, dt.date) else v
            return tuple(pick(row, n) for n in names)

        return {pick(r, key): pick(r, value) for r in df.collect()}

    return collect


def month_ends(first: str, n: int) -> list[str]:
    y, m = int(first[:4]), int(first[5:7])
    out = []
    for i in range(n):
        k = (m - 1 + i + 1)
        nxt = dt.date(y + k // 12, k % 12 + 1, 1)
        out.append((nxt - dt.timedelta(days=1)).isoformat())
    return out
