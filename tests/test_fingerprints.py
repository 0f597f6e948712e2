"""Fingerprint trees, the digest draw, and contracts in the pass that writes."""
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from monthloom.operators import contracts, universe
from monthloom.operators.fingerprints import MODULUS, changed_ranges, fingerprint_tree
from monthloom.staging import shared_root


def _rows(n):
    return [(k, f"name|{k % 7}" if k % 5 else None, k * 3) for k in range(-40, n)]


def _tree(df, **kwargs):
    return fingerprint_tree(df, "k", ["k", "s", "v"], width=4, fanout=2, depth=3, **kwargs)


def test_tree_equals_plain_hashes(make):
    rows = _rows(90) + [(None, "x", 1), (None, None, None), (5, "again", 1), (5, "again", 1)]
    tree = _tree(make(rows, "k long, s string, v long").repartition(5)).collect()
    got = {(r.level, r.node): (r.n_rows, r.low, r.high, r.first_key, r.last_key) for r in tree}
    want = {}
    for row in rows:
        text = "|".join("-" if x is None else f"{len(str(x))}:{x}" for x in row)
        digest = hashlib.md5(text.encode()).hexdigest()
        for level in range(4):
            node = 0 if level == 3 else None if row[0] is None else row[0] // (4 * 2 ** level)
            n, low, high = want.get((level, node), (0, 0, 0))
            want[level, node] = (n + 1, (low + int(digest[:12], 16)) % MODULUS,
                                 (high + int(digest[12:24], 16)) % MODULUS)
    assert {k: v[:3] for k, v in got.items()} == want
    assert got[1, -1][3:] == (-8, -1) and got[0, None][3:] == (None, None)
    assert got[3, 0][3:] == (-40, 91)


def test_changes_are_located(make):
    schema = "k long, s string, v long"
    rows = _rows(90) + [(None, "x", 1)]
    changed = [r for r in rows if r[0] != 71] + [(200, "new", 1), (None, "x", 1)]
    changed[3] = (changed[3][0], "other", changed[3][2])
    out = changed_ranges(_tree(make(rows, schema)), _tree(make(changed, schema)), 2, 3)
    got = {(r.level, r.node): (r.n_left, r.n_right) for r in out.collect()}
    assert {k: v for k, v in got.items() if k[0] == 0} == {
        (0, -10): (4, 4), (0, 17): (4, 3), (0, 50): (0, 1), (0, None): (1, 2)}
    assert got[3, 0] == (131, 132) and got[2, 12] == (0, 1)
    same = changed_ranges(_tree(make(rows, schema)), _tree(make(rows[::-1], schema)), 2, 3)
    assert same.count() == 0
    empty = make([], schema)
    assert [(r.level, r.n_rows) for r in _tree(empty).collect()] == [(3, 0)]
    assert changed_ranges(_tree(empty), _tree(empty), 2, 3).count() == 0
    assert changed_ranges(_tree(empty), _tree(make(rows, schema)), 2, 3).where(
        "level = 3").first().n_right == 131


def test_values_do_not_run_together(make):
    a = make([(1, "a|1:b", None)], "k long, s string, v long")
    b = make([(1, "a", 1)], "k long, s string, v long")
    assert changed_ranges(_tree(a), _tree(b), 2, 3).count() == 4


@pytest.mark.parametrize("k", [3, 2_000])
def test_draw_by_digest(make, k):
    rows = [(p, f"2020-0{m}-28", p) for m in (1, 2) for p in range(2_300 if m == 1 else 2)]
    rows += [(p, None, p) for p in range(4)]
    df = make(rows, "permno long, formation_date date, v long")
    got = {}
    for r in universe.monthly_hash_sample(df, k, 7).collect():
        got.setdefault(r.formation_date and str(r.formation_date), set()).add(r.permno)

    def least(month, n):
        parts = {p: "|".join(x for x in (str(p), month, "7") if x) for p in range(n)}
        return set(sorted(parts, key=lambda p: hashlib.md5(parts[p].encode()).hexdigest())[:k])

    assert got == {"2020-01-28": least("2020-01-28", 2_300),
                   "2020-02-28": least("2020-02-28", 2), None: least(None, 4)}


def test_draw_sends_few_rows(make):
    df = make([(1, "2020-01-31")], "permno long, formation_date date")
    plan = universe.monthly_hash_sample(df, 20, 1)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_checked_write(spark, make, tmp_path):
    df = make([(1, 2.0), (2, None), (3, -1.0)], "k long, v double")
    path = str(tmp_path / "table")
    rules = {"v is negative": F.col("v") >= 0, "k is missing": F.col("k").isNotNull()}
    with pytest.raises(contracts.ContractViolation, match=r"^v is negative \(2 rows\)$"):
        contracts.write_checked(df, path, rules)
    assert os.listdir(tmp_path) == []
    contracts.write_checked(df.where("v > 0"), path, rules)
    assert spark.read.parquet(path).collect() == [(1, 2.0)]
    with pytest.raises(contracts.ContractViolation):
        contracts.write_checked(df, path, rules)
    assert spark.read.parquet(path).collect() == [(1, 2.0)] and os.listdir(tmp_path) == ["table"]
    contracts.write_checked(df.where("k > 9"), path, rules)
    assert spark.read.parquet(path).count() == 0
    contracts.write_checked(df, path, {})
    assert spark.read.parquet(path).count() == 3


def test_checked_stage_computes_once(spark, make):
    rows = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            rows.add(len(b))
            yield b

    df = make([(i,) for i in range(10)], "k long").mapInPandas(count, "k long")
    out = contracts.stage_checked(df, "once", {"k is negative": F.col("k") >= 0})
    assert out.count() == 10 and rows.value == 10
    with pytest.raises(contracts.ContractViolation):
        contracts.stage_checked(df, "breach", {"k is large": F.col("k") < 5})
    root = shared_root(spark).removeprefix("file://")
    assert not [d for _, ds, _ in os.walk(root) for d in ds if d.startswith("breach")]
