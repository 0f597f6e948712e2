import pytest
from pyspark.sql import functions as F

from monthloom import staging
from monthloom.operators.contracts import ContractViolation
from monthloom.sources import scans, sinks
from tests.conftest import month_ends


@pytest.fixture()
def rows(make):
    return make([(d, p, 0.1 * p) for d in month_ends("2020-01-31", 4) for p in (1, 2)],
                "formation_date DATE, permno BIGINT, v DOUBLE")


def _runner(rows, calls):
    def compute(months):
        calls.append(sorted(r[0].isoformat() for r in months.collect()))
        return rows.join(months, "formation_date", "left_semi").groupBy("formation_date").agg(
            F.sum("v").alias("v"))
    return compute


def test_resume_computes_only_new_months(spark, rows, tmp_path):
    path, calls = str(tmp_path / "m"), []
    early = rows.where("formation_date < DATE '2020-03-01'")
    sinks.resume_months(spark, path, early, _runner(early, calls), run_key="k")
    done = sinks.resume_months(spark, path, rows, _runner(rows, calls), run_key="k")
    again = sinks.resume_months(spark, path, rows, _runner(rows, calls), run_key="k")
    assert [len(c) for c in calls] == [2, 2, 0]
    assert done.count() == again.count() == 4
    with pytest.raises(ContractViolation):
        sinks.resume_months(spark, path, rows, _runner(rows, calls), run_key="other")


def test_read_through_and_refresh(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.read_through(spark, path, lambda: rows).count() == 8
    assert sinks.read_through(spark, path, lambda: rows.limit(1)).count() == 8
    assert sinks.read_through(spark, path, lambda: rows.limit(1), refresh=True).count() == 1


def test_csv_round_trip_is_lossless(spark, make, tmp_path):
    values = [0.1, 1 / 3, 1e-300, 123456789.123456789, -2.5e17]
    df = make([(i, v) for i, v in enumerate(values)], "i INT, v DOUBLE")
    path = sinks.write_csv(df, str(tmp_path / "c"))
    back = {int(r.i): float(r.v) for r in spark.read.option("header", True).csv(path).collect()}
    assert [back[i] for i in range(len(values))] == values


def test_projected_scan(spark, rows, tmp_path):
    path = sinks.write_parquet(rows, str(tmp_path / "p"))
    assert scans.projected_scan(spark, path, ["permno"], ["v", "none"]).columns == ["permno", "v"]
    with pytest.raises(ContractViolation):
        scans.projected_scan(spark, path, ["missing"])


def test_fallback_source(spark, rows):
    rows.createOrReplaceTempView("known_rows")
    take = scans.first_available
    assert take(spark, "known_rows", lambda t: t, lambda: rows.limit(0)).count() == 8
    assert take(spark, "unknown_rows", lambda t: t, lambda: rows.limit(0)).count() == 0
    with pytest.raises(ContractViolation):
        take(spark, "unknown_rows", lambda t: t, lambda: rows, allow_fallback=False)


def test_staging_uses_the_named_directory(rows, shared_dir):
    staged = staging.stage(rows, "rows")
    assert all(str(shared_dir) in f for f in staged.inputFiles()) and staged.count() == 8


def test_a_cluster_must_name_its_directory():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    with pytest.raises(RuntimeError):
        staging.shared_root(Session())


def test_increments_are_accepted_and_changed_inputs_refused(spark, rows, tmp_path):
    path, calls = str(tmp_path / "m"), []
    months = sorted(r[0] for r in rows.select("formation_date").distinct().collect())
    for n in (1, 2, 4):
        part = rows.where(F.col("formation_date") <= F.lit(months[n - 1]))
        sinks.resume_months(spark, path, part, _runner(part, calls), {"alpha": 0.1})
    assert [len(c) for c in calls] == [1, 1, 2]
    with pytest.raises(ContractViolation, match="another run"):
        sinks.resume_months(spark, path, rows, _runner(rows, calls), {"alpha": 0.2})
    changed = rows.unionByName(rows.limit(1))
    with pytest.raises(ContractViolation, match="have changed"):
        sinks.resume_months(spark, path, changed, _runner(changed, calls), {"alpha": 0.1})


def test_parts_are_replaced_and_the_others_stay(spark, make, tmp_path):
    path = str(tmp_path / "p")
    sinks.append_parts(make([("a", 1), ("b", 2)], "k STRING, v INT"), path, "k")
    sinks.append_parts(make([("b", 3)], "k STRING, v INT"), path, "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]
