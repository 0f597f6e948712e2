import pytest

from monthloom.operators import accounting as acc
from monthloom.operators.contracts import ContractViolation
from tests.conftest import month_ends

FUNDA = ("gvkey STRING, datadate DATE, fyear INT, seq DOUBLE, ceq DOUBLE, at DOUBLE, lt DOUBLE, "
         "txditc DOUBLE, txdb DOUBLE, itcb DOUBLE, pstkrv DOUBLE, pstkl DOUBLE, pstk DOUBLE")
ANNUAL = ("permno BIGINT, gvkey STRING, characteristic_year INT, datadate DATE, "
          "book_equity DOUBLE, accounting_available_from DATE")
LINKS = ("gvkey STRING, lpermno BIGINT, linktype STRING, linkprim STRING, linkdt DATE, "
         "linkenddt DATE")


def test_book_equity_fallbacks(make, rows_of):
    df = make(
        [
            ("a", "2019-12-31", 2019, 100.0, None, None, None, 5.0, None, None, 10.0, None, None),
            ("b", "2019-12-31", 2019, None, 80.0, None, None, None, 2.0, 3.0, None, 15.0, 20.0),
            ("c", "2019-12-31", 2019, None, None, 150.0, 50.0, None, None, None, None, None, 5.0),
            ("d", "2019-12-31", 2019, 100.0, None, None, None, None, None, None, None, None, None),
        ],
        FUNDA,
    )
    got = rows_of(acc.book_equity(df), "gvkey", (
        "book_equity", "stockholders_equity_source", "preferred_stock_source",
        "deferred_taxes_source"))
    assert got == {
        "a": (95.0, "seq", "pstkrv", "txditc"),
        "b": (90.0, "ceq_plus_pstk", "pstkl", "txdb_plus_itcb"),
        "c": (95.0, "at_minus_lt", "pstk", "assumed_zero_missing"),
        "d": (100.0, "seq", "assumed_zero_missing", "assumed_zero_missing"),
    }


def test_latest_record_of_a_firm_year_wins(make):
    none = (None,) * 9
    df = make(
        [("a", "2019-06-30", 2019, 1.0, *none), ("a", "2019-12-31", 2019, 2.0, *none),
         ("a", "2020-12-31", 2020, 3.0, *none), (None, "2020-12-31", 2020, 3.0, *none)],
        FUNDA,
    )
    got = {(r.accounting_year, r.book_equity, r.accounting_available_from.isoformat())
           for r in acc.annual_accounting(df).collect()}
    assert got == {(2019, 2.0, "2020-06-30"), (2020, 3.0, "2021-06-30")}
    audit = acc.annual_accounting_audit(df).first().asDict()
    assert audit["annual_rows_input"] == 3
    assert audit["duplicate_firm_year_rows"] == 2
    assert audit["duplicate_firm_year_rows_removed"] == 1


def test_only_links_in_force_match(make):
    annual = make([("a", 2020, "2019-12-31", 5.0)],
                  "gvkey STRING, characteristic_year INT, datadate DATE, book_equity DOUBLE")
    links = make(
        [("a", 1, "LC", "P", "2010-01-01", None), ("a", 2, "LC", "P", "2020-01-01", None),
         ("a", 3, "LD", "P", None, None), ("a", 4, "LC", "P", "2010-01-01", "2018-12-31")],
        LINKS,
    )
    assert [r.permno for r in acc.link_accounting(annual, links).collect()] == [1]


def test_primary_link_beats_secondary(make):
    annual = make([("a", 2020, "2019-12-31", 5.0)],
                  "gvkey STRING, characteristic_year INT, datadate DATE, book_equity DOUBLE")
    links = make([("a", 1, "LU", "C", None, None), ("a", 1, "lc", "p", None, None)], LINKS)
    got = acc.link_accounting(annual, links).collect()
    assert [(r.linktype, r.linkprim) for r in got] == [("LC", "P")]
    assert acc.link_audit(annual, links).first()["duplicate_ccm_rows_resolved"] == 1


def _monthly(make, days, me=100_000.0, permno=1):
    return make([(permno, d, me) for d in days],
                "permno BIGINT, date DATE, market_equity DOUBLE")


def test_december_equity_and_units(make):
    annual = make([(1, "a", 2020, "2019-12-31", 50.0, "2020-06-30")], ANNUAL)
    row = acc.annual_book_to_market(annual, _monthly(make, ["2019-12-31"])).first()
    assert (row.me_dec, row.book_to_market) == (100.0, 0.5)


def test_share_classes_add_up(make, rows_of):
    annual = make([(p, "a", 2020, "2019-12-31", 90.0, "2020-06-30") for p in (1, 2)], ANNUAL)
    features = make([(1, "2019-12-31", 60_000.0), (2, "2019-12-31", 30_000.0)],
                    "permno BIGINT, date DATE, market_equity DOUBLE")
    got = rows_of(acc.annual_book_to_market(annual, features), "permno",
                  ("me_dec", "book_to_market"))
    assert got == {1: (90.0, 1.0), 2: (90.0, 1.0)}


def test_incomplete_denominator_is_missing(make):
    annual = make([(p, "a", 2020, "2019-12-31", 90.0, "2020-06-30") for p in (1, 2)], ANNUAL)
    features = make([(1, "2019-12-31", 60_000.0), (2, "2019-11-30", 30_000.0)],
                    "permno BIGINT, date DATE, market_equity DOUBLE")
    rows = acc.annual_book_to_market(annual, features).collect()
    assert all(r.book_to_market is None and r.me_dec is None for r in rows)


def test_negative_equity_has_no_ratio(make):
    annual = make([(1, "a", 2020, "2019-12-31", -10.0, "2020-06-30")], ANNUAL)
    row = acc.annual_book_to_market(annual, _monthly(make, ["2019-12-31"])).first()
    assert row.book_to_market is None


BM = ("permno BIGINT, gvkey STRING, characteristic_year INT, datadate DATE, "
      "accounting_available_from DATE, book_equity DOUBLE, me_dec DOUBLE, book_to_market DOUBLE")


def test_june_assignment(make, rows_of):
    annual = make([(1, "a", 2020, "2019-12-31", "2020-06-30", 1.0, 1.0, 1.0),
                   (1, "a", 2021, "2020-12-31", "2021-06-30", 2.0, 1.0, 2.0)], BM)
    months = _monthly(make, ["2020-05-31", "2020-06-30", "2021-05-31", "2021-06-30"])
    got = rows_of(acc.assign_monthly(months, annual), "date", "book_to_market")
    assert got == {"2020-05-31": None, "2020-06-30": 1.0, "2021-05-31": 1.0, "2021-06-30": 2.0}


def test_early_record_raises(make):
    annual = make([(1, "a", 2020, "2019-12-31", "2021-06-30", 1.0, 1.0, 1.0)], BM)
    with pytest.raises(ContractViolation):
        acc.assign_monthly(_monthly(make, month_ends("2020-06-30", 2)), annual)


def test_full_ties_of_a_firm_year_do_not_depend_on_row_order(make):
    rows = [("g", "2019-12-31", 2019, 5.0), ("g", "2019-12-31", 2019, 7.0)]
    schema = "gvkey STRING, datadate DATE, fyear INT, seq DOUBLE"
    got = {acc.annual_accounting(make(r, schema)).first()["seq"] for r in (rows, rows[::-1])}
    assert len(got) == 1
