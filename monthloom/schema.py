"""Shared names, entity schemas and fixed research constants."""
from __future__ import annotations

# Model contract and labels.
FEATURES = ("log_me", "book_to_market", "mom_12_2")
TARGET = "next_month_return"
FORMATION = "formation_date"
REALIZED = "realized_return_date"
MODEL_COLUMNS = {"Elastic Net": "elastic_net_prediction", "XGBoost": "xgboost_prediction"}
WEIGHTINGS = ("EW", "VW")
BINARY_REGIMES = ("LOW", "HIGH")
THREE_REGIMES = ("LOW", "MIDDLE", "HIGH")
LINK_TYPES = ("LC", "LU")
LINK_PRIMARY = ("P", "C")
PAIRWISE = (("MIDDLE", "LOW"), ("HIGH", "LOW"), ("HIGH", "MIDDLE"))
HAC_LAG = 6
N_PORTFOLIOS = 10
THOUSANDS_PER_MILLION = 1000.0


# Entity schemas as DDL text, as readers accept it.
SECURITY_MONTH = (
    "permno BIGINT, ticker STRING, date DATE, ret DOUBLE, prc DOUBLE, shrout DOUBLE"
)
FUNDAMENTALS = (
    "gvkey STRING, datadate DATE, fyear INT, fyr INT, seq DOUBLE, ceq DOUBLE, at DOUBLE, lt DOUBLE,"
    " txditc DOUBLE, txdb DOUBLE, itcb DOUBLE, pstkrv DOUBLE, pstkl DOUBLE, pstk DOUBLE,"
    " indfmt STRING, datafmt STRING, popsrc STRING, consol STRING, curcd STRING"
)
LINKS = (
    "gvkey STRING, lpermno BIGINT, linktype STRING, linkprim STRING, linkdt DATE, linkenddt DATE"
)
INDEX_DAILY = ("date DATE, vix DOUBLE")
INDEX_CSV = ("DATE STRING, OPEN STRING, HIGH STRING, LOW STRING, CLOSE STRING")
