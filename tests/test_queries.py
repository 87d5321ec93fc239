"""Every registered query of the library against its SQL on the smallest tables."""

import os
import re

import duckdb
import pandas as pd
import pytest

from panelforge.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels conversations sales client_changes".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list:
    def cell(v):
        if isinstance(v, (list, tuple)) or getattr(v, "ndim", 0):
            return tuple(cell(x) for x in v)
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return "~"
        return round(float(v), 6) if not isinstance(v, (str, bool)) and hasattr(v, "__float__") else str(v)

    return sorted((tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_the_matrix_of_all_tickers_has_every_name_and_week(spark, duck):
    wide = registry.QUERIES["return_matrix_all"](spark, SF)
    names, weeks = duck.execute("SELECT count(DISTINCT p_brand), count(DISTINCT date_trunc('week', l_shipdate)) FROM lineitem JOIN part ON l_partkey = p_partkey").fetchone()
    assert (len(wide.columns) - 1, wide.count()) == (names, weeks)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_transcript_tickers_agree_with_brute_force(spark, tmp_path):
    from panelforge.functions import text as X

    planted = ["Acme Corp (NASDAQ: ACME) call", "Acme Corp (a) then (XYZ)", "nyse: ibm results", "see (NYSE:THE) and (NYSE:GE) now", "Ticker: msft here", "symbol AAPL", "(ABCDEF) (AB)", "  " + "x " * 499 + "(NYSE: LATE)", "", None]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs.unionByName(spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(planted)], "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")

    def brute(t):
        for p in X.TICKER_PATTERNS:
            for hit in re.findall(p, (t or "").strip(" ")[:1000], re.I):
                if re.fullmatch("[A-Z]{2,5}", hit.upper()) and hit.upper() not in X.NEVER_TICKERS:
                    return hit.upper()
        return None

    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    want = sorted((r["doc_id"], w, w and "transcript") for r in rows for w in [brute(r["text"])])
    got = sorted(tuple(r) for r in registry.QUERIES["transcript_ticker"](spark, str(tmp_path)).collect())
    assert got == want and sum(w is not None for _, w, _ in want) >= 3
