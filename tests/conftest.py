import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from crosstide.session import build_session

    s = build_session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def bars_of(spark):
    """bars_of(A=[closes...], B=...): consecutive days from 2024-01-02, volume 1000 unless given as (close, volume)."""
    import datetime as dt

    def make(**series):
        rows = []
        for t, values in series.items():
            for i, v in enumerate(values):
                if v is None:
                    continue
                close, vol = v if isinstance(v, tuple) else (v, 1000)
                rows.append((t, dt.date(2024, 1, 2) + dt.timedelta(days=i), float(close), None if vol is None else int(vol), float(close)))
        return spark.createDataFrame(rows, "ticker string, date date, close double, volume bigint, adj_close double")

    return make


@pytest.fixture(scope="session")
def edges_of(spark):
    from crosstide.operators.graph import load_edges

    return lambda *rows: load_edges(
        spark, [{"parent": p, "child": c, "type": "x", "weight": w} for p, c, w in rows]
    )


def last(df, col, ticker):
    rows = [r for r in df.collect() if r["ticker"] == ticker]
    return max(rows, key=lambda r: r["date"])[col]
