"""The scan of offsets: equal costs are equal on both sides, and a first cost of zero has no ratio."""

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import oracle_sql, queries
from bedtrace.operators import align as L
from tests.oracle import compare


def test_cost_does_not_hang_on_the_order_of_rows(spark):
    squares = [0.1, 0.7, 0.3, 1e3 + 0.1, 0.6]
    rows = [("a", o, v) for o, vs in ((0.0, squares), (1.0, squares[::-1]), (2.0, squares[2:] + squares[:2])) for v in vs]
    scan = L.shift_scan(spark.createDataFrame(rows, "g string, offset double, mismatch double").coalesce(1), ["g"], 6).collect()
    assert len({r.cost for r in scan}) == 1 and not any(r.is_minimum for r in scan)


@pytest.fixture(scope="module")
def flat_events(tmp_path_factory):
    """A hundred users with one knot each, so that every offset costs the same, and one whose best offset costs nothing."""
    start, rows = pd.Timestamp("2024-01-02"), []
    for u in range(100):
        rows += [(u, "view", 3.0, 7.77)] + [(u, "click", 1.0 + k, round(0.1 + 13.37 * ((k * 7 + u) % 11), 2)) for k in range(12)]
    rows += [(100, "view", h, v) for h, v in ((0, 10.0), (10, 20.0), (20, 10.0), (30, 19.0), (40, 5.0))] + [(100, "click", 10, 20.0)]
    d = pd.DataFrame(rows, columns=["user_id", "event_type", "h", "value"])
    d["ts"] = (start + pd.to_timedelta(d.pop("h"), unit="h")).astype("datetime64[us]")
    d["event_id"] = range(len(d))
    folder = tmp_path_factory.mktemp("flat")
    d.to_parquet(folder / "events.parquet", index=False)
    return str(folder)


def test_equal_offsets_and_zero_cost_match_sql(spark, flat_events):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{flat_events}/events.parquet')")
    df = queries()["d39_shift_scan"](spark, flat_events)
    assert compare("d39_shift_scan", df, oracle_sql()["d39_shift_scan"], con) == []
    (row,) = df.collect()
    assert (row.user_id, row.first_offset, row.first_cost, row.second_offset, row.ratio) == (100, 0.0, 0.0, 20.0, None)
