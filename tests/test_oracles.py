"""Queries against their SQL on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"
NAMES = "p1_found p3_found p3_sessions history_summary history_by_profile command_hotspots budget_suggestions totals_fold_combine compact_lines fold_similar severity_histogram log_message_dedup usage_session_rollup usage_window_attribution usage_report multiset_line_diff hint_lookup rare_value_rows_history path_tree diff_stats layer_states test_results stream_event_rates".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone='UTC'")
    for p in glob.glob(ROOT + "/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, con, name):
    df = entry.queries()[name](spark, ROOT)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    pick = lambda names: sorted(range(len(names)), key=lambda i: names[i])
    a, b = pick(df.columns), pick(cols)
    left = sorted((tuple(norm(r[i]) for i in a) for r in df.collect()), key=repr)
    assert left == sorted((tuple(norm(r[i]) for i in b) for r in cur.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
