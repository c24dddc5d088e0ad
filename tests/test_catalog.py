from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry

SMALL = Path("/root/testdata/sf0.001")
SAMPLE = (
    "usable_overlap",
    "anomaly_counts",
    "corr_by_month",
    "dataset_build",
    "gap_runs",
    "holdout_tail",
    "cell_temp_cf",
    "feature_table",
    "climatology",
    "run_results",
)

needs_tables = pytest.mark.skipif(not SMALL.exists(), reason="driver tables absent")


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_tables
@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tools.check_oracle import TABLES, compare

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = entry.queries()[name](spark, str(SMALL)).toPandas()
    assert len(got) and compare(got, con.execute(entry.oracle_sql()[name]).df()) == "ok"


@needs_tables
def test_entry_scores_six_forecasters(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 12 and all(r["n"] > 0 for r in rows)
