"""Registered queries against their SQL on the smallest tables; the whole list runs in the correctness check."""

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["flagship", "S3_inferred_records", "S6_fundamentals", "L8_long_series_coefficients", "C24_calc_grid", "J2_asof_known", "G1_pixel_line", "O3_page_by_number", "P3_repair", "C16_regression", "C23_calc_waves", "J2_asof", "J5_align_asof", "T10_trades", "T13_summary", "G8_stacked", "O2_sorted_page", "L1_long_series_average"]


def same(a, b):
    a, b = (d[sorted(d.columns)].astype(object).where(d.notna(), None) for d in (a, b))
    key = lambda d: sorted((tuple(str(round(v, 3)) if isinstance(v, float) else str(v) for v in r) for r in d.itertuples(index=False)))
    return list(a.columns) == list(b.columns) and key(a) == key(b)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, sql, name):
    import __spark_entry__ as entry

    assert same(entry.queries()[name](spark, DATA).toPandas(), sql.execute(entry.oracle_sql()[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
