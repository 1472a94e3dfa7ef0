import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

REPO = Path(entry.__file__).parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 90


def test_entry_has_rows(spark):
    rows = entry.entry(spark)
    assert rows.count() == 81 and set(rows.columns) == {"attribute", "alpha", "size", "share", "reportable"}


def test_the_rest_works_without_the_llm_folders(tmp_path):
    shutil.copytree(REPO / "softseg", tmp_path / "softseg", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


@pytest.mark.parametrize("name", ["consent_filter", "weekday_entropy", "stream_accessibility", "fuzzify_hour_profile", "event_gini", "daily_counts", "membership_distribution"])
def test_some_queries_agree_with_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf)
    want = con.sql(entry.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    plain = lambda rows, cols: sorted(str([round(v, 5) if isinstance(v, float) else v for v in (r[cols.index(n)] for n in names)]) for r in rows)
    assert plain(map(tuple, got.collect()), got.columns) == plain(want.fetchall(), list(want.columns))
