"""Every registered query against its SQL."""

import pytest
from conftest import SF, rows_of

from tessella.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r.asDict(recursive=True).values()) for r in df.collect()]
    cur = duck.execute(SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(columns, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_without_sql_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_imports_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['tessella.llm'] = None; import __spark_entry__ as e; assert e.queries() and not [k for k in e.queries() if k.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__import__("conftest").ROOT)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
