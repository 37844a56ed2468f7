import pytest
from compare import same
from conftest import DATA

from leadloom.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    if name in catalogue.ORACLES:
        assert same(df, duck.execute(catalogue.ORACLES[name]))
    else:
        assert df.columns
        df.count()


def test_entry_points_need_no_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 60"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)
