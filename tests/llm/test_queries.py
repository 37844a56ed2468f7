import pytest
from compare import same
from conftest import DATA

from leadloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    if name in registry.ORACLES:
        assert same(df, duck.execute(registry.ORACLES[name]))
    else:
        table = {"op2_html_extraction": "pages", "op7_chat_quotes": "conversations"}.get(name, "documents")
        assert df.count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()
