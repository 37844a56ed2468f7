import pytest
import typed_rules  # noqa: F401
import typed_small  # noqa: F401
from compare import plain
from typed import CASES


@pytest.mark.parametrize("name", sorted(CASES))
def test_cases(spark, name):
    case = CASES[name]
    given = spark.createDataFrame([(k, *row[0]) for k, row in enumerate(case.rows)], f"event_id long, {case.inputs}")
    found = given.select("event_id", *[c.alias(o) for c, o in zip(case.build(given), case.outputs, strict=True)]).collect()
    got = {r[0]: [plain(x) for x in r[1:]] for r in found}
    assert got == {k: [plain(list(x) if isinstance(x, tuple) else x) for x in row[1]] for k, row in enumerate(case.rows)}
