import importlib

import pytest

from compare import connect, rows

MODULES = ["snapshots", "market", "strategy", "text", "events", "models"]
CASES = [(m, q) for m in MODULES for q in importlib.import_module(f"tidemark.plans.{m}_sql").ORACLE]


@pytest.mark.parametrize("module,query", CASES)
def test_query_equals_its_sql(spark, sf_dir, module, query):
    got = importlib.import_module(f"tidemark.plans.{module}").QUERIES[query](spark, sf_dir).toPandas()
    want = connect(sf_dir).execute(importlib.import_module(f"tidemark.plans.{module}_sql").ORACLE[query]).df()
    assert rows(got) == rows(want)
