"""Every registered query against its SQL."""

import pytest
from conftest import DATA, same_rows

from threadlake import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    result = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    same_rows(registry.queries()[name](spark, f"{DATA}/sf0.001"), result.fetchall(), names)


def test_every_query_has_sql_but_documents():
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"handoff_documents"}


def test_overview_never_reads_payloads(spark):
    plan = registry.queries()["event_overview"](spark, f"{DATA}/sf0.001")
    scans = [line for line in plan._jdf.queryExecution().executedPlan().toString().splitlines() if "ReadSchema" in line]
    assert scans and not any("role:string,text:string,payload" in s for s in scans)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
