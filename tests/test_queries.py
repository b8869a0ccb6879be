"""Every query with SQL gives the SQL's rows; the others run."""

import pytest
from conftest import SF, same_rows
from spindrift.plans.catalogue import registry

REG = registry()


@pytest.mark.parametrize("name", [t.name for t in REG.tasks.values() if t.sql])
def test_equals_sql(spark, duck, name):
    same_rows(REG.run(name, spark, SF), duck.execute(REG.tasks[name].sql))


@pytest.mark.parametrize("name", [t.name for t in REG.tasks.values() if not t.sql])
def test_runs(spark, name):
    assert REG.run(name, spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
