import pytest
from conftest import DATA

from wharfline.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(name, spark, same_as_sql):
    df = catalogue.queries()[name](spark, DATA)
    if name in catalogue.oracle_sql():
        same_as_sql(df, catalogue.oracle_sql()[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_site_names_are_made_by_many_tasks(spark):
    """One split of customers isn't turned into all names in one task."""
    names = catalogue._site_names(spark, DATA)
    explode = names._jdf.queryExecution().sparkPlan().toString().split("Generate", 1)
    assert len(explode) == 2 and "REPARTITION_BY_NUM" in explode[1]
