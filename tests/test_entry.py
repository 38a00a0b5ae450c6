import __spark_entry__
from lavra import catalog

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() == 1


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_own_queries_keep_their_schema(spark):
    for name, query in catalog.QUERIES.items():
        df = query(spark, SF)
        assert df.columns and len(set(df.columns)) == len(df.columns), name
