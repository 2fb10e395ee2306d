import __spark_entry__ as entry


def test_names_match_and_the_flagship_runs(spark):
    known, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(known) and len(known) > 100
    assert entry.entry(spark).count() > 0
