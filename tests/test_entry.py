import __spark_entry__


def test_contract():
    made, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(made) and len(made) >= 75


def test_smoke(spark):
    assert __spark_entry__.entry(spark).count() > 0
