import __spark_entry__


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    names = __spark_entry__.queries().keys()
    assert __spark_entry__.oracle_sql().keys() <= names and len(names) > 70
