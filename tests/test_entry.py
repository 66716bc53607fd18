import __spark_entry__ as entry


def test_every_query_has_its_sql_or_a_reason():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {"p1_found", "p3_found", "p7_found"} <= set(queries)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["chat_id", "first_msg_id", "last_msg_id", "n_messages"] and df.count() > 0
