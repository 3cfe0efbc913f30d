import __spark_entry__ as entry


def test_names_match():
    queries, statements = entry.queries(), entry.oracle_sql()
    assert set(statements) <= set(queries)
    assert len(queries) > 60
