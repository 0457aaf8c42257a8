"""The driver contract."""

import __spark_entry__ as entry


def test_names_agree():
    names, sql = set(entry.queries()), entry.oracle_sql()
    assert set(sql) <= names and len(names) > 100
    assert all(isinstance(text, str) and text.strip() for text in sql.values())


def test_flagship_schema(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["project_code", "reporting_period"] and df.count() > 0
