"""The driver contract."""

import __spark_entry__ as contract


def test_entry_returns_rows(spark):
    df = contract.entry(spark)
    rows = df.collect()
    assert rows and df.schema.fieldNames()[0] == "product_id"
    money = [r["revenue_at_risk"] for r in rows]
    assert money == sorted(money, reverse=True)


def test_oracles_belong_to_queries():
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) >= 100
