"""Driver contract."""

import __spark_entry__ as entry

ROWS_ONLY = set()


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"run", "domain", "actual", "predicted", "n_correct", "prop_correct"}
    assert df.count() > 0


def test_every_query_has_an_oracle_but_model_fitting():
    extra = set(entry.llm.QUERIES) if entry.llm else set()
    qs, ors = set(entry.queries()) - extra, set(entry.oracle_sql()) - extra
    assert qs - ors == ROWS_ONLY
    assert len(qs) >= 60
