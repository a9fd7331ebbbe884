import duckdb
import pandas as pd
import pytest

from cairnspark.llm import queries


def values(df):
    c = sorted(df.columns)
    return c, sorted((tuple(None if pd.isna(x) else x for x in r) for r in df[c].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_oracle(spark, name, scale):
    sf = f"/root/testdata/{scale}"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert values(queries.queries()[name](spark, sf).toPandas()) == values(con.execute(queries.oracle_sql()[name]).df())
