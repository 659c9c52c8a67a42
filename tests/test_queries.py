"""Every registered query of the library against its SQL on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from trajlake import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(smallest):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{smallest}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list:
    def plain(v):
        if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return None
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(name, spark, smallest, duck):
    got = plans.QUERIES[name](spark, smallest).toPandas()
    assert len(got)
    assert rows(got) == rows(duck.execute(plans.ORACLES[name]).df())


def test_flagship(spark, smallest):
    got = {r.kind: r for r in plans.flagship(spark, smallest).collect()}
    assert set(got) == {"positive", "time_swap", "flip"} and len({r.n_rows for r in got.values()}) == 1
    assert 0 < got["positive"].mean_x < 1 and got["flip"].mean_x == -got["positive"].mean_x
