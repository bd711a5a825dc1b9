"""Every registered query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from annmatrix import contracts

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame, columns):
    def plain(v):
        v = v.tolist() if hasattr(v, "tolist") else v
        return None if v is None or v != v else round(v, 6) + 0.0 if isinstance(v, float) else v

    return sorted((repr(tuple(plain(v) for v in r)) for r in frame[columns].astype(object).itertuples(index=False, name=None)))


def compare(spark, sf_dir, made, sql):
    with duckdb.connect() as db:
        for t in TABLES:
            db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        want = db.execute(sql).df()
    got = made(spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows_of(got, columns) == rows_of(want, columns)


@pytest.mark.parametrize("name", sorted(contracts.ORACLES))
def test_query(spark, sf_dir, name):
    compare(spark, sf_dir, contracts.QUERIES[name], contracts.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(contracts.QUERIES) - set(contracts.ORACLES)))
def test_rows_only(spark, sf_dir, name):
    assert contracts.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(contracts.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
