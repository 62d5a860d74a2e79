"""Every query that has SQL gives the rows of its SQL."""

import duckdb
import pytest

from leafmill.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    from pathlib import Path

    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for path in Path(SF).iterdir():
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return db


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    frame = catalog.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(map(str, frame.select(*columns).toPandas().astype(object).to_records(index=False).tolist()))
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(want.columns) == columns
    assert got == sorted(map(str, want[columns].astype(object).to_records(index=False).tolist()))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
