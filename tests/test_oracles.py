"""Every query with an SQL form gives the rows that DuckDB gives."""

from __future__ import annotations

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_registered_classifiers(spark):
    """All instances of all templates: letters of tokens tell more than sizes do; both tell far more than the tenth that chance does."""
    found = {}
    for name in ("classify_rf", "classify_nb", "classify_witnesses", "classify_with_prefixes"):
        for r in entry.queries()[name](spark, SF).collect():
            assert (r["n_train"], r["n_test"]) == (9607, 2500)
            found[(r["model"], r["representation"])] = r["accuracy"]
    assert found[("rf", "bare_sizes")] >= 0.45 and found[("nb", "bare_set")] >= 0.35
    assert found[("rf", "profile")] >= 0.7 and found[("nb", "set")] >= 0.6 and found[("rf", "profile")] > found[("rf", "bare_sizes")]
