"""Limits over a join of many with many: only rows that the limit can keep are made."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracewell.operators.algebra import Relation, first_matches
from tracewell.plans import templates as T
from tracewell.plans.batch import batch


@pytest.fixture(scope="module")
def many(spark):
    """60 customers, four of a name, that share two demographics; 80 returns each; the last customers have no return."""
    customers = spark.range(60).selectExpr("cast(id as int) as c_customer_sk", "if(id % 15 = 7, null, concat('n', id % 15)) as c_customer_id", "'f' as c_first_name", "'l' as c_last_name", "cast(if(id < 50, id % 2, 2) as int) as c_current_cdemo_sk", "0 as c_current_hdemo_sk", "0 as c_current_addr_sk", "concat('C', id) as prov")
    returns = spark.range(160).selectExpr("cast(id % 2 as int) as sr_cdemo_sk", "concat('SR', id) as prov")
    return {
        "customer": customers,
        "store_returns": returns,
        "customer_address": spark.sql("select 0 as ca_address_sk, 'Union' as ca_city, 'CA1' as prov"),
        "customer_demographics": spark.range(3).selectExpr("cast(id as int) as cd_demo_sk", "concat('CD', id) as prov"),
        "household_demographics": spark.sql("select 0 as hd_demo_sk, 0 as hd_income_band_sk, 'HD1' as prov"),
        "income_band": spark.sql("select 0 as ib_income_band_sk, 1000 as ib_lower_bound, 2000 as ib_upper_bound, 'IB1' as prov"),
    }


def whole(db, n):
    c, r = db["customer"].collect(), db["store_returns"].collect()
    rows = [(x["c_customer_id"], [x["prov"], "CA1", f"CD{x['c_current_cdemo_sk']}", "HD1", "IB1", y["prov"]]) for x in c for y in r if x["c_current_cdemo_sk"] == y["sr_cdemo_sk"]]
    return sorted(rows, key=lambda t: (t[0] is None, t[0] or "", t[1]))[:n]


def test_only_rows_of_the_limit_are_joined(many):
    """50 * 80 matches; at most 3 * 3 of them are made."""
    left = Relation.base(many["customer"], "customer")
    found = first_matches(left, Relation.base(many["store_returns"], "store_returns"), F.col("sr_cdemo_sk") == F.col("c_current_cdemo_sk"), "sr_cdemo_sk", F.col("c_customer_id"), 3)
    assert left.join(Relation.base(many["store_returns"], "store_returns"), F.col("sr_cdemo_sk") == F.col("c_current_cdemo_sk")).df.count() == 4000 and found.df.count() == 9


@pytest.mark.parametrize("limit", [1, 7, 90, 100])
def test_batch_84_equals_the_sorted_whole(spark, many, limit):
    params = {"customers": spark.createDataFrame([(1, "Union", 1000), (2, "Union", 5000), (3, "Union", 0)], "instance int, city string, income int")}
    rows = batch(84, many, params, limit).collect()
    for instance in (1, 3):
        assert sorted(((r["customer_id"], r["prov"]) for r in rows if r["instance"] == instance), key=lambda t: (t[0] is None, t[0] or "", t[1])) == whole(many, limit)
    assert not [r for r in rows if r["instance"] == 2]


@pytest.mark.parametrize("limit", [1, 7, 90])
def test_template_84_equals_the_sorted_whole(many, limit):
    rows = T.ReturningCustomers("Union", 1000, limit=limit).run(many)
    assert [(r["customer_id"], r["prov"]) for r in rows.collect()] == whole(many, limit)
    assert "__leading" in rows._jdf.queryExecution().analyzed().toString()
