"""Provenance operators and templates on small tables with their edge cases."""

from __future__ import annotations

import datetime as dt
import subprocess
import sys
from collections import Counter
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.functions import features
from tracewell.operators.algebra import Relation, share, top
from tracewell.plans import templates as T
from tracewell.plans.batch import arm_params, batch, revenue_params, revenue_share_batch, revenue_witnesses, store_quantity_batch
from tracewell.plans.sqltext import discover, run_text, translate
from tracewell.sources.annotate import annotate, number_rows, write_annotated
from tracewell.sources.schemas import RELATIONS, load, schema


def make(spark, relation, *rows):
    """Rows as dictionaries; missing columns are null, prov is the prefix-free position unless given."""
    names = schema(relation).names
    return spark.createDataFrame([tuple({"prov": f"{relation}{k}"} .get(c) if c == "prov" and "prov" not in r else r.get(c) for c in names) for k, r in enumerate(rows)], schema(relation))


@pytest.fixture(scope="module")
def db(spark):
    d = Decimal
    day = dt.date(1997, 8, 9)
    dates = [{"d_date_sk": k, "d_date": day + dt.timedelta(days=x), "d_year": 1997} for k, x in enumerate((0, 30, 31))]
    items = [{"i_item_sk": k, "i_item_id": i, "i_item_desc": "d", "i_category": "Music", "i_class": c, "i_current_price": d("50.00"), "i_manufact_id": 7} for k, (i, c) in enumerate((("A", "x"), ("B", "x"), ("C", "zero"), ("A", "y")))]
    web = [{"ws_item_sk": i, "ws_sold_date_sk": t, "ws_ext_sales_price": d(p), "ws_order_number": n, "ws_quantity": 2, "ws_sales_price": d("100.00"), "ws_net_profit": d("150.00"), "ws_web_page_sk": 0} for n, (i, t, p) in enumerate(((0, 0, "10.00"), (0, 1, "20.00"), (1, 1, "70.00"), (1, 2, "999.00"), (2, 0, "0.00")))]
    cds = [{"cd_demo_sk": k, "cd_marital_status": m, "cd_education_status": e, "cd_gender": "M", "cd_dep_count": 1} for k, (m, e) in enumerate((("D", "Primary"), ("M", "College"), ("D", "Primary")))]
    address = [{"ca_address_sk": k, "ca_country": "United States", "ca_state": s, "ca_county": c, "ca_city": "Union"} for k, (s, c) in enumerate((("VT", None), (None, "q"), ("VT", "q")))]
    return {
        "date_dim": make(spark, "date_dim", *dates),
        "item": make(spark, "item", *items),
        "web_sales": make(spark, "web_sales", *web),
        "customer_demographics": make(spark, "customer_demographics", *cds),
        "customer_address": make(spark, "customer_address", *address),
        "web_page": make(spark, "web_page", {"wp_web_page_sk": 0}),
        "reason": make(spark, "reason", {"r_reason_sk": 0, "r_reason_desc": "a reason of some length 1"}, {"r_reason_sk": 1, "r_reason_desc": "a reason of some length 2"}),
        "web_returns": make(spark, "web_returns", *[{"wr_item_sk": i, "wr_order_number": n, "wr_refunded_cdemo_sk": 0, "wr_returning_cdemo_sk": c, "wr_refunded_addr_sk": 0, "wr_reason_sk": r, "wr_fee": d("1.00"), "wr_refunded_cash": d("2.00")} for i, n, c, r in ((0, 0, 0, 0), (0, 1, 2, 1), (1, 2, 1, 1))]),
        "store": make(spark, "store", {"s_store_sk": 0}),
        "household_demographics": make(spark, "household_demographics", {"hd_demo_sk": 0, "hd_dep_count": 3, "hd_income_band_sk": 0}),
        "income_band": make(spark, "income_band", {"ib_income_band_sk": 0, "ib_lower_bound": 100, "ib_upper_bound": 50100}),
        "store_sales": make(spark, "store_sales", *[{"ss_sold_date_sk": 0, "ss_store_sk": 0, "ss_cdemo_sk": 0, "ss_hdemo_sk": 0, "ss_addr_sk": 0, "ss_item_sk": 0, "ss_quantity": q, "ss_sales_price": d(p), "ss_net_profit": d("150.00"), "ss_ext_sales_price": d("1.00"), "ss_ext_wholesale_cost": d("2.00")} for q, p in ((3, "100.00"), (5, "150.00"), (7, "99.99"))]),
        "customer": make(spark, "customer", {"c_customer_sk": 0, "c_customer_id": "AA", "c_first_name": None, "c_last_name": "L", "c_current_addr_sk": 0, "c_current_cdemo_sk": 0, "c_current_hdemo_sk": 0, "c_birth_month": 6, "c_birth_year": 1960}, {"c_customer_sk": 1, "c_customer_id": "BB", "c_first_name": "F", "c_last_name": None, "c_current_addr_sk": 2, "c_current_cdemo_sk": 1, "c_current_hdemo_sk": 0, "c_birth_month": 6, "c_birth_year": 1970}),
        "store_returns": make(spark, "store_returns", {"sr_cdemo_sk": 0}, {"sr_cdemo_sk": 0}),
        "catalog_sales": make(spark, "catalog_sales", *[{"cs_item_sk": i, "cs_sold_date_sk": 0, "cs_bill_cdemo_sk": 0, "cs_bill_customer_sk": c, "cs_quantity": q, "cs_list_price": d("1.00"), "cs_coupon_amt": d("0.00"), "cs_sales_price": d("1.00"), "cs_net_profit": d("1.00"), "cs_ext_sales_price": d("1.00")} for i, c, q in ((0, 0, 1), (1, 1, 2), (3, 0, 4))]),
        "inventory": make(spark, "inventory", *[{"inv_item_sk": 0, "inv_date_sk": k, "inv_quantity_on_hand": n} for k, n in ((0, 100), (1, 500), (2, 501))]),
    }


STATES = (("VT", "ME", "NH"), ("OH", "KY", "TN"), ("OR", "CA", "NV"))
PEOPLE = (("D", "Primary"), ("M", "College"), ("S", "Unknown"))


def test_revenue_share(db):
    rows = {r["i_item_id"]: r for r in T.RevenueShare("web_sales", ("Music",), dt.date(1997, 8, 9)).run(db).collect()}
    assert set(rows) == {"A", "B", "C"}  # the window holds its 30th day, not its 31st
    assert rows["A"]["itemrevenue"] == 30 and rows["A"]["revenueratio"] == 30.0 and rows["B"]["revenueratio"] == 70.0
    assert rows["C"]["revenueratio"] != rows["C"]["revenueratio"]  # 0 / 0
    assert sorted(map(tuple, rows["A"]["prov"])) == [("web_sales0", "item0", "date_dim0"), ("web_sales1", "item0", "date_dim1")]


def test_store_templates(db, spark):
    row = T.StoreQuantity(*T.arms(48, PEOPLE, STATES), year=1997).run(db).first()
    assert row["sum_quantity"] == 8  # both ends of a band belong to it, 99.99 does not
    assert all(len(w) == len(T.WITNESS[48]) for w in row["prov"])
    row = T.StoreAverages(*T.arms(13, PEOPLE, STATES), year=1997).run(db).first()
    assert row["avg_quantity"] == 4.0 and len(row["prov"][0]) == len(T.WITNESS[13])
    empty = T.StoreQuantity(*T.arms(48, PEOPLE, STATES), year=1066).run(db).collect()
    assert len(empty) == 1 and empty[0]["sum_quantity"] is None and empty[0]["prov"] is None


def test_rollup_keeps_data_nulls_apart(db):
    rows = T.CatalogRollup("M", "Primary", (6,), 1997, ("VT",)).run(db).collect()
    leaves = [r for r in rows if r["i_item_id"] and r["ca_country"] and r["ca_state"]]
    assert sum(r["prov"] is not None for r in rows) == len(rows)
    total = rows[-1]
    assert [total[c] for c in ("i_item_id", "ca_country", "ca_state", "ca_county")] == [None] * 4 and len(total["prov"]) == 3
    assert {(r["ca_county"] is None) for r in leaves} == {True, False}
    assert len(T.CatalogRollup("F", "Primary", (6,), 1997, ("VT",)).run(db).collect()) == 1


def test_stock_is_a_product(db):
    rows = T.StockedItems("catalog_sales", 30, dt.date(1997, 8, 9), (7,)).run(db).collect()
    assert [(r["i_item_id"], len(r["prov"])) for r in rows] == [("A", 2)]
    assert all(len(w) == 4 for w in rows[0]["prov"])


def test_customers(db):
    rows = T.ReturningCustomers("Union", 100).run(db).collect()
    assert [(r["customer_id"], r["customername"]) for r in rows] == [("AA", "L, ")] * 2
    assert rows[0]["prov"] != rows[1]["prov"] and len(rows[0]["prov"]) == 6
    assert T.witnesses(T.ReturningCustomers("Union", 100).run(db)).first()["witnesses"] == [rows[0]["prov"]]


def test_returns_group_by_whole_reason(db):
    rows = T.WebReturns(*T.arms(85, PEOPLE, STATES), year=1997).run(db).collect()
    assert [r["reason"] for r in rows] == ["a reason of some len"] * 2
    same = [w for r in rows for w in r["prov"] if w[3] == w[4]]
    assert len(same) == 1  # refunded and returning demographics may be one row, whose token then stands twice


def test_batch_equals_single_runs(db, spark):
    instances = [(1, ("Music",), dt.date(1997, 8, 9)), (2, ("Music", "Books"), dt.date(1997, 9, 8)), (3, ("Books",), dt.date(1997, 8, 9))]
    batch = revenue_share_batch(db, "web_sales", revenue_params(spark, instances))
    key = lambda r: (r["i_item_id"], r["i_class"], r["itemrevenue"], repr(r["revenueratio"]), sorted(map(tuple, r["prov"])))
    got = sorted((r["instance"], key(r)) for r in batch.collect())
    assert got == sorted((i, key(r)) for i, c, d in instances for r in T.RevenueShare("web_sales", c, d).run(db).collect())
    loose = Counter((r["instance"], tuple(r["witness"])) for r in revenue_witnesses(db, "web_sales", revenue_params(spark, instances)).collect())
    assert loose == Counter((r["instance"], tuple(w)) for r in batch.collect() for w in r["prov"])
    assert {(r["template"], r["instance"]) for r in features.exploded(T.witnesses(batch), 12).collect()} == {(12, i) for i, _ in loose}
    arms = [(1, 1997, PEOPLE, STATES), (2, 1066, PEOPLE, STATES)]
    rows = {r["instance"]: r["sum_quantity"] for r in store_quantity_batch(db, *arm_params(spark, 48, arms)).collect()}
    assert rows == {1: 8, 2: None}


def test_every_batch_equals_single_runs(db, spark):
    """Batches of each template over parameter tables against one run an instance, bags included."""
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    day = dt.date(1997, 8, 9)
    other = (("W", "Primary"), ("U", "College"), ("D", "Unknown"))
    people, shuffled = {1: PEOPLE, 2: other, 3: PEOPLE}, {1: STATES, 2: STATES, 3: (STATES[1], STATES[0], STATES[2])}
    for template in (13, 48, 85):
        persons, places = arm_params(spark, template, [(i, 1997, people[i], shuffled[i]) for i in people])
        kind = {13: T.StoreAverages, 48: T.StoreQuantity, 85: T.WebReturns}[template]
        compare(batch(template, db, {"persons": persons, "places": places}), {i: kind(*T.arms(template, people[i], shuffled[i]), year=1997).run(db) for i in people})
    params = {"buyers": frame([(1, "M", "Primary", 1997), (2, "F", "Primary", 1997)], "instance int, gender string, education string, year int"), "months": frame([(1, 6), (1, 7), (2, 6)], "instance int, month int"), "states": frame([(1, "VT"), (2, "VT"), (2, "OH")], "instance int, state string")}
    compare(batch(18, db, params), {1: T.CatalogRollup("M", "Primary", (6, 7), 1997, ("VT",)).run(db), 2: T.CatalogRollup("F", "Primary", (6,), 1997, ("VT", "OH")).run(db)})
    for template, channel in ((37, "catalog_sales"), (82, "store_sales")):
        params = {"stock": frame([(1, 30, day), (2, 20, day), (3, 90, day)], "instance int, price int, start date"), "makers": frame([(1, 7), (1, 8), (2, 7), (3, 7)], "instance int, maker int")}
        compare(batch(template, db, params), {i: T.StockedItems(channel, p, day, m).run(db) for i, p, m in ((1, 30, (7, 8)), (2, 20, (7,)), (3, 90, (7,)))})
    params = {"customers": frame([(1, "Union", 100), (2, "Union", 60000), (3, "Nowhere", 100)], "instance int, city string, income int")}
    compare(batch(84, db, params), {1: T.ReturningCustomers("Union", 100).run(db), 2: T.ReturningCustomers("Union", 60000).run(db), 3: T.ReturningCustomers("Nowhere", 100).run(db)})
    for template, channel in ((12, "web_sales"), (20, "catalog_sales"), (98, "store_sales")):
        params = {"revenue": revenue_params(spark, [(1, ("Music", "Books"), day), (2, ("Books",), day)])}
        compare(batch(template, db, params), {1: T.RevenueShare(channel, ("Music", "Books"), day).run(db), 2: T.RevenueShare(channel, ("Books",), day).run(db)})


def compare(batched, single):
    def key(r, names):
        return tuple(repr(sorted(map(repr, r[c]))) if c == "prov" and r[c] is not None else repr(r[c]) for c in names)

    names = [c for c in batched.columns if c != "instance"]
    got, want = Counter((r["instance"], key(r, names)) for r in batched.collect()), Counter()
    for i, df in single.items():
        assert sorted(c for c in df.columns) == sorted(names)
        want.update((i, key(r, names)) for r in df.collect())
    assert got == want


def test_digests_equal_bags(db):
    """The digest of a group is the sum over its bag."""
    import hashlib

    sold = Relation.base(db["web_sales"], "web_sales").join(Relation.base(db["item"], "item"), F.col("ws_item_sk") == F.col("i_item_sk"))
    bags = {r["i_class"]: [int(hashlib.md5("|".join(w).encode()).hexdigest()[:15], 16) for w in r["prov"]] for r in sold.group([F.col("i_class")]).collect()}
    assert {r["i_class"]: (r["n_witnesses"], int(r["witness_digest"])) for r in sold.digest([F.col("i_class")]).collect()} == {k: (len(v), sum(v)) for k, v in bags.items()}


def test_written_annotations(spark, tmp_path):
    tables = {"store": spark.createDataFrame([(4,), (2,)], "s_store_sk int"), "reason": spark.createDataFrame([(1, "b"), (0, None)], "r_reason_sk int, r_reason_desc string")}
    write_annotated(tables, str(tmp_path))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/store.parquet").collect())) == [(2, "S1"), (4, "S2")]
    back = load(spark, str(tmp_path))["reason"]
    assert back.columns == ["r_reason_desc", "r_reason_sk", "prov"] and sorted((r["r_reason_sk"], r["prov"]) for r in back.collect()) == [(0, "R1"), (1, "R2")]


def test_plans_have_no_products(db):
    for t in (T.StoreAverages(*T.arms(13, PEOPLE, STATES)), T.StoreQuantity(*T.arms(48, PEOPLE, STATES)), T.WebReturns(*T.arms(85, PEOPLE, STATES))):
        plan = t.run(db)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_share_by_zero(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", -1.0), ("b", 0.0), ("c", None)], "g string, v double")
    got = {(r["g"], r["v"]): r["s"] for r in share(df, "v", ["g"], 100, "s").collect()}
    assert got[("a", 1.0)] == float("inf") and got[("a", -1.0)] == float("-inf") and got[("b", 0.0)] != got[("b", 0.0)] and got[("c", None)] is None
    assert [r["v"] for r in top(df, ["v"], 4).collect()] == [-1.0, 0.0, 1.0, None]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("xy"), st.sampled_from(["p", None]), st.integers(0, 3)), max_size=8))
def test_bags_hold_what_contributed(spark, data):
    fact = spark.createDataFrame([(g, h, k, f"F{i}") for i, (g, h, k) in enumerate(data)], "g string, h string, k int, prov string")
    dim = spark.createDataFrame([(k, f"D{k}") for k in range(3)], "key int, prov string")
    joined = Relation.base(fact, "fact").join(Relation.base(dim, "dim"), F.col("k") == F.col("key"))
    rows = joined.rollup(["g", "h"], {"mean": F.col("k")}).collect()
    want = [(f"F{i}", f"D{k}") for i, (_, _, k) in enumerate(data) if k < 3]
    bags = {level: Counter(tuple(w) for r in rows if r["level"] == level for w in (r["prov"] or [])) for level in range(3)}
    assert all(bags[level] == Counter(want) for level in range(3))
    assert sum(r["level"] == 2 for r in rows) == 1


def test_numbering(spark, tmp_path):
    df = spark.createDataFrame([(x % 7, None if x % 5 == 0 else x) for x in range(100)], "a int, b int").repartition(5)
    rows = [tuple(r) for r in number_rows(df, ["a", "b"]).orderBy("__number").collect()]
    assert [r[2] for r in rows] == list(range(1, 101))
    assert [r[:2] for r in rows] == sorted((r[:2] for r in rows), key=lambda r: (r[0], r[1] is None, r[1] or 0))
    assert {r["prov"] for r in annotate(df, "item").collect()} == {f"I{k}" for k in range(1, 101)}
    assert annotate(df.limit(0), "item").count() == 0
    make(spark, "store", {"s_store_sk": 4}).write.parquet(f"{tmp_path}/store.parquet")
    assert load(spark, str(tmp_path))["store"].first()["s_store_sk"] == 4
    assert len(RELATIONS) == 16


def test_stages_are_cleared():
    """In a process of its own: the shared session still reads its tables."""
    code = "from pyspark.sql import SparkSession; from tracewell.sources.staging import *; s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate(); df = stage(s.range(3), 'x'); assert df.count() == 3; p = application_dir(s).removeprefix('file://'); assert os.path.isdir(p); clear_stages(s); assert not os.path.exists(p); print('cleared')"
    assert "cleared" in subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120).stdout


TEXT = """select i_item_id as name, avg(ws_quantity) as mean, sum(ws_ext_sales_price)*100/sum(sum(ws_ext_sales_price)) over (partition by d_year) as part,
  array_agg(list_value(date_dim.prov, web_sales.prov)) prov
from date_dim, web_sales, item
where d_date_sk = ws_sold_date_sk and i_item_sk = ws_item_sk and ws_ext_sales_price > 5 and i_category in ('Music', 'avg(')
  and d_date <= cast('1997-06-25' as date) + INTERVAL 75 DAY
group by i_item_id, d_year order by i_item_id LIMIT 7;"""


def test_text_of_another_dialect(db, spark, tmp_path):
    rows = run_text(spark, db, ["web_sales", "item", "date_dim"], TEXT).collect()
    assert [(r["name"], r["mean"], r["part"], len(r["prov"])) for r in rows] == [("A", 2.0, 30.0, 2), ("B", 2.0, 70.0, 1)]
    none = run_text(spark, db, ["web_sales"], "select avg(ws_quantity) as a, array_agg(list_value(web_sales.prov)) as prov from web_sales where ws_quantity = 0").collect()
    assert [tuple(r) for r in none] == [(None, None)]
    assert "'avg('" in translate(TEXT)
    (tmp_path / "q12_versions").mkdir()
    (tmp_path / "q12_versions" / "query12_s3.sql").write_text(TEXT)
    found = discover(spark, str(tmp_path)).collect()
    assert [(r["template"], r["instance"], r["sql"]) for r in found] == [(12, 3, TEXT)]
