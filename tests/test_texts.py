"""Texts of all ten shapes, written for another dialect, give what the builders give."""

from __future__ import annotations

import datetime as dt
from collections import Counter

import pytest

from tests.test_algebra import PEOPLE, STATES, db  # noqa: F401
from tracewell.plans import templates as T
from tracewell.plans.sqltext import discover, run_text, translate

DAY = dt.date(1997, 8, 9)
SOURCES = {t: [{"cd1": "customer_demographics", "cd2": "customer_demographics"}.get(r, r) for r in names] for t, names in T.WITNESS.items()}


def bag(template):
    return f"array_agg(list_value({', '.join(f'{r}.prov' for r in T.WITNESS[template])})) as prov"


def any_of(arms):
    return "(" + "\n or ".join(f"({a})" for a in arms) + ")"


def people(arms, price, cd=""):
    return any_of(f"{cd}cd_marital_status = '{a.marital}' and {cd}cd_education_status = '{a.education}' and {price} between {a.low} and {a.high}" + (f" and hd_dep_count = {a.dependants}" if a.dependants else "") for a in arms)


def places(arms, profit):
    return any_of(f"ca_country in ('{p.country}') and ca_state in ({', '.join(map(repr, p.states))}) and {profit} between {p.low} and {p.high}" for p in arms)


def revenue(template, channel, x, limit="LIMIT 100"):
    keys = "i_item_id, i_item_desc, i_category, i_class, i_current_price"
    return f"""select {keys}, sum({x}_ext_sales_price) as itemrevenue, sum({x}_ext_sales_price)*100/sum(sum({x}_ext_sales_price)) over (partition by i_class) as revenueratio, {bag(template)}
from {channel} join item on item.i_item_sk = {x}_item_sk join date_dim on date_dim.d_date_sk = {x}_sold_date_sk
where i_category in ('Music', 'Books') and i_current_price > 0 and d_date between cast('{DAY}' as date) and (cast('{DAY}' as date) + INTERVAL 30 DAY)
group by {keys} order by i_category, i_class, i_item_id, i_item_desc, revenueratio {limit};"""


def stock(template, channel, x):
    return f"""select i_item_id, i_item_desc, i_current_price, {bag(template)} from item join inventory on i_item_sk = inv_item_sk join date_dim on inv_date_sk = d_date_sk join {channel} on i_item_sk = {x}_item_sk
where i_current_price between 30 and 30 + 30 and d_date between cast('{DAY}' as date) and (cast('{DAY}' as date) + INTERVAL 60 DAY) and i_manufact_id in (7, 8) and inv_quantity_on_hand between 100 and 500
group by i_item_id, i_item_desc, i_current_price order by i_item_id LIMIT 100;"""


ARMS = {t: T.arms(t, PEOPLE, STATES) for t in (13, 48, 85)}
IN_STORES = "from store_sales join store on s_store_sk = ss_store_sk join date_dim on ss_sold_date_sk = d_date_sk join customer_demographics on cd_demo_sk = ss_cdemo_sk join customer_address on ss_addr_sk = ca_address_sk"
MEANS = ", ".join(f"avg(cast({v} as decimal(12,2))) as agg{k}" for k, v in enumerate(("cs_quantity", "cs_list_price", "cs_coupon_amt", "cs_sales_price", "cs_net_profit", "c_birth_year", "cd1.cd_dep_count"), 1))
#: template -> (text, the builder's instance)
TEXTS = {
    12: (revenue(12, "web_sales", "ws"), T.RevenueShare("web_sales", ("Music", "Books"), DAY)),
    20: (revenue(20, "catalog_sales", "cs"), T.RevenueShare("catalog_sales", ("Music", "Books"), DAY)),
    98: (revenue(98, "store_sales", "ss", ""), T.RevenueShare("store_sales", ("Music", "Books"), DAY, limit=None)),
    13: (f"select avg(ss_quantity) as avg_quantity, avg(ss_ext_sales_price) as avg_ext_sales_price, avg(ss_ext_wholesale_cost) as avg_ext_wholesale_cost, sum(ss_ext_wholesale_cost) as sum_ext_wholesale_cost, {bag(13)} {IN_STORES} join household_demographics on ss_hdemo_sk = hd_demo_sk where d_year = 1997 and {people(ARMS[13][0], 'ss_sales_price')} and {places(ARMS[13][1], 'ss_net_profit')}", T.StoreAverages(*ARMS[13], year=1997)),
    48: (f"select sum(ss_quantity) as sum_quantity, {bag(48)} {IN_STORES} where d_year = 1997 and {people(ARMS[48][0], 'ss_sales_price')} and {places(ARMS[48][1], 'ss_net_profit')};", T.StoreQuantity(*ARMS[48], year=1997)),
    18: (
        f"""select i_item_id, ca_country, ca_state, ca_county, {MEANS}, {bag(18)} from catalog_sales join date_dim on cs_sold_date_sk = d_date_sk join item on cs_item_sk = i_item_sk join customer_demographics cd1 on cs_bill_cdemo_sk = cd1.cd_demo_sk
join customer on cs_bill_customer_sk = c_customer_sk join customer_demographics cd2 on c_current_cdemo_sk = cd2.cd_demo_sk join customer_address on c_current_addr_sk = ca_address_sk
where cd1.cd_gender = 'M' and cd1.cd_education_status = 'Primary' and c_birth_month in (6, 7) and d_year = 1997 and ca_state in ('VT', 'OH') group by rollup (i_item_id, ca_country, ca_state, ca_county) order by ca_country, ca_state, ca_county, i_item_id LIMIT 100;""",
        T.CatalogRollup("M", "Primary", (6, 7), 1997, ("VT", "OH")),
    ),
    37: (stock(37, "catalog_sales", "cs"), T.StockedItems("catalog_sales", 30, DAY, (7, 8))),
    82: (stock(82, "store_sales", "ss"), T.StockedItems("store_sales", 30, DAY, (7, 8))),
    84: (
        f"""select c_customer_id as customer_id, coalesce(c_last_name, '') || ', ' || coalesce(c_first_name, '') as customername, list_value({', '.join(f'{r}.prov' for r in T.WITNESS[84])}) as prov
from customer join customer_address on c_current_addr_sk = ca_address_sk join household_demographics on hd_demo_sk = c_current_hdemo_sk join income_band on ib_income_band_sk = hd_income_band_sk join customer_demographics on cd_demo_sk = c_current_cdemo_sk join store_returns on sr_cdemo_sk = cd_demo_sk
where ca_city = 'Union' and ib_lower_bound >= 100 and ib_upper_bound <= 100 + 50000 order by c_customer_id LIMIT 100;""",
        T.ReturningCustomers("Union", 100),
    ),
    85: (
        f"""select substr(r_reason_desc, 1, 20) as reason, avg(ws_quantity) as avg_quantity, avg(wr_refunded_cash) as avg_refunded_cash, avg(wr_fee) as avg_fee, {bag(85)}
from web_sales join web_returns on ws_item_sk = wr_item_sk and ws_order_number = wr_order_number join web_page on ws_web_page_sk = wp_web_page_sk join date_dim on ws_sold_date_sk = d_date_sk join customer_demographics cd1 on cd1.cd_demo_sk = wr_refunded_cdemo_sk
join customer_demographics cd2 on cd2.cd_demo_sk = wr_returning_cdemo_sk join customer_address on ca_address_sk = wr_refunded_addr_sk join reason on r_reason_sk = wr_reason_sk
where d_year = 1997 and cd1.cd_marital_status = cd2.cd_marital_status and cd1.cd_education_status = cd2.cd_education_status and {people(ARMS[85][0], 'ws_sales_price', 'cd1.')} and {places(ARMS[85][1], 'ws_net_profit')}
group by r_reason_desc order by substr(r_reason_desc, 1, 20), avg(ws_quantity), avg(wr_refunded_cash), avg(wr_fee) LIMIT 100;""",
        T.WebReturns(*ARMS[85], year=1997),
    ),
}


@pytest.mark.parametrize("template", sorted(TEXTS))
def test_text_equals_builder(spark, db, template):  # noqa: F811
    text, builder = TEXTS[template]
    key = lambda r, names: tuple(repr(sorted(map(repr, r[c]))) if c == "prov" and r[c] is not None else str(round(float(r[c]), 6)) if isinstance(r[c], float) else repr(r[c]) for c in names)
    want = builder.run(db)
    got = run_text(spark, db, sorted(set(SOURCES[template])), text)
    names = sorted(want.columns)
    assert sorted(got.columns) == names and want.count() > 0
    assert Counter(key(r, names) for r in got.collect()) == Counter(key(r, names) for r in want.collect())


def test_discovery_of_all(spark, tmp_path):
    for template, (text, _) in TEXTS.items():
        (tmp_path / f"q{template}_versions").mkdir()
        for k in (1, 12):
            (tmp_path / f"q{template}_versions" / f"query{template}_s{k}.sql").write_text(text)
    (tmp_path / "q12_versions" / "notes.sql").write_text("select 1")
    found = {(r["template"], r["instance"]): r["sql"] for r in discover(spark, str(tmp_path)).collect()}
    assert found == {(t, k): text for t, (text, _) in TEXTS.items() for k in (1, 12)}
    assert all("list_value" not in translate(x) for x in found.values())
