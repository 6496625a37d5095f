"""The templates over the driver's tables, with the SQL that a database answers them by."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.plans import templates as T
from tracewell.sources.star import star, star_sql

CATEGORIES = ("ECONOMY", "LARGE", "PROMO")
STATES = (("CA", "OR", "WA"), ("NV", "AZ", "UT"), ("CO", "NM", "TX"))
PEOPLE = (("W", "College"), ("D", "Unknown"), ("M", "Advanced Degree"))

INSTANCES: dict[str, object] = {
    "tpl_12": T.RevenueShare("web_sales", CATEGORIES, date(1997, 5, 3)),
    "tpl_13": T.StoreAverages(*T.arms(13, PEOPLE, STATES), year=2000),
    "tpl_18": T.CatalogRollup("F", "Primary", (1, 3, 5, 8, 9, 10), 2000, ("CA", "OR", "WA", "NV", "AZ", "CO", "TX")),
    "tpl_20": T.RevenueShare("catalog_sales", CATEGORIES, date(1999, 6, 1)),
    "tpl_37": T.StockedItems("catalog_sales", 20, date(1996, 9, 10), (17, 42, 67, 92, 5, 30)),
    "tpl_48": T.StoreQuantity(*T.arms(48, PEOPLE, STATES), year=2000),
    "tpl_82": T.StockedItems("store_sales", 55, date(1999, 3, 1), (60, 65, 70, 75, 80, 85)),
    "tpl_84": T.ReturningCustomers("City 3", 25000),
    "tpl_85": T.WebReturns(*T.arms(85, PEOPLE, STATES), year=2000),
    "tpl_98": T.RevenueShare("store_sales", CATEGORIES, date(1997, 5, 3), limit=None),
}


def bag_text(bag: Column) -> Column:
    """A bag as one text: witnesses in order, tokens joined by a bar, witnesses by a semicolon."""
    return F.array_join(F.array_sort(F.transform(bag, lambda w: F.array_join(w, "|"))), ";")


def digest(rows: DataFrame) -> DataFrame:
    """Rows with averages rounded, and the bag as its size and the md5 of its text."""
    bag = F.col("witnesses")
    rows = T.witnesses(rows)
    doubles = {c: F.round(c, 6) for c, kind in rows.dtypes if kind == "double"}
    return rows.withColumns(doubles | {"n_witnesses": F.coalesce(F.size(F.when(bag.isNotNull(), bag)), F.lit(0)).cast("long"), "witness_md5": F.md5(bag_text(bag))}).drop("witnesses")


def _run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: digest(INSTANCES[name].run(star(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _run(name) for name in INSTANCES}


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


def _bag(*relations: str) -> str:
    text = f"concat_ws('|', {', '.join(f'{r}.prov' for r in relations)})"
    return f"count({text}) as n_witnesses, md5(string_agg({text}, ';' order by {text})) as witness_md5"


def _avg(column: str, name: str) -> str:
    return f"round(cast(sum({column}) as double) / nullif(count({column}), 0), 6) as {name}"


def _share_sql(t: T.RevenueShare) -> str:
    p = {"web_sales": "ws", "catalog_sales": "cs", "store_sales": "ss"}[t.channel]
    keys = "i_item_id, i_item_desc, i_category, i_class, i_current_price"
    return f"""with {star_sql(t.channel, "item", "date_dim")}, revenue as (
select {keys}, sum({p}_ext_sales_price) as itemrevenue, {_bag(t.channel, "item", "date_dim")}
from {t.channel} join item on {p}_item_sk = i_item_sk join date_dim on {p}_sold_date_sk = d_date_sk
where i_category in {_in(t.categories)} and d_date >= date '{t.start}' and d_date <= date '{t.start}' + interval {t.days} day
group by {keys})
select {keys}, itemrevenue, round(cast(itemrevenue as double) * 100 / cast(sum(itemrevenue) over (partition by i_class) as double), 6) as revenueratio, n_witnesses, witness_md5
from revenue order by i_category, i_class, i_item_id, i_item_desc, i_current_price""" + (f" limit {t.limit}" if t.limit else "")


def _who(people, price: str, cd: str) -> str:
    return " or ".join(f"({cd}.cd_marital_status = '{a.marital}' and {cd}.cd_education_status = '{a.education}' and {price} between {a.low} and {a.high}" + (f" and hd_dep_count = {a.dependants}" if a.dependants is not None else "") + ")" for a in people)


def _where(places, profit: str) -> str:
    return " or ".join(f"(ca_country = '{p.country}' and ca_state in {_in(p.states)} and {profit} between {p.low} and {p.high})" for p in places)


def _store_sql(t, household: bool, values: str) -> str:
    relations = T.WITNESS[13 if household else 48]
    return f"""with {star_sql(*relations)}
select {values}, {_bag(*relations)}
from store_sales join store on s_store_sk = ss_store_sk join date_dim on ss_sold_date_sk = d_date_sk
join customer_demographics on cd_demo_sk = ss_cdemo_sk {"join household_demographics on hd_demo_sk = ss_hdemo_sk" if household else ""}
join customer_address on ca_address_sk = ss_addr_sk
where d_year = {t.year} and ({_who(t.people, "ss_sales_price", "customer_demographics")}) and ({_where(t.places, "ss_net_profit")})"""


def _rollup_sql(t: T.CatalogRollup) -> str:
    values = ("cs_quantity", "cs_list_price", "cs_coupon_amt", "cs_sales_price", "cs_net_profit", "c_birth_year", "cd1.cd_dep_count")
    keys = "i_item_id, ca_country, ca_state, ca_county"
    return f"""with {star_sql("catalog_sales", "customer_demographics", "customer", "customer_address", "date_dim", "item")}
select {keys}, {", ".join(_avg(f"cast({v} as decimal(12,2))", f"agg{i}") for i, v in enumerate(values, 1))}, {_bag("catalog_sales", "cd1", "cd2", "customer_", "customer_address", "date_dim", "item")}
from catalog_sales join date_dim on cs_sold_date_sk = d_date_sk join item on cs_item_sk = i_item_sk
join customer_demographics cd1 on cs_bill_cdemo_sk = cd1.cd_demo_sk join customer_ on cs_bill_customer_sk = c_customer_sk
join customer_demographics cd2 on c_current_cdemo_sk = cd2.cd_demo_sk join customer_address on c_current_addr_sk = ca_address_sk
where cd1.cd_gender = '{t.gender}' and cd1.cd_education_status = '{t.education}' and c_birth_month in {_in(t.months)} and d_year = {t.year} and ca_state in {_in(t.states)}
group by rollup ({keys})
order by ca_country nulls last, ca_state nulls last, ca_county nulls last, i_item_id nulls last, grouping({keys.replace(", ", ") + grouping(")}) limit {t.limit}"""


def _stock_sql(t: T.StockedItems) -> str:
    p = {"catalog_sales": "cs", "store_sales": "ss"}[t.channel]
    return f"""with {star_sql("item", "inventory", "date_dim", t.channel)}
select i_item_id, i_item_desc, i_current_price, {_bag("item", "inventory", "date_dim", t.channel)}
from item join inventory on inv_item_sk = i_item_sk join date_dim on d_date_sk = inv_date_sk join {t.channel} on {p}_item_sk = i_item_sk
where i_current_price >= {t.price} and i_current_price <= {t.price + t.price_span} and i_manufact_id in {_in(t.manufacturers)}
and d_date >= date '{t.start}' and d_date <= date '{t.start}' + interval {t.days} day and inv_quantity_on_hand between {t.stock[0]} and {t.stock[1]}
group by all order by i_item_id, i_item_desc, i_current_price limit {t.limit}"""


def _customers_sql(t: T.ReturningCustomers) -> str:
    tokens = ", ".join(f"{r}{'_' * (r == 'customer')}.prov" for r in T.WITNESS[84])
    return f"""with {star_sql(*T.WITNESS[84])}, found as (
select c_customer_id as customer_id, concat(coalesce(c_last_name, ''), ', ', coalesce(c_first_name, '')) as customername, [{tokens}] as prov
from customer_ join customer_address on c_current_addr_sk = ca_address_sk join household_demographics on hd_demo_sk = c_current_hdemo_sk
join income_band on ib_income_band_sk = hd_income_band_sk join customer_demographics on cd_demo_sk = c_current_cdemo_sk join store_returns on sr_cdemo_sk = cd_demo_sk
where ca_city = '{t.city}' and ib_lower_bound >= {t.income} and ib_upper_bound <= {t.income + t.span}
order by customer_id, prov limit {t.limit})
select customer_id, customername, 1 as n_witnesses, md5(array_to_string(prov, '|')) as witness_md5 from found"""


def _returns_sql(t: T.WebReturns) -> str:
    return f"""with {star_sql("web_sales", "web_returns", "web_page", "customer_demographics", "customer_address", "date_dim", "reason")}, found as (
select r_reason_desc, {_avg("ws_quantity", "avg_quantity")}, {_avg("wr_refunded_cash", "avg_refunded_cash")}, {_avg("wr_fee", "avg_fee")}, {_bag(*T.WITNESS[85])}
from web_sales join web_returns on ws_item_sk = wr_item_sk and ws_order_number = wr_order_number join web_page on ws_web_page_sk = wp_web_page_sk
join date_dim on ws_sold_date_sk = d_date_sk join customer_demographics cd1 on cd1.cd_demo_sk = wr_refunded_cdemo_sk
join customer_demographics cd2 on cd2.cd_demo_sk = wr_returning_cdemo_sk join customer_address on ca_address_sk = wr_refunded_addr_sk join reason on r_reason_sk = wr_reason_sk
where d_year = {t.year} and cd1.cd_marital_status = cd2.cd_marital_status and cd1.cd_education_status = cd2.cd_education_status
and ({_who(t.people, "ws_sales_price", "cd1")}) and ({_where(t.places, "ws_net_profit")})
group by r_reason_desc)
select substr(r_reason_desc, 1, 20) as reason, avg_quantity, avg_refunded_cash, avg_fee, n_witnesses, witness_md5 from found
order by reason, avg_quantity, avg_refunded_cash, avg_fee, r_reason_desc limit {t.limit}"""


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, t in INSTANCES.items():
        if isinstance(t, T.RevenueShare):
            out[name] = _share_sql(t)
        elif isinstance(t, T.StoreAverages):
            out[name] = _store_sql(t, True, f"{_avg('ss_quantity', 'avg_quantity')}, {_avg('ss_ext_sales_price', 'avg_ext_sales_price')}, {_avg('ss_ext_wholesale_cost', 'avg_ext_wholesale_cost')}, sum(ss_ext_wholesale_cost) as sum_ext_wholesale_cost")
        elif isinstance(t, T.StoreQuantity):
            out[name] = _store_sql(t, False, "cast(sum(ss_quantity) as bigint) as sum_quantity")
        elif isinstance(t, T.CatalogRollup):
            out[name] = _rollup_sql(t)
        elif isinstance(t, T.StockedItems):
            out[name] = _stock_sql(t)
        elif isinstance(t, T.ReturningCustomers):
            out[name] = _customers_sql(t)
        else:
            out[name] = _returns_sql(t)
    return out
