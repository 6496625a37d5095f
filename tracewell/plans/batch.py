"""Many instances of one template in one job: the data is joined with tables of parameters instead of running a job each.

Lists become rows of the parameter tables (no list of the templates repeats a value), ranges become join conditions beside an
equality, and every grouping, window and limit gets the instance as its first key. Which side is broadcast is left to the
optimizer, which knows the sizes of the parameter tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.operators.algebra import Relation, average, first_matches, share
from tracewell.plans.templates import BANDS, DEPENDANTS, PROFITS, WITNESS, Tables

CHANNELS = {12: "web_sales", 20: "catalog_sales", 98: "store_sales", 37: "catalog_sales", 82: "store_sales"}
PREFIX = {"web_sales": "ws", "catalog_sales": "cs", "store_sales": "ss"}
Params = Mapping[str, DataFrame]


def revenue_params(spark: SparkSession, instances: Sequence[tuple[int, Sequence[str], date]]) -> DataFrame:
    """instance, category, start: a row for each category of an instance of template 12, 20 or 98."""
    return spark.createDataFrame([(i, c, d) for i, cs, d in instances for c in cs], "instance int, category string, start date")


def arm_params(spark: SparkSession, template: int, instances: Sequence[tuple[int, int, Sequence[tuple[str, str]], Sequence[Sequence[str]]]]) -> tuple[DataFrame, DataFrame]:
    """(person arms, place arms) of instances (instance, year, people, states) of template 13, 48 or 85."""
    people = [(i, year, m, e, *band, d) for i, year, who, _ in instances for (m, e), band, d in zip(who, BANDS, DEPENDANTS)]
    places = [(i, s, *band) for i, _, _, states in instances for group, band in zip(states, PROFITS[template]) for s in group]
    persons = spark.createDataFrame(people, "instance int, year int, marital string, education string, low string, high string, dependants int")
    return persons.withColumns({c: F.col(c).cast("decimal(7,2)") for c in ("low", "high")}), spark.createDataFrame(places, "instance int, state string, p_low int, p_high int")


def _base(db: Tables, relation: str, alias: str | None = None) -> Relation:
    return Relation.base(db[relation], alias or relation)


def _with(relation: Relation, params: DataFrame, condition) -> Relation:
    """The rows of the relation once for each parameter row that they meet; parameters have no tokens."""
    return Relation(relation.df.join(params, condition), relation.tokens)


def _sold(db: Tables, channel: str, params: DataFrame, days: int) -> Relation:
    p = PREFIX[channel]
    wanted = _with(_base(db, "item"), params, F.col("i_category") == F.col("category"))
    return (
        _base(db, channel)
        .join(wanted, F.col(f"{p}_item_sk") == F.col("i_item_sk"))
        .join(_base(db, "date_dim"), (F.col(f"{p}_sold_date_sk") == F.col("d_date_sk")) & F.col("d_date").between(F.col("start"), F.date_add("start", days)))
    )


def _place(sold: Relation, db: Tables, places: DataFrame, address: str, profit: str) -> Relation:
    places = places.withColumnRenamed("instance", "p_instance")
    where = _with(_base(db, "customer_address"), places, (F.col("ca_state") == F.col("state")) & (F.col("ca_country") == "United States"))
    return sold.join(where, (F.col(address) == F.col("ca_address_sk")) & (F.col("p_instance") == F.col("instance")) & F.col(profit).between(F.col("p_low"), F.col("p_high")))


def _in_stores(db: Tables, params: Params, household: bool) -> Relation:
    who = _with(_base(db, "customer_demographics"), params["persons"], (F.col("cd_marital_status") == F.col("marital")) & (F.col("cd_education_status") == F.col("education")))
    sold = (
        _base(db, "store_sales")
        .join(_base(db, "store"), F.col("s_store_sk") == F.col("ss_store_sk"))
        .join(_base(db, "date_dim"), F.col("ss_sold_date_sk") == F.col("d_date_sk"))
        .join(who, (F.col("cd_demo_sk") == F.col("ss_cdemo_sk")) & (F.col("d_year") == F.col("year")) & F.col("ss_sales_price").between(F.col("low"), F.col("high")))
    )
    if household:
        sold = sold.join(_base(db, "household_demographics"), (F.col("ss_hdemo_sk") == F.col("hd_demo_sk")) & (F.col("hd_dep_count") == F.col("dependants")))
    return _place(sold, db, params["places"], "ss_addr_sk", "ss_net_profit").in_order(*WITNESS[13 if household else 48])


def _by_catalog(db: Tables, params: Params) -> Relation:
    buyers = _with(_base(db, "customer_demographics", "cd1"), params["buyers"], (F.col("cd_gender") == F.col("gender")) & (F.col("cd_education_status") == F.col("education")))
    months = params["months"].withColumnRenamed("instance", "m_instance")
    states = params["states"].withColumnRenamed("instance", "s_instance")
    born = _with(_base(db, "customer"), months, F.col("c_birth_month") == F.col("month"))
    living = _with(_base(db, "customer_address"), states, F.col("ca_state") == F.col("state"))
    return (
        _base(db, "catalog_sales")
        .join(_base(db, "date_dim"), F.col("cs_sold_date_sk") == F.col("d_date_sk"))
        .join(_base(db, "item"), F.col("cs_item_sk") == F.col("i_item_sk"))
        .join(buyers, (F.col("cs_bill_cdemo_sk") == F.col("cd1.cd_demo_sk")) & (F.col("d_year") == F.col("year")))
        .join(born, (F.col("cs_bill_customer_sk") == F.col("c_customer_sk")) & (F.col("m_instance") == F.col("instance")))
        .join(_base(db, "customer_demographics", "cd2"), F.col("c_current_cdemo_sk") == F.col("cd2.cd_demo_sk"))
        .join(living, (F.col("c_current_addr_sk") == F.col("ca_address_sk")) & (F.col("s_instance") == F.col("instance")))
        .in_order(*WITNESS[18])
    )


def _stocked(db: Tables, params: Params, span: int = 30, days: int = 60, stock: tuple[int, int] = (100, 500)) -> Relation:
    makers = params["makers"].withColumnRenamed("instance", "m_instance")
    wanted = _with(_base(db, "item"), makers, F.col("i_manufact_id") == F.col("maker"))
    wanted = _with(wanted, params["stock"], (F.col("m_instance") == F.col("instance")) & F.col("i_current_price").between(F.col("price"), F.col("price") + span))
    return (
        wanted.join(_base(db, "inventory").where(F.col("inv_quantity_on_hand").between(*stock)), F.col("inv_item_sk") == F.col("i_item_sk"))
        .join(_base(db, "date_dim"), (F.col("d_date_sk") == F.col("inv_date_sk")) & F.col("d_date").between(F.col("start"), F.date_add("start", days)))
    )


def _in_stock(db: Tables, channel: str, params: Params) -> Relation:
    return _stocked(db, params).join(_base(db, channel), F.col(f"{PREFIX[channel]}_item_sk") == F.col("i_item_sk"))


def _of_city(db: Tables, params: Params, span: int = 50000) -> Relation:
    """The customers of each instance of template 84, with the tokens of all relations but store_returns in witness order."""
    living = _with(_base(db, "customer_address"), params["customers"], F.col("ca_city") == F.col("city"))
    return (
        _base(db, "customer")
        .join(living, F.col("c_current_addr_sk") == F.col("ca_address_sk"))
        .join(_base(db, "household_demographics"), F.col("hd_demo_sk") == F.col("c_current_hdemo_sk"))
        .join(_base(db, "income_band"), (F.col("ib_income_band_sk") == F.col("hd_income_band_sk")) & (F.col("ib_lower_bound") >= F.col("income")) & (F.col("ib_upper_bound") <= F.col("income") + span))
        .join(_base(db, "customer_demographics"), F.col("cd_demo_sk") == F.col("c_current_cdemo_sk"))
        .in_order(*WITNESS[84][:-1])
    )


def _returning(db: Tables, params: Params) -> Relation:
    return _of_city(db, params).join(_base(db, "store_returns"), F.col("sr_cdemo_sk") == F.col("cd_demo_sk"))


def _returned(db: Tables, params: Params) -> Relation:
    same = (F.col("cd1.cd_marital_status") == F.col("cd2.cd_marital_status")) & (F.col("cd1.cd_education_status") == F.col("cd2.cd_education_status"))
    who = _with(_base(db, "customer_demographics", "cd1"), params["persons"], (F.col("cd_marital_status") == F.col("marital")) & (F.col("cd_education_status") == F.col("education")))
    sold = (
        _base(db, "web_sales")
        .join(_base(db, "web_page"), F.col("ws_web_page_sk") == F.col("wp_web_page_sk"))
        .join(_base(db, "web_returns"), (F.col("ws_item_sk") == F.col("wr_item_sk")) & (F.col("ws_order_number") == F.col("wr_order_number")))
        .join(_base(db, "date_dim"), F.col("ws_sold_date_sk") == F.col("d_date_sk"))
        .join(who, (F.col("cd1.cd_demo_sk") == F.col("wr_refunded_cdemo_sk")) & (F.col("d_year") == F.col("year")) & F.col("ws_sales_price").between(F.col("low"), F.col("high")))
        .join(_base(db, "customer_demographics", "cd2"), (F.col("cd2.cd_demo_sk") == F.col("wr_returning_cdemo_sk")) & same)
    )
    placed = _place(sold, db, params["places"], "wr_refunded_addr_sk", "ws_net_profit")
    return placed.join(_base(db, "reason"), F.col("r_reason_sk") == F.col("wr_reason_sk")).in_order(*WITNESS[85])


def joined(template: int, db: Tables, params: Params) -> Relation:
    """The joined rows of a template, once for each instance that they belong to."""
    if template in (12, 20, 98):
        return _sold(db, CHANNELS[template], params["revenue"], 30)
    if template in (13, 48):
        return _in_stores(db, params, template == 13)
    if template in (37, 82):
        return _in_stock(db, CHANNELS[template], params)
    return {18: _by_catalog, 84: _returning, 85: _returned}[template](db, params)


def halves(template: int, db: Tables, params: Params) -> tuple[Relation, str, Relation | None, str]:
    """joined() before its last join where that is of many with many: the left side, its key, the right side, its key. The key is told by
    the tokens of the left side. Other templates have no right side."""
    if template in (37, 82):
        channel = CHANNELS[template]
        return _stocked(db, params), "i_item_sk", _base(db, channel), f"{PREFIX[channel]}_item_sk"
    if template == 84:
        return _of_city(db, params), "cd_demo_sk", _base(db, "store_returns"), "sr_cdemo_sk"
    return joined(template, db, params), "", None, ""


def instance_witnesses(template: int, db: Tables, params: Params) -> DataFrame:
    """instance, witness: a row per witness of the template without its limit, without grouping: features need no bags."""
    return joined(template, db, params).project(F.col("instance")).withColumnRenamed("prov", "witness")


def revenue_witnesses(db: Tables, channel: str, params: DataFrame, days: int = 30) -> DataFrame:
    return _sold(db, channel, params, days).project(F.col("instance")).withColumnRenamed("prov", "witness")


def first_of_each(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n rows of each instance in ascending order of the keys, nulls last."""
    order = Window.partitionBy("instance").orderBy(*[F.col(k).asc_nulls_last() for k in keys])
    return rows.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= n).drop("__rank")


def revenue_share_batch(db: Tables, channel: str, params: DataFrame, days: int = 30, limit: int | None = 100) -> DataFrame:
    """Template 12, 20 or 98 for all instances of params: the template's columns after `instance`."""
    sold = _sold(db, channel, params, days)
    keys = ["instance", "i_item_id", "i_item_desc", "i_category", "i_class", "i_current_price"]
    groups = sold.group([F.col(k) for k in keys], F.sum(f"{PREFIX[channel]}_ext_sales_price").alias("itemrevenue"))
    rows = share(groups, "itemrevenue", ["instance", "i_class"], 100, "revenueratio").select(*keys, "itemrevenue", "revenueratio", "prov")
    return rows if limit is None else first_of_each(rows, ["i_category", "i_class", "i_item_id", "i_item_desc", "revenueratio", "i_current_price"], limit)


def _for_each(instances: DataFrame, found: DataFrame) -> DataFrame:
    """One row an instance, of nulls where nothing was found."""
    return instances.select("instance").distinct().join(found, "instance", "left")


def store_quantity_batch(db: Tables, persons: DataFrame, places: DataFrame) -> DataFrame:
    """Template 48 for all instances: instance, sum_quantity, avg_quantity, prov; instances without a row have null values."""
    sold = _in_stores(db, {"persons": persons, "places": places}, False)
    return _for_each(persons, sold.group([F.col("instance")], F.sum("ss_quantity").alias("sum_quantity"), average("ss_quantity").alias("avg_quantity")))


def batch(template: int, db: Tables, params: Params, limit: int = 100) -> DataFrame:
    """A template for all instances of its parameter tables: `instance`, then the template's columns."""
    if template in (12, 20, 98):
        return revenue_share_batch(db, CHANNELS[template], params["revenue"], limit=None if template == 98 else limit)
    instance = F.col("instance")
    if template == 84:
        name = F.concat(F.coalesce("c_last_name", F.lit("")), F.lit(", "), F.coalesce("c_first_name", F.lit("")))
        found = first_matches(_of_city(db, params), _base(db, "store_returns"), F.col("sr_cdemo_sk") == F.col("cd_demo_sk"), "sr_cdemo_sk", F.col("c_customer_id"), limit, by=("instance",))
        return first_of_each(found.project(instance, F.col("c_customer_id").alias("customer_id"), name.alias("customername")), ["customer_id", "prov"], limit)
    sold = joined(template, db, params)
    if template == 48:
        return _for_each(params["persons"], sold.group([instance], F.sum("ss_quantity").alias("sum_quantity")))
    if template == 13:
        means = [average(f"ss_{c}").alias(f"avg_{c}") for c in ("quantity", "ext_sales_price", "ext_wholesale_cost")]
        return _for_each(params["persons"], sold.group([instance], *means, F.sum("ss_ext_wholesale_cost").alias("sum_ext_wholesale_cost")))
    if template == 18:
        values = ("cs_quantity", "cs_list_price", "cs_coupon_amt", "cs_sales_price", "cs_net_profit", "c_birth_year", "cd1.cd_dep_count")
        keys = ["i_item_id", "ca_country", "ca_state", "ca_county"]
        rolled = sold.rollup(keys, {f"agg{k}": F.col(v).cast("decimal(12,2)") for k, v in enumerate(values, 1)}, by=("instance",))
        return _for_each(params["buyers"], first_of_each(rolled, ["ca_country", "ca_state", "ca_county", "i_item_id", "level"], limit).drop("level"))
    if template in (37, 82):
        keys = ["i_item_id", "i_item_desc", "i_current_price"]
        return first_of_each(sold.group([instance, *map(F.col, keys)]), keys, limit)
    names = ("avg_quantity", "avg_refunded_cash", "avg_fee")
    groups = sold.group([instance, F.col("r_reason_desc")], *[average(c).alias(n) for c, n in zip(("ws_quantity", "wr_refunded_cash", "wr_fee"), names)])
    rows = groups.withColumn("reason", F.substring("r_reason_desc", 1, 20))
    return first_of_each(rows, ["reason", *names, "r_reason_desc"], limit).select("instance", "reason", *names, "prov")
