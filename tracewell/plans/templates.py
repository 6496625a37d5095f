"""The ten report templates as builders over a dictionary of relations, each returning its rows with `prov` bags.

Ties that the templates leave open are settled by the remaining columns, so that limits are deterministic.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.algebra import Relation, average, either, first_matches, share, top

Tables = Mapping[str, DataFrame]


def _base(db: Tables, relation: str, alias: str | None = None) -> Relation:
    return Relation.base(db[relation], alias or relation)


def _eq(a: str, b: str) -> Column:
    return F.col(a) == F.col(b)


def _days(start: date, n: int) -> Column:
    """d_date within start and n days after it, both included."""
    first = F.lit(start)
    return F.col("d_date").between(first, F.date_add(first, n))


@dataclass(frozen=True)
class RevenueShare:
    """12 (web), 20 (catalog), 98 (store): item revenue in 30 days and its share of the class; 98 has no limit."""

    channel: str
    categories: Sequence[str]
    start: date
    days: int = 30
    limit: int | None = 100

    def run(self, db: Tables) -> DataFrame:
        p = {"web_sales": "ws", "catalog_sales": "cs", "store_sales": "ss"}[self.channel]
        sold = (
            _base(db, self.channel)
            .join(_base(db, "item").where(F.col("i_category").isin(*self.categories)), _eq(f"{p}_item_sk", "i_item_sk"))
            .join(_base(db, "date_dim").where(_days(self.start, self.days)), _eq(f"{p}_sold_date_sk", "d_date_sk"))
        )
        keys = ["i_item_id", "i_item_desc", "i_category", "i_class", "i_current_price"]
        groups = sold.group([F.col(k) for k in keys], F.sum(f"{p}_ext_sales_price").alias("itemrevenue"))
        rows = share(groups, "itemrevenue", ["i_class"], 100, "revenueratio").select(*keys, "itemrevenue", "revenueratio", "prov")
        return top(rows, ["i_category", "i_class", "i_item_id", "i_item_desc", "revenueratio", "i_current_price"], self.limit)


@dataclass(frozen=True)
class Arm:
    """One arm of the person predicate: marital status, education, price band, and in template 13 the dependants."""

    marital: str
    education: str
    low: str
    high: str
    dependants: int | None = None


@dataclass(frozen=True)
class Place:
    """One arm of the place predicate: states and profit band."""

    states: Sequence[str]
    low: int
    high: int
    country: str = "United States"


def _person(arm: Arm, price: str, cd: str = "") -> Column:
    same = (F.col(f"{cd}cd_marital_status") == arm.marital) & (F.col(f"{cd}cd_education_status") == arm.education) & F.col(price).between(F.lit(arm.low).cast("decimal(7,2)"), F.lit(arm.high).cast("decimal(7,2)"))
    return same if arm.dependants is None else same & (F.col("hd_dep_count") == arm.dependants)


def _place(place: Place, profit: str) -> Column:
    return (F.col("ca_country") == place.country) & F.col("ca_state").isin(*place.states) & F.col(profit).between(place.low, place.high)


#: Fixed: price bands and dependants of the person arms, profit bands of the place arms.
BANDS = (("100.00", "150.00"), ("50.00", "100.00"), ("150.00", "200.00"))
DEPENDANTS = (3, 1, 1)
PROFITS = {13: ((100, 200), (150, 300), (50, 250)), 48: ((0, 2000), (150, 3000), (50, 25000)), 85: ((100, 200), (150, 300), (50, 250))}


def arms(template: int, people: Sequence[tuple[str, str]], states: Sequence[Sequence[str]]) -> tuple[list[Arm], list[Place]]:
    """The arms of template 13, 48 or 85 from its varying literals."""
    who = [Arm(m, e, *band, dependants=d if template == 13 else None) for (m, e), band, d in zip(people, BANDS, DEPENDANTS)]
    return who, [Place(s, *band) for s, band in zip(states, PROFITS[template])]


@dataclass(frozen=True)
class StoreAverages:
    """13: averages over store sales under two three-armed predicates, one row."""

    people: Sequence[Arm]
    places: Sequence[Place]
    year: int = 2001

    def run(self, db: Tables) -> DataFrame:
        sold = (
            _base(db, "store_sales")
            .join(_base(db, "store"), _eq("s_store_sk", "ss_store_sk"))
            .join(_base(db, "date_dim").where(F.col("d_year") == self.year), _eq("ss_sold_date_sk", "d_date_sk"))
            .join(_base(db, "customer_demographics"), _eq("cd_demo_sk", "ss_cdemo_sk"))
            .join(_base(db, "household_demographics"), _eq("ss_hdemo_sk", "hd_demo_sk"))
            .where(either([_person(a, "ss_sales_price") for a in self.people]))
            .join(_base(db, "customer_address"), _eq("ss_addr_sk", "ca_address_sk"))
            .where(either([_place(p, "ss_net_profit") for p in self.places]))
            .in_order("store_sales", "store", "customer_demographics", "household_demographics", "customer_address", "date_dim")
        )
        return sold.total(average("ss_quantity").alias("avg_quantity"), average("ss_ext_sales_price").alias("avg_ext_sales_price"), average("ss_ext_wholesale_cost").alias("avg_ext_wholesale_cost"), F.sum("ss_ext_wholesale_cost").alias("sum_ext_wholesale_cost"))


@dataclass(frozen=True)
class StoreQuantity:
    """48: quantity sold in stores under two three-armed predicates, one row."""

    people: Sequence[Arm]
    places: Sequence[Place]
    year: int = 2000

    def run(self, db: Tables) -> DataFrame:
        sold = (
            _base(db, "store_sales")
            .join(_base(db, "store"), _eq("s_store_sk", "ss_store_sk"))
            .join(_base(db, "date_dim").where(F.col("d_year") == self.year), _eq("ss_sold_date_sk", "d_date_sk"))
            .join(_base(db, "customer_demographics"), _eq("cd_demo_sk", "ss_cdemo_sk"))
            .where(either([_person(a, "ss_sales_price") for a in self.people]))
            .join(_base(db, "customer_address"), _eq("ss_addr_sk", "ca_address_sk"))
            .where(either([_place(p, "ss_net_profit") for p in self.places]))
            .in_order("store_sales", "store", "customer_demographics", "customer_address", "date_dim")
        )
        return sold.total(F.sum("ss_quantity").alias("sum_quantity"))


@dataclass(frozen=True)
class CatalogRollup:
    """18: seven averages of catalog sales, rolled up over item, country, state and county."""

    gender: str
    education: str
    months: Sequence[int]
    year: int
    states: Sequence[str]
    limit: int = 100

    def run(self, db: Tables) -> DataFrame:
        sold = (
            _base(db, "catalog_sales")
            .join(_base(db, "date_dim").where(F.col("d_year") == self.year), _eq("cs_sold_date_sk", "d_date_sk"))
            .join(_base(db, "item"), _eq("cs_item_sk", "i_item_sk"))
            .join(_base(db, "customer_demographics", "cd1").where((F.col("cd_gender") == self.gender) & (F.col("cd_education_status") == self.education)), _eq("cs_bill_cdemo_sk", "cd1.cd_demo_sk"))
            .join(_base(db, "customer").where(F.col("c_birth_month").isin(*self.months)), _eq("cs_bill_customer_sk", "c_customer_sk"))
            .join(_base(db, "customer_demographics", "cd2"), _eq("c_current_cdemo_sk", "cd2.cd_demo_sk"))
            .join(_base(db, "customer_address").where(F.col("ca_state").isin(*self.states)), _eq("c_current_addr_sk", "ca_address_sk"))
            .in_order("catalog_sales", "cd1", "cd2", "customer", "customer_address", "date_dim", "item")
        )
        values = ("cs_quantity", "cs_list_price", "cs_coupon_amt", "cs_sales_price", "cs_net_profit", "c_birth_year", "cd1.cd_dep_count")
        rolled = sold.rollup(["i_item_id", "ca_country", "ca_state", "ca_county"], {f"agg{i}": F.col(v).cast("decimal(12,2)") for i, v in enumerate(values, 1)})
        return top(rolled, ["ca_country", "ca_state", "ca_county", "i_item_id", "level"], self.limit).drop("level")


@dataclass(frozen=True)
class StockedItems:
    """37 (catalog) and 82 (store): items in a price band and in stock in 60 days that the channel sold at any time."""

    channel: str
    price: int
    start: date
    manufacturers: Sequence[int]
    price_span: int = 30
    days: int = 60
    stock: tuple[int, int] = (100, 500)
    limit: int = 100

    def run(self, db: Tables) -> DataFrame:
        p = {"catalog_sales": "cs", "store_sales": "ss"}[self.channel]
        found = (
            _base(db, "item")
            .where(F.col("i_current_price").between(self.price, self.price + self.price_span) & F.col("i_manufact_id").isin(*self.manufacturers))
            .join(_base(db, "inventory").where(F.col("inv_quantity_on_hand").between(*self.stock)), _eq("inv_item_sk", "i_item_sk"))
            .join(_base(db, "date_dim").where(_days(self.start, self.days)), _eq("d_date_sk", "inv_date_sk"))
            .join(_base(db, self.channel), _eq(f"{p}_item_sk", "i_item_sk"))
        )
        keys = ["i_item_id", "i_item_desc", "i_current_price"]
        return top(found.group([F.col(k) for k in keys]), keys, self.limit)


@dataclass(frozen=True)
class ReturningCustomers:
    """84: customers of a city and an income band, a row for each return of their demographics; one flat witness a row."""

    city: str
    income: int
    span: int = 50000
    limit: int = 100

    def run(self, db: Tables) -> DataFrame:
        living = (
            _base(db, "customer")
            .join(_base(db, "customer_address").where(F.col("ca_city") == self.city), _eq("c_current_addr_sk", "ca_address_sk"))
            .join(_base(db, "household_demographics"), _eq("hd_demo_sk", "c_current_hdemo_sk"))
            .join(_base(db, "income_band").where((F.col("ib_lower_bound") >= self.income) & (F.col("ib_upper_bound") <= self.income + self.span)), _eq("ib_income_band_sk", "hd_income_band_sk"))
            .join(_base(db, "customer_demographics"), _eq("cd_demo_sk", "c_current_cdemo_sk"))
            .in_order("customer", "customer_address", "customer_demographics", "household_demographics", "income_band")
        )
        found = first_matches(living, _base(db, "store_returns"), _eq("sr_cdemo_sk", "cd_demo_sk"), "sr_cdemo_sk", F.col("c_customer_id"), self.limit)
        name = F.concat(F.coalesce("c_last_name", F.lit("")), F.lit(", "), F.coalesce("c_first_name", F.lit("")))
        return top(found.project(F.col("c_customer_id").alias("customer_id"), name.alias("customername")), ["customer_id", "prov"], self.limit)


@dataclass(frozen=True)
class WebReturns:
    """85: averages of returned web sales by reason, under predicates on equal demographics of both parties."""

    people: Sequence[Arm]
    places: Sequence[Place]
    year: int = 2000
    limit: int = 100

    def run(self, db: Tables) -> DataFrame:
        returned = (
            _base(db, "web_sales")
            .join(_base(db, "web_page"), _eq("ws_web_page_sk", "wp_web_page_sk"))
            .join(_base(db, "web_returns"), _eq("ws_item_sk", "wr_item_sk") & _eq("ws_order_number", "wr_order_number"))
            .join(_base(db, "date_dim").where(F.col("d_year") == self.year), _eq("ws_sold_date_sk", "d_date_sk"))
            .join(_base(db, "customer_demographics", "cd1"), _eq("cd1.cd_demo_sk", "wr_refunded_cdemo_sk"))
            .join(_base(db, "customer_demographics", "cd2"), _eq("cd2.cd_demo_sk", "wr_returning_cdemo_sk") & _eq("cd1.cd_marital_status", "cd2.cd_marital_status") & _eq("cd1.cd_education_status", "cd2.cd_education_status"))
            .where(either([_person(a, "ws_sales_price", "cd1.") for a in self.people]))
            .join(_base(db, "customer_address"), _eq("ca_address_sk", "wr_refunded_addr_sk"))
            .where(either([_place(p, "ws_net_profit") for p in self.places]))
            .join(_base(db, "reason"), _eq("r_reason_sk", "wr_reason_sk"))
            .in_order("web_sales", "web_returns", "web_page", "cd1", "cd2", "customer_address", "date_dim", "reason")
        )
        names = ("avg_quantity", "avg_refunded_cash", "avg_fee")
        groups = returned.group([F.col("r_reason_desc")], *[average(c).alias(n) for c, n in zip(("ws_quantity", "wr_refunded_cash", "wr_fee"), names)])
        rows = groups.withColumn("reason", F.substring("r_reason_desc", 1, 20))
        return top(rows, ["reason", *names, "r_reason_desc"], self.limit).select("reason", *names, "prov")


#: Relations of each template in witness order; a table used twice has two aliases.
WITNESS = {
    12: ("web_sales", "item", "date_dim"),
    13: ("store_sales", "store", "customer_demographics", "household_demographics", "customer_address", "date_dim"),
    18: ("catalog_sales", "cd1", "cd2", "customer", "customer_address", "date_dim", "item"),
    20: ("catalog_sales", "item", "date_dim"),
    37: ("item", "inventory", "date_dim", "catalog_sales"),
    48: ("store_sales", "store", "customer_demographics", "customer_address", "date_dim"),
    82: ("item", "inventory", "date_dim", "store_sales"),
    84: ("customer", "customer_address", "customer_demographics", "household_demographics", "income_band", "store_returns"),
    85: ("web_sales", "web_returns", "web_page", "cd1", "cd2", "customer_address", "date_dim", "reason"),
    98: ("store_sales", "item", "date_dim"),
}


def witnesses(rows: DataFrame) -> DataFrame:
    """The rows with `witnesses` (a list of witnesses) in place of `prov`; a flat witness becomes a list of one."""
    flat = dict(rows.dtypes)["prov"] == "array<string>"
    return rows.withColumn("witnesses", F.array("prov") if flat else F.col("prov")).drop("prov")
