"""The sixteen relations derived from the driver's tables, so that all templates run, and can be checked, on them.

Every column is an expression that Spark and ANSI databases read alike; columns(relation) is the single source of both.
Facts are views of lineitem with its order; lines carry a number in the order of all of their columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.sources.annotate import number_rows
from tracewell.sources.schemas import PREFIXES
from tracewell.sources.staging import memo, stage

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
DAY0 = "date '1990-01-01'"


def _cents(column: str, modulus: int, less: int = 0) -> str:
    return f"cast((cast(round({column} * 100) as bigint) % {modulus} - {less}) * 0.01 as decimal(7,2))"


def _days(column: str) -> str:
    return f"cast({column} as date)"


def _sales(p: str, extra: dict[str, str]) -> dict[str, str]:
    return {f"{p}_sold_date_sk": "order_day", f"{p}_item_sk": "l_partkey", f"{p}_quantity": "cast(l_quantity as int)", f"{p}_sales_price": _cents("l_extendedprice", 20000), f"{p}_ext_sales_price": _cents("l_extendedprice", 1000000), f"{p}_net_profit": _cents("l_extendedprice", 30000)} | {f"{p}_{k}": v for k, v in extra.items()}


#: relation -> (source, columns). Sources: a driver table, `line` (numbered lineitem with its order), returned lines, or a range.
_DERIVED: dict[str, tuple[str, dict[str, str]]] = {
    "store_sales": ("line", _sales("ss", {"store_sk": "l_suppkey % 10", "cdemo_sk": "(l_orderkey * 3 + l_linenumber) % 1400", "hdemo_sk": "l_partkey % 40", "addr_sk": "o_custkey % 200", "ext_wholesale_cost": _cents("l_extendedprice", 50000)})),
    "catalog_sales": ("line", _sales("cs", {"bill_cdemo_sk": "(l_orderkey + l_linenumber) % 1400", "bill_customer_sk": "o_custkey", "list_price": _cents("l_extendedprice", 40000), "coupon_amt": _cents("l_extendedprice", 7000)})),
    "web_sales": ("line", _sales("ws", {"order_number": "l_orderkey", "web_page_sk": "l_suppkey % 10"})),
    "inventory": ("line", {"inv_date_sk": "ship_day", "inv_item_sk": "l_partkey", "inv_quantity_on_hand": "cast(l_quantity as int) * 20"}),
    "store_returns": ("returned", {"sr_cdemo_sk": "(l_orderkey + l_linenumber) % 1400"}),
    "web_returns": ("returned", {"wr_item_sk": "l_partkey", "wr_order_number": "l_orderkey", "wr_reason_sk": "l_suppkey % 8", "wr_refunded_addr_sk": "o_custkey % 200", "wr_refunded_cdemo_sk": "(l_orderkey + l_suppkey) % 1400", "wr_returning_cdemo_sk": "(l_orderkey + l_suppkey + 35 * l_linenumber + l_linenumber % 2) % 1400", "wr_fee": _cents("l_extendedprice", 10000), "wr_refunded_cash": _cents("l_extendedprice", 60000)}),
    "item": ("part", {"i_item_sk": "p_partkey", "i_item_id": "concat('ITEM', lpad(cast(p_partkey as varchar(20)), 8, '0'))", "i_item_desc": "p_name", "i_category": "p_type", "i_class": "p_brand", "i_current_price": _cents("p_retailprice", 10000), "i_manufact_id": "p_partkey % 100"}),
    "customer": ("customer", {"c_customer_sk": "c_custkey", "c_customer_id": "c_name", "c_first_name": "case when c_custkey % 7 = 0 then null else concat('First', cast(c_custkey % 50 as varchar(20))) end", "c_last_name": "case when c_custkey % 11 = 0 then null else concat('Last', cast(c_custkey % 90 as varchar(20))) end", "c_current_cdemo_sk": "c_custkey % 1400", "c_current_hdemo_sk": "c_custkey % 40", "c_current_addr_sk": "c_custkey % 200", "c_birth_month": "cast(c_custkey % 12 + 1 as int)", "c_birth_year": "cast(1940 + c_custkey % 60 as int)"}),
    "customer_address": ("range 200", {"ca_address_sk": "k", "ca_city": "concat('City ', cast(k % 20 as varchar(20)))", "ca_country": "'United States'", "ca_state": "case when k % 37 = 0 then null else split_part('CA,OR,WA,NV,AZ,UT,CO,NM,TX', ',', cast(k % 9 + 1 as int)) end", "ca_county": "case when k % 23 = 0 then null else concat('County ', cast(k % 40 as varchar(20))) end"}),
    "customer_demographics": ("range 1400", {"cd_demo_sk": "k", "cd_marital_status": "split_part('M,S,D,W,U', ',', cast(k % 5 + 1 as int))", "cd_education_status": "split_part('2 yr Degree,4 yr Degree,Advanced Degree,College,Primary,Secondary,Unknown', ',', cast(k % 7 + 1 as int))", "cd_gender": "case when k % 3 = 0 then 'M' else 'F' end", "cd_dep_count": "cast(k % 4 as int)"}),
    "household_demographics": ("range 40", {"hd_demo_sk": "k", "hd_dep_count": "cast(k % 4 as int)", "hd_income_band_sk": "k % 20"}),
    "income_band": ("range 20", {"ib_income_band_sk": "k", "ib_lower_bound": "cast(k * 10000 as int)", "ib_upper_bound": "cast((k + 1) * 10000 as int)"}),
    "store": ("range 10", {"s_store_sk": "k"}),
    "web_page": ("range 10", {"wp_web_page_sk": "k"}),
    "reason": ("range 8", {"r_reason_sk": "k", "r_reason_desc": "concat('Reason description number ', cast(k as varchar(20)))"}),
    "date_dim": ("dates", {"d_date_sk": "k", "d_date": "day", "d_year": "cast(year(day) as int)"}),
}
_KEYS = {"item": "p_partkey", "customer": "c_custkey"}
DAYS = 4500  # from DAY0 to the spring of 2002

def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem, numbered over all columns, with date and customer of its order.

    Made once per application and folder and kept in the shared folder, so a fact is a scan of the columns that are used, without a shuffle."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in memo:
        numbered = number_rows(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*LINE), LINE, "number")
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
        day = lambda c: F.datediff(F.col(c).cast("date"), F.expr(DAY0)).cast("int")
        joined = numbered.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("order_day", day("o_orderdate")).withColumn("ship_day", day("l_shipdate"))
        memo[at] = stage(joined.drop("o_orderkey", "o_orderdate"), "lines")
    return memo[at]


def star(spark: SparkSession, sf_dir: str, coded: Callable[[str, Column], Column] | None = None) -> dict[str, DataFrame]:
    """All relations, made when they are first asked for; with `coded`, prov is what it makes of a token's letters and number."""

    def make(relation: str) -> DataFrame:
        source, columns = _DERIVED[relation]
        if source in ("line", "returned"):
            df, key = lines(spark, sf_dir), "number - 1"
            df = df.where("l_returnflag = 'R'") if source == "returned" else df
        elif source == "dates":
            df, key = spark.range(DAYS).select(F.col("id").cast("int").alias("k"), F.expr(f"date_add({DAY0}, cast(id as int))").alias("day")), "k"
        elif source.startswith("range"):
            df, key = spark.range(int(source.split()[1])).withColumnRenamed("id", "k"), "k"
        else:
            df, key = spark.read.parquet(f"{sf_dir}/{source}.parquet"), _KEYS[relation]
        if coded is not None:
            return df.select(*[F.expr(e).alias(n) for n, e in columns.items()], coded(PREFIXES[relation], F.expr(f"cast({key} + 1 as bigint)")).alias("prov"))
        return df.selectExpr(*[f"{e} as {n}" for n, e in columns.items()], f"concat('{PREFIXES[relation]}', cast({key} + 1 as varchar(20))) as prov")

    class Tables(dict):
        def __missing__(self, relation: str) -> DataFrame:
            self[relation] = make(relation)
            return self[relation]

    return Tables()


#: Relations of which each row is a line, with a number of its own.
FACTS = frozenset(r for r, (source, _) in _DERIVED.items() if source in ("line", "returned"))


def keys_are_unique(spark: SparkSession, sf_dir: str) -> bool:
    """Whether no key of orders, part or customer is found twice, so that a line is one row of each fact and meets one of each dimension."""
    at = (spark.sparkContext.applicationId, f"unique {sf_dir}")
    if at not in memo:
        keys = {"orders": "o_orderkey", "part": "p_partkey", "customer": "c_custkey"}
        memo[at] = all(spark.read.parquet(f"{sf_dir}/{t}.parquet").groupBy(k).count().where("count > 1").isEmpty() for t, k in keys.items())
    return memo[at]


def star_sql(*relations: str) -> str:
    """The same relations as common table expressions in DuckDB's SQL, without the leading WITH; customer is named customer_."""
    out = []
    if any(_DERIVED[r][0] in ("line", "returned") for r in relations):
        out.append(f"line as (select l.*, o_custkey, date_diff('day', {DAY0}, cast(o_orderdate as date)) as order_day, date_diff('day', {DAY0}, cast(l_shipdate as date)) as ship_day from (select *, row_number() over (order by {', '.join(LINE)}) as number from lineitem) l join orders on l_orderkey = o_orderkey)")
    for relation in relations:
        source, columns = _DERIVED[relation]
        if source in ("line", "returned"):
            origin, key = "line" + " where l_returnflag = 'R'" * (source == "returned"), "number - 1"
        elif source == "dates":
            origin, key = f"(select cast(k as int) as k, cast({DAY0} + cast(k as int) as date) as day from range({DAYS}) t(k))", "k"
        elif source.startswith("range"):
            origin, key = f"range({source.split()[1]}) t(k)", "k"
        else:
            origin, key = source, _KEYS[relation]
        listed = ", ".join(f"{e} as {n}" for n, e in columns.items())
        out.append(f"{relation}{'_' if source == relation else ''} as (select {listed}, concat('{PREFIXES[relation]}', cast({key} + 1 as varchar)) as prov from {origin})")
    return ", ".join(out)
