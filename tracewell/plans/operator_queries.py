"""One query for each relational operator of the templates, over the driver's tables, with the SQL that answers it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.algebra import Relation, average, either, share, top

Query = Callable[[SparkSession, str], DataFrame]
_made: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _query(sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _made[f.__name__], _sql[f.__name__] = f, sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("select p_partkey, p_type from part where p_type in ('ECONOMY', 'PROMO', 'SMALL')")
def filter_in_str(spark, sf_dir):
    return _t(spark, sf_dir, "part").where(F.col("p_type").isin("ECONOMY", "PROMO", "SMALL")).select("p_partkey", "p_type")


@_query("select p_partkey, p_size from part where p_size in (10, 20, 30, 40)")
def filter_in_int(spark, sf_dir):
    return _t(spark, sf_dir, "part").where(F.col("p_size").isin(10, 20, 30, 40)).select("p_partkey", "p_size")


@_query("select p_partkey, p_retailprice from part where p_retailprice between 920 and 920 + 30")
def between_num(spark, sf_dir):
    return _t(spark, sf_dir, "part").where(F.col("p_retailprice").between(920, F.lit(920) + 30)).select("p_partkey", "p_retailprice")


@_query("select o_orderkey, cast(o_orderdate as date) as day from orders where cast(o_orderdate as date) between date '1997-08-09' and date '1997-08-09' + interval 30 day")
def date_window(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    start = F.lit("1997-08-09").cast("date")
    return _t(spark, sf_dir, "orders").where(day.between(start, F.date_add(start, 30))).select("o_orderkey", day.alias("day"))


@_query("""select o_orderpriority, count(*) as n from orders, customer where
(o_custkey = c_custkey and c_mktsegment = 'BUILDING' and o_orderpriority = '1-URGENT' and o_totalprice between 1000 and 100000) or
(o_custkey = c_custkey and c_mktsegment = 'MACHINERY' and o_orderpriority = '2-HIGH' and o_totalprice between 50000 and 200000) or
(o_custkey = c_custkey and c_mktsegment = 'FURNITURE' and o_orderpriority = '5-LOW' and o_totalprice between 150000 and 400000) group by o_orderpriority""")
def or_arms_factored(spark, sf_dir):
    orders, customer = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer")
    arms = [(F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_mktsegment") == s) & (F.col("o_orderpriority") == p) & F.col("o_totalprice").between(a, b) for s, p, a, b in (("BUILDING", "1-URGENT", 1000, 100000), ("MACHINERY", "2-HIGH", 50000, 200000), ("FURNITURE", "5-LOW", 150000, 400000))]
    return orders.join(customer, either(arms)).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@_query("select c_custkey, c_acctbal from customer where c_acctbal >= 1000 and c_acctbal <= 1000 + 5000")
def band_filter(spark, sf_dir):
    return _t(spark, sf_dir, "customer").where((F.col("c_acctbal") >= 1000) & (F.col("c_acctbal") <= F.lit(1000) + 5000)).select("c_custkey", "c_acctbal")


@_query("select p_brand, n_name, count(*) as n from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by p_brand, n_name")
def join_star3(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    rows = line.join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(_t(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("p_brand", "n_name").agg(F.count(F.lit(1)).alias("n"))


@_query("select r_name, c_mktsegment, count(*) as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name, c_mktsegment")
def join_snowflake(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@_query("select n1.n_name as seller, n2.n_name as buyer, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey join nation n1 on s_nationkey = n1.n_nationkey join nation n2 on c_nationkey = n2.n_nationkey where n1.n_regionkey = n2.n_regionkey group by 1, 2")
def self_join_dim(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation")
    rows = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(nation.alias("n1"), F.col("s_nationkey") == F.col("n1.n_nationkey")).join(nation.alias("n2"), (F.col("c_nationkey") == F.col("n2.n_nationkey")) & (F.col("n1.n_regionkey") == F.col("n2.n_regionkey")))
    return rows.groupBy(F.col("n1.n_name").alias("seller"), F.col("n2.n_name").alias("buyer")).agg(F.count(F.lit(1)).alias("n"))


@_query("select a.l_returnflag as first_flag, b.l_returnflag as second_flag, count(*) as n from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey = b.l_partkey group by 1, 2")
def join_composite_key(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    rows = line.withColumnRenamed("l_returnflag", "first_flag").join(line.withColumnRenamed("l_returnflag", "second_flag"), ["l_orderkey", "l_partkey"])
    return rows.groupBy("first_flag", "second_flag").agg(F.count(F.lit(1)).alias("n"))


@_query("select a.l_partkey as part, count(*) as n from lineitem a join lineitem b on a.l_partkey = b.l_partkey where cast(a.l_shipdate as date) between date '1999-04-12' and date '1999-04-12' + interval 60 day group by 1")
def join_many_to_many(spark, sf_dir):
    line, start = _t(spark, sf_dir, "lineitem"), F.lit("1999-04-12").cast("date")
    stock = line.where(F.col("l_shipdate").cast("date").between(start, F.date_add(start, 60))).select(F.col("l_partkey").alias("part"))
    return stock.join(line.select(F.col("l_partkey").alias("part")), "part").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@_query(_sql["join_many_to_many"])
def count_many_to_many(spark, sf_dir):
    """The same counts where only they are asked for: a part's count of pairs is a product of counts, so no pair is made."""
    line, start = _t(spark, sf_dir, "lineitem"), F.lit("1999-04-12").cast("date")
    stock = line.where(F.col("l_shipdate").cast("date").between(start, F.date_add(start, 60))).groupBy(F.col("l_partkey").alias("part")).agg(F.count(F.lit(1)).alias("k"))
    sold = line.groupBy(F.col("l_partkey").alias("part")).agg(F.count(F.lit(1)).alias("m"))
    return stock.join(sold, "part").select("part", (F.col("k") * F.col("m")).alias("n"))


_MONEY = "cast(l_extendedprice as decimal(12,2))"


@_query(f"select p_brand, sum({_MONEY}) as revenue from lineitem join part on l_partkey = p_partkey group by p_brand")
def sum_grouped(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.expr(f"sum({_MONEY})").alias("revenue"))


@_query(f"select l_returnflag, round(cast(sum(cast(l_quantity as decimal(12,2))) as double) / count(l_quantity), 6) as avg_quantity, round(cast(sum({_MONEY}) as double) / count(*), 6) as avg_price from lineitem group by l_returnflag")
def avg_decimal_cast(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(average(F.col("l_quantity").cast("decimal(12,2)")), 6).alias("avg_quantity"), F.round(average(F.expr(_MONEY)), 6).alias("avg_price"))


@_query(f"select cast(sum(cast(l_quantity as int)) as bigint) as sum_quantity, round(cast(sum({_MONEY}) as double) / count(*), 6) as avg_price, sum({_MONEY}) as sum_price from lineitem")
def global_agg(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").agg(F.sum(F.col("l_quantity").cast("int")).alias("sum_quantity"), F.round(average(F.expr(_MONEY)), 6).alias("avg_price"), F.expr(f"sum({_MONEY})").alias("sum_price"))


@_query("select p_name, p_brand, p_type from part group by p_name, p_brand, p_type")
def group_dedup(spark, sf_dir):
    return _t(spark, sf_dir, "part").groupBy("p_name", "p_brand", "p_type").agg(F.count(F.lit(1))).select("p_name", "p_brand", "p_type")


_ROLLUP = "lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey join part on l_partkey = p_partkey"


@_query(f"select p_brand, r_name, n_name, c_mktsegment, round(cast(sum(cast(l_quantity as decimal(12,2))) as double) / count(l_quantity), 6) as agg1, count(*) as n_witnesses from {_ROLLUP} where o_orderstatus = 'F' and cast(o_orderdate as date) between date '1999-01-01' and date '1999-06-30' group by rollup (p_brand, r_name, n_name, c_mktsegment)")
def rollup4(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    orders = _t(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "F") & day.between("1999-01-01", "1999-06-30")).withColumn("prov", F.concat(F.lit("O"), F.col("o_orderkey") + 1))
    tables = {n: _t(spark, sf_dir, n) for n in ("lineitem", "customer", "nation", "region", "part")}
    rows = Relation.base(orders, "orders")
    df = rows.df.join(tables["lineitem"], F.col("l_orderkey") == F.col("o_orderkey")).join(tables["customer"], F.col("o_custkey") == F.col("c_custkey")).join(tables["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(tables["region"], F.col("n_regionkey") == F.col("r_regionkey")).join(tables["part"], F.col("l_partkey") == F.col("p_partkey"))
    rolled = Relation(df, rows.tokens).rollup(["p_brand", "r_name", "n_name", "c_mktsegment"], {"agg1": F.col("l_quantity").cast("decimal(12,2)")})
    return rolled.select("p_brand", "r_name", "n_name", "c_mktsegment", F.round("agg1", 6).alias("agg1"), F.coalesce(F.size("prov"), F.lit(0)).cast("long").alias("n_witnesses"))


@_query(f"with g as (select p_type, p_brand, sum({_MONEY}) as revenue from lineitem join part on l_partkey = p_partkey group by 1, 2) select p_type, p_brand, revenue, round(cast(revenue as double) * 100 / cast(sum(revenue) over (partition by p_brand) as double), 6) as ratio from g")
def window_share(spark, sf_dir):
    groups = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type", "p_brand").agg(F.expr(f"sum({_MONEY})").alias("revenue"))
    return share(groups, "revenue", ["p_brand"], 100, "ratio").withColumn("ratio", F.round("ratio", 6))


@_query("select c_custkey, case when c_custkey % 5 = 0 then null else c_mktsegment end as segment from customer order by segment nulls last, c_custkey limit 1300")
def sort_nulls_last_limit(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("segment"))
    return top(rows, ["segment", "c_custkey"], 1300)


@_query("select c_custkey, concat(coalesce(case when c_custkey % 5 = 0 then null else c_name end, ''), ', ', coalesce(c_mktsegment, '')) as label from customer")
def concat_coalesce(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 5 != 0, F.col("c_name"))
    return _t(spark, sf_dir, "customer").select("c_custkey", F.concat(F.coalesce(name, F.lit("")), F.lit(", "), F.coalesce("c_mktsegment", F.lit(""))).alias("label"))


@_query("select substr(o_orderpriority, 1, 3) as prefix, count(*) as n from orders group by o_orderpriority")
def substr_group(spark, sf_dir):
    return _t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).select(F.substring("o_orderpriority", 1, 3).alias("prefix"), "n")


def queries() -> dict[str, Query]:
    return dict(_made)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
