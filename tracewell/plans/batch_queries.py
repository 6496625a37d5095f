"""The templates for many instances at a time over the driver's tables, with their SQL: with bags, and as bare witnesses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.algebra import average
from tracewell.plans import templates as T
from tracewell.plans.batch import CHANNELS, PREFIX, batch, instance_witnesses, joined
from tracewell.plans.params import params, params_sql
from tracewell.plans.report_queries import digest
from tracewell.sources.star import star, star_sql

#: Instances of each template in the registered batches.
BATCH = 40

#: The relations of each template that star_sql makes, by the names that the FROM clauses below use.
_SOURCES = {t: [r for r in dict.fromkeys("customer_demographics" if r in ("cd1", "cd2") else r for r in T.WITNESS[t])] for t in T.WITNESS}


def _tokens(template: int) -> list[str]:
    return [f"{r}{'_' * (r == 'customer')}.prov" for r in T.WITNESS[template]]


def _from(template: int) -> str:
    """FROM and WHERE of a template joined with its parameter tables; the instance is p.instance."""
    if template in (12, 20, 98):
        channel = CHANNELS[template]
        x = PREFIX[channel]
        return f"{channel} join item on {x}_item_sk = i_item_sk join revenue{template} p on i_category = category join date_dim on {x}_sold_date_sk = d_date_sk and d_date >= start and d_date <= start + interval 30 day"
    where = f"join customer_address on ca_country = 'United States' join places{template} w on w.instance = p.instance and ca_state = state"
    if template in (13, 48):
        household = "join household_demographics on hd_demo_sk = ss_hdemo_sk and hd_dep_count = dependants" if template == 13 else ""
        return f"""store_sales join store on s_store_sk = ss_store_sk join date_dim on ss_sold_date_sk = d_date_sk join customer_demographics on cd_demo_sk = ss_cdemo_sk
join persons{template} p on cd_marital_status = marital and cd_education_status = education and d_year = year and ss_sales_price between low and high {household}
{where} and ca_address_sk = ss_addr_sk and ss_net_profit between p_low and p_high"""
    if template == 18:
        return """catalog_sales join date_dim on cs_sold_date_sk = d_date_sk join item on cs_item_sk = i_item_sk join customer_demographics cd1 on cs_bill_cdemo_sk = cd1.cd_demo_sk
join buyers18 p on cd1.cd_gender = gender and cd1.cd_education_status = education and d_year = year
join customer_ on cs_bill_customer_sk = c_customer_sk join months18 m on m.instance = p.instance and c_birth_month = month
join customer_demographics cd2 on c_current_cdemo_sk = cd2.cd_demo_sk join customer_address on c_current_addr_sk = ca_address_sk join states18 s on s.instance = p.instance and ca_state = state"""
    if template in (37, 82):
        channel = CHANNELS[template]
        return f"""item join makers{template} m on i_manufact_id = maker join stock{template} p on m.instance = p.instance and i_current_price >= price and i_current_price <= price + 30
join inventory on inv_item_sk = i_item_sk and inv_quantity_on_hand between 100 and 500 join date_dim on d_date_sk = inv_date_sk and d_date >= start and d_date <= start + interval 60 day
join {channel} on {PREFIX[channel]}_item_sk = i_item_sk"""
    if template == 84:
        return """customer_ join customer_address on c_current_addr_sk = ca_address_sk join customers84 p on ca_city = city join household_demographics on hd_demo_sk = c_current_hdemo_sk
join income_band on ib_income_band_sk = hd_income_band_sk and ib_lower_bound >= income and ib_upper_bound <= income + 50000
join customer_demographics on cd_demo_sk = c_current_cdemo_sk join store_returns on sr_cdemo_sk = cd_demo_sk"""
    return f"""web_sales join web_page on ws_web_page_sk = wp_web_page_sk join web_returns on ws_item_sk = wr_item_sk and ws_order_number = wr_order_number
join date_dim on ws_sold_date_sk = d_date_sk join customer_demographics cd1 on cd1.cd_demo_sk = wr_refunded_cdemo_sk
join persons85 p on cd1.cd_marital_status = marital and cd1.cd_education_status = education and d_year = year and ws_sales_price between low and high
join customer_demographics cd2 on cd2.cd_demo_sk = wr_returning_cdemo_sk and cd1.cd_marital_status = cd2.cd_marital_status and cd1.cd_education_status = cd2.cd_education_status
{where} and ca_address_sk = wr_refunded_addr_sk and ws_net_profit between p_low and p_high join reason on r_reason_sk = wr_reason_sk"""


def witness_select(template: int) -> str:
    """A SELECT of instance and witness, after the tables of sources() and params_sql()."""
    return f"select p.instance, [{', '.join(_tokens(template))}] as witness from {_from(template)}"


def sources(*templates: int) -> str:
    """The relations of the templates as common table expressions."""
    return star_sql(*dict.fromkeys(r for t in templates for r in _SOURCES[t]))


def _mean(column: str, name: str) -> str:
    return f"round(cast(sum({column}) as double) / nullif(count({column}), 0), 6) as {name}"


def _batch_sql(template: int, n: int) -> str:
    text = f"concat_ws('|', {', '.join(_tokens(template))})"
    bag = f"count({text}) as n_witnesses, md5(string_agg({text}, ';' order by {text})) as witness_md5"
    head = f"with {sources(template)}, {params_sql(template, n)}"
    rows = _from(template)
    first = lambda keys: f"row_number() over (partition by instance order by {', '.join(f'{k} nulls last' for k in keys)}) <= 100"
    if template in (12, 20, 98):
        x = PREFIX[CHANNELS[template]]
        keys = "i_item_id, i_item_desc, i_category, i_class, i_current_price"
        limit = "" if template == 98 else "qualify " + first(["i_category", "i_class", "i_item_id", "i_item_desc", "revenueratio", "i_current_price"])
        return f"""{head}, revenue as (select p.instance, {keys}, sum({x}_ext_sales_price) as itemrevenue, {bag} from {rows} group by p.instance, {keys}),
shares as (select *, round(cast(itemrevenue as double) * 100 / cast(sum(itemrevenue) over (partition by instance, i_class) as double), 6) as revenueratio from revenue) select * from shares {limit}"""
    if template in (13, 48):
        values = f"{_mean('ss_quantity', 'avg_quantity')}, {_mean('ss_ext_sales_price', 'avg_ext_sales_price')}, {_mean('ss_ext_wholesale_cost', 'avg_ext_wholesale_cost')}, sum(ss_ext_wholesale_cost) as sum_ext_wholesale_cost" if template == 13 else "cast(sum(ss_quantity) as bigint) as sum_quantity"
        return f"{head}, found as (select p.instance, {values}, {bag} from {rows} group by p.instance) select a.instance, found.* exclude (instance, n_witnesses), coalesce(n_witnesses, 0) as n_witnesses from (select distinct instance from persons{template}) a left join found on a.instance = found.instance"
    if template == 18:
        columns = ("cs_quantity", "cs_list_price", "cs_coupon_amt", "cs_sales_price", "cs_net_profit", "c_birth_year", "cd1.cd_dep_count")
        keys = ("i_item_id", "ca_country", "ca_state", "ca_county")
        sets = ", ".join(f"({', '.join(('p.instance', *keys[:k]))})" for k in range(4, -1, -1))
        averages = ", ".join(_mean(f"cast({v} as decimal(12,2))", f"agg{k}") for k, v in enumerate(columns, 1))
        return f"""{head}, rolled as (select p.instance, {', '.join(keys)}, grouping({', '.join(keys)}) as gid, {averages}, {bag} from {rows} group by grouping sets ({sets})),
found as (select * exclude gid from rolled qualify {first(['ca_country', 'ca_state', 'ca_county', 'i_item_id', 'gid'])})
select b.instance, found.* exclude (instance, n_witnesses), coalesce(n_witnesses, 0) as n_witnesses from buyers18 b left join found on b.instance = found.instance"""
    if template in (37, 82):
        keys = ("i_item_id", "i_item_desc", "i_current_price")
        return f"{head}, found as (select p.instance, {', '.join(keys)}, {bag} from {rows} group by p.instance, {', '.join(keys)}) select * from found qualify {first(keys)}"
    if template == 84:
        return f"""{head}, found as (select p.instance, c_customer_id as customer_id, concat(coalesce(c_last_name, ''), ', ', coalesce(c_first_name, '')) as customername, [{', '.join(_tokens(84))}] as prov from {rows})
select instance, customer_id, customername, cast(1 as bigint) as n_witnesses, md5(array_to_string(prov, '|')) as witness_md5 from found qualify {first(['customer_id', 'prov'])}"""
    names = ("avg_quantity", "avg_refunded_cash", "avg_fee")
    return f"""{head}, found as (select p.instance, r_reason_desc, substr(r_reason_desc, 1, 20) as reason, {', '.join(_mean(c, n_) for c, n_ in zip(('ws_quantity', 'wr_refunded_cash', 'wr_fee'), names))}, {bag} from {rows} group by p.instance, r_reason_desc)
select * exclude r_reason_desc from found qualify {first(['reason', *names, 'r_reason_desc'])}"""


def _run(template: int) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: digest(batch(template, star(spark, sf_dir), params(spark, template, BATCH)))


def _run_digest(template: int) -> Callable[[SparkSession, str], DataFrame]:
    """For bags of any size: the number of witnesses and an order-free digest, with the quantities."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        sold = joined(template, star(spark, sf_dir), params(spark, template, BATCH))
        return sold.digest([F.col("instance")], F.round(average("ss_quantity"), 6).alias("avg_quantity"))

    return query


def _digest_sql(template: int) -> str:
    text = f"concat_ws('|', {', '.join(_tokens(template))})"
    return f"with {sources(template)}, {params_sql(template, BATCH)} select p.instance, {_mean('ss_quantity', 'avg_quantity')}, count(*) as n_witnesses, cast(sum(cast(concat('0x', substr(md5({text}), 1, 15)) as bigint)) as decimal(38,0)) as witness_digest from {_from(template)} group by p.instance"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"batch_{t}": _run(t) for t in T.WITNESS} | {f"digest_{t}": _run_digest(t) for t in (13, 48)}


def oracle_sql() -> dict[str, str]:
    return {f"batch_{t}": _batch_sql(t, BATCH) for t in T.WITNESS} | {f"digest_{t}": _digest_sql(t) for t in (13, 48)}


def corpus(spark: SparkSession, sf_dir: str, counts: dict[int, int]) -> DataFrame:
    """(template, instance, witness) of the first instances of each template, each template run as one batch."""
    db, out = star(spark, sf_dir), None
    for template, n in counts.items():
        rows = instance_witnesses(template, db, params(spark, template, n)).select(F.lit(template).alias("template"), "instance", "witness")
        out = rows if out is None else out.union(rows)
    return out


def corpus_sql(counts: dict[int, int]) -> str:
    """The same as common table expressions: witnesses(template, instance, witness) and tokens(template, instance, token)."""
    selects = " union all ".join(f"select {t} as template, * from ({witness_select(t)})" for t in counts)
    return f"with {sources(*counts)}, {', '.join(params_sql(t, n) for t, n in counts.items())}, witnesses as ({selects}), tokens as (select template, instance, unnest(witness) as token from witnesses)"
