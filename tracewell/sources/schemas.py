"""The sixteen relations of the report templates, each with the columns that the templates use, and their token prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_MONEY = "decimal(7,2)"
#: Fixed: relation -> columns and types of the public TPC-DS specification, as far as the templates use them.
_COLUMNS: dict[str, dict[str, list[str]]] = {
    "catalog_sales": {"int": ["cs_bill_cdemo_sk", "cs_bill_customer_sk", "cs_item_sk", "cs_quantity", "cs_sold_date_sk"], _MONEY: ["cs_coupon_amt", "cs_ext_sales_price", "cs_list_price", "cs_net_profit", "cs_sales_price"]},
    "customer": {"int": ["c_birth_month", "c_birth_year", "c_current_addr_sk", "c_current_cdemo_sk", "c_current_hdemo_sk", "c_customer_sk"], "string": ["c_customer_id", "c_first_name", "c_last_name"]},
    "customer_address": {"int": ["ca_address_sk"], "string": ["ca_city", "ca_country", "ca_county", "ca_state"]},
    "customer_demographics": {"int": ["cd_demo_sk", "cd_dep_count"], "string": ["cd_education_status", "cd_gender", "cd_marital_status"]},
    "date_dim": {"date": ["d_date"], "int": ["d_date_sk", "d_year"]},
    "household_demographics": {"int": ["hd_demo_sk", "hd_dep_count", "hd_income_band_sk"]},
    "income_band": {"int": ["ib_income_band_sk", "ib_lower_bound", "ib_upper_bound"]},
    "inventory": {"int": ["inv_date_sk", "inv_item_sk", "inv_quantity_on_hand"]},
    "item": {"int": ["i_item_sk", "i_manufact_id"], "string": ["i_category", "i_class", "i_item_desc", "i_item_id"], _MONEY: ["i_current_price"]},
    "reason": {"string": ["r_reason_desc"], "int": ["r_reason_sk"]},
    "store": {"int": ["s_store_sk"]},
    "store_returns": {"int": ["sr_cdemo_sk"]},
    "store_sales": {"int": ["ss_addr_sk", "ss_cdemo_sk", "ss_hdemo_sk", "ss_item_sk", "ss_quantity", "ss_sold_date_sk", "ss_store_sk"], _MONEY: ["ss_ext_sales_price", "ss_ext_wholesale_cost", "ss_net_profit", "ss_sales_price"]},
    "web_page": {"int": ["wp_web_page_sk"]},
    "web_returns": {"int": ["wr_item_sk", "wr_order_number", "wr_reason_sk", "wr_refunded_addr_sk", "wr_refunded_cdemo_sk", "wr_returning_cdemo_sk"], _MONEY: ["wr_fee", "wr_refunded_cash"]},
    "web_sales": {"int": ["ws_item_sk", "ws_order_number", "ws_quantity", "ws_sold_date_sk", "ws_web_page_sk"], _MONEY: ["ws_ext_sales_price", "ws_net_profit", "ws_sales_price"]},
}
#: Token prefixes; SS and C are given, the others are ours.
PREFIXES = {"catalog_sales": "CS", "customer": "C", "customer_address": "CA", "customer_demographics": "CD", "date_dim": "D", "household_demographics": "HD", "income_band": "IB", "inventory": "INV", "item": "I", "reason": "R", "store": "S", "store_returns": "SR", "store_sales": "SS", "web_page": "WP", "web_returns": "WR", "web_sales": "WS"}
RELATIONS = tuple(_COLUMNS)


def schema(relation: str, prov: bool = True) -> StructType:
    """The relation's columns in alphabetical order, then the token column."""
    columns = sorted((c, kind) for kind, names in _COLUMNS[relation].items() for c in names)
    return StructType.fromDDL(", ".join([*(f"{c} {kind}" for c, kind in columns), *["prov string"] * prov]))


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The relations under folder as Parquet, with the fixed schemas; what is missing is left out only if never asked for."""

    class Tables(dict):
        def __missing__(self, relation: str) -> DataFrame:
            self[relation] = spark.read.schema(schema(relation)).parquet(f"{folder}/{relation}.parquet")
            return self[relation]

    return Tables()
