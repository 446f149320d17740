"""Loading the given tables, and the dirtied forms that both engines derive
from them with the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Customers with planted defects: label variants, gaps, numbers and dates as
# text, constant and near-constant columns, repeated rows.
CUSTOMER = {
    "cust_id": "c_custkey % 1400",
    "segment": "CASE WHEN c_custkey % 10 = 0 THEN concat(lower(c_mktsegment), ' ') "
               "WHEN c_custkey % 10 = 1 THEN concat(' ', c_mktsegment) ELSE c_mktsegment END",
    "padded": "CASE WHEN c_custkey % 4 = 0 THEN concat(c_mktsegment, '  ') ELSE concat(c_mktsegment, '_') END",
    "balance": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END",
    "spend": "CASE WHEN c_custkey % 40 = 0 THEN c_acctbal * 20 ELSE c_acctbal END",
    "sparse": "CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_nationkey END",
    "few_gaps": "CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_nationkey END",
    "amount": "CASE WHEN c_custkey % 13 = 0 THEN 'n/a' WHEN c_custkey % 5 = 0 "
              "THEN concat('1,', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), '.5') "
              "ELSE CAST(c_custkey AS STRING) END",
    "joined": "CASE WHEN c_custkey % 11 = 0 THEN 'soon' WHEN c_custkey % 11 = 1 THEN '3/14/2024' "
              "ELSE concat('2024-0', CAST(1 + c_custkey % 9 AS STRING), '-1', CAST(c_custkey % 10 AS STRING)) END",
    "vip": "CASE WHEN c_custkey % 3 = 0 THEN 'Yes' ELSE 'no ' END",
    "flag": "CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END",
    "channel": "CASE WHEN c_custkey % 100 = 0 THEN 'shop' ELSE 'web' END",
    "plan": "'basic'",
    "nothing": "CAST(NULL AS DOUBLE)",
    "churn_score": "c_acctbal / 100",
}
CUSTOMER_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in CUSTOMER.items()) + " FROM customer"


def dirty_customer(spark: SparkSession, folder: str, *names: str, key: bool = False) -> DataFrame:
    """Dirtied customers; with ``key`` the unique ``c_custkey`` comes first."""
    wanted = names or tuple(CUSTOMER)
    exprs = [f"{CUSTOMER[n]} AS {n}" for n in wanted]
    return table(spark, folder, "customer").selectExpr(*(["c_custkey"] if key else []), *exprs)


def dirty_sql(*names: str, key: bool = False) -> str:
    wanted = names or tuple(CUSTOMER)
    cols = (["c_custkey"] if key else []) + [f"{CUSTOMER[n]} AS {n}" for n in wanted]
    return "SELECT " + ", ".join(cols) + " FROM customer"


# Lines with exact copies: a narrow projection of lineitem.
LINES = ["l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_suppkey"]
# Gaps in numbers, the same rule in both engines.
GAPPY_LINES = {
    "l_orderkey": "l_orderkey",
    "l_linenumber": "l_linenumber",
    "quantity": "CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_quantity END",
    "price": "CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_extendedprice END",
    "discount": "l_discount",
    "tax": "l_tax",
    "one": "CAST(1 AS DOUBLE)",
    "returnflag": "l_returnflag",
}


def gappy_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in GAPPY_LINES.items()])


GAPPY_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in GAPPY_LINES.items()) + " FROM lineitem"


def union_all(parts) -> str:
    return "\nUNION ALL\n".join(parts)
