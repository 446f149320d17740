"""Reporting views over an order-shaped star schema.

Child tables are summed before they are joined, so two child tables never
multiply each other's rows, and each large side is shuffled once on its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def money(name: str) -> Column:
    """Amounts are added as decimals, so totals do not depend on the order of rows."""
    return F.col(name).cast("decimal(15,2)")


def order_summary(orders: DataFrame, customer: DataFrame, nation: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One row per order with customer, nation, item count and value; orders without items stay."""
    items = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("items"), F.sum(money("l_extendedprice") * (1 - money("l_discount"))).alias("net")
    )
    named = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.join(items, "o_orderkey", "left").select(
        "o_orderkey", F.concat_ws(" / ", "c_name", "n_name").alias("customer"), "o_orderstatus",
        F.coalesce("items", F.lit(0).cast("long")).alias("items"), F.coalesce(F.round("net", 2).cast("double"), F.lit(0.0)).alias("net"),
    )


def product_performance(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Units, revenue, orders, return share and margin per product; unsold products stay."""
    sold = lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.sum("l_quantity").alias("units"), F.sum("l_extendedprice").alias("revenue"), F.count_distinct("l_orderkey").alias("orders")
    )
    returned = lineitem.filter(F.col("l_returnflag") == "R").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count("*").alias("returns"), F.avg("l_discount").alias("return_discount")
    )
    cost = F.col("units") * F.col("p_retailprice")
    return part.join(sold, "p_partkey", "left").join(returned, "p_partkey", "left").select(
        "p_partkey", "p_brand", F.coalesce("units", F.lit(0.0)).alias("units"), F.round(F.coalesce("revenue", F.lit(0.0)), 2).alias("revenue"),
        F.coalesce("orders", F.lit(0).cast("long")).alias("orders"), F.coalesce("returns", F.lit(0).cast("long")).alias("returns"),
        F.round("return_discount", 8).alias("return_discount"),
        F.round(F.try_divide((F.col("revenue") - cost) * 100, F.col("revenue")), 2).alias("margin_pct"),
    )


def years_between(later: Column, earlier: Column) -> Column:
    return F.floor(F.months_between(later, earlier) / 12).cast("long")


def people_summary(people: DataFrame, work: DataFrame, today: Column) -> DataFrame:
    """Person, manager, mean work value, distinct work days and whole years since the first one.

    ``people`` has ``id, name, team, manager_id``; ``work`` has ``person_id, value, at``.
    """
    done = work.groupBy(F.col("person_id").alias("id")).agg(
        F.avg("value").alias("mean_value"), F.count_distinct("at").alias("days"), F.min("at").alias("first")
    )
    managers = people.select(F.col("id").alias("manager_id"), F.col("name").alias("manager"))
    return people.join(managers, "manager_id", "left").join(done, "id", "left").select(
        "id", "name", "team", "manager", F.round("mean_value", 6).alias("mean_value"),
        F.coalesce("days", F.lit(0).cast("long")).alias("days"), years_between(today, F.col("first")).alias("years"),
    )


def weekly_support(tickets: DataFrame) -> DataFrame:
    """Per week: tickets, open and failed ones, and the mean value of closed ones.

    ``tickets`` has ``at, kind, value``.
    """
    closed = F.col("kind") != "error"
    return tickets.groupBy(F.date_trunc("week", "at").alias("week")).agg(
        F.count("*").alias("tickets"), F.count_if(F.col("kind") == "error").alias("failed"),
        F.count_if(F.col("kind") == "purchase").alias("purchases"), F.round(F.avg(F.when(closed, F.col("value"))), 4).alias("mean_closed"),
    )


def monthly_revenue(orders: DataFrame) -> DataFrame:
    return orders.groupBy(F.date_trunc("month", "o_orderdate").alias("month")).agg(
        F.count_distinct("o_orderkey").alias("orders"), F.count_distinct("o_custkey").alias("customers"),
        F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.round(F.avg("o_totalprice"), 6).alias("mean_order"),
        F.count_if(F.col("o_orderstatus") == "F").alias("finished"),
    )


def inventory_status(lineitem: DataFrame, part: DataFrame, supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """Units per product and supplier with a stock level."""
    stock = lineitem.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("units"))
    level = F.when(F.col("units") <= 10, "low").when(F.col("units") <= 40, "normal").otherwise("high")
    return (
        stock.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select("p_partkey", "s_suppkey", "n_name", "units", level.alias("level"))
    )


def lifetime_value(customer: DataFrame, orders: DataFrame, excluded: list[str]) -> DataFrame:
    """Value of all orders not in the excluded states, and a tier per customer."""
    spent = orders.filter(~F.col("o_orderstatus").isin(excluded)).groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum("o_totalprice").alias("v")
    )
    value = F.round(F.coalesce("v", F.lit(0.0)), 2)
    tier = F.when(value >= 2_000_000, "platinum").when(value >= 1_000_000, "gold").when(value >= 250_000, "silver").otherwise("bronze")
    return customer.join(spent, "c_custkey", "left").select("c_custkey", value.alias("value"), tier.alias("tier"))


def sample_pairs(df: DataFrame, key: str, options: list, percent: int) -> DataFrame:
    """Attach a fixed share of a short option list to each row.

    The options live in the row expression, so no cross product is formed: each
    row emits only the pairs that are chosen.
    """
    chosen = F.filter(
        F.array(*[F.lit(o) for o in options]),
        lambda o: F.pmod(F.col(key) * 7919 + o * 104729, F.lit(100)) < percent,
    )
    return df.select(key, F.explode(chosen).alias("option"))
