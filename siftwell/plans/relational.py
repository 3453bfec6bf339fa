"""The relational operators over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.plans.registry import register
from siftwell.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = register(QUERIES, SQL)


@query("""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n
from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"),
    )


@query("""select n_name, c_mktsegment, count(*) as orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2""")
def segment_totals(spark, d):
    # Orders are added up per customer before the join, so the join moves one row per customer.
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("t"))
    rows = per.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name", "c_mktsegment").agg(F.sum("n").alias("orders"), F.round(F.sum("t"), 2).alias("total"))


@query("""select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)""")
def customers_without_orders(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(orders, "c_custkey", "left_anti")


@query("""select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place from orders) where place <= 3""")
def top_orders(spark, d):
    from siftwell.operators.dedup import skewed_cap

    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return skewed_cap(rows, "o_custkey", 3, F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey"))


@query("""select o_orderstatus, count(*) filter (where o_orderpriority = '1-URGENT') as urgent, count(*) filter (where o_orderpriority = '5-LOW') as low from orders group by 1""")
def priority_pivot(spark, d):
    rows = table(spark, d, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.count(F.lit(1)))
    return rows.select("o_orderstatus", F.coalesce("1-URGENT", F.lit(0)).alias("urgent"), F.coalesce("5-LOW", F.lit(0)).alias("low"))


@query("""select p_partkey from part intersect select l_partkey from lineitem where l_quantity > 49""")
def parts_in_bulk(spark, d):
    bulk = table(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").intersect(bulk)
