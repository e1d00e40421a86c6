"""The minimum slice: completed-order value by customer segment and quarter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources.tables import table


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
    joined = orders.join(table(spark, sf_dir, "customer"), orders.o_custkey == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment", F.date_trunc("quarter", "o_orderdate").cast("date").alias("quarter")).agg(
        F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("value"), F.round(F.avg("o_totalprice"), 4).alias("avg_value")
    )


QUERIES = {
    "flagship_segment_quarter": (
        flagship,
        """SELECT c_mktsegment, date_trunc('quarter', o_orderdate)::DATE AS quarter, count(*) AS n_orders,
           round(sum(o_totalprice), 2) AS value, round(avg(o_totalprice), 4) AS avg_value
           FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY ALL""",
    )
}
