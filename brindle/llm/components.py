"""Connected components of a link table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import through_table


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b); label is the least node of its component.

    Each round takes the least label among a node and its neighbours, then the
    label of that label, and ends when no label changed. Labels are kept in the
    shared folder between rounds, in an eighth of the usual partitions as their rows
    are narrow.
    """
    few = max(1, int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = through_table(both.coalesce(few), "links")
    labels = through_table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")).coalesce(few), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        jumped = least.join(up, F.col("label") == F.col("up"), "left").select("node", "old", F.least("label", F.coalesce("up_label", "label")).alias("label"))
        jumped = through_table(jumped.coalesce(few), "labels")
        labels = jumped.select("node", "label")
        if jumped.where("old <> label").isEmpty():
            return labels
