"""Connected components of a table of links, by smallest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statekit.session import durable


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(a, b) -> (doc_id, component_id): the smallest id reachable from every id that has a link.

    Each round takes the smallest label of all neighbours, then the label of that label, and is written
    to the shared folder; a hub is combined before the shuffle. Links both ways and twice are allowed.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = durable(spark, both, "links")
    labels = durable(spark, both.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.first("a"), F.min("b")).alias("component_id")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("doc_id", "b"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("component_id").alias("near"))
        step = labels.join(near, "doc_id").select("doc_id", F.col("component_id").alias("old"), F.least("component_id", "near").alias("c"))
        jump = labels.select(F.col("doc_id").alias("c"), F.col("component_id").alias("further"))
        step = step.join(jump, "c").select("doc_id", "old", F.least("c", "further").alias("component_id"))
        step = durable(spark, step, "labels")
        labels = step.select("doc_id", "component_id")
        if not step.where("old != component_id").limit(1).collect():
            return labels
