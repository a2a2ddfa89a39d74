"""Connected components of a distributed table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import looked_up, stored


def _roots(parents: DataFrame) -> DataFrame:
    """(id, label) from (id, label) where labels are ids' smaller neighbours: each one's last label, three steps a round.

    Only the rows of ids that are labels themselves are met: those of large components are met by many.
    """
    parents = stored(parents)
    while True:
        names = parents.select("label").distinct()
        up = stored(parents.join(names.withColumnRenamed("label", "id"), "id", "left_semi").select(F.col("id").alias("label"), F.col("label").alias("up")))
        top = up.toDF("up", "top")
        high = up.join(top, "up", "left").select("label", F.coalesce("top", "up").alias("top"))
        twice = looked_up(parents, stored(high), ["label"], "left").select("id", F.col("label").alias("old"), F.coalesce("top", "label").alias("label"))
        step = stored(twice.withColumn("moved", F.col("label") < F.col("old")))
        parents = step.select("id", "label")
        if step.where("moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """(id, label) of all ids in links (lo, hi), longs: label is the smallest id of the component.

    Each round an id takes its smallest neighbour as parent, trees of parents become their roots, and
    links between different roots go on; at least half of the ids that still have links disappear.
    """
    links = stored(links.select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).where("lo != hi").distinct())
    labels = None
    while not links.isEmpty():
        both = links.union(links.select("hi", "lo")).toDF("id", "to")
        roots = _roots(both.groupBy("id").agg(F.least("id", F.min("to")).alias("label")))
        low = roots.select(F.col("id").alias("lo"), F.col("label").alias("a"))
        high = roots.select(F.col("id").alias("hi"), F.col("label").alias("b"))
        left = looked_up(stored(looked_up(links, low, ["lo"])), high, ["hi"]).where("a != b")
        links = stored(left.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
        labels = roots if labels is None else stored(relabelled(labels, roots))
    return labels if labels is not None else links.toDF("id", "label")


def relabelled(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """labels (id, label) with labels replaced by those that roots (id, label) gives them."""
    new = roots.select(F.col("id").alias("label"), F.col("label").alias("new"))
    return looked_up(labels, new, ["label"], "left").select("id", F.coalesce("new", "label").alias("label"))
