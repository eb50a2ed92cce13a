"""Connected components by minimum labels with hooking and pointer jumping, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """links: a, b. Returns node, label for every node that has a link; label is the component's smallest node.

    A round lowers each label to the smallest one around, lowers the labels of all that shared the old label with it,
    and then jumps to the label's own label, so the rounds grow with the logarithm of a component's width. Each
    round's labels are a written table. A null end or a link to itself is ignored.
    """
    links = links.filter("a <> b")
    both = materialize(links.union(links.select("b", "a")).toDF("node", "near").distinct())
    labels = materialize(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("label")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "near"), "near").groupBy("node").agg(F.min("label").alias("low"))
        # Written, as it is read twice: so a round goes through the links once.
        lower = materialize(labels.join(around, "node").select("node", "label", F.least("label", "low").alias("low")))
        hooked = lower.groupBy("label").agg(F.min("low").alias("hook"))
        lower = materialize(lower.join(hooked, "label").select("node", "label", F.least("low", "hook").alias("low")))
        jump = lower.select(F.col("node").alias("low"), F.col("low").alias("next"))
        labels = materialize(lower.join(jump, "low").select("node", F.col("label").alias("was"), F.least("low", "next").alias("label")))
        if labels.filter("was <> label").isEmpty():
            return labels.select("node", "label")


def merge_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels: what connected_components gave for some links. Returns the same as it gives for these and the links: a, b.

    Only the labels that the new links join are compared; the links that gave the labels are not read again.
    """
    links = links.filter("a <> b").distinct()
    of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = materialize(ends.select("a", "b", *[F.coalesce(f"label_{x}", x).alias(f"label_{x}") for x in "ab"]))
    tops = connected_components(ends.select("label_a", "label_b").toDF("a", "b")).toDF("label", "top")
    nodes = labels.select("node", "label").union(ends.select("a", "label_a")).union(ends.select("b", "label_b")).distinct()
    return materialize(nodes.join(tops, "label", "left").select("node", F.coalesce("top", "label").alias("label")))
