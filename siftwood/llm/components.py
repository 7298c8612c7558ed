"""Connected components of a link table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): the least node it can reach.

    Every round takes the least label among a node's neighbours (a partial aggregate, so a
    node of many links costs one row per task) and then the label of that label, which
    halves the way to go.  The labels of hubs, nodes with a thousandth of all links or more,
    are broadcast to their links, and so are those of components as large, so no task gets
    all links of a hub or all nodes of a component.  Labels and links stay
    in tables of the shared folder, those of the round before are deleted; the driver sees
    only whether a label changed.
    """
    both = links.filter("a <> b").select("a", "b").union(links.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = common.materialise(both, "cc-edges")
    ends = edges.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    hubs = common.hot_keys(ends)
    labels = common.materialise(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "cc-labels")
    far_ends = edges.select("a", F.col("b").alias("node"))
    while True:
        near = common.join_unique(far_ends, labels, ["node"], hubs).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        step = common.materialise(step, "cc-step")
        jump = step.select(F.col("node").alias("now"), F.col("now").alias("far"))
        large = common.hot_keys(step.groupBy("now").agg(F.count(F.lit(1)).alias("n")))
        new = common.join_unique(step, jump, ["now"], large).select("node", "was", F.least("now", "far").alias("component"))
        new = common.materialise(new, "cc-labels")
        common.release(labels, step)
        labels = new.select("node", "component")
        labels._scratch = new._scratch
        if not new.filter("component <> was").limit(1).count():
            common.release(edges)
            return labels
