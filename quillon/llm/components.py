"""Connected components by smallest label, for links in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.scratch import hot_keys, keep, release, salted_join


def smallest_labels(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (u, v): the smallest node that links lead to.

    Every round each node takes the smallest root among its own and its neighbours' and then that
    root's root, so long chains halve. Labels of a round are a table in the shared folder; only the
    number of changes goes to the driver. Links of a node with very many are dealt to copies of its label,
    and so are the nodes of a root that very many share, as those of a giant component do.
    """
    both = keep(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "links")
    labels = keep(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root")), "labels")
    hot = hot_keys(both, "v", "hot")
    while True:
        near = salted_join(both, labels.withColumnRenamed("node", "v"), "v", "u", hot).groupBy("u").agg(F.min("root").alias("near"))
        lower = keep(labels.join(near, F.col("node") == F.col("u"), "left").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid")), "lower")
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))  # each root is a node, so it has a row
        new = keep(salted_join(lower, jump, "mid", "node", hot_keys(lower, "mid", "hot")).select("node", "old", F.least("mid", "far").alias("root")), "labels")
        changed = new.where("root <> old").count()
        release(labels)
        release(lower)
        labels = new.select("node", "root")
        if not changed:
            release(both)
            return labels
