"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each connected component, for every id in ``edges`` (a, b).

    Every round a node takes the smallest label among its neighbours' and its own,
    and then the label of that label; the work of a round is two joins and an
    aggregate over the edges, whose hot nodes are combined before the shuffle.  A
    chain of n nodes takes about log n rounds.
    """
    pairs = keep(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = keep(pairs.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root")))
    while True:
        near = pairs.join(labels.drop("old"), pairs.b == labels.id).groupBy("a").agg(F.min("root").alias("n"))
        low = labels.join(near, labels.id == near.a, "left").select("id", F.col("root").alias("old"), F.least("root", F.coalesce("n", "root")).alias("root"))
        low = keep(low)
        forget(labels)
        up = low.select(F.col("id").alias("_i"), F.col("root").alias("_r"))
        then = keep(low.join(up, low.root == up._i, "left").select("id", "old", F.least("root", F.coalesce("_r", "root")).alias("root")))
        forget(low)
        if then.filter("root <> old").isEmpty():
            forget(pairs)
            return then.select("id", "root")
        labels = then
