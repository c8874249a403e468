"""Connected components of a link table, as rounds of joins.

Each round every node takes its smallest neighbour (or itself) as parent, parents are followed one
step further, and links are carried over to the parents; links inside a parent vanish. A star is
done in one round, a chain shrinks by a factor each round. Links, parents and labels are written
tables; nothing is collected but the number of links left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnsight.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a long, b long); root is one of the component's
    nodes, the same for all of them. Repeated links, loops and an empty table are allowed."""
    labels, links = None, staged(_distinct(links), "links")
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "parents")
        up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        parent = staged(parent.join(up, "p").select(F.col("a").alias("node"), F.col("pp").alias("root")), "parents")
        if labels is None:
            labels = parent
        else:
            over = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = staged(labels.join(over, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
        left = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = links.join(left, "a").join(right, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        links = staged(_distinct(moved), "links")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _distinct(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def forest(n: int, first, second, labels=None):
    """Labels of ``n`` local nodes after linking ``first[k]`` to ``second[k]``: the smallest index
    reachable. ``labels`` holds earlier links and is updated."""
    import numpy as np

    labels = np.arange(n) if labels is None else labels
    while True:
        a, b = labels[first], labels[second]
        apart = a != b
        if not apart.any():
            return labels
        a, b = a[apart], b[apart]
        first, second = first[apart], second[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up
