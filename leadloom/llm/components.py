"""Connected components of a link table that is too large for one machine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import checkpointed


def local_labels(size: int, left: np.ndarray, right: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """The least member of each of ``size`` nodes' component, by hooking to smaller labels and pointer jumping.

    ``labels`` of an earlier call let links arrive in parts.
    """
    labels = np.arange(size) if labels is None else labels
    while True:
        a, b = labels[left], labels[right]
        apart = a != b
        if not apart.any():
            return labels
        left, right = left[apart], right[apart]
        a, b = a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (jumped := labels[labels]).tobytes() != labels.tobytes():
            labels = jumped


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the least node that can be reached.

    Each round, every node takes the least grandparent among its neighbours, passes it to its parent as well,
    and jumps to its own grandparent, so that long chains need a logarithmic number of rounds. Minima are
    combined before the shuffle; the joins are on checkpointed tables, which adaptive execution can split at a
    frequent parent. Parents only fall, so an unchanged sum means that the round changed nothing.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = checkpointed(both.unionAll(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    parents = checkpointed(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")))
    total = None
    while True:
        now = parents.agg(F.sum(F.col("p").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return parents.select(F.col("u").alias("node"), F.col("p").alias("root"))
        total = now
        above = parents.select(F.col("u").alias("p"), F.col("p").alias("g"))
        known = checkpointed(parents.join(above, "p"))
        least = (
            both.join(known.select(F.col("u").alias("v"), "g"), "v").groupBy("u").agg(F.min("g").alias("n"))
        )
        told = known.join(checkpointed(least), "u")
        pairs = F.array(
            F.struct(F.col("u"), F.least("p", "g", "n").alias("p")),
            F.struct(F.col("p").alias("u"), F.least("p", "n").alias("p")),
        )
        parents = checkpointed(told.select(F.inline(pairs)).groupBy("u").agg(F.min("p").alias("p")))
