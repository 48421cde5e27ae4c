"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import cut, remove

#: Edges up to which one task finds the components; larger tables take distributed rounds.
ONE_TASK = 500_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for all ends of some edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (jump := new[new]).tolist() != new.tolist():
            new = jump
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) of every node that has an edge to another; edges have long columns a and b. Nulls and loops are
    no edges. The table is written first: its size decides between one task and large-star/small-star rounds."""
    spark = edges.sparkSession
    now, path = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    if now.count() <= one_task:

        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = [b for b in batches if len(b)]
            if parts:
                both = pd.concat(parts)
                node, root = roots(both["u"].to_numpy(), both["v"].to_numpy())
                yield pd.DataFrame({"node": node, "root": root})

        return now.coalesce(1).mapInPandas(find, "node long, root long")
    state = None
    while True:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", F.col("e.m").alias("v")).filter("u <> v").distinct()
        after, new_path = cut(small)
        seen = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        remove(spark, path)
        now, path = after, new_path
        if seen == state:
            leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return leaves.union(leaves.select("root", "root").distinct()).toDF("node", "root")
        state = seen
