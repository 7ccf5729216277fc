"""Connected components of an edge table, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Stages


def components(edges: DataFrame, stages: Stages, name: str = "components") -> DataFrame:
    """Smallest node of each component, for every node that has an edge: (node, component).

    ``edges`` has two columns of the same type; direction, repeats and self-edges do
    not matter, edges with a null end are left out. No edges give no rows. Each round
    links every larger neighbour of a node to its smallest neighbour, then does the same
    with the smaller ones, so that components become stars in a logarithmic number of
    rounds. A hub's edges are only aggregated (minimum) or joined, never collected.
    """
    a, b = edges.columns
    now = stages.write(
        edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), f"{name}-0"
    )
    seen, turn = None, 0
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        if state == seen or state[0] == 0:
            break
        seen, turn = state, turn + 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = stages.write(
            both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct(), f"{name}-large-{turn}"
        )
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        after = stages.write(small.unionByName(least.select("u", F.col("low").alias("v"))).distinct(), f"{name}-{turn}")
        stages.drop(f"{name}-{turn - 1}")
        stages.drop(f"{name}-large-{turn}")
        now = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
