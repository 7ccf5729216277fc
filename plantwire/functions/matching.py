"""Text containment as equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def containment_pairs(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Distinct (o, i) with ``o`` containing ``i``; inputs have one text column each.

    Every slice of ``o`` whose length occurs among the inner texts becomes a join key,
    so the comparison is a hash join and never a product of both sides. Empty texts
    match nothing. Meant for names and models, whose length is small.
    """
    o = outer.toDF("o").filter("o <> ''").distinct()
    i = inner.toDF("i").filter("i <> ''").distinct()
    sizes = i.agg(F.collect_set(F.length("i"))).scalar()
    slices = (
        o.select("o", F.explode(sizes).alias("_n"))
        .filter(F.col("_n") <= F.length("o"))
        .select("o", "_n", F.explode(F.sequence(F.lit(1), F.length("o") - F.col("_n") + 1)).alias("_p"))
        .select("o", F.substring("o", F.col("_p"), F.col("_n")).alias("i"))
        .distinct()
    )
    return slices.join(i, "i").select("o", "i")


def either_contains(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct (l, r) where one text contains the other."""
    forward = containment_pairs(left, right).toDF("l", "r")
    backward = containment_pairs(right, left).select("i", "o").toDF("l", "r")
    return forward.union(backward).distinct()
