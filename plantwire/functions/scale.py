"""Skew-safe building blocks: bounded top-N, global ranks, sliced gaps, staging.

One key may hold a third of all rows, so nothing here puts a whole key into one
task: top-N prunes inside salted groups first, gaps are taken inside time slices
of a key, and global ranks add counted offsets of many small buckets.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="plantwire-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Bytes of a method above which the JVM only interprets it.
JIT_BYTES = "8000"


@contextlib.contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """Steps that would become one method too long to be compiled run as several short ones meanwhile."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, JIT_BYTES)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and read it back.

    Cuts the lineage, survives executor loss, keeps column pruning and file
    statistics. For tables that many rules or loop steps read.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def top_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, salts: int = 64) -> DataFrame:
    """First ``n`` rows of each key, with their ``rank``.

    The first round ranks inside ``salts`` parts of a key, so that the last round
    sees at most ``n * salts`` rows of a key however many there were.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_r", F.row_number().over(part))
        .filter(F.col("_r") <= n)
        .drop("_salt", "_r")
        .withColumn("rank", F.row_number().over(whole))
        .filter(F.col("rank") <= n)
    )


def global_rank(df: DataFrame, lead: Column, id_col: str, prefix: int = 3) -> DataFrame:
    """Add ``rank`` 1..n ordered by ``lead`` (few values), then by a hex id.

    Buckets are (lead, first hex digits of the id), so each window holds a small
    even share; the offset of a bucket is a running sum over the bucket counts,
    whose number is bounded by the distinct leads times 16**prefix.
    """
    keyed = df.withColumn("_lead", lead).withColumn("_b", F.substring(id_col, 1, prefix))
    running = Window.orderBy("_lead", "_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("_lead", "_b")
        .agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(running), F.lit(0)))
        .select("_lead", "_b", "_offset")
    )
    inside = Window.partitionBy("_lead", "_b").orderBy(id_col)
    return (
        keyed.withColumn("_i", F.row_number().over(inside))
        .join(offsets, ["_lead", "_b"])
        .withColumn("rank", (F.col("_i") + F.col("_offset")).cast("bigint"))
        .drop("_lead", "_b", "_i", "_offset")
    )


#: Widths of slices tried one after the other, as powers of two of microseconds: from 13 days to one.
SLICE_BITS = (40, 32, 24, 16, 8, 0)
#: Rows that one slice of a key may hold.
SLICE_ROWS = 1 << 20


def measured_slices(rows: DataFrame, keys: list[str], time: str, limit: int = SLICE_ROWS) -> DataFrame:
    """Add ``_bits`` and ``_slice``, the time slice of each row, such that no slice of a key holds over ``limit`` rows.

    Rows are counted by key and wide slice first. Only slices that hold too many are counted again
    at the next width, and so on down to single microseconds; rows of one microsecond that are too
    many even so get ``_bits`` -1. The counted tables of full slices hold rows / limit lines at
    most, and a key without a full slice costs one aggregation and no join.
    """
    left, full = rows.select(*keys, time), []
    for bits in SLICE_BITS:
        counted = left.groupBy(*keys, F.shiftright(time, bits).alias("_b")).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)
        counted = stage(counted.drop("_n"), "full-slices")
        if counted.isEmpty():
            break
        full.append((bits, counted.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_b", F.lit(True).alias(f"_full{bits}"))))
        left = left.join(full[-1][1], _in_slice(left, keys, time, bits, full[-1][1]), "left_semi")
    level = F.lit(SLICE_BITS[len(full)] if len(full) < len(SLICE_BITS) else -1)
    for bits, table in full:
        rows = rows.join(table, _in_slice(rows, keys, time, bits, table), "left").drop("_b", *[f"_k{i}" for i in range(len(keys))])
    for bits, _ in reversed(full):
        level = F.when(F.col(f"_full{bits}").isNull(), bits).otherwise(level)
    number = F.lit(None).cast("bigint")
    for bits in (*SLICE_BITS, -1):
        number = F.when(F.col("_bits") == bits, F.shiftright(time, max(bits, 0))).otherwise(number)
    return rows.withColumn("_bits", level).withColumn("_slice", number).drop(*[f"_full{bits}" for bits, _ in full])


def _in_slice(rows: DataFrame, keys: list[str], time: str, bits: int, table: DataFrame) -> Column:
    same = F.shiftright(rows[time], bits) == table["_b"]
    for i, k in enumerate(keys):
        same &= rows[k].eqNullSafe(table[f"_k{i}"])
    return same


def gap_statistics(
    df: DataFrame,
    keys: list[str],
    time_us: Column,
    keep=None,
    extra: dict[str, Column] | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Inter-arrival statistics per key, in microseconds.

    Gaps are computed inside (key, time slice) first and then between neighbouring
    slices of a key. Slices are measured (``measured_slices``), so no task sorts more than
    ``slice_rows`` rows of a key, however they crowd in time. ``keep(gap)`` selects
    the gaps that count (all by default); ``extra`` names columns to sum per key.
    Returns keys, n, first_us, last_us, gap_n, gap_sum, gap_min, gap_max, gap_m2
    (squared deviations from the mean) and the extra sums.
    """
    keep = keep or (lambda gap: F.lit(True))
    extra = extra or {}
    rows = df.select(*keys, time_us.alias("_t"), *[c.alias(n) for n, c in extra.items()])
    rows = measured_slices(rows, keys, "_t", slice_rows)
    inside = Window.partitionBy(*keys, "_bits", "_slice").orderBy("_t")
    gap = F.col("_t") - F.lag("_t").over(inside)
    spread_out = rows.filter("_bits >= 0").withColumn("_gap", gap)
    kept = F.when(F.col("_gap").isNotNull() & keep(F.col("_gap")), F.col("_gap"))
    slices = spread_out.groupBy(*keys, "_bits", "_slice").agg(
        F.count("*").alias("_n"),
        F.min("_t").alias("_first"),
        F.max("_t").alias("_last"),
        F.count(kept).alias("_gn"),
        F.sum(kept).alias("_gs"),
        F.min(kept).alias("_gmin"),
        F.max(kept).alias("_gmax"),
        F.var_pop(kept).alias("_gv"),
        *[F.sum(n).alias(n) for n in extra],
    )
    # rows of one microsecond have gaps of zero, which need no order
    nought = F.when(keep(F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))
    at_once = rows.filter("_bits < 0").groupBy(*keys, "_bits", "_slice").agg(
        F.count("*").alias("_n"), F.min("_t").alias("_first"), F.max("_t").alias("_last"),
        F.when(keep(F.lit(0).cast("bigint")), F.count("*") - 1).otherwise(F.lit(0)).cast("bigint").alias("_gn"),
        nought.alias("_gs"), nought.alias("_gmin"), nought.alias("_gmax"), nought.cast("double").alias("_gv"),
        *[F.sum(n).alias(n) for n in extra],
    )
    slices = slices.unionByName(at_once)
    across = Window.partitionBy(*keys).orderBy("_first")
    whole = Window.partitionBy(*keys)
    edge = F.col("_first") - F.lag("_last").over(across)
    slices = slices.withColumn("_edge", edge).withColumn(
        "_edge", F.when(F.col("_edge").isNotNull() & keep(F.col("_edge")), F.col("_edge"))
    )
    zero = F.lit(0).cast("bigint")
    kept_n = F.col("_gn") + F.when(F.col("_edge").isNotNull(), 1).otherwise(0)
    kept_sum = F.coalesce("_gs", zero) + F.coalesce("_edge", zero)
    slices = slices.withColumn("_mean", F.sum(kept_sum).over(whole) / F.nullif(F.sum(kept_n).over(whole), F.lit(0)))
    spread = (
        F.coalesce(F.col("_gn") * F.col("_gv"), F.lit(0.0))
        + F.coalesce(F.col("_gn") * F.pow(F.col("_gs") / F.nullif(F.col("_gn"), F.lit(0)) - F.col("_mean"), 2), F.lit(0.0))
        + F.coalesce(F.pow(F.col("_edge") - F.col("_mean"), 2), F.lit(0.0))
    )
    return slices.groupBy(*keys).agg(
        F.sum("_n").alias("n"),
        F.min("_first").alias("first_us"),
        F.max("_last").alias("last_us"),
        F.sum(kept_n).alias("gap_n"),
        F.sum(kept_sum).alias("gap_sum"),
        F.min(F.least("_gmin", "_edge")).alias("gap_min"),
        F.max(F.greatest("_gmax", "_edge")).alias("gap_max"),
        F.sum(spread).alias("gap_m2"),
        *[F.sum(n).alias(n) for n in extra],
    )


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node id of each undirected component: (id, component).

    ``nodes``: id; ``edges``: src, dst. Each round takes the smallest label among
    the neighbours and then jumps to the label of that label, so long chains
    close in a logarithmic number of rounds. Every round is staged.
    """
    both = stage(
        edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        .filter("src <> dst").distinct(),
        "edges",
    )
    labels = stage(nodes.select("id").distinct().withColumn("component", F.col("id")), "labels")
    while True:
        near = (
            both.join(labels, both.dst == labels.id)
            .groupBy("src")
            .agg(F.min("component").alias("near"))
        )
        hop = labels.join(near, labels.id == near.src, "left").select(
            "id", F.col("component").alias("old"), F.least("component", "near").alias("component")
        )
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("root"))
        new = stage(
            hop.join(jump, "component", "left").select(
                "id", "old", F.least("component", "root").alias("component")
            ),
            "labels",
        )
        labels = new.select("id", "component")
        if new.filter(F.col("old") != F.col("component")).limit(1).count() == 0:
            return labels
