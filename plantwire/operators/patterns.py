"""Communication patterns: inter-arrival statistics, anomalies, seen ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import columns as X
from ..functions.scale import SLICE_ROWS, gap_statistics
from .packets import _ensure_protocol

STATS_KEY = ["src_ip", "dst_ip", "port", "protocol"]


def connection_stats(packets: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Packets, bytes and gap statistics per (src, dst, destination port, protocol)."""
    rows = _ensure_protocol(packets).withColumn("port", F.col("dst_port"))
    g = gap_statistics(
        rows, STATS_KEY, X.micros(F.col("ts")), extra={"byte_count": F.col("length")}, slice_rows=slice_rows
    )
    zero = F.lit(0.0)
    some = F.col("gap_n") > 0
    average = F.when(some, F.col("gap_sum") / F.col("gap_n") / 1000.0).otherwise(zero)
    deviation = F.when(F.col("gap_n") > 1, F.sqrt(F.col("gap_m2") / F.col("gap_n")) / 1000.0).otherwise(zero)
    duration = (F.col("last_us") - F.col("first_us")) / 1e6
    return (
        g.select(
            *STATS_KEY, F.col("n").alias("packet_count"), "byte_count",
            F.timestamp_micros("first_us").alias("first_seen"), F.timestamp_micros("last_us").alias("last_seen"),
            duration.alias("duration_secs"), average.alias("avg_interval_ms"), deviation.alias("std_interval_ms"),
            F.when(some, F.col("gap_min") / 1000.0).otherwise(zero).alias("min_interval_ms"),
            F.when(some, F.col("gap_max") / 1000.0).otherwise(zero).alias("max_interval_ms"),
            "gap_n",
        )
        .withColumn(
            "is_periodic",
            (F.col("gap_n") >= 5) & (F.col("avg_interval_ms") > 0)
            & (F.col("std_interval_ms") < 0.3 * F.col("avg_interval_ms")),
        )
        .withColumn(
            "packets_per_sec",
            F.when(F.col("duration_secs") > 0, F.col("packet_count") / F.col("duration_secs")).otherwise(zero),
        )
        .drop("gap_n")
    )


def pattern_anomalies(stats: DataFrame) -> DataFrame:
    """One row per rule that a statistics row breaks."""
    ot = F.col("protocol").isin(*C.ICS_PROTOCOLS)
    single = F.col("packet_count") == 1
    enough = (F.col("packet_count") >= 10) & (F.col("avg_interval_ms") > 0)

    def row(kind: str, severity: str, text):
        return F.struct(
            F.lit(kind).alias("anomaly_type"), F.lit(severity).alias("severity"), text.alias("description")
        )

    place = [F.col("src_ip"), F.col("dst_ip"), F.col("port"), F.col("protocol")]
    rules = F.array(
        F.when(single, row("one_off", "low", F.format_string("single packet %s to %s:%d (%s)", *place))),
        F.when(
            ~single & ot & (F.col("packets_per_sec") > 100),
            row("high_frequency", "high",
                F.format_string("%s to %s:%d (%s) at %.1f packets/s", *place, F.col("packets_per_sec"))),
        ),
        F.when(
            ~single & ot & enough & (F.col("std_interval_ms") > F.col("avg_interval_ms")),
            row("irregular_polling", "medium",
                F.format_string("%s to %s:%d (%s) gaps avg %.1f ms, std %.1f ms", *place,
                                F.col("avg_interval_ms"), F.col("std_interval_ms"))),
        ),
        F.when(
            ~single & enough & (F.col("max_interval_ms") > 10 * F.col("avg_interval_ms")),
            row("burst", "medium",
                F.format_string("%s to %s:%d (%s) longest gap %.1f ms, avg %.1f ms", *place,
                                F.col("max_interval_ms"), F.col("avg_interval_ms"))),
        ),
    )
    return stats.select(*STATS_KEY, F.explode(F.array_compact(rules)).alias("a")).select(*STATS_KEY, "a.*")


def pattern_rows(
    stats: DataFrame, anomalies: DataFrame, protocol: str | None = None, anomalies_only: bool = False,
    sort: str = "packet_count", descending: bool = True, page: int = 0, page_size: int | None = None,
) -> DataFrame:
    """Statistics with their anomaly count, filtered, sorted and paged."""
    counts = anomalies.groupBy(*STATS_KEY).agg(F.count("*").alias("anomaly_count"))
    if protocol:
        stats = stats.filter(F.col("protocol") == protocol)
    rows = stats.join(counts, STATS_KEY, "inner" if anomalies_only else "left").withColumn(
        "anomaly_count", F.coalesce("anomaly_count", F.lit(0).cast("bigint"))
    )
    first = F.desc(sort) if descending else F.asc(sort)
    rows = rows.orderBy(first, *STATS_KEY)
    return rows if page_size is None else rows.offset(page * page_size).limit(page_size)


def device_first_last_seen(stats: DataFrame) -> DataFrame:
    return (
        stats.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip_address"), "first_seen", "last_seen")
        .groupBy("ip_address")
        .agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    )


def capture_window(stats: DataFrame) -> DataFrame:
    return stats.agg(F.min("first_seen").alias("capture_start"), F.max("last_seen").alias("capture_end"))
