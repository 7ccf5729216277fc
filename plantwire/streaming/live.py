"""Structured Streaming jobs over a packet stream.

State expires by event time: connections per one-hour window, counters per tumbling interval.
Alerts keep none: the table they are written to says which connections were alerted before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .. import constants as C
from ..functions.scale import shared_dir
from ..operators.packets import CONNECTION_KEY, _ensure_protocol


def live_connections(stream: DataFrame, window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Running totals per connection and window (update mode)."""
    return (
        _ensure_protocol(stream).withWatermark("ts", watermark)
        .groupBy(F.window("ts", window).alias("w"), *CONNECTION_KEY)
        .agg(
            F.count("*").alias("packet_count"), F.sum("length").alias("byte_count"), F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
        )
        .select(F.col("w.start").alias("window_start"), *CONNECTION_KEY, "packet_count", "byte_count", "first_seen", "last_seen")
    )


def connection_totals(updates: DataFrame) -> DataFrame:
    """Totals over all windows from the written updates; the last update of a window
    has its highest count."""
    key = ["window_start", *CONNECTION_KEY]
    latest = updates.groupBy(*key).agg(
        F.max("packet_count").alias("packet_count"), F.max("byte_count").alias("byte_count"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )
    return latest.groupBy(*CONNECTION_KEY).agg(
        F.sum("packet_count").alias("packet_count"), F.sum("byte_count").alias("byte_count"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )


def _alert(port: Column) -> Column:
    out = None
    for ports, technique, title, severity in C.LIVE_ALERT_PORTS:
        row = F.struct(F.lit(technique).alias("technique_id"), F.lit(title).alias("title"), F.lit(severity).alias("severity"))
        out = (F if out is None else out).when(port.isin(*ports), row)
    return out


def alert_candidates(stream: DataFrame, ot_assets: DataFrame) -> DataFrame:
    """Packets of connections that touch an OT device on a watched port, with the alert they give.

    ``ot_assets``: ip_address of OT devices, a static table. The port is the one on the
    OT device's side; the destination counts first.
    """
    watched = [p for ports, *_ in C.LIVE_ALERT_PORTS for p in ports]
    near = _ensure_protocol(stream).filter(F.col("src_port").isin(*watched) | F.col("dst_port").isin(*watched))
    a = ot_assets.select(F.col("ip_address").alias("src_ip"), F.lit(True).alias("_src_ot"))
    b = ot_assets.select(F.col("ip_address").alias("dst_ip"), F.lit(True).alias("_dst_ot"))
    joined = near.join(a, "src_ip", "left").join(b, "dst_ip", "left")
    to_dst = F.coalesce("_dst_ot", F.lit(False))
    rows = joined.filter(to_dst | F.coalesce("_src_ot", F.lit(False))).select(
        "ts", *CONNECTION_KEY, F.when(to_dst, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("ot_ip"),
        _alert(F.when(to_dst, F.col("dst_port")).otherwise(F.col("src_port"))).alias("a"),
    )
    return rows.filter("a IS NOT NULL").select("ts", *CONNECTION_KEY, "ot_ip", "a.*")


def new_alerts(batch: DataFrame, seen: DataFrame) -> DataFrame:
    """First packet of each connection of a batch, for connections that ``seen`` has no alert of."""
    rest = [c for c in batch.columns if c not in (*CONNECTION_KEY, "ts")]
    first = batch.groupBy(*CONNECTION_KEY).agg(F.min(F.struct("ts", *rest)).alias("_f"))
    return first.join(seen.select(*CONNECTION_KEY), CONNECTION_KEY, "left_anti").select("_f.ts", *CONNECTION_KEY, *[f"_f.{c}" for c in rest])


def live_alerts(stream: DataFrame, ot_assets: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """One alert per connection, at its first sight; processes what has arrived and returns all alerts so far.

    A connection alerts once however long it lasts or pauses. Every micro-batch writes its own
    folder under ``path``, which replaces what a failed run of the same batch left, and leaves out
    connections that folders of earlier batches hold. So a restart neither loses nor repeats an
    alert. ``path`` must be given, with ``checkpoint``, to go on from an earlier run.
    """
    candidates = alert_candidates(stream, ot_assets)

    def alerted(batch: DataFrame, seen: DataFrame) -> DataFrame:
        return new_alerts(batch, seen)

    return run_available(candidates, "append", path, checkpoint, alerted)


def live_stats(stream: DataFrame, every: str = "1 second", watermark: str = "10 minutes") -> DataFrame:
    """Packets, bytes, rate, connections and assets per interval, all exact (append mode).

    Two aggregations in a row: the first sees each connection and each address once per interval
    and keeps only its counters, the second counts them. An interval is put out once the
    watermark has passed its end.
    """
    none = F.lit(None).cast("string")
    connection = F.struct(*[F.col(c).cast("string").alias(c) for c in CONNECTION_KEY], none.alias("ip"), F.col("length").alias("length"))

    def address(ip: str) -> Column:
        return F.struct(*[none.alias(c) for c in CONNECTION_KEY], F.col(ip).alias("ip"), F.lit(0).cast("bigint").alias("length"))

    sights = _ensure_protocol(stream).withWatermark("ts", watermark).select(
        "ts", F.explode(F.array(connection, address("src_ip"), address("dst_ip"))).alias("s")
    ).select("ts", "s.*")
    once = sights.groupBy(F.window("ts", every).alias("w"), *CONNECTION_KEY, "ip").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
    seconds = F.unix_micros("w.end") / 1e6 - F.unix_micros("w.start") / 1e6
    of_connection = F.col("ip").isNull()
    return (
        once.groupBy("w").agg(
            F.sum(F.when(of_connection, F.col("n")).otherwise(0)).alias("packets"), F.sum("bytes").alias("bytes"),
            F.count_if(of_connection).alias("active_connections"), F.count_if(~of_connection).alias("assets"),
        )
        .select(F.col("w.start").alias("interval_start"), "packets", "bytes", (F.col("packets") / seconds).alias("packets_per_sec"),
                "active_connections", "assets")
    )


def run_available(stream: DataFrame, mode: str, path: str | None = None, checkpoint: str | None = None, change=None) -> DataFrame:
    """Process what has arrived and return the written table.

    Each micro-batch writes its own folder, replaced if the batch runs again after a
    failure, so a restart neither loses nor repeats rows. ``change`` turns a batch and the
    table written by earlier batches into the rows to write.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    path, checkpoint = path or f"{base}/rows", checkpoint or f"{base}/checkpoint"

    def write(batch: DataFrame, batch_id: int) -> None:
        if change is not None:
            own, shape = batch.sparkSession, StructType([*stream.schema.fields, StructField("batch", LongType())])
            folder = own._jvm.org.apache.hadoop.fs.Path(path)
            written = folder.getFileSystem(own._jsc.hadoopConfiguration()).exists(folder)
            seen = own.read.schema(shape).parquet(path).filter(F.col("batch") < batch_id) if written else own.createDataFrame([], shape)
            batch = change(batch, seen.drop("batch"))
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
