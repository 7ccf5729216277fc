"""Readers for sensor logs: Zeek, Suricata EVE, Wazuh, and packet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import columns as X

# --- fixed values: Zeek log kinds that carry no counters ---------------------------
_MESSAGE_LOGS = ("modbus", "dnp3", "s7comm")

# --- fixed values: application protocol names of Suricata ----------------------------
_APP_PROTOCOLS = {"enip": "ethernet_ip", "cip": "ethernet_ip", "tls": "https", "ssl": "https"}


def _port(column: Column) -> Column:
    number = column.try_cast("int")
    return F.when(number.between(0, 65535), number)


def _time(column: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(column), F.try_to_timestamp(column, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSZ")))


def _by_port(port: Column) -> Column:
    return X.identify(F.lit(0), port)


_ZEEK_COLUMNS = (
    "ts", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "service", "orig_pkts", "resp_pkts", "orig_bytes", "resp_bytes",
)


def _zeek_headers(lines: DataFrame) -> DataFrame:
    """One row per file: its kind and the place of each needed column, 0 for a column it lacks."""
    fields, kind = F.lit("#fields\t"), F.lit("#path\t")
    names = F.split(F.substring("fields", 9, 1 << 30), "\t")
    places = [F.array_position(names, name).cast("int").alias(name.replace(".", "_")) for name in _ZEEK_COLUMNS]
    return lines.filter(F.startswith("value", fields) | F.startswith("value", kind)).groupBy("file").agg(
        F.min(F.when(F.startswith("value", fields), F.col("value"))).alias("fields"),
        F.min(F.when(F.startswith("value", kind), F.trim(F.substring("value", 7, 1 << 30)))).alias("kind"),
    ).filter("fields IS NOT NULL").select("file", F.coalesce("kind", F.lit("conn")).alias("kind"), F.struct(*places).alias("place"))


def read_zeek(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Zeek TSV logs of any kinds as connections.

    Every file under ``path``, subfolders included, has its own kind (``#path``, else conn) and
    columns (``#fields``); ``kind`` overrides the former. Files without ``#fields`` and rows without
    both addresses and ports are dropped. Kinds without counters of their own are read like conn.
    Headers are gathered in a first pass over the lines, one row per file, and joined to them.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    headers = _zeek_headers(lines)
    rows = lines.filter(~F.startswith("value", F.lit("#"))).join(headers, "file")
    rows = rows.select(F.lit(kind).alias("kind") if kind else F.col("kind"), "place", F.split("value", "\t").alias("fields"))

    def col(name: str) -> Column:
        value = F.get("fields", F.col(f"place.{name.replace('.', '_')}") - 1)
        return F.when(~value.isin("-", "(empty)", ""), value)

    def number(name: str, default: int) -> Column:
        return F.coalesce(col(name).try_cast("bigint"), F.lit(default))

    message = F.col("kind").isin(*_MESSAGE_LOGS)
    ts = F.timestamp_micros(F.round(col("ts").try_cast("double") * 1e6).cast("bigint"))
    dst_port = _port(col("id.resp_p"))
    return rows.select(
        col("id.orig_h").alias("src_ip"), _port(col("id.orig_p")).alias("src_port"), col("id.resp_h").alias("dst_ip"),
        dst_port.alias("dst_port"),
        F.when(message, F.col("kind")).otherwise(F.coalesce(col("service"), _by_port(dst_port))).alias("protocol"),
        F.when(message, "tcp").otherwise(F.coalesce(col("proto"), F.lit("tcp"))).alias("transport"),
        F.when(message, F.lit(1)).otherwise(number("orig_pkts", 1) + number("resp_pkts", 0)).cast("bigint").alias("packet_count"),
        F.when(message, F.lit(0)).otherwise(number("orig_bytes", 0) + number("resp_bytes", 0)).cast("bigint").alias("byte_count"),
        ts.alias("first_seen"), ts.alias("last_seen"), F.lit("Zeek").alias("source"),
    ).na.drop(subset=["src_ip", "src_port", "dst_ip", "dst_port"])


def assets_of(connections: DataFrame) -> DataFrame:
    """Addresses of imported connections as imported assets, one row per address."""
    ends = connections.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip_address"), "protocol", "source")
    return ends.groupBy("ip_address").agg(
        F.array_sort(F.collect_set("protocol")).alias("protocols"), F.min("source").alias("source")
    ).select(
        "ip_address", *[F.lit(None).cast("string").alias(c) for c in ("mac_address", "hostname", "device_type", "vendor")],
        "protocols", F.array().cast(T.ArrayType(schemas.PORT_SERVICE)).alias("open_ports"),
        F.lit(None).cast("string").alias("os_info"), "source", F.lit(False).alias("is_active"),
    )


_EVE = (
    "timestamp string, event_type string, src_ip string, src_port int, dest_ip string, dest_port int, proto string, "
    "app_proto string, flow struct<pkts_toserver: bigint, pkts_toclient: bigint, bytes_toserver: bigint, "
    "bytes_toclient: bigint, start: string, end: string>, "
    "alert struct<signature_id: bigint, signature: string, category: string, severity: int>"
)


def read_suricata_eve(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """EVE JSON lines as (connections, alerts); other event types are skipped.

    A missing time stays null.
    """
    raw = spark.read.schema(_EVE).json(path).filter(F.col("src_ip").isNotNull() & F.col("dest_ip").isNotNull())
    ts, zero = _time(F.col("timestamp")), F.lit(0).cast("bigint")
    app = F.lower("app_proto")
    name = app
    for alias, protocol in _APP_PROTOCOLS.items():
        name = F.when(app == alias, protocol).otherwise(name)
    sport, dport = F.coalesce("src_port", F.lit(0)), F.coalesce("dest_port", F.lit(0))

    def total(kind: str) -> Column:
        return F.coalesce(f"flow.{kind}_toserver", zero) + F.coalesce(f"flow.{kind}_toclient", zero)

    flows = raw.filter("event_type = 'flow' AND flow IS NOT NULL").select(
        "src_ip", sport.alias("src_port"), F.col("dest_ip").alias("dst_ip"), dport.alias("dst_port"),
        F.coalesce(name, _by_port(dport)).alias("protocol"), F.lower(F.coalesce("proto", F.lit("tcp"))).alias("transport"),
        total("pkts").alias("packet_count"), total("bytes").alias("byte_count"),
        F.coalesce(_time(F.col("flow.start")), ts).alias("first_seen"), F.coalesce(_time(F.col("flow.end")), ts).alias("last_seen"),
        F.lit("Suricata").alias("source"),
    )
    alerts = raw.filter("event_type = 'alert' AND alert IS NOT NULL").select(
        ts.alias("timestamp"), "src_ip", sport.alias("src_port"), F.col("dest_ip").alias("dst_ip"), dport.alias("dst_port"),
        F.coalesce("alert.signature_id", zero).alias("signature_id"), F.coalesce("alert.signature", F.lit("")).alias("signature"),
        F.coalesce("alert.category", F.lit("")).alias("category"), F.coalesce("alert.severity", F.lit(3)).alias("severity"),
        F.lit("Suricata").alias("source"),
    )
    return flows, alerts


_WAZUH = (
    "timestamp string, rule struct<level: int, description: string, id: string, groups: array<string>>, "
    "agent struct<id: string, name: string, ip: string>, "
    "data struct<srcip: string, src_ip: string, dstip: string, dst_ip: string, srcport: string, src_port: string, "
    "dstport: string, dst_port: string>"
)


def read_wazuh(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Wazuh alerts from JSON lines, or from JSON arrays with ``multiline``."""
    raw = spark.read.schema(_WAZUH).option("multiLine", multiline).json(path).filter("rule IS NOT NULL")

    def first(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])

    def port(*names: str) -> Column:
        return F.coalesce(*[F.nullif(_port(F.col(n)), F.lit(0)) for n in names], F.lit(0))

    level = F.coalesce("rule.level", F.lit(0))
    return raw.select(
        _time(F.col("timestamp")).alias("timestamp"), first("data.srcip", "data.src_ip", "agent.ip").alias("src_ip"),
        port("data.srcport", "data.src_port").alias("src_port"),
        F.coalesce(first("data.dstip", "data.dst_ip"), F.lit("")).alias("dst_ip"),
        port("data.dstport", "data.dst_port").alias("dst_port"),
        F.coalesce(F.col("rule.id").try_cast("bigint"), F.lit(0).cast("bigint")).alias("signature_id"),
        F.coalesce("rule.description", F.lit("Unknown Rule")).alias("signature"),
        F.coalesce(F.get("rule.groups", F.lit(0)), F.lit("wazuh")).alias("category"),
        F.when(level >= 12, 1).when(level >= 7, 2).otherwise(3).alias("severity"), F.lit("Wazuh").alias("source"),
    ).filter("src_ip IS NOT NULL")


def packet_source(spark: SparkSession, path: str, streaming: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """Packet tables from Parquet files, tagged with the file they came from."""
    reader = spark.readStream if streaming else spark.read
    packets = reader.schema(schema or schemas.PACKETS).parquet(path)
    return packets.withColumn("origin_file", F.col("_metadata.file_name"))
