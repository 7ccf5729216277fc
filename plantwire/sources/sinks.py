"""Exports: CSV and JSON files, bill of materials, STIX objects, session snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as X

_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def _when(name: str) -> Column:
    return F.date_format(name, _TIME)


def _joined(name: str) -> Column:
    return F.array_join(name, "; ")


# --- fixed values: export columns in file order --------------------------------------
def assets_export(assets: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return assets.select(
        F.col("ip_address").alias("IP Address"), text("mac_address").alias("MAC Address"), text("hostname").alias("Hostname"),
        F.col("device_type").alias("Device Type"), text("vendor").alias("Vendor"), text("product_family").alias("Product Family"),
        _joined("protocols").alias("Protocols"), F.col("confidence").alias("Confidence"),
        text("purdue_level").alias("Purdue Level"), text("oui_vendor").alias("OUI Vendor"), text("country").alias("Country"),
        F.col("is_public_ip").alias("Public IP"), _when("first_seen").alias("First Seen"), _when("last_seen").alias("Last Seen"),
        F.col("packet_count").alias("Packet Count"), _joined("tags").alias("Tags"), text("notes").alias("Notes"),
    )


def connections_export(conns: DataFrame) -> DataFrame:
    return conns.select(
        F.col("src_ip").alias("Source IP"), F.col("src_port").alias("Source Port"), F.col("dst_ip").alias("Destination IP"),
        F.col("dst_port").alias("Destination Port"), F.col("protocol").alias("Protocol"), F.col("transport").alias("Transport"),
        F.col("packet_count").alias("Packet Count"), F.col("byte_count").alias("Byte Count"),
        _when("first_seen").alias("First Seen"), _when("last_seen").alias("Last Seen"),
    )


def _csv(df: DataFrame, path: str) -> None:
    # Quotes inside a field are doubled, as spreadsheet tools expect.
    df.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_assets_csv(assets: DataFrame, path: str) -> None:
    _csv(assets_export(assets), path)


def write_connections_csv(conns: DataFrame, path: str) -> None:
    _csv(connections_export(conns), path)


def write_assets_json(assets: DataFrame, path: str) -> None:
    assets.write.json(path)


def topology_json_rows(assets: DataFrame, conns: DataFrame, protocol_stats: DataFrame) -> DataFrame:
    """Export rows (section, body) with one JSON object per line."""
    parts = [("asset", assets), ("connection", conns), ("protocol_stat", protocol_stats)]
    rows = [t.select(F.lit(name).alias("section"), F.to_json(F.struct(*t.columns)).alias("body")) for name, t in parts]
    return rows[0].union(rows[1]).union(rows[2])


def write_topology_json(assets: DataFrame, conns: DataFrame, protocol_stats: DataFrame, path: str) -> None:
    topology_json_rows(assets, conns, protocol_stats).write.partitionBy("section").text(path)


# --- bill of materials ------------------------------------------------------------------


# --- fixed values: names of the Purdue levels
def purdue_zone(level: Column) -> Column:
    return (
        F.when(level == 0, "L0 - Process").when(level == 1, "L1 - Basic Control").when(level == 2, "L2 - Area Supervisory")
        .when(level == 3, "L3 - Site Operations").when(level == 4, "L4 - Enterprise").when(level == 5, "L5 - Enterprise")
        .otherwise("Unassigned")
    )


def sbom(assets: DataFrame) -> DataFrame:
    """Asset rows as bill-of-materials entries; the firmware is unknown to passive capture."""
    text = lambda *c: F.coalesce(*c, F.lit(""))
    return assets.select(
        "ip_address", text("mac_address").alias("mac_address"), text("hostname").alias("hostname"),
        text("vendor", "oui_vendor").alias("vendor"), text("product_family").alias("product"),
        F.lit("").alias("firmware_version"), _joined("protocols").alias("protocols"),
        purdue_zone(F.col("purdue_level")).alias("purdue_zone"), "device_type", "confidence", _when("first_seen").alias("first_seen"),
        _when("last_seen").alias("last_seen"), text("country").alias("country"), _joined("tags").alias("tags"),
    )


# --- STIX -----------------------------------------------------------------------------------


def _key(*parts) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def _stix_id(kind: str, *parts) -> Column:
    return F.concat(F.lit(f"{kind}--"), _key(*parts))


# --- fixed values: infrastructure types of the exchange format
def _infrastructure_type(kind: Column) -> Column:
    return (
        F.when(kind.isin("plc", "rtu"), "control-system").when(kind.isin("hmi", "engineering_workstation"), "workstation")
        .when(kind == "historian", "hosting-target-lists").when(kind == "scada_server", "command-and-control").otherwise("unknown")
    )


def stix_objects(assets: DataFrame, conns: DataFrame, findings: DataFrame, as_of: str) -> DataFrame:
    """STIX 2.1 objects and relationships: type, id, source_ref, target_ref, body.

    Ids depend on the natural keys only. Each input is read once: an asset row explodes
    into its address, MAC, infrastructure and relationship objects.
    """
    none = F.lit(None).cast("string")

    def obj(kind: str, key: Column, body: Column, source: Column = none, target: Column = none) -> Column:
        return F.struct(
            F.lit(kind).alias("type"), key.alias("id"), source.alias("source_ref"), target.alias("target_ref"),
            F.to_json(body).alias("body"),
        )

    def common(kind: str, key: Column) -> list[Column]:
        return [F.lit(kind).alias("type"), F.lit("2.1").alias("spec_version"), key.alias("id")]

    stamps = [F.lit(as_of).alias("created"), F.lit(as_of).alias("modified")]

    def relation(name: str, a: Column, b: Column) -> Column:
        key = F.concat(F.lit("relationship--"), _key(a, F.lit(name), b))
        body = F.struct(
            *common("relationship", key), *stamps, F.lit(name).alias("relationship_type"), a.alias("source_ref"), b.alias("target_ref")
        )
        return obj("relationship", key, body, a, b)

    ip, mac = F.col("ip_address"), F.col("mac_address")
    addr, mac_id, infra = _stix_id("ipv4-addr", ip), _stix_id("mac-addr", mac), _stix_id("infrastructure", ip)
    infra_body = F.struct(
        *common("infrastructure", infra), *stamps, F.coalesce("hostname", ip).alias("name"),
        F.array(_infrastructure_type(F.col("device_type"))).alias("infrastructure_types"), _when("first_seen").alias("first_seen"),
        _when("last_seen").alias("last_seen"), F.col("vendor").alias("x_vendor"), F.col("product_family").alias("x_product"),
        F.col("purdue_level").alias("x_purdue_level"), F.col("protocols").alias("x_protocols"),
    )
    per_asset = F.array_compact(F.array(
        obj("ipv4-addr", addr, F.struct(*common("ipv4-addr", addr), ip.alias("value"), F.col("country").alias("x_country"))),
        F.when(mac.isNotNull(), obj("mac-addr", mac_id, F.struct(*common("mac-addr", mac_id), mac.alias("value")))),
        F.when(mac.isNotNull(), relation("resolves-to", addr, mac_id)),
        obj("infrastructure", infra, infra_body),
        relation("consists-of", infra, addr),
    ))
    traffic = _stix_id("network-traffic", "src_ip", F.col("src_port").cast("string"), "dst_ip", F.col("dst_port").cast("string"), "protocol")
    src, dst = _stix_id("ipv4-addr", "src_ip"), _stix_id("ipv4-addr", "dst_ip")
    traffic_body = F.struct(
        *common("network-traffic", traffic), src.alias("src_ref"), dst.alias("dst_ref"), "src_port", "dst_port",
        F.array("transport", "protocol").alias("protocols"), _when("first_seen").alias("start"), _when("last_seen").alias("end"),
        F.col("packet_count").alias("x_packet_count"), F.col("byte_count").alias("x_byte_count"),
    )
    indicator = F.concat(F.lit("indicator--"), "id")
    indicator_body = F.struct(
        *common("indicator", indicator), *stamps, F.col("title").alias("name"), F.col("evidence").alias("description"),
        F.array(F.lit("anomalous-activity")).alias("indicator_types"),
        F.format_string("[x-finding:severity = '%s']", "severity").alias("pattern"), F.lit("stix").alias("pattern_type"),
        F.lit(as_of).alias("valid_from"), F.col("severity").alias("x_severity"), F.col("affected_assets").alias("x_affected_assets"),
    )
    return (
        assets.select(F.explode(per_asset).alias("o"))
        .union(conns.select(obj("network-traffic", traffic, traffic_body, src, dst).alias("o")))
        .union(findings.select(obj("indicator", indicator, indicator_body).alias("o")))
        .select("o.*").distinct()
    )


# --- sessions ---------------------------------------------------------------------------------


def save_session(assets: DataFrame, conns: DataFrame, session_id: str, path: str) -> None:
    """Write a snapshot; saving the same id again replaces it."""
    for name, table in (("assets", assets), ("connections", conns)):
        table.withColumn("session_id", F.lit(session_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("session_id").parquet(f"{path}/{name}")


def load_session(spark: SparkSession, path: str, session_id: str) -> tuple[DataFrame, DataFrame]:
    read = lambda name: spark.read.parquet(f"{path}/{name}").filter(F.col("session_id") == session_id)
    return read("assets"), read("connections")


def list_sessions(spark: SparkSession, path: str) -> DataFrame:
    count = lambda name: spark.read.parquet(f"{path}/{name}").groupBy("session_id").agg(
        F.count("*").alias(f"{name[:-1]}_count"))
    return count("assets").join(count("connections"), "session_id", "full").na.fill(0, ["asset_count", "connection_count"])


def project_rollup(projects: DataFrame, sessions: DataFrame) -> DataFrame:
    """Projects with their number of sessions, most recently updated first."""
    counts = sessions.groupBy("project_id").agg(F.count("*").alias("session_count"))
    return (
        projects.join(counts, "project_id", "left")
        .withColumn("session_count", F.coalesce("session_count", F.lit(0).cast("bigint")))
        .orderBy(F.desc("updated_at"), "project_id")
    )
