"""Inventory and traffic aggregations: connections, assets, listings, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import columns as X
from .packets import CONNECTION_KEY, _ensure_protocol


def _order() -> Column:
    return F.struct("ts", "seq")


def connections(packets: DataFrame, files: bool = False) -> DataFrame:
    """One row per (source, destination, ports, protocol) with totals and first MACs.

    ``files`` adds the names of the captures a connection was seen in as an array, which grows with
    the number of captures; ``connection_files`` has them as rows.
    """

    def first_of(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), _order())).alias(name)

    return (
        _ensure_protocol(packets)
        .groupBy(*CONNECTION_KEY)
        .agg(
            F.count("*").alias("packet_count"),
            F.sum("length").alias("byte_count"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
            first_of("src_mac"),
            first_of("dst_mac"),
            first_of("transport"),
            *([F.array_sort(F.collect_set("origin_file")).alias("origin_files")] if files else []),
        )
        .withColumn("connection_id", X.natural_id(*[F.col(c) for c in CONNECTION_KEY]))
    )


def connection_files(packets: DataFrame) -> DataFrame:
    """Captures of each connection: its key, connection_id, origin_file and the packets in that file."""
    counted = _ensure_protocol(packets).filter("origin_file IS NOT NULL").groupBy(*CONNECTION_KEY, "origin_file").agg(F.count("*").alias("packet_count"))
    return counted.withColumn("connection_id", X.natural_id(*[F.col(c) for c in CONNECTION_KEY]))


def asset_base(packets: DataFrame) -> DataFrame:
    """Every address seen at either end, from one pass over the packets."""
    ends = F.explode(
        F.array(
            F.struct(
                F.col("src_ip").alias("ip"), F.col("src_mac").alias("mac"),
                F.col("src_port").isin(*C.SERVER_PORTS).alias("serves"),
            ),
            F.struct(
                F.col("dst_ip").alias("ip"), F.col("dst_mac").alias("mac"),
                F.col("dst_port").isin(*C.SERVER_PORTS).alias("serves"),
            ),
        )
    )
    return (
        _ensure_protocol(packets)
        .select("ts", "seq", "protocol", ends.alias("end"))
        .groupBy(F.col("end.ip").alias("ip_address"))
        .agg(
            F.array_sort(F.collect_set("protocol")).alias("protocols"),
            F.count("*").alias("packet_count"),
            F.min_by("end.mac", F.when(F.col("end.mac").isNotNull(), _order())).alias("mac_address"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
            F.bool_or("end.serves").alias("is_server"),
        )
    )


def server_ips(table: DataFrame) -> DataFrame:
    """Addresses that own an OT server port; ``table`` holds packets or connections."""
    owners = F.array_compact(
        F.array(
            F.when(F.col("src_port").isin(*C.SERVER_PORTS), F.col("src_ip")),
            F.when(F.col("dst_port").isin(*C.SERVER_PORTS), F.col("dst_ip")),
        )
    )
    return table.select(F.explode(owners).alias("ip_address")).distinct()


def device_type(protocols: Column, is_server: Column) -> Column:
    ot = X.count_of(protocols, C.OT_PROTOCOLS)
    return (
        F.when(
            is_server & (ot >= 1),
            F.when(X.has_any(protocols, ("ethernet_ip", "s7comm", "ge_srtp", "bacnet")), "plc")
            .when(X.has_any(protocols, ("modbus", "dnp3")), "rtu")
            .otherwise("unknown"),
        )
        .when(is_server & F.array_contains(protocols, "wonderware_suitelink"), "scada_server")
        .when(ot >= 2, "hmi")
        .when((ot == 1) & F.array_contains(protocols, "opc_ua"), "historian")
        .when(ot == 0, "it_device")
        .otherwise("unknown")
    )


def infer_device_type(base: DataFrame, servers: DataFrame | None = None) -> DataFrame:
    """Add ``device_type``; server roles come from ``servers`` or the base itself."""
    if servers is not None:
        flag = servers.select("ip_address", F.lit(True).alias("_server"))
        base = base.drop("is_server").join(flag, "ip_address", "left")
        base = base.withColumn("is_server", F.coalesce("_server", F.lit(False))).drop("_server")
    return base.withColumn("device_type", device_type(F.col("protocols"), F.col("is_server")))


def enrich_oui(table: DataFrame, oui: DataFrame, mac: str = "mac_address") -> DataFrame:
    """Vendor by MAC prefix; how the registry is joined is left to Spark, which knows its size."""
    key = oui.select(F.col("prefix").alias("_prefix"), F.col("vendor").alias("oui_vendor"))
    return table.join(key, F.lower(F.substring(mac, 1, 8)) == F.col("_prefix"), "left").drop("_prefix")


is_public_ip = X.is_public_ip


def enrich_country(table: DataFrame, blocks: DataFrame, ip: str = "ip_address") -> DataFrame:
    """Country of public addresses by block (start_ip, end_ip as BIGINT, country).

    Blocks are cut into /16 buckets, which turns the range condition into an equi
    join with a residual; the narrowest block wins.
    """
    lookup = table.select(ip).distinct().filter(X.is_public_ip(F.col(ip))).withColumn("_n", X.ip_number(F.col(ip)))
    buckets = blocks.withColumn(
        "_bucket", F.explode(F.sequence(F.shiftright("start_ip", 16), F.shiftright("end_ip", 16)))
    )
    found = (
        lookup.withColumn("_bucket", F.shiftright("_n", 16))
        .join(buckets, "_bucket")
        .filter(F.col("_n").between(F.col("start_ip"), F.col("end_ip")))
        .groupBy(ip)
        .agg(F.min_by("country", F.struct(F.col("end_ip") - F.col("start_ip"), "country")).alias("country"))
    )
    return table.join(found, ip, "left")


def build_assets(
    base: DataFrame,
    servers: DataFrame | None = None,
    signatures: DataFrame | None = None,
    identities: DataFrame | None = None,
    lldp: DataFrame | None = None,
    oui: DataFrame | None = None,
    country_blocks: DataFrame | None = None,
) -> DataFrame:
    """Asset rows by precedence: signature, MAC vendor, Modbus identity, LLDP.

    Optional inputs: best signature matches (ip, match_rank, ...), Modbus identities
    (ip, vendor_name, product_code, product_name, model_name), LLDP rows per MAC
    (mac, system_name, vendor, model, capabilities, enabled_capabilities).
    """
    spark = base.sparkSession
    a = infer_device_type(base, servers)
    if signatures is not None:
        best = signatures.filter("match_rank = 1").select(
            F.col("ip").alias("ip_address"), F.col("confidence").alias("_sc"), F.col("vendor").alias("_sv"),
            F.col("product_family").alias("_sp"), F.col("device_type").alias("_sd"),
        )
        a = a.join(best, "ip_address", "left")
    else:
        a = a.selectExpr("*", "CAST(NULL AS INT) _sc", "CAST(NULL AS STRING) _sv", "CAST(NULL AS STRING) _sp",
                         "CAST(NULL AS STRING) _sd")
    if oui is not None:
        a = enrich_oui(a, oui)
    else:
        a = a.withColumn("oui_vendor", F.lit(None).cast("string"))
    if identities is not None:
        name = F.concat_ws(" ", "product_code", "product_name", "model_name")
        ident = identities.select(
            F.col("ip").alias("ip_address"), F.lit(True).alias("_id"), F.col("vendor_name").alias("_iv"),
            F.when(name != "", name).alias("_ip"),
        )
        a = a.join(ident, "ip_address", "left")
    else:
        a = a.selectExpr("*", "CAST(NULL AS BOOLEAN) _id", "CAST(NULL AS STRING) _iv", "CAST(NULL AS STRING) _ip")
    if lldp is not None:
        rows = lldp.select(
            F.col("mac").alias("mac_address"), F.col("system_name").alias("_ln"), F.col("vendor").alias("_lv"),
            F.col("model").alias("_lm"),
            F.when(F.col("enabled_capabilities") != 0, F.col("enabled_capabilities"))
            .otherwise(F.col("capabilities")).alias("_caps"),
        )
        a = a.join(rows, "mac_address", "left")
    else:
        a = a.selectExpr("*", "CAST(NULL AS STRING) _ln", "CAST(NULL AS STRING) _lv", "CAST(NULL AS STRING) _lm",
                         "CAST(NULL AS INT) _caps")

    known = F.exists("protocols", lambda p: p != "unknown")
    confidence = F.coalesce("_sc", F.when(known, 1).otherwise(0))
    use_oui = F.col("_sv").isNull() & F.col("oui_vendor").isNotNull()
    confidence = F.when(use_oui, F.greatest(confidence, F.lit(3))).otherwise(confidence)
    identified = F.coalesce("_id", F.lit(False))
    vendor = F.coalesce("_iv", "_sv", "oui_vendor")
    confidence = F.when(identified, 5).otherwise(confidence)
    use_lldp = vendor.isNull() & F.col("_lv").isNotNull()
    confidence = F.when(use_lldp, F.greatest(confidence, F.lit(4))).otherwise(confidence)
    kind = F.when((F.col("_sc") >= 3) & F.col("_sd").isNotNull(), F.col("_sd")).otherwise(F.col("device_type"))
    bridge, router = F.col("_caps").bitwiseAND(4) != 0, F.col("_caps").bitwiseAND(16) != 0
    kind = (
        F.when((kind == "unknown") & F.coalesce(router, F.lit(False)), "router")
        .when((kind == "unknown") & F.coalesce(bridge, F.lit(False)), "switch")
        .otherwise(kind)
    )
    out = a.select(
        "ip_address", "mac_address", F.col("_ln").alias("hostname"), kind.alias("device_type"),
        F.coalesce(vendor, "_lv").alias("vendor"), "protocols", "first_seen", "last_seen",
        F.lit("").alias("notes"), F.lit(None).cast("int").alias("purdue_level"),
        F.array().cast("array<string>").alias("tags"), "packet_count",
        confidence.cast("int").alias("confidence"), F.coalesce("_ip", "_sp", "_lm").alias("product_family"),
        "oui_vendor", X.is_public_ip(F.col("ip_address")).alias("is_public_ip"), "is_server",
    )
    if country_blocks is not None:
        return enrich_country(out, country_blocks)
    return out.withColumn("country", F.lit(None).cast("string"))


def asset_order() -> list[Column]:
    """Display order: OT devices first, then by packets."""
    return [
        F.col("device_type").isin(*C.UNCLASSIFIED_TYPES).asc(), F.col("packet_count").desc(), F.col("ip_address").asc(),
    ]


def protocol_stats(conns: DataFrame) -> DataFrame:
    """Totals and distinct devices per protocol in one aggregation.

    Each connection is seen once per end; only the first sighting carries its totals.
    """
    zero = F.lit(0).cast("bigint")
    ends = F.explode(
        F.array(
            F.struct(F.col("src_ip").alias("ip"), F.col("packet_count").alias("p"), F.col("byte_count").alias("b"),
                     F.lit(1).cast("bigint").alias("n")),
            F.struct(F.col("dst_ip").alias("ip"), zero.alias("p"), zero.alias("b"), zero.alias("n")),
        )
    )
    return conns.select("protocol", ends.alias("e")).groupBy("protocol").agg(
        F.sum("e.p").alias("packet_count"),
        F.sum("e.b").alias("byte_count"),
        F.sum("e.n").alias("connection_count"),
        F.countDistinct("e.ip").alias("unique_devices"),
    )


def function_code_stats(codes: DataFrame) -> DataFrame:
    """Totals per (protocol, function_code) of per-device counts."""
    return codes.groupBy("protocol", "function_code", "function_name", "is_write").agg(
        F.sum("count").alias("count")
    )


def timeline_range(conns: DataFrame) -> DataFrame:
    return conns.agg(
        F.min("first_seen").alias("earliest"), F.max("last_seen").alias("latest"),
        F.count("*").alias("connection_count"),
    )


def data_counts(assets: DataFrame, conns: DataFrame) -> DataFrame:
    total = conns.agg(F.count("*")).scalar()
    return assets.agg(F.count("*").alias("asset_count")).withColumn("connection_count", total)


def _page(table: DataFrame, order: list[Column], page: int, page_size: int | None) -> DataFrame:
    """One page in order, or the whole table as one page."""
    if page_size is None:
        return table.orderBy(*order).withColumn("total", table.agg(F.count("*")).scalar()).withColumn("has_more", F.lit(False))
    total = table.agg(F.count("*")).scalar()
    return (
        table.orderBy(*order).offset(page * page_size).limit(page_size)
        .withColumn("total", total)
        .withColumn("has_more", F.col("total") > (page + 1) * page_size)
    )


def list_assets(assets: DataFrame, page: int = 0, page_size: int | None = None, sort_by: str | None = None) -> DataFrame:
    """One page of assets by ``ip`` (default), ``packets`` or ``protocol``."""
    first = {
        "packets": [F.desc("packet_count")],
        "protocol": [F.get("protocols", F.lit(0)).asc_nulls_last()],
    }.get(sort_by, [])
    return _page(assets, first + [F.asc("ip_address")], page, page_size)


def list_connections(conns: DataFrame, page: int = 0, page_size: int | None = None, sort_by: str | None = None) -> DataFrame:
    """One page of connections by ``packets``, ``bytes`` or id."""
    first = {"packets": [F.desc("packet_count")], "bytes": [F.desc("byte_count")]}.get(sort_by, [])
    return _page(conns, first + [F.asc(c) for c in CONNECTION_KEY], page, page_size)


def search_assets(assets: DataFrame, text: str | None = None, protocol: str | None = None) -> DataFrame:
    if text:
        word = text.lower()
        cond = F.lit(False)
        for name in ("ip_address", "mac_address", "hostname", "vendor", "device_type", "notes"):
            cond = cond | F.coalesce(F.lower(name).contains(word), F.lit(False))
        assets = assets.filter(cond)
    if protocol:
        assets = assets.filter(F.array_contains("protocols", protocol))
    return assets


def ot_assets(assets: DataFrame) -> DataFrame:
    return assets.filter(~F.col("device_type").isin(*C.UNCLASSIFIED_TYPES))


def connection_tree(conns: DataFrame, assets: DataFrame) -> DataFrame:
    """Connections under their source, one row per leaf.

    A source with many connections stays many rows; ``ot_first`` and
    ``source_packets`` give the order of the sources, ``packet_count`` that of leaves.
    """
    totals = conns.groupBy("src_ip").agg(
        F.sum("packet_count").alias("source_packets"), F.count("*").alias("source_connections")
    )
    kinds = assets.select(
        F.col("ip_address").alias("src_ip"), "device_type", F.col("mac_address").alias("source_mac")
    )
    parents = totals.join(kinds, "src_ip", "left").withColumn(
        "device_type", F.coalesce("device_type", F.lit("unknown"))
    )
    leaves = conns.select("src_ip", "src_port", "dst_ip", "dst_port", "protocol", "packet_count", "byte_count")
    return leaves.join(parents, "src_ip").withColumn(
        "ot_first", ~F.col("device_type").isin(*C.UNCLASSIFIED_TYPES)
    )
