"""Queries over packets, inventory, traffic and per-device behaviour."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import devices as D
from ..operators import packets as P
from ..operators import patterns as T
from ..operators import signatures as G
from ..operators import traffic as A
from .registry import on_site, joined, sql_joined, us

KEY = "src_ip, src_port, dst_ip, dst_port, protocol"

# --- packets ---------------------------------------------------------------------------


@on_site("p1_identify_protocol", "SELECT protocol, count(*) AS packets FROM pk GROUP BY protocol")
def _(s):
    return s.packets.groupBy("protocol").agg(F.count("*").alias("packets"))


@on_site("p1_protocol_of_packets", "SELECT seq, protocol FROM pk")
def _(s):
    return s.packets.select("seq", "protocol")


@on_site("p2_is_ot", "SELECT protocol IN ('modbus','dnp3','ethernet_ip','bacnet','s7comm','opc_ua','profinet','iec104','mqtt',"
         "'hart_ip','ge_srtp','wonderware_suitelink') AS is_ot, count(*) AS packets FROM pk GROUP BY 1")
def _(s):
    return s.packets.groupBy(P.is_ot(F.col("protocol")).alias("is_ot")).agg(F.count("*").alias("packets"))


@on_site("p3_decode_modbus", """SELECT event_id AS seq, CAST(event_id % 65536 AS INT) AS transaction_id, unit AS unit_id,
    fc AS function_code, exc AS is_exception, CASE WHEN exc THEN '2' ELSE '' END AS exception_code, role,
    coalesce(reg_start || '+' || reg_count, '') AS registers,
    CASE WHEN fc IN (3, 6, 16) AND reg_start IS NOT NULL THEN 'holding_register' ELSE '' END AS reg_type,
    CASE WHEN fc = 8 AND NOT exc THEN CAST(k AS VARCHAR) ELSE '' END AS sub_function FROM msg WHERE protocol = 'modbus'""")
def _(s):
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return P.decode_modbus(s.packets).select(
        "seq", "transaction_id", "unit_id", "function_code", "is_exception", text("exception_code").alias("exception_code"), "role",
        F.coalesce(F.concat(F.col("reg_start").cast("string"), F.lit("+"), F.col("reg_count").cast("string")), F.lit("")).alias("registers"),
        text("reg_type").alias("reg_type"), text("sub_function").alias("sub_function"),
    )


@on_site("p4_decode_dnp3", """SELECT event_id AS seq, NOT resp AS from_master, CASE WHEN resp THEN 100 + c ELSE s END AS destination_address,
    CASE WHEN resp THEN s ELSE 100 + c END AS source_address, dfc AS function_code, dfc = 130 AS is_unsolicited, role
    FROM msg WHERE protocol = 'dnp3'""")
def _(s):
    return P.decode_dnp3(s.packets).select(
        "seq", "from_master", "destination_address", "source_address", "function_code", "is_unsolicited", "role"
    )


@on_site("p5_decode_iec104", """SELECT event_id AS seq, CASE WHEN iec IS NULL THEN 'u' ELSE 'i' END AS frame_type,
    coalesce(iec, -1) AS type_id, CASE WHEN iec IS NULL THEN -1 ELSE 6 END AS cause, CASE WHEN iec IS NULL THEN -1 ELSE s END AS common_address,
    CASE WHEN iec IS NULL THEN -1 ELSE k END AS first_ioa, coalesce(iec >= 45, FALSE) AS is_command, coalesce(iec < 45, FALSE) AS is_monitor, role
    FROM msg WHERE protocol = 'iec104'""")
def _(s):
    plain = lambda c: F.coalesce(F.col(c), F.lit(-1)).alias(c)
    return P.decode_iec104(s.packets).select(
        "seq", "frame_type", *[plain(c) for c in ("type_id", "cause", "common_address", "first_ioa")], "is_command", "is_monitor", "role"
    )


@on_site("p6_decode_s7", """SELECT event_id AS seq, CASE WHEN resp THEN 3 ELSE 1 END AS rosctr, s7_function, role FROM msg WHERE protocol = 's7comm'""")
def _(s):
    return P.decode_s7(s.packets).select("seq", "rosctr", "s7_function", "role")


@on_site("p7_decode_enip_header", """SELECT event_id AS seq, command, CASE WHEN command = 'send_rr_data' THEN 16 ELSE 0 END AS data_length,
    CAST(1 AS BIGINT) AS session, CAST(0 AS BIGINT) AS status FROM msg WHERE protocol = 'ethernet_ip'""")
def _(s):
    return P.decode_enip_header(s.packets).select("seq", "command", "data_length", "session", "status")


@on_site("p8_function_code_name", "SELECT protocol, function_code, function_name, CAST(sum(n) AS BIGINT) AS messages FROM fcs GROUP BY 1, 2, 3")
def _(s):
    counted = s.messages.filter("function_code IS NOT NULL").groupBy("protocol", "function_code").agg(F.count("*").alias("messages"))
    return P.function_code_name(counted).select("protocol", "function_code", "function_name", "messages")


@on_site("p9_filter_packets", """SELECT seq, src_ip, dst_ip, src_port, dst_port FROM pk WHERE src_ip IN ('10.10.0.1', '203.0.113.4')
    OR dst_ip IN ('10.10.0.1', '203.0.113.4') OR src_port IN (502, 2404) OR dst_port IN (502, 2404)""")
def _(s):
    return P.filter_packets(s.packets, ips=["10.10.0.1", "203.0.113.4"], ports=[502, 2404]).select(
        "seq", "src_ip", "dst_ip", "src_port", "dst_port"
    )


@on_site("p10_connection_packets", f"""SELECT * FROM (SELECT seq, {KEY}, length,
    CAST(row_number() OVER (PARTITION BY {KEY} ORDER BY ts, seq) AS INT) AS rank FROM pk) WHERE rank <= 1000""")
def _(s):
    return P.connection_packets(s.packets, 1000).select("seq", *KEY.split(", "), "length", "rank")


@on_site("p10_all_connection_packets", f"SELECT seq, sha256(concat_ws('|', {KEY})) AS connection_id, {KEY}, transport, length, origin_file FROM pk")
def _(s):
    return P.connection_packets(s.packets).drop("ts")


_SIG = """SELECT seq, src_ip, dst_ip, unnest(list_filter([
    CASE WHEN u2 AND dp = 47808 THEN 'bacnet_npdu_version:4' END, CASE WHEN u2 AND dp = 47808 THEN 'bacnet_bvlc:4' END,
    CASE WHEN u2 AND dp = 47808 THEN 'bacnet_generic:1' END,
    CASE WHEN t2 AND dp = 20000 THEN 'dnp3_generic:1' END, CASE WHEN t2 AND dp = 20000 THEN 'dnp3_start_bytes:4' END,
    CASE WHEN t2 AND dp = 44818 AND et = 'click' THEN 'enip_list_identity:2' END, CASE WHEN t2 AND dp = 44818 THEN 'ethernet_ip_generic:1' END,
    CASE WHEN t2 AND dp = 18245 THEN 'ge_srtp_generic:1' END, CASE WHEN t2 AND dp = 5094 THEN 'hart_ip_generic:1' END,
    CASE WHEN t2 AND dp = 2404 AND iec IS NULL THEN 'iec104_startdt_act:4' END, CASE WHEN t2 AND dp = 2404 THEN 'iec104_generic:1' END,
    CASE WHEN t2 AND dp = 2404 THEN 'iec104_start_byte:4' END, CASE WHEN t2 AND dp = 502 THEN 'modbus_generic:1' END,
    CASE WHEN t2 AND src_port = 502 THEN 'modbus_server_response:2' END, CASE WHEN t2 AND dp = 1883 THEN 'mqtt_generic:1' END,
    CASE WHEN t2 AND dp = 4840 THEN 'opc_ua_generic:1' END, CASE WHEN t2 AND dp = 4840 AND et = 'purchase' THEN 'opc_ua_hello:4' END,
    CASE WHEN t2 AND dp = 102 THEN 's7comm_protocol_id:3' END, CASE WHEN t2 AND dp = 102 THEN 's7comm_cotp_connect:4' END,
    CASE WHEN t2 AND dp = 102 THEN 's7comm_generic:1' END, CASE WHEN t2 AND dp = 5007 THEN 'wonderware_suitelink:1' END
    ], lambda x: x IS NOT NULL)) AS hit FROM (SELECT *, dst_port AS dp, transport = 'tcp' AS t2, transport = 'udp' AS u2 FROM pk)"""


@on_site("p11_match_signatures", f"SELECT seq, split_part(hit, ':', 1) AS signature_name, CAST(split_part(hit, ':', 2) AS INT) AS confidence FROM ({_SIG})")
def _(s):
    return G.match_signatures(s.packets).select("seq", "signature_name", "confidence")


_BEST = f"""SELECT ip, signature_name, confidence, CAST(row_number() OVER (PARTITION BY ip ORDER BY confidence DESC, signature_name) AS INT) AS match_rank
    FROM (SELECT ip, split_part(hit, ':', 1) AS signature_name, max(CAST(split_part(hit, ':', 2) AS INT)) AS confidence FROM (
    SELECT src_ip AS ip, hit FROM ({_SIG}) UNION ALL SELECT dst_ip, hit FROM ({_SIG})) GROUP BY 1, 2)"""


@on_site("p12_best_signature_matches", _BEST)
def _(s):
    return G.best_signature_matches(s.packets).select("ip", "signature_name", "confidence", "match_rank")


@on_site("p13_extract_payload_fields", """WITH h AS (SELECT seq, CAST(hex(payload) AS VARCHAR) AS t, octet_length(payload) AS n FROM pk)
    SELECT seq, 'head' AS label, lower(substr(t, 1, 2)) || CASE WHEN n >= 2 THEN ' ' || lower(substr(t, 3, 2)) ELSE '' END
        || CASE WHEN n >= 3 THEN ' ' || lower(substr(t, 5, 2)) ELSE '' END AS value FROM h WHERE n > 0
    UNION ALL SELECT seq, 'be', CAST(CAST('0x' || substr(t, 1, 4) AS BIGINT) AS VARCHAR) FROM h WHERE n >= 2
    UNION ALL SELECT seq, 'le', CAST(CAST('0x' || substr(t, 3, 2) || substr(t, 1, 2) AS BIGINT) AS VARCHAR) FROM h WHERE n >= 2
    UNION ALL SELECT seq, 'text', v FROM (SELECT seq, array_to_string(list_transform(list_filter(CASE WHEN z > 0 THEN b[:z - 1] ELSE b END,
        lambda x: x BETWEEN '20' AND '7E'), lambda x: chr(CAST('0x' || x AS INT))), '') AS v
        FROM (SELECT seq, b, coalesce(list_position(b, '00'), 0) AS z FROM (SELECT seq, list_transform(range(n), lambda i: substr(t, CAST(2 * i + 1 AS BIGINT), 2)) AS b FROM h))) WHERE v <> ''""")
def _(s):
    return G.extract_payload_fields(s.packets, [
        {"label": "head", "offset": 0, "length": 3, "format": "hex"}, {"label": "be", "offset": 0, "length": 2, "format": "uint16_be"},
        {"label": "le", "offset": 0, "length": 2, "format": "uint16_le"}, {"label": "text", "offset": 0, "length": 0, "format": "ascii"},
    ])


@on_site("p14_test_signature", f"""SELECT src_ip, dst_ip, src_port, dst_port, 'remote_desktop' AS signature_name, 3 AS confidence FROM cn
    WHERE transport = 'tcp' AND dst_port = 3389 AND substr(src_mac, 1, 8) = '00:1b:1b'""")
def _(s):
    rule = {"name": "remote_desktop", "confidence": 3, "filters": [
        {"field": "dst_port", "value": 3389}, {"field": "mac.src_oui", "value": "00:1B:1B"}, {"field": "src_port"}]}
    return G.test_signature(s.connections, rule)


# --- inventory and traffic -----------------------------------------------------------------


@on_site("a1_connections", f"""SELECT {KEY}, packet_count, byte_count, epoch_us(first_seen) AS first_seen_us, epoch_us(last_seen) AS last_seen_us,
    src_mac, dst_mac, transport, {sql_joined('origin_files')} AS origin_files FROM cn""")
def _(s):
    return A.connections(s.packets, files=True).select(
        *KEY.split(", "), "packet_count", "byte_count", us("first_seen"), us("last_seen"), "src_mac", "dst_mac", "transport",
        joined("origin_files").alias("origin_files"),
    )


@on_site("a1_connection_files", f"SELECT {KEY}, origin_file, count(*) AS packet_count FROM pk GROUP BY ALL")
def _(s):
    return A.connection_files(s.packets).drop("connection_id")


@on_site("a2_asset_base", f"""SELECT ip AS ip_address, {sql_joined('protocols')} AS protocols, packet_count, mac AS mac_address,
    epoch_us(first_seen) AS first_seen_us, epoch_us(last_seen) AS last_seen_us FROM ab""")
def _(s):
    return s.base.select("ip_address", joined("protocols").alias("protocols"), "packet_count", "mac_address", us("first_seen"), us("last_seen"))


@on_site("a3_server_ips", "SELECT ip AS ip_address FROM ab WHERE is_server")
def _(s):
    return A.server_ips(s.connections)


@on_site("a4_infer_device_type", "SELECT ip AS ip_address, device_type FROM ass")
def _(s):
    return A.infer_device_type(s.base, s.servers).select("ip_address", "device_type")


# Switch announcements: the servers that spoke on port 3389 carry a switch name.
_LLDP = """lldp AS (SELECT src_mac AS mac, last('sw-' || k ORDER BY ts, seq) AS system_name,
    last(CASE WHEN k % 2 = 0 THEN 4 ELSE 20 END ORDER BY ts, seq) AS caps, last('EDS-400A rev ' || k ORDER BY ts, seq) AS model,
    last(CASE WHEN k % 4 = 0 THEN 1 ELSE k END ORDER BY ts, seq) AS vlan_id
    FROM pk WHERE src_port = 3389 GROUP BY src_mac)"""


def lldp_rows(s):
    k = F.col("k")
    raw = s.packets.filter("src_port = 3389").withColumn("k", F.expr("CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"))
    return raw.select(
        F.col("src_mac").alias("mac"), "ts", "seq", F.concat(F.lit("sw-"), k.cast("string")).alias("system_name"),
        F.lit(None).cast("string").alias("vendor"), F.concat(F.lit("EDS-400A rev "), k.cast("string")).alias("model"),
        F.when(k % 2 == 0, 4).otherwise(20).alias("capabilities"), F.lit(0).alias("enabled_capabilities"),
        F.lit("v1").alias("firmware"), F.when(k % 4 == 0, 1).otherwise(k).alias("vlan_id"),
    )


def packets_with_props(s):
    from . import binding

    extra = binding.events(s.spark, s.sf_dir).select(F.col("event_id").alias("seq"), "props")
    s.packets = s.packets.join(extra, "seq")
    return s


@on_site("a5_asset_signatures", f"""SELECT ip AS ip_address, coalesce(m, '') AS matches FROM ab LEFT JOIN (
    SELECT ip, string_agg(signature_name || '=' || confidence, ',' ORDER BY match_rank) AS m FROM ({_BEST}) GROUP BY ip) USING (ip)""")
def _(s):
    rows = G.asset_signatures(s.assets, G.best_signature_matches(s.packets))
    shown = F.transform("signature_matches", lambda m: F.concat_ws("=", m["signature_name"], m["confidence"].cast("string")))
    return rows.select("ip_address", F.array_join(shown, ",").alias("matches"))


@on_site("a5_build_assets", f"""WITH {_LLDP}, best AS (SELECT * FROM ({_BEST}) WHERE match_rank = 1),
    ident AS (SELECT src_ip AS ip, last('Vendor ' || (k % 7) ORDER BY ts, seq) AS vendor_name, last('PC-' || k ORDER BY ts, seq) AS product
        FROM pk WHERE src_port = 102 GROUP BY src_ip)
    SELECT a.ip AS ip_address, a.mac AS mac_address, coalesce(l.system_name, '') AS hostname,
    CASE WHEN t = 'unknown' AND l.caps = 20 THEN 'router' WHEN t = 'unknown' AND l.caps = 4 THEN 'switch' ELSE t END AS device_type,
    coalesce(i.vendor_name, CASE WHEN b.signature_name LIKE 's7comm%' THEN 'Siemens' WHEN b.signature_name LIKE 'ge_srtp%' THEN 'GE'
        WHEN b.signature_name LIKE 'wonder%' THEN 'Wonderware' END, a.vendor, '') AS vendor, {sql_joined('a.protocols')} AS protocols,
    a.packet_count, CASE WHEN i.ip IS NOT NULL THEN 5 WHEN a.vendor IS NOT NULL AND NOT coalesce(b.signature_name LIKE 's7comm%'
        OR b.signature_name LIKE 'ge_srtp%' OR b.signature_name LIKE 'wonder%', FALSE)
        THEN greatest(3, coalesce(b.confidence, CASE WHEN list_filter(a.protocols, lambda p: p <> 'unknown') <> [] THEN 1 ELSE 0 END))
        ELSE coalesce(b.confidence, CASE WHEN list_filter(a.protocols, lambda p: p <> 'unknown') <> [] THEN 1 ELSE 0 END) END AS confidence,
    coalesce(i.product, l.model, '') AS product_family, coalesce(a.vendor, '') AS oui_vendor, a.is_public AS is_public_ip,
    CASE WHEN a.is_public THEN 'ZZ' ELSE '' END AS country
    FROM (SELECT x.*, b.*, CASE WHEN b.confidence >= 3 AND b.signature_name LIKE 'bacnet_npdu%' THEN 'building_controller'
        WHEN b.confidence >= 3 AND (b.signature_name LIKE 'dnp3%' OR b.signature_name LIKE 'iec104%') THEN 'rtu'
        WHEN b.confidence >= 3 AND b.signature_name LIKE 's7comm%' THEN 'plc' ELSE x.device_type END AS t
        FROM ass x LEFT JOIN (SELECT ip AS bip, signature_name, confidence FROM best) b ON b.bip = x.ip) a
    LEFT JOIN (SELECT ip AS bip, signature_name, confidence FROM best) b ON b.bip = a.ip
    LEFT JOIN ident i ON i.ip = a.ip LEFT JOIN lldp l ON l.mac = a.mac""")
def _(s):
    s = packets_with_props(s)
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    ident = D.modbus_device_identity(
        s.packets.filter("src_port = 102").select(
            F.col("src_ip").alias("ip"), "ts", "seq", F.concat(F.lit("Vendor "), (k % 7).cast("string")).alias("vendor_name"),
            F.concat(F.lit("PC-"), k.cast("string")).alias("product_code"), F.lit(None).cast("string").alias("product_name"),
            F.lit(None).cast("string").alias("model_name"),
        )
    )
    lldp = D._last_row(lldp_rows(s), "mac")
    blocks = s.spark.createDataFrame([(3405803776, 3405804031, "ZZ"), (3405774848, 3405840383, "YY")], "start_ip bigint, end_ip bigint, country string")
    out = A.build_assets(s.base, s.servers, G.best_signature_matches(s.packets), ident, lldp, s.oui, blocks)
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return out.select(
        "ip_address", "mac_address", text("hostname"), "device_type", text("vendor"), joined("protocols").alias("protocols"), "packet_count",
        "confidence", text("product_family"), text("oui_vendor"), "is_public_ip", text("country"),
    )


@on_site("a6_enrich_oui", "SELECT ip AS ip_address, coalesce(vendor, '') AS oui_vendor FROM ass")
def _(s):
    return A.enrich_oui(s.base, s.oui).select("ip_address", F.coalesce("oui_vendor", F.lit("")).alias("oui_vendor"))


@on_site("a7_is_public_ip", """SELECT ip AS ip_address, NOT (o1 IN (0, 10, 127) OR (o1 = 172 AND o2 BETWEEN 16 AND 31) OR (o1 = 192 AND o2 = 168)
    OR (o1 = 100 AND o2 BETWEEN 64 AND 127) OR (o1 = 169 AND o2 = 254) OR o1 >= 224) AS is_public_ip
    FROM (SELECT ip, CAST(split_part(ip, '.', 1) AS INT) AS o1, CAST(split_part(ip, '.', 2) AS INT) AS o2 FROM abw)""", "wide")
def _(s):
    return s.base.select("ip_address", A.is_public_ip(F.col("ip_address")).alias("is_public_ip"))


@on_site("a8_enrich_country", """SELECT ip AS ip_address, CASE WHEN NOT is_public THEN '' WHEN CAST(split_part(ip, '.', 4) AS INT) >= 128 THEN 'BB'
    ELSE 'AA' END AS country FROM assw""", "wide")
def _(s):
    blocks = s.spark.createDataFrame([(3405803776, 3405804031, "AA"), (3405803904, 3405804031, "BB")], "start_ip bigint, end_ip bigint, country string")
    return A.enrich_country(s.base, blocks).select("ip_address", F.coalesce("country", F.lit("")).alias("country"))


@on_site("a9_protocol_stats", """SELECT p.protocol, p.packet_count, p.byte_count, p.connection_count, d.unique_devices FROM (
    SELECT protocol, CAST(sum(packet_count) AS BIGINT) AS packet_count, CAST(sum(byte_count) AS BIGINT) AS byte_count, count(*) AS connection_count
    FROM cn GROUP BY protocol) p JOIN (SELECT protocol, count(DISTINCT ip) AS unique_devices FROM en GROUP BY protocol) d USING (protocol)""")
def _(s):
    return A.protocol_stats(s.connections)


@on_site("a10_function_code_stats", """SELECT protocol, function_code, function_name, is_write, CAST(sum(n) AS BIGINT) AS count FROM fcs GROUP BY 1, 2, 3, 4""")
def _(s):
    return A.function_code_stats(D.function_codes(s.messages))


@on_site("a11_timeline_range", "SELECT epoch_us(min(first_seen)) AS earliest_us, epoch_us(max(last_seen)) AS latest_us, count(*) AS connection_count FROM cn")
def _(s):
    return A.timeline_range(s.connections).select(us("earliest"), us("latest"), "connection_count")


@on_site("a12_data_counts", "SELECT (SELECT count(*) FROM ab) AS asset_count, (SELECT count(*) FROM cn) AS connection_count")
def _(s):
    return A.data_counts(s.base, s.connections)


@on_site("a13_list_assets", """SELECT ip AS ip_address, packet_count, (SELECT count(*) FROM assw) AS total, (SELECT count(*) FROM assw) > 200 AS has_more
    FROM assw ORDER BY packet_count DESC, ip OFFSET 100 LIMIT 100""", "wide")
def _(s):
    return A.list_assets(s.assets, page=1, page_size=100, sort_by="packets").select("ip_address", "packet_count", "total", "has_more")


@on_site("a13_list_connections", f"""SELECT {KEY}, byte_count, (SELECT count(*) FROM cnw) AS total, (SELECT count(*) FROM cnw) > 1500 AS has_more
    FROM cnw ORDER BY byte_count DESC, {KEY} OFFSET 1000 LIMIT 500""", "wide")
def _(s):
    return A.list_connections(s.connections, page=2, page_size=500, sort_by="bytes").select(*KEY.split(", "), "byte_count", "total", "has_more")


@on_site("a13_list_all_assets", "SELECT ip AS ip_address, packet_count, (SELECT count(*) FROM assw) AS total, FALSE AS has_more FROM assw", "wide")
def _(s):
    return A.list_assets(s.assets, sort_by="protocol").select("ip_address", "packet_count", "total", "has_more")


@on_site("a13_list_all_connections", f"SELECT {KEY}, byte_count, (SELECT count(*) FROM cnw) AS total, FALSE AS has_more FROM cnw", "wide")
def _(s):
    return A.list_connections(s.connections).select(*KEY.split(", "), "byte_count", "total", "has_more")


@on_site("a14_search_assets", """SELECT ip AS ip_address, device_type FROM ass WHERE (ip LIKE '%10.200.1%' OR mac LIKE '%10.200.1%'
    OR lower(vendor) LIKE '%10.200.1%') AND list_contains(protocols, 'modbus')""")
def _(s):
    return A.search_assets(s.assets, "10.200.1", "modbus").select("ip_address", "device_type")


@on_site("a14_ot_assets", "SELECT ip AS ip_address, device_type FROM ass WHERE device_type NOT IN ('it_device', 'unknown')")
def _(s):
    return A.ot_assets(s.assets).select("ip_address", "device_type")


@on_site("a15_connection_tree", f"""SELECT c.src_ip, c.src_port, c.dst_ip, c.dst_port, c.protocol, c.packet_count, t.source_packets, t.source_connections,
    a.device_type, a.device_type NOT IN ('it_device', 'unknown') AS ot_first FROM cn c JOIN (SELECT src_ip, CAST(sum(packet_count) AS BIGINT) AS source_packets,
    count(*) AS source_connections FROM cn GROUP BY src_ip) t USING (src_ip) JOIN ass a ON a.ip = c.src_ip""")
def _(s):
    return A.connection_tree(s.connections, s.assets).select(
        *KEY.split(", "), "packet_count", "source_packets", "source_connections", "device_type", "ot_first"
    )


_STATS = """SELECT src_ip, dst_ip, port, protocol, packet_count, byte_count, epoch_us(first_seen) AS first_seen_us, epoch_us(last_seen) AS last_seen_us,
    round(avg_ms, 3) AS avg_ms, round(std_ms, 1) AS std_ms, min_ms, max_ms, is_periodic FROM {t}"""


def _stats(s):
    return s.stats.select(
        "src_ip", "dst_ip", "port", "protocol", "packet_count", "byte_count", us("first_seen"), us("last_seen"),
        F.round("avg_interval_ms", 3).alias("avg_ms"), F.round("std_interval_ms", 1).alias("std_ms"), F.col("min_interval_ms").alias("min_ms"),
        F.col("max_interval_ms").alias("max_ms"), "is_periodic",
    )


on_site("a16_connection_stats", _STATS.format(t="st"))(_stats)
on_site("a16_connection_stats_fast", _STATS.format(t="str"), "replay")(_stats)


@on_site("a17_pattern_anomalies", "SELECT src_ip, dst_ip, port, protocol, anomaly_type FROM anr", "replay")
def _(s):
    return s.anomalies.select("src_ip", "dst_ip", "port", "protocol", "anomaly_type")


@on_site("a17_pattern_anomalies_slow", "SELECT src_ip, dst_ip, port, protocol, anomaly_type FROM an")
def _(s):
    return s.anomalies.select("src_ip", "dst_ip", "port", "protocol", "anomaly_type")


@on_site("a18_pattern_rows", """SELECT s.src_ip, s.dst_ip, s.port, s.protocol, s.packet_count, a.n AS anomaly_count FROM str s JOIN (
    SELECT src_ip, dst_ip, port, protocol, count(*) AS n FROM anr GROUP BY 1, 2, 3, 4) a USING (src_ip, dst_ip, port, protocol)
    WHERE protocol = 'modbus' ORDER BY packet_count DESC, src_ip, dst_ip, port, protocol LIMIT 25""", "replay")
def _(s):
    return T.pattern_rows(s.stats, s.anomalies, protocol="modbus", anomalies_only=True, page_size=25).select(
        "src_ip", "dst_ip", "port", "protocol", "packet_count", "anomaly_count"
    )


@on_site("a18_all_pattern_rows", """SELECT s.src_ip, s.dst_ip, s.port, s.protocol, s.packet_count, coalesce(a.n, 0) AS anomaly_count FROM str s LEFT JOIN (
    SELECT src_ip, dst_ip, port, protocol, count(*) AS n FROM anr GROUP BY 1, 2, 3, 4) a USING (src_ip, dst_ip, port, protocol)""", "replay")
def _(s):
    return T.pattern_rows(s.stats, s.anomalies).select("src_ip", "dst_ip", "port", "protocol", "packet_count", "anomaly_count")


@on_site("a19_device_first_last_seen", "SELECT ip AS ip_address, epoch_us(first_seen) AS first_seen_us, epoch_us(last_seen) AS last_seen_us FROM ab")
def _(s):
    return s.seen.select("ip_address", us("first_seen"), us("last_seen"))


@on_site("a19_capture_window", "SELECT epoch_us(min(ts)) AS capture_start_us, epoch_us(max(ts)) AS capture_end_us FROM pk")
def _(s):
    return T.capture_window(s.stats).select(us("capture_start"), us("capture_end"))


# --- devices --------------------------------------------------------------------------------


@on_site("d1_modbus_roles", "SELECT ip, m_role AS role FROM dv WHERE m_role IS NOT NULL")
def _(s):
    return D.modbus_roles(s.messages)


@on_site("d2_modbus_unit_ids", f"SELECT ip, {sql_joined('m_units')} AS unit_ids FROM dv WHERE m_role IS NOT NULL")
def _(s):
    return D.modbus_unit_ids(s.messages).select("ip", joined("unit_ids").alias("unit_ids"))


@on_site("d3_modbus_function_codes", "SELECT ip, function_code, function_name, n AS count, is_write FROM fcs WHERE protocol = 'modbus'")
def _(s):
    return D.modbus_function_codes(s.messages).select("ip", "function_code", "function_name", "count", "is_write")


@on_site("d4_modbus_register_ranges", """SELECT src_ip AS ip, reg_start, reg_count, 'holding_register' AS reg_type, count(*) AS access_count FROM msg
    WHERE reg_start IS NOT NULL GROUP BY 1, 2, 3""")
def _(s):
    return D.modbus_register_ranges(s.messages)


@on_site("d5_modbus_relationships", f"SELECT ip, remote_ip, remote_role, packet_count, {sql_joined('unit_ids')} AS unit_ids FROM mp")
def _(s):
    return D.modbus_relationships(s.messages).select("ip", "remote_ip", "remote_role", "packet_count", joined("unit_ids").alias("unit_ids"))


@on_site("d6_modbus_polling_intervals", """SELECT ip, remote_ip, function_code, unit_id, avg_ms AS avg_interval_ms, min_ms AS min_interval_ms,
    max_ms AS max_interval_ms, sample_count FROM por""", "replay")
def _(s):
    return D.modbus_polling_intervals(s.messages)


@on_site("d7_modbus_device_identity", "SELECT src_ip AS ip, last('PC-' || k ORDER BY ts, seq) AS product_code FROM pk WHERE src_port = 502 GROUP BY src_ip")
def _(s):
    s = packets_with_props(s)
    rows = s.packets.filter("src_port = 502").select(
        F.col("src_ip").alias("ip"), "ts", "seq", F.concat(F.lit("PC-"), F.regexp_extract("props", "([0-9]+)", 1)).alias("product_code")
    )
    return D.modbus_device_identity(rows)


@on_site("d8_dnp3_detail", f"""SELECT ip, d_role AS role, {sql_joined('d_addr')} AS addresses, d_unsol AS has_unsolicited, d_writes AS write_count FROM dv
    WHERE d_role IS NOT NULL""")
def _(s):
    return D.dnp3_detail(s.messages).select("ip", "role", joined("addresses").alias("addresses"), "has_unsolicited", "write_count")


@on_site("d8_dnp3_relationships", "SELECT ip, remote_ip, remote_role, packet_count FROM dp")
def _(s):
    return D.dnp3_relationships(s.messages)


@on_site("d9_enip_detail", """SELECT ip, e_role AS role, e_assembly AS cip_writes_to_assembly, e_file AS cip_file_access,
    e_list AS list_identity_requests FROM dv WHERE e_role IS NOT NULL""")
def _(s):
    return D.enip_detail(s.messages)


@on_site("d10_s7_detail", f"SELECT ip, s_role AS role, {sql_joined('s_funcs')} AS functions_seen FROM dv WHERE s_role IS NOT NULL")
def _(s):
    return D.s7_detail(s.messages).select("ip", "role", joined("functions_seen").alias("functions_seen"))


@on_site("d11_bacnet_detail", """SELECT ip, b_role AS role, b_out AS write_to_output, b_notif AS write_to_notification_class,
    b_reinit AS reinitialize_device, b_comm AS device_communication_control FROM dv WHERE b_role IS NOT NULL""")
def _(s):
    return D.bacnet_detail(s.messages)


@on_site("d12_iec104_detail", """SELECT ip, i_role AS role, i_cmd AS has_control_commands, i_reset AS has_reset_process,
    i_inter AS has_interrogation FROM dv WHERE i_role IS NOT NULL""")
def _(s):
    return D.iec104_detail(s.messages)


@on_site("d13_profinet_detail", "SELECT ip, p_role AS role, coalesce(p_name, '') AS device_name FROM dv WHERE p_role IS NOT NULL")
def _(s):
    return D.profinet_detail(s.messages).select("ip", "role", F.coalesce("device_name", F.lit("")).alias("device_name"))


@on_site("d14_lldp_by_device", f"WITH {_LLDP} SELECT a.ip, a.mac, l.system_name, l.model, l.vlan_id FROM ab a JOIN lldp l USING (mac)")
def _(s):
    s = packets_with_props(s)
    return D.lldp_by_device(lldp_rows(s), s.base).select("ip", "mac", "system_name", "model", "vlan_id")


@on_site("d14_snmp_by_device", "SELECT src_ip AS ip, last('desc ' || k ORDER BY ts, seq) AS sys_descr FROM pk WHERE src_port = 443 GROUP BY src_ip")
def _(s):
    s = packets_with_props(s)
    rows = s.packets.filter("src_port = 443").select(
        F.col("src_ip").alias("ip"), "ts", "seq", F.concat(F.lit("desc "), F.regexp_extract("props", "([0-9]+)", 1)).alias("sys_descr")
    )
    return D.snmp_by_device(rows)


@on_site("d15_redundancy_frames", """SELECT src_mac AS mac, last(CASE WHEN k % 3 = 0 THEN 'mrp' ELSE 'rstp' END ORDER BY ts, seq) AS protocol,
    last(k % 10 = 1 ORDER BY ts, seq) AS topology_change FROM pk GROUP BY src_mac""")
def _(s):
    s = packets_with_props(s)
    return D.redundancy_frames(redundancy_rows(s))


def redundancy_rows(s):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return s.packets.select(
        F.col("src_mac").alias("mac"), "ts", "seq", F.when(k % 3 == 0, "mrp").otherwise("rstp").alias("protocol"),
        (k % 10 == 1).alias("topology_change"),
    )


@on_site("d16_device_protocol_info", f"""SELECT ip, coalesce(m_role, '') AS modbus_role, m_writes AS modbus_writes, coalesce(d_role, '') AS dnp3_role,
    coalesce(e_role, '') AS enip_role, coalesce(s_role, '') AS s7_role, {sql_joined('s_funcs')} AS s7_functions, coalesce(b_role, '') AS bacnet_role,
    coalesce(i_role, '') AS iec104_role, coalesce(p_role, '') AS profinet_role FROM dv""")
def _(s):
    role = lambda p, n: F.coalesce(F.col(f"{p}.role"), F.lit("")).alias(n)
    return s.devices.select(
        "ip", role("modbus", "modbus_role"), F.coalesce("modbus.write_count", F.lit(0)).alias("modbus_writes"), role("dnp3", "dnp3_role"),
        role("ethernet_ip", "enip_role"), role("s7comm", "s7_role"), joined("s7comm.functions_seen").alias("s7_functions"),
        role("bacnet", "bacnet_role"), role("iec104", "iec104_role"), role("profinet", "profinet_role"),
    )
