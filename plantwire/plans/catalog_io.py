"""Queries over sources, sinks, exports and streams.

Source queries write the derived traffic in the format of the source, read it back
with the reader, and are compared with the traffic itself.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.scale import shared_dir
from ..operators import topology as G
from ..operators import traffic
from ..sources import inventory as I
from ..sources import logs as L
from ..sources import sinks as K
from ..streaming import live as V
from . import binding
from .catalog_assess import alerts
from .registry import SQL, joined, on_site, sql_joined

KEY = "src_ip, src_port, dst_ip, dst_port, protocol"


def _folder(s, name: str) -> str:
    return f"{shared_dir(s.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _text(lines, path: str) -> str:
    lines.write.text(path)
    return path


def _framed(lines, head: str, tail: str | None, path: str) -> str:
    """Lines in as many files as shuffles have partitions, each file with its own first and last line."""
    spark, files = lines.sparkSession, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    body = lines.toDF("line").select(F.pmod(F.xxhash64("line"), F.lit(files)).alias("file"), F.lit(1).alias("place"), "line")
    for place, text in ((0, head), (2, tail)):
        if text is not None:
            body = body.union(spark.range(files).select("id", F.lit(place), F.lit(text)))
    body.repartition(files, "file").sortWithinPartitions("file", "place").drop("place").write.partitionBy("file").text(path)
    return path


#: Column orders of the written logs by kind.
_ZEEK_LOGS = {
    "conn": ["ts", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "service", "orig_pkts", "resp_pkts", "orig_bytes"],
    "notice": ["service", "id.resp_p", "id.resp_h", "uid", "id.orig_p", "id.orig_h", "ts"],
} | {kind: ["id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "ts", "func"] for kind in ("modbus", "dnp3", "s7comm")}
_ZEEK = """SELECT src_ip, src_port, dst_ip, dst_port, protocol, transport, packet_count, byte_count, epoch_us(first_seen) AS first_us FROM cn
UNION ALL SELECT src_ip, src_port, dst_ip, dst_port, protocol, 'tcp', CAST(1 AS BIGINT), CAST(0 AS BIGINT), epoch_us(first_seen) FROM cn WHERE protocol IN ('modbus', 'dnp3', 's7comm')
UNION ALL SELECT src_ip, src_port, dst_ip, dst_port, CASE WHEN dst_port >= 49152 THEN 'unknown' ELSE protocol END, 'tcp', CAST(1 AS BIGINT), CAST(0 AS BIGINT), epoch_us(first_seen) FROM cn"""


def _zeek_folder(s) -> str:
    """Logs of all kinds in one folder, each file with its own header."""
    us = F.unix_micros("first_seen")
    values = {
        "ts": F.concat(F.expr("CAST(unix_micros(first_seen) div 1000000 AS STRING)"), F.lit("."), F.lpad((us % 1000000).cast("string"), 6, "0")),
        "id.orig_h": F.col("src_ip"), "id.orig_p": F.col("src_port").cast("string"), "id.resp_h": F.col("dst_ip"), "id.resp_p": F.col("dst_port").cast("string"),
        "proto": F.col("transport"), "orig_pkts": F.col("packet_count").cast("string"), "resp_pkts": F.lit("-"), "orig_bytes": F.col("byte_count").cast("string"),
    }
    files, rows = int(s.spark.conf.get("spark.sql.shuffle.partitions")), []
    for kind, fields in _ZEEK_LOGS.items():
        line = F.concat_ws("\t", *[values.get(f, {"conn": F.col("protocol"), "notice": F.lit("(empty)")}.get(kind, F.lit("READ"))) for f in fields])
        head = F.lit(f"#separator \\x09\n#path\t{kind}\n#fields\t" + "\t".join(fields))
        logged = s.connections if kind in ("conn", "notice") else s.connections.filter(F.col("protocol") == kind)
        file = F.pmod(F.xxhash64("src_ip", "dst_ip", "src_port", "dst_port"), F.lit(files))
        rows += [s.spark.range(files).select(F.lit(kind).alias("log"), F.col("id").alias("file"), F.lit(0).alias("place"), head.alias("line")),
                 logged.select(F.lit(kind).alias("log"), file.alias("file"), F.lit(1).alias("place"), line.alias("line"))]
    path = _folder(s, "zeek")
    reduce(DataFrame.union, rows).repartition(files, "log", "file").sortWithinPartitions("log", "file", "place").drop("place").write.partitionBy("log", "file").text(path)
    return path


@on_site("s1_read_zeek", _ZEEK)
def _(s):
    return L.read_zeek(s.spark, _zeek_folder(s)).select(
        "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "transport", "packet_count", "byte_count", F.unix_micros("first_seen").alias("first_us")
    )


@on_site("s1_zeek_assets", f"""SELECT ip_address, string_agg(DISTINCT protocol, ',' ORDER BY protocol) AS protocols FROM (
SELECT src_ip AS ip_address, protocol FROM ({_ZEEK}) UNION ALL SELECT dst_ip, protocol FROM ({_ZEEK})) GROUP BY 1""")
def _(s):
    return L.assets_of(L.read_zeek(s.spark, _zeek_folder(s))).select("ip_address", joined("protocols").alias("protocols"))


@on_site("s2_read_suricata_eve", """SELECT src_ip, src_port, dst_ip, dst_port, protocol, packet_count, byte_count FROM cn""")
def _(s):
    flow = F.struct(F.col("packet_count").alias("pkts_toserver"), F.lit(0).alias("pkts_toclient"), F.col("byte_count").alias("bytes_toserver"))
    app = F.when(F.col("protocol") == "ethernet_ip", "enip").when(F.col("protocol") == "https", "tls").otherwise(F.col("protocol"))
    body = F.to_json(F.struct(F.lit("flow").alias("event_type"), "src_ip", "src_port", F.col("dst_ip").alias("dest_ip"), F.col("dst_port").alias("dest_port"),
                              app.alias("app_proto"), flow.alias("flow")))
    conns, _ = L.read_suricata_eve(s.spark, _text(s.connections.select(body), _folder(s, "eve")))
    return conns.select("src_ip", "src_port", "dst_ip", "dst_port", "protocol", "packet_count", "byte_count")


@on_site("s2_suricata_alerts", """SELECT epoch_us(ts) AS at_us, src_ip, src_port, dst_ip, dst_port, seq AS signature_id, 'error on ' || protocol AS signature, 'anomaly' AS category, CAST(seq % 3 + 1 AS INT) AS severity FROM pk WHERE et = 'error'""")
def _(s):
    time = F.date_format(F.to_utc_timestamp("timestamp", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+0000'")
    alert = F.struct("signature_id", "signature", "category", "severity")
    body = F.to_json(F.struct(F.lit("alert").alias("event_type"), time.alias("timestamp"), "src_ip", "src_port",
                              F.col("dst_ip").alias("dest_ip"), F.col("dst_port").alias("dest_port"), alert.alias("alert")))
    _, found = L.read_suricata_eve(s.spark, _text(alerts(s).select(body), _folder(s, "eve")))
    return found.select(F.unix_micros("timestamp").alias("at_us"), "src_ip", "src_port", "dst_ip", "dst_port", "signature_id", "signature", "category", "severity")


_WAZUH = """SELECT seq AS signature_id, src_ip, dst_ip, dst_port, CASE seq % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS severity FROM pk WHERE et = 'error'"""


def _wazuh_line():
    level = F.when(F.col("signature_id") % 3 == 0, 5).when(F.col("signature_id") % 3 == 1, 7).otherwise(12)
    body = F.to_json(F.struct(
        F.struct(level.alias("level"), F.col("signature").alias("description"), F.col("signature_id").cast("string").alias("id")).alias("rule"),
        F.struct(F.col("src_ip").alias("ip")).alias("agent"), F.struct(F.col("dst_ip").alias("dstip"), F.col("dst_port").cast("string").alias("dstport")).alias("data")))
    return body


@on_site("s3_read_wazuh", _WAZUH)
def _(s):
    return L.read_wazuh(s.spark, _text(alerts(s).select(_wazuh_line()), _folder(s, "wazuh"))).select("signature_id", "src_ip", "dst_ip", "dst_port", "severity")


@on_site("s3_read_wazuh_array", _WAZUH)
def _(s):
    path = _framed(alerts(s).select(F.concat(F.lit(","), _wazuh_line())), '[{"rule": null}', "]", _folder(s, "wazuh"))
    return L.read_wazuh(s.spark, path, multiline=True).select("signature_id", "src_ip", "dst_ip", "dst_port", "severity")


_PORTS = "SELECT dst_ip AS ip_address, count(DISTINCT dst_port) AS ports, string_agg(DISTINCT protocol, ',' ORDER BY protocol) AS protocols FROM {} GROUP BY dst_ip"
_BYPORT = """(SELECT dst_ip, dst_port, CASE WHEN dst_port >= 49152 THEN 'unknown' ELSE protocol END AS protocol FROM cn)"""


@on_site("s4_read_nmap", _PORTS.format(_BYPORT))
def _(s):
    per_host = s.connections.select("dst_ip", "dst_port").distinct().groupBy("dst_ip").agg(F.concat_ws("", F.collect_list(F.format_string(
        '<port protocol="tcp" portid="%d"><state state="open"/></port>', "dst_port"))).alias("ports"))
    line = F.format_string('<host><address addr="%s" addrtype="ipv4"/><ports>%s<port protocol="tcp" portid="1"><state state="closed"/></port></ports></host>', "dst_ip", "ports")
    rows = I.read_nmap(s.spark, _framed(per_host.select(line), "<nmaprun>", "</nmaprun>", _folder(s, "nmap")))
    return rows.select("ip_address", F.size("open_ports").cast("bigint").alias("ports"), joined("protocols").alias("protocols"))


@on_site("s5_read_masscan", _PORTS.format(_BYPORT))
def _(s):
    body = F.to_json(F.struct(F.col("dst_ip").alias("ip"), F.array(F.struct(F.col("dst_port").alias("port"), F.lit("tcp").alias("proto"))).alias("ports")))
    rows = I.read_masscan(s.spark, _text(s.connections.select(body), _folder(s, "masscan")), multiline=False)
    return rows.select("ip_address", F.size("open_ports").cast("bigint").alias("ports"), joined("protocols").alias("protocols"))


@on_site("s5_read_masscan_array", _PORTS.format(_BYPORT))
def _(s):
    body = F.to_json(F.struct(F.col("dst_ip").alias("ip"), F.array(F.struct(F.col("dst_port").alias("port"), F.lit("tcp").alias("proto"))).alias("ports")))
    path = _framed(s.connections.select(F.concat(F.lit(","), body)), '[{"finished": 1}', "]", _folder(s, "masscan"))
    rows = I.read_masscan(s.spark, path)
    return rows.select("ip_address", F.size("open_ports").cast("bigint").alias("ports"), joined("protocols").alias("protocols"))


@on_site("s6_read_sinema_csv", "SELECT ip AS ip_address, mac AS mac_address, 'dev ' || ip AS hostname, 'Siemens' AS vendor, 'plc' AS device_type, 's7comm' AS protocols FROM ab")
def _(s):
    rows = s.base.select(F.concat(F.lit("dev "), "ip_address").alias("Device Name"), F.col("ip_address").alias("IP Address"), F.col("mac_address").alias("MAC Address"),
                         F.lit("CPU 1516 S7-1500").alias("Type"))
    path = _folder(s, "sinema")
    rows.write.option("header", True).csv(path)
    return I.read_sinema_csv(s.spark, path).select("ip_address", "mac_address", "hostname", "vendor", "device_type", joined("protocols").alias("protocols"))


@on_site("s7_read_tia_xml", "SELECT ip AS ip_address, 'node ' || ip AS hostname, 'Siemens' AS vendor, 'network_switch' AS device_type FROM ab")
def _(s):
    line = F.format_string('<Device Name="node %s"><Address>%s</Address><TypeIdentifier>SCALANCE XC208</TypeIdentifier></Device>', "ip_address", "ip_address")
    return I.read_tia_xml(s.spark, _framed(s.base.select(line), "<Project>", "</Project>", _folder(s, "tia"))).select("ip_address", "hostname", "vendor", "device_type")


@on_site("s8_read_device_inventory", """SELECT 'sw' || right(mac, 1) AS switch, 'port0' AS port, string_agg(DISTINCT mac, ',' ORDER BY mac) AS macs, string_agg(DISTINCT ip, ',' ORDER BY ip) AS ips FROM ab GROUP BY 1""")
def _(s):
    rows = s.base.select(F.concat(F.lit("sw"), F.substring("mac_address", -1, 1)).alias("hostname"), "ip_address", F.upper("mac_address").alias("mac_address"))
    path = _folder(s, "devices")
    rows.write.option("header", True).csv(path)
    return I.read_device_inventory(s.spark, path).select("switch", "port", joined("mac_addresses").alias("macs"), joined("ip_addresses").alias("ips"))


def _device_list(s):
    return s.base.select(F.concat(F.lit("sw"), F.substring("mac_address", -1, 1)).alias("hostname"), "ip_address", F.upper("mac_address").alias("mac_address"),
                         F.when(F.col("mac_address").endswith("1"), "Gi1/0/1").alias("port"), F.lit(7).alias("vlan"))


_DEVICE_ROWS = """SELECT 'sw' || right(mac, 1) AS switch, CASE WHEN right(mac, 1) = '1' THEN 'Gi1/0/1' ELSE 'port0' END AS port, mac AS mac_address,
    ip AS ip_address, 7 AS vlan, CAST(NULL AS VARCHAR) AS description FROM ab"""


@on_site("s8_read_device_rows", _DEVICE_ROWS)
def _(s):
    path = _folder(s, "devices")
    _device_list(s).write.option("header", True).csv(path)
    return I.read_device_rows(s.spark, path)


@on_site("s8_read_device_rows_json", _DEVICE_ROWS)
def _(s):
    path = _framed(_device_list(s).select(F.concat(F.lit(","), F.to_json(F.struct("*")))), '[{"port": "none", "hostname": null}', "]", _folder(s, "devices"))
    return I.read_device_rows(s.spark, path, "json", multiline=True).filter("ip_address IS NOT NULL")


def _spelled(mac: str, vendor: str):
    """A MAC address as the listings of a vendor write it."""
    digits = F.replace(mac, F.lit(":"), F.lit(""))
    if vendor == "cisco":
        return F.concat_ws(".", *[F.substring(digits, 4 * i + 1, 4) for i in range(3)])
    return F.concat_ws("-", F.substring(digits, 1, 6), F.substring(digits, 7, 6)) if vendor == "aruba" else F.col(mac)


_TAIL = "CAST(CAST('0x' || right(mac, 2) AS INT) AS INT)"
# --- fixed values: how switches print their tables ---
_MAC_LISTINGS = {  # title, line of a device, its columns, port in SQL
    "cisco": ("Vlan    Mac Address       Type        Ports", " %2$d    %1$s    DYNAMIC     Gi1/0/%2$d", f"'Gi1/0/' || {_TAIL}"),
    "juniper": ("  VLAN              MAC                 Type         Age Interfaces", "  v%2$d   %1$s   Learn          0 ge-0/0/%2$d.0", f"'ge-0/0/' || {_TAIL}"),
    "aruba": (" MAC Address    Port  VLAN   Type", " %1$s  A%2$d     %2$d    Dynamic", f"'A' || {_TAIL}"),
}
_ARP_LISTINGS = {
    "cisco": ("Protocol  Address          Age (min)  Hardware Addr   Type   Interface", "Internet  %3$s   5   %1$s  ARPA   Vlan%2$d", f"'Vlan' || {_TAIL}"),
    "juniper": ("MAC Address       Address         Name                      Interface           Flags", "%1$s %3$s    host-%2$d        ge-0/0/%2$d.0          none", f"'ge-0/0/' || {_TAIL}"),
    "aruba": (" IP Address     MAC Address       Type     Age(min)  Port", " %3$s    %1$s     dynamic  15        A%2$d", f"'A' || {_TAIL}"),
}


def _listed(s, vendor: str, title: str, form: str) -> str:
    """The devices as listings of a vendor, with rulers, notes and an entry without an address between them."""
    tail = F.conv(F.substring("mac_address", -2, 2), 16, 10).cast("int")
    line = F.format_string(form, _spelled("mac_address", vendor), tail, F.col("ip_address"))
    noise = s.spark.range(3).select(F.element_at(F.array(*[F.lit(x) for x in ("----    -----------", "Total Mac Addresses for this criterion: 5", "")]), (F.col("id") + 1).cast("int")))
    return _framed(s.base.select(line).union(noise), title, None, _folder(s, "listing"))


def _listing_queries(vendor: str, suffix: str) -> None:
    title, form, port = _MAC_LISTINGS[vendor]
    vlan = "1" if vendor == "juniper" else _TAIL
    kind = "learn" if vendor == "juniper" else "dynamic"

    @on_site(f"s9_read_mac_table{suffix}", f"SELECT mac AS mac_address, {vlan} AS vlan, {port} AS port, '{kind}' AS entry_type FROM ab")
    def _(s):
        return I.read_mac_table(s.spark, _listed(s, vendor, title, form), vendor)

    head, line, place = _ARP_LISTINGS[vendor]
    number = _TAIL if vendor == "cisco" else "CAST(NULL AS INT)"

    @on_site(f"s9_read_arp_table{suffix}", f"SELECT mac AS mac_address, ip AS ip_address, {place} AS interface, {number} AS vlan FROM ab")
    def _(s):
        return I.read_arp_table(s.spark, _listed(s, vendor, head, line), vendor)


for _vendor, _suffix in (("cisco", ""), ("juniper", "_juniper"), ("aruba", "_aruba")):
    _listing_queries(_vendor, _suffix)


@on_site("s10_read_oui", "SELECT DISTINCT substr(mac, 1, 8) AS prefix, 'Vendor ' || substr(mac, 7, 2) AS vendor FROM ab")
def _(s):
    line = F.concat(F.upper(F.substring("mac_address", 1, 8)), F.lit("\tVendor "), F.substring("mac_address", 7, 2))
    return I.read_oui(s.spark, _text(s.base.select(line).distinct(), _folder(s, "oui")))


_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'"


def _csv_back(s, path: str):
    """A written file as text: columns named in lower case, empty fields as empty text."""
    rows = s.spark.read.option("header", True).option("escape", '"').csv(path)
    return rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.lower().replace(" ", "_")) for c in rows.columns])


@on_site("s11_write_connections_csv", f"""SELECT src_ip AS source_ip, CAST(src_port AS VARCHAR) AS source_port, dst_ip AS destination_ip, CAST(dst_port AS VARCHAR) AS destination_port, protocol, transport,
    CAST(packet_count AS VARCHAR) AS packet_count, CAST(byte_count AS VARCHAR) AS byte_count, {_ISO.format('first_seen')} AS first_seen, {_ISO.format('last_seen')} AS last_seen FROM cn""")
def _(s):
    path = _folder(s, "csv")
    K.write_connections_csv(s.connections, path)
    return _csv_back(s, path)


_SURE = f"CASE WHEN vendor IS NOT NULL THEN 3 WHEN len(list_filter(protocols, lambda p: p <> 'unknown')) > 0 THEN 1 ELSE 0 END"


@on_site("s11_write_assets_csv", f"""SELECT ip AS ip_address, coalesce(mac, '') AS mac_address, '' AS hostname, device_type, coalesce(vendor, '') AS vendor, '' AS product_family,
    array_to_string(protocols, '; ') AS protocols, CAST({_SURE} AS VARCHAR) AS confidence, '' AS purdue_level, coalesce(vendor, '') AS oui_vendor, '' AS country,
    CASE WHEN is_public THEN 'true' ELSE 'false' END AS public_ip, {_ISO.format('first_seen')} AS first_seen, {_ISO.format('last_seen')} AS last_seen,
    CAST(packet_count AS VARCHAR) AS packet_count, '' AS tags, '' AS notes FROM ass""")
def _(s):
    path = _folder(s, "csv")
    K.write_assets_csv(s.assets, path)
    return _csv_back(s, path)


@on_site("s12_write_assets_json", f"""SELECT ip AS ip_address, mac AS mac_address, device_type, vendor, vendor AS oui_vendor, CAST({_SURE} AS INT) AS confidence, is_public AS is_public_ip,
    array_to_string(protocols, ',') AS protocols, packet_count FROM ass""")
def _(s):
    path = _folder(s, "json")
    K.write_assets_json(s.assets, path)
    kinds = "ip_address string, mac_address string, device_type string, vendor string, oui_vendor string, confidence int, is_public_ip boolean, protocols array<string>, packet_count bigint"
    return s.spark.read.schema(kinds).json(path).withColumn("protocols", F.array_join("protocols", ","))


@on_site("s12_write_topology_json", f"""SELECT 'asset' AS section, ip AS a, device_type AS b, '' AS c, '' AS d, '' AS protocol, packet_count, CAST(NULL AS BIGINT) AS byte_count FROM ass
    UNION ALL SELECT 'connection', src_ip, CAST(src_port AS VARCHAR), dst_ip, CAST(dst_port AS VARCHAR), protocol, packet_count, byte_count FROM cn
    UNION ALL SELECT 'protocol_stat', '', '', '', '', protocol, count(*), CAST(sum(length) AS BIGINT) FROM pk GROUP BY protocol""")
def _(s):
    path = _folder(s, "topology")
    K.write_topology_json(s.assets, s.connections, traffic.protocol_stats(s.connections), path)
    rows = s.spark.read.text(path)
    field = lambda *names: F.coalesce(*[F.get_json_object("value", f"$.{n}") for n in names], F.lit(""))
    number = lambda name: F.get_json_object("value", f"$.{name}").cast("bigint").alias(name)
    protocol = F.when(F.col("section") == "asset", "").otherwise(field("protocol"))
    return rows.select(
        "section", field("ip_address", "src_ip").alias("a"), field("device_type", "src_port").alias("b"), field("dst_ip").alias("c"), field("dst_port").alias("d"),
        protocol.alias("protocol"), number("packet_count"), number("byte_count"),
    )


@on_site("s13_sessions", "SELECT 's1' AS session_id, (SELECT count(*) FROM ab) AS asset_count, (SELECT count(*) FROM cn) AS connection_count")
def _(s):
    path = _folder(s, "sessions")
    K.save_session(s.assets, s.connections, "s1", path)
    return K.list_sessions(s.spark, path)


@on_site("s13_load_session", "SELECT ip AS ip_address, device_type FROM ass")
def _(s):
    path = _folder(s, "sessions")
    K.save_session(s.assets, s.connections, "s1", path)
    return K.load_session(s.spark, path, "s1")[0].select("ip_address", "device_type")


@on_site("s13_project_rollup", "SELECT n_nationkey AS project_id, coalesce(n, 0) AS session_count FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def _(s):
    projects = s.spark.read.parquet(f"{s.sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("updated_at"))
    sessions = s.spark.read.parquet(f"{s.sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("project_id"))
    return K.project_rollup(projects, sessions).select("project_id", "session_count")


@on_site("s14_packet_source", "SELECT seq, src_ip, dst_ip, length FROM pk")
def _(s):
    return L.packet_source(s.spark, binding.packets_path(s.spark, s.sf_dir, s.variant, s.where)).select("seq", "src_ip", "dst_ip", "length")


@on_site("x1_sbom", f"""SELECT ip AS ip_address, coalesce(mac, '') AS mac_address, '' AS hostname, coalesce(vendor, '') AS vendor, '' AS product, '' AS firmware_version,
    array_to_string(protocols, '; ') AS protocols, CASE level WHEN 1 THEN 'L1 - Basic Control' WHEN 2 THEN 'L2 - Area Supervisory' WHEN 3 THEN 'L3 - Site Operations' ELSE 'L4 - Enterprise' END AS purdue_zone,
    device_type, CAST({_SURE} AS INT) AS confidence, {_ISO.format('first_seen')} AS first_seen, {_ISO.format('last_seen')} AS last_seen, '' AS country, '' AS tags FROM ass JOIN lv USING (ip, device_type)""")
def _(s):
    return K.sbom(s.leveled).withColumn("confidence", F.col("confidence").cast("int"))


_A, _M, _I = "'ipv4-addr--' || sha256({0})", "'mac-addr--' || sha256({0})", "'infrastructure--' || sha256({0})"


def _link(name: str, a: str, b: str, source: str) -> str:
    return f"SELECT 'relationship', 'relationship--' || sha256({a} || '|{name}|' || {b}), {a}, {b}, '{name}' FROM {source}"


@on_site("x2_stix_objects", f"""SELECT DISTINCT 'ipv4-addr' AS type, {_A.format('ip')} AS id, CAST(NULL AS VARCHAR) AS source_ref, CAST(NULL AS VARCHAR) AS target_ref, ip AS name FROM ass
    UNION ALL SELECT DISTINCT 'mac-addr', {_M.format('mac')}, NULL, NULL, mac FROM ass UNION ALL SELECT 'infrastructure', {_I.format('ip')}, NULL, NULL, ip FROM ass
    UNION ALL {_link('resolves-to', _A.format('ip'), _M.format('mac'), 'ass')} UNION ALL {_link('consists-of', _I.format('ip'), _A.format('ip'), 'ass')}
    UNION ALL SELECT 'network-traffic', 'network-traffic--' || sha256(concat_ws('|', src_ip, src_port, dst_ip, dst_port, protocol)), {_A.format('src_ip')}, {_A.format('dst_ip')}, CAST(packet_count AS VARCHAR) FROM cn
    UNION ALL SELECT 'indicator', 'indicator--' || sha256(concat_ws('|', finding_type, technique_id, title, affected)), NULL, NULL, title FROM ({SQL['f35_purdue_violations']})""")
def _(s):
    rows = K.stix_objects(s.assets, s.connections, s.violations, "2024-02-01T00:00:00Z")
    return rows.select("type", "id", "source_ref", "target_ref", F.coalesce(*[F.get_json_object("body", f"$.{n}") for n in ("name", "value", "relationship_type", "x_packet_count")]).alias("name"))


def _stream(s):
    return L.packet_source(s.spark, binding.packets_path(s.spark, s.sf_dir, s.variant, s.where), streaming=True)


@on_site("l1_live_connections", f"SELECT {KEY}, packet_count, byte_count FROM cn")
def _(s):
    updates = V.run_available(V.live_connections(_stream(s)), "update")
    return V.connection_totals(updates).select(*KEY.split(", "), "packet_count", "byte_count")


_ALERT_PORTS = " ".join(f"WHEN port IN ({', '.join(map(str, ports))}) THEN {{'t': '{code}', 'n': '{title}', 's': '{severity}'}}" for ports, code, title, severity in C.LIVE_ALERT_PORTS)


@on_site("l2_live_alerts", f"""WITH ot AS (SELECT ip FROM ass WHERE device_type IN ('plc', 'rtu', 'hmi', 'scada_server', 'historian')),
    near AS (SELECT *, CASE {_ALERT_PORTS} END AS a FROM (SELECT *, CASE WHEN dst_ip IN (SELECT ip FROM ot) THEN dst_ip ELSE src_ip END AS ot_ip,
        CASE WHEN dst_ip IN (SELECT ip FROM ot) THEN dst_port ELSE src_port END AS port FROM pk) WHERE ot_ip IN (SELECT ip FROM ot))
    SELECT {KEY}, ot_ip, a.t AS technique_id, a.n AS title, a.s AS severity, epoch_us(min(ts)) AS first_us FROM near WHERE a IS NOT NULL GROUP BY ALL""")
def _(s):
    ot = s.assets.filter(F.col("device_type").isin("plc", "rtu", "hmi", "scada_server", "historian")).select("ip_address")
    return V.live_alerts(_stream(s), ot).select(*KEY.split(", "), "ot_ip", "technique_id", "title", "severity", F.unix_micros("ts").alias("first_us"))


@on_site("l3_live_stats", """WITH t AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS h FROM pk),
    e AS (SELECT h, src_ip AS ip FROM t UNION SELECT h, dst_ip FROM t)
    SELECT epoch_us(h) AS interval_us, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, round(count(*) / 3600.0, 6) AS packets_per_sec,
    count(DISTINCT (src_ip, src_port, dst_ip, dst_port, protocol)) AS active_connections, (SELECT count(*) FROM e WHERE e.h = t.h) AS assets
    FROM t GROUP BY h HAVING h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM pk) - INTERVAL 10 MINUTE""")
def _(s):
    rows = V.run_available(V.live_stats(_stream(s), "1 hour"), "append")
    return rows.select(F.unix_micros("interval_start").alias("interval_us"), "packets", "bytes", F.round("packets_per_sec", 6).alias("packets_per_sec"), "active_connections", "assets")
