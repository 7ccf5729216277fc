"""Queries over topology and security findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import analysis as A
from ..operators import attack_rules as R
from ..operators import findings as N
from ..operators import topology as G
from ..operators import traffic
from ..operators.full_run import run_in_few_passes
from ..operators.patterns import device_first_last_seen
from .catalog_traffic import lldp_rows, packets_with_props, redundancy_rows
from .registry import SITES, SQL, at_site, joined, on_site, query, shown_findings, sql_finding, sql_joined
from .site import SQL_SETS, LabelledSite, Site, shared

_OTP, _OTT, _ICS = SQL_SETS["OTP"], SQL_SETS["OTT"], SQL_SETS["ICS"]

# --- topology ---------------------------------------------------------------------------

_PREFIX = "(split_part({0}, '.', 1) || '.' || split_part({0}, '.', 2) || '.' || split_part({0}, '.', 3))"


def _p24(column: str) -> str:
    return _PREFIX.format(column)


@on_site("g1_topo_nodes", f"SELECT ip AS ip_address, mac AS mac_address, {sql_joined('protocols')} AS protocols, packet_count, {_p24('ip')} || '.0/24' AS subnet FROM abw", "wide")
def _(s):
    return G.topo_nodes(s.packets).select("ip_address", "mac_address", joined("protocols").alias("protocols"), "packet_count", "subnet")


_EDGES = """SELECT e.src_ip, e.dst_ip, e.protocol, e.packet_count, e.byte_count, r.src_ip IS NOT NULL AS bidirectional FROM (
    SELECT src_ip, dst_ip, protocol, count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS byte_count FROM pkw GROUP BY 1, 2, 3) e
    LEFT JOIN (SELECT DISTINCT src_ip, dst_ip, protocol FROM pkw) r ON r.src_ip = e.dst_ip AND r.dst_ip = e.src_ip AND r.protocol = e.protocol"""


@on_site("g2_topo_edges", _EDGES, "wide")
def _(s):
    return G.topo_edges(s.packets)


_CAP_NODES = "SELECT ip AS ip_address, packet_count FROM abw ORDER BY packet_count DESC, ip LIMIT 60"


@on_site("g3_cap_topology_nodes", _CAP_NODES, "wide")
def _(s):
    return G.cap_topology(G.topo_nodes(s.packets), G.topo_edges(s.packets), n=60, e=1000)[0].select("ip_address", "packet_count")


@on_site("g3_cap_topology_edges", f"""SELECT src_ip, dst_ip, protocol, packet_count FROM ({_EDGES}) WHERE src_ip IN (SELECT ip_address FROM ({_CAP_NODES}))
    AND dst_ip IN (SELECT ip_address FROM ({_CAP_NODES})) ORDER BY packet_count DESC, src_ip, dst_ip, protocol LIMIT 400""", "wide")
def _(s):
    return G.cap_topology(G.topo_nodes(s.packets), G.topo_edges(s.packets), n=60, e=400)[1].select("src_ip", "dst_ip", "protocol", "packet_count")


@on_site("g3_whole_topology", f"SELECT src_ip, dst_ip, protocol, packet_count FROM ({_EDGES})", "wide")
def _(s):
    return G.cap_topology(G.topo_nodes(s.packets), G.topo_edges(s.packets))[1].select("src_ip", "dst_ip", "protocol", "packet_count")


# The short-lived guests reach only a few hosts, which keeps one hop smaller than two.
_HOPS = """WITH adj AS (SELECT src_ip AS a, dst_ip AS b FROM cnw UNION SELECT dst_ip, src_ip FROM cnw),
    h1 AS (SELECT b AS ip FROM adj WHERE a = '10.66.0.1' UNION SELECT '10.66.0.1'),
    h2 AS (SELECT b AS ip FROM adj WHERE a IN (SELECT ip FROM h1) UNION SELECT ip FROM h1)"""


@on_site("g4_neighbor_subgraph_nodes", f"{_HOPS} SELECT ip AS ip_address FROM h2", "wide")
def _(s):
    return G.neighbor_subgraph(G.topo_nodes(s.packets), G.topo_edges(s.packets), "10.66.0.1", 2)[0].select("ip_address")


@on_site("g4_neighbor_subgraph_edges", f"""{_HOPS} SELECT src_ip, dst_ip, protocol, packet_count FROM ({_EDGES}) WHERE src_ip IN (SELECT ip FROM h1)
    AND dst_ip IN (SELECT ip FROM h1)""", "wide")
def _(s):
    return G.neighbor_subgraph(G.topo_nodes(s.packets), G.topo_edges(s.packets), "10.66.0.1", 1)[1].select(
        "src_ip", "dst_ip", "protocol", "packet_count"
    )


@on_site("g5_hide_nodes", f"SELECT src_ip, dst_ip, protocol, packet_count FROM ({_EDGES}) WHERE src_ip NOT LIKE '203.0.113.%' AND dst_ip NOT LIKE '203.0.113.%'", "wide")
def _(s):
    nodes = G.topo_nodes(s.packets)
    hidden = nodes.filter(traffic.is_public_ip(F.col("ip_address"))).select("ip_address")
    return G.hide_nodes(nodes, G.topo_edges(s.packets), hidden)[1].select("src_ip", "dst_ip", "protocol", "packet_count")


_GROUPS = " UNION ALL ".join(
    f"SELECT '{mode}' AS mode, 'group:' || {key} AS group_id, count(*) AS node_count, CAST(sum(packet_count) AS BIGINT) AS packet_count FROM assw GROUP BY 2"
    for mode, key in (
        ("subnet", f"{_p24('ip')} || '.0/24'"),
        ("protocol", f"coalesce(list_filter(protocols, lambda p: p IN {SQL_SETS['OT']})[1], protocols[1])"),
        ("device_role", "device_type"), ("vendor", "coalesce(vendor, 'Unknown')"),
    )
)


@on_site("g6_group_nodes", _GROUPS, "wide")
def _(s):
    nodes = s.assets.withColumn("subnet", G.X.subnet24(F.col("ip_address")))
    parts = [G.group_nodes(nodes, m).select(F.lit(m).alias("mode"), "group_id", "node_count", "packet_count")
             for m in ("subnet", "protocol", "device_role", "vendor")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@on_site("g7_mesh_edges", f"SELECT src_ip, dst_ip, protocol, packet_count FROM ({_EDGES}) WHERE protocol = 'modbus' AND packet_count >= 2", "wide")
def _(s):
    return G.mesh_edges(G.topo_nodes(s.packets), G.topo_edges(s.packets), "modbus", 2)[1].select("src_ip", "dst_ip", "protocol", "packet_count")


@on_site("g7_mesh_nodes", f"""SELECT ip AS ip_address FROM abw WHERE ip IN (SELECT src_ip FROM ({_EDGES}) WHERE protocol = 'modbus' AND packet_count >= 2
    UNION SELECT dst_ip FROM ({_EDGES}) WHERE protocol = 'modbus' AND packet_count >= 2)""", "wide")
def _(s):
    return G.mesh_edges(G.topo_nodes(s.packets), G.topo_edges(s.packets), "modbus", 2)[0].select("ip_address")


@on_site("g8_edge_weight", f"""SELECT src_ip, dst_ip, protocol, round(CASE WHEN packet_count <= 1 THEN 1.0 ELSE 1.0 + least(log2(packet_count) / 20.0, 1.0) * 7.0 END, 6)
    AS weight FROM ({_EDGES})""", "wide")
def _(s):
    return G.topo_edges(s.packets).select("src_ip", "dst_ip", "protocol", F.round(G.edge_weight(F.col("packet_count")), 6).alias("weight"))


@on_site("g9_purdue_band", "SELECT ip AS ip_address, CASE level WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 3 ELSE 1 END AS band FROM lv")
def _(s):
    return s.levels.select("ip_address", G.purdue_band(F.col("level")).alias("band"))


_CROSS = f"""SELECT src_ip AS ip, {_p24('dst_ip')} AS remote FROM cnw WHERE {_p24('src_ip')} <> {_p24('dst_ip')}
    UNION SELECT dst_ip, {_p24('src_ip')} FROM cnw WHERE {_p24('src_ip')} <> {_p24('dst_ip')}"""
_SUBNETS = f"""SELECT network || '.0/24' AS network, {sql_joined('list(ip)')} AS member_ips, count(*) AS members,
    coalesce(first(ip ORDER BY pri, ip) FILTER (WHERE pri IS NOT NULL), '') AS gateway_ip FROM (
    SELECT ip, {_p24('ip')} AS network, CASE WHEN ip LIKE '%.1' AND x THEN 1 WHEN ip LIKE '%.254' AND x THEN 2 WHEN ip LIKE '%.1' THEN 3
    WHEN ip LIKE '%.254' THEN 4 WHEN x THEN 5 END AS pri FROM (SELECT ip, ip IN (SELECT ip FROM ({_CROSS})) AS x FROM abw)) GROUP BY network"""


@on_site("g10_infer_subnets", _SUBNETS, "wide")
def _(s):
    return G.infer_subnets(s.connections, s.base).select(
        "network", joined("member_ips").alias("member_ips"), F.size("member_ips").cast("bigint").alias("members"),
        F.coalesce("gateway_ip", F.lit("")).alias("gateway_ip"),
    )


@on_site("g11_detect_gateways", f"""SELECT ip AS ip_address, n AS subnet_count, CASE WHEN g AND n >= 2 THEN 3 WHEN g OR n >= 2 THEN 2 ELSE 1 END AS confidence
    FROM (SELECT ip, count(*) AS n, ip LIKE '%.1' OR ip LIKE '%.254' AS g FROM ({_CROSS}) GROUP BY ip)""", "wide")
def _(s):
    return G.detect_gateways(s.connections, s.assets).select("ip_address", "subnet_count", "confidence")


@on_site("g11_gateway_subnets", f"SELECT ip AS ip_address, remote || '.0/24' AS subnet FROM ({_CROSS})", "wide")
def _(s):
    return G.gateway_subnets(s.connections)


@on_site("g12_switch_candidates", f"""SELECT ip AS ip_address, n AS peers, CASE WHEN n > 10 THEN 2 ELSE 1 END AS confidence FROM (
    SELECT ip, count(*) AS n FROM (SELECT src_ip AS ip, dst_ip AS peer FROM cnf WHERE {_p24('src_ip')} = {_p24('dst_ip')}
    UNION SELECT dst_ip, src_ip FROM cnf WHERE {_p24('src_ip')} = {_p24('dst_ip')}) GROUP BY ip) WHERE n > 5""", "flat")
def _(s):
    return G.switch_candidates(s.connections, s.assets).select("ip_address", F.size("connected_ips").cast("bigint").alias("peers"), "confidence")


@on_site("g13_broadcast_domains", f"""SELECT 'bd-' || network AS id, network, members, CASE WHEN gateway_ip = '' THEN 'subnet' ELSE 'gateway' END AS inferred_from
    FROM ({_SUBNETS})""", "wide")
def _(s):
    return G.broadcast_domains(G.infer_subnets(s.connections, s.base)).select(
        "id", "network", F.size("member_ips").cast("bigint").alias("members"), "inferred_from"
    )


# Switch tables: each MAC is learnt on a port that follows from its text; half of the
# rows use the short port name.


def mac_table(s):
    m = s.base.filter("mac_address IS NOT NULL").select("mac_address").distinct()
    tail = F.conv(F.substring("mac_address", -2, 2), 16, 10).cast("int")
    port = tail % 24
    return m.select(
        F.concat(F.lit("sw"), (tail % 3).cast("string")).alias("switch"),
        F.concat(F.when(tail % 2 == 0, "GigabitEthernet1/0/").otherwise("Gi1/0/"), port.cast("string")).alias("port"),
        F.upper(F.replace("mac_address", F.lit(":"), F.lit("-"))).alias("mac_address"), (tail % 5).alias("vlan"),
    )


def port_table(s):
    return s.spark.range(0, 72).select(
        F.concat(F.lit("sw"), (F.col("id") % 3).cast("string")).alias("switch"),
        F.concat(F.lit("GigabitEthernet1/0/"), F.expr("CAST(id div 3 AS STRING)")).alias("port"),
        F.concat(F.lit("Gi1/0/"), F.expr("CAST(id div 3 AS STRING)")).alias("short_name"),
    )


_MACS = """mt AS (SELECT DISTINCT mac, CAST('0x' || right(mac, 2) AS INT) AS t FROM abw WHERE mac IS NOT NULL),
    pm AS (SELECT 'sw' || (t % 3) AS switch, 'GigabitEthernet1/0/' || (t % 24) AS port, mac AS mac_address, t % 5 AS vlan FROM mt)"""


@on_site("g14_apply_mac_table", f"WITH {_MACS} SELECT switch, port, mac_address, vlan FROM pm", "wide")
def _(s):
    return G.apply_mac_table(port_table(s), mac_table(s))


@on_site("g15_device_locations", f"WITH {_MACS} SELECT a.ip AS ip_address, p.mac_address, p.switch, p.port, p.vlan FROM abw a JOIN pm p ON p.mac_address = a.mac", "wide")
def _(s):
    arp = s.base.select("ip_address", F.upper("mac_address").alias("mac_address"))
    return G.device_locations(G.apply_mac_table(port_table(s), mac_table(s)), arp)


@on_site("g16_switch_links", f"WITH {_MACS} SELECT DISTINCT switch AS src_switch, port AS src_port, 'dev-' || right(mac_address, 2) AS dst_switch, 'uplink' AS dst_port FROM pm", "wide")
def _(s):
    neighbors = mac_table(s).select(
        "switch", "port", F.concat(F.lit("dev-"), F.lower(F.substring("mac_address", -2, 2))).alias("device_id"), F.lit("uplink").alias("remote_port")
    )
    return G.switch_links(port_table(s), neighbors)


# --- findings -----------------------------------------------------------------------------


#: What each rule's query finds, by name of the query.
RULE_FN = {}


def rule(name: str, fn, sql: str, variant: str = "base"):
    RULE_FN[name] = fn
    on_site(name, sql, variant)(lambda s: shown_findings(fn(s)))


def S(fn):
    return lambda s: fn(s.snapshot)


rule("f1_t0855_modbus_writes", S(R.t0855_modbus_writes), sql_finding(
    "'critical'", "'Modbus broadcast write from ' || ip", "T0855", "ip",
    f"m_writes || ' write commands, broadcast unit ids ' || {sql_joined('list_filter(m_units, lambda x: x IN (0, 255))')}",
    "dv WHERE m_role IN ('master','both') AND m_writes > 0 AND list_has_any(m_units, [0, 255])") + " UNION ALL " + sql_finding(
    "'high'", "'High fan-out Modbus writes from ' || ip", "T0855", "ip", "'writes to ' || n || ' slaves'",
    """(SELECT ip, count(*) AS n FROM mp WHERE remote_role = 'slave' AND ip IN (SELECT ip FROM dv WHERE m_role IN ('master','both') AND m_writes > 0)
    GROUP BY ip HAVING count(*) >= 5)"""))

rule("f2_t0814_modbus_diagnostics", S(R.t0814_modbus_diagnostics), sql_finding(
    "'high'", "'Modbus diagnostics (FC 8) from non-engineer: ' || ip", "T0814", "ip",
    "'type ' || device_type || ' sent ' || m_diag || ' diagnostic commands'", "dv JOIN ass USING (ip) WHERE m_diag > 0"))

rule("f3_t0856_dnp3_unsolicited", S(R.t0856_dnp3_unsolicited), sql_finding(
    "'medium'", "'DNP3 unsolicited response from ' || ip || ' to unknown master'", "T0856", "ip", "n || ' unknown masters'",
    """(SELECT ip, count(*) AS n FROM dp WHERE remote_role = 'master' AND ip IN (SELECT ip FROM dv WHERE d_unsol)
    AND remote_ip NOT IN (SELECT ip FROM dv WHERE d_role IN ('master','both')) GROUP BY ip)"""))

rule("f4_t0846_remote_discovery", S(R.t0846_remote_discovery), sql_finding(
    "'high'", "'Unknown device ' || ip || ' polling ' || n || ' PLCs/RTUs'", "T0846", "ip", "'reached OT ports of ' || n || ' hosts'",
    f"""(SELECT src_ip AS ip, count(DISTINCT dst_ip) AS n FROM cnw WHERE dst_port IN {_OTP} GROUP BY src_ip HAVING count(DISTINCT dst_ip) >= 3)
    JOIN assw USING (ip) WHERE device_type IN ('it_device','unknown')"""), "wide")


def _device_rules(*parts) -> str:
    return " UNION ALL ".join(sql_finding(f"'{sev}'", title, code, "ip", evidence, source) for sev, code, title, evidence, source in parts)


rule("f5_enip_rules", S(R.enip_rules), _device_rules(
    ("high", "T0855", "'CIP write to Assembly object from ' || ip", "ip || ' wrote to class 0x04'", "dv WHERE e_assembly"),
    ("critical", "T0836", "'CIP File class access from ' || ip", "ip || ' used class 0x37'", "dv WHERE e_file"),
    ("medium", "T0846", "'EtherNet/IP ListIdentity from non-OT device ' || ip", "ip || ' has type ' || device_type",
     "dv JOIN ass USING (ip) WHERE e_list AND device_type IN ('it_device','unknown')")))

rule("f6_s7_rules", S(R.s7_rules), _device_rules(*[
    (sev, code, f"'{title}' || ip", f"'function {fc}'", f"dv WHERE list_contains(s_funcs, '{fn}')") for sev, code, title, fc, fn in (
        ("critical", "T0843", "S7 program download from ", "0x1D", "download_start"), ("high", "T0845", "S7 program upload from ", "0x1A", "upload_start"),
        ("critical", "T0816", "S7 PLC Stop command from ", "0x29", "plc_stop"),
        ("critical", "T0809", "S7 PI Service (possible block delete) from ", "0x28", "pi_service"),
        ("high", "T0855", "S7 Write Var command from ", "0x05", "write_var"))]))

rule("f7_iec104_rules", S(R.iec104_rules), _device_rules(
    ("high", "T0855", "'IEC 104 control commands from ' || ip", "'command type ids seen'", "dv WHERE i_cmd"),
    ("critical", "T0816", "'IEC 104 Reset Process command from ' || ip", "'type id 105 seen'", "dv WHERE i_reset"),
    ("medium", "T0814", "'IEC 104 interrogation from non-OT device ' || ip", "ip || ' has type ' || device_type",
     "dv JOIN ass USING (ip) WHERE i_inter AND device_type IN ('it_device','unknown')")))

rule("f8_bacnet_rules", S(R.bacnet_rules), _device_rules(
    ("high", "T0855", "'BACnet WriteProperty to output object from ' || ip", "'analog or binary output written'", "dv WHERE b_out"),
    ("high", "T0856", "'BACnet alarm suppression from ' || ip", "'notification class written'", "dv WHERE b_notif"),
    ("high", "T0816", "'BACnet ReinitializeDevice from ' || ip", "'reinitialize requested'", "dv WHERE b_reinit"),
    ("high", "T0811", "'BACnet DeviceCommunicationControl from ' || ip", "'communication control requested'", "dv WHERE b_comm")))

rule("f9_flat_network", lambda s: R.flat_network(s.assets), sql_finding(
    "'high'", "'Flat network detected: ' || n || ' of ' || t || ' devices on ' || subnet", "T0886", "''", "'no segmentation inside ' || subnet",
    f"""(SELECT {_p24('ip')} || '.0/24' AS subnet, count(*) AS n, (SELECT count(*) FROM abf) AS t FROM abf GROUP BY 1)
    WHERE t >= 6 AND n > 5 AND n > 0.8 * t"""), "flat")

_CLEAR = "(502,20000,44818,102,47808,2404,34962,34963,34964,4840,1883,5094,18245,18246)"
rule("f10_cleartext_ot", lambda s: R.cleartext_ot(s.connections), sql_finding(
    "'high'", "'100% of OT traffic is unencrypted'", "", "''", "n || ' of ' || n || ' packets in clear; ' || breakdown",
    f"""(SELECT CAST(sum(n) AS BIGINT) AS n, string_agg(protocol || ': ' || n, ', ' ORDER BY protocol) AS breakdown FROM (
    SELECT protocol, CAST(sum(packet_count) AS BIGINT) AS n FROM cn WHERE dst_port IN {_CLEAR} GROUP BY protocol))"""))

_EXPOSED = "['modbus','dnp3','s7comm','ethernet_ip','bacnet','iec104','profinet','opc_ua']"
rule("f11_internet_exposed_ot", lambda s: R.internet_exposed_ot(s.assets), sql_finding(
    "'critical'", "'Internet-exposed OT device: ' || ip", "T0846", "ip",
    f"'public address speaks ' || {sql_joined(f'list_intersect(protocols, {_EXPOSED})')}", f"assw WHERE is_public AND list_has_any(protocols, {_EXPOSED})"), "wide")

_REMOTE = "(22, 23, 3389, 5900, 5901, 5902, 5903, 5904, 5905, 5906, 5907, 5908, 5909, 5910, 5938, 7070)"
_SERVICE = "CASE dst_port WHEN 22 THEN 'SSH' WHEN 23 THEN 'Telnet' WHEN 3389 THEN 'RDP' ELSE 'remote access' END"
rule("f12_t0822_external_remote", S(R.t0822_external_remote), sql_finding(
    "'high'", f"'OT device ' || src_ip || ' accessing ' || {_SERVICE} || ' (port ' || dst_port || ')'", "T0822", "src_ip || ',' || dst_ip",
    "'to ' || dst_ip || ', ' || n || ' packets'",
    f"""(SELECT src_ip, dst_ip, dst_port, CAST(sum(packet_count) AS BIGINT) AS n FROM cn WHERE dst_port IN {_REMOTE} AND src_ip IN (SELECT ip FROM oti)
    GROUP BY 1, 2, 3)"""))

rule("f13_t0867_lateral_transfer", S(R.t0867_lateral_transfer), sql_finding(
    "'high'", "'FTP file transfer involving OT device: ' || src_ip || ' to ' || dst_ip", "T0867", "src_ip || ',' || dst_ip",
    "'port 21, ' || n || ' packets'",
    """(SELECT src_ip, dst_ip, CAST(sum(packet_count) AS BIGINT) AS n FROM cn WHERE dst_port = 21 AND (src_ip IN (SELECT ip FROM oti)
    OR dst_ip IN (SELECT ip FROM oti)) GROUP BY 1, 2)"""))


def tagged(s):
    """Connections whose protocol label came from a sensor, right or wrong."""
    odd = F.when((F.col("dst_port") == 9999), "modbus").when((F.col("dst_port") == 502) & (F.col("src_port") == 49153), "http").otherwise(F.col("protocol"))
    return s.connections.withColumn("protocol", odd)


_TAGGED = """(SELECT * REPLACE (CASE WHEN dst_port = 9999 THEN 'modbus' WHEN dst_port = 502 AND src_port = 49153 THEN 'http' ELSE protocol END AS protocol) FROM cn)"""
rule("f14_t0885_uncommon_port", lambda s: R.t0885_uncommon_port(tagged(s)), sql_finding(
    "'medium'", "'modbus on non-standard port 9999 (' || src_ip || ' to ' || d || ')'", "T0885", "src_ip || ',' || d", "n || ' packets'",
    f"(SELECT src_ip, min(dst_ip) AS d, CAST(sum(packet_count) AS BIGINT) AS n FROM {_TAGGED} WHERE protocol = 'modbus' AND dst_port <> 502 AND src_port <> 502 GROUP BY src_ip)"))

rule("f15_t0849_masquerading", lambda s: R.t0849_masquerading(tagged(s)), sql_finding(
    "'medium'", "'http traffic masquerading on OT port 502 (' || src_ip || ' to ' || d || ')'", "T0849", "src_ip || ',' || d", "'expected modbus'",
    f"(SELECT src_ip, min(dst_ip) AS d FROM {_TAGGED} WHERE protocol = 'http' AND dst_port = 502 GROUP BY src_ip)"))

rule("f16_t0868_operating_mode", S(R.t0868_operating_mode), sql_finding(
    "'high'", "'S7 program upload/download from ' || ip", "T0868", "ip",
    f"'functions ' || {sql_joined(chr(39).join(['list_intersect(s_funcs, [', 'upload', ',', 'upload_start', '])']))}",
    "dv WHERE list_has_any(s_funcs, ['upload', 'upload_start'])"))

_W = "high-rate"
rule("f17_t0806_brute_force_io", lambda s: R.t0806_brute_force_io(s.snapshot, threshold=100), sql_finding(
    "'high'", "'High-rate I/O writes from ' || src_ip || ' to ' || dst_ip", "T0806", "src_ip || ',' || dst_ip", "write_count || ' write commands'",
    "wt WHERE write_count >= 100"))

rule("f18_t0802_automated_collection", S(R.t0802_automated_collection), sql_finding(
    "'medium'", "'Automated collection: ' || src_ip || ' polling ' || n || ' OT devices'", "T0802", "src_ip", "n || ' read targets'",
    "(SELECT src_ip, count(*) AS n FROM rtw GROUP BY src_ip HAVING count(*) >= 10)"), "wide")

rule("f19_t0861_point_tag_scan", S(R.t0861_point_tag_scan), sql_finding(
    "'medium'", "'Modbus point/tag scan from ' || ip || ' (' || len(m_units) || ' unit IDs)'", "T0861", "ip", f"'units ' || {sql_joined('m_units')}",
    "dv WHERE m_role IN ('master','both') AND m_reads > 0 AND len(m_units) >= 5"))

rule("f20_t0840_connection_enumeration", S(R.t0840_connection_enumeration), sql_finding(
    "'high'", "'OT port sweep by ' || src_ip || ' (' || n || ' OT ports)'", "T0840", "src_ip", "n || ' distinct OT ports'",
    f"(SELECT src_ip, count(DISTINCT dst_port) AS n FROM cnw WHERE dst_port IN {_OTP} GROUP BY src_ip HAVING count(DISTINCT dst_port) >= 10)"), "wide")

def without_ports(s):
    """The snapshot with a context that knows no ports, as an import without them gives."""
    snap = s.snapshot
    N.context_of(snap)["src_ports"] = snap.connections.select("src_ip", "dst_port").limit(0)
    return R.t0840_connection_enumeration(snap)


rule("f20_host_sweep", without_ports, sql_finding(
    "'high'", "'OT host sweep by ' || src_ip || ' (' || n || ' hosts)'", "T0840", "src_ip", "n || ' distinct hosts on OT ports'",
    f"(SELECT src_ip, count(DISTINCT dst_ip) AS n FROM cnw WHERE dst_port IN {_OTP} GROUP BY src_ip HAVING count(DISTINCT dst_ip) >= 10)"), "wide")

rule("f21_t0803_block_command", S(R.t0803_block_command), sql_finding(
    "'medium'", "'PLC/RTU ' || ip || ' receiving no OT commands'", "T0803", "ip", "ip || ' has traffic but no inbound OT-port connection'",
    f"ass WHERE device_type IN ('plc','rtu') AND ip NOT IN (SELECT dst_ip FROM cn WHERE dst_port IN {_OTP})"))

rule("f22_t0804_block_reporting", S(R.t0804_block_reporting), sql_finding(
    "'medium'", "'DNP3 outstation ' || ip || ' not reporting to master'", "T0804", "ip", "ip || ' has a master but sends nothing to OT ports'",
    f"dv WHERE d_role = 'outstation' AND ip IN (SELECT ip FROM dp WHERE remote_role = 'master') AND ip NOT IN (SELECT src_ip FROM cn WHERE dst_port IN {_OTP})"))

rule("f23_t0881_service_stop", lambda s: R.t0881_service_stop(s.snapshot, s.servers), sql_finding(
    "'high'", "'Possible service stop on OT device ' || ip", "T0881", "ip", "r || ' packets received, average ' || av",
    f"""(SELECT a.ip, coalesce(r, 0) AS r, (SELECT CAST(sum(packet_count) AS BIGINT) // count(DISTINCT dst_ip) FROM cn WHERE dst_port IN {_OTP}) AS av
    FROM ass a LEFT JOIN (SELECT dst_ip AS ip, CAST(sum(packet_count) AS BIGINT) AS r FROM cn WHERE dst_port IN {_OTP} GROUP BY dst_ip) USING (ip)
    WHERE a.is_server AND list_has_any(a.protocols, [{SQL_SETS['OT'][1:-1]}])) WHERE av >= 10 AND r <= greatest(av // 20, 1)"""))

_TOUCH = "(SELECT src_ip AS ip, dst_ip AS peer FROM cn UNION SELECT dst_ip, src_ip FROM cn)"
rule("f24_t0864_transient_asset", lambda s: R.t0864_transient_asset(s.snapshot, s.seen), sql_finding(
    "'medium'", "'Transient device ' || ip || ' seen for only ' || (d // 1000000) || 's on OT segment'", "T0864", "ip", "ip || ' exchanged packets with OT devices'",
    f"""(SELECT ip, epoch_us(last_seen) - epoch_us(first_seen) AS d FROM ab WHERE ip NOT IN (SELECT ip FROM oti)
    AND ip IN (SELECT ip FROM {_TOUCH} WHERE peer IN (SELECT ip FROM oti))) WHERE d > 0 AND d < 300000000"""))

rule("f25_t0830_aitm", S(R.t0830_aitm), sql_finding(
    "'critical'", "'IP ' || ip || ' seen with ' || n || ' distinct MACs'", "T0830", "ip", "'from ' || a || ' to ' || z",
    """(SELECT ip, count(DISTINCT mac) AS n, min(mac) AS a, max(mac) AS z FROM (SELECT src_ip AS ip, src_mac AS mac FROM cn UNION ALL SELECT dst_ip, dst_mac FROM cn)
    GROUP BY ip HAVING count(DISTINCT mac) >= 2)"""))

rule("f26_t0884_connection_proxy", S(R.t0884_connection_proxy), sql_finding(
    "'high'", "'Possible OT traffic proxy at ' || ip", "T0884", "ip", "'client and server on ports ' || ports",
    f"""(SELECT ip, {sql_joined('list(dst_port)')} AS ports FROM (SELECT src_ip AS ip, dst_port FROM cn WHERE dst_port IN {_OTP}
    INTERSECT SELECT dst_ip, dst_port FROM cn WHERE dst_port IN {_OTP}) GROUP BY ip) JOIN ass USING (ip) WHERE device_type NOT IN {_OTT}"""))

rule("f27_t0866_remote_exploitation", S(R.t0866_remote_exploitation), sql_finding(
    "'high'", "CASE WHEN src_ip IN (SELECT ip FROM ass WHERE is_public) THEN 'External' ELSE 'Non-OT' END || ' host ' || src_ip || ' connecting to OT device ' || dst_ip || ' (port ' || dst_port || ')'",
    "T0866", "src_ip || ',' || dst_ip", f"{_SERVICE} || ', ' || n || ' packets'",
    """(SELECT src_ip, dst_ip, dst_port, CAST(sum(packet_count) AS BIGINT) AS n FROM cn WHERE dst_port IN (22, 23, 80, 443, 3389)
    AND dst_ip IN (SELECT ip FROM oti) AND (src_ip IN (SELECT ip FROM ass WHERE is_public) OR src_ip NOT IN (SELECT ip FROM oti)) GROUP BY 1, 2, 3)"""))

_FIELD = """(SELECT src_ip AS ip, count(DISTINCT dst_ip) AS n FROM cnw WHERE dst_ip IN (SELECT ip FROM assw WHERE device_type IN ('plc','rtu')) GROUP BY src_ip)"""
rule("f28_t0800_firmware_mode", S(R.t0800_firmware_mode), " UNION ALL ".join(sql_finding(
    "'critical'", f"'{what} from ' || ip || ' targeting PLC(s)'", "T0800", "ip", "n || ' field devices reached'", f"{_FIELD} JOIN dvw USING (ip) WHERE {cond}")
    for what, cond in (("CIP File Access", "e_file AND e_role = 'scanner'"),
                       ("S7 program upload/download", "s_role = 'client' AND list_has_any(s_funcs, ['upload', 'upload_start'])"))), "wide")

rule("f29_t0801_monitor_state", S(R.t0801_monitor_state), sql_finding(
    "'medium'", "'Wide process state monitoring by ' || src_ip || ' (' || n || ' OT endpoints)'", "T0801", "src_ip", "n || ' distinct OT endpoints'",
    f"""(SELECT src_ip, count(DISTINCT dst_ip || ':' || dst_port) AS n FROM cn WHERE dst_port IN {_OTP} GROUP BY src_ip)
    LEFT JOIN (SELECT src_ip, count(*) AS w FROM wt GROUP BY src_ip) USING (src_ip) WHERE n >= 20 AND (w IS NULL OR w < n // 2)"""))


@on_site("f30_capture_context", """SELECT 'ot_ips' AS kind, ip AS a, '' AS b FROM oti UNION ALL SELECT 'external_ips', ip, '' FROM ass WHERE is_public
    UNION ALL SELECT DISTINCT 'ip_macs', ip, mac FROM (SELECT src_ip AS ip, src_mac AS mac FROM cn UNION ALL SELECT dst_ip, dst_mac FROM cn)
    UNION ALL SELECT DISTINCT 'src_ports', src_ip, CAST(dst_port AS VARCHAR) FROM cn UNION ALL SELECT 'write_targets', src_ip, dst_ip FROM wt
    UNION ALL SELECT 'write_counts', src_ip, dst_ip || '=' || write_count FROM wt WHERE write_count > 0 UNION ALL SELECT 'read_targets', src_ip, dst_ip FROM rt""")
def _(s):
    ctx = N.capture_context(s.snapshot)
    ctx["write_counts"] = ctx["write_counts"].select("src_ip", F.concat_ws("=", "dst_ip", F.col("write_count").cast("string")))
    out = None
    for kind, table in ctx.items():
        cols = [F.col(c).cast("string") for c in table.columns]
        rows = table.select(F.lit(kind).alias("kind"), cols[0].alias("a"), (cols[1] if len(cols) > 1 else F.lit("")).alias("b"))
        out = rows if out is None else out.union(rows)
    return out


@on_site("f30_finding_targets", f"""SELECT 'T0855' AS technique_id, src_ip, dst_ip AS target_ip FROM wt UNION ALL
    SELECT DISTINCT 'T0846', src_ip, dst_ip FROM cn WHERE dst_port IN {_OTP} AND src_ip IN (SELECT ip FROM ass WHERE device_type IN ('it_device','unknown'))
    UNION ALL SELECT 'T0802', src_ip, dst_ip FROM rt UNION ALL SELECT 'T0856', ip, remote_ip FROM dp WHERE remote_role = 'master'
    UNION ALL SELECT DISTINCT 'T0801', src_ip, dst_ip FROM cn WHERE dst_port IN {_OTP}
    UNION ALL SELECT DISTINCT 'T0800', src_ip, dst_ip FROM cn WHERE dst_ip IN (SELECT ip FROM ass WHERE device_type IN ('plc', 'rtu'))""")
def _(s):
    return R.finding_targets(s.snapshot)


_CV = "(max_ms - min_ms) / avg_ms"
_POLL = f"(SELECT *, {_CV} AS cv FROM por WHERE sample_count >= 5 AND avg_ms > 0) WHERE cv > "
_POLL_TEXT = "'to ' || remote_ip || ', FC ' || function_code || ', unit ' || unit_id || ', ' || sample_count || ' samples'"


@on_site("f31_polling_deviation", f"""SELECT 'polling_deviation' AS anomaly_type, CASE WHEN cv > 2 THEN 'high' ELSE 'medium' END AS severity,
    CAST(CASE WHEN cv > 2 THEN 0.9 WHEN cv > 1 THEN 0.7 ELSE 0.5 END AS DOUBLE) AS confidence, ip AS affected_asset, {_POLL_TEXT} AS evidence FROM {_POLL} 0.5""", "replay")
def _(s):
    return A.polling_deviation(s.snapshot.polling)[0]


rule("f31_polling_deviation_findings", lambda s: A.polling_deviation(s.snapshot.polling)[1], sql_finding(
    "CASE WHEN cv > 2 THEN 'high' ELSE 'medium' END",
    "'Irregular polling interval from ' || ip || ' to ' || remote_ip || ' (FC ' || function_code || ', unit ' || unit_id || ')'", "", "ip || ',' || remote_ip", _POLL_TEXT,
    f"{_POLL} 1", "anomaly"), "replay")


@on_site("f32_role_reversal", """SELECT 'role_reversal' AS anomaly_type, 'high' AS severity, CAST(0.8 AS DOUBLE) AS confidence, ip AS affected_asset,
    m_master || ' master function codes' AS evidence FROM dv WHERE m_role = 'slave' AND m_master > 0
    UNION ALL SELECT 'role_reversal', 'high', 0.7, ip, d_master || ' master function codes' FROM dv WHERE d_role = 'outstation' AND d_unsol AND d_master > 0""")
def _(s):
    return A.role_reversal(s.snapshot)[0]


rule("f32_role_reversal_findings", lambda s: A.role_reversal(s.snapshot)[1], sql_finding(
    "'high'", "'Modbus role reversal: slave ' || ip || ' acting as master'", "", "ip", "m_master || ' master function codes'",
    "dv WHERE m_role = 'slave' AND m_master > 0", "anomaly"))

_PUBLIC = f"assw WHERE is_public AND list_has_any(protocols, [{SQL_SETS['OT'][1:-1]}])"
rule("f33_unexpected_public_ip", lambda s: A.unexpected_public_ip(s.assets)[1], sql_finding(
    "'critical'", "'Public IP on OT network: ' || ip", "", "ip", "array_to_string(protocols, ', ')", _PUBLIC, "anomaly"), "wide")


@on_site("f33_unexpected_public_ip_anomalies", f"""SELECT 'unexpected_public_ip' AS anomaly_type, 'critical' AS severity, CAST(0.95 AS DOUBLE) AS confidence,
    ip AS affected_asset, array_to_string(protocols, ', ') AS evidence FROM {_PUBLIC}""", "wide")
def _(s):
    return A.unexpected_public_ip(s.assets)[0]


@on_site("f34_purdue_assign", "SELECT ip AS ip_address, level, 'auto' AS method, reason FROM lv")
def _(s):
    return s.levels


_PV = sql_finding("severity", "'Cross-zone communication: L' || low || ' with L' || high || ' (' || x || ', ' || y || ')'", "T0886", "x || ',' || y",
                  "packets || ' packets between the levels'", "pv", "purdue_violation")
rule("f35_purdue_violations", lambda s: s.violations, _PV)
rule("f35_purdue_violations_wide", lambda s: s.violations, _PV.replace("FROM pv", "FROM pvw"), "wide")


def malware(name, fn, sql, variant="base"):
    on_site(name, sql, variant)(lambda s: fn(s.snapshot).select(
        "malware_name", "confidence", "severity", "source_ip", "target_count", "techniques", "evidence"))


def _malware_sql(name, confidence, severity, ip, targets, techniques, evidence, source):
    return (f"SELECT '{name}' AS malware_name, '{confidence}' AS confidence, '{severity}' AS severity, {ip} AS source_ip, {targets} AS target_count, "
            f"'{techniques}' AS techniques, {evidence} AS evidence FROM {source}")


malware("f36_malware_write_only_master", A.malware_write_only_master, _malware_sql(
    "FrostyGoop", "medium", "high", "ip", "coalesce(n, 0)", "T0855,T0831", "m_writes || ' write commands, no read targets'",
    """dvw LEFT JOIN (SELECT src_ip AS ip, count(*) AS n FROM wtw GROUP BY 1) USING (ip)
    WHERE m_role IN ('master','both') AND m_writes >= 3 AND ip NOT IN (SELECT src_ip FROM rtw)"""), "wide")

_PD = "PIPEDREAM/INCONTROLLER"
malware("f37_malware_multi_protocol", A.malware_multi_protocol, _malware_sql(
    _PD, "high", "critical", "ip", "n", "T0846,T0855,T0843", "p",
    f"""(SELECT src_ip AS ip, count(DISTINCT dst_ip) AS n, string_agg(DISTINCT protocol, ', ' ORDER BY protocol) AS p FROM cn WHERE protocol IN {_ICS}
    GROUP BY 1 HAVING count(DISTINCT protocol) >= 3)""") + " UNION ALL " + _malware_sql(
    _PD, "medium", "high", "ip", "n", "T0843,T0846", "'CODESYS runtime port 2455'",
    f"""(SELECT src_ip AS ip, count(DISTINCT dst_ip) AS n FROM cn WHERE dst_port = 2455 AND src_ip IN (SELECT src_ip FROM cn WHERE protocol IN {_ICS})
    AND src_ip NOT IN (SELECT ip FROM oti) GROUP BY 1)"""))

_IECT = "dv JOIN (SELECT src_ip AS ip, count(DISTINCT dst_ip) AS n FROM cn WHERE dst_port = 2404 OR protocol = 'iec104' GROUP BY 1) USING (ip) WHERE i_cmd"
malware("f38_malware_iec104_burst", A.malware_iec104_burst, _malware_sql(
    "Industroyer2", "high", "critical", "ip", "n", "T0855,T0831", "'control commands to ' || n || ' outstations'", f"{_IECT} AND n >= 2") + " UNION ALL " +
    _malware_sql("Industroyer2", "low", "high", "ip", "n", "T0816,T0831", "'control commands and a process reset'", f"{_IECT} AND n = 1 AND i_reset"))


# Switches of the derived site: devices that answered on port 22 stand for managed
# switches; VLANs and ring frames come from the same packets.


def switch_site(s):
    s = packets_with_props(s)
    managed = s.packets.filter("src_port = 22").select(F.col("src_ip").alias("ip_address")).distinct().withColumn("_sw", F.lit(True))
    assets = s.assets.join(managed, "ip_address", "left").withColumn(
        "device_type", F.when(F.col("_sw"), "switch").otherwise(F.col("device_type"))
    ).withColumn("protocols", F.when(F.col("_sw") & F.array_contains("protocols", "http"), F.array_append("protocols", F.lit("telnet"))).otherwise(F.col("protocols")))
    vlans = lldp_rows(s).select("vlan_id")
    ring = redundancy_rows(s)
    defaults = assets.filter("vendor = 'Moxa'").select("ip_address")
    return assets, vlans, ring, defaults


@on_site("f39_switch_security", """WITH sw AS (SELECT ip, protocols, vendor FROM ass WHERE ip IN (SELECT src_ip FROM pk WHERE src_port = 22))
    SELECT 'medium' AS severity, 'Default VLAN in use' AS title, 'VLAN 1 seen' AS evidence, '' AS ip_address
    WHERE EXISTS (SELECT 1 FROM pk WHERE src_port = 3389 AND (k % 4 = 0 OR k = 1))
    UNION ALL SELECT 'medium', 'Topology change notification', 'redundancy topology changed', '' WHERE EXISTS (SELECT 1 FROM pk WHERE k % 10 = 1)
    UNION ALL SELECT 'critical', 'Default credentials on switches', count(*) || ' switches', '' FROM sw WHERE vendor = 'Moxa' HAVING count(*) > 0
    UNION ALL SELECT 'medium', 'Insecure and secure management together', 'telnet next to ssh or https', ip FROM sw
    WHERE list_contains(protocols, 'http') AND list_has_any(protocols, ['ssh', 'https'])""")
def _(s):
    return A.switch_security(*switch_site(s))


#: The queries whose rows together are the findings of a run, and those of its anomalies.
RULES = [
    "f1_t0855_modbus_writes", "f2_t0814_modbus_diagnostics", "f3_t0856_dnp3_unsolicited", "f4_t0846_remote_discovery", "f5_enip_rules",
    "f6_s7_rules", "f7_iec104_rules", "f8_bacnet_rules", "f9_flat_network", "f10_cleartext_ot", "f11_internet_exposed_ot",
    "f12_t0822_external_remote", "f13_t0867_lateral_transfer", "f14_t0885_uncommon_port", "f15_t0849_masquerading", "f16_t0868_operating_mode",
    "f17_t0806_brute_force_io", "f18_t0802_automated_collection", "f19_t0861_point_tag_scan", "f20_t0840_connection_enumeration",
    "f21_t0803_block_command", "f22_t0804_block_reporting", "f23_t0881_service_stop", "f24_t0864_transient_asset", "f25_t0830_aitm",
    "f26_t0884_connection_proxy", "f27_t0866_remote_exploitation", "f28_t0800_firmware_mode", "f29_t0801_monitor_state",
    "f31_polling_deviation_findings", "f32_role_reversal_findings", "f33_unexpected_public_ip", "f35_purdue_violations",
]
ANOMALIES = ["f31_polling_deviation", "f32_role_reversal", "f33_unexpected_public_ip_anomalies"]
#: Write commands from which a writer counts as heavy on the derived traffic (as in f17).
HEAVY = 100
#: The site with a sensor's labels, where most rules fire; the others complete them.
RUN_SITES = {"": "m", "_wide": "w", "_flat": "f", "_replay": "r"}


def run_of(spark, sf_dir: str, suffix: str = "m") -> dict:
    """Tables of a full run over a site, written once per application."""
    site = LabelledSite(spark, sf_dir) if suffix == "m" else Site(spark, sf_dir, SITES[suffix][0])
    site.label = suffix

    def build(name):
        if not hasattr(site, "_run"):
            snap = site.snapshot.staged()
            site._run = run_in_few_passes(snap, device_first_last_seen(snap.stats), io_writes=HEAVY)
        return site._run[name]

    return {"site": site} | {name: shared(site, f"run-{name}", lambda name=name: build(name)) for name in ("findings", "anomalies")}


def found_sql(suffix: str = "m", names: list[str] = RULES) -> str:
    """Rows of all these queries on the site with the suffix, duplicates kept; connections have the site's own labels."""
    return " UNION ALL ".join(f"SELECT * FROM ({at_site(SQL[name].replace(_TAGGED, 'cn'), suffix)})" for name in names)


#: All findings of the labelled site with their id, and the rank of their severity.
FOUND = f"""found AS ({found_sql()}), ranked AS (SELECT *, sha256(finding_type || '|' || technique_id || '|' || title || '|' || affected) AS id,
    CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS r FROM found)"""
ODD = f"odd AS ({found_sql(names=ANOMALIES)})"


def _run_query(name: str, suffix: str) -> None:
    @query(f"f40_run_full_analysis{name}", found_sql(suffix))
    def _(spark, d):
        return shown_findings(run_of(spark, d, suffix)["findings"])

    @query(f"f40_run_anomalies{name}", found_sql(suffix, ANOMALIES))
    def _(spark, d):
        return run_of(spark, d, suffix)["anomalies"]


for _name, _suffix in RUN_SITES.items():
    _run_query(_name, _suffix)


@query("f41_analysis_summary", f"""WITH {FOUND}, {ODD} SELECT count(*) AS total_findings, count(*) FILTER (WHERE severity = 'critical') AS critical_count,
    count(*) FILTER (WHERE severity = 'high') AS high_count, count(*) FILTER (WHERE severity = 'medium') AS medium_count,
    count(*) FILTER (WHERE severity = 'low') AS low_count, count(*) FILTER (WHERE severity = 'info') AS info_count,
    count(*) FILTER (WHERE finding_type = 'purdue_violation') AS purdue_violations, (SELECT count(*) FROM odd) AS anomaly_count,
    (SELECT count(*) FROM ab) AS assets_analyzed, (SELECT count(*) FROM cnm) AS connections_analyzed,
    (SELECT round(CAST(greatest(sum(packet_count) FILTER (WHERE protocol IN {SQL_SETS['OT']}) - sum(packet_count) FILTER (WHERE protocol IN ('https', 'ssh')), 0) AS BIGINT)
    * 100.0 / CAST(sum(packet_count) FILTER (WHERE protocol IN {SQL_SETS['OT']}) AS BIGINT), 1) FROM cnm) AS unencrypted_ot_percent FROM ranked""")
def _(spark, d):
    run = run_of(spark, d)
    return A.analysis_summary(run["findings"], run["anomalies"], run["site"].assets, run["site"].connections)


_TOP_FINDINGS = "SELECT severity, title, id FROM ranked ORDER BY r DESC, id"


@query("f42_top_findings", f"WITH {FOUND} {_TOP_FINDINGS} LIMIT 40")
def _(spark, d):
    return A.top_findings(run_of(spark, d)["findings"], 40).select("severity", "title", "id")


@query("f42_all_findings", f"WITH {FOUND} {_TOP_FINDINGS}")
def _(spark, d):
    return A.top_findings(run_of(spark, d)["findings"]).select("severity", "title", "id")


_TOP_ANOMALIES = f"""SELECT severity, confidence, affected_asset, evidence FROM ({found_sql("r", ANOMALIES)})
    ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, confidence DESC, anomaly_type, affected_asset, evidence"""


@query("f42_top_anomalies", f"{_TOP_ANOMALIES} LIMIT 30")
def _(spark, d):
    return A.top_anomalies(run_of(spark, d, "r")["anomalies"], 30).select("severity", "confidence", "affected_asset", "evidence")


@query("f42_all_anomalies", _TOP_ANOMALIES)
def _(spark, d):
    return A.top_anomalies(run_of(spark, d, "r")["anomalies"]).select("severity", "confidence", "affected_asset", "evidence")


def _advice_sql() -> str:
    by_code = " ".join(f"WHEN technique_id = '{code}' THEN '{tip}'" for code, tip in reversed(C.ADVICE_BY_TECHNIQUE.items()))
    by_title = " ".join(f"WHEN contains(lower(title), '{word}') THEN '{tip}'" for word, tip in C.ADVICE_BY_TITLE)
    return f"CASE {by_code} {by_title} ELSE '{C.ADVICE_DEFAULT}' END"


@query("f43_remediation_list", f"WITH {FOUND} SELECT row_number() OVER (ORDER BY r DESC, id) AS rank, severity, title, {_advice_sql()} AS remediation FROM ranked")
def _(spark, d):
    return A.remediation_list(run_of(spark, d)["findings"]).select("rank", "severity", "title", "remediation")


def _meaning_sql() -> str:
    cases = [f"WHEN technique_id = '{k}' THEN '{v}'" for k, v in C.MEANING_BY_TECHNIQUE.items()] + [f"WHEN finding_type = '{k}' THEN '{v}'" for k, v in C.MEANING_BY_TYPE.items()]
    return f"CASE {' '.join(cases)} END"


@query("f40_described_findings", f"WITH {FOUND} SELECT id, {_meaning_sql()} AS description, (SELECT epoch_us(max(ts)) FROM pk) AS as_of_us FROM ranked")
def _(spark, d):
    run = run_of(spark, d)
    end = run["site"].packets.agg(F.max("ts")).scalar()
    return N.described(run["findings"], end).select("id", "description", F.unix_micros("as_of").alias("as_of_us"))
