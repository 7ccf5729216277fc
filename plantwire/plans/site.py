"""Tables of one derived capture, built lazily, and their SQL counterparts.

``Site`` is what a user would write to go from packets to every other table.
``site_ctes`` states the same tables as SQL over the packet CTE; message fields come
from the values the packets were made of, not from decoding payloads.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scale import compiled, stage
from ..operators import analysis as A
from ..operators import assess, devices, patterns, segmentation, similarity, traffic
from ..operators import packets as P
from ..operators.findings import Snapshot
from . import binding

# --- fixed values: vendors of the MAC prefixes in the derived traffic ---------------
OUI_ROWS = [("00:1c:06", "Siemens"), ("00:a0:45", "Phoenix Contact"), ("00:90:e8", "Moxa"), ("00:1b:1b", "Rockwell Automation")]


_SHARED: dict[tuple, DataFrame] = {}


def shared(site: "Site", name: str, build) -> DataFrame:
    """A staged table of a site, written once per application and state of the events."""
    key = (site.spark.sparkContext.applicationId, site.sf_dir, binding.identity(site.spark, site.sf_dir), site.variant, site.where, site.label, site.hot, name)
    if key not in _SHARED:
        table = build()
        with compiled(site.spark):
            _SHARED[key] = stage(table, name)
    return _SHARED[key]


class SiteSnapshot:
    """A snapshot whose tables are built when a rule first reads them."""

    def __init__(self, site: "Site"):
        self.site, self.context = site, None

    def __getattr__(self, name):
        build = {
            "assets": lambda s: s.assets, "connections": lambda s: s.connections, "devices": lambda s: s.devices,
            "stats": lambda s: s.stats, "function_codes": lambda s: devices.function_codes(s.messages),
            "modbus_peers": lambda s: devices.modbus_relationships(s.messages),
            "dnp3_peers": lambda s: devices.dnp3_relationships(s.messages),
            "polling": lambda s: devices.modbus_polling_intervals(s.messages),
        }
        if name not in build:
            raise AttributeError(name)
        table = build[name](self.site)
        setattr(self, name, table)
        return table

    def staged(self) -> Snapshot:
        return Snapshot.staged(self)


class Site:
    def __init__(self, spark: SparkSession, sf_dir: str, variant: str = "base", where: str | None = None, hot: int = 5):
        self.spark, self.sf_dir, self.variant, self.where, self.label, self.hot = spark, sf_dir, variant, where, None, hot

    @cached_property
    def packets(self) -> DataFrame:
        return P.identify_protocol(binding.packets(self.spark, self.sf_dir, self.variant, self.where))

    @cached_property
    def messages(self) -> DataFrame:
        return P.messages(self.packets)

    @cached_property
    def connections(self) -> DataFrame:
        return traffic.connections(self.packets)

    @cached_property
    def base(self) -> DataFrame:
        return traffic.asset_base(self.packets)

    @cached_property
    def oui(self) -> DataFrame:
        return self.spark.createDataFrame(OUI_ROWS, "prefix string, vendor string")

    @cached_property
    def assets(self) -> DataFrame:
        return traffic.build_assets(self.base, oui=self.oui)

    @cached_property
    def servers(self) -> DataFrame:
        return traffic.server_ips(self.connections)

    @cached_property
    def stats(self) -> DataFrame:
        return patterns.connection_stats(self.packets)

    @cached_property
    def anomalies(self) -> DataFrame:
        return patterns.pattern_anomalies(self.stats)

    @cached_property
    def seen(self) -> DataFrame:
        return patterns.device_first_last_seen(self.stats)

    @cached_property
    def devices(self) -> DataFrame:
        return devices.device_protocol_info(self.messages)

    @cached_property
    def snapshot(self) -> "SiteSnapshot":
        return SiteSnapshot(self)

    @cached_property
    def levels(self) -> DataFrame:
        return A.purdue_assign(self.snapshot)

    @cached_property
    def leveled(self) -> DataFrame:
        """Assets with their automatic level."""
        return A.apply_levels(self.assets, self.levels)

    @cached_property
    def partly_leveled(self) -> DataFrame:
        """Levels for all but the unclassified devices, so that communities exist."""
        return self.leveled.withColumn(
            "purdue_level", F.when(F.col("device_type") != "unknown", F.col("purdue_level"))
        )

    @cached_property
    def allowlist(self) -> DataFrame:
        return assess.allowlist(self.connections, self.leveled, self.stats)

    @cached_property
    def violations(self) -> DataFrame:
        return A.purdue_violations(self.connections, self.levels)

    def once(self, name: str) -> DataFrame:
        """A table of the site, written once for steps that read it many times."""
        return shared(self, name, lambda: getattr(self, name))

    def written(self, *names: str) -> "Site":
        """This site, with the named tables written once."""
        site = type(self)(self.spark, self.sf_dir, self.variant, self.where, self.hot)
        site.label = self.label
        for name in names:
            setattr(site, name, site.once(name))
        return site

    @cached_property
    def segment_inputs(self) -> tuple[DataFrame, DataFrame]:
        # Everything after this reads the two tables many times, so they are written once.
        def build(*names: str) -> tuple[DataFrame, DataFrame]:
            s = self.written(*names)
            return segmentation.segmentation_inputs(
                s.partly_leveled, s.connections, s.stats, s.anomalies, s.devices, s.allowlist, s.violations
            )

        tables = ("connections", "assets", "devices", "levels")
        return shared(self, "profiles", lambda: build(*tables)[0]), shared(self, "observed", lambda: build(*tables, "stats")[1])

    @cached_property
    def neighbors(self) -> DataFrame:
        return shared(self, "neighbors", lambda: similarity.neighbor_sets(self.once("connections")))

    @cached_property
    def groups(self) -> DataFrame:
        profiles, observed = self.segment_inputs
        return shared(self, "groups", lambda: segmentation.policy_groups(profiles, observed, self.neighbors, hot=self.hot))

    @cached_property
    def zones(self) -> DataFrame:
        return segmentation.baseline_zones(segmentation.group_table(self.groups))

    @cached_property
    def ip_zone(self) -> DataFrame:
        return segmentation.ip_to_zone(self.segment_inputs[0], self.zones)

    @cached_property
    def rules(self) -> DataFrame:
        return shared(self, "rules", lambda: segmentation.communication_matrix(self.segment_inputs[1], self.ip_zone))


class LabelledSite(Site):
    """A site whose connections carry the labels of a sensor, so that wrong labels occur."""

    @cached_property
    def connections(self) -> DataFrame:
        from .registry import SENSOR_LABEL

        return super().connections.withColumn("protocol", F.expr(SENSOR_LABEL))


_OT = (
    "('modbus','dnp3','ethernet_ip','bacnet','s7comm','opc_ua','profinet','iec104','mqtt','hart_ip',"
    "'foundation_fieldbus','ge_srtp','wonderware_suitelink')"
)
_ICS = _OT.replace("'mqtt',", "")
_OTP = "(102,502,1089,1090,1091,2222,2404,4840,5007,5094,18245,18246,20000,34962,34963,34964,44818,47808)"
_SRV = "(102,502,1089,1090,1091,1883,2222,2404,4840,5007,5094,8883,18245,18246,20000,34962,34963,34964,44818,47808)"
_L1 = "(502,44818,2222,102,20000,2404,34962,34963,34964)"
_OTT = "('plc','rtu','hmi','historian','engineering_workstation','scada_server','io_server','field_device','controller')"
SQL_SETS = {"OT": _OT, "ICS": _ICS, "OTP": _OTP, "SRV": _SRV, "L1": _L1, "OTT": _OTT}


def _has(column: str, values: str) -> str:
    return f"list_has_any({column}, [{values}])"


def _ctes() -> dict[str, str]:
    known = "length(list_filter(protocols, lambda p: p IN {OT}))"
    role2 = (
        "CASE WHEN bool_or(protocol='{p}' AND role='{a}') AND bool_or(protocol='{p}' AND role='{b}') THEN 'both' "
        "WHEN bool_or(protocol='{p}' AND role='{a}') THEN '{a}' WHEN bool_or(protocol='{p}' AND role='{b}') THEN '{b}' "
        "WHEN bool_or(protocol='{p}') THEN 'unknown' END"
    )
    last = "last(role ORDER BY ts, seq) FILTER (WHERE protocol='{p}')"
    return {
        # connections
        "cn": """SELECT src_ip, src_port, dst_ip, dst_port, protocol, count(*) AS packet_count,
            CAST(sum(length) AS BIGINT) AS byte_count, min(ts) AS first_seen, max(ts) AS last_seen,
            first(src_mac ORDER BY ts, seq) AS src_mac, first(dst_mac ORDER BY ts, seq) AS dst_mac,
            first(transport ORDER BY ts, seq) AS transport,
            list_sort(list(DISTINCT origin_file)) AS origin_files
            FROM pk{S} GROUP BY src_ip, src_port, dst_ip, dst_port, protocol""",
        # packet ends
        "en": """SELECT src_ip AS ip, src_mac AS mac, protocol, ts, seq, src_port IN {SRV} AS serves FROM pk{S}
            UNION ALL SELECT dst_ip, dst_mac, protocol, ts, seq, dst_port IN {SRV} FROM pk{S}""",
        "ab": """SELECT ip, list_sort(list(DISTINCT protocol)) AS protocols, count(*) AS packet_count,
            first(mac ORDER BY ts, seq) AS mac, min(ts) AS first_seen, max(ts) AS last_seen, bool_or(serves) AS is_server
            FROM en{S} GROUP BY ip""",
        "ass": f"""SELECT ip, protocols, packet_count, mac, first_seen, last_seen, is_server,
            CASE WHEN is_server AND {known} >= 1 THEN
                CASE WHEN {_has('protocols', "'ethernet_ip','s7comm','ge_srtp','bacnet'")} THEN 'plc'
                     WHEN {_has('protocols', "'modbus','dnp3'")} THEN 'rtu' ELSE 'unknown' END
                WHEN is_server AND list_contains(protocols, 'wonderware_suitelink') THEN 'scada_server'
                WHEN {known} >= 2 THEN 'hmi'
                WHEN {known} = 1 AND list_contains(protocols, 'opc_ua') THEN 'historian'
                WHEN {known} = 0 THEN 'it_device' ELSE 'unknown' END AS device_type,
            CASE substr(mac, 1, 8) WHEN '00:1c:06' THEN 'Siemens' WHEN '00:a0:45' THEN 'Phoenix Contact'
                WHEN '00:90:e8' THEN 'Moxa' WHEN '00:1b:1b' THEN 'Rockwell Automation' END AS vendor,
            ip LIKE '203.0.113.%' AS is_public
            FROM ab{{S}}""",
        # statistics
        "gp": """SELECT src_ip, dst_ip, dst_port AS port, protocol, length, ts,
            epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY src_ip, dst_ip, dst_port, protocol ORDER BY ts) AS gap
            FROM pk{S}""",
        "st": """SELECT *, CASE WHEN duration_secs > 0 THEN packet_count / duration_secs ELSE 0.0 END AS packets_per_sec,
            gap_n >= 5 AND avg_ms > 0 AND std_ms < 0.3 * avg_ms AS is_periodic FROM (
            SELECT src_ip, dst_ip, port, protocol, count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS byte_count,
            min(ts) AS first_seen, max(ts) AS last_seen, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_secs,
            count(gap) AS gap_n, coalesce(CAST(sum(gap) AS BIGINT) / count(gap) / 1000.0, 0.0) AS avg_ms,
            CASE WHEN count(gap) > 1 THEN stddev_pop(gap / 1000.0) ELSE 0.0 END AS std_ms,
            coalesce(min(gap) / 1000.0, 0.0) AS min_ms, coalesce(max(gap) / 1000.0, 0.0) AS max_ms
            FROM gp{S} GROUP BY src_ip, dst_ip, port, protocol)""",
        "an": """SELECT src_ip, dst_ip, port, protocol, unnest(list_filter([
            CASE WHEN packet_count = 1 THEN 'one_off' END,
            CASE WHEN packet_count > 1 AND protocol IN {ICS} AND packets_per_sec > 100 THEN 'high_frequency' END,
            CASE WHEN packet_count >= 10 AND protocol IN {ICS} AND avg_ms > 0 AND std_ms > avg_ms THEN 'irregular_polling' END,
            CASE WHEN packet_count >= 10 AND avg_ms > 0 AND max_ms > 10 * avg_ms THEN 'burst' END],
            lambda x: x IS NOT NULL)) AS anomaly_type FROM st{S}""",
        # messages, from what the packets were made of
        "msg": """SELECT *, CASE sp WHEN 502 THEN CASE WHEN resp THEN 'slave' ELSE 'master' END
            WHEN 20000 THEN CASE WHEN resp THEN 'outstation' ELSE 'master' END
            WHEN 2404 THEN CASE WHEN iec IS NULL THEN 'unknown' WHEN iec = 36 THEN 'outstation' ELSE 'master' END
            WHEN 102 THEN CASE WHEN resp THEN 'server' ELSE 'client' END
            WHEN 47808 THEN bacnet_role WHEN 34962 THEN pn_role
            ELSE CASE WHEN resp THEN 'adapter' WHEN et IN ('purchase', 'signup') THEN 'scanner' ELSE 'unknown' END
            END AS role,
            CASE sp WHEN 502 THEN fc WHEN 20000 THEN dfc END AS function_code,
            CASE WHEN sp IN (44818, 2222) THEN CASE WHEN resp THEN 'send_rr_data' WHEN et = 'click' THEN 'list_identity'
                WHEN et = 'signup' THEN 'register_session' ELSE 'send_rr_data' END END AS command,
            CASE WHEN sp = 102 THEN CASE s7 WHEN 4 THEN 'read_var' WHEN 5 THEN 'write_var' WHEN 29 THEN 'download_start'
                WHEN 26 THEN 'upload_start' WHEN 41 THEN 'plc_stop' WHEN 40 THEN 'pi_service'
                WHEN 240 THEN 'setup_communication' WHEN 27 THEN 'upload' END END AS s7_function,
            CASE WHEN sp = 502 AND fc IN (3, 6, 16) AND (NOT resp OR (fc = 16 AND NOT exc)) THEN k END AS reg_start,
            CASE WHEN sp = 502 AND fc IN (3, 6, 16) AND (NOT resp OR (fc = 16 AND NOT exc))
                THEN CASE WHEN fc = 6 THEN 1 ELSE 10 END END AS reg_count
            FROM pk{S} WHERE sp IN (502, 20000, 2404, 102, 44818, 2222, 47808, 34962)""",
        "dv": f"""SELECT src_ip AS ip,
            {role2.format(p='modbus', a='master', b='slave')} AS m_role,
            list_sort(list(DISTINCT unit) FILTER (WHERE protocol='modbus')) AS m_units,
            count(*) FILTER (WHERE protocol='modbus' AND function_code IN (5,6,15,16)) AS m_writes,
            count(*) FILTER (WHERE protocol='modbus' AND function_code IN (5,6,15,16,22,23)) AS m_writes_wide,
            count(*) FILTER (WHERE protocol='modbus' AND function_code BETWEEN 1 AND 4) AS m_reads,
            count(*) FILTER (WHERE protocol='modbus' AND function_code IN (1,2,3,4,5,6,15,16)) AS m_master,
            count(*) FILTER (WHERE protocol='modbus' AND function_code = 8) AS m_diag,
            {role2.format(p='dnp3', a='master', b='outstation')} AS d_role,
            list_sort(list(DISTINCT CASE WHEN resp THEN s ELSE 100 + c END) FILTER (WHERE protocol='dnp3')) AS d_addr,
            coalesce(bool_or(protocol='dnp3' AND function_code = 130), FALSE) AS d_unsol,
            count(*) FILTER (WHERE protocol='dnp3' AND function_code BETWEEN 2 AND 6) AS d_writes,
            count(*) FILTER (WHERE protocol='dnp3' AND function_code BETWEEN 1 AND 6) AS d_master,
            {last.format(p='ethernet_ip')} AS e_role,
            bool_or(protocol='ethernet_ip' AND coalesce(cip_service='write' AND cip_class='assembly', FALSE)) AS e_assembly,
            bool_or(protocol='ethernet_ip' AND coalesce(cip_class='file', FALSE)) AS e_file,
            bool_or(protocol='ethernet_ip' AND command='list_identity') AS e_list,
            {last.format(p='s7comm')} AS s_role,
            list_sort(list(DISTINCT s7_function) FILTER (WHERE protocol='s7comm')) AS s_funcs,
            {last.format(p='bacnet')} AS b_role,
            bool_or(protocol='bacnet' AND bacnet_service='write_property' AND bacnet_object IN ('analog_output','binary_output')) AS b_out,
            bool_or(protocol='bacnet' AND bacnet_service='write_property' AND bacnet_object='notification_class') AS b_notif,
            bool_or(protocol='bacnet' AND bacnet_service='reinitialize_device') AS b_reinit,
            bool_or(protocol='bacnet' AND bacnet_service='device_communication_control') AS b_comm,
            {last.format(p='iec104')} AS i_role,
            bool_or(protocol='iec104' AND coalesce(iec IN (45, 46, 100, 105), FALSE)) AS i_cmd,
            bool_or(protocol='iec104' AND coalesce(iec = 105, FALSE)) AS i_reset,
            bool_or(protocol='iec104' AND coalesce(iec = 100, FALSE)) AS i_inter,
            CASE WHEN bool_or(protocol='profinet') THEN
                coalesce(last(role ORDER BY ts, seq) FILTER (WHERE protocol='profinet' AND role <> 'unknown'), 'unknown') END AS p_role,
            last(pn_station ORDER BY ts, seq) FILTER (WHERE protocol='profinet' AND pn_station IS NOT NULL) AS p_name
            FROM msg{{S}} GROUP BY src_ip""",
        "fcs": """SELECT protocol, src_ip AS ip, function_code, count(*) AS n,
            CASE WHEN protocol='modbus' THEN CASE function_code WHEN 3 THEN 'Read Holding Registers'
                WHEN 6 THEN 'Write Single Register' WHEN 8 THEN 'Diagnostics' WHEN 16 THEN 'Write Multiple Registers' END
            ELSE CASE function_code WHEN 1 THEN 'Read' WHEN 2 THEN 'Write' WHEN 3 THEN 'Select' WHEN 5 THEN 'Direct Operate'
                WHEN 129 THEN 'Response' WHEN 130 THEN 'Unsolicited Response' END END AS function_name,
            CASE WHEN protocol='modbus' THEN function_code IN (5,6,15,16,22,23) ELSE function_code BETWEEN 2 AND 6 END AS is_write
            FROM msg{S} WHERE protocol IN ('modbus','dnp3') GROUP BY protocol, src_ip, function_code""",
        "mp": """SELECT src_ip AS ip, dst_ip AS remote_ip,
            first(CASE role WHEN 'master' THEN 'slave' WHEN 'slave' THEN 'master' ELSE 'unknown' END ORDER BY ts, seq) AS remote_role,
            count(*) AS packet_count, list_sort(list(DISTINCT unit)) AS unit_ids
            FROM msg{S} WHERE protocol='modbus' GROUP BY src_ip, dst_ip""",
        "dp": """SELECT src_ip AS ip, dst_ip AS remote_ip,
            first(CASE role WHEN 'master' THEN 'outstation' WHEN 'outstation' THEN 'master' ELSE 'unknown' END ORDER BY ts, seq)
            AS remote_role, count(*) AS packet_count
            FROM msg{S} WHERE protocol='dnp3' GROUP BY src_ip, dst_ip""",
        "pog": """SELECT src_ip AS ip, dst_ip AS remote_ip, fc AS function_code, unit AS unit_id, epoch_us(ts)
            - lag(epoch_us(ts)) OVER (PARTITION BY src_ip, dst_ip, fc, unit ORDER BY ts) AS gap
            FROM msg{S} WHERE protocol='modbus' AND role='master' AND NOT exc""",
        "po": """SELECT ip, remote_ip, function_code, unit_id, round(CAST(sum(g) AS BIGINT) / count(g) / 1000.0, 1) AS avg_ms,
            round(min(g) / 1000.0, 1) AS min_ms, round(max(g) / 1000.0, 1) AS max_ms, count(g) AS sample_count FROM (
            SELECT ip, remote_ip, function_code, unit_id, CASE WHEN gap > 0 AND gap < 60000000 THEN gap END AS g FROM pog{S})
            GROUP BY ip, remote_ip, function_code, unit_id HAVING count(*) >= 3 AND count(g) >= 2""",
        # capture context
        "oti": """SELECT ip FROM ass{S} WHERE device_type IN {OTT} UNION SELECT dst_ip FROM cn{S} WHERE dst_port IN {OTP}""",
        "wt": """SELECT p.ip AS src_ip, p.remote_ip AS dst_ip, d.m_writes AS write_count FROM mp{S} p JOIN dv{S} d USING (ip)
            WHERE p.remote_role = 'slave' AND d.m_role IN ('master','both')""",
        "rt": """SELECT DISTINCT src_ip, dst_ip FROM cn{S} c WHERE dst_port IN {OTP}
            AND NOT EXISTS (SELECT 1 FROM wt{S} w WHERE w.src_ip = c.src_ip AND w.dst_ip = c.dst_ip)""",
        # Purdue levels
        "lc": """SELECT ip, count(*) FILTER (WHERE client) AS targets, count(*) FILTER (WHERE NOT client) AS served FROM (
            SELECT src_ip AS ip, TRUE AS client FROM cn{S} WHERE dst_port IN {L1}
            UNION ALL SELECT dst_ip, FALSE FROM cn{S} WHERE dst_port IN {L1}) GROUP BY ip""",
        "lv": f"""SELECT a.ip, a.device_type,
            CASE WHEN device_type IN ('plc','rtu') THEN 1 WHEN device_type IN ('hmi','engineering_workstation') THEN 2
                WHEN device_type IN ('historian','scada_server') THEN 3 WHEN coalesce(served, 0) > 0 THEN 1
                WHEN list_contains(protocols, 'opc_ua') OR coalesce(targets, 0) >= 10 THEN 3
                WHEN {known} >= 2 OR coalesce(targets, 0) >= 2 THEN 2 WHEN {known} >= 1 THEN 2 ELSE 4 END AS level,
            CASE WHEN device_type IN ('plc','rtu','hmi','engineering_workstation','historian','scada_server')
                    THEN 'device type ' || device_type
                WHEN coalesce(served, 0) > 0 THEN 'serves an OT port'
                WHEN list_contains(protocols, 'opc_ua') THEN 'uses OPC UA'
                WHEN coalesce(targets, 0) >= 10 THEN targets || ' OT client connections'
                WHEN {known} >= 2 OR coalesce(targets, 0) >= 2
                    THEN {known} || ' OT protocols, ' || coalesce(targets, 0) || ' OT client connections'
                WHEN {known} >= 1 THEN 'OT client of ' || list_aggregate(list_filter(protocols, lambda p: p IN {{OT}}), 'string_agg', ', ')
                ELSE 'no OT activity' END AS reason
            FROM ass{{S}} a LEFT JOIN lc{{S}} USING (ip)""",
        "pv": """SELECT x, y, CASE max(r) WHEN 2 THEN 'medium' ELSE 'low' END AS severity, CAST(sum(packet_count) AS BIGINT) AS packets,
            arg_max(low, r * 100 + low * 10 + high) AS low, arg_max(high, r * 100 + low * 10 + high) AS high FROM (
            SELECT least(c.src_ip, c.dst_ip) AS x, greatest(c.src_ip, c.dst_ip) AS y, packet_count,
                least(a.level, b.level) AS low, greatest(a.level, b.level) AS high,
                CASE WHEN least(a.level, b.level) <= 1 AND greatest(a.level, b.level) >= 4 THEN 2
                     WHEN least(a.level, b.level) = 2 AND greatest(a.level, b.level) >= 4 THEN 1 END AS r
            FROM cn{S} c JOIN lv{S} a ON a.ip = c.src_ip JOIN lv{S} b ON b.ip = c.dst_ip) WHERE r IS NOT NULL GROUP BY x, y""",
        # allowlist
        "alrev": """SELECT DISTINCT c.src_ip, c.dst_ip, c.dst_port, c.protocol FROM cn{S} c JOIN cn{S} r
            ON r.src_ip = c.dst_ip AND r.dst_ip = c.src_ip AND r.protocol = c.protocol
            AND (r.dst_port = c.dst_port OR r.dst_port = c.src_port)""",
        "al": """SELECT f.src_ip, f.dst_ip, f.dst_port, f.protocol,
            CASE WHEN b.src_ip IS NULL THEN 'unidirectional' ELSE 'bidirectional' END AS direction,
            s.packet_count, s.is_periodic, s.avg_ms, s.packets_per_sec, s.duration_secs,
            x.device_type AS src_type, y.device_type AS dst_type, lx.level AS src_level, ly.level AS dst_level,
            CASE WHEN f.protocol NOT IN {ICS} THEN 'it'
                WHEN x.device_type LIKE '%historian%' OR x.device_type LIKE '%scada%' OR y.device_type LIKE '%historian%'
                    OR lx.level = 3 OR ly.level = 3 THEN 'monitoring' ELSE 'operational' END AS classification
            FROM (SELECT DISTINCT src_ip, dst_ip, dst_port, protocol FROM cn{S}) f
            LEFT JOIN alrev{S} b USING (src_ip, dst_ip, dst_port, protocol)
            JOIN st{S} s ON s.src_ip = f.src_ip AND s.dst_ip = f.dst_ip AND s.port = f.dst_port AND s.protocol = f.protocol
            JOIN ass{S} x ON x.ip = f.src_ip JOIN ass{S} y ON y.ip = f.dst_ip
            JOIN lv{S} lx ON lx.ip = f.src_ip JOIN lv{S} ly ON ly.ip = f.dst_ip""",
        # segmentation
        "pf": """SELECT a.ip, a.vendor, a.device_type, CASE WHEN a.device_type <> 'unknown' THEN l.level END AS level, a.protocols,
            list_has_any(a.protocols, ['modbus','dnp3','ethernet_ip','s7comm','bacnet','iec104','profinet','hart_ip','ge_srtp','wonderware_suitelink']) AS is_ot,
            list_has_any(a.protocols, ['http','https','dns','ssh','rdp','snmp']) AS any_it,
            CASE WHEN a.device_type IN ('plc','rtu') THEN 'critical' WHEN a.device_type IN ('hmi','scada_server') THEN 'high'
                WHEN a.device_type = 'historian' THEN 'medium'
                WHEN list_has_any(a.protocols, ['modbus','dnp3','s7comm','ethernet_ip','bacnet','iec104','profinet']) THEN 'high'
                ELSE 'low' END AS criticality, d.m_role, d.d_role, d.e_role, d.s_role, d.b_role
            FROM ass{S} a JOIN lv{S} l USING (ip) LEFT JOIN dv{S} d USING (ip)""",
        "opw": """SELECT ip, m_writes_wide > 0 OR coalesce(e_assembly, FALSE) OR coalesce(b_out, FALSE) OR coalesce(b_notif, FALSE) AS w,
            coalesce(e_file, FALSE) OR coalesce(len(list_filter(s_funcs, lambda f: f LIKE '%download%' OR f LIKE '%upload%' OR f LIKE '%stop%')) > 0, FALSE) AS c
            FROM dv{S}""",
        "ob": """SELECT c.src_ip, c.src_port, c.dst_ip, c.dst_port, c.protocol, c.packet_count, c.byte_count, c.first_seen, c.last_seen,
            coalesce(p.per, FALSE) AS is_periodic, q.src_ip IS NOT NULL AS pattern_anomaly,
            coalesce(a.w, FALSE) OR coalesce(b.w, FALSE) AS w, coalesce(a.c, FALSE) OR coalesce(b.c, FALSE) AS cfg, TRUE AS listed,
            v.x IS NOT NULL AS t0886
            FROM cn{S} c
            LEFT JOIN (SELECT src_ip, dst_ip, port, bool_or(is_periodic) AS per FROM st{S} GROUP BY 1, 2, 3) p
                ON p.src_ip = c.src_ip AND p.dst_ip = c.dst_ip AND p.port = c.dst_port
            LEFT JOIN (SELECT DISTINCT src_ip, dst_ip, port FROM an{S}) q
                ON q.src_ip = c.src_ip AND q.dst_ip = c.dst_ip AND q.port = c.dst_port
            LEFT JOIN opw{S} a ON a.ip = c.src_ip LEFT JOIN opw{S} b ON b.ip = c.dst_ip
            LEFT JOIN pv{S} v ON v.x = least(c.src_ip, c.dst_ip) AND v.y = greatest(c.src_ip, c.dst_ip)""",
        "nb": """SELECT src_ip AS ip, dst_ip AS peer FROM cn{S} UNION SELECT dst_ip, src_ip FROM cn{S}""",
        "nbl": """SELECT ip, list(peer) AS peers FROM nb{S} GROUP BY ip""",
        "rl": """SELECT ip, level, criticality, coalesce(vendor, 'unknown') AS vendor, CASE
            WHEN level <= 1 THEN coalesce(list_filter(list_concat(
                list_filter([CASE WHEN m_role = 'slave' THEN 'Modbus' END, CASE WHEN d_role = 'outstation' THEN 'DNP3' END,
                    CASE WHEN e_role = 'adapter' THEN 'EtherNetIP' END, CASE WHEN s_role = 'server' THEN 'S7' END,
                    CASE WHEN b_role = 'server' THEN 'BACnet' END], lambda x: x IS NOT NULL),
                list_transform(protocols, lambda p: CASE p WHEN 'modbus' THEN 'Modbus' WHEN 'dnp3' THEN 'DNP3' WHEN 's7comm' THEN 'S7'
                    WHEN 'ethernet_ip' THEN 'EtherNetIP' WHEN 'iec104' THEN 'IEC104' WHEN 'profinet' THEN 'PROFINET'
                    WHEN 'bacnet' THEN 'BACnet' END)), lambda x: x IS NOT NULL)[1], 'Control')
            WHEN level = 2 THEN CASE WHEN ip IN (SELECT src_ip FROM ob{S} WHERE cfg UNION SELECT dst_ip FROM ob{S} WHERE cfg)
                THEN 'Engineering' ELSE 'HMI' END
            WHEN level = 3 THEN CASE WHEN is_ot AND any_it THEN 'DMZ' WHEN device_type LIKE '%historian%' OR list_contains(protocols, 'opc_ua')
                THEN 'Historian' WHEN device_type LIKE '%scada%' THEN 'SCADA' ELSE 'Operations' END
            ELSE CASE WHEN list_has_any(protocols, ['http','https']) THEN 'Web' WHEN list_has_any(protocols, ['rdp','ssh']) THEN 'RemoteAccess'
                ELSE 'IT' END END AS role
            FROM pf{S} WHERE level IS NOT NULL""",
        "gs": """SELECT grp, bool_and(sim < 0.3) AS split FROM (
            SELECT a.grp, a.vendor AS va, b.vendor AS vb, avg(len(list_intersect(x.peers, y.peers))
                / (len(x.peers) + len(y.peers) - len(list_intersect(x.peers, y.peers)))) AS sim
            FROM (SELECT *, 'L' || level || '-' || role AS grp FROM rl{S}) a
            JOIN (SELECT *, 'L' || level || '-' || role AS grp FROM rl{S}) b ON a.grp = b.grp AND a.vendor < b.vendor
            JOIN nbl{S} x ON x.ip = a.ip JOIN nbl{S} y ON y.ip = b.ip GROUP BY 1, 2, 3) GROUP BY grp""",
        "se": """SELECT a.ip AS a, b.ip AS b FROM (SELECT p.ip, n.peers FROM pf{S} p JOIN nbl{S} n USING (ip) WHERE p.level IS NULL) a,
            (SELECT p.ip, n.peers FROM pf{S} p JOIN nbl{S} n USING (ip) WHERE p.level IS NULL) b
            WHERE len(list_intersect(a.peers, b.peers)) / (len(a.peers) + len(b.peers) - len(list_intersect(a.peers, b.peers))) > 0.6""",
        "cr": """SELECT ip, ip AS member FROM pf{S} WHERE level IS NULL UNION SELECT c.ip, s.b FROM cr{S} c JOIN se{S} s ON s.a = c.member""",
        "cm": """SELECT ip, min(member) AS community FROM cr{S} GROUP BY ip""",
        "gm": """SELECT r.ip, CASE WHEN coalesce(g.split, FALSE) THEN 'L' || level || '-' || role || '-' || vendor ELSE 'L' || level || '-' || role END AS group_name,
            level, CASE WHEN level = 0 THEN 'sensor' WHEN level = 1 THEN 'plc' WHEN role = 'HMI' THEN 'hmi' WHEN role = 'Engineering'
                THEN 'engineering_station' WHEN role = 'DMZ' THEN 'dmz_gateway' WHEN role = 'Historian' THEN 'historian'
                WHEN level = 3 THEN 'scada_server' ELSE 'it_endpoint' END AS category, criticality
            FROM rl{S} r LEFT JOIN gs{S} g ON g.grp = 'L' || level || '-' || role
            UNION ALL SELECT c.ip, 'Unclassified-' || c.community, NULL,
                CASE WHEN bool_or(near) OVER (PARTITION BY c.community) THEN 'network_infra' ELSE 'unknown' END, p.criticality
            FROM (SELECT *, ip IN (SELECT n.ip FROM nb{S} n JOIN pf{S} q ON q.ip = n.peer WHERE q.is_ot) AS near FROM cm{S}) c
            JOIN pf{S} p USING (ip)""",
        "gt": """SELECT group_name, level, category, CASE WHEN level <= 1 THEN 'sl3' WHEN level IN (2, 3) THEN 'sl2' ELSE 'sl1' END AS security_level,
            CASE max(CASE criticality WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END)
                WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'unknown' END AS criticality,
            count(*) AS member_count FROM gm{S} GROUP BY group_name, level, category""",
        "zg": """SELECT group_name, member_count, CASE WHEN category = 'dmz_gateway' THEN 'DMZ Zone' WHEN level <= 1 THEN 'Control Zone'
            WHEN level = 2 THEN 'Supervisory Zone' WHEN level = 3 THEN 'Operations Zone' WHEN level >= 4 THEN 'Enterprise Zone'
            ELSE 'Unclassified Zone' END AS zone FROM gt{S}""",
        "zn": """SELECT zone, CASE zone WHEN 'Control Zone' THEN 'sl3' WHEN 'Supervisory Zone' THEN 'sl2' WHEN 'Operations Zone' THEN 'sl2'
            WHEN 'DMZ Zone' THEN 'sl2' ELSE 'sl1' END AS security_level,
            CASE zone WHEN 'Control Zone' THEN 0 WHEN 'Supervisory Zone' THEN 2 WHEN 'Operations Zone' THEN 3 WHEN 'DMZ Zone' THEN 35
            WHEN 'Enterprise Zone' THEN 4 END AS low, count(*) AS group_count, CAST(sum(member_count) AS BIGINT) AS asset_count
            FROM zg{S} GROUP BY zone""",
        "iz": """SELECT p.ip, z.zone FROM pf{S} p JOIN zn{S} z ON z.zone = CASE WHEN p.level IS NULL THEN 'Unclassified Zone'
            WHEN p.level <= 1 THEN 'Control Zone' WHEN p.level = 2 THEN 'Supervisory Zone' WHEN p.level = 3 THEN 'Operations Zone'
            ELSE 'Enterprise Zone' END""",
        "oz": """SELECT o.*, a.zone AS src_zone, b.zone AS dst_zone FROM ob{S} o LEFT JOIN iz{S} a ON a.ip = o.src_ip
            LEFT JOIN iz{S} b ON b.ip = o.dst_ip""",
        "mx": """SELECT src_zone, dst_zone, protocol, dst_port, CAST(sum(packet_count) AS BIGINT) AS packet_count,
            count(DISTINCT src_ip) AS src_count, count(DISTINCT dst_ip) AS dst_count, min(first_seen) AS first_seen, max(last_seen) AS last_seen,
            CASE WHEN bool_or(cfg) THEN 'high' WHEN bool_or(w) THEN 'medium' ELSE 'low' END AS risk, bool_or(t0886) AS t0886
            FROM oz{S} WHERE src_zone <> dst_zone GROUP BY src_zone, dst_zone, protocol, dst_port""",
    }


def site_ctes(suffix: str) -> dict[str, str]:
    """CTE name → SQL for the tables of a site with this name suffix."""
    out = {}
    for name, sql in _ctes().items():
        for key, value in SQL_SETS.items():
            sql = sql.replace("{" + key + "}", value)
        out[name + suffix] = sql.replace("{S}", suffix)
    return out
