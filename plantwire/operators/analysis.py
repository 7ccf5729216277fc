"""Anomalies, Purdue levels, malware patterns, switch checks and the full run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import columns as X
from ..functions.scale import global_rank
from . import attack_rules as R
from .attack_rules import MASTER, _union
from .findings import Snapshot, attack, context_of, finding, severity_rank, text

# --- anomalies: each returns (anomalies, findings) ---------------------------------


def _anomaly(rows: DataFrame, kind: str, severity, confidence, asset: str, evidence: Column) -> DataFrame:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return rows.select(
        F.lit(kind).alias("anomaly_type"), as_col(severity).alias("severity"),
        as_col(confidence).cast("double").alias("confidence"), F.col(asset).alias("affected_asset"),
        evidence.alias("evidence"),
    )


def polling_deviation(polling: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Polling whose range exceeds half of its average; a finding above the average."""
    spread = (F.col("max_interval_ms") - F.col("min_interval_ms")) / F.col("avg_interval_ms")
    rows = polling.filter("sample_count >= 5 AND avg_interval_ms > 0").withColumn("cv", spread).filter("cv > 0.5")
    severity = F.when(F.col("cv") > 2.0, "high").otherwise("medium")
    confidence = F.when(F.col("cv") > 2.0, 0.9).when(F.col("cv") > 1.0, 0.7).otherwise(0.5)
    what = text("to %s, FC %d, unit %d, %d samples", "remote_ip", "function_code", "unit_id", "sample_count")
    found = finding(
        rows.filter("cv > 1.0"), "anomaly", severity,
        text("Irregular polling interval from %s to %s (FC %d, unit %d)", "ip", "remote_ip", "function_code", "unit_id"),
        what, None, "ip", "remote_ip",
    )
    return _anomaly(rows, "polling_deviation", severity, confidence, "ip", what), found


def _reversed_slaves(devices: DataFrame) -> DataFrame:
    return devices.filter("modbus.role = 'slave' AND modbus.master_code_count > 0").select(
        "ip", F.col("modbus.master_code_count").alias("n")
    )


def reversal_anomalies(devices: DataFrame) -> DataFrame:
    stations = devices.filter(
        "dnp3.role = 'outstation' AND dnp3.has_unsolicited AND dnp3.master_code_count > 0"
    ).select("ip", F.col("dnp3.master_code_count").alias("n"))
    codes = text("%d master function codes", "n")
    return _union(
        _anomaly(_reversed_slaves(devices), "role_reversal", "high", 0.8, "ip", codes),
        _anomaly(stations, "role_reversal", "high", 0.7, "ip", codes),
    )


def role_reversal(s: Snapshot) -> tuple[DataFrame, DataFrame]:
    slaves, codes = _reversed_slaves(s.devices), text("%d master function codes", "n")
    return reversal_anomalies(s.devices), finding(slaves, "anomaly", "high", text("Modbus role reversal: slave %s acting as master", "ip"),
                              codes, None, "ip")


def unexpected_public_ip(assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = assets.filter(F.col("is_public_ip") & X.has_any(F.col("protocols"), C.OT_PROTOCOLS))
    spoken = F.array_join("protocols", ", ")
    return (
        _anomaly(rows, "unexpected_public_ip", "critical", 0.95, "ip_address", spoken),
        finding(rows, "anomaly", "critical", text("Public IP on OT network: %s", "ip_address"), spoken, None, "ip_address"),
    )


# --- Purdue levels --------------------------------------------------------------------


def level_of() -> Column:
    """Level and reason of a row with the columns of an asset, its device details, ot_targets and served."""
    kind = F.col("device_type")
    ot = F.array_intersect("protocols", F.array(*[F.lit(p) for p in C.OT_PROTOCOLS]))
    targets, served = F.coalesce("ot_targets", F.lit(0)), F.coalesce("served", F.lit(0))

    def to(level, reason) -> Column:
        level = level if isinstance(level, Column) else F.lit(level)
        reason = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(level.cast("int").alias("level"), reason.alias("reason"))

    def role(protocol: str) -> Column:
        return F.col(f"{protocol}.role")

    return (
        F.when(F.col("purdue_level").isNotNull(), to(F.col("purdue_level"), "manual"))
        .when(kind.isin("plc", "rtu"), to(1, F.concat(F.lit("device type "), kind)))
        .when(kind.isin("hmi", "engineering_workstation"), to(2, F.concat(F.lit("device type "), kind)))
        .when(kind.isin("historian", "scada_server"), to(3, F.concat(F.lit("device type "), kind)))
        .when(served > 0, to(1, "serves an OT port"))
        .when(F.array_contains(ot, "opc_ua"), to(3, "uses OPC UA"))
        .when(targets >= 10, to(3, text("%d OT client connections", targets.cast("bigint"))))
        .when((F.size(ot) >= 2) | (targets >= 2),
              to(2, text("%d OT protocols, %d OT client connections", F.size(ot), targets.cast("bigint"))))
        .when(F.size(ot) > 0, to(2, F.concat(F.lit("OT client of "), F.array_join(ot, ", "))))
        .when(F.col("modbus").isNotNull() | F.col("dnp3").isNotNull(), to(2, "decoded OT messages"))
        .when(role("ethernet_ip") == "adapter", to(1, "EtherNet/IP adapter"))
        .when(F.col("ethernet_ip").isNotNull(), to(2, "EtherNet/IP scanner"))
        .when(role("s7comm") == "server", to(1, "S7 server"))
        .when(F.col("s7comm").isNotNull(), to(2, "S7 client"))
        .when(role("bacnet") == "server", to(1, "BACnet server"))
        .when(F.col("bacnet").isNotNull(), to(2, "BACnet client"))
        .when(role("iec104") == "outstation", to(1, "IEC 104 outstation"))
        .when(F.col("iec104").isNotNull(), to(2, "IEC 104 master"))
        .when(role("profinet") == "io_device", to(1, "PROFINET device"))
        .when(role("profinet").isin("io_controller", "io_supervisor"), to(2, F.concat(F.lit("PROFINET "), role("profinet"))))
        .otherwise(to(4, "no OT activity"))
    )


def purdue_assign(s: Snapshot) -> DataFrame:
    """Level and reason per asset by an ordered decision list.

    Client connections count as rows, not as distinct hosts.
    """
    ends = F.explode(
        F.array(
            F.struct(F.col("src_ip").alias("ip_address"), F.lit(True).alias("client")),
            F.struct(F.col("dst_ip").alias("ip_address"), F.lit(False).alias("client")),
        )
    )
    counts = (
        s.connections.filter(F.col("dst_port").isin(*C.L1_SERVER_PORTS)).select(ends.alias("e"))
        .groupBy("e.ip_address")
        .agg(F.count_if("e.client").alias("ot_targets"), F.count_if(~F.col("e.client")).alias("served"))
    )
    detail = s.devices.select(
        F.col("ip").alias("ip_address"), "modbus", "dnp3", "ethernet_ip", "s7comm", "bacnet", "iec104", "profinet"
    )
    rows = s.assets.join(counts, "ip_address", "left").join(detail, "ip_address", "left")
    method = F.when(F.col("purdue_level").isNotNull(), "manual").otherwise("auto")
    return rows.select("ip_address", level_of().alias("p"), method.alias("method")).select(
        "ip_address", "p.level", "method", "p.reason"
    )


def apply_levels(assets: DataFrame, assignments: DataFrame) -> DataFrame:
    """Write automatic levels back to assets without one."""
    auto = assignments.select("ip_address", F.col("level").alias("_level"))
    return assets.join(auto, "ip_address", "left").withColumn(
        "purdue_level", F.coalesce("purdue_level", "_level")
    ).drop("_level")


def purdue_violations(conns: DataFrame, assignments: DataFrame) -> DataFrame:
    """L0–1 with L4+ (medium) and L2 with L4+ (low), one finding per unordered pair."""
    levels = assignments.select("ip_address", "level")
    flows = conns.groupBy("src_ip", "dst_ip").agg(
        F.min("dst_port").alias("dst_port"), F.sum("packet_count").alias("packet_count")
    )
    a = levels.select(F.col("ip_address").alias("src_ip"), F.col("level").alias("src_level"))
    b = levels.select(F.col("ip_address").alias("dst_ip"), F.col("level").alias("dst_level"))
    low, high = F.least("src_level", "dst_level"), F.greatest("src_level", "dst_level")
    severity = F.when((low <= 1) & (high >= 4), "medium").when((low == 2) & (high >= 4), "low")
    rows = (
        flows.join(a, "src_ip").join(b, "dst_ip").withColumn("severity", severity).filter("severity IS NOT NULL")
        .groupBy(F.least("src_ip", "dst_ip").alias("x"), F.greatest("src_ip", "dst_ip").alias("y"))
        .agg(F.max(F.struct(severity_rank().alias("r"), "severity", low.alias("low"), high.alias("high"))).alias("m"),
             F.sum("packet_count").alias("packet_count"))
        .select("x", "y", "m.severity", "m.low", "m.high", "packet_count")
    )
    return finding(rows, "purdue_violation", F.col("severity"),
                   text("Cross-zone communication: L%d with L%d (%s, %s)", "low", "high", "x", "y"),
                   text("%d packets between the levels", "packet_count"), "T0886", "x", "y")


# --- malware behaviour -----------------------------------------------------------------


def _malware(rows: DataFrame, name: str, confidence: str, severity: str, source: str, evidence: Column, *techniques: str):
    return rows.select(
        F.lit(name).alias("malware_name"), F.lit(confidence).alias("confidence"), F.lit(severity).alias("severity"),
        F.col(source).alias("source_ip"), F.col("targets").cast("bigint").alias("target_count"),
        F.lit(",".join(techniques)).alias("techniques"), evidence.alias("evidence"),
    )


def malware_write_only_master(s: Snapshot) -> DataFrame:
    ctx = context_of(s)
    writers = s.devices.filter(F.col("modbus.role").isin(*MASTER) & (F.col("modbus.write_count") >= 3)).select(
        F.col("ip").alias("src_ip"), F.col("modbus.write_count").alias("n")
    )
    targets = ctx["write_targets"].groupBy("src_ip").agg(F.count("*").alias("targets"))
    rows = (
        writers.join(ctx["read_targets"], "src_ip", "left_anti").join(targets, "src_ip", "left")
        .withColumn("targets", F.coalesce("targets", F.lit(0)))
    )
    return _malware(rows, "FrostyGoop", "medium", "high", "src_ip",
                    text("%d write commands, no read targets", "n"), "T0855", "T0831")


def malware_multi_protocol(s: Snapshot) -> DataFrame:
    """Sources of three or more OT protocols; CODESYS access by a non-OT source that also
    speaks OT protocols."""
    ics = s.connections.filter(F.col("protocol").isin(*C.ICS_PROTOCOLS))
    many = (
        ics.groupBy("src_ip")
        .agg(F.array_sort(F.collect_set("protocol")).alias("protocols"), F.countDistinct("dst_ip").alias("targets"))
        .filter(F.size("protocols") >= 3)
    )
    codesys = s.connections.filter(F.col("dst_port") == C.CODESYS_PORT).groupBy("src_ip").agg(
        F.countDistinct("dst_ip").alias("targets")
    )
    ot = context_of(s)["ot_ips"].withColumnRenamed("ip_address", "src_ip")
    runtime = codesys.join(ics.select("src_ip"), "src_ip", "left_semi").join(ot, "src_ip", "left_anti")
    name = "PIPEDREAM/INCONTROLLER"
    return _union(
        _malware(many, name, "high", "critical", "src_ip", F.array_join("protocols", ", "), "T0846", "T0855", "T0843"),
        _malware(runtime, name, "medium", "high", "src_ip", F.lit("CODESYS runtime port 2455"), "T0843", "T0846"),
    )


def malware_iec104_burst(s: Snapshot) -> DataFrame:
    commanders = s.devices.filter("iec104.has_control_commands").select(
        F.col("ip").alias("src_ip"), F.col("iec104.has_reset_process").alias("reset")
    )
    targets = (
        s.connections.filter((F.col("dst_port") == 2404) | (F.col("protocol") == "iec104"))
        .groupBy("src_ip").agg(F.countDistinct("dst_ip").alias("targets"))
    )
    rows = commanders.join(targets, "src_ip")
    return _union(
        _malware(rows.filter("targets >= 2"), "Industroyer2", "high", "critical", "src_ip",
                 text("control commands to %d outstations", "targets"), "T0855", "T0831"),
        _malware(rows.filter("targets = 1 AND reset"), "Industroyer2", "low", "high", "src_ip",
                 F.lit("control commands and a process reset"), "T0816", "T0831"),
    )


# --- switches ------------------------------------------------------------------------------


def switch_security(
    assets: DataFrame, vlans: DataFrame, redundancy: DataFrame, credential_matches: DataFrame
) -> DataFrame:
    """Layer-2 checks. ``vlans``: vlan_id rows seen; ``redundancy``: protocol,
    topology_change; ``credential_matches``: ip_address of devices with known defaults."""
    kind = F.lower("device_type")
    switches = assets.filter(kind.isin(*C.SWITCH_TYPES))
    facts = assets.agg(
        F.count_if(kind.isin(*C.SWITCH_TYPES)).alias("switches"),
        F.count_if(kind.isin(*C.SWITCH_RULE_OT_TYPES)).alias("ot_devices"),
    )
    facts = (
        facts.withColumn("vlans", vlans.agg(F.countDistinct("vlan_id")).scalar())
        .withColumn("vlan1", vlans.agg(F.count_if(F.col("vlan_id") == 1)).scalar())
        .withColumn("ring", redundancy.agg(F.count("*")).scalar())
        .withColumn("changes", redundancy.agg(F.count_if("topology_change")).scalar())
        .withColumn(
            "defaults",
            credential_matches.select("ip_address").distinct()
            .join(switches.select("ip_address"), "ip_address", "left_semi").agg(F.count("*")).scalar(),
        )
    )

    def site(cond: str, severity: str, title: str, evidence: Column) -> Column:
        return F.when(
            F.expr(cond),
            F.struct(F.lit(severity).alias("severity"), F.lit(title).alias("title"), evidence.alias("evidence"),
                     F.lit("").alias("ip_address")),
        )

    rules = F.array_compact(F.array(
        site("ot_devices >= 3 AND vlans <= 1", "high", "Flat Layer-2 network",
             text("%d OT devices, %d VLANs", "ot_devices", "vlans")),
        site("vlan1 > 0", "medium", "Default VLAN in use", F.lit("VLAN 1 seen")),
        site("ring = 0 AND switches > 0", "medium", "No redundancy protocol", text("%d switches", "switches")),
        site("changes > 0", "medium", "Topology change notification", F.lit("redundancy topology changed")),
        site("defaults > 0", "critical", "Default credentials on switches", text("%d switches", "defaults")),
    ))
    site_rows = facts.select(F.explode(rules).alias("r")).select("r.*")
    mixed = F.array_contains("protocols", "telnet") & X.has_any(F.col("protocols"), ("ssh", "https"))
    per_switch = switches.filter(mixed).select(
        F.lit("medium").alias("severity"), F.lit("Insecure and secure management together").alias("title"),
        F.lit("telnet next to ssh or https").alias("evidence"), "ip_address",
    )
    return site_rows.unionByName(per_switch)


def switch_findings(rows: DataFrame) -> DataFrame:
    """Switch checks as findings, for the compliance report."""
    return finding(rows, "attack_technique", F.col("severity"), F.col("title"), F.col("evidence"), None, "ip_address")


def credential_findings(matches: DataFrame) -> DataFrame:
    rows = matches.groupBy("ip_address").agg(F.count("*").alias("n"))
    return finding(rows, "attack_technique", "critical", text("Default credential match on %s", "ip_address"),
                   text("%d matching entries", "n"), None, "ip_address")


# --- the full run -----------------------------------------------------------------------------


def attack_findings(s: Snapshot, servers: DataFrame, seen: DataFrame, io_writes: int = 500) -> DataFrame:
    return _union(
        R.t0855_modbus_writes(s), R.t0814_modbus_diagnostics(s), R.t0856_dnp3_unsolicited(s),
        R.t0846_remote_discovery(s), R.enip_rules(s), R.s7_rules(s), R.bacnet_rules(s), R.iec104_rules(s),
        R.flat_network(s.assets), R.cleartext_ot(s.connections), R.internet_exposed_ot(s.assets),
        R.t0822_external_remote(s), R.t0867_lateral_transfer(s), R.t0885_uncommon_port(s.connections),
        R.t0849_masquerading(s.connections), R.t0868_operating_mode(s), R.t0806_brute_force_io(s, io_writes),
        R.t0802_automated_collection(s), R.t0861_point_tag_scan(s), R.t0840_connection_enumeration(s),
        R.t0803_block_command(s), R.t0804_block_reporting(s), R.t0881_service_stop(s, servers),
        R.t0864_transient_asset(s, seen), R.t0830_aitm(s), R.t0884_connection_proxy(s),
        R.t0866_remote_exploitation(s), R.t0800_firmware_mode(s), R.t0801_monitor_state(s),
    )


def run_full_analysis(s: Snapshot, servers: DataFrame, seen: DataFrame, io_writes: int = 500) -> dict[str, DataFrame]:
    """All rules over one snapshot: findings, assignments and anomalies.

    Pass ``snapshot.staged()`` so that the rules share written tables.
    """
    assignments = purdue_assign(s)
    poll_a, poll_f = polling_deviation(s.polling)
    role_a, role_f = role_reversal(s)
    pub_a, pub_f = unexpected_public_ip(s.assets)
    findings = _union(
        attack_findings(s, servers, seen, io_writes), purdue_violations(s.connections, assignments), poll_f, role_f, pub_f
    )
    return {
        "findings": findings,
        "assignments": assignments,
        "anomalies": _union(poll_a, role_a, pub_a),
    }


def analysis_summary(findings: DataFrame, anomalies: DataFrame, assets: DataFrame, conns: DataFrame) -> DataFrame:
    ot = F.sum(F.when(X.is_ot(F.col("protocol")), F.col("packet_count")))
    encrypted = F.sum(F.when(F.col("protocol").isin("https", "ssh"), F.col("packet_count")))
    share = conns.agg(
        F.coalesce(ot, F.lit(0)).alias("ot"), F.coalesce(encrypted, F.lit(0)).alias("enc"), F.count("*").alias("n")
    ).select(
        F.when(F.col("ot") > 0, F.round(F.greatest(F.col("ot") - F.col("enc"), F.lit(0)) * 100.0 / F.col("ot"), 1))
        .otherwise(F.lit(0.0)).alias("pct"), "n",
    )
    per = [F.count_if(F.col("severity") == v).alias(f"{v}_count") for v in ("critical", "high", "medium", "low", "info")]
    return (
        findings.agg(
            F.count("*").alias("total_findings"), *per,
            F.count_if(F.col("finding_type") == "purdue_violation").alias("purdue_violations"),
        )
        .withColumn("anomaly_count", anomalies.agg(F.count("*")).scalar())
        .withColumn("assets_analyzed", assets.agg(F.count("*")).scalar())
        .withColumn("connections_analyzed", share.select("n").scalar())
        .withColumn("unencrypted_ot_percent", share.select("pct").scalar())
    )


def top_findings(findings: DataFrame, n: int | None = None) -> DataFrame:
    """Findings by severity, as the report shows them: all, or the first ``n``."""
    ordered = findings.orderBy(severity_rank().desc(), "id")
    return ordered if n is None else ordered.limit(n)


def top_anomalies(anomalies: DataFrame, n: int | None = None) -> DataFrame:
    """Anomalies by severity and confidence: all, or the first ``n``."""
    ordered = anomalies.orderBy(
        severity_rank().desc(), F.desc("confidence"), "anomaly_type", "affected_asset", "evidence"
    )
    return ordered if n is None else ordered.limit(n)


def advice(technique: Column, title: Column) -> Column:
    out = F.lit(C.ADVICE_DEFAULT)
    for word, tip in reversed(C.ADVICE_BY_TITLE):
        out = F.when(F.lower(title).contains(word), F.lit(tip)).otherwise(out)
    for code, tip in C.ADVICE_BY_TECHNIQUE.items():
        out = F.when(technique == code, F.lit(tip)).otherwise(out)
    return out


def remediation_list(findings: DataFrame) -> DataFrame:
    """Findings ranked by severity with advice; ties rank by id."""
    ranked = global_rank(findings, -severity_rank(), "id")
    return ranked.withColumn("remediation", advice(F.col("technique_id"), F.col("title")))
