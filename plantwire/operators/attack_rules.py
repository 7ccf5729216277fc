"""Attack-technique rules over device details, assets and connections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import columns as X
from .findings import Snapshot, attack, context_of, flag, text, with_type

MASTER = ("master", "both")


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _first_per(rows: DataFrame, keys: list[str], *rest: str) -> DataFrame:
    """One row per key, the smallest of the rest, with the packets of all its rows."""
    return (
        rows.groupBy(*keys)
        .agg(F.min(F.struct(*rest)).alias("_r"), F.sum("packet_count").alias("packet_count"))
        .select(*keys, "_r.*", "packet_count")
    )


def _flags_to_rows(table: DataFrame, *rules: tuple[Column, dict]) -> DataFrame:
    """Explode the rules a row breaks: one scan for any number of boolean rules."""
    names = ("severity", "title", "evidence", "technique")
    hits = F.array_compact(
        F.array(
            *[
                F.when(cond, F.struct(*[(F.lit(spec[n]) if isinstance(spec[n], str) else spec[n]).alias(n) for n in names]))
                for cond, spec in rules
            ]
        )
    )
    return table.select("ip", F.explode(hits).alias("h")).select("ip", "h.*")


def _attack_rows(rows: DataFrame) -> DataFrame:
    """Findings from rows (ip, severity, title, evidence, technique)."""
    shaped = rows.select(
        F.lit("attack_technique").alias("finding_type"), "severity", "title", F.col("technique").alias("technique_id"),
        F.array("ip").alias("affected_assets"), "evidence",
    )
    key = [F.col(c) for c in ("finding_type", "technique_id", "title")] + [F.array_join("affected_assets", ",")]
    return shaped.withColumn("id", X.natural_id(*key))


def _rule(severity: str, technique: str, title: Column, evidence: Column) -> dict:
    return {"severity": severity, "technique": technique, "title": title, "evidence": evidence}


def t0855_modbus_writes(s: Snapshot) -> DataFrame:
    masters = s.devices.filter(F.col("modbus.role").isin(*MASTER) & (F.col("modbus.write_count") > 0))
    broadcast_ids = F.filter("modbus.unit_ids", lambda u: u.isin(0, 255))
    wide = masters.filter(F.size(broadcast_ids) > 0).select(
        "ip", F.col("modbus.write_count").alias("n"), F.array_join(broadcast_ids, ",").alias("units")
    )
    fan = s.modbus_peers.filter("remote_role = 'slave'").groupBy("ip").agg(F.count("*").alias("targets"))
    fan = fan.filter("targets >= 5").join(masters.select("ip"), "ip", "left_semi")
    return _union(
        attack(wide, "critical", text("Modbus broadcast write from %s", "ip"),
               text("%d write commands, broadcast unit ids %s", "n", "units"), "T0855", "ip"),
        attack(fan, "high", text("High fan-out Modbus writes from %s", "ip"),
               text("writes to %d slaves", "targets"), "T0855", "ip"),
    )


def t0814_modbus_diagnostics(s: Snapshot) -> DataFrame:
    used = s.devices.filter(F.col("modbus.diagnostic_count") > 0).select(
        "ip", F.col("modbus.diagnostic_count").alias("n")
    )
    rows = with_type(used, s.assets, "ip").filter("device_type <> 'engineering_workstation'")
    return attack(rows, "high", text("Modbus diagnostics (FC 8) from non-engineer: %s", "ip"),
                  text("type %s sent %d diagnostic commands", "device_type", "n"), "T0814", "ip")


def t0856_dnp3_unsolicited(s: Snapshot) -> DataFrame:
    senders = s.devices.filter(F.col("dnp3.has_unsolicited")).select("ip")
    masters = s.devices.filter(F.col("dnp3.role").isin(*MASTER)).select(F.col("ip").alias("remote_ip"))
    strange = (
        s.dnp3_peers.filter("remote_role = 'master'")
        .join(senders, "ip", "left_semi").join(masters, "remote_ip", "left_anti")
        .groupBy("ip").agg(F.count("*").alias("targets"))
    )
    known = masters.agg(F.count("*")).scalar()
    alone = senders.filter(known == 0)
    return _union(
        attack(strange, "medium", text("DNP3 unsolicited response from %s to unknown master", "ip"),
               text("%d unknown masters", "targets"), "T0856", "ip"),
        attack(alone, "medium", text("DNP3 unsolicited response with no known masters: %s", "ip"),
               text("%s sends unsolicited responses", "ip"), "T0856", "ip"),
    )


def t0846_remote_discovery(s: Snapshot) -> DataFrame:
    probes = s.connections.filter(F.col("dst_port").isin(*C.OT_PORTS)).select("src_ip", "dst_ip").distinct()
    rows = (
        with_type(probes.groupBy("src_ip").agg(F.count("*").alias("targets")).filter("targets >= 3"), s.assets, "src_ip")
        .filter(F.col("device_type").isin(*C.UNCLASSIFIED_TYPES))
    )
    return attack(rows, "high", text("Unknown device %s polling %d PLCs/RTUs", "src_ip", "targets"),
                  text("reached OT ports of %d hosts", "targets"), "T0846", "src_ip")


def _unclassified() -> Column:
    return F.col("device_type").isin(*C.UNCLASSIFIED_TYPES)


def enip_rules(s: Snapshot) -> DataFrame:
    rows = with_type(s.devices.filter("ethernet_ip IS NOT NULL").select("ip", "ethernet_ip.*"), s.assets, "ip")
    return _attack_rows(_flags_to_rows(
        rows,
        (F.col("cip_writes_to_assembly"), _rule("high", "T0855", text("CIP write to Assembly object from %s", "ip"),
                                                text("%s wrote to class 0x04", "ip"))),
        (F.col("cip_file_access"), _rule("critical", "T0836", text("CIP File class access from %s", "ip"),
                                         text("%s used class 0x37", "ip"))),
        (F.col("list_identity_requests") & _unclassified(),
         _rule("medium", "T0846", text("EtherNet/IP ListIdentity from non-OT device %s", "ip"),
               text("%s has type %s", "ip", "device_type"))),
    ))


def s7_rules(s: Snapshot) -> DataFrame:
    rows = s.devices.filter("s7comm IS NOT NULL").select("ip", F.col("s7comm.functions_seen").alias("seen"))

    def used(name: str) -> Column:
        return F.array_contains("seen", name)

    return _attack_rows(_flags_to_rows(
        rows,
        (used("download_start"), _rule("critical", "T0843", text("S7 program download from %s", "ip"),
                                       F.lit("function 0x1D"))),
        (used("upload_start"), _rule("high", "T0845", text("S7 program upload from %s", "ip"), F.lit("function 0x1A"))),
        (used("plc_stop"), _rule("critical", "T0816", text("S7 PLC Stop command from %s", "ip"),
                                 F.lit("function 0x29"))),
        (used("pi_service"), _rule("critical", "T0809", text("S7 PI Service (possible block delete) from %s", "ip"),
                                   F.lit("function 0x28"))),
        (used("write_var"), _rule("high", "T0855", text("S7 Write Var command from %s", "ip"),
                                  F.lit("function 0x05"))),
    ))


def iec104_rules(s: Snapshot) -> DataFrame:
    rows = with_type(s.devices.filter("iec104 IS NOT NULL").select("ip", "iec104.*"), s.assets, "ip")
    return _attack_rows(_flags_to_rows(
        rows,
        (F.col("has_control_commands"), _rule("high", "T0855", text("IEC 104 control commands from %s", "ip"),
                                              F.lit("command type ids seen"))),
        (F.col("has_reset_process"), _rule("critical", "T0816", text("IEC 104 Reset Process command from %s", "ip"),
                                           F.lit("type id 105 seen"))),
        (F.col("has_interrogation") & _unclassified(),
         _rule("medium", "T0814", text("IEC 104 interrogation from non-OT device %s", "ip"),
               text("%s has type %s", "ip", "device_type"))),
    ))


def bacnet_rules(s: Snapshot) -> DataFrame:
    rows = s.devices.filter("bacnet IS NOT NULL").select("ip", "bacnet.*")
    return _attack_rows(_flags_to_rows(
        rows,
        (F.col("write_to_output"), _rule("high", "T0855", text("BACnet WriteProperty to output object from %s", "ip"),
                                         F.lit("analog or binary output written"))),
        (F.col("write_to_notification_class"), _rule("high", "T0856", text("BACnet alarm suppression from %s", "ip"),
                                                     F.lit("notification class written"))),
        (F.col("reinitialize_device"), _rule("high", "T0816", text("BACnet ReinitializeDevice from %s", "ip"),
                                             F.lit("reinitialize requested"))),
        (F.col("device_communication_control"),
         _rule("high", "T0811", text("BACnet DeviceCommunicationControl from %s", "ip"),
               F.lit("communication control requested"))),
    ))


def flat_network(assets: DataFrame) -> DataFrame:
    total = assets.agg(F.count("*")).scalar()
    counts = assets.groupBy(X.subnet24(F.col("ip_address")).alias("subnet")).agg(
        F.count("*").alias("n"), F.min("ip_address").alias("first_ip")
    )
    rows = counts.withColumn("total", total).filter("total >= 6 AND n > 5 AND n > 0.8 * total")
    return attack(rows, "high", text("Flat network detected: %d of %d devices on %s", "n", "total", "subnet"),
                  text("no segmentation inside %s", "subnet"), "T0886")


def cleartext_ot(conns: DataFrame) -> DataFrame:
    """At most one finding: the share of OT packets sent in clear."""
    clear = F.col("dst_port").isin(*C.CLEARTEXT_OT_PORTS)
    tls = (F.col("protocol") == "opc_ua") & (F.col("dst_port") == C.OPC_UA_TLS_PORT)
    per_protocol = conns.filter(clear | tls).groupBy("protocol").agg(
        F.sum(F.when(clear, F.col("packet_count"))).alias("clear"), F.sum("packet_count").alias("all")
    )
    label = F.when(F.col("clear") > 0, F.concat("protocol", F.lit(": "), F.col("clear").cast("string")))
    # One row per protocol at most, so the breakdown stays short.
    totals = per_protocol.agg(
        F.sum("clear").alias("clear"), F.sum("all").alias("all"),
        F.array_join(F.array_sort(F.collect_list(label)), ", ").alias("breakdown"),
    ).filter("clear > 0")
    severity = (
        F.when(F.col("clear") >= 0.99 * F.col("all"), "high").when(F.col("clear") >= 0.5 * F.col("all"), "medium")
        .otherwise("low")
    )
    percent = F.round(F.col("clear") * 100.0 / F.col("all"), 0).cast("int")
    return attack(totals, severity, text("%d%% of OT traffic is unencrypted", percent),
                  text("%d of %d packets in clear; %s", "clear", "all", "breakdown"), None)


def internet_exposed_ot(assets: DataFrame) -> DataFrame:
    spoken = F.array_intersect("protocols", F.array(*[F.lit(p) for p in C.EXPOSED_PROTOCOLS]))
    rows = assets.filter("is_public_ip").withColumn("spoken", F.array_join(spoken, ",")).filter("spoken <> ''")
    return attack(rows, "critical", text("Internet-exposed OT device: %s", "ip_address"),
                  text("public address speaks %s", "spoken"), "T0846", "ip_address")


# --- rules that need the capture context ---------------------------------------------


def _service(port: Column) -> Column:
    name = F.when(port.isin(*C.VNC_PORTS), "VNC")
    for number, label in C.REMOTE_SERVICE_NAMES.items():
        name = name.when(port == number, label)
    return name.otherwise("remote access")


def t0822_external_remote(s: Snapshot) -> DataFrame:
    remote = s.connections.filter(F.col("dst_port").isin(*C.REMOTE_ACCESS_PORTS))
    ot = context_of(s)["ot_ips"].withColumnRenamed("ip_address", "src_ip")
    rows = (
        remote.groupBy("src_ip", "dst_ip", "dst_port").agg(F.sum("packet_count").alias("packet_count"))
        .join(ot, "src_ip", "left_semi").withColumn("service", _service(F.col("dst_port")))
    )
    return attack(rows, "high", text("OT device %s accessing %s (port %d)", "src_ip", "service", "dst_port"),
                  text("to %s, %d packets", "dst_ip", "packet_count"), "T0822", "src_ip", "dst_ip")


def t0867_lateral_transfer(s: Snapshot) -> DataFrame:
    moved = s.connections.filter(F.col("dst_port").isin(*C.FILE_TRANSFER_PORTS))
    pairs = _first_per(moved, ["src_ip", "dst_ip"], "dst_port")
    ot = context_of(s)["ot_ips"]
    rows = flag(flag(pairs, ot, "src_ip", "a"), ot, "dst_ip", "b").filter("a OR b")
    name = F.when(F.col("dst_port") == 21, "FTP").otherwise("TFTP")
    return attack(rows, "high", text("%s file transfer involving OT device: %s to %s", name, "src_ip", "dst_ip"),
                  text("port %d, %d packets", "dst_port", "packet_count"), "T0867", "src_ip", "dst_ip")


def t0885_uncommon_port(conns: DataFrame) -> DataFrame:
    """A known OT protocol with neither port canonical, once per (src, protocol, port)."""
    odd = F.lit(False)
    for protocol, ports in C.CANONICAL_PORTS.items():
        odd = odd | (
            (F.col("protocol") == protocol) & ~F.col("dst_port").isin(*ports) & ~F.col("src_port").isin(*ports)
        )
    rows = _first_per(conns.filter(odd), ["src_ip", "protocol", "dst_port"], "dst_ip")
    return attack(rows, "medium", text("%s on non-standard port %d (%s to %s)", "protocol", "dst_port", "src_ip", "dst_ip"),
                  text("%d packets", "packet_count"), "T0885", "src_ip", "dst_ip")


def t0849_masquerading(conns: DataFrame) -> DataFrame:
    """An office protocol on a canonical OT port, once per (src, protocol, port)."""
    expected = F.lit(None).cast("string")
    for port, protocol in C.EXPECTED_ON_PORT.items():
        expected = F.when(F.col("dst_port") == port, protocol).otherwise(expected)
    cond = F.col("protocol").isin(*C.MASQUERADE_PROTOCOLS) & F.col("dst_port").isin(*C.EXPECTED_ON_PORT)
    rows = _first_per(conns.filter(cond), ["src_ip", "protocol", "dst_port"], "dst_ip").withColumn("expected", expected)
    return attack(rows, "medium",
                  text("%s traffic masquerading on OT port %d (%s to %s)", "protocol", "dst_port", "src_ip", "dst_ip"),
                  text("expected %s", "expected"), "T0849", "src_ip", "dst_ip")


def _transfers(seen: str) -> Column:
    return F.array_intersect(seen, F.array(*[F.lit(f) for f in C.S7_TRANSFER_FUNCTIONS]))


def t0868_operating_mode(s: Snapshot) -> DataFrame:
    rows = (
        s.devices.filter("s7comm IS NOT NULL")
        .select("ip", F.array_join(_transfers("s7comm.functions_seen"), ",").alias("used")).filter("used <> ''")
    )
    return attack(rows, "high", text("S7 program upload/download from %s", "ip"), text("functions %s", "used"),
                  "T0868", "ip")


def t0806_brute_force_io(s: Snapshot, threshold: int = 500) -> DataFrame:
    """Heavy writers per (source, target); a single-slave Modbus master not yet reported."""
    heavy = context_of(s)["write_counts"].filter(F.col("write_count") >= threshold)
    masters = s.devices.filter(F.col("modbus.role").isin(*MASTER)).select(
        F.col("ip").alias("src_ip"), F.col("modbus.write_count").alias("write_count")
    ).filter(F.col("write_count") >= threshold)
    lone = (
        s.modbus_peers.filter("remote_role = 'slave'").groupBy(F.col("ip").alias("src_ip"))
        .agg(F.count("*").alias("slaves"), F.min("remote_ip").alias("dst_ip")).filter("slaves = 1")
    )
    rest = masters.join(lone, "src_ip").join(heavy.select("src_ip", "dst_ip"), ["src_ip", "dst_ip"], "left_anti")
    return _union(
        attack(heavy, "high", text("High-rate I/O writes from %s to %s", "src_ip", "dst_ip"),
               text("%d write commands", "write_count"), "T0806", "src_ip", "dst_ip"),
        attack(rest, "high", text("Modbus brute force I/O from %s to %s", "src_ip", "dst_ip"),
               text("%d write commands", "write_count"), "T0806", "src_ip", "dst_ip"),
    )


def t0802_automated_collection(s: Snapshot, threshold: int = 10) -> DataFrame:
    """Readers of many OT targets; without read data, sources of many OT-port targets."""
    reads = context_of(s)["read_targets"]
    none_read = reads.agg(F.count("*")).scalar() == 0
    ot = context_of(s)["ot_ips"].withColumnRenamed("ip_address", "dst_ip")
    reached = (
        s.connections.filter(F.col("dst_port").isin(*C.OT_PORTS)).select("src_ip", "dst_ip").distinct()
        .join(ot, "dst_ip", "left_semi")
    )

    def many(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("src_ip").agg(F.count("*").alias("targets")).filter(F.col("targets") >= threshold)

    return _union(
        attack(many(reads), "medium", text("Automated collection: %s polling %d OT devices", "src_ip", "targets"),
               text("%d read targets", "targets"), "T0802", "src_ip"),
        attack(many(reached).filter(none_read), "medium",
               text("Automated collection: %s connecting to %d OT devices", "src_ip", "targets"),
               text("%d OT targets", "targets"), "T0802", "src_ip"),
    )


def t0861_point_tag_scan(s: Snapshot) -> DataFrame:
    rows = s.devices.filter(
        F.col("modbus.role").isin(*MASTER) & (F.col("modbus.read_count") > 0) & (F.size("modbus.unit_ids") >= 5)
    ).select("ip", F.size("modbus.unit_ids").alias("n"), F.array_join("modbus.unit_ids", ",").alias("units"))
    return attack(rows, "medium", text("Modbus point/tag scan from %s (%d unit IDs)", "ip", "n"),
                  text("units %s", "units"), "T0861", "ip")


def t0840_connection_enumeration(s: Snapshot, threshold: int = 10) -> DataFrame:
    """Sources of many OT ports; where the context names no ports, sources of many hosts on OT ports.

    Distinct hosts are counted in two levels, over parts of a source first, so that a scanner of
    very many hosts is no single group.
    """
    ports = context_of(s)["src_ports"]
    none_known = ports.agg(F.count("*")).scalar() == 0
    swept = (
        ports.filter(F.col("dst_port").isin(*C.OT_PORTS))
        .groupBy("src_ip").agg(F.countDistinct("dst_port").alias("ports")).filter(F.col("ports") >= threshold)
    )
    hosts = (
        s.connections.filter(F.col("dst_port").isin(*C.OT_PORTS)).select("src_ip", "dst_ip").distinct()
        .groupBy("src_ip", F.pmod(F.xxhash64("dst_ip"), F.lit(64)).alias("_part")).agg(F.count("*").alias("hosts"))
        .groupBy("src_ip").agg(F.sum("hosts").alias("hosts")).filter((F.col("hosts") >= threshold) & none_known)
    )
    return _union(
        attack(swept, "high", text("OT port sweep by %s (%d OT ports)", "src_ip", "ports"),
               text("%d distinct OT ports", "ports"), "T0840", "src_ip"),
        attack(hosts, "high", text("OT host sweep by %s (%d hosts)", "src_ip", "hosts"),
               text("%d distinct hosts on OT ports", "hosts"), "T0840", "src_ip"),
    )


def t0803_block_command(s: Snapshot) -> DataFrame:
    """Field devices with traffic but without one inbound OT-port connection, given that
    OT-port traffic exists. One pass marks both facts per address."""
    to_ot = F.col("dst_port").isin(*C.OT_PORTS)
    ends = F.explode(
        F.array(
            F.struct(F.col("src_ip").alias("ip_address"), F.lit(False).alias("commanded")),
            F.struct(F.col("dst_ip").alias("ip_address"), to_ot.alias("commanded")),
        )
    )
    facts = s.connections.select(ends.alias("e")).groupBy("e.ip_address").agg(F.bool_or("e.commanded").alias("commanded"))
    any_ot = s.connections.agg(F.count_if(to_ot)).scalar() > 0
    field = s.assets.filter(F.col("device_type").isin(*C.FIELD_DEVICE_TYPES)).select("ip_address")
    rows = facts.join(field, "ip_address", "left_semi").filter(~F.col("commanded") & any_ot)
    return attack(rows, "medium", text("PLC/RTU %s receiving no OT commands", "ip_address"),
                  text("%s has traffic but no inbound OT-port connection", "ip_address"), "T0803", "ip_address")


def t0804_block_reporting(s: Snapshot) -> DataFrame:
    outstations = s.devices.filter(F.col("dnp3.role") == "outstation").select("ip")
    mastered = s.dnp3_peers.filter("remote_role = 'master' AND packet_count > 0").select("ip")
    senders = s.connections.filter(F.col("dst_port").isin(*C.OT_PORTS)).select(F.col("src_ip").alias("ip"))
    rows = outstations.join(mastered, "ip", "left_semi").join(senders, "ip", "left_anti")
    return attack(rows, "medium", text("DNP3 outstation %s not reporting to master", "ip"),
                  text("%s has a master but sends nothing to OT ports", "ip"), "T0804", "ip")


def t0881_service_stop(s: Snapshot, servers: DataFrame) -> DataFrame:
    """OT servers whose inbound OT packets are at most a twentieth of the average."""
    inbound = (
        s.connections.filter(F.col("dst_port").isin(*C.OT_PORTS))
        .groupBy(F.col("dst_ip").alias("ip_address")).agg(F.sum("packet_count").alias("received"))
    )
    average = inbound.agg(F.expr("sum(received) div count(*)")).scalar()
    speaks = s.assets.filter(X.has_any(F.col("protocols"), C.OT_PROTOCOLS)).select("ip_address")
    rows = (
        servers.select("ip_address").join(speaks, "ip_address", "left_semi")
        .join(inbound, "ip_address", "left").withColumn("received", F.coalesce("received", F.lit(0).cast("bigint")))
        .withColumn("average", average)
        .filter("average >= 10 AND received <= greatest(average div 20, 1)")
    )
    return attack(rows, "high", text("Possible service stop on OT device %s", "ip_address"),
                  text("%d packets received, average %d", "received", "average"), "T0881", "ip_address")


def t0864_transient_asset(s: Snapshot, seen: DataFrame, max_seconds: int = 300) -> DataFrame:
    """Non-OT addresses seen briefly that exchanged packets with an OT device.

    ``seen``: output of device_first_last_seen.
    """
    duration = X.micros(F.col("last_seen")) - X.micros(F.col("first_seen"))
    ot = context_of(s)["ot_ips"]
    brief = (
        seen.withColumn("us", duration).filter((F.col("us") > 0) & (F.col("us") < max_seconds * 1_000_000))
        .join(ot, "ip_address", "left_anti")
    )
    pairs = s.connections.select(
        F.explode(F.array(F.struct(F.col("src_ip").alias("ip_address"), F.col("dst_ip").alias("peer")),
                          F.struct(F.col("dst_ip").alias("ip_address"), F.col("src_ip").alias("peer")))).alias("p")
    ).select("p.*")
    touched = pairs.join(ot.withColumnRenamed("ip_address", "peer"), "peer", "left_semi")
    rows = brief.join(touched, "ip_address", "left_semi").withColumn("sec", F.expr("us div 1000000"))
    return attack(rows, "medium", text("Transient device %s seen for only %ds on OT segment", "ip_address", "sec"),
                  text("%s exchanged packets with OT devices", "ip_address"), "T0864", "ip_address")


def t0830_aitm(s: Snapshot) -> DataFrame:
    rows = (
        context_of(s)["ip_macs"].groupBy("ip_address")
        .agg(F.count("*").alias("n"), F.min("mac").alias("a"), F.max("mac").alias("z")).filter("n >= 2")
    )
    return attack(rows, "critical", text("IP %s seen with %d distinct MACs", "ip_address", "n"),
                  text("from %s to %s", "a", "z"), "T0830", "ip_address")


def t0884_connection_proxy(s: Snapshot) -> DataFrame:
    """Addresses without an OT device type that are client and server on one OT port."""
    to_ot = s.connections.filter(F.col("dst_port").isin(*C.OT_PORTS))
    ends = F.explode(
        F.array(
            F.struct(F.col("src_ip").alias("ip_address"), F.lit(True).alias("client")),
            F.struct(F.col("dst_ip").alias("ip_address"), F.lit(False).alias("client")),
        )
    )
    both = (
        to_ot.select("dst_port", ends.alias("e")).groupBy("e.ip_address", "dst_port")
        .agg(F.bool_or("e.client").alias("c"), F.bool_or(~F.col("e.client")).alias("v")).filter("c AND v")
        .groupBy("ip_address").agg(F.array_join(F.array_sort(F.collect_set("dst_port")), ",").alias("ports"))
    )
    ot = s.assets.filter(F.col("device_type").isin(*C.OT_DEVICE_TYPES)).select("ip_address")
    return attack(both.join(ot, "ip_address", "left_anti"), "high", text("Possible OT traffic proxy at %s", "ip_address"),
                  text("client and server on ports %s", "ports"), "T0884", "ip_address")


def t0866_remote_exploitation(s: Snapshot) -> DataFrame:
    ctx = context_of(s)
    managed = (
        s.connections.filter(F.col("dst_port").isin(*C.MANAGEMENT_PORTS))
        .groupBy("src_ip", "dst_ip", "dst_port").agg(F.sum("packet_count").alias("packet_count"))
        .join(ctx["ot_ips"].withColumnRenamed("ip_address", "dst_ip"), "dst_ip", "left_semi")
    )
    rows = flag(flag(managed, ctx["external_ips"], "src_ip", "ext"), ctx["ot_ips"], "src_ip", "ot").filter("ext OR NOT ot")
    label = F.when(F.col("ext"), "External").otherwise("Non-OT")
    return attack(rows, "high",
                  text("%s host %s connecting to OT device %s (port %d)", label, "src_ip", "dst_ip", "dst_port"),
                  text("%s, %d packets", _service(F.col("dst_port")), "packet_count"), "T0866", "src_ip", "dst_ip")


def t0800_firmware_mode(s: Snapshot) -> DataFrame:
    field = s.assets.filter(F.col("device_type").isin(*C.FIELD_DEVICE_TYPES)).select(F.col("ip_address").alias("dst_ip"))
    cip = s.devices.filter("ethernet_ip.cip_file_access AND ethernet_ip.role = 'scanner'").select(
        F.col("ip").alias("src_ip"), F.lit("CIP File Access").alias("what")
    )
    s7 = s.devices.filter((F.col("s7comm.role") == "client") & (F.size(_transfers("s7comm.functions_seen")) > 0)).select(
        F.col("ip").alias("src_ip"), F.lit("S7 program upload/download").alias("what")
    )
    pairs = s.connections.select("src_ip", "dst_ip").distinct().join(field, "dst_ip", "left_semi")
    targets = pairs.groupBy("src_ip").agg(F.count("*").alias("targets"))
    rows = cip.union(s7).join(targets, "src_ip")
    return attack(rows, "critical", text("%s from %s targeting PLC(s)", "what", "src_ip"),
                  text("%d field devices reached", "targets"), "T0800", "src_ip")


def t0801_monitor_state(s: Snapshot, threshold: int = 20) -> DataFrame:
    endpoints = (
        s.connections.filter(F.col("dst_port").isin(*C.OT_PORTS))
        .groupBy("src_ip").agg(F.countDistinct("dst_ip", "dst_port").alias("endpoints"))
        .filter(F.col("endpoints") >= threshold)
    )
    writes = context_of(s)["write_targets"].groupBy("src_ip").agg(F.count("*").alias("writes"))
    rows = endpoints.join(writes, "src_ip", "left").filter("writes IS NULL OR writes < endpoints div 2")
    return attack(rows, "medium", text("Wide process state monitoring by %s (%d OT endpoints)", "src_ip", "endpoints"),
                  text("%d distinct OT endpoints", "endpoints"), "T0801", "src_ip")


def finding_targets(s: Snapshot) -> DataFrame:
    """Targets behind the fan-out rules: technique_id, src_ip, target_ip.

    Holds the pairs behind T0855 fan-out, T0846 discovery, T0802 collection, T0856 unknown masters,
    T0801 monitoring (which T0840 sweeps share) and T0800 firmware transfer, one row each.
    """
    ctx = context_of(s)
    field = s.assets.filter(F.col("device_type").isin(*C.FIELD_DEVICE_TYPES)).select(F.col("ip_address").alias("dst_ip"))
    reached = s.connections.select("src_ip", "dst_ip").distinct().join(field, "dst_ip", "left_semi").select("src_ip", "dst_ip")
    discovery = s.connections.filter(F.col("dst_port").isin(*C.OT_PORTS)).select("src_ip", "dst_ip").distinct()
    unclassified = s.assets.filter(_unclassified()).select(F.col("ip_address").alias("src_ip"))
    parts = [
        (ctx["write_targets"], "T0855"),
        (discovery.join(unclassified, "src_ip", "left_semi"), "T0846"),
        (ctx["read_targets"], "T0802"),
        (s.dnp3_peers.filter("remote_role = 'master'").select("ip", "remote_ip"), "T0856"),
        (discovery, "T0801"),
        (reached, "T0800"),
    ]
    return _union(*[
        t.toDF("src_ip", "target_ip").select(F.lit(code).alias("technique_id"), "src_ip", "target_ip") for t, code in parts
    ])
