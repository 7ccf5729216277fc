"""All rules of a run in a few passes, where a scan per rule would read every table many times.

Connections become flows, ends of flows and assets become addresses with their device details.
Then every flow and every peer gives a row to each rule that it concerns, and one aggregation
counts them by rule and subject, over the single items first, so that a subject with very many
items is no large group. Every rule is then a condition on a subject or on an address.

Connections, assets, devices, peers and statistics are read once, polling twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import columns as X
from ..functions.scale import stage
from . import analysis as A
from .attack_rules import MASTER, _service, _transfers, _union
from .findings import Snapshot, attack, severity_rank, text

_DETAILS = ["modbus", "dnp3", "ethernet_ip", "s7comm", "bacnet", "iec104", "profinet"]


def _flows(conns: DataFrame) -> DataFrame:
    """Connections without their client ports, which are what makes them many."""
    odd = F.lit(False)
    for protocol, ports in C.CANONICAL_PORTS.items():
        odd = odd | ((F.col("protocol") == protocol) & ~F.col("dst_port").isin(*ports) & ~F.col("src_port").isin(*ports))
    return conns.groupBy(
        "src_ip", "dst_ip", "dst_port", "protocol", F.lower("src_mac").alias("src_mac"), F.lower("dst_mac").alias("dst_mac")
    ).agg(
        F.count("*").alias("n"), F.sum("packet_count").alias("packet_count"), F.sum(F.when(odd, F.col("packet_count"))).alias("odd_packets"),
        F.bool_or(F.col("src_port").isin(*C.SERVER_PORTS)).alias("src_serves"),
    )


def _addresses(flows: DataFrame, assets: DataFrame, devices: DataFrame, seen: DataFrame) -> DataFrame:
    """One row per address: its asset (null if none), what flows say of it, device details, first and last sight."""
    to_ot, to_l1 = F.col("dst_port").isin(*C.OT_PORTS), F.col("dst_port").isin(*C.L1_SERVER_PORTS)
    kept = assets.select("ip_address", "device_type", "is_public_ip", "protocols", "purdue_level")
    asset = F.struct(*kept.columns[1:])
    zero = F.lit(0).cast("bigint")

    def end(ip: str, mac: str, source: bool) -> Column:
        return F.struct(
            F.col(ip).alias("ip"), F.col(mac).alias("mac"), F.lit(1).alias("flows"), (to_ot & (not source)).alias("reached"),
            (to_ot & source).alias("sends"), F.when(to_ot & (not source), F.col("packet_count")).alias("received"),
            F.when(to_l1 & source, F.col("n")).otherwise(zero).alias("l1_client"), F.when(to_l1 & (not source), F.col("n")).otherwise(zero).alias("l1_served"),
            (F.col("src_serves") if source else F.col("dst_port").isin(*C.SERVER_PORTS)).alias("serves"),
            F.lit(None).cast(kept.select(asset.alias("a")).schema["a"].dataType).alias("asset"),
        )

    ends = flows.select(F.explode(F.array(end("src_ip", "src_mac", True), end("dst_ip", "dst_mac", False))).alias("e")).select("e.*")
    known = assets.select(
        F.col("ip_address").alias("ip"), F.lower("mac_address").alias("mac"), F.lit(0).alias("flows"), F.lit(False).alias("reached"),
        F.lit(False).alias("sends"), F.lit(None).cast("bigint").alias("received"), zero.alias("l1_client"), zero.alias("l1_served"),
        F.lit(False).alias("serves"), asset.alias("asset"),
    )
    sums = [F.sum(c).alias(c) for c in ("flows", "received", "l1_client", "l1_served")]
    either = [F.bool_or(c).alias(c) for c in ("reached", "sends", "serves")]
    whole = [*sums, *either, F.first("asset", ignorenulls=True).alias("asset")]
    rows = ends.unionByName(known).groupBy("ip", "mac").agg(*whole)
    rows = rows.groupBy("ip").agg(*whole, F.count("mac").alias("macs"), F.min("mac").alias("mac_a"), F.max("mac").alias("mac_z"))
    sight = seen.select(F.col("ip_address").alias("ip"), (X.micros(F.col("last_seen")) - X.micros(F.col("first_seen"))).alias("us"))
    rows = rows.join(devices.select("ip", *_DETAILS), "ip", "full").join(sight, "ip", "left")
    rows = rows.select("*", "asset.*", F.col("asset").isNotNull().alias("is_asset"), F.col("l1_client").alias("ot_targets"), F.col("l1_served").alias("served")).drop("asset")
    kind = F.coalesce("device_type", F.lit("unknown"))
    rows = rows.withColumn("kind", kind).withColumn("ot_type", F.col("kind").isin(*C.OT_DEVICE_TYPES))
    rows = rows.withColumn("is_ot", F.col("ot_type") | F.coalesce("reached", F.lit(False)))
    return rows.withColumn("p", F.when(F.col("is_asset"), A.level_of()))


def _hit(rule: str, cond: Column, a, b=None, port=None, item=None, packets=None, extra=None, top=None, c: Column | bool = False, v: bool = False) -> Column:
    """A row for a rule: subject (a, b, port), item that is counted once, and what is added up over its flows."""
    col = lambda x, kind: (F.lit(None) if x is None else F.col(x) if isinstance(x, str) else x).cast(kind)
    return F.when(cond, F.struct(
        F.lit(rule).alias("rule"), col(a, "string").alias("a"), col(b, "string").alias("b"), col(port, "int").alias("port"), col(item, "string").alias("item"),
        col(packets, "bigint").alias("packets"), col(extra, "bigint").alias("extra"), col(top, "bigint").alias("top"),
        (c if isinstance(c, Column) else F.lit(c)).alias("c"), F.lit(v).alias("v"),
    ))


def _exploded(rows: DataFrame, *hits: Column) -> DataFrame:
    return rows.select(F.explode(F.array_compact(F.array(*hits))).alias("h")).select("h.*")


def _subjects(flows: DataFrame, addresses: DataFrame, modbus_peers: DataFrame, dnp3_peers: DataFrame) -> DataFrame:
    """Counts by rule and subject: n (items that count), n_c (items seen in flows), first, ports and sums."""

    def side(prefix: str) -> DataFrame:
        return addresses.select(
            F.col("ip").alias(f"{prefix}_ip"), F.col("is_ot").alias(f"{prefix}_ot"), F.col("kind").alias(f"{prefix}_kind"),
            F.coalesce("is_public_ip", F.lit(False)).alias(f"{prefix}_public"), F.col("p.level").alias(f"{prefix}_level"),
        )

    f = flows.join(side("src"), "src_ip").join(side("dst"), "dst_ip")
    port, packets = F.col("dst_port"), "packet_count"
    to_ot, src_ot, dst_ot = port.isin(*C.OT_PORTS), F.col("src_ot"), F.col("dst_ot")
    clear = port.isin(*C.CLEARTEXT_OT_PORTS)
    tls = (F.col("protocol") == "opc_ua") & (port == C.OPC_UA_TLS_PORT)
    low, high = F.least("src_level", "dst_level"), F.greatest("src_level", "dst_level")
    both = F.col("src_level").isNotNull() & F.col("dst_level").isNotNull()
    grave = F.when(both & (low <= 1) & (high >= 4), severity_rank(F.lit("medium"))).when(both & (low == 2) & (high >= 4), severity_rank(F.lit("low")))
    of_flows = _exploded(
        f,
        _hit("f4", to_ot & F.col("src_kind").isin(*C.UNCLASSIFIED_TYPES), "src_ip", item="dst_ip"),
        _hit("f10", clear | tls, "protocol", packets=packets, extra=F.when(clear, F.col(packets))),
        _hit("f12", port.isin(*C.REMOTE_ACCESS_PORTS) & src_ot, "src_ip", "dst_ip", "dst_port", packets=packets),
        _hit("f13", port.isin(*C.FILE_TRANSFER_PORTS) & (src_ot | dst_ot), "src_ip", "dst_ip", item=F.lpad(port.cast("string"), 5, "0"), packets=packets),
        _hit("f14", F.col("odd_packets").isNotNull(), "src_ip", "protocol", "dst_port", "dst_ip", "odd_packets"),
        _hit("f15", F.col("protocol").isin(*C.MASQUERADE_PROTOCOLS) & port.isin(*C.EXPECTED_ON_PORT), "src_ip", "protocol", "dst_port", "dst_ip"),
        _hit("f18", to_ot, "src_ip", item="dst_ip", c=True),
        _hit("f20", to_ot, "src_ip", item="dst_port"),
        _hit("f24", dst_ot, "src_ip"), _hit("f24", src_ot, "dst_ip"),
        _hit("f26", to_ot, "src_ip", item="dst_port", c=True), _hit("f26", to_ot, "dst_ip", item="dst_port", v=True),
        _hit("f27", port.isin(*C.MANAGEMENT_PORTS) & dst_ot & (F.col("src_public") | ~src_ot), "src_ip", "dst_ip", "dst_port", packets=packets, c=F.col("src_public")),
        _hit("f28", F.col("dst_kind").isin(*C.FIELD_DEVICE_TYPES), "src_ip", item="dst_ip"),
        _hit("f29", to_ot, "src_ip", item=F.concat_ws(":", "dst_ip", port.cast("string"))),
        _hit("f35", grave.isNotNull(), F.least("src_ip", "dst_ip"), F.greatest("src_ip", "dst_ip"), packets=packets, top=grave * 10_000 + low * 100 + high),
    )
    masters = addresses.select(F.col("ip"), F.col("modbus.role").isin(*MASTER).alias("master"), F.col("modbus.write_count").alias("writes"))
    slaves = modbus_peers.filter("remote_role = 'slave'").select("ip", "remote_ip").join(masters, "ip", "left")
    of_modbus = _exploded(
        slaves, _hit("slaves", F.lit(True), "ip", item="remote_ip"), _hit("f18", F.col("master"), "ip", item="remote_ip", v=True),
        _hit("f17", F.col("master"), "ip", "remote_ip", packets="writes"),
    )
    strange = addresses.select(F.col("ip").alias("remote_ip"), F.col("dnp3.role").isin(*MASTER).alias("known"))
    of_dnp3 = _exploded(
        dnp3_peers.filter("remote_role = 'master'").select("ip", "remote_ip", "packet_count").join(strange, "remote_ip", "left"),
        _hit("f3", ~F.coalesce("known", F.lit(False)), "ip", item="remote_ip"), _hit("f22", F.col("packet_count") > 0, "ip"),
    )
    sums = [F.sum("packets").alias("packets"), F.sum("extra").alias("extra"), F.max("top").alias("top")]
    items = _union(of_flows, of_modbus, of_dnp3).groupBy("rule", "a", "b", "port", "item").agg(*sums, F.bool_or("c").alias("c"), F.bool_or("v").alias("v"))
    counts = F.when(F.col("rule") == "f18", F.col("c") & ~F.col("v")).when(F.col("rule") == "f26", F.col("c") & F.col("v")).otherwise(True)
    return items.groupBy("rule", "a", "b", "port").agg(
        F.count_if(counts).alias("n"), F.count_if("c").alias("n_c"), F.min(F.when(counts, F.col("item"))).alias("first"), *sums, F.bool_or("c").alias("c"),
        # ports of the OT list only
        F.array_sort(F.collect_set(F.when((F.col("rule") == "f26") & counts, F.col("item").cast("int")))).alias("ports"),
    )


def _found(rows: DataFrame, *rules: tuple) -> DataFrame:
    """Findings from rows: each rule is (condition, type, severity, technique, title, evidence, affected addresses)."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
    hits = [
        F.when(cond, F.struct(
            lit(kind).alias("finding_type"), lit(severity).alias("severity"), lit(title).alias("title"), lit(technique).alias("technique_id"),
            F.array(*[F.col(x) for x in affected]).alias("affected_assets"), lit(evidence).alias("evidence"),
        ))
        for cond, kind, severity, technique, title, evidence, affected in rules
    ]
    out = rows.select(F.explode(F.array_compact(F.array(*hits))).alias("h")).select("h.*")
    key = [F.coalesce(F.col(c), F.lit("")) for c in ("finding_type", "technique_id", "title")] + [F.array_join("affected_assets", ",")]
    return out.withColumn("id", X.natural_id(*key))


def _subject_findings(subjects: DataFrame, io_writes: int) -> DataFrame:
    is_ = lambda rule, cond=F.lit(True): (F.col("rule") == rule) & cond
    n, kind, pair = F.col("n"), "attack_technique", ("a", "b")
    no_reads = subjects.agg(F.count_if((F.col("rule") == "f18") & (n > 0))).scalar() == 0
    expected = F.lit(None).cast("string")
    for port, protocol in C.EXPECTED_ON_PORT.items():
        expected = F.when(F.col("port") == port, protocol).otherwise(expected)
    moved = F.col("first").cast("int")
    rank, low, high = F.floor(F.col("top") / 10_000), F.floor(F.col("top") / 100) % 100, F.col("top") % 100
    service = _service(F.col("port"))
    rows = subjects.filter(F.col("rule").isin("f4", "f12", "f13", "f14", "f15", "f17", "f18", "f20", "f27", "f35"))
    return _found(
        rows.withColumns({"to": F.col("first")}),
        (is_("f4", n >= 3), kind, "high", "T0846", text("Unknown device %s polling %d PLCs/RTUs", "a", n), text("reached OT ports of %d hosts", n), "a"),
        (is_("f12"), kind, "high", "T0822", text("OT device %s accessing %s (port %d)", "a", service, "port"), text("to %s, %d packets", "b", "packets"), pair),
        (is_("f13"), kind, "high", "T0867", text("%s file transfer involving OT device: %s to %s", F.when(moved == 21, "FTP").otherwise("TFTP"), "a", "b"),
         text("port %d, %d packets", moved, "packets"), pair),
        (is_("f14"), kind, "medium", "T0885", text("%s on non-standard port %d (%s to %s)", "b", "port", "a", "to"), text("%d packets", "packets"), ("a", "to")),
        (is_("f15"), kind, "medium", "T0849", text("%s traffic masquerading on OT port %d (%s to %s)", "b", "port", "a", "to"), text("expected %s", expected), ("a", "to")),
        (is_("f17", F.col("packets") >= io_writes), kind, "high", "T0806", text("High-rate I/O writes from %s to %s", "a", "b"), text("%d write commands", "packets"), pair),
        (is_("f18", n >= 10), kind, "medium", "T0802", text("Automated collection: %s polling %d OT devices", "a", n), text("%d read targets", n), "a"),
        (is_("f18", (F.col("n_c") >= 10) & no_reads), kind, "medium", "T0802", text("Automated collection: %s connecting to %d OT devices", "a", "n_c"), text("%d OT targets", "n_c"), "a"),
        (is_("f20", n >= 10), kind, "high", "T0840", text("OT port sweep by %s (%d OT ports)", "a", n), text("%d distinct OT ports", n), "a"),
        (is_("f27"), kind, "high", "T0866",
         text("%s host %s connecting to OT device %s (port %d)", F.when(F.col("c"), "External").otherwise("Non-OT"), "a", "b", "port"), text("%s, %d packets", service, "packets"), pair),
        (is_("f35"), "purdue_violation", X.label_of(rank, C.SEVERITY_RANK), "T0886", text("Cross-zone communication: L%d with L%d (%s, %s)", low, high, "a", "b"),
         text("%d packets between the levels", "packets"), pair),
    )


def _clear_text(subjects: DataFrame) -> DataFrame:
    """At most one finding: the share of OT packets sent in clear."""
    label = F.when(F.col("extra") > 0, F.concat("a", F.lit(": "), F.col("extra").cast("string")))
    totals = subjects.filter("rule = 'f10'").agg(
        F.sum("extra").alias("clear"), F.sum("packets").alias("all"), F.array_join(F.array_sort(F.collect_list(label)), ", ").alias("breakdown")
    ).filter("clear > 0")
    severity = F.when(F.col("clear") >= 0.99 * F.col("all"), "high").when(F.col("clear") >= 0.5 * F.col("all"), "medium").otherwise("low")
    percent = F.round(F.col("clear") * 100.0 / F.col("all"), 0).cast("int")
    return attack(totals, severity, text("%d%% of OT traffic is unencrypted", percent), text("%d of %d packets in clear; %s", "clear", "all", "breakdown"), None)


def _told(addresses: DataFrame, subjects: DataFrame) -> DataFrame:
    """Addresses with what the counts say of them."""
    of = lambda rule, value, merge=F.max: merge(F.when(F.col("rule") == rule, F.col(value)))
    facts = subjects.filter(F.col("rule").isin("slaves", "f3", "f22", "f24", "f26", "f28", "f29")).groupBy(F.col("a").alias("ip")).agg(
        of("slaves", "n").alias("slaves"), of("f3", "n").alias("strange"), of("f22", "n").alias("mastered"), of("f24", "n").alias("touched"),
        F.first(F.when(F.col("rule") == "f26", F.col("ports")), ignorenulls=True).alias("ports"), of("f28", "n").alias("fields"), of("f29", "n").alias("endpoints"),
    )
    return addresses.join(facts, "ip", "left")


def _address_findings(told: DataFrame, max_seconds: int = 300) -> DataFrame:
    """Findings about single addresses, all rules in one pass over them."""
    kind, ip = "attack_technique", ("ip",)
    yes = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))
    master, writes = yes(F.col("modbus.role").isin(*MASTER)), F.col("modbus.write_count")
    broadcast = F.filter("modbus.unit_ids", lambda u: u.isin(0, 255))
    used = lambda name: yes(F.array_contains("s7comm.functions_seen", name))
    moved = F.array_join(_transfers("s7comm.functions_seen"), ",")
    loose = F.col("kind").isin(*C.UNCLASSIFIED_TYPES)
    facts = told.agg(
        F.expr("sum(received) div count(received)").alias("average"), F.bool_or("reached").alias("any_ot"),
        F.count_if(F.col("dnp3.role").isin(*MASTER)).alias("masters"),
    )
    average, any_ot, masters = (facts.select(c).scalar() for c in ("average", "any_ot", "masters"))
    received = F.coalesce("received", F.lit(0).cast("bigint"))
    spoken = F.array_join(F.array_intersect("protocols", F.array(*[F.lit(p) for p in C.EXPOSED_PROTOCOLS])), ",")
    public, unsolicited = yes("is_public_ip"), yes("dnp3.has_unsolicited")
    brief = (F.col("us") > 0) & (F.col("us") < max_seconds * 1_000_000)
    typed = text("%s has type %s", "ip", "kind")
    reversal = (F.col("modbus.role") == "slave") & (F.col("modbus.master_code_count") > 0)

    def said(cond, severity, technique, title, evidence, kind_=kind):
        return (cond, kind_, severity, technique, title, evidence, ip)

    field = [F.col("fields") > 0]
    rows = told.withColumns({"average": average, "any_ot": any_ot, "masters": masters})
    return _found(
        rows,
        said(master & (writes > 0) & (F.size(broadcast) > 0), "critical", "T0855", text("Modbus broadcast write from %s", "ip"),
             text("%d write commands, broadcast unit ids %s", writes, F.array_join(broadcast, ","))),
        said(master & (writes > 0) & (F.col("slaves") >= 5), "high", "T0855", text("High fan-out Modbus writes from %s", "ip"), text("writes to %d slaves", "slaves")),
        said((F.col("modbus.diagnostic_count") > 0) & (F.col("kind") != "engineering_workstation"), "high", "T0814", text("Modbus diagnostics (FC 8) from non-engineer: %s", "ip"),
             text("type %s sent %d diagnostic commands", "kind", "modbus.diagnostic_count")),
        said(unsolicited & (F.col("strange") > 0), "medium", "T0856", text("DNP3 unsolicited response from %s to unknown master", "ip"), text("%d unknown masters", "strange")),
        said(unsolicited & (F.col("masters") == 0), "medium", "T0856", text("DNP3 unsolicited response with no known masters: %s", "ip"), text("%s sends unsolicited responses", "ip")),
        said(yes("ethernet_ip.cip_writes_to_assembly"), "high", "T0855", text("CIP write to Assembly object from %s", "ip"), text("%s wrote to class 0x04", "ip")),
        said(yes("ethernet_ip.cip_file_access"), "critical", "T0836", text("CIP File class access from %s", "ip"), text("%s used class 0x37", "ip")),
        said(yes("ethernet_ip.list_identity_requests") & loose, "medium", "T0846", text("EtherNet/IP ListIdentity from non-OT device %s", "ip"), typed),
        said(used("download_start"), "critical", "T0843", text("S7 program download from %s", "ip"), "function 0x1D"),
        said(used("upload_start"), "high", "T0845", text("S7 program upload from %s", "ip"), "function 0x1A"),
        said(used("plc_stop"), "critical", "T0816", text("S7 PLC Stop command from %s", "ip"), "function 0x29"),
        said(used("pi_service"), "critical", "T0809", text("S7 PI Service (possible block delete) from %s", "ip"), "function 0x28"),
        said(used("write_var"), "high", "T0855", text("S7 Write Var command from %s", "ip"), "function 0x05"),
        said(yes("iec104.has_control_commands"), "high", "T0855", text("IEC 104 control commands from %s", "ip"), "command type ids seen"),
        said(yes("iec104.has_reset_process"), "critical", "T0816", text("IEC 104 Reset Process command from %s", "ip"), "type id 105 seen"),
        said(yes("iec104.has_interrogation") & loose, "medium", "T0814", text("IEC 104 interrogation from non-OT device %s", "ip"), typed),
        said(yes("bacnet.write_to_output"), "high", "T0855", text("BACnet WriteProperty to output object from %s", "ip"), "analog or binary output written"),
        said(yes("bacnet.write_to_notification_class"), "high", "T0856", text("BACnet alarm suppression from %s", "ip"), "notification class written"),
        said(yes("bacnet.reinitialize_device"), "high", "T0816", text("BACnet ReinitializeDevice from %s", "ip"), "reinitialize requested"),
        said(yes("bacnet.device_communication_control"), "high", "T0811", text("BACnet DeviceCommunicationControl from %s", "ip"), "communication control requested"),
        said(F.col("is_asset") & public & (spoken != ""), "critical", "T0846", text("Internet-exposed OT device: %s", "ip"), text("public address speaks %s", spoken)),
        said(moved != "", "high", "T0868", text("S7 program upload/download from %s", "ip"), text("functions %s", moved)),
        said(master & (F.col("modbus.read_count") > 0) & (F.size("modbus.unit_ids") >= 5), "medium", "T0861",
             text("Modbus point/tag scan from %s (%d unit IDs)", "ip", F.size("modbus.unit_ids")), text("units %s", F.array_join("modbus.unit_ids", ","))),
        said(F.col("kind").isin(*C.FIELD_DEVICE_TYPES) & (F.col("flows") > 0) & ~F.col("reached") & F.col("any_ot"), "medium", "T0803",
             text("PLC/RTU %s receiving no OT commands", "ip"), text("%s has traffic but no inbound OT-port connection", "ip")),
        said((F.col("dnp3.role") == "outstation") & (F.col("mastered") > 0) & ~yes("sends"), "medium", "T0804", text("DNP3 outstation %s not reporting to master", "ip"),
             text("%s has a master but sends nothing to OT ports", "ip")),
        said(yes("serves") & F.col("is_asset") & X.has_any(F.col("protocols"), C.OT_PROTOCOLS) & (F.col("average") >= 10) & (received <= F.greatest(F.expr("average div 20"), F.lit(1))),
             "high", "T0881", text("Possible service stop on OT device %s", "ip"), text("%d packets received, average %d", received, "average")),
        said(brief & ~F.col("is_ot") & (F.col("touched") > 0), "medium", "T0864", text("Transient device %s seen for only %ds on OT segment", "ip", F.expr("us div 1000000")),
             text("%s exchanged packets with OT devices", "ip")),
        said(F.col("macs") >= 2, "critical", "T0830", text("IP %s seen with %d distinct MACs", "ip", "macs"), text("from %s to %s", "mac_a", "mac_z")),
        said((F.size("ports") > 0) & ~F.col("ot_type"), "high", "T0884", text("Possible OT traffic proxy at %s", "ip"), text("client and server on ports %s", F.array_join("ports", ","))),
        said(yes("ethernet_ip.cip_file_access") & (F.col("ethernet_ip.role") == "scanner") & field[0], "critical", "T0800", text("CIP File Access from %s targeting PLC(s)", "ip"),
             text("%d field devices reached", "fields")),
        said((F.col("s7comm.role") == "client") & (moved != "") & field[0], "critical", "T0800", text("S7 program upload/download from %s targeting PLC(s)", "ip"),
             text("%d field devices reached", "fields")),
        said((F.col("endpoints") >= 20) & (~master | F.col("slaves").isNull() | (F.col("slaves") < F.expr("endpoints div 2"))), "medium", "T0801",
             text("Wide process state monitoring by %s (%d OT endpoints)", "ip", "endpoints"), text("%d distinct OT endpoints", "endpoints")),
        said(reversal, "high", None, text("Modbus role reversal: slave %s acting as master", "ip"), text("%d master function codes", "modbus.master_code_count"), "anomaly"),
        said(F.col("is_asset") & public & X.has_any(F.col("protocols"), C.OT_PROTOCOLS), "critical", None, text("Public IP on OT network: %s", "ip"), F.array_join("protocols", ", "), "anomaly"),
    )


def _flat(addresses: DataFrame) -> DataFrame:
    assets = addresses.filter("is_asset")
    total = assets.agg(F.count("*")).scalar()
    rows = assets.groupBy(X.subnet24(F.col("ip")).alias("subnet")).agg(F.count("*").alias("n")).withColumn("total", total).filter("total >= 6 AND n > 5 AND n > 0.8 * total")
    return attack(rows, "high", text("Flat network detected: %d of %d devices on %s", "n", "total", "subnet"), text("no segmentation inside %s", "subnet"), "T0886")


def run_in_few_passes(s: Snapshot, seen: DataFrame, io_writes: int = 500) -> dict[str, DataFrame]:
    """Findings, anomalies and assignments of ``run_full_analysis``, from flows, addresses and subjects.

    ``seen``: output of device_first_last_seen. The three tables are written once each.
    """
    flows = stage(_flows(s.connections), "flows")
    addresses = stage(_addresses(flows, s.assets, s.devices, seen), "addresses")
    subjects = stage(_subjects(flows, addresses, s.modbus_peers, s.dnp3_peers), "subjects")
    known = addresses.filter("is_asset").withColumn("ip_address", F.col("ip"))
    poll_a, poll_f = A.polling_deviation(s.polling)
    method = F.when(F.col("purdue_level").isNotNull(), "manual").otherwise("auto")
    return {
        "findings": _union(
            _subject_findings(subjects, io_writes), _clear_text(subjects), _address_findings(_told(addresses, subjects)), _flat(addresses), poll_f
        ),
        "assignments": known.select("ip_address", "p.level", method.alias("method"), "p.reason"),
        "anomalies": _union(poll_a, A.reversal_anomalies(addresses), A.unexpected_public_ip(known)[0]),
    }
