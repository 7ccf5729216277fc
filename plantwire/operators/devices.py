"""Protocol behaviour per device, from the ``messages`` table.

Bounded properties (roles, unit ids, flags, counts) are one aggregation per device;
unbounded ones (function counts, register ranges, peers, polling) stay tables of
their own, so no device is ever gathered into one row that grows with its traffic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import columns as X
from ..functions.scale import SLICE_ROWS, gap_statistics
from .packets import function_code_name



def _order() -> Column:
    return F.struct("ts", "seq")


def _of(messages: DataFrame, protocol: str) -> DataFrame:
    return messages.filter(F.col("protocol") == protocol).withColumn("ip", F.col("src_ip"))


def _roles(cond: Column, first: str, second: str) -> Column:
    a = F.coalesce(F.bool_or(cond & (F.col("role") == first)), F.lit(False))
    b = F.coalesce(F.bool_or(cond & (F.col("role") == second)), F.lit(False))
    return F.when(a & b, "both").when(a, first).when(b, second).otherwise("unknown")


def _any(cond: Column) -> Column:
    return F.coalesce(F.bool_or(cond), F.lit(False))


def _last(value: str, cond: Column) -> Column:
    return F.max_by(value, F.when(cond, _order()))


def _detail(protocol: str) -> list[Column]:
    """Aggregates of one protocol, each restricted to the rows of that protocol."""
    of = F.col("protocol") == protocol
    code, write = F.col("function_code"), F.col("cip_service").isin("write", "read_modify_write")
    if protocol == "modbus":
        return [
            _roles(of, "master", "slave").alias("role"),
            F.array_sort(F.collect_set(F.when(of, F.col("unit_id")))).alias("unit_ids"),
            F.count_if(of & code.isin(*C.MODBUS_WRITE_CODES)).alias("write_count"),
            F.count_if(of & code.isin(*C.MODBUS_WRITE_CODES_WIDE)).alias("write_count_wide"),
            F.count_if(of & code.isin(*C.MODBUS_READ_CODES)).alias("read_count"),
            F.count_if(of & code.isin(*C.MODBUS_MASTER_CODES)).alias("master_code_count"),
            F.count_if(of & (code == 8)).alias("diagnostic_count"),
        ]
    if protocol == "dnp3":
        return [
            _roles(of, "master", "outstation").alias("role"),
            F.array_sort(F.collect_set(F.when(of, F.col("source_address")))).alias("addresses"),
            _any(of & F.col("is_unsolicited")).alias("has_unsolicited"),
            F.count_if(of & code.isin(*C.DNP3_WRITE_CODES)).alias("write_count"),
            F.count_if(of & code.isin(*C.DNP3_MASTER_CODES)).alias("master_code_count"),
        ]
    if protocol == "ethernet_ip":
        return [
            _last("role", of).alias("role"),
            _any(of & write & (F.col("cip_class") == "assembly")).alias("cip_writes_to_assembly"),
            _any(of & (F.col("cip_class") == "file")).alias("cip_file_access"),
            _any(of & (F.col("command") == "list_identity") & ~F.coalesce("cip_is_response", F.lit(False)))
            .alias("list_identity_requests"),
        ]
    if protocol == "s7comm":
        return [
            _last("role", of).alias("role"),
            F.array_sort(F.collect_set(F.when(of, F.col("s7_function")))).alias("functions_seen"),
        ]
    if protocol == "bacnet":
        writes = F.col("bacnet_service").isin("write_property", "write_property_multiple")
        outputs = F.col("bacnet_object").isin("analog_output", "binary_output")
        return [
            _last("role", of).alias("role"),
            _any(of & writes & outputs).alias("write_to_output"),
            _any(of & writes & (F.col("bacnet_object") == "notification_class")).alias("write_to_notification_class"),
            _any(of & (F.col("bacnet_service") == "reinitialize_device")).alias("reinitialize_device"),
            _any(of & (F.col("bacnet_service") == "device_communication_control"))
            .alias("device_communication_control"),
        ]
    if protocol == "iec104":
        return [
            _last("role", of).alias("role"),
            _any(of & F.col("is_command")).alias("has_control_commands"),
            _any(of & (F.col("type_id") == C.IEC104_RESET_TYPE)).alias("has_reset_process"),
            _any(of & (F.col("type_id") == C.IEC104_INTERROGATION_TYPE)).alias("has_interrogation"),
        ]
    if protocol == "profinet":
        return [
            F.coalesce(_last("role", of & (F.col("role") != "unknown")), F.lit("unknown")).alias("role"),
            _last("pn_station", of & (F.col("pn_station") != "")).alias("device_name"),
        ]
    raise ValueError(protocol)


DETAIL_PROTOCOLS = ("modbus", "dnp3", "ethernet_ip", "s7comm", "bacnet", "iec104", "profinet")


def _detail_table(messages: DataFrame, protocol: str) -> DataFrame:
    return _of(messages, protocol).groupBy("ip").agg(*_detail(protocol))


def modbus_roles(messages: DataFrame) -> DataFrame:
    return _detail_table(messages, "modbus").select("ip", "role")


def modbus_unit_ids(messages: DataFrame) -> DataFrame:
    return _detail_table(messages, "modbus").select("ip", "unit_ids")


def function_codes(messages: DataFrame) -> DataFrame:
    """Count per (protocol, device, function code) with label and write flag."""
    code = F.col("function_code")
    write = F.when(F.col("protocol") == "modbus", code.isin(*C.MODBUS_WRITE_CODES_WIDE)).otherwise(
        code.isin(*C.DNP3_WRITE_CODES)
    )
    counted = (
        messages.filter(F.col("protocol").isin("modbus", "dnp3") & code.isNotNull())
        .groupBy(F.col("src_ip").alias("ip"), "protocol", "function_code")
        .agg(F.count("*").alias("count"))
    )
    return function_code_name(counted).withColumn("is_write", write)


def modbus_function_codes(messages: DataFrame) -> DataFrame:
    return function_codes(messages.filter("protocol = 'modbus'")).drop("protocol")


def modbus_register_ranges(messages: DataFrame) -> DataFrame:
    return (
        _of(messages, "modbus").filter(F.col("reg_type").isNotNull())
        .groupBy("ip", "reg_start", "reg_count", "reg_type")
        .agg(F.count("*").alias("access_count"))
    )


def _relationships(messages: DataFrame, protocol: str, other: dict[str, str], *extra: Column) -> DataFrame:
    remote_role = F.lit("unknown")
    for role, opposite in other.items():
        remote_role = F.when(F.col("role") == role, F.lit(opposite)).otherwise(remote_role)
    return (
        _of(messages, protocol)
        .withColumn("_remote_role", remote_role)
        .groupBy("ip", F.col("dst_ip").alias("remote_ip"))
        .agg(F.min_by("_remote_role", _order()).alias("remote_role"), F.count("*").alias("packet_count"), *extra)
    )


def modbus_relationships(messages: DataFrame) -> DataFrame:
    return _relationships(
        messages, "modbus", {"master": "slave", "slave": "master"},
        F.array_sort(F.collect_set("unit_id")).alias("unit_ids"),
    )


def dnp3_relationships(messages: DataFrame) -> DataFrame:
    return _relationships(messages, "dnp3", {"master": "outstation", "outstation": "master"})


def modbus_polling_intervals(
    messages: DataFrame, max_gap_ms: int = 60000, min_samples: int = 3, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Gaps between equal requests of a master, per (master, slave, function, unit)."""
    requests = (
        _of(messages, "modbus")
        .filter((F.col("role") == "master") & ~F.col("is_exception"))
        .withColumn("remote_ip", F.col("dst_ip"))
    )
    g = gap_statistics(
        requests, ["ip", "remote_ip", "function_code", "unit_id"], X.micros(F.col("ts")),
        keep=lambda gap: (gap > 0) & (gap < max_gap_ms * 1000), slice_rows=slice_rows,
    ).filter((F.col("n") >= min_samples) & (F.col("gap_n") >= 2))

    def tenth(us: Column) -> Column:
        return F.round(us / 1000.0, 1)

    return g.select(
        "ip", "remote_ip", "function_code", "unit_id",
        tenth(F.col("gap_sum") / F.col("gap_n")).alias("avg_interval_ms"),
        tenth(F.col("gap_min")).alias("min_interval_ms"),
        tenth(F.col("gap_max")).alias("max_interval_ms"),
        F.col("gap_n").cast("bigint").alias("sample_count"),
    )


def _last_row(table: DataFrame, key: str) -> DataFrame:
    """Latest row per key by (ts, seq), as one mergeable aggregate."""
    rest = [c for c in table.columns if c not in (key, "ts", "seq")]
    return table.groupBy(key).agg(F.max_by(F.struct(*rest), _order()).alias("_r")).select(key, "_r.*")


def modbus_device_identity(identities: DataFrame) -> DataFrame:
    """Latest identification per source (ip, ts, seq, vendor_name, product_code, ...)."""
    return _last_row(identities, "ip")


def dnp3_detail(messages: DataFrame) -> DataFrame:
    return _detail_table(messages, "dnp3")


def enip_detail(messages: DataFrame) -> DataFrame:
    return _detail_table(messages, "ethernet_ip")


def s7_detail(messages: DataFrame) -> DataFrame:
    return _detail_table(messages, "s7comm")


def bacnet_detail(messages: DataFrame) -> DataFrame:
    return _detail_table(messages, "bacnet")


def iec104_detail(messages: DataFrame) -> DataFrame:
    return _detail_table(messages, "iec104")


def profinet_detail(messages: DataFrame) -> DataFrame:
    return _detail_table(messages, "profinet")


def lldp_by_device(lldp: DataFrame, assets: DataFrame) -> DataFrame:
    """Latest LLDP row per MAC, joined to the addresses that use the MAC."""
    latest = _last_row(lldp, "mac")
    owners = assets.select(F.col("ip_address").alias("ip"), F.col("mac_address").alias("mac"))
    return owners.join(latest, "mac")


def snmp_by_device(snmp: DataFrame) -> DataFrame:
    return _last_row(snmp, "ip")


def redundancy_frames(frames: DataFrame) -> DataFrame:
    """Latest ring-redundancy row per source MAC."""
    return _last_row(frames, "mac")


def device_protocol_info(
    messages: DataFrame, lldp: DataFrame | None = None, snmp: DataFrame | None = None, ip: str | None = None
) -> DataFrame:
    """One row per device with a struct per protocol (null if not spoken).

    All protocol details come from one scan and one shuffle of the messages; the
    LLDP and SNMP tables, already one row per device, are joined on.
    """
    rows = messages.withColumn("ip", F.col("src_ip"))
    if ip is not None:
        rows = rows.filter(F.col("ip") == ip)
    aggs, structs = [], []
    for p in DETAIL_PROTOCOLS:
        aggs.append(F.count_if(F.col("protocol") == p).alias(f"_n_{p}"))
        details = _detail(p)
        names = _DETAIL_NAMES[p]
        aggs += [c.alias(f"_{p}_{n}") for c, n in zip(details, names)]
        structs.append(
            F.when(F.col(f"_n_{p}") > 0, F.struct(*[F.col(f"_{p}_{n}").alias(n) for n in names])).alias(p)
        )
    out = rows.groupBy("ip").agg(*aggs).select("ip", *structs)
    for name, table in (("lldp", lldp), ("snmp", snmp)):
        if table is None:
            continue
        fields = [c for c in table.columns if c != "ip"]
        side = table.select("ip", F.struct(*fields).alias(name))
        if ip is not None:
            side = side.filter(F.col("ip") == ip)
        out = out.join(side, "ip", "full")
    return out


_DETAIL_NAMES = {
    "modbus": ("role", "unit_ids", "write_count", "write_count_wide", "read_count", "master_code_count",
               "diagnostic_count"),
    "dnp3": ("role", "addresses", "has_unsolicited", "write_count", "master_code_count"),
    "ethernet_ip": ("role", "cip_writes_to_assembly", "cip_file_access", "list_identity_requests"),
    "s7comm": ("role", "functions_seen"),
    "bacnet": ("role", "write_to_output", "write_to_notification_class", "reinitialize_device",
               "device_communication_control"),
    "iec104": ("role", "has_control_commands", "has_reset_process", "has_interrogation"),
    "profinet": ("role", "device_name"),
}
