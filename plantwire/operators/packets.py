"""Packet-level projections: protocol, decoded messages, filters, first packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .. import schemas
from ..functions import columns as X
from ..functions import decode
from ..functions.scale import top_n_per_key

CONNECTION_KEY = ["src_ip", "src_port", "dst_ip", "dst_port", "protocol"]


def identify_protocol(packets: DataFrame) -> DataFrame:
    return packets.withColumn("protocol", X.identify(F.col("src_port"), F.col("dst_port")))


is_ot = X.is_ot


def _ensure_protocol(packets: DataFrame) -> DataFrame:
    return packets if "protocol" in packets.columns else identify_protocol(packets)


def _decoded(packets: DataFrame, protocol: str, fields) -> DataFrame:
    frames = _ensure_protocol(packets).filter(
        (F.col("protocol") == protocol) & decode.is_frame(protocol, F.col("payload"))
    )
    base = ["seq", "ts", "src_ip", "dst_ip", "src_port", "dst_port"]
    return decode.with_head(frames).select(*base, *[c.alias(n) for n, c in fields().items()])


def decode_modbus(packets: DataFrame) -> DataFrame:
    return _decoded(packets, "modbus", decode.modbus_fields)


def decode_dnp3(packets: DataFrame) -> DataFrame:
    return _decoded(packets, "dnp3", decode.dnp3_fields)


def decode_iec104(packets: DataFrame) -> DataFrame:
    return _decoded(packets, "iec104", decode.iec104_fields)


def decode_s7(packets: DataFrame) -> DataFrame:
    return _decoded(packets, "s7comm", decode.s7_fields)


def decode_enip_header(packets: DataFrame) -> DataFrame:
    return _decoded(packets, "ethernet_ip", decode.enip_fields)


def messages(packets: DataFrame) -> DataFrame:
    """One row per packet of a decoded protocol, from a single scan of the packets.

    Fields of variable-length protocols come in as columns (``schemas.APP_FIELDS``);
    absent ones read as null.
    """
    packets = _ensure_protocol(packets)
    for field in schemas.APP_FIELDS.fields:
        if field.name not in packets.columns:
            packets = packets.withColumn(field.name, F.lit(None).cast(field.dataType))
    proto = F.col("protocol")

    def pick(mapping: dict[str, Column]) -> Column:
        chain = None
        for name, value in mapping.items():
            chain = (F if chain is None else chain).when(proto == name, value)
        return chain

    framed = {p: decode.is_frame(p, F.col("payload")) for p in ("modbus", "dnp3", "iec104", "s7comm", "ethernet_ip")}
    valid = pick({**framed, "bacnet": F.col("bacnet_role").isNotNull(), "profinet": F.col("pn_role").isNotNull()})
    rows = decode.with_head(packets.filter(valid))
    parts = {
        "modbus": decode.modbus_fields(), "dnp3": decode.dnp3_fields(), "iec104": decode.iec104_fields(),
        "s7comm": decode.s7_fields(), "ethernet_ip": decode.enip_fields(),
    }

    def field(name: str, *protocols: str) -> Column:
        return pick({p: parts[p][name] for p in protocols}).alias(name)

    sends = F.col("_cmd").isin("send_rr_data", "send_unit_data")
    enip_role = (
        F.when((F.col("_cmd") == "list_identity") & (parts["ethernet_ip"]["data_length"] > 0), "adapter")
        .when(F.col("_cmd") == "register_session", "scanner")
        .when(sends & F.col("cip_is_response"), "adapter")
        .when(sends & F.col("cip_service").isin("forward_open", "write"), "scanner")
        .otherwise("unknown")
    )
    role = pick(
        {
            **{p: parts[p]["role"] for p in ("modbus", "dnp3", "iec104", "s7comm")},
            "ethernet_ip": enip_role,
            "bacnet": F.coalesce("bacnet_role", F.lit("unknown")),
            "profinet": F.coalesce("pn_role", F.lit("unknown")),
        }
    )
    return rows.select(
        "seq", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
        role.alias("role"),
        field("unit_id", "modbus"),
        field("function_code", "modbus", "dnp3"),
        field("is_exception", "modbus"),
        field("reg_start", "modbus"),
        field("reg_count", "modbus"),
        field("reg_type", "modbus"),
        field("source_address", "dnp3"),
        field("is_unsolicited", "dnp3"),
        field("type_id", "iec104"),
        field("is_command", "iec104"),
        field("s7_function", "s7comm"),
        field("command", "ethernet_ip"),
        field("data_length", "ethernet_ip"),
        "cip_service", "cip_class", "cip_is_response",
        "bacnet_service", "bacnet_object", "pn_station",
    )


def function_names(spark) -> DataFrame:
    """Lookup of function labels: protocol, function_code, function_name."""
    rows = [("modbus", c, n) for c, n in C.MODBUS_FUNCTION_NAMES.items()]
    rows += [("dnp3", c, n) for c, n in C.DNP3_FUNCTION_NAMES.items()]
    return spark.createDataFrame(rows, "protocol string, function_code int, function_name string")


def function_code_name(table: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Label function codes; the label table has one row per code (at most 512)."""
    names = function_names(table.sparkSession) if names is None else names
    return table.join(F.broadcast(names), ["protocol", "function_code"], "left").withColumn(
        "function_name", F.coalesce("function_name", F.lit("Unknown"))
    )


def filter_packets(packets: DataFrame, ips=(), ports=()) -> DataFrame:
    """Packets that touch a listed address or port; no lists means all packets.

    Rows that came from an import rather than a capture carry a bracketed origin
    such as ``[Zeek]`` and have no packets behind them.
    """
    packets = packets.filter(~F.col("origin_file").startswith("["))
    cond = F.lit(False)
    if not ips and not ports:
        return packets
    if ips:
        cond = cond | F.col("src_ip").isin(*ips) | F.col("dst_ip").isin(*ips)
    if ports:
        cond = cond | F.col("src_port").isin(*ports) | F.col("dst_port").isin(*ports)
    return packets.filter(cond)


def connection_packets(packets: DataFrame, n: int | None = None, connection_id: str | None = None) -> DataFrame:
    """Packets of each connection by (ts, seq), without payload: all of them, or the first ``n`` with their rank."""
    rows = _ensure_protocol(packets).select(
        X.natural_id(*[F.col(c) for c in CONNECTION_KEY]).alias("connection_id"),
        "seq", "ts", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "transport", "length", "origin_file",
    )
    if connection_id is not None:
        rows = rows.filter(F.col("connection_id") == connection_id)
    if n is None:
        return rows
    return top_n_per_key(rows, ["connection_id"], [F.col("ts"), F.col("seq")], n)
