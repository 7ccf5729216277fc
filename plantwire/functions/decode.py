"""Fixed-offset protocol fields as column expressions over the packet payload.

:func:`with_head` turns the first bytes of the payload into hex text once per row;
every field is a slice of that text. Each ``*_fields`` function returns named columns.
:func:`is_frame` tests the payload bytes themselves, so that the test can run in the
scan's filter without any of the decoding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C

_HEAD = 32  # bytes: longest fixed part of any header but S7, which has its own slice
HELPERS = ("_n", "_h", "_s7", "_cmd")


def _lookup(values: dict[int, str], code: Column) -> Column:
    table = F.create_map(*[F.lit(x).cast("bigint") if isinstance(x, int) else F.lit(x) for pair in values.items() for x in pair])
    return F.try_element_at(table, code)


def _slice(text: Column, offset: int, size: int) -> Column:
    return F.substring(text, 2 * offset + 1, 2 * size)


def _number(text: Column, size: int) -> Column:
    return F.when(F.length(text) == 2 * size, F.conv(text, 16, 10).cast("bigint"))


def be(offset: int, size: int = 1, text: str = "_h") -> Column:
    """Big-endian unsigned integer, null past the end of the payload."""
    return _number(_slice(F.col(text), offset, size), size)


def le(offset: int, size: int) -> Column:
    return _number(F.concat(*[_slice(F.col("_h"), offset + i, 1) for i in reversed(range(size))]), size)


def _int(column: Column) -> Column:
    return column.cast("int")


def _bit(column: Column, mask: int) -> Column:
    return column.bitwiseAND(mask) != 0


def is_frame(protocol: str, payload: Column) -> Column:
    """Does the payload begin like a frame of the protocol?"""
    n = F.octet_length(payload)
    at = lambda i, text: F.substring(payload, i + 1, len(text) // 2) == F.lit(bytes.fromhex(text))
    return {
        "modbus": lambda: (n >= 8) & at(2, "0000"),
        "dnp3": lambda: (n >= 10) & at(0, "0564"),
        "iec104": lambda: (n >= 6) & at(0, "68"),
        "s7comm": lambda: (n >= 6) & at(0, "03"),
        "ethernet_ip": lambda: n >= 24,
    }[protocol]()


def with_head(packets: DataFrame) -> DataFrame:
    """Add the columns that the field functions read; drop them with ``HELPERS``."""
    proto = F.col("protocol")
    packets = packets.withColumns(
        {
            "_n": F.coalesce(F.octet_length("payload"), F.lit(0)),
            "_h": F.hex(F.substring("payload", 1, _HEAD)),
        }
    )
    # The S7 header starts behind a COTP header of variable length.
    start = F.lit(6) + be(4)
    s7 = F.when((proto == "s7comm") & (be(5) == 0xF0), F.hex(F.substring("payload", start.cast("int"), F.lit(14))))
    command = F.when(proto == "ethernet_ip", F.coalesce(_lookup(C.ENIP_COMMANDS, le(0, 2)), F.lit("unknown")))
    return packets.withColumns({"_s7": s7, "_cmd": command})


def modbus_fields() -> dict[str, Column]:
    n, src_port, dst_port = F.col("_n"), F.col("src_port"), F.col("dst_port")
    raw = be(7)
    code = raw.bitwiseAND(0x7F)
    exception = raw >= 0x80
    master, slave = dst_port == 502, (dst_port != 502) & (src_port == 502)
    kind = (
        F.when(code.isin(1, 5, 15), "coil")
        .when(code == 2, "discrete_input")
        .when(code.isin(3, 6, 16, 23), "holding_register")
        .when(code == 4, "input_register")
    )
    has_range = (n >= 12) & (
        (master & code.isin(1, 2, 3, 4, 5, 6, 15, 16, 23)) | (slave & code.isin(15, 16))
    )
    count = F.when(master & code.isin(5, 6), F.lit(1)).otherwise(be(10, 2))
    return {
        "transaction_id": _int(be(0, 2)),
        "unit_id": _int(be(6)),
        "function_code": _int(code),
        "is_exception": exception,
        "exception_code": _int(F.when(exception & (n >= 9), be(8))),
        "role": F.when(master, "master").when(slave, "slave").otherwise("unknown"),
        "reg_start": _int(F.when(has_range, be(8, 2))),
        "reg_count": _int(F.when(has_range, count)),
        "reg_type": F.when(has_range, kind),
        "sub_function": _int(F.when((code == 8) & (n >= 10), be(8, 2))),
    }


def dnp3_fields() -> dict[str, Column]:
    control, code = be(3), be(12)
    role = (
        F.when(_bit(control, 0x80), "master")
        .when((F.col("src_port") == 20000) | (F.col("dst_port") != 20000), "outstation")
        .otherwise("unknown")
    )
    return {
        "from_master": _bit(control, 0x80),
        "is_primary": _bit(control, 0x40),
        "destination_address": _int(le(4, 2)),
        "source_address": _int(le(6, 2)),
        "function_code": _int(code),
        "is_unsolicited": F.coalesce(code == 130, F.lit(False)),
        "role": role,
    }


def iec104_fields() -> dict[str, Column]:
    n, control = F.col("_n"), be(2)
    numbered = ~_bit(control, 0x01) & (n > 6)
    kind = be(6)
    command = F.coalesce(numbered & (kind.between(45, 69) | kind.between(100, 107)), F.lit(False))
    monitor = F.coalesce(numbered & kind.between(1, 44), F.lit(False))
    return {
        "frame_type": F.when(~_bit(control, 0x01), "i").when(control.bitwiseAND(3) == 1, "s").otherwise("u"),
        "type_id": _int(F.when(numbered, kind)),
        "cause": _int(F.when(numbered & (n > 8), be(8).bitwiseAND(0x3F))),
        "common_address": _int(F.when(numbered & (n >= 12), le(10, 2))),
        "first_ioa": _int(F.when(numbered & (n >= 15), le(12, 3))),
        "is_command": command,
        "is_monitor": monitor,
        "role": F.when(command, "master").when(monitor, "outstation").otherwise("unknown"),
    }


def s7_fields() -> dict[str, Column]:
    """Fields behind the COTP header; all null unless a whole S7 header follows it."""
    text = F.col("_s7")
    whole = (F.length(text) >= 20) & text.startswith("32")
    control = F.when(whole, be(1, 1, "_s7"))
    code = F.when(
        whole & (be(6, 2, "_s7") > 0), F.when(control.isin(2, 3), be(12, 1, "_s7")).otherwise(be(10, 1, "_s7"))
    )
    return {
        "rosctr": _int(control),
        "s7_function": F.when(code.isNotNull(), F.coalesce(_lookup(C.S7_FUNCTIONS, code), F.lit("unknown"))),
        "role": F.when(control.isin(1, 7), "client").when(control.isin(2, 3), "server").otherwise("unknown"),
    }


def enip_fields() -> dict[str, Column]:
    return {
        "command": F.col("_cmd"),
        "data_length": _int(le(2, 2)),
        "session": le(4, 4),
        "status": le(8, 4),
    }
