"""Explicit schemas of the tables that sources read and operators exchange."""

from pyspark.sql import types as T

_S, _I, _L, _TS, _B = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType(), T.BooleanType()


def _schema(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


PACKETS = _schema(
    ("seq", _L), ("ts", _TS), ("src_mac", _S), ("dst_mac", _S), ("src_ip", _S), ("dst_ip", _S),
    ("transport", _S), ("src_port", _I), ("dst_port", _I), ("length", _L),
    ("payload", T.BinaryType()), ("origin_file", _S),
)

# Fields of variable-length protocols that an upstream dissector supplies with a packet.
APP_FIELDS = _schema(
    ("cip_service", _S), ("cip_class", _S), ("cip_is_response", _B),
    ("bacnet_role", _S), ("bacnet_service", _S), ("bacnet_object", _S),
    ("pn_role", _S), ("pn_station", _S),
)

CONNECTIONS = _schema(
    ("connection_id", _S), ("src_ip", _S), ("src_port", _I), ("src_mac", _S),
    ("dst_ip", _S), ("dst_port", _I), ("dst_mac", _S), ("protocol", _S), ("transport", _S),
    ("packet_count", _L), ("byte_count", _L), ("first_seen", _TS), ("last_seen", _TS),
    ("origin_files", T.ArrayType(_S)),
)

INGESTED_CONNECTIONS = _schema(
    ("src_ip", _S), ("src_port", _I), ("dst_ip", _S), ("dst_port", _I), ("protocol", _S),
    ("transport", _S), ("packet_count", _L), ("byte_count", _L),
    ("first_seen", _TS), ("last_seen", _TS), ("source", _S),
)

PORT_SERVICE = _schema(
    ("port", _I), ("protocol", _S), ("service_name", _S), ("service_version", _S), ("product", _S),
)

INGESTED_ASSETS = _schema(
    ("ip_address", _S), ("mac_address", _S), ("hostname", _S), ("device_type", _S), ("vendor", _S),
    ("protocols", T.ArrayType(_S)), ("open_ports", T.ArrayType(PORT_SERVICE)), ("os_info", _S),
    ("source", _S), ("is_active", _B),
)

ALERTS = _schema(
    ("timestamp", _TS), ("src_ip", _S), ("src_port", _I), ("dst_ip", _S), ("dst_port", _I),
    ("signature_id", _L), ("signature", _S), ("category", _S), ("severity", _I), ("source", _S),
)

FINDINGS = _schema(
    ("id", _S), ("finding_type", _S), ("severity", _S), ("title", _S), ("technique_id", _S),
    ("affected_assets", T.ArrayType(_S)), ("evidence", _S),
)
