"""Device signatures: AND of filters per rule, best match per device, payload fields.

A rule is a small dict (it is configuration, like the rule files it comes from)::

    {"name": ..., "confidence": 4, "vendor": ..., "product_family": ...,
     "device_type": ..., "role": ...,
     "filters": [{"field": "tcp.dst_port", "value": 502},
                 {"field": "payload", "pattern": "0564", "offset": 0, "min_length": 7},
                 {"field": "mac.src_oui", "value": "00:0e:8c"}]}

Rules become boolean expressions over the packet row, so matching needs no join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as X
from ..functions.scale import top_n_per_key
from .packets import _ensure_protocol

# --- fixed values: built-in rules -----------------------------------------------


def _rule(name, confidence, *filters, vendor=None, product=None, device_type=None, role=None):
    return {
        "name": name, "confidence": confidence, "filters": list(filters), "vendor": vendor,
        "product_family": product, "device_type": device_type, "role": role,
    }


def _port(field, value):
    return {"field": field, "value": value}


def _bytes(pattern, offset=None):
    return {"field": "payload", "pattern": pattern, "offset": offset}


def _oui(value):
    return {"field": "mac.src_oui", "value": value}


RULES = [
    _rule("abb_mac", 3, _oui("00:80:25"), vendor="ABB", device_type="plc"),
    _rule("bacnet_npdu_version", 4, _port("udp.dst_port", 47808), _bytes("81", 0), _bytes("01", 4),
          device_type="building_controller"),
    _rule("bacnet_bvlc", 4, _port("udp.dst_port", 47808), _bytes("81", 0)),
    _rule("bacnet_generic", 1, _port("udp.dst_port", 47808)),
    _rule("dnp3_generic", 1, _port("tcp.dst_port", 20000), device_type="rtu", role="slave"),
    _rule("dnp3_start_bytes", 4, _port("tcp.dst_port", 20000), _bytes("0564", 0), device_type="rtu", role="slave"),
    _rule("enip_list_identity", 2, _port("tcp.dst_port", 44818), _bytes("6300", 0), device_type="plc"),
    _rule("ethernet_ip_generic", 1, _port("tcp.dst_port", 44818), device_type="plc"),
    _rule("ethernet_ip_register_session", 4, _port("tcp.dst_port", 44818), _bytes("0065", 0), device_type="plc"),
    _rule("ge_srtp_generic", 1, _port("tcp.dst_port", 18245), vendor="GE", device_type="plc"),
    _rule("hart_ip_generic", 1, _port("tcp.dst_port", 5094)),
    _rule("iec104_startdt_act", 4, _port("tcp.dst_port", 2404), _bytes("680407000000", 0), device_type="rtu"),
    _rule("iec104_generic", 1, _port("tcp.dst_port", 2404), device_type="rtu"),
    _rule("iec104_start_byte", 4, _port("tcp.dst_port", 2404), _bytes("68", 0), device_type="rtu"),
    _rule("modbus_generic", 1, _port("tcp.dst_port", 502), device_type="rtu", role="slave"),
    _rule("modbus_server_response", 2, _port("tcp.src_port", 502), {"field": "payload", "min_length": 7},
          device_type="rtu", role="slave"),
    _rule("mqtt_generic", 1, _port("tcp.dst_port", 1883)),
    _rule("opc_ua_generic", 1, _port("tcp.dst_port", 4840)),
    _rule("opc_ua_hello", 4, _port("tcp.dst_port", 4840), _bytes("48454c", 0)),
    _rule("profinet_dcp_identify", 2, _port("udp.dst_port", 34964), _bytes("0500", 0), vendor="Siemens",
          device_type="plc"),
    _rule("profinet_generic", 1, _port("dst_port", 34962), vendor="Siemens"),
    _rule("rockwell_ethernet_ip", 4, _port("tcp.dst_port", 44818), _bytes("526f636b77656c6c"),
          vendor="Rockwell Automation", product="ControlLogix", device_type="plc", role="slave"),
    _rule("rockwell_mac", 3, _oui("00:00:bc"), vendor="Rockwell Automation", device_type="plc"),
    _rule("s7comm_protocol_id", 3, _port("tcp.dst_port", 102), _bytes("32", 7), vendor="Siemens", device_type="plc"),
    _rule("s7comm_cotp_connect", 4, _port("tcp.dst_port", 102), _bytes("0300", 0), vendor="Siemens",
          device_type="plc"),
    _rule("s7comm_generic", 1, _port("tcp.dst_port", 102), vendor="Siemens", device_type="plc"),
    _rule("schneider_mac", 3, _oui("00:80:f4"), vendor="Schneider Electric", device_type="plc"),
    _rule("schneider_modbus", 4, _port("tcp.dst_port", 502), _bytes("5363686e6569646572"),
          vendor="Schneider Electric", product="Modicon M340", device_type="plc", role="slave"),
    _rule("siemens_s7_mac", 3, _oui("00:0e:8c"), vendor="Siemens", device_type="plc"),
    _rule("siemens_scalance", 3, _oui("00:0e:8c"), _port("dst_port", 34962), vendor="Siemens",
          product="SCALANCE", device_type="switch"),
    _rule("wonderware_suitelink", 1, _port("tcp.dst_port", 5007), vendor="Wonderware",
          device_type="scada_server", role="server"),
]

_MATCH_TYPE = T.StructType(
    [
        T.StructField("signature_name", T.StringType()),
        T.StructField("confidence", T.IntegerType()),
        T.StructField("vendor", T.StringType()),
        T.StructField("product_family", T.StringType()),
        T.StructField("device_type", T.StringType()),
        T.StructField("role", T.StringType()),
    ]
)


def _filter_conditions(spec: dict) -> list[Column]:
    field = spec["field"]
    out: list[Column] = []
    if field.endswith(("dst_port", "src_port")):
        # A port filter without a value says nothing; a bare field name means TCP.
        if spec.get("value") is not None:
            transport = "udp" if field.startswith("udp.") else "tcp"
            side = field.rsplit(".", 1)[-1]
            out.append((F.col("transport") == transport) & (F.col(side) == int(spec["value"])))
    elif field == "protocol":
        if spec.get("value") is not None:
            out.append(F.col("protocol") == str(spec["value"]).lower())
    elif field in ("mac.src_oui", "mac.dst_oui"):
        if spec.get("value") is not None:
            mac = F.col("src_mac" if "src" in field else "dst_mac")
            out.append(F.lower(F.substring(mac, 1, 8)) == str(spec["value"]).lower())
    else:
        if spec.get("pattern") is not None:
            pattern = bytes.fromhex(spec["pattern"])
            if spec.get("offset") is None:
                found = F.contains(F.col("payload"), F.lit(pattern))
            else:
                found = F.substring("payload", int(spec["offset"]) + 1, len(pattern)) == F.lit(pattern)
            out.append((F.octet_length("payload") > 0) & found)
        if field == "payload" and spec.get("min_length") is not None:
            out.append(F.octet_length("payload") >= int(spec["min_length"]))
    return out


def _condition(rule: dict) -> Column:
    parts = [c for spec in rule["filters"] for c in _filter_conditions(spec)]
    return F.coalesce(reduce(lambda a, b: a & b, parts, F.lit(True)), F.lit(False))


def _match_struct(rule: dict) -> Column:
    names = ("vendor", "product_family", "device_type", "role")
    return F.struct(
        F.lit(rule["name"]).alias("signature_name"),
        F.lit(int(rule["confidence"])).alias("confidence"),
        *[F.lit(rule.get(n)).cast("string").alias(n) for n in names],
    ).cast(_MATCH_TYPE)


def match_signatures(packets: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """One row per (packet, matching rule)."""
    rules = RULES if rules is None else rules
    hits = F.array_compact(F.array(*[F.when(_condition(r), _match_struct(r)) for r in rules]))
    return (
        _ensure_protocol(packets)
        .select("seq", "ts", "src_ip", "dst_ip", "src_port", "dst_port", F.explode(hits).alias("m"))
        .select("seq", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "m.*")
    )


def best_signature_matches(packets: DataFrame, rules: list[dict] | None = None, cap: int | None = None) -> DataFrame:
    """Per device (both ends of a packet) and signature: confidence and rank, best first.

    ``cap`` limits the packets looked at per device to its first ``cap``; without it
    every packet counts.
    """
    packets = _ensure_protocol(packets)
    ends = F.explode(F.array("src_ip", "dst_ip")).alias("ip")
    if cap is not None:
        needed = [
            "seq", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "transport", "protocol",
            "src_mac", "dst_mac", "payload",
        ]
        sampled = top_n_per_key(
            packets.select(*needed, ends), ["ip"], [F.col("ts"), F.col("seq")], cap
        )
        hits = F.array_compact(
            F.array(*[F.when(_condition(r), _match_struct(r)) for r in (RULES if rules is None else rules)])
        )
        matches = sampled.select("ip", F.explode(hits).alias("m")).select("ip", "m.*")
    else:
        matches = match_signatures(packets, rules).select(ends, *_MATCH_TYPE.fieldNames())
    from pyspark.sql.window import Window

    best = matches.groupBy("ip", "signature_name").agg(
        F.max("confidence").alias("confidence"),
        *[F.max(n).alias(n) for n in ("vendor", "product_family", "device_type", "role")],
    )
    order = Window.partitionBy("ip").orderBy(F.desc("confidence"), "signature_name")
    return best.withColumn("match_rank", F.row_number().over(order))


def asset_signatures(assets: DataFrame, best: DataFrame) -> DataFrame:
    """Assets with ``signature_matches``: name and confidence of each signature they match, best first.

    ``best``: output of ``best_signature_matches``. An array is as long as the list of signatures at most.
    """
    matches = F.array_sort(F.collect_list(F.struct("match_rank", "signature_name", "confidence")))
    lists = best.groupBy(F.col("ip").alias("ip_address")).agg(matches.alias("_m"))
    shown = F.transform(F.coalesce("_m", F.array()), lambda m: F.struct(m["signature_name"].alias("signature_name"), m["confidence"].alias("confidence")))
    return assets.join(lists, "ip_address", "left").withColumn("signature_matches", shown).drop("_m")


def extract_payload_fields(packets: DataFrame, extractors: list[dict]) -> DataFrame:
    """Slices of the payload as text: label, offset, length (0 = rest), format
    ``ascii`` | ``hex`` | ``uint16_be`` | ``uint16_le``. Empty values are dropped."""
    size = F.octet_length("payload")
    values = []
    for spec in extractors:
        offset, length = int(spec.get("offset") or 0), int(spec.get("length") or 0)
        part = F.substring("payload", offset + 1, length) if length else F.expr(f"substring(payload, {offset + 1})")
        digits = F.hex(part)
        if spec["format"] == "ascii":
            text = F.substring_index(F.decode(part, "ISO-8859-1"), "\u0000", 1)
            value = F.regexp_replace(text, "[^\\x20-\\x7e]", "")
        elif spec["format"] == "hex":
            value = F.trim(F.regexp_replace(F.lower(digits), "(..)", "$1 "))
        elif spec["format"] in ("uint16_be", "uint16_le"):
            high, low = F.substring(digits, 1, 2), F.substring(digits, 3, 2)
            pair = F.concat(high, low) if spec["format"] == "uint16_be" else F.concat(low, high)
            value = F.when(F.length(digits) >= 4, F.conv(pair, 16, 10))
        else:
            continue
        present = (size > offset) & (F.length(value) > 0)
        values.append(
            F.when(present, F.struct(F.lit(spec["label"]).alias("label"), value.alias("value")))
        )
    found = F.array_compact(F.array(*values))
    return packets.select("seq", F.explode(found).alias("v")).select("seq", "v.label", "v.value")


def test_signature(connections: DataFrame, rule: dict) -> DataFrame:
    """Try one rule on connections, taken as packets without payload."""
    as_packets = connections.withColumn("payload", F.lit(b""))
    return as_packets.filter(_condition(rule)).select(
        "src_ip", "dst_ip", "src_port", "dst_port",
        F.lit(rule["name"]).alias("signature_name"), F.lit(int(rule["confidence"])).alias("confidence"),
    )


test_signature.__test__ = False
