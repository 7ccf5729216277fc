"""Network traffic derived from the ``events`` table.

Each event becomes one packet. The derivation is a list of column definitions in
SQL that Spark and ANSI engines both run, so that the same packets exist on both
sides of a comparison. ``k`` is the number in ``props``, ``u`` the user, ``c`` the
client class, ``s`` the server index, ``sp`` the server port, ``resp`` whether the
server speaks.

Variants: ``base`` (12 clients), ``wide`` (one client per user), ``replay`` (base,
30 days squeezed into a quarter of a second, with a pause on a third of the
servers), ``flat`` (base with all private hosts in one /24).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions.scale import compiled, shared_dir

EPOCH_US = 1704067200000000  # 2024-01-01T00:00:00Z
PAUSE_US = 1705363200000000  # 2024-01-16T00:00:00Z
VARIANTS = ("base", "wide", "replay", "flat")

_SPARK = {
    "div": "div",
    "us": "unix_micros",
    "mk": "timestamp_micros",
    "ts": "CAST(ts AS TIMESTAMP)",
}
_DUCK = {"div": "//", "us": "epoch_us", "mk": "make_timestamp", "ts": "ts"}


def _h2(expr: str) -> str:
    return f"lpad(hex({expr}), 2, '0')"


def _h4(expr: str) -> str:
    return f"lpad(hex({expr}), 4, '0')"


def _steps(variant: str, d: dict[str, str]) -> list[list[tuple[str, str]]]:
    div, us, mk = d["div"], d["us"], d["mk"]
    wide, flat = variant == "wide", variant == "flat"
    if wide:
        client = (
            f"CASE WHEN tr THEN '10.66.' || ((b {div} 250) % 250) || '.' || (b % 250 + 1) "
            f"WHEN u % 40 = 3 THEN '203.0.113.' || ((u {div} 40) % 250 + 1) "
            f"ELSE '10.' || (u {div} 2000) || '.' || (u % 8) || '.' || ((u {div} 8) % 250 + 1) END"
        )
        relay, member = "'10.0.6.1'", "u"
    elif flat:
        client = (
            "CASE WHEN c = 3 THEN '203.0.113.4' ELSE '10.200.0.' || (100 + c) END"
        )
        relay, member = "'10.200.0.106'", "c"
    else:
        client = (
            f"CASE WHEN tr THEN '10.66.' || ((b {div} 250) % 250) || '.' || (b % 250 + 1) "
            "WHEN c = 3 THEN '203.0.113.4' ELSE '10.10.' || (c % 3) || '.' || (c + 1) END"
        )
        relay, member = "'10.10.0.7'", "c"
    server = "'10.200.0.' || (s + 1)" if flat else "'10.200.' || (s % 3) || '.' || (s % 10 + 1)"
    when = d["ts"]
    if variant == "replay":
        pause = f"CASE WHEN s % 3 = 0 AND {us}({when}) >= {PAUSE_US} THEN 3600000000 ELSE 0 END"
        when = f"{mk}({EPOCH_US} + ({us}({when}) - {EPOCH_US}) {div} 10000000 + {pause})"

    def mac(m: str, odd: str = "FALSE") -> str:
        return (
            f"lower('00:1b:1b:' || CASE WHEN {odd} THEN 'ff' ELSE {_h2(f'({m} {div} 65536) % 256')} END || ':' "
            f"|| {_h2(f'({m} {div} 256) % 256')} || ':' || {_h2(f'{m} % 256')})"
        )

    port = f"""CASE
        WHEN tr THEN CASE WHEN event_id % 2 = 0 THEN 502 ELSE 80 END
        WHEN c = 1 THEN CASE WHEN k % 2 = 0 THEN 44818 ELSE 2222 END
        WHEN c = 4 THEN CASE WHEN k % 10 = 9 THEN 2455 ELSE 2404 END
        WHEN c IN (5, 9) THEN CASE k % 5 WHEN 0 THEN 22 WHEN 1 THEN 80 WHEN 2 THEN 3389 WHEN 3 THEN 443 ELSE 21 END
        WHEN c = 6 THEN 4840
        WHEN c = 8 THEN 502
        WHEN c = 10 THEN CASE k % 4 WHEN 0 THEN 2455 WHEN 1 THEN 9999 WHEN 2 THEN 8080 ELSE 443 END
        ELSE CASE k % 20
            WHEN 0 THEN 502 WHEN 1 THEN 502 WHEN 2 THEN 502 WHEN 10 THEN 502
            WHEN 3 THEN 20000 WHEN 4 THEN 20000 WHEN 5 THEN 44818 WHEN 6 THEN 102
            WHEN 7 THEN 47808 WHEN 8 THEN 2404 WHEN 9 THEN 4840 WHEN 11 THEN 22
            WHEN 12 THEN 80 WHEN 13 THEN 3389 WHEN 14 THEN 21 WHEN 15 THEN 2222
            WHEN 16 THEN 443 WHEN 17 THEN 1883 WHEN 18 THEN 2455
            ELSE CASE k {div} 20 WHEN 0 THEN 9999 WHEN 1 THEN 34962 WHEN 2 THEN 5094
                WHEN 3 THEN 18245 ELSE 5007 END
        END
    END"""
    return [
        [
            ("u", "user_id"),
            ("et", "event_type"),
            ("k", "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"),
            ("c", "CAST(user_id % 12 AS INT)"),
            ("b", f"event_id {div} 500"),
            # The flat site has no short-lived guests.
            ("tr", "FALSE" if flat else "event_id % 500 < 2"),
        ],
        [
            ("s", "CASE WHEN c = 8 OR tr THEN k % 10 ELSE k % 30 END"),
            ("sp", f"CAST({port} AS INT)"),
        ],
        [
            ("pts", when),
            ("relayed", "c = 11 AND sp = 4840 AND NOT tr"),
            ("resp", "NOT tr AND (et = 'view' OR k % 30 = 29 OR (c = 2 AND sp = 20000))"),
            ("cip_addr", client),
            ("cp", "CAST(49152 + u % 4 AS INT)"),
            (
                "cmac",
                f"CASE WHEN tr THEN lower('02:aa:00:00:00:' || {_h2('b % 256')}) "
                f"ELSE {mac(member, 'c = 7 AND event_id % 2 = 1')} END",
            ),
            ("unit", f"CASE WHEN c = 8 THEN k {div} 50 ELSE k % 8 END"),
        ],
        [
            ("sip", f"CASE WHEN relayed THEN {relay} ELSE {server} END"),
            (
                "smac",
                f"CASE WHEN relayed THEN {mac('6')} ELSE lower(CASE s % 3 WHEN 0 THEN '00:1c:06:' "
                f"WHEN 1 THEN '00:a0:45:' ELSE '00:90:e8:' END || '00:00:' || {_h2('s')}) END",
            ),
            ("fc", "CASE et WHEN 'purchase' THEN 6 WHEN 'error' THEN 8 WHEN 'signup' THEN 16 ELSE 3 END"),
            ("exc", "resp AND u % 25 = 1"),
            (
                "dfc",
                "CASE WHEN resp THEN CASE u % 3 WHEN 0 THEN 130 WHEN 1 THEN 129 ELSE 1 END "
                "ELSE CASE et WHEN 'purchase' THEN 3 WHEN 'error' THEN 5 WHEN 'signup' THEN 2 ELSE 1 END END",
            ),
            (
                "iec",
                "CASE WHEN resp THEN 36 ELSE CASE et WHEN 'click' THEN 100 WHEN 'purchase' THEN 45 "
                "WHEN 'error' THEN CASE WHEN u % 2 = 0 THEN 105 ELSE 46 END END END",
            ),
            (
                "s7",
                "CASE WHEN resp THEN 4 ELSE CASE et WHEN 'click' THEN 4 WHEN 'purchase' THEN 5 WHEN 'error' THEN "
                f"CASE (k {div} 20) % 4 WHEN 0 THEN 29 WHEN 1 THEN 26 WHEN 2 THEN 41 ELSE 40 END "
                "ELSE CASE WHEN u % 2 = 1 THEN 240 ELSE 27 END END END",
            ),
        ],
        [
            ("seq", "event_id"),
            ("src_mac", "CASE WHEN resp THEN smac ELSE cmac END"),
            ("dst_mac", "CASE WHEN resp THEN cmac ELSE smac END"),
            ("src_ip", "CASE WHEN resp THEN sip ELSE cip_addr END"),
            ("dst_ip", "CASE WHEN resp THEN cip_addr ELSE sip END"),
            ("transport", "CASE WHEN sp IN (47808, 2222, 34962) THEN 'udp' ELSE 'tcp' END"),
            ("src_port", "CASE WHEN resp THEN sp ELSE cp END"),
            ("dst_port", "CASE WHEN resp THEN cp ELSE sp END"),
            ("length", "CAST(60 + floor(value * 4) AS BIGINT)"),
            ("origin_file", "'cap' || (event_id % 2)"),
            (
                "hp",
                f"""CASE
        WHEN sp = 502 AND exc THEN {_h4('event_id % 65536')} || '00000003' || {_h2('unit')} || {_h2('fc + 128')} || '02'
        WHEN sp = 502 THEN {_h4('event_id % 65536')} || '00000006' || {_h2('unit')} || {_h2('fc')} || {_h4('k')} || '000A'
        WHEN sp = 20000 AND resp THEN '05640B44' || {_h2('100 + c')} || '00' || {_h2('s')} || '000000C0C1' || {_h2('dfc')}
        WHEN sp = 20000 THEN '05640BC4' || {_h2('s')} || '00' || {_h2('100 + c')} || '000000C0C1' || {_h2('dfc')}
        WHEN sp = 2404 AND iec IS NULL THEN '680407000000'
        WHEN sp = 2404 THEN '680E00000000' || {_h2('iec')} || '010600' || {_h2('s')} || '00' || {_h2('k')} || '0000'
        WHEN sp = 102 AND resp THEN '0300001F02F08032030000' || {_h4('k')} || '000200000000' || {_h2('s7')} || '00'
        WHEN sp = 102 THEN '0300001F02F08032010000' || {_h4('k')} || '00020000' || {_h2('s7')} || '00'
        WHEN sp IN (44818, 2222) AND NOT resp AND et = 'click' THEN '630000000100000000000000000000000000000000000000'
        WHEN sp IN (44818, 2222) AND NOT resp AND et = 'signup' THEN '650000000100000000000000000000000000000000000000'
        WHEN sp IN (44818, 2222) THEN '6F0010000100000000000000000000000000000000000000'
        WHEN sp = 47808 THEN '810A001101040000'
        WHEN sp = 4840 AND et = 'purchase' THEN '48454C46'
        ELSE '' END""",
            ),
            (
                "cip_service",
                "CASE WHEN sp IN (44818, 2222) THEN CASE WHEN resp THEN 'read' WHEN et = 'purchase' THEN 'write' "
                "WHEN et = 'error' THEN 'read' END END",
            ),
            (
                "cip_class",
                "CASE WHEN sp IN (44818, 2222) THEN CASE WHEN resp THEN 'identity' WHEN et = 'purchase' "
                "THEN 'assembly' WHEN et = 'error' THEN 'file' END END",
            ),
            (
                "cip_is_response",
                "CASE WHEN sp IN (44818, 2222) AND (resp OR et IN ('purchase', 'error')) THEN resp END",
            ),
            ("bacnet_role", "CASE WHEN sp = 47808 THEN CASE WHEN resp THEN 'server' ELSE 'client' END END"),
            (
                "bacnet_service",
                "CASE WHEN sp = 47808 THEN CASE WHEN resp OR et = 'click' THEN 'read_property' "
                "WHEN et = 'purchase' THEN 'write_property' WHEN et = 'error' THEN CASE WHEN u % 2 = 0 "
                "THEN 'reinitialize_device' ELSE 'device_communication_control' END ELSE 'who_is' END END",
            ),
            (
                "bacnet_object",
                "CASE WHEN sp = 47808 THEN CASE WHEN NOT resp AND et = 'purchase' THEN CASE u % 3 WHEN 0 "
                "THEN 'analog_output' WHEN 1 THEN 'binary_output' ELSE 'notification_class' END ELSE 'device' END END",
            ),
            (
                "pn_role",
                "CASE WHEN sp = 34962 THEN CASE WHEN resp THEN 'io_device' WHEN u % 2 = 0 THEN 'io_controller' "
                "ELSE 'unknown' END END",
            ),
            ("pn_station", "CASE WHEN sp = 34962 AND resp THEN 'pn-' || k END"),
        ],
    ]


_COLUMNS = [
    "seq", "pts AS ts", "src_mac", "dst_mac", "src_ip", "dst_ip", "transport", "src_port", "dst_port", "length",
    "unhex(hp) AS payload", "origin_file", "cip_service", "cip_class", "cip_is_response",
    "bacnet_role", "bacnet_service", "bacnet_object", "pn_role", "pn_station",
]
# What the packet was made from; only comparisons look at these.
_TRUTH = ["u", "et", "k", "c", "s", "sp", "resp", "unit", "fc", "exc", "dfc", "iec", "s7", "event_id", "ts AS event_ts"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def derive_packets(spark: SparkSession, sf_dir: str, variant: str = "base", where: str | None = None) -> DataFrame:
    """Packet rows computed from the events; ``where`` is a condition on the events."""
    df = events(spark, sf_dir)
    if where:
        df = df.filter(where)
    for step in _steps(variant, _SPARK):
        df = df.selectExpr("*", *[f"{expr} AS {name}" for name, expr in step])
    return df.selectExpr(*_COLUMNS)


_STAGED: dict[tuple, str] = {}


def identity(spark: SparkSession, sf_dir: str) -> tuple:
    """What tells one state of the events from another: time of change and size."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getFileStatus(path).getModificationTime(), files.getContentSummary(path).getLength()


def packets_path(spark: SparkSession, sf_dir: str, variant: str = "base", where: str | None = None) -> str:
    """Folder of the packet table of a variant, written once per application and state of the events."""
    key = (spark.sparkContext.applicationId, sf_dir, identity(spark, sf_dir), variant, where)
    if key not in _STAGED:
        path = f"{shared_dir(spark).rstrip('/')}/packets-{variant}-{uuid.uuid4().hex}"
        rows = derive_packets(spark, sf_dir, variant, where)
        with compiled(spark):
            rows.write.parquet(path)
        _STAGED[key] = path
    return _STAGED[key]


def packets(spark: SparkSession, sf_dir: str, variant: str = "base", where: str | None = None) -> DataFrame:
    """Packet table of a variant.

    Analyses start from a stored packet table, so that filters and columns reach the
    scan instead of the derivation.
    """
    path = packets_path(spark, sf_dir, variant, where)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(path)


def packets_sql(variant: str = "base", where: str | None = None, name: str = "pk") -> str:
    """The same table as a chain of common table expressions for DuckDB."""
    parts = []
    source = "events"
    for i, step in enumerate(_steps(variant, _DUCK)):
        cond = f" WHERE {where}" if where and i == 0 else ""
        columns = ", ".join(f"{expr} AS {col}" for col, expr in step)
        parts.append(f"{name}_{i} AS (SELECT *, {columns} FROM {source}{cond})")
        source = f"{name}_{i}"
    by_port = (
        "CASE {p} WHEN 502 THEN 'modbus' WHEN 20000 THEN 'dnp3' WHEN 44818 THEN 'ethernet_ip' "
        "WHEN 2222 THEN 'ethernet_ip' WHEN 47808 THEN 'bacnet' WHEN 102 THEN 's7comm' WHEN 4840 THEN 'opc_ua' "
        "WHEN 34962 THEN 'profinet' WHEN 2404 THEN 'iec104' WHEN 1883 THEN 'mqtt' WHEN 5094 THEN 'hart_ip' "
        "WHEN 18245 THEN 'ge_srtp' WHEN 5007 THEN 'wonderware_suitelink' WHEN 80 THEN 'http' WHEN 8080 THEN 'http' "
        "WHEN 443 THEN 'https' WHEN 22 THEN 'ssh' WHEN 3389 THEN 'rdp' END"
    )
    proto = f"coalesce({by_port.format(p='dst_port')}, {by_port.format(p='src_port')}, 'unknown') AS protocol"
    columns = ", ".join(_COLUMNS + _TRUTH + [proto])
    parts.append(f"{name} AS (SELECT {columns} FROM {source})")
    return ",\n".join(parts)
