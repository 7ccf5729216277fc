"""Findings: the row shape shared by all rules, and the snapshot they read.

A finding names the device it is about and, where the rule is about a pair, the
other one. Rules over many targets carry the number of targets; the targets
themselves stay a table (``finding_targets``), so that no scanner's target list has
to fit into one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import columns as X
from ..functions.scale import stage


@dataclass
class Snapshot:
    """Tables of one capture that the rules read.

    ``devices`` is the output of ``device_protocol_info``; the others are named after
    the operators that build them.
    """

    assets: DataFrame
    connections: DataFrame
    devices: DataFrame
    stats: DataFrame | None = None
    function_codes: DataFrame | None = None
    modbus_peers: DataFrame | None = None
    dnp3_peers: DataFrame | None = None
    polling: DataFrame | None = None
    context: dict[str, DataFrame] | None = None

    def staged(self) -> "Snapshot":
        """Write the tables once, because every rule reads some of them."""
        names = ("assets", "connections", "devices", "stats", "function_codes", "modbus_peers", "dnp3_peers", "polling")
        tables = {n: getattr(self, n) for n in names}
        return Snapshot(**{n: stage(t, n) if t is not None else None for n, t in tables.items()})


def finding(
    rows: DataFrame, kind: str, severity: str | Column, title: Column, evidence: Column,
    technique: str | None, *assets: str,
) -> DataFrame:
    """Shape rule rows into findings; the id is the hash of type, technique, title and assets."""
    sev = F.lit(severity) if isinstance(severity, str) else severity
    names = F.array(*[F.col(a) for a in assets]) if assets else F.array().cast("array<string>")
    out = rows.select(
        F.lit(kind).alias("finding_type"), sev.alias("severity"), title.alias("title"),
        F.lit(technique).cast("string").alias("technique_id"), names.alias("affected_assets"),
        evidence.alias("evidence"),
    )
    key = [F.col(c) for c in ("finding_type", "technique_id", "title")] + [F.array_join("affected_assets", ",")]
    return out.withColumn("id", X.natural_id(*[F.coalesce(c, F.lit("")) for c in key]))


def attack(rows: DataFrame, severity, title: Column, evidence: Column, technique, *assets: str) -> DataFrame:
    return finding(rows, "attack_technique", severity, title, evidence, technique, *assets)


def text(template: str, *columns) -> Column:
    return F.format_string(template, *[F.col(c) if isinstance(c, str) else c for c in columns])


def severity_rank(column: Column | str = "severity") -> Column:
    return X.rank_of(F.col(column) if isinstance(column, str) else column, C.SEVERITY_RANK)


def described(findings: DataFrame, as_of: Column) -> DataFrame:
    """Findings with ``description``, what such a finding means, and ``as_of``, the time they hold for."""
    meaning = F.lit(None).cast("string")
    for table, column in ((C.MEANING_BY_TYPE, "finding_type"), (C.MEANING_BY_TECHNIQUE, "technique_id")):
        names = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
        meaning = F.coalesce(F.try_element_at(names, F.col(column)), meaning)
    return findings.withColumn("description", meaning).withColumn("as_of", as_of)


def with_type(table: DataFrame, assets: DataFrame, ip: str, name: str = "device_type") -> DataFrame:
    """Add the device type of an address; unknown addresses are ``unknown``."""
    kinds = assets.select(F.col("ip_address").alias(ip), F.col("device_type").alias(name))
    return table.join(kinds, ip, "left").withColumn(name, F.coalesce(name, F.lit("unknown")))


def _ot_ips(s: Snapshot) -> DataFrame:
    reached = s.connections.filter(F.col("dst_port").isin(*C.OT_PORTS)).select("dst_ip")
    return s.assets.filter(F.col("device_type").isin(*C.OT_DEVICE_TYPES)).select("ip_address").union(reached).distinct()


def _ip_macs(s: Snapshot) -> DataFrame:
    macs = F.explode(
        F.array(
            F.struct(F.col("src_ip").alias("ip_address"), F.col("src_mac").alias("mac")),
            F.struct(F.col("dst_ip").alias("ip_address"), F.col("dst_mac").alias("mac")),
        )
    )
    seen = s.connections.select(macs.alias("m")).select("m.*").union(s.assets.select("ip_address", "mac_address"))
    return seen.filter(F.col("mac").isNotNull()).withColumn("mac", F.lower("mac")).distinct()


def _write_counts(s: Snapshot) -> DataFrame:
    masters = s.devices.filter(F.col("modbus.role").isin("master", "both")).select(
        "ip", F.col("modbus.write_count").alias("write_count")
    )
    slaves = s.modbus_peers.filter("remote_role = 'slave'").select("ip", "remote_ip")
    return slaves.join(masters, "ip").select(
        F.col("ip").alias("src_ip"), F.col("remote_ip").alias("dst_ip"), "write_count"
    )


def _read_targets(s: Snapshot) -> DataFrame:
    reached = s.connections.filter(F.col("dst_port").isin(*C.OT_PORTS)).select("src_ip", "dst_ip").distinct()
    return reached.join(_write_counts(s).select("src_ip", "dst_ip"), ["src_ip", "dst_ip"], "left_anti")


_CONTEXT = {
    "ot_ips": _ot_ips,
    "external_ips": lambda s: s.assets.filter("is_public_ip").select("ip_address"),
    "ip_macs": _ip_macs,
    "src_ports": lambda s: s.connections.select("src_ip", "dst_port").distinct(),
    "write_targets": lambda s: _write_counts(s).select("src_ip", "dst_ip"),
    "write_counts": lambda s: _write_counts(s).filter("write_count > 0"),
    "read_targets": _read_targets,
}


def capture_context(snapshot: Snapshot) -> dict[str, DataFrame]:
    """Helper tables derived from a snapshot, each a table of distinct rows.

    ot_ips (OT device types and destinations on OT ports), external_ips, ip_macs,
    src_ports, write_targets, write_counts, read_targets.
    """
    return {name: build(snapshot) for name, build in _CONTEXT.items()}


class _Lazy(dict):
    def __init__(self, snapshot):
        super().__init__()
        self.snapshot = snapshot

    def __missing__(self, name):
        self[name] = _CONTEXT[name](self.snapshot)
        return self[name]


def context_of(snapshot: Snapshot) -> dict[str, DataFrame]:
    """The context of a snapshot, built table by table as rules ask for it."""
    if snapshot.context is None:
        snapshot.context = _Lazy(snapshot)
    return snapshot.context


def flag(table: DataFrame, ids: DataFrame, ip: str, name: str) -> DataFrame:
    """Add a boolean: is the address in ``ids`` (ip_address)?"""
    marked = ids.select(F.col("ip_address").alias(ip), F.lit(True).alias(name))
    return table.join(marked, ip, "left").withColumn(name, F.coalesce(name, F.lit(False)))
