"""Registry of named queries and the SQL each one must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binding
from .site import Site, site_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BEFORE, AFTER = "ts < '2024-01-16'", "ts >= '2024-01-16'"
# Suffix of the SQL names → (variant, condition on the events).
SITES = {
    "": ("base", None), "w": ("wide", None), "r": ("replay", None), "f": ("flat", None),
    "b": ("base", BEFORE), "c": ("base", AFTER), "m": ("base", None),
}
#: Labels of a sensor, right or wrong, on the connections of the site with suffix m.
SENSOR_LABEL = "CASE WHEN dst_port = 9999 THEN 'modbus' WHEN dst_port = 502 AND src_port = 49153 THEN 'http' ELSE protocol END"


def query(name: str, sql: str | None = None):
    """Register a query function (spark, sf_dir) and its SQL."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def on_site(name: str, sql: str | None = None, variant: str = "base"):
    """Register a query function of a Site."""

    def register(fn):
        query(name, sql)(lambda spark, d: fn(Site(spark, d, variant)))
        return fn

    return register


def _all_ctes() -> tuple[dict[str, str], dict[str, str]]:
    ctes, packets = {}, {}
    for suffix, (variant, where) in SITES.items():
        ctes.update(site_ctes(suffix))
        packets[f"pk{suffix}"] = binding.packets_sql(variant, where, f"pk{suffix}")
    ctes["cnm"] = f"SELECT * REPLACE ({SENSOR_LABEL} AS protocol) FROM ({ctes['cnm']})"
    return ctes, packets


_CTES, _PACKETS = _all_ctes()
_NAMES = re.compile(r"\b(" + "|".join(sorted([*_CTES, *_PACKETS], key=len, reverse=True)) + r")\b")
_PLACE = re.compile(r"(?:FROM|JOIN|,)\s+(\w+)", re.I)
_BASE = {name + suffix: name for suffix in SITES for name in [*site_ctes(""), "pk"]}


def at_site(sql: str, suffix: str) -> str:
    """The SQL with its tables taken from the site of another suffix."""

    def moved(match: re.Match) -> str:
        whole, name = match.group(0), match.group(1)
        return whole[: len(whole) - len(name)] + _BASE[name] + suffix if name in _BASE else whole

    return _PLACE.sub(moved, sql)


def full_sql(sql: str) -> str:
    """Put the needed table expressions in front of a query."""
    order: list[str] = []

    def visit(text: str, seen: tuple[str, ...]) -> None:
        for name in _PLACE.findall(text):
            if name in seen or name in order or not _NAMES.fullmatch(name):
                continue
            if name in _CTES:
                visit(_CTES[name], seen + (name,))
            order.append(name)

    visit(sql, ())
    if not order:
        return sql
    parts = [_PACKETS[n] if n in _PACKETS else f"{n} AS ({_CTES[n]})" for n in order]
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    recursive = "RECURSIVE " if (head and head.group(1)) or any(n.startswith("cr") for n in order) else ""
    prefix = f"WITH {recursive}" + ",\n".join(parts)
    return f"{prefix},\n{sql[head.end():]}" if head else f"{prefix}\n{sql}"


def joined(column: str | Column) -> Column:
    """Array as sorted comma-separated text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.array_join(F.array_sort(c).cast("array<string>"), ","), F.lit(""))


def sql_joined(column: str) -> str:
    return f"coalesce(array_to_string(CAST(list_sort({column}) AS VARCHAR[]), ','), '')"


def us(column: str) -> Column:
    """Timestamp as microseconds, which no session time zone can shift."""
    return F.unix_micros(F.col(column)).alias(f"{column}_us")


def shown_findings(df: DataFrame) -> DataFrame:
    return df.select(
        "finding_type", "severity", "title", F.coalesce("technique_id", F.lit("")).alias("technique_id"),
        F.array_join("affected_assets", ",").alias("affected"), "evidence",
    )


def sql_finding(severity: str, title: str, technique: str, affected: str, evidence: str, source: str,
                kind: str = "attack_technique") -> str:
    return (
        f"SELECT '{kind}' AS finding_type, {severity} AS severity, {title} AS title, '{technique}' AS technique_id, "
        f"{affected} AS affected, {evidence} AS evidence FROM {source}"
    )
