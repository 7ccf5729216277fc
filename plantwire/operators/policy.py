"""Whole policy documents: every line of a configuration with its number, in five formats.

A document has rows of several kinds: opening notes, object groups with their members, and for
each zone pair a header, remarks, rules and the default deny. Each kind is made where its data
are; a line's number is the count of lines in the buckets before its own plus its place inside.
A zone's members are numbered by /24, so no bucket grows with the zone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C
from ..functions import columns as X
from .segmentation import _acl_name, enforcement_denies, enforcement_rules, vendor_remarks

NOTES = {
    "router_acl": ("! Format: extended ACL of routers", "! Put address ranges in place of any before use", "!"),
    "firewall_acl": ("! Format: extended ACL of firewalls", "! Object groups hold the addresses seen in each zone", "!"),
    "table": ("\t".join(C.POLICY_TABLE_HEADER),),
    "ids": ("# Format: rules of an intrusion detection system", "# Pass rules come before the default drop"),
}
GROUPED_ASSETS = 3
_BUCKET = ["section", "k1", "k2", "b"]
_PLACE = ["a", "p", "q", "j"]


def _lines(table: DataFrame, section: int, line: Column, k1="", k2="", b: Column | int = 0, a: int = 0, p="", q: Column | int = 0, j: int = 0) -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return table.select(
        lit(section).alias("section"), lit(k1).alias("k1"), lit(k2).alias("k2"), lit(b).cast("bigint").alias("b"), lit(a).alias("a"), lit(p).alias("p"),
        lit(q).cast("bigint").alias("q"), lit(j).alias("j"), line.alias("line"),
    )


def number_lines(rows: DataFrame) -> DataFrame:
    """Lines with their numbers; only the bucket counts are put in order as a whole."""
    running = Window.orderBy(*_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*_BUCKET).agg(F.count("*").alias("_n")).select(*_BUCKET, F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*_BUCKET).orderBy(*_PLACE)
    placed = rows.withColumn("_i", F.row_number().over(inside)).join(before, _BUCKET)
    return placed.select((F.col("_before") + F.col("_i")).cast("bigint").alias("line_no"), "line")


def _pair_rows(rules: DataFrame, zones: DataFrame, fmt: str, vendors: DataFrame | None) -> list[DataFrame]:
    key = ["src_zone", "dst_zone", "protocol", "dst_port"]
    pair = {"k1": F.col("src_zone"), "k2": F.col("dst_zone")}
    at = pair | {"a": 2, "p": F.col("protocol"), "q": F.coalesce("dst_port", F.lit(-1))}
    pairs = rules.select("src_zone", "dst_zone").distinct()
    names = F.concat_ws(" to ", "src_zone", "dst_zone")
    acl = F.concat(F.lit("ACL-"), _acl_name("src_zone"), F.lit("-TO-"), _acl_name("dst_zone"))
    line = F.col("line")
    indent = F.concat(F.lit(" "), line) if fmt == "router_acl" else line
    rows = [_lines(enforcement_rules(rules, zones, fmt, vendors), 2, indent, j=2, **at)]
    if fmt in ("router_acl", "firewall_acl"):
        head = " remark " if fmt == "router_acl" else "! "
        risk = F.concat(F.lit("["), "risk", F.lit("] "), "justification")
        why = F.concat(F.lit(" remark "), risk) if fmt == "router_acl" else F.concat(F.lit("access-list "), acl, F.lit(" remark "), risk)
        rows.append(_lines(rules, 2, why, j=1, **at))
        if vendors is not None:
            rows.append(_lines(vendor_remarks(rules, vendors).select(*key, "vendor_context"), 2, F.concat(F.lit(head), "vendor_context"), j=0, **at))
        if fmt == "router_acl":
            rows.append(_lines(pairs, 2, F.concat(F.lit("ip access-list extended "), acl), a=0, **pair))
            rows.append(_lines(pairs, 2, F.concat(F.lit(" remark "), names), a=1, **pair))
        else:
            rows.append(_lines(pairs, 2, F.concat(F.lit("! Zone pair: "), names), a=1, **pair))
        rows.append(_lines(enforcement_denies(rules, fmt), 2, indent, a=3, **pair))
    elif fmt == "ids":
        rows.append(_lines(pairs, 2, F.concat(F.lit("# "), names), a=1, **pair))
    if fmt in ("table", "ids"):
        rows.append(_lines(enforcement_denies(rules, fmt), 3, line))
    return rows


def _object_groups(rules: DataFrame, zones: DataFrame, members: DataFrame) -> list[DataFrame]:
    """Groups of the zones that rules name and that have over ``GROUPED_ASSETS`` assets, with their addresses."""
    named = rules.select(F.explode(F.array("src_zone", "dst_zone")).alias("zone")).distinct()
    grouped = zones.filter(F.col("asset_count") > GROUPED_ASSETS).join(named, "zone", "left_semi").select("zone", "asset_count")
    number = X.ip_number(F.col("ip"))
    inside = members.select("zone", "ip").distinct().join(grouped.select("zone"), "zone", "left_semi").withColumn("_n", number)
    zone = {"k1": F.col("zone")}
    return [
        _lines(grouped, 1, F.concat(F.lit("object-group network OBJ-"), _acl_name("zone")), b=-3, **zone),
        _lines(grouped, 1, F.concat(F.lit(" description "), "zone", F.lit(" ("), F.col("asset_count").cast("string"), F.lit(" assets)")), b=-2, **zone),
        _lines(inside, 1, F.concat(F.lit(" network-object host "), "ip"), b=F.coalesce(F.shiftright("_n", 8), F.lit(-1)),
               p=F.when(F.col("_n").isNull(), F.col("ip")).otherwise(""), q=F.coalesce(F.col("_n") % 256, F.lit(0)), **zone),
    ]


def _json_rows(rules: DataFrame, zones: DataFrame, conduits: DataFrame, vendors: DataFrame | None) -> list[DataFrame]:
    """One JSON document: an element per line, all but the first of a list behind a comma."""
    spark = rules.sparkSession
    one = spark.range(1)
    zone = F.to_json(F.struct(F.col("zone").alias("name"), "purdue_levels", "asset_count", "security_level"))
    conduit = F.to_json(F.struct("zone_a", "zone_b", "direction", "rule_count", "cross_purdue_risk"))
    policy = enforcement_rules(rules, zones, "json", vendors)
    rows = [_lines(one, 0, F.lit('{"metadata":{"format":"json"},"zones":['))]
    lists = [
        (1, zones, zone, {"k1": F.col("zone")}, '],"conduits":['),
        (3, conduits, conduit, {"k1": F.col("zone_a"), "k2": F.col("zone_b")}, '],"rules":['),
        (5, policy, F.col("line"), {"k1": F.col("src_zone"), "k2": F.col("dst_zone"), "p": F.col("protocol"), "q": F.coalesce("dst_port", F.lit(-1))}, '],"default_action":"deny"}'),
    ]
    for section, table, text, place, after in lists:
        made = _lines(table, section, text, **place)
        order = F.struct(*_BUCKET[1:], *_PLACE)
        first = made.agg(F.min(order)).scalar()
        rows.append(made.withColumn("line", F.when(order == first, F.col("line")).otherwise(F.concat(F.lit(","), "line"))))
        rows.append(_lines(one, section + 1, F.lit(after)))
    return rows


def policy_document(
    rules: DataFrame, zones: DataFrame, members: DataFrame, fmt: str, conduits: DataFrame | None = None, zone_vendors: DataFrame | None = None
) -> DataFrame:
    """All lines of a policy: line_no from 1, line.

    ``rules``: output of ``communication_matrix``; ``members``: zone and ip of every address; ``conduits`` are those
    of the zone model, for ``json``. ``fmt``: as in ``enforcement_rules``.
    """
    if fmt == "json":
        rows = _json_rows(rules, zones, conduits, zone_vendors)
    else:
        notes = rules.sparkSession.createDataFrame([(n, line) for n, line in enumerate(NOTES[fmt])], "q int, line string")
        rows = [_lines(notes, 0, F.col("line"), q=F.col("q")), *_pair_rows(rules, zones, fmt, zone_vendors)]
        if fmt == "firewall_acl":
            rows += _object_groups(rules, zones, members)
    return number_lines(reduce(DataFrame.unionByName, rows))
