"""Zones and conduits: profiles, policy groups, zones, matrix, simulation, enforcement.

Groups and zones are named, not numbered, so ids are the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C
from ..functions import columns as X
from ..functions.scale import connected_components
from .assess import assess_criticality
from .findings import text
from .similarity import average_group_similarity, communities, sketched_group_similarity

UNCLASSIFIED = "Unclassified Zone"
DMZ = "DMZ Zone"


def segmentation_inputs(
    assets: DataFrame, conns: DataFrame, stats: DataFrame, anomalies: DataFrame, devices: DataFrame,
    allowlist: DataFrame, findings: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """(asset profiles, observed connections)."""
    protos = F.col("protocols")
    ot = X.has_any(protos, C.SEGMENT_OT_PROTOCOLS)
    roles = devices.select(
        F.col("ip").alias("ip_address"),
        *[F.col(f"{p}.role").alias(f"_{p}") for p in ("modbus", "dnp3", "ethernet_ip", "s7comm", "bacnet")],
    )
    profiles = (
        assets.join(assess_criticality(assets).select("ip_address", "criticality"), "ip_address")
        .join(roles, "ip_address", "left")
        .select(
            F.col("ip_address").alias("ip"), "vendor", "device_type", "purdue_level", "protocols", "criticality",
            ot.alias("is_ot"), (~ot & (F.size(protos) > 0)).alias("is_it"),
            (ot & X.has_any(protos, C.IT_PROTOCOLS)).alias("is_dual_homed"),
            X.subnet24(F.col("ip_address")).alias("subnet"),
            F.array_compact(F.array(*[
                F.when(F.col(f"_{p}").isNotNull(), F.struct(F.lit(p).alias("protocol"), F.col(f"_{p}").alias("role")))
                for p in ("modbus", "dnp3", "ethernet_ip", "s7comm", "bacnet")
            ])).alias("protocol_roles"),
        )
    )
    transfer = F.exists("s7comm.functions_seen", lambda f: X.contains_any(f, ("download", "upload", "stop", "program_transfer")))

    def yes(cond: Column) -> Column:
        return F.coalesce(cond, F.lit(False))

    ops = devices.select(
        "ip",
        (yes(F.col("modbus.write_count_wide") > 0) | yes(F.col("ethernet_ip.cip_writes_to_assembly"))
         | yes(F.col("bacnet.write_to_output")) | yes(F.col("bacnet.write_to_notification_class"))).alias("w"),
        (yes(F.col("ethernet_ip.cip_file_access")) | yes(transfer)).alias("c"),
    ).filter("w OR c")

    def end(prefix: str) -> DataFrame:
        return ops.select(F.col("ip").alias(f"{prefix}_ip"), F.col("w").alias(f"{prefix}_w"), F.col("c").alias(f"{prefix}_c"))

    flow3, flow4 = ["src_ip", "dst_ip", "dst_port"], ["src_ip", "dst_ip", "dst_port", "protocol"]
    periodic = stats.groupBy("src_ip", "dst_ip", F.col("port").alias("dst_port")).agg(F.bool_or("is_periodic").alias("is_periodic"))
    odd = anomalies.select("src_ip", "dst_ip", F.col("port").alias("dst_port"), F.lit(True).alias("pattern_anomaly")).distinct()
    listed = allowlist.select(*flow4, F.lit(True).alias("is_in_allowlist")).distinct()
    pair = (
        findings.filter((F.size("affected_assets") == 2) & F.col("technique_id").isNotNull())
        .select(F.array_min("affected_assets").alias("_x"), F.array_max("affected_assets").alias("_y"), "technique_id")
        .groupBy("_x", "_y").agg(F.array_sort(F.collect_set("technique_id")).alias("attack_techniques"))
    )
    flags = ("is_periodic", "pattern_anomaly", "is_in_allowlist", "src_w", "dst_w", "src_c", "dst_c")
    observed = (
        conns.withColumns({"_x": F.least("src_ip", "dst_ip"), "_y": F.greatest("src_ip", "dst_ip")})
        .join(periodic, flow3, "left").join(odd, flow3, "left").join(listed, flow4, "left")
        .join(end("src"), "src_ip", "left").join(end("dst"), "dst_ip", "left").join(pair, ["_x", "_y"], "left")
        .withColumns({f: F.coalesce(f, F.lit(False)) for f in flags})
        .select(
            "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "packet_count", "byte_count", "first_seen", "last_seen",
            "is_periodic", "pattern_anomaly", (F.col("src_w") | F.col("dst_w")).alias("has_write_operations"),
            F.lit(True).alias("has_read_operations"), (F.col("src_c") | F.col("dst_c")).alias("has_config_operations"),
            F.coalesce("attack_techniques", F.array().cast("array<string>")).alias("attack_techniques"), "is_in_allowlist",
        )
    )
    return profiles, observed


def security_level(level: Column) -> Column:
    return F.when(level <= 1, "sl3").when(level.isin(2, 3), "sl2").otherwise("sl1")


_L1_LABELS = {
    "modbus": "Modbus", "dnp3": "DNP3", "s7comm": "S7", "ethernet_ip": "EtherNetIP", "iec104": "IEC104",
    "profinet": "PROFINET", "bacnet": "BACnet",
}


def _l1_label(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for protocol, label in _L1_LABELS.items():
        out = F.when(name == protocol, label).otherwise(out)
    return out


def asset_roles(profiles: DataFrame, observed: DataFrame) -> DataFrame:
    """Role label and device category of every asset with a level."""
    config = (
        observed.filter("has_config_operations").select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct()
        .withColumn("_config", F.lit(True))
    )
    kind, level = F.col("device_type"), F.col("purdue_level")
    server_roles = F.filter(
        "protocol_roles", lambda r: r["role"].isin("slave", "server", "outstation", "adapter", "io_device")
    )

    def first_label(array: Column, pick) -> Column:
        return F.get(F.filter(F.transform(array, lambda x: _l1_label(pick(x))), lambda v: v.isNotNull()), F.lit(0))

    field = F.coalesce(
        first_label(server_roles, lambda r: r["protocol"]), first_label(F.col("protocols"), lambda p: p), F.lit("Control")
    )
    engineering = F.coalesce("_config", F.lit(False)) | X.contains_any(kind, ("engineering", "ews"))
    role = (
        F.when(level <= 1, field)
        .when(level == 2, F.when(engineering, "Engineering").otherwise("HMI"))
        .when(level == 3, F.when(F.col("is_dual_homed"), "DMZ")
              .when(kind.contains("historian") | F.array_contains("protocols", "opc_ua"), "Historian")
              .when(kind.contains("scada"), "SCADA").otherwise("Operations"))
        .otherwise(F.when(X.has_any(F.col("protocols"), ("http", "https")), "Web")
                   .when(X.has_any(F.col("protocols"), ("rdp", "ssh", "vnc", "telnet")), "RemoteAccess").otherwise("IT"))
    )
    category = (
        F.when(level == 0, "sensor").when(level == 1, "plc").when(F.col("_role") == "HMI", "hmi")
        .when(F.col("_role") == "Engineering", "engineering_station").when(F.col("_role") == "DMZ", "dmz_gateway")
        .when(F.col("_role") == "Historian", "historian").when(level == 3, "scada_server").otherwise("it_endpoint")
    )
    return (
        profiles.filter("purdue_level IS NOT NULL").join(config, "ip", "left")
        .withColumn("_role", role)
        .select("ip", "purdue_level", F.col("_role").alias("role"), category.alias("category"), "criticality",
                F.coalesce("vendor", F.lit("unknown")).alias("vendor"))
    )


def policy_groups(
    profiles: DataFrame, observed: DataFrame, sets: DataFrame, vendor_max: float = 0.3, hot: int = 200,
    min_sim: float = 0.6, hashes: int | None = None,
) -> DataFrame:
    """Group of every asset: ip, group_name, purdue_level, category, security_level, criticality.

    Level and role make a group; it is split by vendor only if every pair of vendors in
    it is less similar than ``vendor_max`` on average. Assets without a level fall into
    communities of similar neighbours. With ``hashes``, vendors are compared by sketches of so many
    hash functions, linear in the assets, instead of exactly.
    """
    roles = asset_roles(profiles, observed)
    base = F.concat_ws("-", F.concat(F.lit("L"), F.col("purdue_level").cast("string")), "role")
    roles = roles.withColumn("grp", base)
    parts = roles.select("grp", F.col("vendor").alias("part"), "ip")
    similar = average_group_similarity(parts, sets, hot) if hashes is None else sketched_group_similarity(parts, sets, hashes)
    split = similar.groupBy("grp").agg((F.max("similarity") < vendor_max).alias("_split"))
    named = roles.join(split, "grp", "left").select(
        "ip", F.when(F.coalesce("_split", F.lit(False)), F.concat_ws("-", "grp", "vendor")).otherwise(F.col("grp"))
        .alias("group_name"),
        "purdue_level", "category", "criticality",
    )
    loose = profiles.filter("purdue_level IS NULL").select("ip", "criticality")
    found = communities(loose, sets, min_sim)
    ot = profiles.filter("is_ot").select(F.col("ip").alias("peer"))
    near_ot = sets.join(ot, "peer", "left_semi").select("ip").distinct().withColumn("_near", F.lit(True))
    infra = (
        found.join(near_ot, "ip", "left").groupBy("community").agg(F.bool_or(F.coalesce("_near", F.lit(False))).alias("_near"))
    )
    unclassified = loose.join(found, "ip").join(infra, "community").select(
        "ip", F.concat(F.lit("Unclassified-"), "community").alias("group_name"),
        F.lit(None).cast("int").alias("purdue_level"),
        F.when(F.col("_near"), "network_infra").otherwise("unknown").alias("category"), "criticality",
    )
    members = named.unionByName(unclassified)
    rank = F.max(X.rank_of(F.col("criticality"), C.CRITICALITY_RANK)).alias("_c")
    worst = members.groupBy("group_name").agg(rank)
    return members.drop("criticality").join(worst, "group_name").select(
        "ip", "group_name", "purdue_level", "category", security_level(F.col("purdue_level")).alias("security_level"),
        X.label_of(F.col("_c"), C.CRITICALITY_RANK).alias("criticality"),
    )


def group_table(members: DataFrame) -> DataFrame:
    return members.groupBy("group_name", "purdue_level", "category", "security_level", "criticality").agg(
        F.count("*").alias("member_count")
    )


def zone_definitions(spark) -> DataFrame:
    return spark.createDataFrame(
        [(n, s, list(levels)) for _, n, s, levels in C.ZONES], "base_zone string, security_level string, purdue_levels array<int>"
    )


def _base_zone(level: Column, category: Column) -> Column:
    bucket = (
        F.when(category == "dmz_gateway", 35).when(level <= 1, 1).when(level == 2, 2).when(level == 3, 3)
        .when(level == 35, 35).when(level >= 4, 4).otherwise(99)
    )
    out = F.lit(UNCLASSIFIED)
    for number, name, _, _ in C.ZONES:
        out = F.when(bucket == number, name).otherwise(out)
    return out


def zone_groups(groups: DataFrame) -> DataFrame:
    """Zone of each group by level bucket: group_name, zone, base_zone, member_count."""
    zone = _base_zone(F.col("purdue_level"), F.col("category"))
    return groups.select("group_name", zone.alias("zone"), zone.alias("base_zone"), "purdue_level", "member_count")


def zone_table(assigned: DataFrame) -> DataFrame:
    """Zones with their groups counted: zone, security_level, purdue_levels, group_count, asset_count."""
    rows = assigned.groupBy("zone", "base_zone").agg(
        F.count("*").alias("group_count"), F.sum("member_count").alias("asset_count")
    )
    return rows.join(F.broadcast(zone_definitions(assigned.sparkSession)), "base_zone").select(
        "zone", "base_zone", "security_level", "purdue_levels", "group_count", "asset_count"
    )


def baseline_zones(groups: DataFrame) -> DataFrame:
    return zone_table(zone_groups(groups))


def split_subzones(assigned: DataFrame, members: DataFrame, conns: DataFrame, max_parts: int | None = None) -> DataFrame:
    """Rename zones whose groups do not reach each other, one letter per part: A to Z, then A1 and so on.

    ``max_parts`` puts all further parts of a zone into the last one it allows.
    """
    of_ip = members.select("ip", "group_name").join(assigned.select("group_name", "zone"), "group_name")

    def end(prefix: str) -> DataFrame:
        return of_ip.select(F.col("ip").alias(f"{prefix}_ip"), F.col("group_name").alias(prefix), F.col("zone").alias(f"{prefix}_z"))

    links = (
        conns.select("src_ip", "dst_ip").distinct().join(end("src"), "src_ip").join(end("dst"), "dst_ip")
        .filter("src_z = dst_z AND src <> dst").select("src", "dst").distinct()
    )
    parts = connected_components(assigned.select(F.col("group_name").alias("id")), links)
    marked = assigned.join(parts, F.col("group_name") == F.col("id")).drop("id")
    # parts are numbered over the groups of a zone, which are roles and vendors, not devices
    order = Window.partitionBy("zone").orderBy("component")
    numbered = marked.select("zone", "component").distinct().withColumn("_n", F.row_number().over(order) - 1)
    parts_of = numbered.groupBy("zone").agg(F.count("*").alias("_parts"))
    number = F.col("_n") if max_parts is None else F.least("_n", F.lit(max_parts - 1))
    more = F.when(number >= 26, F.floor(number / 26).cast("string")).otherwise("")
    letter = F.concat(F.lit(" "), F.char(F.lit(65) + number % 26), more)
    renamed = F.when(F.col("_parts") == 1, F.col("zone")).otherwise(F.concat("zone", letter))
    return marked.join(numbered, ["zone", "component"]).join(parts_of, "zone").select(
        "group_name", renamed.alias("zone"), "base_zone", "purdue_level", "member_count"
    )


def dmz_zone(assigned: DataFrame, members: DataFrame, profiles: DataFrame) -> DataFrame:
    """Move groups with dual-homed members into a DMZ zone, unless one exists."""
    dual = (
        members.join(profiles.filter("is_dual_homed").select("ip"), "ip", "left_semi")
        .select("group_name").distinct().withColumn("_dual", F.lit(True))
    )
    existing = assigned.agg(F.count_if(F.col("zone").contains("DMZ"))).scalar()
    move = F.coalesce("_dual", F.lit(False)) & (existing == 0)
    return assigned.join(dual, "group_name", "left").select(
        "group_name", F.when(move, DMZ).otherwise(F.col("zone")).alias("zone"),
        F.when(move, DMZ).otherwise(F.col("base_zone")).alias("base_zone"), "purdue_level", "member_count",
    )


def _cross_level_traffic(members: DataFrame, conns: DataFrame) -> Column:
    """Scalar: number of flows between levels 0–1 and 4+."""
    level = members.filter("purdue_level <= 1 OR purdue_level >= 4").select("ip", (F.col("purdue_level") <= 1).alias("low"))
    a = level.select(F.col("ip").alias("src_ip"), F.col("low").alias("a"))
    b = level.select(F.col("ip").alias("dst_ip"), F.col("low").alias("b"))
    flows = conns.select("src_ip", "dst_ip").distinct().join(a, "src_ip").join(b, "dst_ip").filter("a <> b")
    return flows.agg(F.count("*")).scalar()


def _largest_subnet(profiles: DataFrame) -> DataFrame:
    """One row: assets in the fullest /24 and in total."""
    per = profiles.groupBy("subnet").agg(F.count("*").alias("n"))
    return per.agg(F.max("n").alias("largest"), F.sum("n").alias("total"))


def flat_zone(profiles: DataFrame, members: DataFrame, conns: DataFrame) -> DataFrame:
    """One recommendation if more than 80 % of the assets share a /24."""
    rows = _largest_subnet(profiles).withColumn("cross", _cross_level_traffic(members, conns)).filter(
        "largest * 100 div greatest(total, 1) > 80"
    )
    level = F.when(F.col("cross") > 0, "CRITICAL").otherwise("WARNING")
    return rows.select(level.alias("level"), text("flat network: %d of %d assets in one /24", "largest", "total").alias("recommendation"))


def zone_recommendations(
    assigned: DataFrame, members: DataFrame, profiles: DataFrame, conns: DataFrame, findings: DataFrame
) -> DataFrame:
    """Recommendations from traffic, addressing and findings: level, recommendation."""
    title = F.lower("title")
    facts = findings.agg(
        F.count_if(F.col("technique_id") == "T0886").alias("remote"),
        F.count_if(F.col("finding_type") == "purdue_violation").alias("violations"),
        F.count_if(title.contains("flat network")).alias("flat"),
    )
    facts = facts.withColumn("dmz", assigned.agg(F.count_if(F.col("zone").contains("DMZ"))).scalar()).withColumn(
        "cross", _cross_level_traffic(members, conns)
    )

    def tip(cond: str, level: str, message: str) -> Column:
        return F.when(F.expr(cond), F.struct(F.lit(level).alias("level"), F.lit(message).alias("recommendation")))

    tips = F.array_compact(F.array(
        tip("cross > 0 AND dmz = 0", "CRITICAL", "direct L1 to L4 traffic without a DMZ zone"),
        tip("remote > 0 AND dmz = 0", "GAP", "remote services found and no DMZ zone"),
        tip("violations > 0", "GAP", "Purdue violations found: review risky conduits"),
        tip("flat > 0", "GAP", "flat network found: subnets must be split"),
    ))
    return facts.select(F.explode(tips).alias("t")).select("t.*").unionByName(flat_zone(profiles, members, conns))


def zone_of_ip(members: DataFrame, assigned: DataFrame) -> DataFrame:
    """Zone of each address through its group: ip, zone."""
    return members.select("ip", "group_name").join(assigned.select("group_name", "zone"), "group_name").select("ip", "zone")


def _with_zones(conns: DataFrame, ip_zone: DataFrame, how: str = "inner") -> DataFrame:
    a = ip_zone.select(F.col("ip").alias("src_ip"), F.col("zone").alias("src_zone"))
    b = ip_zone.select(F.col("ip").alias("dst_ip"), F.col("zone").alias("dst_zone"))
    return conns.join(a, "src_ip", how).join(b, "dst_ip", how)


def conduit_rules(ip_zone: DataFrame, observed: DataFrame) -> DataFrame:
    """Per unordered zone pair, protocol and port: direction flags and operation flags."""
    rows = _with_zones(observed, ip_zone).filter("src_zone <> dst_zone")
    forward = F.col("src_zone") < F.col("dst_zone")
    return rows.groupBy(
        F.least("src_zone", "dst_zone").alias("zone_a"), F.greatest("src_zone", "dst_zone").alias("zone_b"),
        "protocol", "dst_port",
    ).agg(
        F.bool_or(forward).alias("forward"), F.bool_or(~forward).alias("backward"),
        F.bool_or("has_write_operations").alias("has_write_ops"), F.bool_or("has_config_operations").alias("has_config_ops"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("attack_techniques")))).alias("attack_techniques"),
    )


def conduits(zones: DataFrame, rules: DataFrame) -> DataFrame:
    """Zone pairs with traffic: direction, number of rules, risk if the levels are far apart."""
    lowest = zones.select("zone", F.array_min("purdue_levels").alias("low"))
    pairs = rules.groupBy("zone_a", "zone_b").agg(
        F.bool_or("forward").alias("f"), F.bool_or("backward").alias("b"), F.count("*").alias("rule_count")
    )
    a = lowest.select(F.col("zone").alias("zone_a"), F.col("low").alias("la"))
    b = lowest.select(F.col("zone").alias("zone_b"), F.col("low").alias("lb"))
    risk = F.coalesce(F.abs(F.col("la") - F.col("lb")) > 2, F.lit(False))
    return pairs.join(a, "zone_a", "left").join(b, "zone_b", "left").select(
        "zone_a", "zone_b", F.when(F.col("f") & F.col("b"), "bidirectional").otherwise("unidirectional").alias("direction"),
        "rule_count", risk.alias("cross_purdue_risk"),
    )


def zone_score(conduit_table: DataFrame) -> DataFrame:
    risky = F.count_if("cross_purdue_risk")
    return conduit_table.agg(
        F.when(F.count("*") == 0, 1.0).otherwise(1.0 - risky / F.count("*")).alias("zone_score")
    )


def ip_to_zone(profiles: DataFrame, zones: DataFrame) -> DataFrame:
    """Zone of each address through its level: the first zone (by name) with that level."""
    by_level = (
        zones.select("zone", F.explode("purdue_levels").alias("_level")).groupBy("_level").agg(F.min("zone").alias("zone"))
    )
    rest = zones.filter(F.size("purdue_levels") == 0).agg(F.min("zone")).scalar()
    level = F.least("purdue_level", F.lit(4))
    joined = profiles.select("ip", "purdue_level", level.alias("_level")).join(F.broadcast(by_level), "_level", "left")
    return joined.select(
        "ip", F.when(F.col("purdue_level").isNull(), rest).otherwise(F.col("zone")).alias("zone")
    ).filter("zone IS NOT NULL")


def communication_matrix(observed: DataFrame, ip_zone: DataFrame, include_intra_zone: bool = False) -> DataFrame:
    """Observed flows between zones as policy rules with risk and justification."""
    rows = _with_zones(observed, ip_zone)
    if not include_intra_zone:
        rows = rows.filter("src_zone <> dst_zone")
    g = rows.groupBy("src_zone", "dst_zone", "protocol", "dst_port").agg(
        F.sum("packet_count").alias("packet_count"), F.countDistinct("src_ip").alias("src_count"),
        F.countDistinct("dst_ip").alias("dst_count"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"), F.bool_or("has_write_operations").alias("has_write"),
        F.bool_or("has_config_operations").alias("has_config"), F.bool_or("is_in_allowlist").alias("allowlisted"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("attack_techniques")))).alias("attack_techniques"),
    )
    risk = F.when(F.col("has_config"), "high").when(F.col("has_write"), "medium").otherwise("low")
    start, end = F.date_format("first_seen", "yyyy-MM-dd"), F.date_format("last_seen", "yyyy-MM-dd")
    span = F.when(start == end, start).otherwise(F.concat_ws(" to ", start, end))
    seen = F.format_string(
        "Observed %d packets, %s/%d | %d sources, %d destinations | %s", "packet_count", "protocol", "dst_port", "src_count",
        "dst_count", span,
    )
    warn = F.when(F.size("attack_techniques") > 0, F.concat(F.lit("techniques: "), F.array_join("attack_techniques", ", ")))
    pre = F.when(F.col("allowlisted"), "pre-approved in allowlist")
    return g.select(
        "src_zone", "dst_zone", "protocol", "dst_port", "packet_count", "src_count", "dst_count", risk.alias("risk"),
        F.concat_ws("; ", seen, warn, pre).alias("justification"),
    )


def matrix_coverage(observed: DataFrame, ip_zone: DataFrame) -> DataFrame:
    """Share of inter-zone connections with both ends in a zone, in percent."""
    rows = _with_zones(observed, ip_zone, "left")
    a, b = F.col("src_zone"), F.col("dst_zone")
    both, one = F.count_if(a != b), F.count_if(a.isNull() != b.isNull())
    return rows.agg(F.when(both + one == 0, 100.0).otherwise(both * 100.0 / (both + one)).alias("coverage_percent"))


def simulate_policy(observed: DataFrame, ip_zone: DataFrame, rules: DataFrame) -> DataFrame:
    """Each connection under default deny: allowed or blocked, and how bad a block is.

    ``rules``: src_zone, dst_zone, protocol, dst_port (null = any port). Connections
    with an end outside every zone are allowed. Spark picks the join by the size of the
    rule table; hot zone pairs are split by adaptive execution.
    """
    key = ["src_zone", "dst_zone", "protocol"]
    exact = rules.filter("dst_port IS NOT NULL").select(*key, "dst_port", F.lit(True).alias("_exact")).distinct()
    any_port = rules.filter("dst_port IS NULL").select(*key, F.lit(True).alias("_any")).distinct()
    rows = (
        _with_zones(observed, ip_zone, "left").join(exact, key + ["dst_port"], "left").join(any_port, key, "left")
    )
    unzoned = F.col("src_zone").isNull() | F.col("dst_zone").isNull()
    allowed = unzoned | F.coalesce("_exact", "_any", F.lit(False))
    candidate = F.col("is_periodic") & ~F.col("has_write_operations") & F.col("is_in_allowlist")
    verdict = F.when(allowed, "allowed").when(candidate, "false_positive_candidate").otherwise("critical_block")
    reason = F.when(
        ~allowed, text("no rule allows %s:%d from %s to %s", "protocol", "dst_port", "src_zone", "dst_zone")
    )
    return rows.select(
        "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "src_zone", "dst_zone", verdict.alias("verdict"), reason.alias("reason")
    )


def zone_block_summary(sim: DataFrame) -> DataFrame:
    return (
        sim.filter("verdict <> 'allowed'").groupBy("src_zone", "dst_zone").agg(F.count("*").alias("blocked_count"))
    )


def simulation_totals(sim: DataFrame) -> DataFrame:
    blocked = F.count_if(F.col("verdict") != "allowed")
    return sim.agg(
        F.count_if(F.col("verdict") == "allowed").alias("allowed"), blocked.alias("blocked"),
        F.when(F.count("*") == 0, 0.0).otherwise(blocked * 100.0 / F.count("*")).alias("blocked_percent"),
        F.count_if(F.col("verdict") == "false_positive_candidate").alias("false_positive_candidates"),
    )


def risk_reduction(findings: DataFrame, ip_zone: DataFrame, rules: DataFrame) -> DataFrame:
    """Severity-weighted share of findings none of whose zones may send anywhere."""
    open_zones = rules.select(F.col("src_zone").alias("zone")).distinct().withColumn("_open", F.lit(True))
    places = (
        findings.select("id", F.explode("affected_assets").alias("ip")).join(ip_zone, "ip").join(open_zones, "zone", "left")
        .groupBy("id").agg(F.bool_or(F.coalesce("_open", F.lit(False))).alias("_open"))
    )
    weight = F.greatest(X.rank_of(F.col("severity"), C.SEVERITY_RANK), F.lit(0))
    rows = findings.join(places, "id", "left")
    total = F.sum(weight)
    stopped = F.sum(F.when(~F.col("_open"), weight).otherwise(0))
    return rows.agg(F.when(F.coalesce(total, F.lit(0)) == 0, 0.0).otherwise(stopped / total).alias("risk_reduction"))


def deployment_score(zones: DataFrame, rules: DataFrame) -> DataFrame:
    """Security-level-weighted share of zones that a rule covers."""
    covered = rules.select(F.explode(F.array("src_zone", "dst_zone")).alias("zone")).distinct().withColumn("_in", F.lit(True))
    weight = X.rank_of(F.col("security_level"), {k: int(v) for k, v in C.SECURITY_LEVEL_WEIGHT.items()})
    rows = zones.join(covered, "zone", "left")
    return rows.agg(
        F.when(F.coalesce(F.sum(weight), F.lit(0)) == 0, 0.0)
        .otherwise(F.sum(F.when(F.col("_in"), weight).otherwise(0)) / F.sum(weight)).alias("deployment_score")
    )


# --- enforcement ---------------------------------------------------------------------------


def transport_of(protocol: Column, port: Column) -> Column:
    return F.when(F.coalesce(port.isin(*C.ACL_UDP_PORTS), F.lit(False)) | F.lower(protocol).isin(*C.ACL_UDP_PROTOCOLS), "udp").otherwise("tcp")


def _acl_name(zone: str) -> Column:
    """Name of at most 28 characters; a cut one ends in a hash of the zone, so that it stays unique."""
    name = F.upper(F.regexp_replace(zone, "[^0-9A-Za-z]", "_"))
    cut = F.concat(F.substring(name, 1, 19), F.lit("_"), F.upper(F.substring(F.sha2(F.col(zone), 256), 1, 8)))
    return F.when(F.length(name) <= 28, name).otherwise(cut)


def vendor_remarks(rules: DataFrame, zone_vendors: DataFrame) -> DataFrame:
    """Vendor notes per rule from the vendors (zone, vendor) at both of its zones."""
    key = ["src_zone", "dst_zone", "protocol", "dst_port"]
    notes = rules.sparkSession.createDataFrame(list(C.VENDOR_PORT_NOTES), "word string, dst_port int, note string")
    ends = rules.select(*key, F.explode(F.array_distinct(F.array("src_zone", "dst_zone"))).alias("zone"))
    hits = (
        ends.join(zone_vendors, "zone").join(F.broadcast(notes), "dst_port")
        .filter(F.lower("vendor").contains(F.col("word")))
        .select(*key, F.concat_ws(": ", "vendor", "note").alias("remark")).distinct()
    )
    return hits.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("remark")), "; ").alias("vendor_context"))


def enforcement_rules(
    rules: DataFrame, zones: DataFrame, fmt: str, zone_vendors: DataFrame | None = None, first_sid: int = 9000001
) -> DataFrame:
    """Policy rules as text, one line per rule: src_zone, dst_zone, protocol, dst_port, line.

    ``fmt``: ``router_acl``, ``firewall_acl``, ``table`` (columns ``C.POLICY_TABLE_HEADER``),
    ``ids`` or ``json``. Default denies are :func:`enforcement_denies`.
    """
    key = ["src_zone", "dst_zone", "protocol", "dst_port"]
    if zone_vendors is not None:
        rules = rules.join(vendor_remarks(rules, zone_vendors), key, "left")
    else:
        rules = rules.withColumn("vendor_context", F.lit(None).cast("string"))
    context = F.coalesce("vendor_context", F.lit(""))
    transport = transport_of(F.col("protocol"), F.col("dst_port"))
    port = F.coalesce(F.col("dst_port").cast("string"), F.lit("any"))
    eq = F.when(F.col("dst_port").isNotNull(), F.concat(F.lit(" eq "), F.col("dst_port").cast("string"))).otherwise("")
    if fmt == "router_acl":
        line = F.concat(F.lit("permit "), transport, F.lit(" any any"), eq)
    elif fmt == "firewall_acl":
        sizes = zones.select("zone", "asset_count")
        for e in ("src", "dst"):
            rules = rules.join(
                F.broadcast(sizes.select(F.col("zone").alias(f"{e}_zone"), F.col("asset_count").alias(f"_{e}"))), f"{e}_zone", "left"
            )
        clause = {
            e: F.when(F.col(f"_{e}") > 3, F.concat(F.lit("object-group OBJ-"), _acl_name(f"{e}_zone"))).otherwise("any")
            for e in ("src", "dst")
        }
        line = F.concat(
            F.lit("access-list ACL-"), _acl_name("src_zone"), F.lit("-TO-"), _acl_name("dst_zone"),
            F.lit(" extended permit "), transport, F.lit(" "), clause["src"], F.lit(" "), clause["dst"], eq,
        )
    elif fmt == "table":
        note = F.when(context == "", "").otherwise(F.concat(F.lit(" ["), context, F.lit("]")))
        why = F.concat(F.translate("justification", "\t", " "), note)
        line = F.concat_ws("\t", F.lit("ALLOW"), "src_zone", F.lit("any"), "dst_zone", F.lit("any"), transport, port, F.lit("→"), "risk", why)
    elif fmt == "ids":
        # Numbering: position inside the zone pair plus the rules of the pairs before it.
        pairs = rules.groupBy("src_zone", "dst_zone").agg(F.count("*").alias("_n"))
        running = Window.orderBy("src_zone", "dst_zone").rowsBetween(Window.unboundedPreceding, -1)
        offsets = pairs.withColumn("_o", F.coalesce(F.sum("_n").over(running), F.lit(0))).drop("_n")
        inside = Window.partitionBy("src_zone", "dst_zone").orderBy("protocol", "dst_port")
        rules = rules.withColumn("_i", F.row_number().over(inside)).join(F.broadcast(offsets), ["src_zone", "dst_zone"])
        sid = F.col("_o") + F.col("_i") + (first_sid - 1)
        suffix = F.when(context == "", "").otherwise(F.concat(F.lit(" ("), context, F.lit(")")))
        message = F.regexp_replace(
            F.concat(F.lit("ALLOW: "), "protocol", F.lit("/"), port, F.lit(" "), "src_zone", F.lit(" to "), "dst_zone",
                     F.lit(" ["), "risk", F.lit("]"), suffix), '[";]', "")
        line = F.concat(
            F.lit("pass "), transport, F.lit(" any any -> any "), port, F.lit(' (msg:"'), message, F.lit('"; sid:'),
            sid.cast("string"), F.lit("; rev:1;)"),
        )
    elif fmt == "json":
        line = F.to_json(F.struct(*key, "risk", "packet_count", "justification", context.alias("vendor_context")))
    else:
        raise ValueError(fmt)
    return rules.select(*key, line.alias("line"))


def enforcement_denies(rules: DataFrame, fmt: str) -> DataFrame:
    """Default-deny lines: one per zone pair for the ACL dialects, one in all otherwise."""
    if fmt in ("router_acl", "firewall_acl"):
        pairs = rules.select("src_zone", "dst_zone").distinct()
        head = F.lit("") if fmt == "router_acl" else F.concat(
            F.lit("access-list ACL-"), _acl_name("src_zone"), F.lit("-TO-"), _acl_name("dst_zone"), F.lit(" extended ")
        )
        return pairs.select("src_zone", "dst_zone", F.concat(head, F.lit("deny ip any any log")).alias("line"))
    n = rules.agg(F.count("*").alias("n"))
    line = {
        "table": F.lit("DENY\t*\t*\t*\t*\t*\t*\t*\t—\tDefault deny"),
        "ids": F.concat(
            F.lit('drop ip any any -> any any (msg:"DENY: default deny"; sid:'),
            (F.col("n") + 9000001).cast("string"), F.lit("; rev:1;)"),
        ),
        "json": F.lit('{"default_action":"deny"}'),
    }[fmt]
    return n.select(F.lit("*").alias("src_zone"), F.lit("*").alias("dst_zone"), line.alias("line"))
