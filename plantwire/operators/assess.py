"""Asset assessments: criticality, names, infrastructure roles, CVEs, compliance, allowlist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import columns as X
from ..functions.matching import either_contains
from .findings import text

# --- fixed values: words that decide criticality, in order ---------------------------
_SAFETY_WORDS = ("safety", "sis", "sil")
_CONTROL_WORDS = ("plc", "rtu", "ied", "relay", "controller", "outstation")
_SUPERVISORY_WORDS = ("hmi", "scada", "engineering", "ews", "dcs")
_DATA_WORDS = ("historian", "gateway", "opc", "dmz")
_CRITICAL_PROTOCOL_WORDS = ("modbus", "dnp3", "s7", "ethernet_ip", "bacnet", "iec104", "profinet")

# --- fixed values: name prefixes by role word, then by protocol word --------------------
_ROLE_PREFIXES = (
    (("safety", "sis"), "SIS"), (("plc", "controller"), "PLC"), (("rtu", "outstation"), "RTU"), (("hmi",), "HMI"),
    (("historian",), "HIST"), (("engineering", "ews"), "EWS"), (("scada",), "SCADA"), (("switch", "managed"), "SW"),
    (("gateway", "proxy"), "GW"), (("io", "remote i/o"), "IO"), (("relay", "ied"), "IED"), (("dcs",), "DCS"),
)
_PROTOCOL_PREFIXES = (
    (("modbus",), "MOD"), (("dnp3",), "DNP"), (("s7",), "S7"), (("bacnet",), "BAC"), (("enip", "ethernet"), "EIP"),
    (("iec104",), "IEC"), (("profinet",), "PN"),
)


def assess_criticality(assets: DataFrame) -> DataFrame:
    role = F.lower("device_type")
    ot = F.exists("protocols", lambda p: X.contains_any(F.lower(p), _CRITICAL_PROTOCOL_WORDS))
    level = F.col("purdue_level")
    grade = (
        F.when(X.contains_any(role, _SAFETY_WORDS + _CONTROL_WORDS), "critical")
        .when(X.contains_any(role, _SUPERVISORY_WORDS), "high")
        .when(X.contains_any(role, _DATA_WORDS), "medium")
        .when(ot, "high")
        .when(level.isin(0, 1), "critical").when(level == 2, "high").when(level == 3, "medium")
        .otherwise("low")
    )
    reason = (
        F.when((F.col("criticality") == "critical") & role.contains("safety"), text("safety system (%s)", "device_type"))
        .when(F.col("criticality") == "critical", text("control device (%s)", "device_type"))
        .when(F.col("criticality") == "high", text("supervisory device (%s)", "device_type"))
        .when(F.col("criticality") == "medium", text("data layer (%s)", "device_type"))
        .when(level.isNotNull(), text("Purdue level %d", "purdue_level"))
        .otherwise("no OT protocol or role")
    )
    return assets.select("ip_address", "device_type", "purdue_level", grade.alias("criticality")).select(
        "ip_address", "criticality", reason.alias("reason")
    )


def suggest_names(assets: DataFrame) -> DataFrame:
    role, protocol = F.lower("device_type"), F.coalesce(F.get("protocols", F.lit(0)), F.lit("unknown"))
    prefix = F.lit("DEV")
    for words, label in reversed(_PROTOCOL_PREFIXES):
        prefix = F.when(X.contains_any(F.lower(protocol), words), label).otherwise(prefix)
    for words, label in reversed(_ROLE_PREFIXES):
        prefix = F.when(X.contains_any(role, words), label).otherwise(prefix)
    ip = F.col("ip_address")

    def part(i: int) -> Column:
        return F.lpad(F.coalesce(X.octet(ip, i), F.lit(0)).cast("string"), 3, "0")

    quad = F.size(F.split(ip, r"\.")) == 4
    suffix = F.when(quad, F.concat_ws("-", part(2), part(3))).otherwise(F.replace(ip, F.lit("."), F.lit("-")))
    return assets.select(
        "ip_address", F.concat_ws("-", prefix, suffix).alias("suggested_name"),
        F.format_string("role %s, protocol %s", F.col("device_type"), protocol).alias("reason"),
    )


def _scalance_role(model: Column) -> Column:
    upper = F.upper(model)
    series = F.ltrim(F.regexp_extract(upper, "SCALANCE(.*)", 1))
    return F.when(
        upper.contains("SCALANCE"),
        F.when(series.startswith("W"), "access_point").when(series.startswith("M"), "router")
        .when(series.startswith("S"), "firewall").otherwise("managed_switch"),
    )


def classify_infrastructure(assets: DataFrame) -> DataFrame:
    """Network role by type, model text, vendor, protocol profile and tags, in that order."""
    kind = F.lower("device_type")
    vendor = F.lower(F.coalesce("vendor", F.lit("")))
    managed = X.has_any(F.col("protocols"), C.MANAGEMENT_PROTOCOLS)
    ot = X.has_any(F.col("protocols"), C.OT_PROTOCOLS)
    switch = F.when(managed, "managed_switch").otherwise("unmanaged_switch")
    tag_role = F.get(
        F.filter(
            F.transform(
                "tags",
                lambda t: F.when(F.lower(t).isin("switch", "managed-switch"), "managed_switch")
                .when(F.lower(t) == "unmanaged-switch", "unmanaged_switch").when(F.lower(t) == "router", "router")
                .when(F.lower(t) == "firewall", "firewall").when(F.lower(t).isin("access-point", "ap"), "access_point")
                .when(F.lower(t) == "gateway", "gateway"),
            ),
            lambda r: r.isNotNull(),
        ),
        F.lit(0),
    )
    by_type = (
        F.when(kind == "switch", switch).when(kind == "router", "router")
        .when(kind.isin("firewall", "utm", "ngfw"), "firewall")
        .when(kind.isin("access_point", "wlan_ap"), "access_point").when(kind == "gateway", "gateway")
    )
    by_model = F.coalesce(*[_scalance_role(F.col(c)) for c in ("product_family", "hostname", "device_type", "vendor")])
    by_vendor = (
        F.when(X.contains_any(vendor, C.OT_SWITCH_VENDORS), switch)
        .when(X.contains_any(vendor, C.FIREWALL_VENDORS), "firewall")
        .when(X.contains_any(vendor, C.ROUTER_VENDORS), "router")
    )
    by_profile = F.when(F.array_contains("protocols", "snmp") & managed & ~ot, "managed_switch")
    role = F.coalesce(by_type, by_model, by_vendor, by_profile, tag_role, F.lit("not_infrastructure"))
    level = F.when(role.isin("managed_switch", "unmanaged_switch", "access_point"), 2).when(
        role.isin("router", "firewall", "gateway"), 3
    )
    return assets.select("ip_address", role.alias("role"), level.alias("purdue_level"))


def device_identities(assets: DataFrame, lldp: DataFrame | None = None, snmp: DataFrame | None = None) -> DataFrame:
    """Vendor, model and firmware per device: LLDP, then SNMP, then the asset row."""
    rows = assets.select("ip_address", F.col("vendor").alias("_av"), F.col("product_family").alias("_am"))
    none = F.lit(None).cast("string")
    if lldp is not None:
        rows = rows.join(
            lldp.select(F.col("ip").alias("ip_address"), F.col("vendor").alias("_lv"), F.col("model").alias("_lm"),
                        F.col("firmware").alias("_lf")), "ip_address", "left")
    else:
        rows = rows.withColumns({"_lv": none, "_lm": none, "_lf": none})
    if snmp is not None:
        rows = rows.join(snmp.select(F.col("ip").alias("ip_address"), F.col("vendor").alias("_sv")), "ip_address", "left")
    else:
        rows = rows.withColumn("_sv", none)
    return rows.select(
        "ip_address", F.coalesce("_lv", "_sv", "_av").alias("vendor"),
        F.coalesce("_lm", "_am", F.lit("")).alias("model"), F.col("_lf").alias("firmware"),
    ).filter(F.coalesce(F.col("vendor"), F.lit("")) != "")


def cve_table(spark) -> DataFrame:
    return spark.createDataFrame(
        [(i, s, v, list(p), a) for i, s, v, p, a in C.CVES],
        "cve_id string, cvss double, cve_vendor string, products array<string>, advisory string",
    )


def match_cves(identities: DataFrame, cves: DataFrame | None = None) -> DataFrame:
    """Vulnerabilities per device by vendor text and product text, either way round.

    Texts are compared once per distinct (vendor, model, firmware present), then joined
    back to the devices.
    """
    cves = cve_table(identities.sparkSession) if cves is None else cves
    keyed = identities.select(
        "ip_address", F.lower("vendor").alias("v"), F.lower("model").alias("m"), F.col("firmware").isNotNull().alias("fw")
    )
    kinds = keyed.select("v", "m", "fw").distinct()
    vendors = either_contains(kinds.select("v"), cves.select(F.lower("cve_vendor")))
    near = kinds.join(vendors, kinds.v == vendors.l).join(cves, F.lower("cve_vendor") == F.col("r"))
    product = F.get(
        F.filter("products", lambda p: F.col("m").contains(F.lower(p)) | F.lower(p).contains(F.col("m"))), F.lit(0)
    )
    no_model = F.col("m") == ""
    matched = near.withColumn("p", F.when(~no_model, product)).filter(no_model | F.col("p").isNotNull())
    confidence = F.when(no_model, "low").when(F.col("fw"), "high").otherwise("medium")
    label = (
        F.when(F.col("cvss") >= 9, "CRITICAL").when(F.col("cvss") >= 7, "HIGH").when(F.col("cvss") >= 4, "MEDIUM")
        .otherwise("LOW")
    )
    hits = matched.select(
        "v", "m", "fw", "cve_id", "cvss", "advisory", F.coalesce("p", "cve_vendor").alias("matched_product"),
        confidence.alias("confidence"), label.alias("severity_label"),
    )
    return keyed.join(hits, ["v", "m", "fw"]).drop("v", "m", "fw")


def match_default_credentials(assets: DataFrame, dims: DataFrame) -> DataFrame:
    """Devices whose vendor and product match a known-default entry, once per entry.

    ``dims`` (vendor, product_pattern, severity) is the caller's list; it carries no
    secrets.
    """
    keyed = assets.filter(F.col("vendor").isNotNull() & F.col("product_family").isNotNull()).select(
        "ip_address", F.lower("vendor").alias("v"), F.lower("product_family").alias("m")
    )
    kinds = keyed.select("v", "m").distinct()
    vendors = either_contains(kinds.select("v"), dims.select(F.lower("vendor")))
    d = dims.select(
        F.lower("vendor").alias("r"), F.col("vendor").alias("entry_vendor"), "product_pattern", "severity"
    )
    pattern = F.lower("product_pattern")
    hits = (
        kinds.join(vendors, kinds.v == vendors.l).join(d, "r")
        .filter(F.col("m").contains(pattern) | pattern.contains(F.col("m")))
        .select("v", "m", "entry_vendor", "product_pattern", "severity").distinct()
    )
    return keyed.join(hits, ["v", "m"]).drop("v", "m").dropDuplicates(["ip_address", "entry_vendor", "product_pattern"])


# --- compliance -------------------------------------------------------------------------


def _has(words, title: Column) -> Column:
    return X.contains_any(title, words)


def compliance_report(
    findings: DataFrame, assets: DataFrame, conns: DataFrame, framework: str, requirements=C.COMPLIANCE_REQUIREMENTS
) -> DataFrame:
    """Status and evidence per requirement; every check reads one row of counts."""
    title = F.lower("title")
    facts = findings.agg(
        F.count_if(_has(("flat network",), title) | (F.col("technique_id") == "T0869")).alias("flat"),
        F.count_if(F.col("finding_type") == "purdue_violation").alias("violations"),
        F.count_if(_has(("default credential", "default password"), title)).alias("defaults"),
        F.count_if(_has(("cleartext", "unencrypted ot"), title)).alias("clear"),
        F.count_if(F.col("finding_type") == "attack_technique").alias("attacks"),
        F.count_if((F.col("finding_type") == "attack_technique") & (F.col("severity") == "critical")).alias("critical"),
        F.count_if((F.col("finding_type") == "attack_technique") & (F.col("severity") == "high")).alias("high"),
        F.count_if((F.col("technique_id") == "T0822") | _has(("remote access", "external remote"), title)).alias("remote"),
        F.count_if(_has(("no redundancy",), title)).alias("no_ring"),
        F.count_if(_has(("redundancy", "mrp", "rstp", "hsr", "prp", "dlr"), title)).alias("ring"),
        F.count_if(_has(("internet", "public ip"), title)).alias("exposed"),
    )
    a = assets.agg(
        F.count("*").alias("assets"), F.count_if(F.col("device_type") != "unknown").alias("typed"),
        F.count("purdue_level").alias("leveled"),
        F.count_if(
            F.col("is_public_ip")
            & ((F.col("purdue_level") <= 3) | X.has_any(F.col("protocols"), C.ICS_PROTOCOLS))
        ).alias("public_ot"),
    )
    public = assets.filter("is_public_ip").select("ip_address")
    touching = conns.select(
        "connection_id", F.explode(F.array("src_ip", "dst_ip")).alias("ip_address")
    ).join(public, "ip_address", "left_semi")
    c = conns.agg(
        F.count("*").alias("conns"), F.count_if(F.col("protocol").isin(*C.ICS_PROTOCOLS)).alias("ot_conns"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("protocol").isin(*C.ICS_PROTOCOLS), F.col("protocol")))),
                     ", ").alias("ot_names"),
    )
    for table, names in ((a, a.columns), (c, c.columns)):
        facts = facts.withColumns({n: table.select(n).scalar() for n in names})
    facts = facts.withColumn("external", touching.agg(F.countDistinct("connection_id")).scalar())

    def status(check: str, *cases: tuple[str, str, Column], otherwise: tuple[str, Column]) -> Column:
        def row(state: str, why: Column) -> Column:
            return F.struct(F.lit(check).alias("check_type"), F.lit(state).alias("status"), why.alias("evidence"))

        chain = None
        for cond, state, why in cases:
            chain = (F if chain is None else chain).when(F.expr(cond), row(state, why))
        return chain.otherwise(row(*otherwise))

    none = ("assets = 0", "not_assessed", F.lit("no asset data"))
    typed_pct, leveled_pct = "typed * 100 div greatest(assets, 1)", "leveled * 100 div greatest(assets, 1)"
    checks = F.array(
        status("flat_network",
               ("flat > 0", "gap", text("%d flat network findings", "flat")),
               ("violations > 0", "partial", text("%d cross-zone violations", "violations")), none,
               otherwise=("met", text("no flat network across %d assets", "assets"))),
        status("purdue_violations",
               ("violations > 0", "gap", text("%d cross-zone violations", "violations")), none,
               otherwise=("met", text("%d assets analyzed", "assets"))),
        status("default_creds",
               ("defaults > 0", "gap", text("%d devices with default credentials", "defaults")), none,
               otherwise=("met", text("no matches across %d assets", "assets"))),
        status("cleartext_ot",
               ("clear > 0", "gap", text("cleartext OT protocols in %d connections", "ot_conns")),
               ("ot_conns > 0", "gap", text("unencrypted OT protocols: %s", "ot_names")),
               ("conns = 0", "not_assessed", F.lit("no connection data")),
               otherwise=("met", F.lit("no unencrypted OT traffic"))),
        status("attack_findings",
               ("attacks > 0", "gap", text("%d findings, %d critical, %d high", "attacks", "critical", "high")), none,
               otherwise=("met", text("%d assets, %d connections analyzed", "assets", "conns"))),
        status("device_inventory", none,
               (f"{typed_pct} >= 80", "met", text("%d of %d devices typed", "typed", "assets")),
               otherwise=("partial", text("%d of %d devices typed", "typed", "assets"))),
        status("purdue_assigned", none,
               (f"{leveled_pct} >= 90", "met", text("%d of %d devices leveled", "leveled", "assets")),
               (f"{leveled_pct} >= 50", "partial", text("%d of %d devices leveled", "leveled", "assets")),
               otherwise=("gap", text("%d of %d devices leveled", "leveled", "assets"))),
        status("external_access",
               ("remote > 0", "gap", text("%d remote access findings", "remote")),
               ("external > 0", "partial", text("%d connections with public addresses", "external")),
               ("conns = 0", "not_assessed", F.lit("no connection data")),
               otherwise=("met", F.lit("no external access seen"))),
        status("redundancy",
               ("no_ring > 0", "gap", F.lit("no redundancy protocol seen")),
               ("ring > 0", "met", F.lit("redundancy protocol seen")),
               otherwise=("not_assessed", F.lit("redundancy unknown"))),
        status("internet_exposure",
               ("exposed > 0", "gap", text("%d exposure findings", "exposed")),
               ("public_ot > 0", "gap", text("%d OT devices with public addresses", "public_ot")), none,
               otherwise=("met", text("no exposure across %d assets", "assets"))),
    )
    rows = facts.select(F.explode(checks).alias("c")).select("c.*")
    wanted = rows.sparkSession.createDataFrame(
        [r for r in requirements if r[0] == framework],
        "framework string, requirement_id string, requirement_name string, check_type string",
    )
    return wanted.join(F.broadcast(rows), "check_type").select(
        "framework", "requirement_id", "requirement_name", "status", "evidence"
    )


# --- allowlist ----------------------------------------------------------------------------

_FLOW = ["src_ip", "dst_ip", "dst_port", "protocol"]


def _one_decimal(value: Column) -> Column:
    tenths = F.round(value * 10).cast("bigint")
    return F.concat((F.floor(tenths / 10)).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def _pretty(kind: Column) -> Column:
    fixed = {
        "plc": "PLC", "rtu": "RTU", "hmi": "HMI", "scada_server": "SCADA Server", "io_server": "I/O Server",
        "engineering_workstation": "Engineering Workstation", "field_device": "Field Device",
        "unknown": "Unknown Device",
    }
    out = F.concat(F.upper(F.substring(kind, 1, 1)), F.substring(kind, 2, 1000))
    for name, label in fixed.items():
        out = F.when(kind == name, label).otherwise(out)
    return out


def allowlist(conns: DataFrame, assets: DataFrame, stats: DataFrame) -> DataFrame:
    """One row per observed flow with direction, frequency, class and justification."""
    candidates = conns.select(*_FLOW, F.explode(F.array("dst_port", "src_port")).alias("_port")).distinct()
    reverse = conns.select(
        F.col("dst_ip").alias("src_ip"), F.col("src_ip").alias("dst_ip"), "protocol", F.col("dst_port").alias("_port"),
        F.lit(True).alias("_back"),
    ).distinct()
    flows = (
        candidates.join(reverse, ["src_ip", "dst_ip", "protocol", "_port"], "left")
        .groupBy(*_FLOW).agg(F.coalesce(F.bool_or("_back"), F.lit(False)).alias("both"))
    )

    def end(prefix: str) -> DataFrame:
        return assets.select(
            F.col("ip_address").alias(f"{prefix}_ip"), F.col("device_type").alias(f"{prefix}_type"),
            F.col("purdue_level").alias(f"{prefix}_level"),
        )

    s = stats.select(
        "src_ip", "dst_ip", F.col("port").alias("dst_port"), "protocol",
        F.struct("packet_count", "is_periodic", "avg_interval_ms", "packets_per_sec", "duration_secs").alias("st"),
    )
    rows = flows.join(end("src"), "src_ip", "left").join(end("dst"), "dst_ip", "left").join(s, _FLOW, "left")
    rows = rows.withColumns({f"{e}_type": F.coalesce(f"{e}_type", F.lit("unknown")) for e in ("src", "dst")})
    ms = F.col("st.avg_interval_ms")
    label = (
        F.when(ms < 1000, F.concat(F.lit("periodic ("), F.round(ms).cast("bigint").cast("string"), F.lit("ms)")))
        .when(ms < 60000, F.concat(F.lit("periodic ("), _one_decimal(ms / 1000), F.lit("s)")))
        .otherwise(F.concat(F.lit("periodic ("), _one_decimal(ms / 60000), F.lit("min)")))
    )
    one = F.col("st.packet_count") == 1
    frequency = (
        F.when(F.col("st").isNull(), "occasional").when(one, "one-off").when(F.col("st.is_periodic"), label)
        .when((F.col("st.packets_per_sec") > 1) & (F.col("st.duration_secs") > 60), "continuous")
        .otherwise("occasional")
    )
    src, dst = F.lower("src_type"), F.lower("dst_type")
    level3 = F.coalesce(F.col("src_level") == 3, F.lit(False)) | F.coalesce(F.col("dst_level") == 3, F.lit(False))
    grade = (
        F.when(~F.col("protocol").isin(*C.ICS_PROTOCOLS), "it")
        .when(src.contains("engineer") | dst.contains("engineer"), "management")
        .when(X.contains_any(src, ("historian", "scada")) | dst.contains("historian") | level3, "monitoring")
        .otherwise("operational")
    )
    known_src, known_dst = F.col("src_type") != "unknown", F.col("dst_type") != "unknown"
    a, b = _pretty(F.col("src_type")), _pretty(F.col("dst_type"))
    why = (
        F.when(known_src & known_dst, text("%s communicating with %s via %s", a, b, "protocol"))
        .when(known_src, text("%s to %s:%d", a, "protocol", "dst_port"))
        .when(known_dst, text("%s traffic to %s on port %d", "protocol", b, "dst_port"))
        .otherwise(text("%s traffic on port %d", "protocol", "dst_port"))
    )
    return rows.select(
        *_FLOW, F.when(F.col("both"), "bidirectional").otherwise("unidirectional").alias("direction"),
        frequency.alias("frequency"), F.when(~one, ms).alias("avg_interval_ms"), grade.alias("classification"),
        why.alias("justification"),
    )


def allowlist_order() -> list[Column]:
    rank = X.rank_of(F.col("classification"), {"operational": 0, "management": 1, "monitoring": 2, "it": 3})
    return [rank, F.col("src_ip"), F.col("dst_port"), F.col("dst_ip"), F.col("protocol")]


def allowlist_csv(rows: DataFrame) -> DataFrame:
    interval = F.coalesce(_one_decimal(F.col("avg_interval_ms")), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(F.col("justification"), F.lit('"'), F.lit("'")), F.lit('"'))
    return rows.select(
        F.concat_ws(
            ",", "src_ip", "dst_ip", "protocol", F.col("dst_port").cast("string"), "direction", "frequency", interval,
            "classification", quoted,
        ).alias("line")
    )


def firewall_rules(rows: DataFrame) -> DataFrame:
    """ALLOW line per flow and a last DENY line, numbered by section for ordering."""
    transport = F.when(F.col("dst_port").isin(*C.UDP_PORTS), "udp").otherwise("tcp")
    allow = rows.select(
        F.lit(1).alias("section"),
        text("ALLOW %s %s -> %s:%d  # %s", transport, "src_ip", "dst_ip", "dst_port", "justification").alias("line"),
    )
    deny = rows.sparkSession.createDataFrame([(2, "DENY all * -> *")], "section int, line string")
    return allow.union(deny)
