"""Queries over assessments, drift and merging, and segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import analysis as A
from ..operators import assess as E
from ..operators import drift as B
from ..operators import policy as Y
from ..operators import segmentation as Z
from ..operators import similarity as J
from ..operators import topology as G
from ..operators import traffic
from .catalog_findings import found_sql, run_of, switch_site
from .catalog_traffic import _LLDP, lldp_rows, packets_with_props
from .registry import AFTER, BEFORE, SQL, joined, on_site, query, sql_joined, us
from .site import SQL_SETS, Site

# --- assessments ---------------------------------------------------------------------------


@on_site("e1_assess_criticality", """SELECT ip AS ip_address, criticality, CASE criticality WHEN 'critical' THEN 'control device (' || device_type || ')'
    WHEN 'high' THEN 'supervisory device (' || device_type || ')' WHEN 'medium' THEN 'data layer (' || device_type || ')'
    ELSE coalesce('Purdue level ' || level, 'no OT protocol or role') END AS reason FROM pf""")
def _(s):
    return E.assess_criticality(s.partly_leveled)


@on_site("e2_suggest_names", """SELECT ip AS ip_address, prefix || '-' || lpad(split_part(ip, '.', 3), 3, '0') || '-' || lpad(split_part(ip, '.', 4), 3, '0') AS suggested_name,
    'role ' || device_type || ', protocol ' || protocols[1] AS reason FROM (SELECT *, CASE device_type WHEN 'plc' THEN 'PLC' WHEN 'rtu' THEN 'RTU' WHEN 'hmi' THEN 'HMI'
    WHEN 'historian' THEN 'HIST' WHEN 'scada_server' THEN 'SCADA' ELSE CASE protocols[1] WHEN 'modbus' THEN 'MOD' WHEN 'dnp3' THEN 'DNP' WHEN 's7comm' THEN 'S7'
    WHEN 'bacnet' THEN 'BAC' WHEN 'ethernet_ip' THEN 'EIP' WHEN 'iec104' THEN 'IEC' WHEN 'profinet' THEN 'PN' ELSE 'DEV' END END AS prefix FROM assw)""", "wide")
def _(s):
    return E.suggest_names(s.assets)


@on_site("e3_classify_infrastructure", f"""WITH {_LLDP} SELECT a.ip AS ip_address, CASE
    WHEN t = 'switch' AND m THEN 'managed_switch' WHEN t = 'switch' THEN 'unmanaged_switch' WHEN t = 'router' THEN 'router'
    WHEN vendor IN ('Moxa', 'Phoenix Contact', 'Rockwell Automation') THEN CASE WHEN m THEN 'managed_switch' ELSE 'unmanaged_switch' END
    ELSE 'not_infrastructure' END AS role FROM (SELECT a.ip, a.vendor, list_has_any(a.protocols, ['http', 'https', 'ssh', 'snmp']) AS m,
    CASE WHEN a.device_type = 'unknown' AND l.caps = 20 THEN 'router' WHEN a.device_type = 'unknown' AND l.caps = 4 THEN 'switch' ELSE a.device_type END AS t
    FROM ass a LEFT JOIN lldp l USING (mac)) a""")
def _(s):
    from ..operators.devices import _last_row
    from ..operators.traffic import build_assets

    s = packets_with_props(s)
    assets = build_assets(s.base, lldp=_last_row(lldp_rows(s), "mac"), oui=s.oui)
    return E.classify_infrastructure(assets).select("ip_address", "role")


def identities(s):
    from ..operators.devices import lldp_by_device

    s = packets_with_props(s)
    return E.device_identities(s.assets, lldp_by_device(lldp_rows(s), s.base))


@on_site("e4_match_cves", f"""WITH {_LLDP}, idn AS (SELECT a.ip, a.vendor, coalesce(l.model, '') AS model, l.mac IS NOT NULL AS fw FROM ass a LEFT JOIN lldp l USING (mac) WHERE a.vendor IS NOT NULL),
    cve AS (SELECT * FROM (VALUES ('CVE-2020-28400', CAST(7.5 AS DOUBLE), 'Siemens', 'ICSA-21-194-03', ''), ('CVE-2023-44317', 7.2, 'Siemens', 'SSA-699386', ''),
    ('CVE-2022-46142', 6.5, 'Siemens', 'SSA-413565', ''), ('CVE-2021-37185', 7.5, 'Siemens', 'SSA-150692', ''),
    ('CVE-2022-30767', 9.8, 'Moxa', 'Moxa Security Advisory MPSA-221201', 'EDS-400A'), ('CVE-2023-25072', 7.5, 'Phoenix Contact', 'VDE-2023-009', '')) t(cve_id, cvss, cv, advisory, product))
    SELECT ip AS ip_address, cve_id, cvss, advisory, CASE WHEN model = '' THEN cv ELSE product END AS matched_product,
    CASE WHEN model = '' THEN 'low' WHEN fw THEN 'high' ELSE 'medium' END AS confidence,
    CASE WHEN cvss >= 9 THEN 'CRITICAL' WHEN cvss >= 7 THEN 'HIGH' ELSE 'MEDIUM' END AS severity_label
    FROM idn JOIN cve ON vendor = cv WHERE model = '' OR (product <> '' AND contains(model, product))""")
def _(s):
    return E.match_cves(identities(s))


_DIMS = [("Moxa Inc", "EDS", "high"), ("moxa", "EDS-400A", "critical"), ("Siemens AG", "S7", "high"), ("Phoenix", "FL", "medium"), ("Siemens", "EDS", "low")]


@on_site("e5_match_default_credentials", f"""WITH {_LLDP} SELECT a.ip AS ip_address, d.v AS entry_vendor, d.p AS product_pattern, d.s AS severity FROM ass a JOIN lldp l USING (mac)
    JOIN (VALUES ('Moxa Inc', 'EDS', 'high'), ('moxa', 'EDS-400A', 'critical'), ('Siemens AG', 'S7', 'high'), ('Phoenix', 'FL', 'medium'), ('Siemens', 'EDS', 'low')) d(v, p, s)
    ON (contains(lower(a.vendor), lower(d.v)) OR contains(lower(d.v), lower(a.vendor))) AND (contains(lower(l.model), lower(d.p)) OR contains(lower(d.p), lower(l.model)))""")
def _(s):
    rows = identities(s).withColumn("product_family", F.when(F.col("model") != "", F.col("model")))
    return E.match_default_credentials(rows, s.spark.createDataFrame(_DIMS, "vendor string, product_pattern string, severity string"))


_NO_ASSET = "none"


def _status_sql() -> str:
    """One row per check: check_type, status, evidence, from the counts in ``facts``."""

    def check(name: str, *cases: tuple[str, str, str], otherwise: tuple[str, str]) -> str:
        status = " ".join(f"WHEN {cond} THEN '{state}'" for cond, state, _ in cases)
        why = " ".join(f"WHEN {cond} THEN {text}" for cond, _, text in cases)
        return f"SELECT '{name}' AS check_type, CASE {status} ELSE '{otherwise[0]}' END AS status, CASE {why} ELSE {otherwise[1]} END AS evidence FROM facts"

    none, quiet = ("assets = 0", "not_assessed", "'no asset data'"), ("conns = 0", "not_assessed", "'no connection data'")
    typed, leveled = "typed || ' of ' || assets || ' devices typed'", "leveled || ' of ' || assets || ' devices leveled'"
    share = "{0} * 100 // greatest(assets, 1) >= {1}"
    return " UNION ALL ".join([
        check("flat_network", ("flat > 0", "gap", "flat || ' flat network findings'"), ("violations > 0", "partial", "violations || ' cross-zone violations'"), none,
              otherwise=("met", "'no flat network across ' || assets || ' assets'")),
        check("purdue_violations", ("violations > 0", "gap", "violations || ' cross-zone violations'"), none, otherwise=("met", "assets || ' assets analyzed'")),
        check("default_creds", ("defaults > 0", "gap", "defaults || ' devices with default credentials'"), none, otherwise=("met", "'no matches across ' || assets || ' assets'")),
        check("cleartext_ot", ("clear > 0", "gap", "'cleartext OT protocols in ' || ot_conns || ' connections'"),
              ("ot_conns > 0", "gap", "'unencrypted OT protocols: ' || ot_names"), quiet, otherwise=("met", "'no unencrypted OT traffic'")),
        check("attack_findings", ("attacks > 0", "gap", "attacks || ' findings, ' || critical || ' critical, ' || high || ' high'"), none,
              otherwise=("met", "assets || ' assets, ' || conns || ' connections analyzed'")),
        check("device_inventory", none, (share.format("typed", 80), "met", typed), otherwise=("partial", typed)),
        check("purdue_assigned", none, (share.format("leveled", 90), "met", leveled), (share.format("leveled", 50), "partial", leveled), otherwise=("gap", leveled)),
        check("external_access", ("remote > 0", "gap", "remote || ' remote access findings'"), ("external > 0", "partial", "external || ' connections with public addresses'"), quiet,
              otherwise=("met", "'no external access seen'")),
        check("redundancy", ("no_ring > 0", "gap", "'no redundancy protocol seen'"), ("ring > 0", "met", "'redundancy protocol seen'"), otherwise=("not_assessed", "'redundancy unknown'")),
        check("internet_exposure", ("exposed > 0", "gap", "exposed || ' exposure findings'"), ("public_ot > 0", "gap", "public_ot || ' OT devices with public addresses'"), none,
              otherwise=("met", "'no exposure across ' || assets || ' assets'")),
    ])


def _compliance_sql(findings: str, frameworks: tuple[str, ...]) -> str:
    """The report over ``findings`` (finding_type, severity, title, technique_id) and the labelled site."""
    rows = ", ".join(f"('{f}', '{i}', '{n}', '{c}')" for f, i, n, c in C.COMPLIANCE_REQUIREMENTS if f in frameworks)

    def titled(*words: str) -> str:
        return " OR ".join(f"contains(lower(title), '{w}')" for w in words)

    counts = {
        "flat": f"{titled('flat network')} OR technique_id = 'T0869'", "violations": "finding_type = 'purdue_violation'",
        "defaults": titled("default credential", "default password"), "clear": titled("cleartext", "unencrypted ot"),
        "attacks": "finding_type = 'attack_technique'", "critical": "finding_type = 'attack_technique' AND severity = 'critical'",
        "high": "finding_type = 'attack_technique' AND severity = 'high'", "remote": f"technique_id = 'T0822' OR {titled('remote access', 'external remote')}",
        "no_ring": titled("no redundancy"), "ring": titled("redundancy", "mrp", "rstp", "hsr", "prp", "dlr"), "exposed": titled("internet", "public ip"),
    }
    ics = SQL_SETS["ICS"]
    return f"""WITH all_found AS ({findings}),
    f AS (SELECT {", ".join(f"count(*) FILTER ({cond}) AS {name}" for name, cond in counts.items())} FROM all_found),
    a AS (SELECT count(*) AS assets, count(*) FILTER (device_type <> 'unknown') AS typed, count(level) AS leveled,
        count(*) FILTER (is_public AND (level <= 3 OR list_has_any(protocols, [{ics[1:-1]}]))) AS public_ot FROM assm JOIN lvm USING (ip, device_type)),
    c AS (SELECT count(*) AS conns, count(*) FILTER (protocol IN {ics}) AS ot_conns, coalesce(string_agg(DISTINCT protocol, ', ' ORDER BY protocol) FILTER (protocol IN {ics}), '') AS ot_names,
        count(*) FILTER (src_ip IN (SELECT ip FROM assm WHERE is_public) OR dst_ip IN (SELECT ip FROM assm WHERE is_public)) AS external FROM cnm),
    facts AS (SELECT * FROM f, a, c), checks AS ({_status_sql()})
    SELECT framework, requirement_id, requirement_name, status, evidence FROM (VALUES {rows}) r(framework, requirement_id, requirement_name, check_type) JOIN checks USING (check_type)"""


_KINDS = "SELECT finding_type, severity, title, technique_id FROM ({})"


@query("e6_compliance_report", _compliance_sql(_KINDS.format(found_sql()), ("iec62443",)))
def _(spark, d):
    run = run_of(spark, d)
    return E.compliance_report(run["findings"], run["site"].leveled, run["site"].connections, "iec62443")


_SWITCH_KINDS = f"""SELECT 'attack_technique' AS finding_type, severity, title, '' AS technique_id FROM ({SQL["f39_switch_security"]})
    UNION ALL SELECT 'attack_technique', 'critical', 'Default credential match on ' || ip, '' FROM ass WHERE vendor = 'Moxa'"""


@query("e6_compliance_report_all_frameworks", _compliance_sql(f"{_KINDS.format(found_sql())} UNION ALL {_SWITCH_KINDS}", ("iec62443", "nist80082", "nerccip")))
def _(spark, d):
    run = run_of(spark, d)
    assets, vlans, ring, defaults = switch_site(Site(spark, d))
    found = A.switch_findings(A.switch_security(assets, vlans, ring, defaults)).unionByName(A.credential_findings(defaults))
    found = found.unionByName(run["findings"])
    parts = [E.compliance_report(found, run["site"].leveled, run["site"].connections, f) for f in ("iec62443", "nist80082", "nerccip")]
    return parts[0].union(parts[1]).union(parts[2])


_PRETTY = "CASE {0} WHEN 'plc' THEN 'PLC' WHEN 'rtu' THEN 'RTU' WHEN 'hmi' THEN 'HMI' WHEN 'historian' THEN 'Historian' WHEN 'it_device' THEN 'It_device' WHEN 'scada_server' THEN 'SCADA Server' END"
_DEC = "(CAST(round({0} * 10) AS BIGINT) // 10) || '.' || (CAST(round({0} * 10) AS BIGINT) % 10)"


def _allow(t: str) -> str:
    a, b = _PRETTY.format("src_type"), _PRETTY.format("dst_type")
    return f"""SELECT src_ip, dst_ip, dst_port, protocol, direction, classification,
    CASE WHEN packet_count = 1 THEN 'one-off' WHEN is_periodic THEN 'periodic (' || CASE WHEN avg_ms < 1000 THEN CAST(round(avg_ms) AS BIGINT) || 'ms'
        WHEN avg_ms < 60000 THEN {_DEC.format('avg_ms / 1000')} || 's' ELSE {_DEC.format('avg_ms / 60000')} || 'min' END || ')'
        WHEN packets_per_sec > 1 AND duration_secs > 60 THEN 'continuous' ELSE 'occasional' END AS frequency,
    CASE WHEN packet_count = 1 THEN '' ELSE {_DEC.format('avg_ms')} END AS interval,
    CASE WHEN src_type <> 'unknown' AND dst_type <> 'unknown' THEN {a} || ' communicating with ' || {b} || ' via ' || protocol
        WHEN src_type <> 'unknown' THEN {a} || ' to ' || protocol || ':' || dst_port WHEN dst_type <> 'unknown' THEN protocol || ' traffic to ' || {b} || ' on port ' || dst_port
        ELSE protocol || ' traffic on port ' || dst_port END AS justification FROM al{t}"""


_ALLOW = "SELECT src_ip, dst_ip, dst_port, protocol, direction, classification, frequency, justification FROM ({})"


def _allowlist(s):
    return s.allowlist.select("src_ip", "dst_ip", "dst_port", "protocol", "direction", "classification", "frequency", "justification")


on_site("e7_allowlist", _ALLOW.format(_allow("")))(_allowlist)
on_site("e7_allowlist_fast", _ALLOW.format(_allow("r")), "replay")(_allowlist)


@on_site("e8_allowlist_csv", f"""SELECT src_ip || ',' || dst_ip || ',' || protocol || ',' || dst_port || ',' || direction || ',' || frequency || ',' || interval || ',' ||
    classification || ',"' || justification || '"' AS line FROM ({_allow('')})""")
def _(s):
    return E.allowlist_csv(s.allowlist)


@on_site("e8_firewall_rules", f"""SELECT 1 AS section, 'ALLOW ' || CASE WHEN dst_port IN (47808, 34962, 34963, 34964, 2222) THEN 'udp' ELSE 'tcp' END || ' ' || src_ip || ' -> ' || dst_ip || ':' ||
    dst_port || '  # ' || justification AS line FROM ({_allow('')}) UNION ALL SELECT 2, 'DENY all * -> *'""")
def _(s):
    return E.firewall_rules(s.allowlist)


# --- drift: traffic before and after the middle of the month ------------------------------------


def two_sites(fn):
    return lambda spark, d: fn(Site(spark, d, "base", BEFORE), Site(spark, d, "base", AFTER))


_SIDES = """b AS (SELECT ip, device_type, coalesce(vendor, '') AS vendor, array_to_string(protocols, ', ') AS protocols, CASE WHEN vendor IS NOT NULL THEN 3 ELSE 1 END AS conf FROM assb),
    c AS (SELECT ip, device_type, coalesce(vendor, '') AS vendor, array_to_string(protocols, ', ') AS protocols, CASE WHEN vendor IS NOT NULL THEN 3 ELSE 1 END AS conf FROM assc)"""
_CHANGES = """SELECT b.ip, unnest(list_filter([CASE WHEN b.device_type <> c.device_type THEN {'f': 'device_type', 'o': b.device_type, 'n': c.device_type} END,
    CASE WHEN b.protocols <> c.protocols THEN {'f': 'protocols', 'o': b.protocols, 'n': c.protocols} END,
    CASE WHEN b.vendor <> c.vendor THEN {'f': 'vendor', 'o': b.vendor, 'n': c.vendor} END], lambda x: x IS NOT NULL)) AS d FROM b JOIN c USING (ip)"""

query("b1_drift_assets", f"""WITH {_SIDES} SELECT coalesce(c.ip, b.ip) AS ip_address, CASE WHEN b.ip IS NULL THEN 'new' WHEN c.ip IS NULL THEN 'missing' ELSE 'changed' END AS status,
    coalesce(c.device_type, b.device_type) AS device_type, coalesce(c.vendor, b.vendor) AS vendor FROM b FULL JOIN c ON b.ip = c.ip
    WHERE b.ip IS NULL OR c.ip IS NULL OR b.ip IN (SELECT ip FROM ({_CHANGES}))""")(two_sites(lambda b, c: B.drift_assets(b.assets, c.assets).select(
        "ip_address", "status", "device_type", F.coalesce("vendor", F.lit("")).alias("vendor"))))

query("b2_asset_changes", f"WITH {_SIDES} SELECT ip AS ip_address, d.f AS field, d.o AS old_value, d.n AS new_value FROM ({_CHANGES})")(
    two_sites(lambda b, c: B.asset_changes(b.assets, c.assets)))

_FLOWS = """fb AS (SELECT DISTINCT src_ip, dst_ip, dst_port, protocol FROM cnb), fc AS (SELECT DISTINCT src_ip, dst_ip, dst_port, protocol FROM cnc),
    fd AS (SELECT *, 'new' AS status FROM (SELECT * FROM fc EXCEPT SELECT * FROM fb) UNION ALL SELECT *, 'missing' FROM (SELECT * FROM fb EXCEPT SELECT * FROM fc))"""
query("b3_drift_connections", f"WITH {_FLOWS} SELECT * FROM fd")(two_sites(lambda b, c: B.drift_connections(b.connections, c.connections)))

query("b4_drift_summary", f"""WITH {_SIDES}, {_FLOWS}, q AS (SELECT (SELECT count(*) FROM c WHERE ip NOT IN (SELECT ip FROM b)) AS new_assets,
    (SELECT count(*) FROM b WHERE ip NOT IN (SELECT ip FROM c)) AS missing_assets, (SELECT count(DISTINCT ip) FROM ({_CHANGES})) AS changed_assets,
    (SELECT count(*) FROM b) AS baseline_assets, (SELECT count(*) FROM c) AS current_assets,
    (SELECT count(*) FROM cnc JOIN fd USING (src_ip, dst_ip, dst_port, protocol) WHERE status = 'new') AS new_connections,
    (SELECT count(*) FROM cnb JOIN fd USING (src_ip, dst_ip, dst_port, protocol) WHERE status = 'missing') AS missing_connections,
    (SELECT count(*) FROM fb) AS nb, (SELECT count(*) FROM fc) AS nc)
    SELECT new_assets, missing_assets, changed_assets, baseline_assets, current_assets, new_connections, missing_connections,
    round(least((new_assets + missing_assets + changed_assets + new_connections + missing_connections) / (greatest(baseline_assets, current_assets) + greatest(nb, nc)), 1.0), 6) AS drift_score FROM q""")(
    two_sites(lambda b, c: B.drift_summary(b.assets, c.assets, b.connections, c.connections).withColumn("drift_score", F.round("drift_score", 6))))


def alerts(s):
    """Error events as sensor alerts, one per packet."""
    from . import binding

    errors = binding.events(s.spark, s.sf_dir).filter("event_type = 'error'").select(F.col("event_id").alias("seq"))
    return s.packets.join(errors, "seq").select(
        F.col("ts").alias("timestamp"), "src_ip", "src_port", "dst_ip", "dst_port", F.col("seq").alias("signature_id"),
        F.concat(F.lit("error on "), "protocol").alias("signature"), F.lit("anomaly").alias("category"),
        (F.col("seq") % 3 + 1).cast("int").alias("severity"), F.lit("Suricata").alias("source"),
    )


@on_site("b5_correlate_alerts", """SELECT p.seq AS signature_id, p.src_ip, p.dst_ip, CAST(p.seq % 3 + 1 AS INT) AS severity, a.device_type AS src_device_type, b.device_type AS dst_device_type,
    coalesce(CAST(x.level AS VARCHAR), '') AS src_level FROM pk p JOIN ass a ON a.ip = p.src_ip JOIN ass b ON b.ip = p.dst_ip JOIN lv x ON x.ip = p.src_ip WHERE p.et = 'error'""")
def _(s):
    return B.correlate_alerts(alerts(s), s.leveled).select(
        "signature_id", "src_ip", "dst_ip", "severity", "src_device_type", "dst_device_type",
        F.coalesce(F.col("src_purdue_level").cast("string"), F.lit("")).alias("src_level"),
    )


def imported(s):
    return s.connections.withColumn("origin_files", F.array(F.lit("[Zeek]")))


_EV = """SELECT src_ip AS ip, dst_ip AS peer, protocol, dst_port FROM cn UNION ALL SELECT dst_ip, src_ip, protocol, dst_port FROM cn"""


@on_site("b6_zeek_device_events", f"""SELECT e.ip AS device_ip, count(*) FILTER (WHERE protocol = 'modbus') AS modbus_events, count(*) FILTER (WHERE protocol = 'dnp3') AS dnp3_events,
    CAST(0 AS BIGINT) AS dns_queries, count(*) FILTER (WHERE protocol NOT IN ('modbus','dnp3','s7comm') AND dst_port IN (80, 443, 8080, 8443)) AS http_requests,
    count(*) FILTER (WHERE protocol NOT IN ('modbus','dnp3') AND (protocol = 's7comm' OR dst_port NOT IN (80, 443, 8080, 8443))) AS conn_log_entries,
    count(DISTINCT peer) AS unique_peers, coalesce(any_value(a.n), 0) AS alert_count FROM ({_EV}) e LEFT JOIN (SELECT ip, count(*) AS n FROM (
    SELECT src_ip AS ip FROM pk WHERE et = 'error' UNION ALL SELECT dst_ip FROM pk WHERE et = 'error') GROUP BY ip) a ON a.ip = e.ip GROUP BY e.ip""")
def _(s):
    return B.zeek_device_events(imported(s), alerts(s))


@on_site("b6_zeek_event_samples", """SELECT device_ip, rank, peer_ip, summary FROM (SELECT ip AS device_ip, peer AS peer_ip, CAST(row_number() OVER (PARTITION BY ip ORDER BY first_seen, src_ip, src_port, dst_ip, dst_port)
    AS INT) AS rank, upper(transport) || ' ' || src_ip || ':' || src_port || ' -> ' || dst_ip || ':' || dst_port || ' (' || packet_count || ' pkts)' AS summary FROM (
    SELECT src_ip AS ip, dst_ip AS peer, * FROM cn UNION ALL SELECT dst_ip, src_ip, * FROM cn)) WHERE rank <= 50""")
def _(s):
    return B.zeek_event_samples(imported(s), 50).select("device_ip", "rank", "peer_ip", "summary")


def ingest_batch(spark, d):
    """The wide traffic as an import from a sensor: (connections, one asset row per address)."""
    w = Site(spark, d, "wide")
    conns = w.connections.withColumn("source", F.lit("Zeek"))
    assets = w.base.select(
        "ip_address", "protocols", F.lit(None).cast("string").alias("hostname"), F.lit("SensorVendor").alias("vendor"),
        F.when(F.col("packet_count") % 2 == 0, F.lit("Linux")).alias("os_info"), F.lit("Zeek").alias("source"),
        (F.col("packet_count") % 3 == 0).alias("is_active"), F.lit("unknown").alias("device_type"), "mac_address",
    )
    return conns, assets


@query("b7_merge_assets", """SELECT coalesce(a.ip, w.ip) AS ip_address, coalesce(a.device_type, 'unknown') AS device_type, coalesce(a.vendor, CASE WHEN w.ip IS NOT NULL THEN 'SensorVendor' END) AS vendor,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(a.protocols, []), coalesce(w.protocols, [])))), ','), '') AS protocols,
    CASE WHEN w.packet_count % 2 = 0 THEN CASE WHEN w.packet_count % 3 = 0 THEN '[scan] OS: Linux' ELSE '[passive] OS: Linux' END ELSE '' END AS notes,
    CASE WHEN w.ip IS NULL THEN '' WHEN w.packet_count % 3 = 0 THEN '[Zeek],[active-scan]' ELSE '[Zeek]' END AS tags FROM ass a FULL JOIN abw w ON a.ip = w.ip""")
def _(spark, d):
    _, assets = ingest_batch(spark, d)
    return B.merge_assets(Site(spark, d).assets, assets).select(
        "ip_address", "device_type", "vendor", joined("protocols").alias("protocols"), "notes", joined("tags").alias("tags")
    )


@query("b8_merge_connections", """SELECT src_ip, src_port, dst_ip, dst_port, first(protocol ORDER BY late) AS protocol, CAST(sum(packet_count) AS BIGINT) AS packet_count,
    CAST(sum(byte_count) AS BIGINT) AS byte_count, array_to_string(list_sort(list_distinct(flatten(list(origin_files)))), ',') AS origin_files FROM (
    SELECT *, 0 AS late FROM cn UNION ALL SELECT * REPLACE (['[Zeek]'] AS origin_files), 1 FROM cnw) GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    conns, _ = ingest_batch(spark, d)
    return B.merge_connections(traffic.connections(Site(spark, d).packets, files=True), conns).select(
        "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "packet_count", "byte_count", joined("origin_files").alias("origin_files")
    )


@query("b8_merge_connection_files", """SELECT DISTINCT src_ip, src_port, dst_ip, dst_port, origin_file FROM pk
    UNION SELECT src_ip, src_port, dst_ip, dst_port, '[Zeek]' FROM cnw""")
def _(spark, d):
    conns, _ = ingest_batch(spark, d)
    return B.merge_connection_files(traffic.connection_files(Site(spark, d).packets), conns)


@query("b9_dedup_ingested_assets", """SELECT ip AS ip_address, array_to_string(list_sort(list(DISTINCT protocol)), ',') AS protocols, count(DISTINCT port) AS ports, min(host) AS hostname FROM (
    SELECT dst_ip AS ip, protocol, dst_port AS port, 'host-' || src_port AS host FROM cnw) GROUP BY ip""")
def _(spark, d):
    w = Site(spark, d, "wide")
    none = F.lit(None).cast("string")
    rows = w.connections.select(
        F.col("dst_ip").alias("ip_address"), none.alias("mac_address"), F.concat(F.lit("host-"), F.col("src_port").cast("string")).alias("hostname"),
        none.alias("device_type"), none.alias("vendor"), F.array("protocol").alias("protocols"),
        F.array(F.struct(F.col("dst_port").alias("port"), F.col("transport").alias("protocol"), F.col("protocol").alias("service_name"),
                         none.alias("service_version"), none.alias("product"))).alias("open_ports"),
        none.alias("os_info"), F.lit("Nmap").alias("source"), F.lit(True).alias("is_active"),
    )
    return B.dedup_ingested_assets(rows).select(
        "ip_address", joined("protocols").alias("protocols"), F.size("open_ports").cast("bigint").alias("ports"), "hostname"
    )


def edits(s):
    """User edits from the customers: the customer number points at a client address."""
    cust = s.spark.read.parquet(f"{s.sf_dir}/customer.parquet")
    u = "c_custkey"
    return cust.selectExpr(
        f"'10.' || ({u} div 2000) || '.' || ({u} % 8) || '.' || (({u} div 8) % 250 + 1) AS ip_address",
        "CASE WHEN c_custkey % 3 = 0 THEN 'engineering_workstation' END AS device_type", "c_name AS hostname", "CAST(NULL AS STRING) AS notes",
        "CAST(c_nationkey % 8 AS INT) AS purdue_level", "array(lower(c_mktsegment)) AS tags", "timestamp_seconds(c_custkey) AS edited_at",
    )


_EDITS = """ed AS (SELECT '10.' || (c_custkey // 2000) || '.' || (c_custkey % 8) || '.' || ((c_custkey // 8) % 250 + 1) AS ip, c_custkey AS tm, c_name AS hostname,
    CASE WHEN c_custkey % 3 = 0 THEN 'engineering_workstation' END AS device_type, c_nationkey % 8 AS lvl, lower(c_mktsegment) AS tag FROM customer),
    el AS (SELECT ip, arg_max(hostname, tm) AS hostname, arg_max(device_type, tm) FILTER (WHERE device_type IS NOT NULL) AS device_type, arg_max(lvl, tm) AS lvl, arg_max(tag, tm) AS tag, max(tm) AS tm FROM ed GROUP BY ip)"""


@on_site("b10_apply_overrides", f"""WITH {_EDITS} SELECT a.ip AS ip_address, coalesce(e.device_type, a.device_type) AS device_type, coalesce(e.hostname, '') AS hostname,
    CASE WHEN e.lvl BETWEEN 0 AND 5 THEN CAST(e.lvl AS VARCHAR) ELSE 'none' END AS purdue_level, coalesce(e.tag, '') AS tags FROM assw a LEFT JOIN el e USING (ip)""", "wide")
def _(s):
    return B.apply_overrides(s.assets, edits(s)).select(
        "ip_address", "device_type", F.coalesce("hostname", F.lit("")).alias("hostname"),
        F.coalesce(F.col("purdue_level").cast("string"), F.lit("none")).alias("purdue_level"), joined("tags").alias("tags"),
    )


@on_site("b11_asset_history", f"""WITH {_EDITS} SELECT ip AS ip_address, f.f AS field, f.o AS old_value, f.n AS new_value, CAST(tm AS BIGINT) AS changed_at FROM (
    SELECT ip, e.tm, unnest(list_filter([CASE WHEN e.device_type <> a.device_type THEN {{'f': 'device_type', 'o': a.device_type, 'n': e.device_type}} END,
    {{'f': 'hostname', 'o': '', 'n': e.hostname}}, {{'f': 'purdue_level', 'o': '', 'n': CAST(e.lvl AS VARCHAR)}}, {{'f': 'tags', 'o': '', 'n': e.tag}}], lambda x: x IS NOT NULL)) AS f
    FROM assw a JOIN el e USING (ip))""", "wide")
def _(s):
    return B.asset_history(edits(s), s.assets).select("ip_address", "field", "old_value", "new_value", F.unix_seconds("changed_at").alias("changed_at"))


@on_site("b12_timeline_filter", """SELECT src_ip, src_port, dst_ip, dst_port, protocol FROM cnw, (SELECT epoch_us(min(first_seen)) AS a, epoch_us(max(last_seen)) AS z FROM cnw)
    WHERE epoch_us(first_seen) <= a + (z - a) // 4""", "wide")
def _(s):
    return B.timeline_filter(s.connections, 0.25).select("src_ip", "src_port", "dst_ip", "dst_port", "protocol")


# --- segmentation --------------------------------------------------------------------------------


@on_site("z1_segmentation_profiles", """SELECT ip, device_type, criticality, coalesce(CAST(level AS VARCHAR), 'none') AS purdue_level, is_ot, NOT is_ot AS is_it, is_ot AND any_it AS is_dual_homed,
    array_to_string(list_filter(['modbus:' || m_role, 'dnp3:' || d_role, 'ethernet_ip:' || e_role, 's7comm:' || s_role, 'bacnet:' || b_role], lambda x: x IS NOT NULL), ',') AS roles FROM pf""")
def _(s):
    return s.segment_inputs[0].select(
        "ip", "device_type", "criticality", F.coalesce(F.col("purdue_level").cast("string"), F.lit("none")).alias("purdue_level"), "is_ot", "is_it", "is_dual_homed",
        F.array_join(F.transform("protocol_roles", lambda r: F.concat_ws(":", r["protocol"], r["role"])), ",").alias("roles"),
    )


_OB = """SELECT src_ip, src_port, dst_ip, dst_port, protocol, is_periodic, pattern_anomaly, w AS has_write_operations, cfg AS has_config_operations, listed AS is_in_allowlist,
    CASE WHEN t0886 THEN 'T0886' ELSE '' END AS attack_techniques FROM ob"""


def _observed(s):
    return s.segment_inputs[1].select(
        "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "is_periodic", "pattern_anomaly", "has_write_operations", "has_config_operations", "is_in_allowlist",
        joined("attack_techniques").alias("attack_techniques"),
    )


on_site("z1_segmentation_connections", _OB)(_observed)


@on_site("z2_neighbor_sets", "SELECT ip, peer FROM nbw", "wide")
def _(s):
    return s.neighbors


def server_pairs(s):
    """Pairs of neighbouring server addresses inside each /24 of servers, by rank."""
    servers = s.servers.withColumn("net", G.X.prefix24(F.col("ip_address")))
    from pyspark.sql.window import Window

    w = Window.partitionBy("net").orderBy("ip_address")
    return servers.withColumn("b", F.lead("ip_address").over(w)).filter("b IS NOT NULL").select(F.col("ip_address").alias("a"), "b")


@on_site("z3_jaccard_similarity", """SELECT a, b, round(len(list_intersect(x.peers, y.peers)) / (len(x.peers) + len(y.peers) - len(list_intersect(x.peers, y.peers))), 6) AS similarity
    FROM (SELECT ip AS a, lead(ip) OVER (PARTITION BY substr(ip, 1, length(ip) - length(split_part(ip, '.', 4))) ORDER BY ip) AS b FROM abw WHERE is_server) p
    JOIN nblw x ON x.ip = a JOIN nblw y ON y.ip = b""", "wide")
def _(s):
    return J.jaccard_similarity(s.neighbors, server_pairs(s)).withColumn("similarity", F.round("similarity", 6))


_GV = """SELECT a.device_type AS grp, a.vendor AS part_a, b.vendor AS part_b, round(avg(len(list_intersect(x.peers, y.peers)) / (len(x.peers) + len(y.peers) - len(list_intersect(x.peers, y.peers)))), 6) AS similarity
    FROM assw a JOIN assw b ON a.device_type = b.device_type AND a.vendor < b.vendor JOIN nblw x ON x.ip = a.ip JOIN nblw y ON y.ip = b.ip GROUP BY 1, 2, 3"""


@on_site("z3_average_group_similarity", _GV, "wide")
def _(s):
    groups = s.assets.filter("vendor IS NOT NULL").select(F.col("device_type").alias("grp"), F.col("vendor").alias("part"), F.col("ip_address").alias("ip"))
    return J.average_group_similarity(groups, s.neighbors, hot=5).withColumn("similarity", F.round("similarity", 6))


_HASHES = 64
_SKETCH = f"""fn AS (SELECT i, 1 + (i * i * 40503 + i * 2654435) % {J.SKETCH_PRIME - 1} AS a, (i * 1640531527 + 12345) % {J.SKETCH_PRIME} AS b FROM range(1, {_HASHES + 1}) t(i)),
    sk AS (SELECT ip, i, min((a * x + b) % {J.SKETCH_PRIME}) AS v FROM (SELECT ip, CAST('0x' || left(md5(peer), 7) AS BIGINT) AS x FROM nbw), fn GROUP BY 1, 2)"""


@on_site("z3_sketched_similarity", f"""WITH {_SKETCH}, mem AS (SELECT ip, device_type AS grp, vendor AS part FROM assw WHERE vendor IS NOT NULL)
    SELECT x.grp, x.part AS part_a, y.part AS part_b, round(count(*) FILTER (p.v = q.v) / CAST(count(*) AS DOUBLE), 6) AS similarity
    FROM mem x JOIN mem y ON x.grp = y.grp AND x.part < y.part JOIN sk p ON p.ip = x.ip JOIN sk q ON q.ip = y.ip AND q.i = p.i GROUP BY 1, 2, 3""", "wide")
def _(s):
    groups = s.assets.filter("vendor IS NOT NULL").select(F.col("device_type").alias("grp"), F.col("vendor").alias("part"), F.col("ip_address").alias("ip"))
    return J.sketched_group_similarity(groups, s.neighbors, _HASHES).withColumn("similarity", F.round("similarity", 6))


@on_site("z4_policy_groups", "SELECT group_name, coalesce(CAST(level AS VARCHAR), 'none') AS purdue_level, category, security_level, criticality, member_count FROM gt")
def _(s):
    return Z.group_table(s.groups).select(
        "group_name", F.coalesce(F.col("purdue_level").cast("string"), F.lit("none")).alias("purdue_level"), "category", "security_level", "criticality", "member_count"
    )


@on_site("z4_policy_group_members", "SELECT ip, group_name FROM gmw", "wide")
def _(s):
    return s.groups.select("ip", "group_name")


@on_site("z5_communities", "SELECT ip, community FROM cmw", "wide")
def _(s):
    loose = s.segment_inputs[0].filter("purdue_level IS NULL").select("ip")
    return J.communities(loose, s.neighbors)


@on_site("z6_baseline_zones", "SELECT zone, security_level, group_count, asset_count FROM zn")
def _(s):
    return s.zones.select("zone", "security_level", "group_count", "asset_count")


_SPLIT = """WITH RECURSIVE gz AS (SELECT m.ip, m.group_name, z.zone FROM gmw m JOIN zgw z USING (group_name)),
    ge AS (SELECT DISTINCT a.group_name AS x, b.group_name AS y FROM cnw c JOIN gz a ON a.ip = c.src_ip JOIN gz b ON b.ip = c.dst_ip WHERE a.zone = b.zone AND a.group_name <> b.group_name),
    gr AS (SELECT group_name AS g, group_name AS h FROM zgw UNION SELECT r.g, e.y FROM gr r JOIN (SELECT x, y FROM ge UNION SELECT y, x FROM ge) e ON e.x = r.h),
    gc AS (SELECT g, min(h) AS comp FROM gr GROUP BY g),
    gk AS (SELECT z.group_name, z.zone, z.member_count, dense_rank() OVER (PARTITION BY z.zone ORDER BY comp) AS r, count(DISTINCT comp) OVER (PARTITION BY z.zone) AS n FROM zgw z JOIN gc ON g = group_name)
    SELECT group_name, CASE WHEN n = 1 THEN zone WHEN r = 1 THEN zone || ' A' WHEN r = 2 THEN zone || ' B' ELSE zone || ' C' END AS zone, member_count FROM gk"""


@on_site("z7_split_subzones", _SPLIT, "wide")
def _(s):
    assigned = Z.zone_groups(Z.group_table(s.groups))
    return Z.split_subzones(assigned, s.groups, s.once("connections"), max_parts=3).select("group_name", "zone", "member_count")


@on_site("z7_split_subzones_all", _SPLIT.replace("WHEN r = 1 THEN zone || ' A' WHEN r = 2 THEN zone || ' B' ELSE zone || ' C' END", """ELSE zone || ' ' || chr(CAST(65 + (r - 1) % 26 AS INT))
        || CASE WHEN r > 26 THEN CAST((r - 1) // 26 AS VARCHAR) ELSE '' END END"""), "wide")
def _(s):
    assigned = Z.zone_groups(Z.group_table(s.groups))
    return Z.split_subzones(assigned, s.groups, s.once("connections")).select("group_name", "zone", "member_count")


@on_site("z8_dmz_zone", """SELECT z.group_name, CASE WHEN (SELECT count(*) FROM zg WHERE zone = 'DMZ Zone') = 0 AND z.group_name IN (SELECT group_name FROM gm JOIN pf USING (ip) WHERE is_ot AND any_it)
    THEN 'DMZ Zone' ELSE z.zone END AS zone FROM zg z""")
def _(s):
    return Z.dmz_zone(Z.zone_groups(Z.group_table(s.groups)), s.groups, s.segment_inputs[0]).select("group_name", "zone")


_CROSSL = "(SELECT count(*) FROM (SELECT DISTINCT src_ip, dst_ip FROM cnf) c JOIN gmf a ON a.ip = c.src_ip JOIN gmf b ON b.ip = c.dst_ip WHERE (a.level <= 1 AND b.level >= 4) OR (a.level >= 4 AND b.level <= 1))"


@on_site("z8_flat_zone", f"""SELECT CASE WHEN {_CROSSL} > 0 THEN 'CRITICAL' ELSE 'WARNING' END AS level, 'flat network: ' || max(n) || ' of ' || CAST(sum(n) AS BIGINT) || ' assets in one /24' AS recommendation
    FROM (SELECT count(*) AS n FROM abf GROUP BY substr(ip, 1, length(ip) - length(split_part(ip, '.', 4)))) HAVING max(n) * 100 // CAST(sum(n) AS BIGINT) > 80""", "flat")
def _(s):
    return Z.flat_zone(s.segment_inputs[0], s.groups, s.connections)


@on_site("z8_zone_recommendations", """SELECT 'CRITICAL' AS level, 'direct L1 to L4 traffic without a DMZ zone' AS recommendation WHERE (SELECT count(*) FROM zg WHERE zone LIKE '%DMZ%') = 0
    AND EXISTS (SELECT 1 FROM cn c JOIN gm a ON a.ip = c.src_ip JOIN gm b ON b.ip = c.dst_ip WHERE (a.level <= 1 AND b.level >= 4) OR (a.level >= 4 AND b.level <= 1))
    UNION ALL SELECT 'GAP', 'remote services found and no DMZ zone' WHERE (SELECT count(*) FROM zg WHERE zone LIKE '%DMZ%') = 0 AND EXISTS (SELECT 1 FROM pv)
    UNION ALL SELECT 'GAP', 'Purdue violations found: review risky conduits' WHERE EXISTS (SELECT 1 FROM pv)""")
def _(s):
    profiles, _ = s.segment_inputs
    return Z.zone_recommendations(Z.zone_groups(Z.group_table(s.groups)), s.groups, profiles, s.connections, s.violations)


_CR = """WITH zi AS (SELECT m.ip, z.zone FROM gm m JOIN zg z USING (group_name)), cz AS (SELECT least(a.zone, b.zone) AS zone_a, greatest(a.zone, b.zone) AS zone_b, o.protocol, o.dst_port,
    bool_or(a.zone < b.zone) AS f, bool_or(a.zone > b.zone) AS r, bool_or(o.w) AS w, bool_or(o.cfg) AS cfg, bool_or(t0886) AS t FROM ob o JOIN zi a ON a.ip = o.src_ip JOIN zi b ON b.ip = o.dst_ip
    WHERE a.zone <> b.zone GROUP BY 1, 2, 3, 4)"""
_CT = f"""{_CR}, cd AS (SELECT zone_a, zone_b, CASE WHEN bool_or(f) AND bool_or(r) THEN 'bidirectional' ELSE 'unidirectional' END AS direction, count(*) AS rule_count,
    coalesce(abs(any_value(x.low) - any_value(y.low)) > 2, FALSE) AS cross_purdue_risk FROM cz JOIN zn x ON x.zone = zone_a JOIN zn y ON y.zone = zone_b GROUP BY 1, 2)"""


def _conduit_rules(s):
    ip_zone = Z.zone_of_ip(s.groups, Z.zone_groups(Z.group_table(s.groups)))
    return Z.conduit_rules(ip_zone, s.segment_inputs[1])


@on_site("z9_conduit_rules", f"{_CR} SELECT zone_a, zone_b, protocol, dst_port, f AS forward, w AS has_write_ops, cfg AS has_config_ops, CASE WHEN t THEN 'T0886' ELSE '' END AS attack_techniques FROM cz")
def _(s):
    return _conduit_rules(s).select("zone_a", "zone_b", "protocol", "dst_port", "forward", "has_write_ops", "has_config_ops", joined("attack_techniques").alias("attack_techniques"))


@on_site("z9_conduits", f"{_CT} SELECT * FROM cd")
def _(s):
    return Z.conduits(s.zones, _conduit_rules(s))


@on_site("z10_zone_score", f"{_CT} SELECT round(1.0 - count(*) FILTER (WHERE cross_purdue_risk) / count(*), 6) AS zone_score FROM cd")
def _(s):
    return Z.zone_score(Z.conduits(s.zones, _conduit_rules(s))).withColumn("zone_score", F.round("zone_score", 6))


@on_site("z11_ip_to_zone", "SELECT ip, zone FROM iz")
def _(s):
    return s.ip_zone


@on_site("z12_communication_matrix", """SELECT src_zone, dst_zone, protocol, dst_port, packet_count, src_count, dst_count, risk, 'Observed ' || packet_count || ' packets, ' || protocol || '/' || dst_port || ' | ' ||
    src_count || ' sources, ' || dst_count || ' destinations | ' || CASE WHEN strftime(first_seen, '%Y-%m-%d') = strftime(last_seen, '%Y-%m-%d') THEN strftime(first_seen, '%Y-%m-%d')
    ELSE strftime(first_seen, '%Y-%m-%d') || ' to ' || strftime(last_seen, '%Y-%m-%d') END || CASE WHEN t0886 THEN '; techniques: T0886' ELSE '' END || '; pre-approved in allowlist' AS justification FROM mx""")
def _(s):
    return s.rules


@on_site("z13_matrix_coverage", """SELECT round(count(*) FILTER (WHERE src_zone <> dst_zone) * 100.0 / (count(*) FILTER (WHERE src_zone <> dst_zone) + count(*) FILTER (WHERE (src_zone IS NULL) <> (dst_zone IS NULL))), 6)
    AS coverage_percent FROM oz""")
def _(s):
    return Z.matrix_coverage(s.segment_inputs[1], s.ip_zone).withColumn("coverage_percent", F.round("coverage_percent", 6))


# A policy that keeps the busier half of the observed rules and opens one protocol wholly.


def policy(s):
    strict = s.rules.filter("packet_count >= 20").select("src_zone", "dst_zone", "protocol", "dst_port")
    opened = s.rules.filter("protocol = 'https'").select("src_zone", "dst_zone", "protocol", F.lit(None).cast("int").alias("dst_port")).distinct()
    return strict.union(opened)


_SIM = """WITH si AS (SELECT o.*, CASE WHEN src_zone IS NULL OR dst_zone IS NULL OR EXISTS (SELECT 1 FROM mx m WHERE m.src_zone = o.src_zone AND m.dst_zone = o.dst_zone AND m.protocol = o.protocol
    AND (m.protocol = 'https' OR (m.packet_count >= 20 AND m.dst_port = o.dst_port))) THEN 'allowed' WHEN is_periodic AND NOT w THEN 'false_positive_candidate' ELSE 'critical_block' END AS verdict FROM oz o)"""


def _sim(s):
    return Z.simulate_policy(s.segment_inputs[1], s.ip_zone, policy(s))


@on_site("z14_simulate_policy", f"""{_SIM} SELECT src_ip, src_port, dst_ip, dst_port, protocol, verdict, CASE WHEN verdict = 'allowed' THEN '' ELSE 'no rule allows ' || protocol || ':' || dst_port || ' from ' || src_zone || ' to ' ||
    dst_zone END AS reason FROM si""")
def _(s):
    return _sim(s).select("src_ip", "src_port", "dst_ip", "dst_port", "protocol", "verdict", F.coalesce("reason", F.lit("")).alias("reason"))


@on_site("z15_zone_block_summary", f"{_SIM} SELECT src_zone, dst_zone, count(*) AS blocked_count FROM si WHERE verdict <> 'allowed' GROUP BY 1, 2")
def _(s):
    return Z.zone_block_summary(_sim(s))


@on_site("z15_simulation_totals", f"""{_SIM} SELECT count(*) FILTER (WHERE verdict = 'allowed') AS allowed, count(*) FILTER (WHERE verdict <> 'allowed') AS blocked,
    round(count(*) FILTER (WHERE verdict <> 'allowed') * 100.0 / count(*), 6) AS blocked_percent, count(*) FILTER (WHERE verdict = 'false_positive_candidate') AS false_positive_candidates FROM si""")
def _(s):
    return Z.simulation_totals(_sim(s)).withColumn("blocked_percent", F.round("blocked_percent", 6))


def narrow_policy(s):
    return s.rules.filter("src_zone = 'Enterprise Zone'").select("src_zone", "dst_zone", "protocol", "dst_port")


@on_site("z16_risk_reduction", """SELECT round(coalesce(sum(CASE WHEN NOT open THEN r END), 0) / sum(r), 6) AS risk_reduction FROM (SELECT v.x, v.y, CASE severity WHEN 'medium' THEN 2 ELSE 1 END AS r,
    coalesce(bool_or(i.zone = 'Enterprise Zone' AND EXISTS (SELECT 1 FROM mx WHERE src_zone = 'Enterprise Zone')), FALSE) AS open
    FROM pv v JOIN iz i ON i.ip IN (v.x, v.y) GROUP BY v.x, v.y, severity)""")
def _(s):
    return Z.risk_reduction(s.violations, s.ip_zone, narrow_policy(s)).withColumn("risk_reduction", F.round("risk_reduction", 6))


@on_site("z16_deployment_score", """SELECT round(CAST(sum(CASE WHEN zone = 'Enterprise Zone' OR zone IN (SELECT dst_zone FROM mx WHERE src_zone = 'Enterprise Zone') THEN CAST(substr(security_level, 3) AS INT) ELSE 0 END) AS BIGINT)
    / CAST(sum(CAST(substr(security_level, 3) AS INT)) AS BIGINT), 6) AS deployment_score FROM zn""")
def _(s):
    return Z.deployment_score(s.zones, narrow_policy(s)).withColumn("deployment_score", F.round("deployment_score", 6))


_T = "CASE WHEN dst_port IN (47808, 34962, 34963, 34964, 2222, 161, 162, 69, 123, 514) OR protocol IN ('bacnet', 'profinet', 'snmp', 'dns') THEN 'udp' ELSE 'tcp' END"
_UP = "upper(regexp_replace({0}, '[^0-9A-Za-z]', '_', 'g'))"
_N = f"CASE WHEN length({_UP}) <= 28 THEN {_UP} ELSE substr({_UP}, 1, 19) || '_' || upper(substr(sha256({{0}}), 1, 8)) END"


def _enforce(fmt: str, line: str, source: str = "mx", keys: str = "src_zone, dst_zone, protocol, dst_port"):
    on_site(f"z17_enforcement_{fmt}", f"SELECT {keys}, {line} AS line FROM {source}")(
        lambda s: Z.enforcement_rules(s.rules, s.zones, fmt)
    )


_enforce("router_acl", f"'permit ' || {_T} || ' any any eq ' || dst_port")
_OBJ = "CASE WHEN {0}.asset_count > 3 THEN 'object-group OBJ-' || " + _N.format("m.{1}") + " ELSE 'any' END"
_enforce("firewall_acl", f"'access-list ACL-' || {_N.format('src_zone')} || '-TO-' || {_N.format('dst_zone')} || ' extended permit ' || {_T} || ' ' || {_OBJ.format('x', 'src_zone')} || ' ' || {_OBJ.format('y', 'dst_zone')} || ' eq ' || dst_port",
         "mx m JOIN zn x ON x.zone = m.src_zone JOIN zn y ON y.zone = m.dst_zone")
_enforce("ids", f"""'pass ' || {_T} || ' any any -> any ' || dst_port || ' (msg:"ALLOW: ' || protocol || '/' || dst_port || ' ' || src_zone || ' to ' || dst_zone || ' [' || risk || ']"; sid:' ||
    (9000000 + row_number() OVER (ORDER BY src_zone, dst_zone, protocol, dst_port)) || '; rev:1;)'""")


_REMARKS = """SELECT m.src_zone, m.dst_zone, m.protocol, m.dst_port, string_agg(DISTINCT v.vendor || ': ' || n.note, '; ' ORDER BY v.vendor || ': ' || n.note) AS vendor_context FROM mx m
    JOIN (SELECT DISTINCT zone, vendor FROM pf JOIN iz USING (ip) WHERE vendor IS NOT NULL) v ON v.zone IN (m.src_zone, m.dst_zone)
    JOIN (VALUES ('siemens', 102, 'S7comm PLC communication'), ('siemens', 443, 'SCALANCE web management'), ('siemens', 34962, 'PROFINET IO'), ('rockwell', 44818, 'EtherNet/IP explicit messaging'),
    ('rockwell', 2222, 'EtherNet/IP I/O')) n(word, port, note) ON n.port = m.dst_port AND contains(lower(v.vendor), n.word) GROUP BY 1, 2, 3, 4"""


_WHY = """'Observed ' || packet_count || ' packets, ' || protocol || '/' || dst_port || ' | ' || src_count || ' sources, ' || dst_count || ' destinations | '
    || strftime(first_seen, '%Y-%m-%d') || CASE WHEN strftime(first_seen, '%Y-%m-%d') <> strftime(last_seen, '%Y-%m-%d') THEN ' to ' || strftime(last_seen, '%Y-%m-%d') ELSE '' END
    || CASE WHEN t0886 THEN '; techniques: T0886' ELSE '' END || '; pre-approved in allowlist'"""
#: Rules with their justification and vendor notes.
_MXV = f"SELECT *, {_WHY} AS why, coalesce(vendor_context, '') AS note FROM mx LEFT JOIN ({_REMARKS}) USING (src_zone, dst_zone, protocol, dst_port)"
_TABLE_LINE = f"""concat_ws(chr(9), 'ALLOW', src_zone, 'any', dst_zone, 'any', {_T}, CAST(dst_port AS VARCHAR), '→', risk, why || CASE WHEN note = '' THEN '' ELSE ' [' || note || ']' END)"""
_JSON_LINE = """CAST(json_object('src_zone', src_zone, 'dst_zone', dst_zone, 'protocol', protocol, 'dst_port', dst_port, 'risk', risk, 'packet_count', packet_count,
    'justification', why, 'vendor_context', note) AS VARCHAR)"""
_IDS_LINE = f"""'pass ' || {_T} || ' any any -> any ' || dst_port || ' (msg:"ALLOW: ' || protocol || '/' || dst_port || ' ' || src_zone || ' to ' || dst_zone || ' [' || risk || ']'
    || CASE WHEN note = '' THEN '' ELSE ' (' || note || ')' END || '"; sid:' || (9000000 + row_number() OVER (ORDER BY src_zone, dst_zone, protocol, dst_port)) || '; rev:1;)'"""


@on_site("z17_enforcement_table", f"SELECT src_zone, dst_zone, protocol, dst_port, {_TABLE_LINE} AS line FROM ({_MXV})")
def _(s):
    return Z.enforcement_rules(s.rules, s.zones, "table", zone_vendors(s))


@on_site("z17_table_columns", f"""SELECT src_zone, dst_zone, protocol, dst_port, concat_ws(chr(9), 'ALLOW', src_zone, 'any', dst_zone, 'any', {_T}, CAST(dst_port AS VARCHAR), '→', risk) AS lead,
    CASE WHEN vendor_context IS NULL THEN '' ELSE '[' || vendor_context || ']' END AS note, 10 AS n_columns
    FROM mx LEFT JOIN ({_REMARKS}) USING (src_zone, dst_zone, protocol, dst_port)""")
def _(s):
    rows = Z.enforcement_rules(s.rules, s.zones, "table", zone_vendors(s))
    return rows.select(
        "src_zone", "dst_zone", "protocol", "dst_port", F.substring_index("line", "\t", 9).alias("lead"),
        F.regexp_extract("line", r"\[[^\]]*\]$", 0).alias("note"), F.size(F.split("line", "\t")).alias("n_columns"),
    )


@on_site("z17_enforcement_json", f"SELECT src_zone, dst_zone, protocol, dst_port, {_JSON_LINE} AS line FROM ({_MXV})")
def _(s):
    return Z.enforcement_rules(s.rules, s.zones, "json", zone_vendors(s))


def zone_vendors(s):
    profiles, _ = s.segment_inputs
    return profiles.filter("vendor IS NOT NULL").join(s.ip_zone, "ip").select("zone", "vendor").distinct()


@on_site("z17_vendor_remarks", _REMARKS)
def _(s):
    return Z.vendor_remarks(s.rules, zone_vendors(s))


@on_site("z17_enforcement_denies", "SELECT DISTINCT src_zone, dst_zone, 'deny ip any any log' AS line FROM mx")
def _(s):
    return Z.enforcement_denies(s.rules, "router_acl")


@on_site("z17_enforcement_denies_all", """SELECT 'firewall_acl' AS format, src_zone, dst_zone, 'access-list ACL-' || %s || '-TO-' || %s || ' extended deny ip any any log' AS line
    FROM (SELECT DISTINCT src_zone, dst_zone FROM mx) UNION ALL SELECT 'table', '*', '*', concat_ws(chr(9), 'DENY', '*', '*', '*', '*', '*', '*', '*', '—', 'Default deny')
    UNION ALL SELECT 'ids', '*', '*', 'drop ip any any -> any any (msg:"DENY: default deny"; sid:' || (9000001 + count(*)) || '; rev:1;)' FROM mx
    UNION ALL SELECT 'json', '*', '*', '{"default_action":"deny"}'""" % (_N.format("src_zone"), _N.format("dst_zone")))
def _(s):
    parts = [Z.enforcement_denies(s.rules, f).select(F.lit(f).alias("format"), "src_zone", "dst_zone", "line") for f in ("firewall_acl", "table", "ids", "json")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _notes(fmt: str) -> str:
    return " UNION ALL ".join(f"SELECT 0, '', '', 0, 0, '', {n}, 0, '{line.replace(chr(39), chr(39) * 2)}'" for n, line in enumerate(Y.NOTES[fmt]))


_ACL = f"'ACL-' || {_N.format('src_zone')} || '-TO-' || {_N.format('dst_zone')}"
_AT = "2, src_zone, dst_zone, 0, 2, protocol, dst_port"
_RISK = "'[' || risk || '] ' || why"
_PAIRS = "(SELECT DISTINCT src_zone, dst_zone FROM mx)"
_IPN = "(CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT))"
_BIG = "(SELECT zone, asset_count FROM zn WHERE asset_count > 3 AND zone IN (SELECT src_zone FROM mx UNION SELECT dst_zone FROM mx))"
_FW_LINE = f"""'access-list ' || {_ACL.replace('src_zone', 'm.src_zone').replace('dst_zone', 'm.dst_zone')} || ' extended permit ' || {_T} || ' ' || {_OBJ.format('x', 'src_zone')} || ' ' || {_OBJ.format('y', 'dst_zone')} || ' eq ' || dst_port"""
_LEVELS = ", ".join(f"('{name}', {list(levels)}::INTEGER[])" for _, name, _, levels in C.ZONES)


def _json_list(section: int, place: str, text: str, source: str) -> str:
    """Elements of a list, all but the first behind a comma."""
    return f"SELECT {section}, {place}, CASE WHEN row_number() OVER (ORDER BY {place}) = 1 THEN '' ELSE ',' END || {text} FROM {source}"


_DOCUMENTS = {
    "router_acl": [
        f"SELECT 2, src_zone, dst_zone, 0, 0, '', 0, 0, 'ip access-list extended ' || {_ACL} FROM {_PAIRS}", f"SELECT 2, src_zone, dst_zone, 0, 1, '', 0, 0, ' remark ' || src_zone || ' to ' || dst_zone FROM {_PAIRS}",
        f"SELECT {_AT}, 0, ' remark ' || note FROM rv WHERE note <> ''", f"SELECT {_AT}, 1, ' remark ' || {_RISK} FROM rv", f"SELECT {_AT}, 2, ' permit ' || {_T} || ' any any eq ' || dst_port FROM rv",
        f"SELECT 2, src_zone, dst_zone, 0, 3, '', 0, 0, ' deny ip any any log' FROM {_PAIRS}",
    ],
    "firewall_acl": [
        f"SELECT 1, zone, '', -3, 0, '', 0, 0, 'object-group network OBJ-' || {_N.format('zone')} FROM {_BIG}", f"SELECT 1, zone, '', -2, 0, '', 0, 0, ' description ' || zone || ' (' || asset_count || ' assets)' FROM {_BIG}",
        f"SELECT 1, zone, '', {_IPN} >> 8, 0, '', {_IPN} % 256, 0, ' network-object host ' || ip FROM iz WHERE zone IN (SELECT zone FROM {_BIG})",
        f"SELECT 2, src_zone, dst_zone, 0, 1, '', 0, 0, '! Zone pair: ' || src_zone || ' to ' || dst_zone FROM {_PAIRS}", f"SELECT {_AT}, 0, '! ' || note FROM rv WHERE note <> ''",
        f"SELECT {_AT}, 1, 'access-list ' || {_ACL} || ' remark ' || {_RISK} FROM rv", f"SELECT {_AT}, 2, {_FW_LINE} FROM rv m JOIN zn x ON x.zone = m.src_zone JOIN zn y ON y.zone = m.dst_zone",
        f"SELECT 2, src_zone, dst_zone, 0, 3, '', 0, 0, 'access-list ' || {_ACL} || ' extended deny ip any any log' FROM {_PAIRS}",
    ],
    "table": [f"SELECT {_AT}, 2, {_TABLE_LINE} FROM rv", "SELECT 3, '', '', 0, 0, '', 0, 0, concat_ws(chr(9), 'DENY', '*', '*', '*', '*', '*', '*', '*', '—', 'Default deny')"],
    "ids": [
        f"SELECT 2, src_zone, dst_zone, 0, 1, '', 0, 0, '# ' || src_zone || ' to ' || dst_zone FROM {_PAIRS}", f"SELECT {_AT}, 2, {_IDS_LINE} FROM rv",
        """SELECT 3, '', '', 0, 0, '', 0, 0, 'drop ip any any -> any any (msg:"DENY: default deny"; sid:' || (9000001 + count(*)) || '; rev:1;)' FROM rv""",
    ],
    "json": [
        """SELECT 0, '', '', 0, 0, '', 0, 0, '{"metadata":{"format":"json"},"zones":['""", """SELECT 2, '', '', 0, 0, '', 0, 0, '],"conduits":['""", """SELECT 4, '', '', 0, 0, '', 0, 0, '],"rules":['""",
        """SELECT 6, '', '', 0, 0, '', 0, 0, '],"default_action":"deny"}'""",
        _json_list(1, "zone, '', 0, 0, '', 0, 0", "CAST(json_object('name', zone, 'purdue_levels', levels, 'asset_count', asset_count, 'security_level', security_level) AS VARCHAR)", f"zn JOIN (VALUES {_LEVELS}) v(zone, levels) USING (zone)"),
        _json_list(3, "zone_a, zone_b, 0, 0, '', 0, 0", "CAST(json_object('zone_a', zone_a, 'zone_b', zone_b, 'direction', direction, 'rule_count', rule_count, 'cross_purdue_risk', cross_purdue_risk) AS VARCHAR)", "cd"),
        _json_list(5, "src_zone, dst_zone, 0, 0, protocol, dst_port, 0", _JSON_LINE, "rv"),
    ],
}


def _document_query(fmt: str) -> None:
    rows = " UNION ALL ".join([*([_notes(fmt)] if fmt in Y.NOTES else []), *_DOCUMENTS[fmt]])
    sql = f"{_CT}, rv AS ({_MXV}), doc(section, k1, k2, b, a, p, q, j, line) AS ({rows}) SELECT row_number() OVER (ORDER BY section, k1, k2, b, a, p, q, j) AS line_no, line FROM doc"

    @on_site(f"z17_document_{fmt}", sql)
    def _(s):
        conduits = Z.conduits(s.zones, _conduit_rules(s)) if fmt == "json" else None
        return Y.policy_document(s.rules, s.zones, s.ip_zone, fmt, conduits, zone_vendors(s))


for _fmt in _DOCUMENTS:
    _document_query(_fmt)
