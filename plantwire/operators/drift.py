"""Baseline comparison, alert correlation, and merging of external data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions.scale import top_n_per_key

FLOW = ["src_ip", "dst_ip", "dst_port", "protocol"]


def _change_array(old: str, new: str) -> Column:
    """Changed fields between two asset structs, as (field, old, new)."""

    def plain(side: str, name: str, missing: str = "") -> Column:
        return F.coalesce(F.col(f"{side}.{name}").cast("string"), F.lit(missing))

    def protocols(side: str) -> Column:
        return F.array_join(F.array_sort(f"{side}.protocols"), ", ")

    fields = [
        ("device_type", plain(old, "device_type"), plain(new, "device_type")),
        ("vendor", plain(old, "vendor"), plain(new, "vendor")),
        ("confidence", plain(old, "confidence"), plain(new, "confidence")),
        ("protocols", protocols(old), protocols(new)),
        ("hostname", plain(old, "hostname"), plain(new, "hostname")),
        ("purdue_level", plain(old, "purdue_level", "none"), plain(new, "purdue_level", "none")),
    ]
    return F.array_compact(
        F.array(
            *[
                F.when(a != b, F.struct(F.lit(n).alias("field"), a.alias("old_value"), b.alias("new_value")))
                for n, a, b in fields
            ]
        )
    )


_COMPARED = ["device_type", "vendor", "confidence", "protocols", "hostname", "purdue_level", "mac_address"]


def _side(assets: DataFrame, name: str) -> DataFrame:
    return assets.select("ip_address", F.struct(*_COMPARED).alias(name))


def drift_assets(base: DataFrame, current: DataFrame) -> DataFrame:
    """New, missing and changed assets with the values that describe them."""
    both = _side(base, "b").join(_side(current, "c"), "ip_address", "full")
    status = (
        F.when(F.col("b").isNull(), "new").when(F.col("c").isNull(), "missing")
        .when(F.size(_change_array("b", "c")) > 0, "changed")
    )
    shown = F.coalesce("c", "b")
    return both.select("ip_address", status.alias("status"), shown.alias("s")).filter("status IS NOT NULL").select(
        "ip_address", "status", "s.device_type", "s.vendor", "s.protocols", "s.confidence"
    )


def asset_changes(base: DataFrame, current: DataFrame) -> DataFrame:
    both = _side(base, "b").join(_side(current, "c"), "ip_address")
    return both.select("ip_address", F.explode(_change_array("b", "c")).alias("f")).select("ip_address", "f.*")


def drift_connections(base: DataFrame, current: DataFrame) -> DataFrame:
    """Flows seen on one side only."""
    marked = base.select(*FLOW, F.lit(True).alias("in_base")).union(current.select(*FLOW, F.lit(False)))
    seen = marked.groupBy(*FLOW).agg(F.bool_or("in_base").alias("b"), F.bool_or(~F.col("in_base")).alias("c"))
    return seen.filter("NOT (b AND c)").select(*FLOW, F.when(F.col("c"), "new").otherwise("missing").alias("status"))


def _connection_changes(base: DataFrame, current: DataFrame) -> DataFrame:
    """Connection rows (not flows) whose flow is on one side only, counted per side."""
    marked = base.select(*FLOW, F.lit(True).alias("in_base")).union(current.select(*FLOW, F.lit(False)))
    seen = marked.groupBy(*FLOW).agg(
        F.count_if("in_base").alias("b"), F.count_if(~F.col("in_base")).alias("c")
    )
    return seen.agg(
        F.coalesce(F.sum(F.when(F.col("b") == 0, F.col("c"))), F.lit(0)).alias("new_connections"),
        F.coalesce(F.sum(F.when(F.col("c") == 0, F.col("b"))), F.lit(0)).alias("missing_connections"),
        F.count_if(F.col("b") > 0).alias("base_flows"), F.count_if(F.col("c") > 0).alias("current_flows"),
    )


def drift_summary(
    base_assets: DataFrame, current_assets: DataFrame, base_conns: DataFrame, current_conns: DataFrame
) -> DataFrame:
    drift = drift_assets(base_assets, current_assets).agg(
        F.count_if(F.col("status") == "new").alias("new_assets"),
        F.count_if(F.col("status") == "missing").alias("missing_assets"),
        F.count_if(F.col("status") == "changed").alias("changed_assets"),
    )
    flows = _connection_changes(base_conns, current_conns)
    out = (
        drift.withColumn("baseline_assets", base_assets.agg(F.count("*")).scalar())
        .withColumn("current_assets", current_assets.agg(F.count("*")).scalar())
        .withColumns({n: flows.select(n).scalar() for n in flows.columns})
    )
    changes = sum((F.col(c) for c in ("missing_assets", "changed_assets", "new_connections", "missing_connections")),
                  F.col("new_assets"))
    items = F.greatest("baseline_assets", "current_assets") + F.greatest("base_flows", "current_flows")
    score = F.when(items > 0, F.least(changes / items, F.lit(1.0))).otherwise(F.lit(0.0))
    return out.withColumn("drift_score", score).drop("base_flows", "current_flows")


def correlate_alerts(alerts: DataFrame, assets: DataFrame, ip: str | None = None) -> DataFrame:
    """Alerts with the devices at both ends; most severe first, then latest."""
    if ip is not None:
        alerts = alerts.filter((F.col("src_ip") == ip) | (F.col("dst_ip") == ip))

    def end(prefix: str) -> DataFrame:
        return assets.select(
            F.col("ip_address").alias(f"{prefix}_ip"), F.col("hostname").alias(f"{prefix}_hostname"),
            F.col("device_type").alias(f"{prefix}_device_type"), F.col("purdue_level").alias(f"{prefix}_purdue_level"),
        )

    return (
        alerts.join(end("src"), "src_ip", "left").join(end("dst"), "dst_ip", "left")
        .orderBy(F.asc("severity"), F.desc("timestamp"))
    )


def log_type(protocol: Column, port: Column) -> Column:
    name = F.lower(protocol)
    return (
        F.when(name.isin("modbus", "dnp3", "s7comm"), name).when(port == 53, "dns")
        .when(port.isin(80, 443, 8080, 8443), "http").otherwise("conn")
    )


def _device_events(conns: DataFrame) -> DataFrame:
    zeek = conns.filter(F.exists("origin_files", lambda f: f.contains("Zeek")))
    ends = F.explode(
        F.array(
            F.struct(F.col("src_ip").alias("device_ip"), F.col("dst_ip").alias("peer_ip")),
            F.struct(F.col("dst_ip").alias("device_ip"), F.col("src_ip").alias("peer_ip")),
        )
    )
    return zeek.withColumn("log_type", log_type(F.col("protocol"), F.col("dst_port"))).withColumn("e", ends).select(
        "e.device_ip", "e.peer_ip", "log_type", "first_seen", "transport", "src_ip", "src_port", "dst_ip", "dst_port",
        "packet_count",
    )


def zeek_device_events(conns: DataFrame, alerts: DataFrame) -> DataFrame:
    """Log counts, distinct peers and alerts per device."""
    kind = F.col("log_type")
    counts = _device_events(conns).groupBy("device_ip").agg(
        F.count_if(kind == "modbus").alias("modbus_events"), F.count_if(kind == "dnp3").alias("dnp3_events"),
        F.count_if(kind == "dns").alias("dns_queries"), F.count_if(kind == "http").alias("http_requests"),
        F.count_if(kind.isin("conn", "s7comm")).alias("conn_log_entries"),
        F.countDistinct("peer_ip").alias("unique_peers"),
    )
    warned = (
        alerts.select(F.explode(F.array("src_ip", "dst_ip")).alias("device_ip"))
        .groupBy("device_ip").agg(F.count("*").alias("alert_count"))
    )
    return counts.join(warned, "device_ip", "left").withColumn(
        "alert_count", F.coalesce("alert_count", F.lit(0).cast("bigint"))
    )


def zeek_event_samples(conns: DataFrame, samples: int) -> DataFrame:
    """First ``samples`` log rows per device, for display."""
    order = [F.col(c) for c in ("first_seen", "src_ip", "src_port", "dst_ip", "dst_port")]
    rows = top_n_per_key(_device_events(conns), ["device_ip"], order, samples)
    summary = F.format_string(
        "%s %s:%d -> %s:%d (%d pkts)", F.upper("transport"), "src_ip", "src_port", "dst_ip", "dst_port", "packet_count"
    )
    return rows.select("device_ip", "rank", F.col("first_seen").alias("timestamp"), "log_type", "peer_ip",
                       summary.alias("summary"))


# --- merging -----------------------------------------------------------------------------


def dedup_ingested_assets(rows: DataFrame) -> DataFrame:
    """One row per address: all protocols, one entry per port, first known names."""
    ports = (
        rows.select("ip_address", F.explode("open_ports").alias("p"))
        .groupBy("ip_address", "p.port").agg(F.min("p").alias("p"))
        .groupBy("ip_address").agg(F.array_sort(F.collect_list("p")).alias("open_ports"))
    )
    names = rows.select("ip_address", F.explode_outer("protocols").alias("proto"), "mac_address", "hostname",
                        "device_type", "vendor", "os_info", "source", "is_active")
    merged = names.groupBy("ip_address").agg(
        F.array_sort(F.collect_set("proto")).alias("protocols"),
        *[F.min(c).alias(c) for c in ("mac_address", "hostname", "device_type", "vendor", "os_info", "source")],
        F.bool_or("is_active").alias("is_active"),
    )
    return merged.join(ports, "ip_address", "left")


def merge_assets(assets: DataFrame, ingested: DataFrame) -> DataFrame:
    """Enrich known assets from an import and insert the others.

    ``ingested`` has one row per address (see dedup_ingested_assets).
    """
    i = ingested.select(
        "ip_address", F.lit(True).alias("_in"), F.col("protocols").alias("_p"), F.col("hostname").alias("_h"),
        F.col("vendor").alias("_v"), F.col("os_info").alias("_os"), F.col("source").alias("_src"),
        F.coalesce("is_active", F.lit(False)).alias("_act"), F.col("device_type").alias("_t"),
        F.col("mac_address").alias("_m"),
    )
    empty = F.array().cast("array<string>")
    note = F.when(
        F.col("_os").isNotNull(),
        F.concat(F.when(F.col("_act"), "[scan]").otherwise("[passive]"), F.lit(" OS: "), F.col("_os")),
    )
    old = F.coalesce("notes", F.lit(""))
    notes = (
        F.when(note.isNull() | F.coalesce(old.contains(note), F.lit(False)), old)
        .when(old == "", note).otherwise(F.concat(old, F.lit("; "), note))
    )
    tags = F.when(
        F.col("_in"),
        F.array_union(
            F.array(F.concat(F.lit("["), F.col("_src"), F.lit("]"))),
            F.when(F.col("_act"), F.array(F.lit("[active-scan]"))).otherwise(empty),
        ),
    ).otherwise(empty)
    return assets.join(i, "ip_address", "full").select(
        "ip_address",
        F.coalesce("mac_address", "_m").alias("mac_address"),
        F.coalesce("hostname", "_h").alias("hostname"),
        F.coalesce("device_type", "_t", F.lit("unknown")).alias("device_type"),
        F.coalesce("vendor", "_v").alias("vendor"),
        F.array_union(F.coalesce("protocols", empty), F.coalesce("_p", empty)).alias("protocols"),
        notes.alias("notes"),
        F.array_union(F.coalesce("tags", empty), tags).alias("tags"),
        F.coalesce("packet_count", F.lit(0).cast("bigint")).alias("packet_count"),
        "purdue_level",
        F.coalesce("is_public_ip", X.is_public_ip(F.col("ip_address"))).alias("is_public_ip"),
    )


def merge_connections(existing: DataFrame, ingested: DataFrame) -> DataFrame:
    """Add imported totals to the same 4-tuple, or insert it.

    An existing row keeps its protocol, transport and times; the import adds counts. Where
    ``existing`` has the array origin_files, the import adds its source tag to it;
    ``merge_connection_files`` keeps origins as rows.
    """
    rest = ["protocol", "transport", "first_seen", "last_seen"]
    files = ["origin_files"] if "origin_files" in existing.columns else []
    a = existing.select(*_TUPLE, *rest, "packet_count", "byte_count", *files, F.lit(0).alias("_late"))
    b = ingested.select(
        *_TUPLE, *rest, "packet_count", "byte_count", *[F.array(_tag()).alias(c) for c in files], F.lit(1).alias("_late"),
    )
    both = a.unionByName(b)
    lead = F.min(F.struct("_late", *rest)).alias("_r")
    totals = both.groupBy(*_TUPLE).agg(
        lead, F.sum("packet_count").alias("packet_count"), F.sum("byte_count").alias("byte_count"),
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in files],
    )
    return totals.select(*_TUPLE, *[f"_r.{c}" for c in rest], "packet_count", "byte_count", *files)


_TUPLE = ["src_ip", "src_port", "dst_ip", "dst_port"]


def _tag() -> Column:
    return F.concat(F.lit("["), F.col("source"), F.lit("]"))


def merge_connection_files(existing: DataFrame, ingested: DataFrame) -> DataFrame:
    """Origins of merged connections, one row each: the 4-tuple and origin_file.

    ``existing``: output of ``connection_files``; ``ingested``: imported connections, whose
    origin is the tag of their source.
    """
    a = existing.select(*_TUPLE, "origin_file")
    return a.union(ingested.filter("source IS NOT NULL").select(*_TUPLE, _tag())).distinct()


_EDITABLE = ["device_type", "hostname", "notes", "purdue_level", "tags"]


def _latest_edit(edits: DataFrame) -> DataFrame:
    """Last non-null value per field and address."""
    at = F.col("edited_at")
    return edits.groupBy("ip_address").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_{c}") for c in _EDITABLE], F.max("edited_at").alias("_at")
    )


def apply_overrides(assets: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply user edits (single or bulk); a level outside 0–5 clears the level."""
    rows = assets.join(_latest_edit(edits), "ip_address", "left")
    level = F.when(F.col("_purdue_level").isNull(), F.col("purdue_level")).when(
        F.col("_purdue_level").between(0, 5), F.col("_purdue_level")
    )
    plain = {c: F.coalesce(f"_{c}", c) for c in _EDITABLE if c != "purdue_level"}
    return rows.withColumns({**plain, "purdue_level": level}).drop(*[f"_{c}" for c in _EDITABLE], "_at")


def asset_history(edits: DataFrame, assets: DataFrame) -> DataFrame:
    """One row per field that an edit changes: ip_address, field, old, new, changed_at."""
    rows = assets.join(_latest_edit(edits), "ip_address")

    def shown(c: str) -> Column:
        text = F.array_join(c, ", ") if c.endswith("tags") else F.col(c).cast("string")
        return F.coalesce(text, F.lit(""))

    pairs = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"_{c}").isNotNull() & (shown(c) != shown(f"_{c}")),
                    F.struct(F.lit(c).alias("field"), shown(c).alias("old_value"), shown(f"_{c}").alias("new_value")),
                )
                for c in _EDITABLE
            ]
        )
    )
    return rows.select("ip_address", F.explode(pairs).alias("f"), F.col("_at").alias("changed_at")).select(
        "ip_address", "f.*", "changed_at"
    )


def timeline_filter(conns: DataFrame, position: float) -> DataFrame:
    """Connections that had begun at a replay position between 0 and 1."""
    span = conns.agg(F.min("first_seen").alias("a"), F.max("last_seen").alias("z"))
    start, end = X.micros(F.col("a")), X.micros(F.col("z"))
    cutoff = span.select((start + F.floor(F.lit(float(position)) * (end - start))).cast("bigint")).scalar()
    return conns.filter(X.micros(F.col("first_seen")) <= cutoff)
