"""Topology as node and edge tables: build, cap, slice, group, infer structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import columns as X
from ..functions.scale import stage
from .packets import _ensure_protocol

EDGE_KEY = ["src_ip", "dst_ip", "protocol"]


def topo_nodes(packets: DataFrame) -> DataFrame:
    ends = F.explode(
        F.array(
            F.struct(F.col("src_ip").alias("ip"), F.col("src_mac").alias("mac")),
            F.struct(F.col("dst_ip").alias("ip"), F.col("dst_mac").alias("mac")),
        )
    )
    order = F.when(F.col("end.mac").isNotNull(), F.struct("ts", "seq"))
    return (
        _ensure_protocol(packets)
        .select("ts", "seq", "protocol", ends.alias("end"))
        .groupBy(F.col("end.ip").alias("ip_address"))
        .agg(
            F.min_by("end.mac", order).alias("mac_address"),
            F.array_sort(F.collect_set("protocol")).alias("protocols"),
            F.count("*").alias("packet_count"),
        )
        .withColumn("subnet", X.subnet24(F.col("ip_address")))
    )


def topo_edges(packets: DataFrame) -> DataFrame:
    """Directed totals per protocol; bidirectional if the other direction exists.

    Both directions meet in one group of the unordered pair, so the reverse lookup
    needs no self-join.
    """
    low, high = F.least("src_ip", "dst_ip"), F.greatest("src_ip", "dst_ip")
    forward = F.col("src_ip") == F.col("_low")
    pairs = (
        _ensure_protocol(packets)
        .select("src_ip", "protocol", "length", low.alias("_low"), high.alias("_high"))
        .groupBy("_low", "_high", "protocol")
        .agg(
            F.count_if(forward).alias("_np"), F.sum(F.when(forward, F.col("length"))).alias("_nb"),
            F.count_if(~forward).alias("_rp"), F.sum(F.when(~forward, F.col("length"))).alias("_rb"),
        )
    )

    def edge(src: str, dst: str, packets_: str, bytes_: str) -> Column:
        return F.when(
            F.col(packets_) > 0,
            F.struct(
                F.col(src).alias("src_ip"), F.col(dst).alias("dst_ip"),
                F.col(packets_).alias("packet_count"), F.col(bytes_).alias("byte_count"),
            ),
        )

    both = (F.col("_np") > 0) & (F.col("_rp") > 0)
    sides = F.array_compact(F.array(edge("_low", "_high", "_np", "_nb"), edge("_high", "_low", "_rp", "_rb")))
    return pairs.select("protocol", both.alias("bidirectional"), F.explode(sides).alias("e")).select(
        "e.src_ip", "e.dst_ip", "protocol", "e.packet_count", "e.byte_count", "bidirectional"
    )


def _both_ends_in(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose two ends are in ``ids`` (column ip_address)."""
    a, b = ids.select(F.col("ip_address").alias("src_ip")), ids.select(F.col("ip_address").alias("dst_ip"))
    return edges.join(a, "src_ip", "left_semi").join(b, "dst_ip", "left_semi")


def cap_topology(
    nodes: DataFrame, edges: DataFrame, n: int | None = None, e: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Busiest ``n`` nodes and the busiest ``e`` edges among them, for display; None: all of them."""
    top, kept = nodes, edges
    if n is not None:
        top = nodes.orderBy(F.desc("packet_count"), "ip_address").limit(n)
        kept = _both_ends_in(edges, top.select("ip_address"))
    return top, kept if e is None else kept.orderBy(F.desc("packet_count"), *EDGE_KEY).limit(e)


def neighbor_subgraph(
    nodes: DataFrame, edges: DataFrame, target: str, depth: int = 2
) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``depth`` undirected hops of ``target`` and the edges among them."""
    spark = nodes.sparkSession
    adjacent = stage(
        edges.select("src_ip", "dst_ip")
        .union(edges.select("dst_ip", "src_ip"))
        .toDF("a", "b").filter("a <> b").distinct(),
        "adjacency",
    )
    seen = spark.createDataFrame([(target,)], "ip_address string")
    frontier = seen
    for _ in range(depth):
        reached = (
            adjacent.join(frontier, adjacent.a == frontier.ip_address, "left_semi")
            .select(F.col("b").alias("ip_address")).distinct()
        )
        frontier = stage(reached.join(seen, "ip_address", "left_anti"), "frontier")
        seen = stage(seen.union(frontier), "seen")
    return nodes.join(seen, "ip_address", "left_semi"), _both_ends_in(edges, seen)


def hide_nodes(nodes: DataFrame, edges: DataFrame, hidden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop hidden nodes (column ip_address) and edges that touch them."""
    gone = hidden.select("ip_address").distinct()
    kept = edges.join(gone.withColumnRenamed("ip_address", "src_ip"), "src_ip", "left_anti").join(
        gone.withColumnRenamed("ip_address", "dst_ip"), "dst_ip", "left_anti"
    )
    return nodes.join(gone, "ip_address", "left_anti"), kept


def primary_protocol(protocols: Column) -> Column:
    ot = F.filter(protocols, lambda p: X.is_ot(p))
    return F.coalesce(F.get(ot, F.lit(0)), F.get(protocols, F.lit(0)), F.lit("unknown"))


def group_nodes(nodes: DataFrame, mode: str) -> DataFrame:
    """Node count and packets per ``subnet``, ``protocol``, ``device_role`` or ``vendor``."""
    key = {
        "subnet": lambda: F.col("subnet"),
        "protocol": lambda: primary_protocol(F.col("protocols")),
        "device_role": lambda: F.col("device_type"),
        "vendor": lambda: F.coalesce("vendor", F.lit("Unknown")),
    }[mode]()
    return nodes.groupBy(F.concat(F.lit("group:"), key).alias("group_id")).agg(
        F.count("*").alias("node_count"), F.sum("packet_count").alias("packet_count")
    )


def mesh_edges(
    nodes: DataFrame, edges: DataFrame, protocol: str | None = None, min_packets: int = 0
) -> tuple[DataFrame, DataFrame]:
    if protocol is not None:
        edges = edges.filter(F.col("protocol") == protocol)
    if min_packets > 0:
        edges = edges.filter(F.col("packet_count") >= min_packets)
    used = edges.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip_address")).distinct()
    return nodes.join(used, "ip_address", "left_semi"), edges


def edge_weight(packets: Column, low: float = 1.0, high: float = 8.0) -> Column:
    share = F.least(F.log2(packets) / 20.0, F.lit(1.0))
    return F.when(packets <= 1, F.lit(low)).otherwise(F.lit(low) + share * F.lit(high - low))


def purdue_band(level: Column) -> Column:
    """Display row of a level, 0 (top, also unknown) to 6."""
    return (
        F.when(level.isNull() | (level >= 5), 0).when(level >= 4, 1).when(level >= 3, 3)
        .when(level >= 2, 4).when(level >= 1, 5).otherwise(6)
    )


# --- structure inferred from addresses ------------------------------------------


def _cross_links(conns: DataFrame) -> DataFrame:
    """Per end of a connection between two /24s: ip and the other end's prefix."""
    a, b = X.prefix24(F.col("src_ip")), X.prefix24(F.col("dst_ip"))
    ends = F.explode(
        F.array(
            F.struct(F.col("src_ip").alias("ip_address"), b.alias("remote")),
            F.struct(F.col("dst_ip").alias("ip_address"), a.alias("remote")),
        )
    )
    return conns.filter(a != b).select(ends.alias("e")).select("e.*")


def infer_subnets(conns: DataFrame, assets: DataFrame) -> DataFrame:
    """/24 groups of all addresses with their gateway.

    A /24 has at most 256 IPv4 members, so the member list is bounded.
    """
    crossing = X.prefix24(F.col("src_ip")) != X.prefix24(F.col("dst_ip"))
    seen = conns.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip_address"), crossing.alias("crosses"))
    hosts = (
        seen.union(assets.select("ip_address", F.lit(False)))
        .groupBy(X.prefix24(F.col("ip_address")).alias("prefix"), "ip_address")
        .agg(F.bool_or("crosses").alias("crosses"))
    )
    last = F.substring_index("ip_address", ".", -1)
    first, final = last == "1", last == "254"
    priority = (
        F.when(first & F.col("crosses"), 1).when(final & F.col("crosses"), 2).when(first, 3).when(final, 4)
        .when(F.col("crosses"), 5)
    )
    return (
        hosts.groupBy("prefix")
        .agg(
            F.array_sort(F.collect_list("ip_address")).alias("member_ips"),
            F.min_by("ip_address", F.when(priority.isNotNull(), F.struct(priority, "ip_address"))).alias("gateway_ip"),
        )
        .select(F.concat("prefix", F.lit(".0/24")).alias("network"), "member_ips", "gateway_ip")
    )


def gateway_subnets(conns: DataFrame) -> DataFrame:
    """Remote /24 of every address that talks across subnets, one row per pair."""
    return (
        _cross_links(conns).distinct()
        .select("ip_address", F.concat("remote", F.lit(".0/24")).alias("subnet"))
    )


def detect_gateways(conns: DataFrame, assets: DataFrame) -> DataFrame:
    """Addresses that talk to other /24s: number of remote subnets and confidence."""
    counted = _cross_links(conns).groupBy("ip_address").agg(F.countDistinct("remote").alias("subnet_count"))
    last = F.substring_index("ip_address", ".", -1).isin("1", "254")
    many = F.col("subnet_count") >= 2
    macs = assets.select("ip_address", "mac_address")
    return counted.join(macs, "ip_address", "left").withColumn(
        "confidence", F.when(last & many, 3).when(last | many, 2).otherwise(1)
    )


def switch_candidates(conns: DataFrame, assets: DataFrame) -> DataFrame:
    """Addresses with more than five peers in their own /24 (peers at most 255)."""
    same = X.prefix24(F.col("src_ip")) == X.prefix24(F.col("dst_ip"))
    ends = F.explode(
        F.array(
            F.struct(F.col("src_ip").alias("ip_address"), F.col("dst_ip").alias("peer")),
            F.struct(F.col("dst_ip").alias("ip_address"), F.col("src_ip").alias("peer")),
        )
    )
    found = (
        conns.filter(same).select(ends.alias("e")).select("e.*")
        .groupBy("ip_address").agg(F.array_sort(F.collect_set("peer")).alias("connected_ips"))
        .filter(F.size("connected_ips") > 5)
    )
    return found.join(assets.select("ip_address", "mac_address"), "ip_address", "left").withColumn(
        "confidence", F.when(F.size("connected_ips") > 10, 2).otherwise(1)
    )


def broadcast_domains(subnets: DataFrame) -> DataFrame:
    source = F.when(F.col("gateway_ip").isNotNull(), "gateway").otherwise("subnet")
    return subnets.select(
        F.concat(F.lit("bd-"), "network").alias("id"), "network", "member_ips", "gateway_ip",
        source.alias("inferred_from"),
    )


# --- switch tables -----------------------------------------------------------------


def apply_mac_table(ports: DataFrame, mac_table: DataFrame) -> DataFrame:
    """Attach learnt MACs and VLANs to ports, by long or short port name.

    ``ports``: switch, port, short_name; ``mac_table``: switch, port, mac_address,
    vlan. One row per (switch, port, mac, vlan); the long name wins over the short.
    """
    names = ports.select(
        "switch", F.col("port").alias("port_name"),
        F.explode(F.array(F.struct(F.lit(0).alias("pref"), F.col("port").alias("name")),
                          F.struct(F.lit(1).alias("pref"), F.col("short_name").alias("name")))).alias("n"),
    ).select("switch", "port_name", "n.pref", "n.name")
    by_name = names.groupBy("switch", "name").agg(F.min_by("port_name", F.struct("pref", "port_name")).alias("port"))
    learnt = mac_table.select(
        "switch", F.col("port").alias("name"), X.normalize_mac(F.col("mac_address")).alias("mac_address"), "vlan"
    )
    return learnt.join(by_name, ["switch", "name"]).select("switch", "port", "mac_address", "vlan").distinct()


def device_locations(port_macs: DataFrame, arp_table: DataFrame) -> DataFrame:
    """Place addresses on ports through ARP: ip → MAC → (switch, port, vlan); the
    smallest (switch, port) wins when a MAC shows up on several ports."""
    place = (
        port_macs.withColumn("mac_address", X.normalize_mac(F.col("mac_address")))
        .groupBy("mac_address")
        .agg(F.min(F.struct("switch", "port", F.coalesce("vlan", F.lit(1)).alias("vlan"))).alias("p"))
        .select("mac_address", "p.*")
    )
    return (
        arp_table.select("ip_address", X.normalize_mac(F.col("mac_address")).alias("mac_address"))
        .join(place, "mac_address")
        .groupBy("ip_address")
        .agg(F.min(F.struct("switch", "port", "vlan", "mac_address")).alias("p"))
        .select("ip_address", "p.mac_address", "p.switch", "p.port", "p.vlan")
    )


def switch_links(ports: DataFrame, neighbors: DataFrame) -> DataFrame:
    """Neighbour rows (switch, port, device_id, remote_port) on known ports as links."""
    long_name = ports.select("switch", F.col("port").alias("name"), "port")
    short_name = ports.select("switch", F.col("short_name").alias("name"), "port")
    by_name = long_name.union(short_name).groupBy("switch", "name").agg(F.min("port").alias("src_port"))
    return (
        neighbors.withColumnRenamed("port", "name").join(by_name, ["switch", "name"])
        .select(
            F.col("switch").alias("src_switch"), "src_port", F.col("device_id").alias("dst_switch"),
            F.col("remote_port").alias("dst_port"),
        )
        .distinct()
    )
