import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantwire.functions import columns as X
from plantwire.functions.scale import connected_components, gap_statistics, global_rank, measured_slices, top_n_per_key
from plantwire.operators import packets as P
from plantwire.operators import patterns, similarity

PACKET = (
    "seq bigint, ts timestamp, src_mac string, dst_mac string, src_ip string, dst_ip string, transport string, src_port int, "
    "dst_port int, length bigint, payload binary, origin_file string"
)
T0 = dt.datetime(2024, 1, 1)


def packet(seq, ms, payload=b"", sport=49152, dport=502, src="10.0.0.1", dst="10.0.0.2"):
    return (seq, T0 + dt.timedelta(milliseconds=ms), "aa", "bb", src, dst, "tcp", sport, dport, 60, payload, "f")


def test_modbus_request(spark):
    df = spark.createDataFrame([packet(1, 0, bytes.fromhex("00010000000601030000000A"))], PACKET)
    row = P.decode_modbus(df).first()
    assert (row.transaction_id, row.unit_id, row.function_code, row.role) == (1, 1, 3, "master")
    assert (row.reg_start, row.reg_count, row.reg_type) == (0, 10, "holding_register")


def test_short_payload_is_no_frame(spark):
    df = spark.createDataFrame([packet(1, 0, b"\x00\x01"), packet(2, 0, b"")], PACKET)
    assert P.decode_modbus(df).count() == 0 and P.messages(df).count() == 0


@pytest.mark.parametrize("ip,public", [
    ("10.1.1.1", False), ("172.16.0.1", False), ("172.32.0.1", True), ("192.168.1.1", False), ("100.64.0.1", False), ("8.8.8.8", True),
    ("224.0.0.1", False), ("fe80::1", False), ("2001:4860::8888", True), ("not an ip", False), ("300.1.1.1", False)])
def test_public_ip(spark, ip, public):
    assert spark.createDataFrame([(ip,)], "ip string").select(X.is_public_ip(F.col("ip"))).first()[0] is public


def stats_of(spark, times, slice_rows=600):
    df = spark.createDataFrame([packet(i, t) for i, t in enumerate(times)], PACKET)
    return patterns.connection_stats(P.identify_protocol(df), slice_rows)


def test_periodic_and_one_off(spark):
    assert stats_of(spark, [i * 1000 for i in range(10)]).first().is_periodic
    single = stats_of(spark, [0])
    assert [r.anomaly_type for r in patterns.pattern_anomalies(single).collect()] == ["one_off"]


def test_high_frequency_and_burst(spark):
    fast = patterns.pattern_anomalies(stats_of(spark, [i * 5 for i in range(200)])).collect()
    assert [r.anomaly_type for r in fast] == ["high_frequency"]
    burst = patterns.pattern_anomalies(stats_of(spark, [i * 1000 for i in range(12)] + [500_000])).collect()
    assert {r.anomaly_type for r in burst} == {"irregular_polling", "burst"}


@pytest.mark.parametrize("width", [1, 7, 600])
def test_slices_do_not_change_gaps(spark, width):
    times = [0, 3, 3, 900, 1500, 40_000, 41_000, 99_999]
    row = stats_of(spark, times, width).first()
    gaps = [b - a for a, b in zip(times, times[1:])]
    mean = sum(gaps) / len(gaps)
    assert row.packet_count == len(times) and row.min_interval_ms == 0 and row.max_interval_ms == max(gaps)
    assert abs(row.avg_interval_ms - mean) < 1e-6
    assert abs(row.std_interval_ms - (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5) < 1e-6


def test_top_n_of_a_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4990, "hot").otherwise("cold").alias("k"), "id")
    rows = top_n_per_key(df, ["k"], [F.col("id")], 7).collect()
    assert sorted(r.id for r in rows if r.k == "hot") == list(range(7))
    assert sorted(r.rank for r in rows if r.k == "cold") == list(range(1, 8))


def test_global_rank(spark):
    df = spark.range(300).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), (F.col("id") % 3).alias("g"))
    rows = global_rank(df, F.col("g"), "id").select("g", "id", "rank").collect()
    assert [r.rank for r in sorted(rows, key=lambda r: (r.g, r.id))] == list(range(1, 301))


def test_components(spark):
    nodes = spark.createDataFrame([(str(i),) for i in range(6)], "id string")
    edges = spark.createDataFrame([("1", "0"), ("1", "2"), ("4", "5")], "src string, dst string")
    got = {r.id: r.component for r in connected_components(nodes, edges).collect()}
    assert got == {"0": "0", "1": "0", "2": "0", "3": "3", "4": "4", "5": "4"}


def _jaccard(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


@pytest.mark.parametrize("hot", [0, 2, 100])
def test_group_similarity_equals_brute_force(spark, hot):
    sets = {f"d{i}": {f"p{j}" for j in range(8) if (i * 7 + j * j) % 3 == 0 or j == i % 4} | {"hub"} for i in range(12)}
    parts = {d: "abc"[i % 3] for i, d in enumerate(sets)}
    long = spark.createDataFrame([(d, p) for d, ps in sets.items() for p in ps], "ip string, peer string")
    groups = spark.createDataFrame([("g", parts[d], d) for d in sets], "grp string, part string, ip string")
    got = {(r.part_a, r.part_b): r.similarity for r in similarity.average_group_similarity(groups, long, hot).collect()}
    for x, y in itertools.combinations("abc", 2):
        values = [_jaccard(sets[a], sets[b]) for a in sets for b in sets if parts[a] == x and parts[b] == y]
        assert abs(got[(x, y)] - sum(values) / len(values)) < 1e-9


def _random_sets(n, peers, seed):
    draw = random.Random(seed)
    return {f"d{i:04}": set(draw.sample([f"p{j}" for j in range(peers)], draw.randint(peers // 3, peers - 2))) for i in range(n)}


def test_group_similarity_block_by_block(spark):
    sets = _random_sets(240, 14, 5) | {"e0": set(), "e1": set()}
    parts = {d: "aaaaaaaabbbcdef"[i % 15] for i, d in enumerate(sets)} | {"e0": "a", "e1": "b"}
    long = spark.createDataFrame([(d, p) for d, ps in sets.items() for p in ps], "ip string, peer string")
    groups = spark.createDataFrame([("g", parts[d], d) for d in sets] + [("h", "a", "d0001"), ("h", "b", "d0002"), ("h", None, "d0003"), (None, "a", "d0004")], "grp string, part string, ip string")
    got = {(r.grp, r.part_a, r.part_b): r.similarity for r in similarity.average_group_similarity(groups, long, 3, block=16).collect()}
    assert abs(got.pop(("h", "a", "b")) - _jaccard(sets["d0001"], sets["d0002"])) < 1e-9
    assert set(got) == {("g", *p) for p in itertools.combinations("abcdef", 2)}
    for x, y in itertools.combinations("abcdef", 2):
        values = [_jaccard(sets[a], sets[b]) for a in sets for b in sets if parts[a] == x and parts[b] == y]
        assert abs(got["g", x, y] - sum(values) / len(values)) < 1e-9


def test_common_counts_of_frequent_and_rare_values():
    draw = random.Random(3)
    a, b = ([np.array(sorted(draw.sample(range(9000), draw.choice((0, 3, 4000)))), dtype=np.int64) for _ in range(n)] for n in (50, 40))
    assert similarity.common_counts(a, b).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]


def test_sketched_similarity_within_its_error(spark):
    sets = {f"d{i}": {f"p{(i % 5) * 7 + j}" for j in range(6 + i % 9)} | ({"hub"} if i % 2 else set()) for i in range(90)}
    sets |= {"e0": set(), "e1": set(), "e2": set()}
    parts = {d: "abc"[i % 3] for i, d in enumerate(sets)}
    long = spark.createDataFrame([(d, p) for d, ps in sets.items() for p in ps], "ip string, peer string")
    groups = spark.createDataFrame([("g", parts[d], d) for d in sets] + [("h", "a", "e0"), ("h", "b", "e1"), ("h", "c", "d0")], "grp string, part string, ip string")
    hashes = 400
    got = {(r.grp, r.part_a, r.part_b): r.similarity for r in similarity.sketched_group_similarity(groups, long, hashes).collect()}
    assert [got["h", *k] for k in ("ab", "ac", "bc")] == [1.0, 0.0, 0.0]
    for x, y in itertools.combinations("abc", 2):
        values = [_jaccard(sets[a], sets[b]) for a in sets for b in sets if parts[a] == x and parts[b] == y]
        assert abs(got["g", x, y] - sum(values) / len(values)) < 3 * 0.5 / hashes**0.5


def test_a_hub_shared_by_all_makes_no_pairs(spark):
    n = 1200
    rows = [(f"d{i}", "hub") for i in range(n)] + [(f"d{i}", f"p{i}-{j}") for i in range(n) for j in range(1 + i % 3)]
    rows += [(f"s{i}", p) for i in range(40) for p in ("hub", "q1", "q2", "q3", f"r{i % 4}")]
    sets = spark.createDataFrame(rows, "ip string, peer string")
    ips = sets.select("ip").distinct()
    found = similarity.candidate_pairs(ips, sets, 0.6, crowd=50).collect()
    # equal sets are one, so four classes of s remain, each named after its smallest member
    assert {(r.a, r.b) for r in found} == set(itertools.combinations(["s0", "s1", "s10", "s11"], 2))


@pytest.mark.parametrize("crowd", [2, 1000])
def test_similar_pairs_of_crowded_peers(spark, crowd):
    sets = {f"d{i:02}": {f"p{j}" for j in range(12) if (i * i + j * 5) % 7 < 4} | {f"x{i % 6}"} for i in range(60)}
    long = spark.createDataFrame([(d, p) for d, ps in sets.items() for p in ps], "ip string, peer string")
    got = {(r.a, r.b) for r in similarity.similar_pairs(long.select("ip").distinct(), long, crowd=crowd).collect()}
    lead = {}
    for d in sorted(sets):
        lead.setdefault(frozenset(sets[d]), d)
    assert got == {(a, b) for a, b in itertools.combinations(sorted(lead.values()), 2) if _jaccard(sets[a], sets[b]) > 0.6}


@pytest.mark.parametrize("crowd,block", [(2, 8), (20, 1024)])
def test_similar_links_make_the_same_communities(spark, crowd, block):
    sets = _random_sets(150, 16, 9) | {f"s{i}": {f"q{i}", f"q{i + 1}", f"r{i // 9}"} for i in range(40)} | {f"t{i}": {f"q{i}"} for i in range(3)}
    long = spark.createDataFrame([(d, p) for d, ps in sets.items() for p in ps] + [("d0000", None)], "ip string, peer string")
    ips = long.select("ip").distinct()
    pairs, links = similarity.similar_pairs(ips, long), similarity.similar_links(ips, long, crowd=crowd, block=block)
    assert {tuple(sorted(r)) for r in links.collect()} <= {tuple(r[:2]) for r in pairs.collect()}
    nodes = ips.withColumnRenamed("ip", "id")
    parts = [{r.id: r.component for r in connected_components(nodes, e.toDF("src", "dst")).collect()} for e in (pairs.select("a", "b"), links)]
    assert parts[0] == parts[1] and len(set(parts[0].values())) < len(sets)


def test_alike_sets_make_fewer_links_than_pairs(spark, monkeypatch):
    sets = _random_sets(600, 30, 2)
    sets = {d: s | {f"p{j}" for j in range(20)} for d, s in sets.items()}
    long = spark.createDataFrame([(d, p) for d, ps in sets.items() for p in ps], "ip string, peer string")
    n, seen = len({frozenset(s) for s in sets.values()}), []
    monkeypatch.setattr(similarity, "connected_components", lambda nodes, edges: seen.append(edges.count()) or connected_components(nodes, edges))
    found = similarity.communities(long.select("ip").distinct(), long).collect()
    assert len(found) == 600 and {r.community for r in found} == {"d0000"}
    assert n > 300 and seen[0] < 4 * n


def test_similar_pairs_find_all(spark):
    sets = {f"d{i}": {f"p{j}" for j in range(10) if (i + j) % 4 and (i * j) % 7 != 3} for i in range(10)}
    long = spark.createDataFrame([(d, p) for d, ps in sets.items() for p in ps], "ip string, peer string")
    ips = spark.createDataFrame([(d,) for d in sets], "ip string")
    got = {(r.a, r.b) for r in similarity.similar_pairs(ips, long).collect()}
    lead = {}
    for d in sorted(sets):
        lead.setdefault(frozenset(sets[d]), d)
    want = {(a, b) for a, b in itertools.combinations(sorted(lead.values()), 2) if _jaccard(sets[a], sets[b]) > 0.6}
    assert got == want


def test_crowded_slices_are_split_down_to_equal_times(spark):
    crowd = [(i * 37) % 1_000_000 for i in range(6000)] + [500_000] * 900 + [2_000_000 + i for i in range(300)]
    rows = [("hot", t) for t in crowd] + [("cold", 10**9 * i) for i in range(40)] + [(None, 5), (None, 9)]
    df = spark.createDataFrame(rows, "k string, t bigint").repartition(6)
    limit = 256
    cut = measured_slices(df, ["k"], "t", limit)
    assert cut.columns == ["k", "t", "_bits", "_slice"] and cut.count() == len(rows)
    sizes = cut.groupBy("k", "_bits", "_slice").agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("z")).collect()
    assert all(r.n <= limit if r._bits >= 0 else r.a == r.z for r in sizes)
    assert sum(r.n > limit for r in sizes) == 1 and sum(r.k == "hot" for r in sizes) > 20
    ordered = sorted((r.a, r.z) for r in sizes if r.k == "hot")
    assert all(z < a for (_, z), (a, _) in zip(ordered, ordered[1:]))
    # the windows of the hot key run in several tasks
    tasks = cut.filter("k = 'hot'").repartition(8, "k", "_bits", "_slice").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 4 and max(r["count"] for r in tasks) < len(crowd) / 2
    for keep in (None, lambda gap: gap > 0):
        got = {r.k: r for r in gap_statistics(df, ["k"], F.col("t"), keep=keep, slice_rows=limit).collect()}
        for k in ("hot", "cold", None):
            times = sorted(t for name, t in rows if name == k)
            gaps = [b - a for a, b in zip(times, times[1:]) if keep is None or b > a]
            r, mean = got[k], sum(gaps) / len(gaps)
            assert (r.n, r.first_us, r.last_us) == (len(times), times[0], times[-1])
            assert (r.gap_n, r.gap_sum, r.gap_min, r.gap_max) == (len(gaps), sum(gaps), min(gaps), max(gaps))
            assert abs(r.gap_m2 - sum((g - mean) ** 2 for g in gaps)) <= 1e-9 * max(1.0, r.gap_m2)


def test_segmentation_reads_packets_once(spark, tmp_path, monkeypatch):
    from plantwire.plans import site as sites

    rows = [(i, T0 + dt.timedelta(seconds=i), i % 24, ("view", "click", "purchase", "error")[i % 4], 1.0 * i, f'{{"k": {i % 100}}}') for i in range(400)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    written = {}
    stage = sites.stage
    monkeypatch.setattr(sites, "stage", lambda df, name: written.setdefault(name, df.inputFiles()) and stage(df, name))
    members = sites.Site(spark, str(tmp_path), "wide").groups
    assert members.count() > 0
    of_packets = {name for name, files in written.items() if any("/packets-wide" in f for f in files)}
    assert of_packets == {"connections", "assets", "devices", "stats"}
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535"
