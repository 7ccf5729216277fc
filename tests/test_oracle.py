"""Registered queries against their SQL at the smallest scale."""

import oracle
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [
    "p3_decode_modbus", "p12_best_signature_matches", "a1_connections", "a5_build_assets", "a9_protocol_stats", "a16_connection_stats",
    "d16_device_protocol_info", "g2_topo_edges", "f12_t0822_external_remote", "f34_purdue_assign", "e4_match_cves", "b4_drift_summary",
    "s1_read_zeek", "s1_zeek_assets", "s2_suricata_alerts", "l1_live_connections",
    "l2_live_alerts", "l3_live_stats", "a1_connection_files", "s9_read_arp_table_juniper", "z3_sketched_similarity", "x2_stix_objects", "f40_run_full_analysis",
]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    ok, note = oracle.compare(spark, oracle.connect(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note
