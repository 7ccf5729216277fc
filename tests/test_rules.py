"""Branches of rules that the derived traffic does not reach, one by one and in the run of few passes."""

import datetime as dt

import pytest

from plantwire.operators import attack_rules as R
from plantwire.operators import full_run
from plantwire.operators.findings import Snapshot

T0 = dt.datetime(2024, 1, 1)
CONNECTION = "src_ip string, src_port int, dst_ip string, dst_port int, protocol string, packet_count bigint, src_mac string, dst_mac string"
ASSET = "ip_address string, mac_address string, device_type string, is_public_ip boolean, protocols array<string>, purdue_level int"
DEVICE = (
    "ip string, modbus struct<role: string, write_count: bigint, read_count: bigint, diagnostic_count: bigint, master_code_count: bigint, unit_ids: array<int>>, "
    "dnp3 struct<role: string, has_unsolicited: boolean, master_code_count: bigint>, "
    "ethernet_ip struct<role: string, cip_writes_to_assembly: boolean, cip_file_access: boolean, list_identity_requests: boolean>, "
    "s7comm struct<role: string, functions_seen: array<string>>, bacnet struct<role: string, write_to_output: boolean, write_to_notification_class: boolean, "
    "reinitialize_device: boolean, device_communication_control: boolean>, iec104 struct<role: string, has_control_commands: boolean, has_reset_process: boolean, "
    "has_interrogation: boolean>, profinet struct<role: string>"
)
PEER = "ip string, remote_ip string, remote_role string, packet_count bigint"
POLLING = "ip string, remote_ip string, function_code int, unit_id int, avg_interval_ms double, min_interval_ms double, max_interval_ms double, sample_count bigint"


def snapshot(spark, conns=(), assets=(), devices=(), modbus=(), dnp3=()):
    frame = spark.createDataFrame
    return Snapshot(
        assets=frame(list(assets), ASSET), connections=frame([(*c, "aa", "bb") for c in conns], CONNECTION),
        devices=frame([(ip, m, d, None, None, None, None, None) for ip, m, d in devices], DEVICE),
        modbus_peers=frame([(*p, 1) for p in modbus], PEER), dnp3_peers=frame([(*p, 1) for p in dnp3], PEER), polling=frame([], POLLING),
    )


def seen(spark, *rows):
    return spark.createDataFrame([(ip, T0, T0 + dt.timedelta(seconds=s)) for ip, s in rows], "ip_address string, first_seen timestamp, last_seen timestamp")


def titles(spark, s, *sights, **options):
    """Titles of the run in few passes; it must be empty where nothing is wrong."""
    return sorted(r.title for r in full_run.run_in_few_passes(s, seen(spark, *sights), **options)["findings"].collect())


def test_unsolicited_responses_without_any_known_master(spark):
    s = snapshot(spark, devices=[("10.0.0.5", None, ("outstation", True, 0))])
    want = ["DNP3 unsolicited response with no known masters: 10.0.0.5"]
    assert [r.title for r in R.t0856_dnp3_unsolicited(s).collect()] == want == titles(spark, s)


@pytest.mark.parametrize("tls,severity", [(1, "high"), (40, "medium"), (900, "low")])
def test_share_of_clear_text(spark, tls, severity):
    s = snapshot(spark, conns=[("10.0.0.1", 5000, "10.0.0.2", 502, "modbus", 100), ("10.0.0.1", 5000, "10.0.0.2", 4843, "opc_ua", tls)])
    for found in (R.cleartext_ot(s.connections), full_run.run_in_few_passes(s, seen(spark))["findings"].filter("title LIKE '%unencrypted'")):
        row = found.collect()
        assert [(r.severity, r.evidence) for r in row] == [(severity, f"100 of {100 + tls} packets in clear; modbus: 100")]


def test_collection_without_read_data_counts_connections(spark):
    conns = [("10.0.0.1", 5000, f"10.0.1.{i}", 502, "modbus", 1) for i in range(12)]
    master = ("master", 0, 5, 0, 0, [1])
    s = snapshot(spark, conns=conns, devices=[("10.0.0.1", master, None)], modbus=[("10.0.0.1", f"10.0.1.{i}", "slave") for i in range(12)])
    want = "Automated collection: 10.0.0.1 connecting to 12 OT devices"
    assert [r.title for r in R.t0802_automated_collection(s).collect()] == [want] and want in titles(spark, s)


def test_one_scanner_with_most_flows(spark):
    conns = [("10.9.9.9", 5000 + i % 7, f"10.{i // 200}.0.{i % 200}", (502, 20000, 102)[i % 3], "modbus", 1) for i in range(3000)]
    s = snapshot(spark, conns=conns)
    by_rule = {r.technique_id: r for r in R.t0846_remote_discovery(s).unionByName(R.t0801_monitor_state(s)).collect()}
    found = full_run.run_in_few_passes(s, seen(spark))["findings"]
    mine = {r.technique_id: r for r in found.filter("technique_id IN ('T0846', 'T0801')").collect()}
    assert by_rule["T0846"].title == mine["T0846"].title == "Unknown device 10.9.9.9 polling 3000 PLCs/RTUs"
    assert by_rule["T0801"].evidence == mine["T0801"].evidence == "3000 distinct OT endpoints"


def test_empty_tables_find_nothing(spark):
    assert titles(spark, snapshot(spark)) == []
