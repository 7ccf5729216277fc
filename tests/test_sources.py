from plantwire.sources import logs

MODBUS = "#path\tmodbus\n#fields\tid.resp_p\tid.resp_h\tid.orig_p\tid.orig_h\tts\tfunc\n502\t10.0.0.2\t40000\t10.0.0.1\t1.5\tREAD\n"
CONN = (
    "#path\tconn\n#path\tconn\n#fields\tts\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\tservice\torig_pkts\tresp_pkts\torig_bytes\n"
    "2.5\t10.0.0.1\t40000\t10.0.0.3\t20000\tudp\t(empty)\t7\t-\t90\n3.5\t10.0.0.1\t40000\t-\t20000\tudp\t-\t1\t1\t1\n4.5\t10.0.0.9\n"
)


def read(spark, folder, **kinds):
    rows = logs.read_zeek(spark, str(folder), **kinds).collect()
    return sorted((r.src_ip, r.src_port, r.dst_ip, r.dst_port, r.protocol, r.transport, r.packet_count, r.byte_count) for r in rows)


def test_zeek_files_keep_their_own_kind_and_columns(spark, tmp_path):
    (tmp_path / "day").mkdir()
    for name, text in [("modbus.log", MODBUS), ("conn.log", CONN), ("day/headless.log", "1\t2\t3\n"), ("empty.log", "")]:
        (tmp_path / name).write_text(text)
    modbus = ("10.0.0.1", 40000, "10.0.0.2", 502, "modbus", "tcp", 1, 0)
    assert read(spark, tmp_path) == [modbus, ("10.0.0.1", 40000, "10.0.0.3", 20000, "dnp3", "udp", 7, 90)]
    assert read(spark, tmp_path / "modbus.log", kind="dnp3") == [(*modbus[:4], "dnp3", "tcp", 1, 0)]
    assets = logs.assets_of(logs.read_zeek(spark, str(tmp_path))).collect()
    assert {r.ip_address: r.protocols for r in assets} == {"10.0.0.1": ["dnp3", "modbus"], "10.0.0.2": ["modbus"], "10.0.0.3": ["dnp3"]}


def test_zeek_without_rows(spark, tmp_path):
    (tmp_path / "empty.log").write_text("")
    assert read(spark, tmp_path) == []
