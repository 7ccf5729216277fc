"""Streams: one alert per connection over restarts, exact counters per interval."""

import datetime as dt
import os

from pyspark.sql import functions as F

from plantwire import schemas
from plantwire.streaming import live

T0 = dt.datetime(2024, 1, 1)
OT = "10.0.0.2"


def write(spark, folder, seconds, sport=40000, dport=22, src="10.0.0.1", dst=OT):
    rows = [{"seq": n, "ts": T0 + dt.timedelta(seconds=t), "src_ip": src, "dst_ip": dst, "transport": "tcp", "src_port": sport, "dst_port": dport, "length": 60} for n, t in enumerate(seconds)]
    spark.createDataFrame(rows, schemas.PACKETS).coalesce(1).write.mode("append").parquet(folder)


def test_a_connection_alerts_once_over_pauses_and_restarts(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("packets", "alerts", "checkpoint"))
    ot = spark.createDataFrame([(OT,)], "ip_address string")

    def run():
        return live.live_alerts(spark.readStream.schema(schemas.PACKETS).parquet(folder), ot, out, checkpoint)

    write(spark, folder, [5, 1, 9])
    write(spark, folder, [3], dport=9999)
    assert [r.ts for r in run().collect()] == [T0 + dt.timedelta(seconds=1)]
    # days later the same connection goes on and another one, from the device's side, begins
    write(spark, folder, [300_000, 400_000])
    write(spark, folder, [300_001], src=OT, dst="10.0.0.9", sport=443, dport=50001)
    alerts = sorted((r.technique_id, r.src_ip, r.src_port, r.ot_ip) for r in run().collect())
    assert alerts == [("T0868", "10.0.0.1", 40000, OT), ("T0885", OT, 443, OT)]
    # the last batch runs again, as after a failure before its commit
    commits = os.path.join(checkpoint, "commits")
    last = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
    for name in (last, f".{last}.crc"):
        os.remove(os.path.join(commits, name))
    assert sorted((r.technique_id, r.src_ip, r.src_port, r.ot_ip) for r in run().collect()) == alerts


def test_counters_are_exact(spark, tmp_path):
    folder = str(tmp_path / "packets")
    write(spark, folder, [0, 1, 2, 3599], sport=1)
    write(spark, folder, [10, 20], sport=2, src="10.0.0.7", dst="10.0.0.7")
    write(spark, folder, [3600, 3601], sport=3)
    write(spark, folder, [100_000], sport=4)
    stats = live.live_stats(spark.readStream.schema(schemas.PACKETS).parquet(folder), "1 hour")
    got = live.run_available(stats, "append").select("packets", "bytes", "active_connections", "assets", F.round("packets_per_sec", 9).alias("rate")).collect()
    assert sorted(map(tuple, got)) == [(2, 120, 1, 2, round(2 / 3600, 9)), (6, 360, 2, 3, round(6 / 3600, 9))]
