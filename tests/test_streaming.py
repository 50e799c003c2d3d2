import json

import pytest
from pyspark.sql import functions as F

from tallyweir.functions.keys import canon_numeric
from tallyweir.operators.sessions import udp_sessions_wheel
from tallyweir.policies import catalog
from tallyweir.policies.engine import Settings, flows_of
from tallyweir.schema import KEY
from tallyweir.streaming import jobs
from tests.test_policies import PACKET, frame, trace


@pytest.fixture
def stream(spark, tmp_path):
    rows = trace(11, 400)
    batches = frame(spark, rows).orderBy("pkt_no").coalesce(1)
    for i in range(3):
        batches.where(f"pkt_no >= {150 * i} and pkt_no < {150 * (i + 1)}").write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    return rows, spark.readStream.schema(PACKET).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*")), tmp_path


def finish(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_first_come_keeps_its_state(spark, stream):
    rows, packets, _ = stream
    settings = Settings(buckets=4, cap=7, idle=10)
    got = sorted((tuple(r[k] for k in KEY), r["count"], r.wins, r.end_reason) for r in finish(jobs.first_come(packets, settings), "first_come").collect())
    whole = flows_of(catalog.run(frame(spark, rows), "fcfs", settings)).where("end_reason <> 'eof'").collect()
    assert got == sorted((tuple(r[k] for k in KEY), r["count"], r.wins, r.end_reason) for r in whole)


def test_sessions_end_when_the_clock_passes(spark, stream):
    rows, packets, _ = stream
    got = finish(jobs.udp_sessions(packets.where("proto = 17"), 10, 7), "sessions")
    batch = udp_sessions_wheel(canon_numeric(frame(spark, rows).where("proto = 17")), 10).groupBy(*KEY, "session_no").agg(F.count("*").alias("packets"), F.min("ts_us").alias("first_us"))
    want = {(*[r[k] for k in KEY], r.first_us): r.packets for r in batch.collect()}
    found = {(*[r[k] for k in KEY], r.first_us): r.packets for r in got.collect()}
    assert len(found) > 3 and all(want[k] == n for k, n in found.items())
    assert len(found) >= len(want) - len({k[:5] for k in want})  # the last of each flow may still be open


def test_work_ends_at_a_stop_message(spark, tmp_path):
    flow = {"cli_ip": "1.1.1.1", "srv_ip": "2.2.2.2", "cli_port": 1, "srv_port": 2, "proto": "UDP", "count": 2, "ts": [0.0], "len": [1]}
    for i, text in enumerate((json.dumps([flow, flow]), json.dumps([flow]) + '\n{"STOP":true}', json.dumps([flow] * 5))):
        (tmp_path / f"{i}.txt").write_text(text)
    lines = spark.readStream.option("maxFilesPerTrigger", 1).option("latestFirst", False).text(str(tmp_path) + "/*.txt")
    seen = []
    assert jobs.work_until_stop(lines, lambda df, n: seen.append(df.count()), str(tmp_path / "check"), timeout=120)
    assert seen == [2, 1]


def test_json_sink_and_messages(spark, stream):
    _, packets, path = stream
    q = jobs.to_json_sink(packets.select("pkt_no", "proto"), str(path / "out"), str(path / "check"))
    q.awaitTermination(120)
    assert spark.read.json(str(path / "out")).count() == 400
    flow = {"cli_ip": "1.1.1.1", "srv_ip": "2.2.2.2", "cli_port": 1, "srv_port": 2, "proto": "UDP", "count": 2, "ts": [0.0, 0.5], "len": [1, -2]}
    lines = spark.createDataFrame([(json.dumps([flow, flow]),), ("not json",), ('{"STOP":true}',), ("[]",)], "value string")
    assert [r.srv_port for r in jobs.parse_messages(lines).collect()] == [2, 2]
