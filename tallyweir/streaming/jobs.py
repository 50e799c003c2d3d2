"""The same operators on streams: sessions with timers, the first-come policy with kept state, and a JSON sink."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyweir.functions.keys import canon_numeric, with_bucket
from tallyweir.policies.engine import CounterRng, Output, Packet, Settings
from tallyweir.policies.single import FirstCome, Slot
from tallyweir.schema import KEY

SESSION = "ip1 long, port1 int, ip2 long, port2 int, proto int, first_us long, last_us long, packets long, ts array<long>, len array<int>, end_reason string"
HELD = "first_us long, last_us long, packets long, ts array<long>, len array<int>, cli_ip long, cli_port int"


def udp_sessions(packets: DataFrame, idle: int, cap: int, late_seconds: int = 0) -> DataFrame:
    """Sessions of a packet stream, emitted when the event clock is `idle` seconds past their last packet."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        held = list(state.get) if state.exists else None
        if state.hasTimedOut:
            yield _frame([(*key, *held[:5], "idle")])
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("pkt_no")
        for r in rows.itertuples():
            if held and r.ts_us // 1_000_000 - held[1] // 1_000_000 >= idle:
                done.append((*key, *held[:5], "idle"))
                held = None
            if held is None:
                held = [r.ts_us, r.ts_us, 0, [], [], r.src_ip_n, r.src_port]
            held[1], held[2] = max(held[1], r.ts_us), held[2] + 1
            if len(held[3]) < cap:
                held[3] = [*held[3], r.ts_us - held[0]]
                held[4] = [*held[4], r.ip_len if (r.src_ip_n, r.src_port) == (held[5], held[6]) else -r.ip_len]
        state.update(tuple(int(x) if not isinstance(x, list) else [int(y) for y in x] for x in held))
        state.setTimeoutTimestamp(max(held[1] // 1000 + idle * 1000, state.getCurrentWatermarkMs() + 1))
        yield _frame(done)

    timed = canon_numeric(packets).withColumn("at", F.timestamp_micros("ts_us")).withWatermark("at", f"{late_seconds} seconds")
    return timed.groupBy(*KEY).applyInPandasWithState(step, SESSION, HELD, "append", GroupStateTimeout.EventTimeTimeout)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SESSION.split(", ")])


EMITTED = "bucket long, ip1 long, port1 int, ip2 long, port2 int, proto int, count long, wins long, end_reason string"


def first_come(packets: DataFrame, settings: Settings) -> DataFrame:
    """The first-come policy on a stream: each bucket's slot is kept as state between batches."""
    import pickle

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = Output("fcfs")
        rules = FirstCome(settings, out, CounterRng(settings.seed))
        slot = pickle.loads(state.get[0]) if state.exists else Slot((int(key[0]), int(key[1])))
        rows = pd.concat(list(frames)).sort_values("pkt_no")
        for r in rows.itertuples():
            flags = 0 if pd.isna(r.tcp_flags) else int(r.tcp_flags)
            rules.packet(slot, Packet(r.pkt_no, r.ts_us, r.src_ip_n, r.src_port, r.dst_ip_n, r.dst_port, r.proto, flags, r.ip_len, (r.ip1, r.port1, r.ip2, r.port2, r.proto), r.hash))
        state.update((pickle.dumps(slot),))
        yield pd.DataFrame([{k: r[k] for k in (c.split()[0] for c in EMITTED.split(", "))} for r in out.rows if r["kind"] == "flow"], columns=[c.split()[0] for c in EMITTED.split(", ")])

    keyed = with_bucket(canon_numeric(packets), settings.buckets)
    return keyed.groupBy("proto", "bucket").applyInPandasWithState(step, EMITTED, "slot binary", "append", GroupStateTimeout.NoTimeout)


def to_json_sink(flows: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Flows as JSON lines, exactly once. With available_now the query stops when the input is read."""
    writer = flows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def work_until_stop(lines: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, timeout: float | None = None) -> bool:
    """Gives the flows of each batch of messages to `handle`, until a stop message comes; whether one came.

    A stop message ends the work after its batch; batches are one at a time, and their flows are spread over all tasks.
    """
    stop = threading.Event()

    def step(batch: DataFrame, number: int) -> None:
        if stop.is_set():
            return
        handle(parse_messages(batch), number)
        if not batch.where(F.get_json_object("value", "$.STOP") == "true").isEmpty():
            stop.set()

    query = lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
    try:
        stop.wait(timeout)
    finally:
        query.stop()
    if query.exception() is not None and not stop.is_set():
        raise query.exception()
    return stop.is_set()


def parse_messages(lines: DataFrame) -> DataFrame:
    """Flows of JSON messages (arrays of objects), one per line; what is no message, and stop messages, give no row."""
    schema = "array<struct<cli_ip:string,srv_ip:string,cli_port:int,srv_port:int,proto:string,count:int,ts:array<double>,len:array<int>>>"
    flows = lines.select(F.from_json(F.col("value"), schema, {"mode": "PERMISSIVE"}).alias("m")).select(F.explode("m").alias("f")).select("f.*")
    return flows.where("cli_ip is not null")
