"""Flow records: the first packets of each session, their printed forms, and counts per flow."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweir.functions.keys import canon_numeric, flow_id, ip_text, proto_name, with_bucket
from tallyweir.operators.sessions import udp_sessions_wheel
from tallyweir.schema import FIN, KEY, SYN, TCP


def flow_records(packets: DataFrame, cap: int, idle: int) -> DataFrame:
    """One row per UDP session: its first `cap` packets as offsets in seconds and signed lengths, + from the client.

    The client is the sender of the first packet. One shuffle by flow key serves the session number, the packet number
    in the session and the aggregation.
    """
    p = udp_sessions_wheel(canon_numeric(packets), idle)
    w = Window.partitionBy(*KEY, "session_no").orderBy("pkt_no")
    p = p.withColumn("n", F.row_number().over(w)).withColumn("total", F.count("*").over(Window.partitionBy(*KEY, "session_no"))).where(F.col("n") <= cap)
    held = F.sort_array(F.collect_list(F.struct("pkt_no", "ts_us", "src_ip_n", "src_port", "dst_ip_n", "dst_port", "ip_len")))
    r = p.groupBy(*KEY, "session_no").agg(held.alias("held"), F.first("total").alias("total"))
    first = F.col("held")[0]
    # seconds as doubles before they are subtracted
    offset = lambda x: x["ts_us"] / F.lit(1e6) - first["ts_us"] / F.lit(1e6)
    signed = lambda x: F.when((x["src_ip_n"] == first["src_ip_n"]) & (x["src_port"] == first["src_port"]), x["ip_len"]).otherwise(-x["ip_len"])
    return r.select(
        *KEY, "session_no", first["src_ip_n"].alias("cli_ip"), first["src_port"].alias("cli_port"), first["dst_ip_n"].alias("srv_ip"), first["dst_port"].alias("srv_port"),
        F.size("held").cast("long").alias("count"), "total", F.transform("held", offset).alias("ts"), F.transform("held", signed).alias("len"),
    )


RECORD = "ip1 long, port1 int, ip2 long, port2 int, proto int, session_no long, cli_ip long, cli_port int, srv_ip long, srv_port int, count long, total long, ts array<double>, len array<int>"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}
_RECORD = pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in RECORD.split(", ")])


def tcp_flow_records(packets: DataFrame, cap: int) -> DataFrame:
    """One row per finished TCP session, as flow_records has for UDP: a SYN of any kind begins it where the flow has none open, its first `cap`
    packets are kept, and the first FIN ends it by which both sides have sent one while `cap` packets are held. What is
    open at the end of the trace is no row. Packets are dealt by flow, sorted by Spark, and read as a stream.
    """
    columns = [*KEY, "pkt_no", "ts_us", "src_ip_n", "src_port", "dst_ip_n", "dst_port", "ip_len", "tcp_flags"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flow = state = None
        sessions, out = 0, []
        for batch in batches:
            for *key, _, ts, src, sport, dst, dport, size, flags in zip(*(c.to_pylist() for c in batch.columns)):
                if key != flow:
                    flow, state, sessions = key, None, 0
                flags = flags or 0
                if state is None:
                    if not flags & SYN:
                        continue
                    sessions += 1
                    state = [(src, sport, dst, dport), [], [], 0, set()]
                ends, times, sizes, _, fins = state
                mine = (src, sport) == ends[:2]
                state[3] += 1
                if len(times) < cap:
                    times.append(ts / 1e6)
                    sizes.append(size if mine else -size)
                if flags & FIN:
                    fins.add(mine)
                    if len(fins) == 2 and len(times) == cap:
                        out.append((*key, sessions, *ends, cap, state[3], [t - times[0] for t in times], sizes))
                        state = None
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _RECORD)], schema=_RECORD)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _RECORD)], schema=_RECORD)

    dealt = canon_numeric(packets.where(F.col("proto") == TCP)).select(*columns).repartition(*KEY).sortWithinPartitions(*KEY, "pkt_no")
    return dealt.mapInArrow(run, RECORD)


def dump_text(records: DataFrame) -> DataFrame:
    """(key, session_no, text): a heading for each flow, and a line for each of its packets with offset and signed length."""
    ends = F.format_string("%s:%d \u21c6 %s:%d", ip_text(F.col("cli_ip")), "cli_port", ip_text(F.col("srv_ip")), "srv_port")
    heading = F.format_string("=== Flow %s (%s) packets:%d ===", ends, proto_name(F.col("proto")), "count")
    lines = F.zip_with("ts", "len", lambda t, n: F.format_string("%.6f  len=%d", t, n))
    return records.select(*KEY, "session_no", F.concat_ws("\n", heading, F.array_join(lines, "\n")).alias("text"))


def fixed6(x: Column) -> Column:
    """A double with six decimals."""
    return F.format_string("%.6f", x)


def csv_lines(records: DataFrame, cap: int) -> DataFrame:
    """Vector lines of the full flows: (flow_id, line). Offsets of server packets are negated."""
    pair = lambda t, n: F.concat(F.lit("("), fixed6(F.when(n < 0, -t).otherwise(t)), F.lit(", "), F.format_string("%.1f", n.cast("double")), F.lit(")"))
    vector = F.concat(F.lit('"['), F.array_join(F.zip_with("ts", "len", pair), ", "), F.lit(']"'))
    return records.where(F.col("count") == cap).select(flow_id().alias("flow_id"), "proto", F.concat(flow_id(), F.lit(","), vector).alias("line"))


def json_records(records: DataFrame) -> DataFrame:
    """One JSON object per flow, with unsigned offsets, and with the wins of flows that a policy emits."""
    wins = ["wins"] if "wins" in records.columns else []
    body = F.struct(ip_text(F.col("cli_ip")).alias("cli_ip"), ip_text(F.col("srv_ip")).alias("srv_ip"), "cli_port", "srv_port", proto_name(F.col("proto")).alias("proto"), "count", *wins, "ts", "len")
    return records.select(*KEY, *(["session_no"] if "session_no" in records.columns else []), F.to_json(body).alias("json"))


def messages(records: DataFrame, batch: int = 16, parts: int = 64) -> DataFrame:
    """JSON arrays of at most `batch` flows; batches are cut within `parts` groups by the flows' hash, so no task numbers all flows."""
    j = with_bucket(json_records(records), parts).withColumnRenamed("bucket", "part")
    n = F.row_number().over(Window.partitionBy("part").orderBy(*KEY, "json")) - 1
    g = j.withColumn("batch_no", F.floor(n / batch)).groupBy("part", "batch_no").agg(F.sort_array(F.collect_list("json")).alias("flows"))
    return g.select("part", "batch_no", F.size("flows").cast("long").alias("flows_in"), F.concat(F.lit("["), F.array_join("flows", ","), F.lit("]")).alias("message"))


def packet_counts(packets: DataFrame) -> DataFrame:
    """Packets, bytes, and first and last time of each flow."""
    return packets.groupBy(*KEY).agg(F.count("*").alias("packets"), F.sum("ip_len").cast("long").alias("bytes"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


def totals(packets: DataFrame) -> DataFrame:
    """Packets, bytes and flows of a whole trace. Frames that were read but did not decode (no protocol) are packets, of no flow and 0 bytes."""
    per_flow = packet_counts(canon_numeric(packets))
    return per_flow.agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"), F.count(F.when(F.col("proto").isNotNull(), 1)).alias("flows"), F.sum(F.when(F.col("proto") == 6, F.col("packets")).otherwise(0)).alias("tcp_packets"), F.sum(F.when(F.col("proto") == 17, F.col("packets")).otherwise(0)).alias("udp_packets"))


def file_counters(packets: DataFrame) -> DataFrame:
    """Files, packets, those of TCP or UDP, and flows of a trace of many files."""
    per_flow = canon_numeric(packets).groupBy(*KEY).agg(F.count("*").alias("n"), F.collect_set("file").alias("files"))
    files = packets.select("file").distinct().agg(F.count("*").alias("files"))
    t = per_flow.agg(F.sum("n").alias("packets"), F.sum(F.when(F.col("proto").isin(6, 17), F.col("n")).otherwise(0)).alias("parsed_packets"), F.count("*").alias("unique_flows"), F.sum((F.size("files") > 1).cast("int")).cast("long").alias("flows_in_several_files"))
    return files.crossJoin(t)  # one row each


def inter_arrival(packets: DataFrame) -> DataFrame:
    """Microseconds since the flow's packet before, and since its first one."""
    w = Window.partitionBy(*KEY).orderBy("pkt_no")
    return packets.select("pkt_no", *KEY, (F.col("ts_us") - F.lag("ts_us").over(w)).alias("gap_us"), (F.col("ts_us") - F.first("ts_us").over(w)).alias("offset_us"), F.row_number().over(w).cast("long").alias("n"))


def admitted_once(packets: DataFrame) -> DataFrame:
    """The first UDP packet of each key: what an exact once-only gate lets in."""
    return packets.where("proto = 17").groupBy(*KEY).agg(F.min("pkt_no").alias("admitted_at"), F.count("*").alias("packets"))


def max_flows(packets: DataFrame, most: int) -> DataFrame:
    """Counts of the first `most` flows by first packet; later keys are ignored."""
    c = packets.groupBy(*KEY).agg(F.count("*").alias("packets"), F.sum("ip_len").cast("long").alias("bytes"), F.min("pkt_no").alias("first_pkt"))
    return c.orderBy("first_pkt").limit(most)


def decoded_flags(packets: DataFrame) -> DataFrame:
    """TCP flag bits and their text."""
    bit = lambda b: F.when(F.col("tcp_flags").bitwiseAND(b) != 0, 1).otherwise(0)
    t = packets.where("proto = 6").select("pkt_no", "tcp_flags", bit(1).alias("fin"), bit(2).alias("syn"), bit(4).alias("rst"), bit(16).alias("ack"))
    return t.withColumn("flags_text", F.format_string("FIN:%d, SYN:%d, RST:%d, ACK:%d", "fin", "syn", "rst", "ack"))


def as_text(packets: DataFrame) -> DataFrame:
    """Packets as rows of strings; a field that a protocol lacks is null."""
    s = lambda c: F.col(c).cast("string")
    stamp = F.concat(F.floor(F.col("ts_us") / 1000000).cast("string"), F.lit("."), F.lpad((F.col("ts_us") % 1000000).cast("string"), 6, "0"))
    return packets.select(stamp.alias("timestamp"), ip_text(F.col("src_ip_n")).alias("src_ip"), ip_text(F.col("dst_ip_n")).alias("dst_ip"), s("src_port").alias("src_port"), s("dst_port").alias("dst_port"), proto_name(F.col("proto")).alias("protocol"), s("ip_len").alias("packet_length"), s("tcp_flags").alias("tcp_flags"))
