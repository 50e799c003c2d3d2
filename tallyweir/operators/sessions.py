"""Flow sessions: where a UDP flow ends after a quiet time, and where a TCP flow begins and ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweir.schema import KEY, UDP

#: Packets per run of the global order; only one row per run is looked at across runs.
RUN = 1 << 16


def second(ts_us: Column) -> Column:
    return F.floor(ts_us / F.lit(1000000)).cast("long")


def by_flow():
    return Window.partitionBy(*KEY).orderBy("pkt_no")


def numbered(df: DataFrame, boundary: Column) -> DataFrame:
    """df with session_no from 1: how many boundaries the flow has had."""
    return df.withColumn("boundary", boundary.cast("int")).withColumn("session_no", F.sum("boundary").over(by_flow()).cast("long")).drop("boundary")


def udp_sessions_wheel(packets: DataFrame, idle: int) -> DataFrame:
    """A flow's packet begins a session if its whole second lies `idle` or more after the last one's: the clock of an expiry wheel."""
    gap = second(F.col("ts_us")) - F.lag(second(F.col("ts_us"))).over(by_flow())
    return numbered(packets, F.coalesce(gap >= idle, F.lit(True)))


def previous_second(packets: DataFrame) -> DataFrame:
    """packets with prev_sec: the second of the packet before in the whole trace.

    The order is global, but work is not: packets lie in runs of their number, a window looks back within a run, and the
    first of a run takes the last second of the runs before from a table of one row a run.
    """
    runs = packets.withColumn("sec", second(F.col("ts_us"))).withColumn("run", F.floor(F.col("pkt_no") / RUN))
    inside = Window.partitionBy("run").orderBy("pkt_no")
    last = runs.groupBy("run").agg(F.max_by("sec", "pkt_no").alias("last_sec"))
    before = last.select("run", F.lag("last_sec").over(Window.orderBy("run")).alias("run_prev"))
    looked = runs.withColumn("in_run", F.lag("sec").over(inside))
    return looked.join(before, "run").withColumn("prev_sec", F.coalesce("in_run", "run_prev")).drop("in_run", "run_prev", "run")


def wheel_clock(packets: DataFrame) -> DataFrame:
    """packets with clock: the greatest second seen so far in the whole trace, which late packets do not turn back."""
    runs = packets.withColumn("sec", second(F.col("ts_us"))).withColumn("run", F.floor(F.col("pkt_no") / RUN))
    most = runs.groupBy("run").agg(F.max("sec").alias("most"))
    before = most.select("run", F.max("most").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)).alias("run_before"))
    inside = Window.partitionBy("run").orderBy("pkt_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return runs.join(before, "run").withColumn("clock", F.greatest(F.max("sec").over(inside), "run_before")).drop("run", "run_before", "sec")


def udp_sessions_scan(packets: DataFrame, idle: int) -> DataFrame:
    """A table scan after each packet: a flow ends only if another packet was seen `idle` seconds or more after its last one."""
    seen = previous_second(packets)
    gap = F.col("prev_sec") - F.lag("sec").over(by_flow())
    return numbered(seen, F.coalesce(gap >= idle, F.lit(True))).drop("sec", "prev_sec")


def udp_sessions_strict(packets: DataFrame, idle: int, slots: int = 256) -> DataFrame:
    """Sessions of an expiry wheel of so many slots of a second, late packets included.

    A packet's deadline is its own second plus `idle`, in the slot of that second modulo `slots`. A late packet's deadline
    may lie behind the clock: then the flow ends only when the wheel comes to that slot again.
    """
    seen = wheel_clock(packets)
    wait = F.pmod(second(F.col("ts_us")) + idle - F.col("clock") - 1, F.lit(slots)) + 1
    ends = F.lag(F.col("clock") + wait).over(by_flow())
    return numbered(seen.where(F.col("proto") == UDP), F.coalesce(F.col("clock") >= ends, F.lit(True)))


def is_syn(pure: bool = False) -> Column:
    return F.coalesce(F.col("tcp_flags") == 2, F.lit(False)) if pure else F.coalesce(F.col("tcp_flags").bitwiseAND(2) != 0, F.lit(False))


def tcp_started(packets: DataFrame, pure: bool = False) -> DataFrame:
    """TCP packets from their flow's first SYN on, and all UDP packets."""
    seen = F.max(is_syn(pure).cast("int")).over(by_flow())
    return packets.withColumn("started", (F.col("proto") == UDP) | (seen == 1)).where("started").drop("started")


def tcp_fin_both(packets: DataFrame, cap: int) -> DataFrame:
    """TCP flows that end on a FIN once both sides have sent one and `cap` packets are held: (key, end pkt_no, packets until then)."""
    p = tcp_started(packets.where("proto = 6"))
    w = by_flow()
    first = F.struct("src_ip_n", "src_port")
    p = p.withColumn("n", F.row_number().over(w)).withColumn("client", F.first(first).over(w)).withColumn("fin", F.col("tcp_flags").bitwiseAND(1) != 0)
    mine = F.col("client") == first
    p = p.withColumn("fin_client", F.max((F.col("fin") & mine).cast("int")).over(w)).withColumn("fin_server", F.max((F.col("fin") & ~mine).cast("int")).over(w))
    return p.where(F.col("fin") & (F.col("fin_client") == 1) & (F.col("fin_server") == 1) & (F.col("n") >= cap)).groupBy(*KEY).agg(F.min_by(F.struct("pkt_no", "n"), "pkt_no").alias("end")).select(*KEY, F.col("end.pkt_no").alias("end_pkt_no"), F.col("end.n").cast("long").alias("packets"))


def tcp_any_fin(packets: DataFrame) -> DataFrame:
    """TCP sessions that any FIN ends: (key, session_no, packets)."""
    p = packets.where("proto = 6")
    fins = F.sum(F.when(F.col("tcp_flags").bitwiseAND(1) != 0, 1).otherwise(0)).over(by_flow().rowsBetween(Window.unboundedPreceding, -1))
    return p.withColumn("session_no", F.coalesce(fins, F.lit(0)).cast("long") + 1).groupBy(*KEY, "session_no").agg(F.count("*").alias("packets"))
