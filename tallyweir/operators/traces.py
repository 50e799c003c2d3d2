"""Traces: merging files into simulated sessions, and rewriting addresses."""

from __future__ import annotations

import heapq
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assign_sessions(durations: dict[int, int], order: list[int], sessions: int, starts: list[int] | None = None) -> dict[int, tuple[int, int, int]]:
    """file -> (session, place in it, base time): each next file goes to the session that ends first. One row per file."""
    heap = [((starts or [0] * sessions)[s], s, 0) for s in range(sessions)]
    heapq.heapify(heap)
    out = {}
    for f in order:
        base, s, n = heapq.heappop(heap)
        out[f] = (s, n, base)
        heapq.heappush(heap, (base + durations[f], s, n + 1))
    return out


def merged(packets: DataFrame, sessions: int) -> DataFrame:
    """Files in fixed turns over the sessions: each plays its files back to back from time 0, every file rebased.

    The base of a file is the sum of the durations of the files before it in its session; that table has one row per
    file. Rows come ordered by (out_us, session_no, file_no, pkt_no) when written with a sort.
    """
    spans = packets.groupBy("file_no").agg(F.min("ts_us").alias("first_us"), (F.max("ts_us") - F.min("ts_us")).alias("dur_us"))
    spans = spans.withColumn("session_no", (F.col("file_no") % sessions).cast("int"))
    before = Window.partitionBy("session_no").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = spans.withColumn("base_us", F.coalesce(F.sum("dur_us").over(before), F.lit(0)).cast("long"))
    return packets.join(bases.drop("dur_us"), "file_no").select("session_no", "file_no", "pkt_no", (F.col("base_us") + F.col("ts_us") - F.col("first_us")).alias("out_us"))


#: Microseconds after time 0 at which a session begins at the latest.
LATEST_START = 2_000_000


def shuffled(files: list, seed: int) -> list:
    """Files in an order drawn by a seed."""
    out = sorted(files)
    random.Random(seed).shuffle(out)
    return out


def random_starts(sessions: int, seed: int) -> list[int]:
    """When each session begins, in microseconds."""
    rng = random.Random(f"starts {seed}")
    return [rng.randint(0, LATEST_START) for _ in range(sessions)]


def in_time_order(rows: DataFrame) -> DataFrame:
    """Merged packets in one order over all sessions, as a capture of them has; a range shuffle."""
    return rows.orderBy("out_us", "session_no", "file_no", "pkt_no")


def one_trace(packets: DataFrame) -> DataFrame:
    """Packets of several files as one trace: pkt_no orders over files, by name, and in each by place; file_no is the name's place."""
    names = packets.select("file").distinct()  # one row a file
    numbered = names.withColumn("file_no", (F.row_number().over(Window.orderBy("file")) - 1).cast("int"))
    return packets.join(numbered, "file").withColumn("pkt_no", F.shiftleft(F.col("file_no").cast("long"), 40) + F.col("pkt_no"))


def merged_dynamic(packets: DataFrame, sessions: int, starts: list[int] | None = None, seed: int | None = None) -> DataFrame:
    """As `merged`, but whichever session ends first takes the next file. Durations, one per file, are on the driver.

    With a seed the files come in an order drawn by it, and sessions begin at random in the first two seconds.
    """
    spans = {r.file_no: (r.first_us, r.dur) for r in packets.groupBy("file_no").agg(F.min("ts_us").alias("first_us"), (F.max("ts_us") - F.min("ts_us")).alias("dur")).collect()}
    if seed is not None:
        starts = starts or random_starts(sessions, seed)
    at = assign_sessions({f: d for f, (_, d) in spans.items()}, sorted(spans) if seed is None else shuffled(list(spans), seed), sessions, starts)
    rows = [(f, s, base, spans[f][0]) for f, (s, _, base) in at.items()]
    bases = packets.sparkSession.createDataFrame(rows, "file_no int, session_no int, base_us long, first_us long")
    return packets.join(F.broadcast(bases), "file_no").select("session_no", "file_no", "pkt_no", (F.col("base_us") + F.col("ts_us") - F.col("first_us")).alias("out_us"))


def rewrite_files(packets: DataFrame, prefix: int, bits: int, first_target: int, target_bits: int) -> DataFrame:
    """`rewrite_prefix` with a target of its own for each file: first_target for the first by name, one more for each next one. Addresses
    under prefix/bits get the target's first target_bits and keep the rest. Adds target, by which a capture per file can be written.
    """
    names = packets.select("file").distinct()  # one row a file
    targets = names.withColumn("target", F.row_number().over(Window.orderBy("file")) - 1 + F.lit(first_target).cast("long"))
    low, kept = (1 << (32 - bits)) - 1, (1 << (32 - target_bits)) - 1

    def moved(c: str):
        n = F.col(c)
        return F.when(n - n.bitwiseAND(low) == F.lit(prefix & ~low), F.col("target") - F.col("target").bitwiseAND(kept) + n.bitwiseAND(kept)).otherwise(n).alias(c)

    joined = packets.join(targets, "file")
    return joined.select(*[moved(c) if c in ("src_ip_n", "dst_ip_n") else c for c in packets.columns], "target")


def rewrite_prefix(packets: DataFrame, prefix: int, bits: int, target: int) -> DataFrame:
    """Addresses under prefix/bits keep their low bits and get the target's high ones."""
    low = (1 << (32 - bits)) - 1

    def moved(c: str):
        n = F.col(c)
        return F.when(n - n.bitwiseAND(low) == F.lit(prefix & ~low), F.lit(target & ~low) + n.bitwiseAND(low)).otherwise(n).alias(c)

    return packets.select(*[moved(c) if c in ("src_ip_n", "dst_ip_n") else c for c in packets.columns])
