"""Writers: vector lines, counts, collisions and JSON in the layouts that downstream tools read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.functions.keys import ip_text, proto_name
from tallyweir.operators.flows import csv_lines, json_records
from tallyweir.schema import CAP

COUNTS = ["src_ip", "src_port", "dst_ip", "dst_port", "proto", "packets"]
COLLISIONS = ["ts_us", "winner_ip1", "winner_port1", "winner_ip2", "winner_port2", "winner_proto", "loser_ip1", "loser_port1", "loser_ip2", "loser_port2", "loser_proto", "winner_was_incumbent", "winner_pkts", "loser_pkts", "winner_ge40", "loser_ge40"]
SUMMARY = ["ip1", "port1", "ip2", "port2", "proto", "pkts", "ge40", "collisions", "wins", "losses"]
TIMING = ["first_ts_us", "hit30_ts_us", "last_ts_us", "dur_to_30_us", "dur_30_to_last_us", "dur_total_us"]


def vector_files(records: DataFrame, path: str, cap: int = CAP, split: bool = True) -> None:
    """Vector lines of the full flows as text, in a folder per protocol if `split`."""
    lines = csv_lines(records, cap).select(proto_name(F.col("proto")).alias("protocol"), F.col("line").alias("value"))
    if split:
        lines.write.mode("append").partitionBy("protocol").text(path)
    else:
        lines.select("value").write.mode("append").text(path)


def table_files(flows: DataFrame, path: str) -> None:
    """Flows of a two-table policy: flowid, count_total, features, in a folder per table; flows of any length."""
    ends = F.concat(ip_text(F.col("ip1")), F.col("port1").cast("string"), ip_text(F.col("ip2")), F.col("port2").cast("string"), proto_name(F.col("proto")))
    pair = lambda t, n: F.concat(F.lit("("), F.format_string("%.6f", F.when(n < 0, -t).otherwise(t) / 1e6), F.lit(", "), F.format_string("%.1f", n.cast("double")), F.lit(")"))
    rows = flows.where(F.col("count") > 0).select("in_table", ends.alias("flowid"), F.col("total").alias("count_total"), F.concat(F.lit("["), F.array_join(F.zip_with("ts", "len", pair), ", "), F.lit("]")).alias("features"))
    rows.write.mode("overwrite").option("header", True).option("quoteAll", False).partitionBy("in_table").csv(path)


def count_files(counts: DataFrame, path: str) -> None:
    counts.select(ip_text(F.col("ip1")).alias("src_ip"), F.col("port1").alias("src_port"), ip_text(F.col("ip2")).alias("dst_ip"), F.col("port2").alias("dst_port"), "proto", "packets").write.mode("overwrite").option("header", True).csv(path)


def collision_files(table: DataFrame, path: str) -> None:
    """The 16 columns of the collision log with its ground truth."""
    named = table.withColumn("winner_proto", F.col("proto")).withColumn("loser_proto", F.col("proto"))
    for c in ("winner_ip1", "winner_ip2", "loser_ip1", "loser_ip2"):
        named = named.withColumn(c, ip_text(F.col(c)))
    named.select(*COLLISIONS).write.mode("overwrite").option("header", True).csv(path)


def summary_files(summary: DataFrame, path: str, timing: bool = False) -> None:
    """One line per flow: 10 columns, or 16 with timing."""
    named = summary.withColumn("ip1", ip_text(F.col("ip1"))).withColumn("ip2", ip_text(F.col("ip2")))
    named.select(*SUMMARY, *(TIMING if timing else [])).write.mode("overwrite").option("header", True).csv(path)


def json_files(records: DataFrame, path: str) -> None:
    """One JSON object per line."""
    json_records(records).select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def occupied(records: DataFrame, at_us: int) -> DataFrame:
    """Flows in each table and protocol at an instant, from the flows that a policy emits: those begun and not yet ended."""
    last = F.col("first_ts_us") + F.element_at("ts", -1)
    live = records.where((F.col("first_ts_us") <= at_us) & (last >= at_us))
    return live.groupBy("in_table", "proto").agg(F.count("*").alias("flows"))
