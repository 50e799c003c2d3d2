"""Packets made from plain tables: any table with endpoints, times and sizes can be shaped into packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def micros(column):
    return F.unix_micros(column.cast("timestamp"))


def packets_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packet for each event: users talk to seven servers, even users by UDP. pkt_no is the arrival order."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    user = F.col("user_id").cast("long")
    out = ~F.col("event_type").isin("error", "view")
    client, server = F.lit(167772160) + user, F.lit(3232235520) + user % 7
    client_port = (F.lit(1024) + user * 7919 % 60000).cast("int")
    server_port = F.when(user % 3 == 0, 443).when(user % 3 == 1, 80).otherwise(53)
    proto = F.when(user % 2 == 0, 17).otherwise(6)
    pick = lambda a, b: F.when(out, a).otherwise(b)
    flags = F.when(proto == 17, None).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "purchase", 17).otherwise(16)
    return e.select(
        F.lit("events").alias("file"), F.col("event_id").cast("long").alias("pkt_no"), micros(F.col("ts")).alias("ts_us"),
        pick(client, server).alias("src_ip_n"), pick(server, client).alias("dst_ip_n"), pick(client_port, server_port).alias("src_port"), pick(server_port, client_port).alias("dst_port"),
        proto.alias("proto"), (F.lit(40) + F.floor("value")).cast("int").alias("ip_len"), flags.alias("tcp_flags"),
    )


def packets_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A UDP packet for each line item: parts talk to five servers. `turn` orders the packets of equal time."""
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    out = F.col("l_linenumber") % 2 == 1
    client, server = F.lit(167772160) + F.col("l_partkey").cast("long"), F.lit(3232235776) + F.col("l_partkey").cast("long") % 5
    pick = lambda a, b: F.when(out, a).otherwise(b)
    ts = micros(F.col("l_shipdate")) + (F.col("l_orderkey").cast("long") * 7 + F.col("l_linenumber")) % 86400 * 1000000
    return i.select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("turn"), ts.alias("ts_us"),
        pick(client, server).alias("src_ip_n"), pick(server, client).alias("dst_ip_n"), F.lit(5000).alias("src_port"), F.lit(5000).alias("dst_port"),
        F.lit(17).alias("proto"), (F.lit(40) + F.floor(F.col("l_quantity") * 20)).cast("int").alias("ip_len"), F.lit(None).cast("int").alias("tcp_flags"),
    )


def trace_files(spark: SparkSession, sf_dir: str, files: int = 8) -> DataFrame:
    """Orders as packets of several files, for merging: (file_no, seq_key, ts_us)."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select((F.col("o_custkey") % files).cast("int").alias("file_no"), F.col("o_orderkey").cast("long").alias("pkt_no"), micros(F.col("o_orderdate")).alias("ts_us"))
