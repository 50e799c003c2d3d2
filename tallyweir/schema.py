"""Schemas of packets and flows, and the settings that the operators take."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Protocol numbers and TCP flag bits.
TCP, UDP = 6, 17
FIN, SYN, RST, ACK = 1, 2, 4, 16
CAP, FIRST_N, IDLE_SECONDS = 40, 8, 30

PACKETS = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("pkt_no", T.LongType()), T.StructField("ts_us", T.LongType()),
    T.StructField("src_ip_n", T.LongType()), T.StructField("dst_ip_n", T.LongType()), T.StructField("src_port", T.IntegerType()), T.StructField("dst_port", T.IntegerType()),
    T.StructField("proto", T.IntegerType()), T.StructField("ip_len", T.IntegerType()), T.StructField("tcp_seq", T.LongType()), T.StructField("tcp_ack", T.LongType()), T.StructField("tcp_flags", T.IntegerType()),
])

KEY = ["ip1", "port1", "ip2", "port2", "proto"]


@dataclass(frozen=True)
class FlowSettings:
    """cap: packets kept per flow. idle: seconds without a packet that end a UDP flow."""

    cap: int = CAP
    idle: int = IDLE_SECONDS
    first_n: int = FIRST_N
