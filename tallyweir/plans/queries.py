"""Registered queries, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.functions import keys
from tallyweir.operators import evaluate, features, flows, groundtruth, learning, sequence, sessions, sinks, traces
from tallyweir.policies import catalog
from tallyweir.policies.engine import Settings, collisions_of, counts_of, flows_of, noted
from tallyweir.schema import KEY
from tallyweir.sources import adapters, capture, training
from tallyweir.streaming import jobs

#: The event tables' time scale is days: quiet times that end sessions, and small tables for policies.
IDLE, SHORT_IDLE, BUCKETS, CAP = 172_800, 43_200, 16, 40
LINE_ORDER = ["ts_us", "turn"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# ---- SQL building blocks -----------------------------------------------------------------------------------------

EVENTS = """
raw AS (SELECT event_id AS pkt_no, epoch_us(ts) AS ts_us, event_type NOT IN ('error', 'view') AS outward, user_id::BIGINT AS u, event_type AS et, value FROM events),
packets AS (
  SELECT pkt_no, ts_us, CASE WHEN outward THEN 167772160 + u ELSE 3232235520 + u % 7 END AS src_ip_n, CASE WHEN outward THEN 3232235520 + u % 7 ELSE 167772160 + u END AS dst_ip_n,
    CAST(CASE WHEN outward THEN 1024 + (u * 7919) % 60000 ELSE CASE u % 3 WHEN 0 THEN 443 WHEN 1 THEN 80 ELSE 53 END END AS INTEGER) AS src_port,
    CAST(CASE WHEN outward THEN CASE u % 3 WHEN 0 THEN 443 WHEN 1 THEN 80 ELSE 53 END ELSE 1024 + (u * 7919) % 60000 END AS INTEGER) AS dst_port,
    CASE WHEN u % 2 = 0 THEN 17 ELSE 6 END AS proto, CASE WHEN u % 2 = 0 THEN NULL WHEN et = 'signup' THEN 2 WHEN et = 'purchase' THEN 17 ELSE 16 END AS tcp_flags,
    CAST(40 + floor(value) AS INTEGER) AS ip_len
  FROM raw),
canon AS (
  SELECT *, f AS src_first, CASE WHEN f THEN src_ip_n ELSE dst_ip_n END AS ip1, CASE WHEN f THEN src_port ELSE dst_port END AS port1, CASE WHEN f THEN dst_ip_n ELSE src_ip_n END AS ip2, CASE WHEN f THEN dst_port ELSE src_port END AS port2
  FROM (SELECT *, src_ip_n < dst_ip_n OR (src_ip_n = dst_ip_n AND src_port <= dst_port) AS f FROM packets))"""

LINES = """
packets AS (
  SELECT epoch_us(l_shipdate) + ((l_orderkey * 7 + l_linenumber) % 86400) * 1000000 AS ts_us, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
    CASE WHEN l_linenumber % 2 = 1 THEN 167772160 + l_partkey ELSE 3232235776 + l_partkey % 5 END AS src_ip_n, CASE WHEN l_linenumber % 2 = 1 THEN 3232235776 + l_partkey % 5 ELSE 167772160 + l_partkey END AS dst_ip_n,
    5000 AS src_port, 5000 AS dst_port, 17 AS proto, CAST(40 + floor(l_quantity * 20) AS INTEGER) AS ip_len
  FROM lineitem),
canon AS (
  SELECT *, CASE WHEN src_ip_n <= dst_ip_n THEN src_ip_n ELSE dst_ip_n END AS ip1, src_port AS port1, CASE WHEN src_ip_n <= dst_ip_n THEN dst_ip_n ELSE src_ip_n END AS ip2, dst_port AS port2 FROM packets),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY ip1, port1, ip2, port2, proto ORDER BY ts_us, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, count(*) OVER (PARTITION BY ip1, port1, ip2, port2, proto) AS packets
  FROM canon)"""

K = "ip1, port1, ip2, port2, proto"


def ip(c: str) -> str:
    return f"(({c} >> 24) & 255)::VARCHAR || '.' || (({c} >> 16) & 255)::VARCHAR || '.' || (({c} >> 8) & 255)::VARCHAR || '.' || ({c} & 255)::VARCHAR"


def swap(c: str) -> str:
    return f"(({c} & 255) * 16777216 + (({c} >> 8) & 255) * 65536 + (({c} >> 16) & 255) * 256 + (({c} >> 24) & 255))"


def fnv() -> str:
    text = f"printf('%08x%04x%08x%04x%02x', {swap('ip1')}, port1, {swap('ip2')}, port2, proto)"
    return f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


SESSIONS = f"""
gaps AS (SELECT *, ts_us // 1000000 AS sec, ts_us // 1000000 - lag(ts_us // 1000000) OVER (PARTITION BY {K} ORDER BY pkt_no) AS gap FROM canon WHERE proto = 17),
sess AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= {{idle}} THEN 1 ELSE 0 END) OVER (PARTITION BY {K} ORDER BY pkt_no) AS session_no FROM gaps)"""

RECORDS_SQL = f"""{EVENTS}, {SESSIONS.format(idle=IDLE)},
firsts AS (SELECT *, row_number() OVER s AS n, count(*) OVER (PARTITION BY {K}, session_no) AS total, first_value(src_ip_n) OVER s AS cli_ip, first_value(src_port) OVER s AS cli_port, first_value(dst_ip_n) OVER s AS srv_ip, first_value(dst_port) OVER s AS srv_port, first_value(ts_us) OVER s AS ts0
  FROM sess WINDOW s AS (PARTITION BY {K}, session_no ORDER BY pkt_no)),
records AS (SELECT {K}, session_no, any_value(cli_ip) AS cli_ip, any_value(cli_port) AS cli_port, any_value(srv_ip) AS srv_ip, any_value(srv_port) AS srv_port, count(*) AS count, any_value(total) AS total,
    list(ts_us / 1e6 - ts0 / 1e6 ORDER BY pkt_no) AS ts, list(CASE WHEN src_ip_n = cli_ip AND src_port = cli_port THEN ip_len ELSE -ip_len END ORDER BY pkt_no) AS len
  FROM firsts WHERE n <= {CAP} GROUP BY {K}, session_no)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.packets_from_events(spark, sf_dir)


def canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.canon_numeric(events(spark, sf_dir))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.canon_numeric(adapters.packets_from_lineitem(spark, sf_dir))


# ---- totals, keys, hashes ----------------------------------------------------------------------------------------


@query(f"WITH {EVENTS} SELECT count(*) AS packets, sum(ip_len)::BIGINT AS bytes, count(DISTINCT ({K})) AS flows, sum(CASE WHEN proto = 6 THEN 1 ELSE 0 END)::BIGINT AS tcp_packets, sum(CASE WHEN proto = 17 THEN 1 ELSE 0 END)::BIGINT AS udp_packets FROM canon")
def traffic_totals(spark, sf_dir):
    return flows.totals(events(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT {K}, count(*) AS packets, sum(ip_len)::BIGINT AS bytes, min(ts_us) AS first_us, max(ts_us) AS last_us FROM canon GROUP BY {K}")
def packet_counts(spark, sf_dir):
    return flows.packet_counts(canon(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT src_ip_n AS ip1, src_port AS port1, dst_ip_n AS ip2, dst_port AS port2, proto, count(*) AS packets FROM packets GROUP BY ALL")
def directional_counts(spark, sf_dir):
    return keys.directional(events(spark, sf_dir)).groupBy(*KEY).agg(F.count("*").alias("packets"))


def _first(cond: str) -> str:
    return f"CASE WHEN {cond} THEN {ip('src_ip_n')} || ':' || src_port::VARCHAR ELSE {ip('dst_ip_n')} || ':' || dst_port::VARCHAR END"


def _wire(c: str) -> str:
    return f"(({c} & 255) * 256 + (({c} >> 8) & 255))"


@query(
    f"""WITH {EVENTS}, t AS (SELECT DISTINCT src_ip_n, src_port, dst_ip_n, dst_port, proto FROM packets)
SELECT {ip('src_ip_n')} AS src, src_port, {ip('dst_ip_n')} AS dst, dst_port, proto, {_first('src_ip_n < dst_ip_n OR (src_ip_n = dst_ip_n AND src_port <= dst_port)')} AS first_numeric,
  {_first(f"{swap('src_ip_n')} < {swap('dst_ip_n')} OR (src_ip_n = dst_ip_n AND {_wire('src_port')} <= {_wire('dst_port')})")} AS first_raw,
  {_first(f"({ip('src_ip_n')}) < ({ip('dst_ip_n')}) OR (src_ip_n = dst_ip_n AND src_port <= dst_port)")} AS first_lex, {_first(f"({ip('src_ip_n')}) < ({ip('dst_ip_n')}) OR (src_ip_n = dst_ip_n AND src_port <= dst_port)")} AS first_endpoint FROM t"""
)
def canonical_keys(spark, sf_dir):
    t = events(spark, sf_dir).select("src_ip_n", "src_port", "dst_ip_n", "dst_port", "proto").distinct()
    for name in ("numeric", "raw", "lex", "endpoint"):
        t = keys.CANONS[name](t).withColumn(f"first_{name}", F.concat(keys.ip_text(F.col("ip1")), F.lit(":"), F.col("port1").cast("string"))).drop("ip1", "port1", "ip2", "port2")
    return t.select(keys.ip_text(F.col("src_ip_n")).alias("src"), "src_port", keys.ip_text(F.col("dst_ip_n")).alias("dst"), "dst_port", "proto", "first_numeric", "first_raw", "first_lex", "first_endpoint")


HASHED = f"{EVENTS}, per_flow AS (SELECT {K}, count(*) AS packets FROM canon GROUP BY {K}), hashed AS (SELECT *, {fnv()} AS hash FROM per_flow), buckets AS (SELECT *, hash & {BUCKETS - 1} AS bucket FROM hashed)"


@query(f"WITH {HASHED} SELECT {K}, packets, hash, bucket, hash & 4095 AS bucket_4096 FROM buckets")
def fnv_buckets(spark, sf_dir):
    return groundtruth.flow_buckets(canon(spark, sf_dir), BUCKETS).withColumn("bucket_4096", F.col("hash").bitwiseAND(4095))


_mix_1 = "xor(x, x >> 16)"
_mul = lambda x, m: f"((({x} & 65535) * {m} + ((({x} >> 16) * {m} & 65535) << 16)) & 4294967295)"


@query(f"WITH {HASHED}, a AS (SELECT hash AS x FROM hashed), b AS (SELECT x, {_mul(_mix_1, keys.MIX_1)} AS y FROM a), c AS (SELECT x, {_mul('xor(y, y >> 15)', keys.MIX_2)} AS z FROM b) SELECT x AS hash, xor(z, z >> 16) AS mixed FROM c")
def mix32_of_hashes(spark, sf_dir):
    return groundtruth.flow_buckets(canon(spark, sf_dir), BUCKETS).select("hash", keys.mix32(F.col("hash")).alias("mixed"))


_FIELDS = "2166136261::BIGINT"
for _c in (swap("ip1"), swap("ip2"), "port1", "port2", "proto"):
    _FIELDS = f"((xor({_FIELDS}, ({_c})::BIGINT) * 16777619) & 4294967295)"


@query(
    f"""WITH {EVENTS}, k AS (SELECT DISTINCT {K} FROM canon WHERE proto = 17), o AS (SELECT *, {_FIELDS} AS one FROM k), a AS (SELECT *, xor(one, {keys.BLOOM_XOR}) AS x FROM o), b AS (SELECT *, {_mul(_mix_1, keys.MIX_1)} AS y FROM a),
c AS (SELECT *, {_mul('xor(y, y >> 15)', keys.MIX_2)} AS z FROM b), d AS (SELECT *, CASE WHEN xor(z, z >> 16) = 0 THEN {keys.BLOOM_STEP} ELSE xor(z, z >> 16) END AS two FROM c)
SELECT {K}, one AS field_hash, i::INTEGER AS i, (one + i * two) & 16383 AS position FROM d, (SELECT unnest(range(4)) AS i)"""
)
def bloom_positions(spark, sf_dir):
    k = canon(spark, sf_dir).where("proto = 17").select(*KEY).distinct()
    return k.select(*KEY, keys.fnv_fields().alias("field_hash"), F.posexplode(keys.bloom_positions(16384, 4)).alias("i", "position"))


@query(
    f"""WITH p AS ({SQL['bloom_positions']}) SELECT position >> 6 AS word, bit_or(1::BIGINT << (position & 62)::INTEGER) AS bits, count(*) AS positions, max((position & 1)::INTEGER) AS odd FROM p GROUP BY 1"""
)
def bloom_words(spark, sf_dir):
    # of each 64-bit word only the even bits, as a number of SQL has no sign bit to set
    p = bloom_positions(spark, sf_dir)
    words = p.groupBy(F.shiftright("position", 6).alias("word")).agg(keys.bit_set(F.col("position").bitwiseAND(62)).alias("bits"), F.count("*").alias("positions"), F.max(keys.has_bit(F.col("position"), F.lit(0)).cast("int")).alias("odd"))
    return words


_product = lambda x, m: f"((({x} >> 32)::HUGEINT * {m} % 4294967296 * 4294967296 + ({x} & 4294967295)::HUGEINT * {m}) % 18446744073709551616)::UBIGINT"


@query(
    f"""WITH {EVENTS}, k AS (SELECT DISTINCT {K} FROM canon), a AS (SELECT *, xor(xor(xor((({swap('ip1')})::UBIGINT << 32), ({swap('ip2')})::UBIGINT), xor(port1::UBIGINT << 48, port2::UBIGINT << 32)), proto::UBIGINT) AS x FROM k),
b AS (SELECT *, {_product('xor(x, x >> 33)', keys.MIX64_1)} AS y FROM a), c AS (SELECT *, {_product('xor(y, y >> 33)', keys.MIX64_2)} AS z FROM b), d AS (SELECT *, xor(z, z >> 33) AS w FROM c)
SELECT {K}, CASE WHEN w = 0 THEN 1 WHEN w >= 9223372036854775808 THEN (w::HUGEINT - 18446744073709551616)::BIGINT ELSE w::BIGINT END AS signature FROM d"""
)
def key_signatures(spark, sf_dir):
    return canon(spark, sf_dir).select(*KEY).distinct().withColumn("signature", keys.signature())


@query(f"WITH {HASHED} SELECT proto, bucket, count(*) AS flows, sum(packets)::BIGINT AS packets FROM buckets GROUP BY proto, bucket")
def bucket_occupancy(spark, sf_dir):
    return groundtruth.occupancy(canon(spark, sf_dir), BUCKETS)


@query(f"WITH {HASHED} SELECT proto, bucket, count(*) AS flows, (count(*) * (count(*) - 1) // 2)::BIGINT AS pairs FROM buckets GROUP BY proto, bucket")
def bucket_contention_pairs(spark, sf_dir):
    return groundtruth.contention(canon(spark, sf_dir), BUCKETS)


@query(
    f"""WITH {EVENTS}, t AS (SELECT pkt_no, tcp_flags, CASE WHEN tcp_flags & 1 <> 0 THEN 1 ELSE 0 END AS fin, CASE WHEN tcp_flags & 2 <> 0 THEN 1 ELSE 0 END AS syn, CASE WHEN tcp_flags & 4 <> 0 THEN 1 ELSE 0 END AS rst, CASE WHEN tcp_flags & 16 <> 0 THEN 1 ELSE 0 END AS ack FROM packets WHERE proto = 6)
SELECT *, 'FIN:' || fin || ', SYN:' || syn || ', RST:' || rst || ', ACK:' || ack AS flags_text FROM t"""
)
def tcp_flag_decode(spark, sf_dir):
    return flows.decoded_flags(events(spark, sf_dir))


@query(
    f"""WITH {EVENTS} SELECT (ts_us // 1000000)::VARCHAR || '.' || lpad((ts_us % 1000000)::VARCHAR, 6, '0') AS timestamp, {ip('src_ip_n')} AS src_ip, {ip('dst_ip_n')} AS dst_ip, src_port::VARCHAR AS src_port, dst_port::VARCHAR AS dst_port,
CASE WHEN proto = 17 THEN 'UDP' ELSE 'TCP' END AS protocol, ip_len::VARCHAR AS packet_length, tcp_flags::VARCHAR AS tcp_flags FROM packets"""
)
def packet_strings(spark, sf_dir):
    return flows.as_text(events(spark, sf_dir))


# ---- sessions and records ----------------------------------------------------------------------------------------


@query(f"WITH {EVENTS}, {SESSIONS.format(idle=SHORT_IDLE)} SELECT {K}, session_no::BIGINT AS session_no, count(*) AS packets, min(ts_us) AS first_us, max(ts_us) AS last_us FROM sess GROUP BY {K}, session_no")
def udp_sessions_wheel(spark, sf_dir):
    s = sessions.udp_sessions_wheel(canon(spark, sf_dir).where("proto = 17"), SHORT_IDLE)
    return s.groupBy(*KEY, "session_no").agg(F.count("*").alias("packets"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


@query(
    f"""WITH {EVENTS}, seen AS (SELECT *, ts_us // 1000000 AS sec, lag(ts_us // 1000000) OVER (ORDER BY pkt_no) AS prev_sec FROM canon),
gaps AS (SELECT *, prev_sec - lag(sec) OVER (PARTITION BY {K} ORDER BY pkt_no) AS gap FROM seen WHERE proto = 17),
sess AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= {SHORT_IDLE} THEN 1 ELSE 0 END) OVER (PARTITION BY {K} ORDER BY pkt_no) AS session_no FROM gaps)
SELECT {K}, session_no::BIGINT AS session_no, count(*) AS packets, min(ts_us) AS first_us, max(ts_us) AS last_us FROM sess GROUP BY {K}, session_no"""
)
def udp_sessions_scan(spark, sf_dir):
    every = canon(spark, sf_dir)
    seen = sessions.previous_second(every).where("proto = 17")
    gap = F.col("prev_sec") - F.lag("sec").over(sessions.by_flow())
    s = sessions.numbered(seen, F.coalesce(gap >= SHORT_IDLE, F.lit(True)))
    return s.groupBy(*KEY, "session_no").agg(F.count("*").alias("packets"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


@query(f"WITH {EVENTS} SELECT pkt_no, ts_us, max((ts_us + CASE WHEN pkt_no % 3 = 0 THEN -7200000000 ELSE 0 END) // 1000000) OVER (ORDER BY pkt_no) AS clock FROM packets")
def wheel_clock(spark, sf_dir):
    # every third packet is made two hours late
    late = events(spark, sf_dir).withColumn("own_us", F.col("ts_us")).withColumn("ts_us", F.col("ts_us") - F.when(F.col("pkt_no") % 3 == 0, 7200000000).otherwise(0))
    return sessions.wheel_clock(late).select("pkt_no", F.col("own_us").alias("ts_us"), "clock")


#: Every eleventh packet comes late, some by more than the wheel is round.
_LATE = "CASE WHEN pkt_no % 11 = 0 THEN 100000000000 + pkt_no % 7 * 10000000000 ELSE 0 END"
_WHEEL = 1 << 16


@query(
    f"""WITH {EVENTS}, late AS (SELECT * REPLACE (ts_us - {_LATE} AS ts_us) FROM canon), c AS (SELECT *, ts_us // 1000000 AS sec, max(ts_us // 1000000) OVER (ORDER BY pkt_no) AS clock FROM late),
e AS (SELECT *, lag(clock + ((sec + {SHORT_IDLE} - clock - 1) % {_WHEEL} + {_WHEEL}) % {_WHEEL} + 1) OVER (PARTITION BY {K} ORDER BY pkt_no) AS ends FROM c WHERE proto = 17),
s AS (SELECT *, sum(CASE WHEN ends IS NULL OR clock >= ends THEN 1 ELSE 0 END) OVER (PARTITION BY {K} ORDER BY pkt_no) AS session_no FROM e)
SELECT {K}, session_no::BIGINT AS session_no, count(*) AS packets, min(pkt_no) AS first_pkt FROM s GROUP BY {K}, session_no"""
)
def udp_sessions_strict(spark, sf_dir):
    late = F.when(F.col("pkt_no") % 11 == 0, F.lit(100_000_000_000) + F.col("pkt_no") % 7 * 10_000_000_000).otherwise(0)
    s = sessions.udp_sessions_strict(canon(spark, sf_dir).withColumn("ts_us", F.col("ts_us") - late), SHORT_IDLE, _WHEEL)
    return s.groupBy(*KEY, "session_no").agg(F.count("*").alias("packets"), F.min("pkt_no").alias("first_pkt"))


@query(f"WITH {EVENTS}, t AS (SELECT *, pkt_no % 4 AS file FROM canon), f AS (SELECT {K}, count(*) AS n, count(DISTINCT file) AS files FROM t GROUP BY {K}) SELECT (SELECT count(DISTINCT file) FROM t) AS files, sum(n)::BIGINT AS packets, sum(n)::BIGINT AS parsed_packets, count(*) AS unique_flows, sum((files > 1)::INTEGER)::BIGINT AS flows_in_several_files FROM f")
def file_counters(spark, sf_dir):
    return flows.file_counters(events(spark, sf_dir).withColumn("file", (F.col("pkt_no") % 4).cast("string")))


@query(
    f"""WITH {EVENTS}, s AS (SELECT *, max(CASE WHEN tcp_flags & 2 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {K} ORDER BY pkt_no) AS syn, max(CASE WHEN tcp_flags = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY {K} ORDER BY pkt_no) AS pure FROM canon WHERE proto = 6)
SELECT {K}, count(*) AS packets, sum(syn)::BIGINT AS after_syn, sum(pure)::BIGINT AS after_pure_syn FROM s GROUP BY {K}"""
)
def syn_gate(spark, sf_dir):
    p = canon(spark, sf_dir).where("proto = 6")
    w = sessions.by_flow()
    s = p.withColumn("syn", F.max(sessions.is_syn().cast("int")).over(w)).withColumn("pure", F.max(sessions.is_syn(True).cast("int")).over(w))
    return s.groupBy(*KEY).agg(F.count("*").alias("packets"), F.sum("syn").alias("after_syn"), F.sum("pure").alias("after_pure_syn"))


@query(
    f"""WITH {EVENTS}, both_ends AS (SELECT * REPLACE (CASE WHEN tcp_flags = 16 AND src_ip_n > 3232235519 AND ip_len % 5 = 0 THEN 17 ELSE tcp_flags END AS tcp_flags) FROM canon WHERE proto = 6),
s AS (SELECT *, max(CASE WHEN tcp_flags & 2 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {K} ORDER BY pkt_no) AS syn FROM both_ends),
m AS (SELECT *, row_number() OVER w AS n, src_ip_n = first_value(src_ip_n) OVER w AND src_port = first_value(src_port) OVER w AS mine, tcp_flags & 1 <> 0 AS fin FROM s WHERE syn = 1 WINDOW w AS (PARTITION BY {K} ORDER BY pkt_no)),
f AS (SELECT *, max(CASE WHEN fin AND mine THEN 1 ELSE 0 END) OVER w AS fc, max(CASE WHEN fin AND NOT mine THEN 1 ELSE 0 END) OVER w AS fs FROM m WINDOW w AS (PARTITION BY {K} ORDER BY pkt_no)),
e AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY pkt_no) AS r FROM f WHERE fin AND fc = 1 AND fs = 1 AND n >= 12)
SELECT {K}, pkt_no AS end_pkt_no, n AS packets FROM e WHERE r = 1"""
)
def tcp_fin_flush(spark, sf_dir):
    # in this trace servers never say FIN: some of their packets are made to
    says = (F.col("tcp_flags") == 16) & (F.col("src_ip_n") > 3232235519) & (F.col("ip_len") % 5 == 0)
    return sessions.tcp_fin_both(canon(spark, sf_dir).withColumn("tcp_flags", F.when(says, 17).otherwise(F.col("tcp_flags"))), 12)


@query(
    f"""WITH {EVENTS}, s AS (SELECT *, coalesce(sum(CASE WHEN tcp_flags & 1 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {K} ORDER BY pkt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS session_no FROM canon WHERE proto = 6)
SELECT {K}, session_no::BIGINT AS session_no, count(*) AS packets FROM s GROUP BY {K}, session_no"""
)
def tcp_any_fin_sessions(spark, sf_dir):
    return sessions.tcp_any_fin(canon(spark, sf_dir))


def _records(spark, sf_dir):
    return flows.flow_records(events(spark, sf_dir).where("proto = 17"), CAP, IDLE)


@query(f"WITH {RECORDS_SQL} SELECT {K}, session_no::BIGINT AS session_no, cli_ip, cli_port, srv_ip, srv_port, count, total, array_to_string(list_transform(ts, lambda x: CAST(round(x * 1e6) AS BIGINT)), ' ') AS offsets_us, array_to_string(len, ' ') AS lengths FROM records")
def flow_records(spark, sf_dir):
    r = _records(spark, sf_dir)
    us = F.transform("ts", lambda x: F.round(x * 1e6).cast("long").cast("string"))
    return r.select(*KEY, "session_no", "cli_ip", "cli_port", "srv_ip", "srv_port", "count", "total", F.array_join(us, " ").alias("offsets_us"), F.array_join(F.transform("len", lambda x: x.cast("string")), " ").alias("lengths"))


_ID = f"{ip('ip1')} || port1::VARCHAR || {ip('ip2')} || port2::VARCHAR || CASE WHEN proto = 17 THEN 'UDP' ELSE 'TCP' END"


@query(
    f"""WITH {RECORDS_SQL}, full_ones AS (SELECT *, {_ID} AS flow_id FROM records WHERE count = {CAP})
SELECT flow_id, proto, flow_id || ',"[' || array_to_string(list_transform(list_zip(ts, len), lambda x: '(' || printf('%.6f', CASE WHEN x[2] < 0 THEN -x[1] ELSE x[1] END) || ', ' || printf('%.1f', x[2]::DOUBLE) || ')'), ', ') || ']"' AS line FROM full_ones"""
)
def flow_csv_lines(spark, sf_dir):
    return flows.csv_lines(_records(spark, sf_dir), CAP)


@query()
def flow_json(spark, sf_dir):
    return flows.json_records(_records(spark, sf_dir))


@query()
def flow_messages(spark, sf_dir):
    return flows.messages(_records(spark, sf_dir))


_US = "array_to_string(list_transform(ts, lambda x: CAST(round(x * 1e6) AS BIGINT)), ' ') AS offsets_us, array_to_string(len, ' ') AS lengths"


def _us():
    return F.array_join(F.transform("ts", lambda x: F.round(x * 1e6).cast("long").cast("string")), " ").alias("offsets_us"), F.array_join(F.transform("len", lambda x: x.cast("string")), " ").alias("lengths")


#: Messages as a worker reads them: written as JSON, in batches, and parsed again.
@query(f"WITH {RECORDS_SQL} SELECT {ip('cli_ip')} AS cli_ip, {ip('srv_ip')} AS srv_ip, cli_port, srv_port, 'UDP' AS proto, count::INTEGER AS count, {_US} FROM records")
def flow_messages_read(spark, sf_dir):
    read = jobs.parse_messages(flows.messages(_records(spark, sf_dir)).select(F.col("message").alias("value")))
    return read.select("cli_ip", "srv_ip", "cli_port", "srv_port", "proto", "count", *_us())


#: The sizes of message batches, by the flows' hash.
@query(
    f"""WITH {RECORDS_SQL}, h AS (SELECT {fnv()} & 63 AS part FROM records), c AS (SELECT part, count(*) AS n FROM h GROUP BY part)
SELECT part, batch_no, least(16, n - 16 * batch_no) AS flows_in FROM (SELECT part, n, unnest(range((n + 15) // 16)) AS batch_no FROM c)"""
)
def message_batches(spark, sf_dir):
    return flows.messages(_records(spark, sf_dir)).select("part", "batch_no", "flows_in")


@query(
    f"""WITH {RECORDS_SQL} SELECT {K}, session_no::BIGINT AS session_no, '=== Flow ' || {ip('cli_ip')} || ':' || cli_port::VARCHAR || ' \u21c6 ' || {ip('srv_ip')} || ':' || srv_port::VARCHAR || ' (UDP) packets:' || count::VARCHAR || ' ===' || chr(10)
  || array_to_string(list_transform(list_zip(ts, len), lambda x: printf('%.6f', x[1]) || '  len=' || x[2]::VARCHAR), chr(10)) AS text FROM records"""
)
def flow_dump(spark, sf_dir):
    return flows.dump_text(_records(spark, sf_dir))


#: TCP packets of a trace in which servers say FIN, too.
_BOTH_FINS = "both_ends AS (SELECT * REPLACE (CASE WHEN tcp_flags = 16 AND src_ip_n > 3232235519 AND ip_len % 5 = 0 THEN 17 ELSE tcp_flags END AS tcp_flags) FROM canon WHERE proto = 6)"


@query(
    f"""WITH RECURSIVE {EVENTS}, {_BOTH_FINS}, q AS (SELECT {K}, row_number() OVER (PARTITION BY {K} ORDER BY pkt_no) AS rn, ts_us, src_ip_n AS a, src_port AS p, dst_ip_n AS b, dst_port AS d, ip_len, tcp_flags & 2 <> 0 AS syn, tcp_flags & 1 <> 0 AS fin FROM both_ends),
s AS (
  SELECT DISTINCT {K}, 0::BIGINT AS rn, 0::BIGINT AS session_no, false AS is_open, 0::BIGINT AS cli_ip, 0 AS cli_port, 0::BIGINT AS srv_ip, 0 AS srv_port, 0::BIGINT AS total, []::BIGINT[] AS ts, []::INTEGER[] AS lens, false AS fc, false AS fs, false AS done FROM q
  UNION ALL
  SELECT ip1, port1, ip2, port2, proto, rn, session_no, here AND NOT ends, cli_ip, cli_port, srv_ip, srv_port, total, ts, lens, fc, fs, ends
  FROM (SELECT *, coalesce(here AND fin AND fc AND fs AND len(ts) = 12, false) AS ends
    FROM (SELECT ip1, port1, ip2, port2, proto, rn, session_no, here, cli_ip, cli_port, srv_ip, srv_port, CASE WHEN here THEN total + 1 ELSE total END AS total, fin, CASE WHEN here AND len(ts) < 12 THEN list_append(ts, ts_us) ELSE ts END AS ts,
        CASE WHEN here AND len(lens) < 12 THEN list_append(lens, CASE WHEN mine THEN ip_len ELSE -ip_len END) ELSE lens END AS lens, fc OR (here AND fin AND mine) AS fc, fs OR (here AND fin AND NOT mine) AS fs
      FROM (SELECT *, a = cli_ip AND p = cli_port AS mine
        FROM (SELECT s.ip1, s.port1, s.ip2, s.port2, s.proto, q.rn, s.is_open OR q.syn AS here, CASE WHEN NOT s.is_open AND q.syn THEN s.session_no + 1 ELSE s.session_no END AS session_no, q.ts_us, q.a, q.p, q.ip_len, q.fin,
            CASE WHEN s.is_open THEN s.cli_ip ELSE q.a END AS cli_ip, CASE WHEN s.is_open THEN s.cli_port ELSE q.p END AS cli_port, CASE WHEN s.is_open THEN s.srv_ip ELSE q.b END AS srv_ip, CASE WHEN s.is_open THEN s.srv_port ELSE q.d END AS srv_port,
            CASE WHEN s.is_open THEN s.total ELSE 0 END AS total, CASE WHEN s.is_open THEN s.ts ELSE [] END AS ts, CASE WHEN s.is_open THEN s.lens ELSE [] END AS lens, s.is_open AND s.fc AS fc, s.is_open AND s.fs AS fs
          FROM s JOIN q ON {' AND '.join(f'q.{k} = s.{k}' for k in KEY)} AND q.rn = s.rn + 1)))))
SELECT {K}, session_no, cli_ip, cli_port, srv_ip, srv_port, 12::BIGINT AS count, total, array_to_string(list_transform(ts, lambda x: x - ts[1]), ' ') AS offsets_us, array_to_string(lens, ' ') AS lengths FROM s WHERE done"""
)
def tcp_flow_records(spark, sf_dir):
    says = (F.col("tcp_flags") == 16) & (F.col("src_ip_n") > 3232235519) & (F.col("ip_len") % 5 == 0)
    r = flows.tcp_flow_records(events(spark, sf_dir).withColumn("tcp_flags", F.when(says, 17).otherwise(F.col("tcp_flags"))), 12)
    return r.select(*KEY, "session_no", "cli_ip", "cli_port", "srv_ip", "srv_port", "count", "total", *_us())


@query(f"WITH {EVENTS} SELECT pkt_no, {K}, ts_us - lag(ts_us) OVER w AS gap_us, ts_us - first_value(ts_us) OVER w AS offset_us, row_number() OVER w AS n FROM canon WINDOW w AS (PARTITION BY {K} ORDER BY pkt_no)")
def inter_arrival(spark, sf_dir):
    return flows.inter_arrival(canon(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT {K}, min(pkt_no) AS admitted_at, count(*) AS packets FROM canon WHERE proto = 17 GROUP BY {K}")
def bloom_gate_dedup(spark, sf_dir):
    return flows.admitted_once(canon(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT {K}, count(*) AS packets, sum(ip_len)::BIGINT AS bytes, min(pkt_no) AS first_pkt FROM canon GROUP BY {K} ORDER BY first_pkt LIMIT 100")
def max_flows_admission(spark, sf_dir):
    return flows.max_flows(canon(spark, sf_dir), 100)


# ---- features, labels, evaluation ----------------------------------------------------------------------------------


def _features_sql(n: int, digits: int = 6) -> str:
    r = lambda x, name: f"round({x}, {digits}) AS {name}"
    sums = f"list_reduce(list_prepend(0.0::DOUBLE, size), lambda a, b: a + b)"
    gsum = f"list_reduce(list_prepend(0.0::DOUBLE, gaps), lambda a, b: a + b)"
    spread = lambda a, mean, k: f"sqrt(greatest(0, list_reduce(list_prepend(0.0::DOUBLE, list_transform({a}, lambda x: (x - {mean}) * (x - {mean}))), lambda a, b: a + b) / {k}))"
    cols = [r(f"size[{i}]", f"s{i}") for i in range(1, n + 1)] + [r(f"gaps[{i}]", f"dt{i + 1}") for i in range(1, n)]
    cols += [r("mean_s", "mean_size"), r(spread("size", "mean_s", n), "std_size"), r("list_min(size)", "min_size"), r("list_max(size)", "max_size"), r("sum_s", "sum_size"), r("mean_g", "mean_dt"), r(spread("gaps", "mean_g", n - 1), "std_dt"), r("list_min(gaps)", "min_dt"), r("list_max(gaps)", "max_dt"), r("span", f"span_{n}"), r(f"{n} / (span + 1e-9)", f"pps_{n}"), r("sum_s / (span + 1e-9)", f"bps_{n}")]
    return f"""{LINES}, held AS (SELECT {K}, any_value(packets) AS packets, list(ts_us / 1e6 ORDER BY n) AS ts, list(ip_len::DOUBLE ORDER BY n) AS size FROM numbered WHERE n <= {n} AND packets >= {n} GROUP BY {K}),
gapped AS (SELECT *, list_transform(list_zip(ts[2:], ts[:-2]), lambda x: x[1] - x[2]) AS gaps, ts[{n}] - ts[1] AS span FROM held),
sums AS (SELECT *, {sums} AS sum_s, {sums} / {n} AS mean_s, {gsum} / {n - 1} AS mean_g FROM gapped)
SELECT {K}, {', '.join(cols)}, CASE WHEN packets >= 40 THEN 1 ELSE 0 END AS label FROM sums"""


def _first_features(spark, sf_dir, n):
    return features.first_n_features(features.first_packets(lines(spark, sf_dir), n, LINE_ORDER), n, 4)


@query(f"WITH {_features_sql(8, 4)}")
def first8_features(spark, sf_dir):
    return _first_features(spark, sf_dir, 8)


@query(f"WITH {_features_sql(5, 4)}")
def firstn_features_n5(spark, sf_dir):
    return _first_features(spark, sf_dir, 5)


@query(f"WITH {LINES} SELECT {K}, count(*) AS packets, CASE WHEN count(*) >= 40 THEN 1 ELSE 0 END AS label FROM canon GROUP BY {K}")
def labels_ge40(spark, sf_dir):
    return lines(spark, sf_dir).groupBy(*KEY).agg(F.count("*").alias("packets")).withColumn("label", features.label())


@query(
    f"""WITH {EVENTS}, m AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY pkt_no) AS n FROM canon),
g AS (SELECT {K}, count(*) AS pkts, min_by(ts_us, n) AS first_ts_us, max(CASE WHEN n = 30 THEN ts_us END) AS hit, max_by(ts_us, n) AS last_ts_us FROM m GROUP BY {K})
SELECT {K}, pkts, CASE WHEN pkts >= 40 THEN 1 ELSE 0 END AS ge40, first_ts_us, coalesce(hit, 0) AS hit30_ts_us, last_ts_us, coalesce(hit - first_ts_us, 0) AS dur_to_30_us, coalesce(last_ts_us - hit, 0) AS dur_30_to_last_us, last_ts_us - first_ts_us AS dur_total_us FROM g"""
)
def flow_timing_hit30(spark, sf_dir):
    return groundtruth.timing(canon(spark, sf_dir))


#: A score that both engines compute alike: pseudo-random by key, higher for long flows.
_P = "(((ip1 * 7919 + ip2 * 104729 + packets * 31) % 1000) / 1000.0 + CASE WHEN packets >= 40 THEN 1 ELSE 0 END) / 2"
SCORED = f"{LINES}, counted AS (SELECT {K}, count(*) AS packets, sum(ip_len) AS bytes FROM canon GROUP BY {K}), scored AS (SELECT {K}, packets, bytes, CASE WHEN packets >= 40 THEN 1 ELSE 0 END AS label, ({_P})::DOUBLE AS p FROM counted)"


def scored(spark, sf_dir):
    c = lines(spark, sf_dir).groupBy(*KEY).agg(F.count("*").alias("packets"), F.sum("ip_len").cast("long").alias("bytes")).withColumn("label", features.label())
    return c.withColumn("p", ((F.col("ip1") * 7919 + F.col("ip2") * 104729 + F.col("packets") * 31) % 1000 / F.lit(1000.0) + F.col("label")) / 2)


def _prf(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> str:
    p, r = f"(CASE WHEN {tp} + {fp} = 0 THEN 0.0 ELSE {tp}::DOUBLE / ({tp} + {fp}) END)", f"(CASE WHEN {tp} + {fn} = 0 THEN 0.0 ELSE {tp}::DOUBLE / ({tp} + {fn}) END)"
    return f"round({p}, 6) AS precision, round({r}, 6) AS recall, round(CASE WHEN {p} + {r} = 0 THEN 0.0 ELSE 2 * {p} * {r} / ({p} + {r}) END, 6) AS f1"


_CELLS = "count(*) FILTER (p >= {t} AND label = 1) AS tp, count(*) FILTER (p >= {t} AND label = 0) AS fp, count(*) FILTER (p < {t} AND label = 1) AS fn, count(*) FILTER (p < {t} AND label = 0) AS tn"


@query(f"WITH {SCORED}, c AS (SELECT {_CELLS.format(t='0.5')} FROM scored) SELECT *, {_prf()} FROM c")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion(scored(spark, sf_dir))


@query(f"WITH {SCORED}, t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS threshold), c AS (SELECT threshold, {_CELLS.format(t='threshold')} FROM scored, t GROUP BY threshold) SELECT *, {_prf()} FROM c")
def threshold_sweep(spark, sf_dir):
    return evaluate.sweep(scored(spark, sf_dir))


@query(
    f"""WITH {SCORED}, g AS (SELECT p, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY p), c AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM g),
t AS (SELECT sum(pos)::DOUBLE AS np, sum(neg)::DOUBLE AS nn, sum(pos * tp::DOUBLE / (tp + fp)) AS ap, sum(pos * fp - pos * neg / 2.0)::DOUBLE AS above FROM c)
SELECT round(ap / np, 6) AS pr_auc, round(1.0 - above / (np * nn), 6) AS roc_auc, round(np / (np + nn), 6) AS positive_rate FROM t"""
)
def average_precision(spark, sf_dir):
    return evaluate.areas(scored(spark, sf_dir))


@query(f"WITH {SCORED} SELECT round(sum(CASE WHEN (p >= 0.5) = (label = 1) THEN bytes ELSE 0 END)::DOUBLE / sum(bytes), 6) AS weighted_accuracy, round(avg(CASE WHEN (p >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM scored")
def weighted_accuracy(spark, sf_dir):
    return evaluate.weighted_accuracy(scored(spark, sf_dir), "bytes")


@query(f"WITH {SCORED} SELECT {K}, packets, label, p FROM scored ORDER BY p DESC, ip1, ip2 LIMIT 50")
def topk_flows(spark, sf_dir):
    return evaluate.top_k(scored(spark, sf_dir).withColumn("tie", F.struct("ip1", "ip2")), 50, "tie").select(*KEY, "packets", "label", "p")


@query(f"WITH {SCORED} SELECT count(*) AS n, round(avg(packets), 6) AS mean, quantile_disc(packets, 0.25) AS p25, quantile_disc(packets, 0.5) AS p50, quantile_disc(packets, 0.75) AS p75 FROM scored")
def percentile_nearest_rank(spark, sf_dir):
    return evaluate.nearest_rank(scored(spark, sf_dir), "packets")


@query(f"WITH {SCORED} SELECT ((ip1 * 31 + ip2) % 5 = 0) AS held_out, count(*) AS flows, sum(label)::BIGINT AS positives FROM scored GROUP BY 1")
def group_split_counts(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.groupBy(((F.col("ip1") * 31 + F.col("ip2")) % 5 == 0).alias("held_out")).agg(F.count("*").alias("flows"), F.sum("label").cast("long").alias("positives"))


@query(
    f"""WITH {LINES}, d AS (SELECT {K}, count(*) AS packets, round(min(ts_us) / 1e6, 6) AS first_t, round(max(ts_us) / 1e6, 6) AS last_t, sum(ip_len)::DOUBLE AS bytes FROM canon GROUP BY {K})
SELECT 'trace.csv' AS "group", CASE WHEN ({ip('ip1')}) <= ({ip('ip2')}) THEN {ip('ip1')} ELSE {ip('ip2')} END AS ip1, port1, CASE WHEN ({ip('ip1')}) <= ({ip('ip2')}) THEN {ip('ip2')} ELSE {ip('ip1')} END AS ip2, port2, 'UDP' AS proto, packets, first_t, last_t, bytes FROM d"""
)
def training_csv_parse(spark, sf_dir):
    f = training.flows(training.parse(training.lines_of(adapters.packets_from_lineitem(spark, sf_dir))))
    return f.select("group", *KEY, "packets", F.round(F.array_min("ts"), 6).alias("first_t"), F.round(F.array_max("ts"), 6).alias("last_t"), features.total(F.col("size")).alias("bytes"))


# ---- traces ---------------------------------------------------------------------------------------------------------


@query(
    """WITH p AS (SELECT (o_custkey % 8)::INTEGER AS file_no, o_orderkey AS pkt_no, epoch_us(o_orderdate::TIMESTAMP) AS ts_us FROM orders), s AS (SELECT file_no, min(ts_us) AS first_us, max(ts_us) - min(ts_us) AS dur, file_no % 3 AS session_no FROM p GROUP BY file_no),
b AS (SELECT *, coalesce(sum(dur) OVER (PARTITION BY session_no ORDER BY file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base_us FROM s)
SELECT session_no, file_no, pkt_no, base_us + ts_us - first_us AS out_us FROM p JOIN b USING (file_no)"""
)
def merge_sessions(spark, sf_dir):
    return traces.merged(adapters.trace_files(spark, sf_dir), 3)


@query(
    """WITH RECURSIVE p AS (SELECT (o_custkey % 8)::INTEGER AS file_no, o_orderkey AS pkt_no, epoch_us(o_orderdate::TIMESTAMP) AS ts_us FROM orders),
d AS (SELECT file_no, min(ts_us) AS first_us, (max(ts_us) - min(ts_us))::BIGINT AS dur, row_number() OVER (ORDER BY file_no) AS n FROM p GROUP BY file_no),
s AS (SELECT 0::BIGINT AS n, [0, 0, 0]::BIGINT[] AS ends, NULL::INTEGER AS file_no, 0 AS session_no, 0::BIGINT AS base_us
  UNION ALL SELECT d.n, list_transform(s.ends, lambda e, i: CASE WHEN i = list_position(s.ends, list_min(s.ends)) THEN e + d.dur ELSE e END), d.file_no, list_position(s.ends, list_min(s.ends)) - 1, list_min(s.ends) FROM s JOIN d ON d.n = s.n + 1)
SELECT s.session_no::INTEGER AS session_no, p.file_no, p.pkt_no, s.base_us + p.ts_us - d.first_us AS out_us FROM p JOIN d USING (file_no) JOIN s ON s.file_no = p.file_no"""
)
def merge_sessions_dynamic(spark, sf_dir):
    return traces.merged_dynamic(adapters.trace_files(spark, sf_dir), 3)


#: Files in a drawn order, sessions that begin at drawn times; all packets in one order over sessions.
@query()
def merge_sessions_random(spark, sf_dir):
    return traces.in_time_order(traces.merged_dynamic(adapters.trace_files(spark, sf_dir), 3, seed=7))


@query(
    f"""WITH {EVENTS}, f AS (SELECT *, 'f' || (pkt_no % 3)::VARCHAR AS file FROM packets), m AS (SELECT *, 2550136833 + pkt_no % 3 AS target FROM f)
SELECT file, pkt_no, {ip('CASE WHEN src_ip_n // 65536 = 2560 THEN target - target % 256 + src_ip_n % 256 ELSE src_ip_n END')} AS src_ip, {ip('CASE WHEN dst_ip_n // 65536 = 2560 THEN target - target % 256 + dst_ip_n % 256 ELSE dst_ip_n END')} AS dst_ip, target FROM m"""
)
def ip_rewrite_files(spark, sf_dir):
    p = events(spark, sf_dir).withColumn("file", F.concat(F.lit("f"), (F.col("pkt_no") % 3).cast("string")))
    moved = traces.rewrite_files(p, 167772160, 16, 0x98000001, 24)
    return moved.select("file", "pkt_no", keys.ip_text(F.col("src_ip_n")).alias("src_ip"), keys.ip_text(F.col("dst_ip_n")).alias("dst_ip"), "target")


@query(
    f"""WITH {EVENTS}, f AS (SELECT 'f' || (pkt_no % 3)::VARCHAR AS file, pkt_no, {K}, ip_len FROM canon), t AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY file, pkt_no) AS n FROM f)
SELECT {K}, file, pkt_no, ip_len FROM t WHERE n = 3"""
)
def files_as_one_trace(spark, sf_dir):
    # the third packet of each flow over the files of a trace
    p = canon(spark, sf_dir).withColumn("file", F.concat(F.lit("f"), (F.col("pkt_no") % 3).cast("string")))
    t = traces.one_trace(p).withColumn("n", F.row_number().over(sessions.by_flow()))
    return t.where("n = 3").select(*KEY, "file", (F.col("pkt_no").bitwiseAND((1 << 40) - 1)).alias("pkt_no"), "ip_len")


@query(f"WITH {EVENTS} SELECT pkt_no, {ip('CASE WHEN src_ip_n // 65536 = 2560 THEN 2886795264 + src_ip_n % 65536 ELSE src_ip_n END')} AS src_ip, {ip('CASE WHEN dst_ip_n // 65536 = 2560 THEN 2886795264 + dst_ip_n % 65536 ELSE dst_ip_n END')} AS dst_ip FROM packets")
def ip_rewrite(spark, sf_dir):
    moved = traces.rewrite_prefix(events(spark, sf_dir), 167772160, 16, 2886795264)
    return moved.select("pkt_no", keys.ip_text(F.col("src_ip_n")).alias("src_ip"), keys.ip_text(F.col("dst_ip_n")).alias("dst_ip"))


# ---- policies -------------------------------------------------------------------------------------------------------

SMALL = Settings(buckets=BUCKETS, aux_buckets=BUCKETS, idle=IDLE)


def _policy(name: str, **options):
    def run(spark, sf_dir):
        r = catalog.run(events(spark, sf_dir), name, SMALL, **options)
        f = flows_of(r)
        return f.select("policy", "bucket", *KEY, "first_ts_us", "count", "wins", "total", "end_reason", "in_table", F.array_join(F.transform("ts", lambda x: x.cast("string")), " ").alias("offsets_us"), F.array_join(F.transform("len", lambda x: x.cast("string")), " ").alias("lengths"))

    run.__name__ = f"policy_{name}"
    return run


_FLOW = "STRUCT(ip1 BIGINT, port1 BIGINT, ip2 BIGINT, port2 BIGINT, proto BIGINT)"
_CLASH = f"STRUCT(pkt_no BIGINT, ts_us BIGINT, winner {_FLOW}, loser {_FLOW}, kept BOOLEAN)"


def _logged_sql(name: str) -> str:
    """The log of a recursion's collisions."""
    side = lambda x: ", ".join(f"clash.{x}.{k}{'::INTEGER' if 'port' in k else ''} AS {x}_{k}" for k in KEY[:4])
    return f" SELECT '{name}' AS policy, bucket, clash.winner.proto::INTEGER AS proto, clash.pkt_no AS pkt_no, clash.ts_us AS ts_us, {side('winner')}, {side('loser')}, clash.kept::INTEGER AS winner_was_incumbent FROM s WHERE clash IS NOT NULL"


def _draws_sql(seed: int) -> str:
    """CTEs up to draws(shard, bucket, n, draw): the counter generator, with products modulo 2^64 by halves."""
    product = lambda x, m: f"((({x} >> 32)::HUGEINT * {m} % 4294967296 * 4294967296 + ({x} & 4294967295)::HUGEINT * {m}) % 18446744073709551616)::UBIGINT"
    out = [f"z0 AS (SELECT o.shard, o.bucket, n.n, {seed}::UBIGINT AS z FROM opened o, (SELECT unnest(range((SELECT max(rn) FROM q)::BIGINT)) AS n) n)"]
    for i, part in enumerate(("shard", "bucket", "n")):
        out.append(f"a{i} AS (SELECT shard, bucket, n, ((xor(z, {part}::UBIGINT)::HUGEINT + {0x9E3779B97F4A7C15}) % 18446744073709551616)::UBIGINT AS z FROM z{i})")
        out.append(f"b{i} AS (SELECT shard, bucket, n, {product('xor(z, z >> 30)', 0xBF58476D1CE4E5B9)} AS z FROM a{i})")
        out.append(f"c{i} AS (SELECT shard, bucket, n, {product('xor(z, z >> 27)', 0x94D049BB133111EB)} AS z FROM b{i})")
        out.append(f"z{i + 1} AS (SELECT shard, bucket, n, xor(z, z >> 31) AS z FROM c{i})")
    return ", ".join(out) + ", draws AS (SELECT shard, bucket, n, (z >> 32)::BIGINT AS draw FROM z3)"


def _slots_sql(name: str, asks: str, hits: str = "false", shared: bool = False, pure: bool = False, gate: bool = True, before: bool = False, after: bool = False, wins: str = "false", at_cap: bool = True, seed: int | None = None, give: str = "flows", counted: str = "") -> str:
    """A policy of one slot per bucket as a recursion over each bucket's packets.

    give: the flows, those that end before the trace does, the log of its collisions, or its counts; counted: the names and conditions of those that it has.

    asks: whether a packet of another flow may contend, which uses a draw. hits: whether it takes over. before, after:
    whether the once-only gate is asked before the draw, or after it. wins: when the incumbent scores.
    """
    shard = "0" if shared else "proto"
    flush = f"len(ts) = {CAP} AND (taken OR same)" + ("" if at_cap else " AND both_fin")
    steps = f"""WITH RECURSIVE {EVENTS}, keyed AS (SELECT *, {fnv()} & {BUCKETS - 1} AS bucket FROM canon),
q AS (SELECT {shard} AS shard, bucket, row_number() OVER (PARTITION BY {shard}, bucket ORDER BY pkt_no) AS rn, {{'ip1': ip1::BIGINT, 'port1': port1::BIGINT, 'ip2': ip2::BIGINT, 'port2': port2::BIGINT, 'proto': proto::BIGINT}} AS p_key, {{'a': src_ip_n::BIGINT, 'p': src_port::BIGINT}} AS src,
    pkt_no, ts_us, ts_us // 1000000 AS sec, proto = 17 AS udp, coalesce({'tcp_flags = 2' if pure else 'tcp_flags & 2 <> 0'}, false) OR proto = 17 AS starts, coalesce(tcp_flags & 1 <> 0, false) AS fin, ip_len::BIGINT AS ip_len FROM keyed),
opened AS (SELECT DISTINCT shard, bucket FROM q), {_draws_sql(SMALL.seed if seed is None else seed)},
s AS (
  SELECT shard, bucket, 0::BIGINT AS rn, 0::BIGINT AS drawn, NULL::{_FLOW} AS key, NULL::STRUCT(a BIGINT, p BIGINT) AS cli, []::BIGINT[] AS ts, []::BIGINT[] AS lens, 0::BIGINT AS wins, 1::BIGINT AS seen, 0::BIGINT AS total, 0::BIGINT AS last, false AS isudp, []::BOOLEAN[] AS fins,
    []::{_FLOW}[] AS known, NULL::STRUCT(key {_FLOW}, ts BIGINT[], lens BIGINT[], wins BIGINT, total BIGINT, reason VARCHAR) AS emitted, NULL::{_CLASH} AS clash, []::VARCHAR[] AS did
  FROM opened
  UNION ALL
  SELECT shard, bucket, rn, drawn, CASE WHEN {flush} THEN NULL ELSE key END, cli, ts, lens, wins, seen, total, last, isudp, fins, known,
    CASE WHEN {flush} THEN {{'key': key, 'ts': ts, 'lens': lens, 'wins': wins, 'total': total, 'reason': '{'cap' if at_cap else 'fin'}'}} ELSE idle_out END, clash, did
  FROM (
    SELECT shard, bucket, p_rn AS rn, drawn + asks::BIGINT AS drawn, same, taken, CASE WHEN taken THEN p_key WHEN hits THEN CASE WHEN kept THEN held END ELSE held END AS key, CASE WHEN taken THEN src ELSE cli END AS cli,
      CASE WHEN taken THEN [ts_us] WHEN same AND len(ts) < {CAP} THEN list_append(ts, ts_us) ELSE ts END AS ts, CASE WHEN taken THEN [ip_len] WHEN same AND len(lens) < {CAP} THEN list_append(lens, CASE WHEN src = cli THEN ip_len ELSE -ip_len END) ELSE lens END AS lens,
      CASE WHEN taken THEN 0 WHEN meets AND ({wins}) THEN wins + 1 ELSE wins END AS wins, CASE WHEN taken AND meets OR asks THEN seen + 1 WHEN taken THEN 1 ELSE seen END AS seen, CASE WHEN taken THEN 1 WHEN same THEN total + 1 ELSE total END AS total,
      CASE WHEN taken OR same THEN sec ELSE last END AS last, CASE WHEN taken THEN udp ELSE isudp END AS isudp, CASE WHEN taken THEN CASE WHEN fin THEN [true] ELSE [] END WHEN same AND fin THEN list_distinct(list_append(fins, src = cli)) ELSE fins END AS fins,
      fin AND NOT udp AND len(list_distinct(list_append(CASE WHEN same THEN fins ELSE [] END, src = CASE WHEN same THEN cli ELSE src END))) = 2 AS both_fin,
      CASE WHEN udp AND (opens AND {str(gate).lower()} OR asks AND {str(before).lower()} OR hits AND NOT kept AND {str(after).lower()}) THEN list_append(known, p_key) ELSE known END AS known,
      CASE WHEN gone THEN {{'key': s_key, 'ts': ts, 'lens': lens, 'wins': wins, 'total': total, 'reason': 'idle'}} END AS idle_out,
      CASE WHEN asks THEN {{'pkt_no': pkt_no, 'ts_us': ts_us, 'winner': CASE WHEN hits THEN p_key ELSE held END, 'loser': CASE WHEN hits THEN held ELSE p_key END, 'kept': NOT hits}} END AS clash, [{counted}]::VARCHAR[] AS did
    FROM (SELECT *, opens OR (hits AND NOT kept AND starts) AS taken
      FROM (SELECT *, {str(after).lower()} AND asked_before AS kept
        FROM (SELECT *, asks AND ({hits}) AS hits
          FROM (SELECT *, held IS NULL AND starts AND NOT ({str(gate).lower()} AND asked_before) AS opens, meets AND ({asks}) AS asks
            FROM (SELECT *, held IS NOT NULL AND NOT same AS meets
              FROM (SELECT *, CASE WHEN NOT gone THEN s_key END AS held, coalesce(NOT gone AND s_key = p_key, false) AS same, udp AND list_contains(known, p_key) AS asked_before
                FROM (SELECT s.shard, s.bucket, s.drawn, s.key AS s_key, s.cli, s.ts, s.lens, s.wins, s.seen, s.total, s.last, s.isudp, s.fins, s.known, q.rn AS p_rn, q.p_key, q.src, q.pkt_no, q.ts_us, q.sec, q.udp, q.starts, q.fin, q.ip_len, d.draw, s.key IS NOT NULL AND s.isudp AND q.sec - s.last >= {IDLE} AS gone
                  FROM s JOIN q ON q.shard = s.shard AND q.bucket = s.bucket AND q.rn = s.rn + 1 LEFT JOIN draws d ON d.shard = s.shard AND d.bucket = s.bucket AND d.n = s.drawn))))))))),
ends AS (SELECT shard, bucket, emitted AS e FROM s WHERE emitted IS NOT NULL
  UNION ALL SELECT shard, bucket, {{'key': key, 'ts': ts, 'lens': lens, 'wins': wins, 'total': total, 'reason': CASE WHEN isudp THEN 'idle' ELSE 'eof' END}} FROM s WHERE key IS NOT NULL AND rn = (SELECT max(rn) FROM q WHERE q.shard = s.shard AND q.bucket = s.bucket))"""
    if give == "log":
        return steps + _logged_sql(name)
    if give == "counts":
        return f"""{steps}, every AS (SELECT unnest(did) AS name FROM s UNION ALL SELECT 'packets' FROM q UNION ALL SELECT 'flows_' || e.reason FROM ends)
SELECT '{name}' AS policy, name, count(*) AS value FROM every WHERE name IS NOT NULL GROUP BY name"""
    if give == "during":
        steps = steps.replace("FROM s WHERE key IS NOT NULL AND rn", "FROM s WHERE false AND rn")
    return f"""{steps}
SELECT '{name}' AS policy, bucket, e.key.ip1 AS ip1, e.key.port1::INTEGER AS port1, e.key.ip2 AS ip2, e.key.port2::INTEGER AS port2, e.key.proto::INTEGER AS proto, e.ts[1] AS first_ts_us, len(e.ts) AS count, e.wins AS wins, e.total AS total, e.reason AS end_reason, 'main' AS in_table,
  array_to_string(list_transform(e.ts, lambda t: t - e.ts[1]), ' ') AS offsets_us, array_to_string(e.lens, ' ') AS lengths FROM ends"""


#: What the stand-in scorer makes of the first eight packets: whether it calls the flow long.
_GOOD = "(list_avg(list_transform({lens}[1:8], lambda x: abs(x))) - 70) / 20 + (300000 - ({ts}[8] - {ts}[1]) / 1e6) / 300000 >= 0"
_HALF = 1 << 31
_SLOT_POLICIES = {
    "drop_challenger": {"asks": "false", "shared": True, "gate": False, "at_cap": False},
    "fcfs": {"asks": "false", "wins": "starts"},
    "reservoir_shared": {"asks": "NOT asked_before", "hits": "draw % (seen + 1) = 0", "shared": True, "gate": False, "before": True, "at_cap": False},
    "reservoir": {"asks": "starts", "hits": "draw % (wins + 2) = 0", "after": True, "wins": "asks AND NOT hits"},
    "random": {"asks": "starts AND NOT asked_before", "hits": f"draw < {_HALF}", "pure": True, "before": True, "wins": "asks AND NOT hits"},
    "weighted": {"asks": "starts AND NOT asked_before", "hits": f"draw / 4294967296.0 < CASE WHEN len(ts) < 30 THEN 0.5 ELSE 0.5 * ({CAP} - len(ts)) / {CAP - 30} END", "pure": True, "before": True, "wins": "asks AND NOT hits"},
    "random_replicate": {"asks": "starts", "hits": "draw % 2 = 0", "after": True},
    "protected": {"asks": f"NOT (len(ts) >= 8 AND {_GOOD.format(lens='lens', ts='ts')})", "hits": "true", "shared": True, "gate": False, "at_cap": False},
}
for _name, _rules in _SLOT_POLICIES.items():
    SQL[f"policy_{_name}"] = _slots_sql(_name, **_rules)


def _duel_sql(name: str, shared: bool = False, gate: bool = True, coin: bool = False, emit_aux: bool = False, even: bool = False, give: str = "flows") -> str:
    """A policy of a main and an auxiliary slot per bucket as a recursion over each bucket's packets.

    coin: whether a third flow may take the auxiliary slot. even: whether a coin decides each duel. m and a stand for the slots: key, client, times, lengths,
    total, last second, whether UDP.
    """
    shard = "0" if shared else "proto"
    parts = ("k", "c", "w", "l", "n", "z", "u")
    kinds = {"k": _FLOW, "c": "STRUCT(a BIGINT, p BIGINT)", "w": "BIGINT[]", "l": "BIGINT[]", "n": "BIGINT", "z": "BIGINT", "u": "BOOLEAN"}
    nothing = ", ".join(f"NULL::{kinds[x]} AS {e}{x}" for e in "ma" for x in parts)

    def touched(e: str, mine: str) -> str:
        """The slot's columns after the packet; old columns where it is not the packet's."""
        new = {"k": "p_key", "c": "src", "w": "[ts_us]", "l": "[ip_len]", "n": "1", "z": "sec", "u": "udp"}
        more = {"k": f"{e}k", "c": f"{e}c", "w": f"CASE WHEN len({e}w) < {CAP} THEN list_append({e}w, ts_us) ELSE {e}w END", "l": f"CASE WHEN len({e}l) < {CAP} THEN list_append({e}l, CASE WHEN src = {e}c THEN ip_len ELSE -ip_len END) ELSE {e}l END", "n": f"{e}n + 1", "z": "sec", "u": f"{e}u"}
        return ", ".join(f"CASE WHEN {mine} AND opens THEN {new[x]} WHEN {mine} AND adds THEN {more[x]} WHEN h{e} IS NOT NULL THEN {e}{x} END AS {e}{x}2" for x in parts)

    def after(e: str) -> str:
        other = "a" if e == "m" else "m"
        gone = "main_full" if e == "m" else "aux_full OR duel"
        taken = "duel AND NOT keep" if e == "m" else "false"
        return ", ".join(f"CASE WHEN {gone} AND NOT ({taken}) THEN NULL WHEN swap OR ({taken}) THEN {'sec' if x == 'z' else other + x + '2'} ELSE {e}{x}2 END AS {e}{x}" for x in parts)

    flow = lambda e, x, reason, table: f"{{'key': {e}k{x}, 'ts': {e}w{x}, 'lens': {e}l{x}, 'total': {e}n{x}, 'reason': '{reason}', 'tab': '{table}'}}"
    steps = f"""WITH RECURSIVE {EVENTS}, keyed AS (SELECT *, {fnv()} & {BUCKETS - 1} AS bucket FROM canon),
q AS (SELECT {shard} AS shard, bucket, row_number() OVER (PARTITION BY {shard}, bucket ORDER BY pkt_no) AS rn, {{'ip1': ip1::BIGINT, 'port1': port1::BIGINT, 'ip2': ip2::BIGINT, 'port2': port2::BIGINT, 'proto': proto::BIGINT}} AS p_key, {{'a': src_ip_n::BIGINT, 'p': src_port::BIGINT}} AS src,
    pkt_no, ts_us, ts_us // 1000000 AS sec, proto = 17 AS udp, coalesce(tcp_flags & 2 <> 0, false) OR proto = 17 AS starts, ip_len::BIGINT AS ip_len FROM keyed),
opened AS (SELECT DISTINCT shard, bucket FROM q), {_draws_sql(SMALL.seed)},
s AS (
  SELECT shard, bucket, 0::BIGINT AS rn, 0::BIGINT AS drawn, {nothing}, []::{_FLOW}[] AS known, NULL::STRUCT(key {_FLOW}, ts BIGINT[], lens BIGINT[], total BIGINT, reason VARCHAR, tab VARCHAR) AS emitted, NULL::{_CLASH} AS clash FROM opened
  UNION ALL
  SELECT shard, bucket, p_rn, drawn + (third AND {str(coin).lower()})::BIGINT + tie::BIGINT, {after('m')}, {after('a')}, CASE WHEN opens AND udp AND {str(gate).lower()} THEN list_append(known, p_key) ELSE known END,
    CASE WHEN main_full THEN {flow('m', '2', 'cap', 'main')} WHEN aux_full THEN {flow('a', '2', 'cap', 'aux')} WHEN m_gone THEN {flow('m', '', 'idle', 'main')} END,
    CASE WHEN duel THEN {{'pkt_no': pkt_no, 'ts_us': ts_us, 'winner': CASE WHEN keep THEN mk2 ELSE ak2 END, 'loser': CASE WHEN keep THEN ak2 ELSE mk2 END, 'kept': keep}} END
  FROM (SELECT *, CASE WHEN tie THEN draw & 1 = 1 ELSE m_good END AS keep
    FROM (SELECT *, duel AND {'true' if even else 'm_good = a_good'} AS tie
      FROM (SELECT *, coalesce(judged AND len(mw2) < 8, false) AS swap, coalesce(judged AND len(mw2) >= 8, false) AS duel, {_GOOD.format(lens='ml2', ts='mw2')} AS m_good, {_GOOD.format(lens='al2', ts='aw2')} AS a_good
        FROM (SELECT *, (opens OR adds) AND NOT main_full AND NOT aux_full AND mk2 IS NOT NULL AND ak2 IS NOT NULL AND mk2 <> ak2 AND len(aw2) >= 8 AS judged
          FROM (SELECT *, coalesce((opens OR adds) AND NOT in_aux AND len(mw2) = {CAP}, false) AS main_full, coalesce((opens OR adds) AND in_aux AND {str(emit_aux).lower()} AND len(aw2) = {CAP}, false) AS aux_full
            FROM (SELECT *, {touched('m', 'NOT in_aux')}, {touched('a', 'in_aux')}
              FROM (SELECT *, NOT out_now AND NOT there AND starts AND NOT ({str(gate).lower()} AND udp AND list_contains(known, p_key)) AS opens, NOT out_now AND there AS adds
                FROM (SELECT * REPLACE (CASE WHEN third THEN CASE WHEN out_now THEN ha END ELSE ha END AS ha), CASE WHEN in_aux THEN ha IS NOT NULL AND NOT third ELSE hm IS NOT NULL END AS there
                  FROM (SELECT *, third AND {'draw & 1 = 0' if coin else 'true'} AS out_now
                    FROM (SELECT *, in_aux AND coalesce(ha <> p_key, false) AS third
                      FROM (SELECT *, coalesce(hm <> p_key, false) AS in_aux
                        FROM (SELECT *, CASE WHEN NOT m_gone THEN mk END AS hm, CASE WHEN NOT (ak IS NOT NULL AND au AND sec - az >= {IDLE}) THEN ak END AS ha
                          FROM (SELECT s.*, q.rn AS p_rn, q.p_key, q.src, q.pkt_no, q.ts_us, q.sec, q.udp, q.starts, q.ip_len, d.draw, coalesce(s.mk IS NOT NULL AND s.mu AND q.sec - s.mz >= {IDLE}, false) AS m_gone
                            FROM s JOIN q ON q.shard = s.shard AND q.bucket = s.bucket AND q.rn = s.rn + 1 LEFT JOIN draws d ON d.shard = s.shard AND d.bucket = s.bucket AND d.n = s.drawn)))))))))))))),
ends AS (SELECT shard, bucket, emitted AS e FROM s WHERE emitted IS NOT NULL
  UNION ALL SELECT shard, bucket, {{'key': mk, 'ts': mw, 'lens': ml, 'total': mn, 'reason': CASE WHEN mu THEN 'idle' ELSE 'eof' END, 'tab': 'main'}} FROM s WHERE mk IS NOT NULL AND rn = (SELECT max(rn) FROM q WHERE q.shard = s.shard AND q.bucket = s.bucket))"""
    if give == "log":
        return steps + _logged_sql(name)
    return f"""{steps}
SELECT '{name}' AS policy, bucket, e.key.ip1 AS ip1, e.key.port1::INTEGER AS port1, e.key.ip2 AS ip2, e.key.port2::INTEGER AS port2, e.key.proto::INTEGER AS proto, e.ts[1] AS first_ts_us, len(e.ts) AS count, 0::BIGINT AS wins, e.total AS total, e.reason AS end_reason, e.tab AS in_table,
  array_to_string(list_transform(e.ts, lambda t: t - e.ts[1]), ' ') AS offsets_us, array_to_string(e.lens, ' ') AS lengths FROM ends"""


_DUELS = {"duel_shared": {"shared": True, "gate": False}, "duel": {"gate": False}, "duel_gated": {}, "duel_revised": {"coin": True, "emit_aux": True}, "duel_logged": {}}
for _name, _rules in _DUELS.items():
    SQL[f"policy_{_name}"] = _duel_sql(_name, **_rules)

#: Equal tables: SQL has one auxiliary slot for each main one.
SQL["policy_duel_coin"] = _duel_sql("duel_even", even=True)

for _name in catalog.POLICIES:
    QUERIES[f"policy_{_name}"] = _policy(_name, **({"aux_buckets": BUCKETS // 4} if _name == "duel_even" else {}))
QUERIES["policy_duel_coin"] = _policy("duel_even")
QUERIES["policy_random_seeded"] = _policy("random", rng="global")
QUERIES["policy_weighted_seeded"] = _policy("weighted", rng="global")


def _statistics(names) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf_dir):
        every = [counts_of(catalog.run(events(spark, sf_dir), name, SMALL)) for name in names]
        return reduce(DataFrame.union, every)

    return run


#: What a step counts, by its name.
_STEP = "CASE WHEN same THEN 'matched' END, CASE WHEN taken THEN 'inserted' END, CASE WHEN held IS NULL AND NOT starts THEN 'mid_flow' END"
_COUNTED = {
    "drop_challenger": "CASE WHEN meets THEN 'collisions' END",
    "fcfs": "CASE WHEN meets THEN 'collisions' END, CASE WHEN meets AND starts THEN 'incumbent_wins' END, CASE WHEN held IS NULL AND starts AND asked_before THEN 'refused' END",
    "random": "CASE WHEN asks THEN 'collisions' END, CASE WHEN hits THEN 'challenger_wins' END, CASE WHEN asks AND NOT hits THEN 'incumbent_wins' END, CASE WHEN NOT same AND starts AND asked_before THEN 'refused' END",
}
_COUNTED["weighted"] = _COUNTED["random"]


def _slot_counts(name: str) -> str:
    tracked = f"CASE WHEN taken OR (same AND len(ts) < {CAP}) THEN 'tracked' END"
    return _slots_sql(name, **_SLOT_POLICIES[name], give="counts", counted=f"{_STEP}, {tracked}, {_COUNTED[name]}")


QUERIES["slot_statistics"] = _statistics(_COUNTED)
SQL["slot_statistics"] = " UNION ALL ".join(f"SELECT * FROM ({_slot_counts(name)})" for name in _COUNTED)
#: The counts of every policy.
QUERIES["policy_statistics"] = _statistics(catalog.POLICIES)

_TIMING = f"m AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY pkt_no) AS n FROM canon), g AS (SELECT {K}, count(*) AS pkts, min_by(ts_us, n) AS first_ts_us, max(CASE WHEN n = 30 THEN ts_us END) AS hit, max_by(ts_us, n) AS last_ts_us FROM m GROUP BY {K})"


def _joined_sql(log: str) -> str:
    """A log with both sides' true packet counts."""
    sides = [f"LEFT JOIN g {x} ON {' AND '.join(f'{x}.{k} = c.{y}_{k}' for k in KEY[:4])} AND {x}.proto = c.proto" for x, y in (("w", "winner"), ("l", "loser"))]
    pkts = ", ".join(f"coalesce({x}.pkts, 0) AS {y}_pkts, CASE WHEN coalesce({x}.pkts, 0) >= {CAP} THEN 1 ELSE 0 END AS {y}_ge40" for x, y in (("w", "winner"), ("l", "loser")))
    return f"WITH {EVENTS}, {_TIMING}, c AS ({log}) SELECT c.*, {pkts} FROM c {' '.join(sides)}"


@query(_joined_sql(_slots_sql("random", **_SLOT_POLICIES["random"], give="log")))
def collision_log(spark, sf_dir):
    log = collisions_of(catalog.run(events(spark, sf_dir), "random", SMALL))
    return groundtruth.collision_table(log, groundtruth.timing(canon(spark, sf_dir)))


@query(
    f"""WITH {EVENTS}, {_TIMING}, c AS ({_slots_sql('weighted', **_SLOT_POLICIES['weighted'], give='log')}),
both_sides AS (SELECT winner_ip1 AS ip1, winner_port1 AS port1, winner_ip2 AS ip2, winner_port2 AS port2, proto, 1 AS won FROM c UNION ALL SELECT loser_ip1, loser_port1, loser_ip2, loser_port2, proto, 0 FROM c),
n AS (SELECT {K}, count(*) AS collisions, sum(won)::BIGINT AS wins, sum(1 - won)::BIGINT AS losses FROM both_sides GROUP BY {K})
SELECT {K}, pkts, CASE WHEN pkts >= {CAP} THEN 1 ELSE 0 END AS ge40, first_ts_us, coalesce(hit, 0) AS hit30_ts_us, last_ts_us, coalesce(hit - first_ts_us, 0) AS dur_to_30_us, coalesce(last_ts_us - hit, 0) AS dur_30_to_last_us, last_ts_us - first_ts_us AS dur_total_us,
  coalesce(collisions, 0) AS collisions, coalesce(wins, 0) AS wins, coalesce(losses, 0) AS losses FROM g LEFT JOIN n USING ({K})"""
)
def collision_summary(spark, sf_dir):
    log = collisions_of(catalog.run(events(spark, sf_dir), "weighted", SMALL))
    return groundtruth.collision_summary(log, groundtruth.timing(canon(spark, sf_dir)))


@query(
    f"""WITH t AS ({_joined_sql(_duel_sql('duel_logged', give='log'))})
SELECT count(*) AS collisions, count(*) FILTER (winner_ge40 = 1) AS winners_ge40, count(*) FILTER (loser_ge40 = 1) AS losers_ge40, count(*) FILTER (winner_ge40 = 1 AND loser_ge40 = 0) AS right, count(*) FILTER (winner_ge40 = 0 AND loser_ge40 = 1) AS wrong FROM t"""
)
def duel_outcomes(spark, sf_dir):
    log = collisions_of(catalog.run(events(spark, sf_dir), "duel_logged", SMALL))
    return groundtruth.duel_outcomes(groundtruth.collision_table(log, groundtruth.timing(canon(spark, sf_dir))))


@query(
    f"""WITH c AS ({_duel_sql('duel_logged', give='log')}), both_sides AS (SELECT winner_ip1 AS ip1, winner_port1 AS port1, winner_ip2 AS ip2, winner_port2 AS port2, proto FROM c UNION ALL SELECT loser_ip1, loser_port1, loser_ip2, loser_port2, proto FROM c)
SELECT 'duel_logged' AS policy, name, count(*) AS total, count(DISTINCT ({K})) AS unique_flows FROM both_sides, (SELECT unnest(['classified', 'competed']) AS name) GROUP BY name"""
)
def classified_flows(spark, sf_dir):
    return noted(catalog.run(events(spark, sf_dir), "duel_logged", SMALL))


#: What is shown of a log: its first 50 rows.
@query(f"SELECT * FROM ({SQL['collision_log']}) ORDER BY pkt_no, proto, bucket LIMIT 50")
def collision_display(spark, sf_dir):
    return collision_log(spark, sf_dir).orderBy("pkt_no", "proto", "bucket").limit(50)


_RUNS = " UNION ALL ".join(f"SELECT count(*) FILTER (end_reason = 'cap') AS full_flows FROM ({_slots_sql('random_replicate', **_SLOT_POLICIES['random_replicate'], seed=SMALL.seed + r)})" for r in range(5))


@query(f"SELECT count(*) AS n, round(avg(full_flows), 6) AS mean, quantile_disc(full_flows, 0.25) AS p25, quantile_disc(full_flows, 0.5) AS p50, quantile_disc(full_flows, 0.75) AS p75 FROM ({_RUNS})")
def monte_carlo_capdumps(spark, sf_dir):
    return evaluate.nearest_rank(catalog.replicates(events(spark, sf_dir), 5, SMALL), "full_flows")


@query()
def monte_carlo_1000(spark, sf_dir):
    return evaluate.nearest_rank(catalog.replicates(events(spark, sf_dir), 1000, SMALL), "full_flows")


# ---- models -----------------------------------------------------------------------------------------------------------


def _fit_and_report(pipeline):
    def run(spark, sf_dir):
        rows = _first_features(spark, sf_dir, 8)
        held = learning.in_test(F.concat_ws(":", "ip1", "ip2"))
        model = learning.train(rows.where(~held), pipeline)
        return learning.score(model, rows.where(held))

    return run


@query()
def lr_scores(spark, sf_dir):
    return _fit_and_report(learning.logistic(8))(spark, sf_dir)


@query()
def rf_scores(spark, sf_dir):
    return _fit_and_report(learning.forest(8))(spark, sf_dir)


@query()
def sequence_classes(spark, sf_dir):
    return sequence.classify(_records(spark, sf_dir), sequence.random_network(1))


@query(
    f"""WITH f AS ({_slots_sql('fcfs', **_SLOT_POLICIES['fcfs'])}), h AS (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 AS t FROM events),
l AS (SELECT *, first_ts_us + string_split(offsets_us, ' ')[-1]::BIGINT AS last_us FROM f)
SELECT in_table, proto, count(*) AS flows FROM l, h WHERE first_ts_us <= t AND last_us >= t GROUP BY in_table, proto"""
)
def table_occupancy(spark, sf_dir):
    span = events(spark, sf_dir).agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("b")).first()
    return sinks.occupied(flows_of(catalog.run(events(spark, sf_dir), "fcfs", SMALL)), ((span.a or 0) + (span.b or 0)) // 2)


# ---- sources and sinks: what is written is read again -------------------------------------------------------------------

_FOLDERS: list[tuple[SparkSession, str]] = []


def _delete_folders() -> None:
    for spark, path in _FOLDERS:
        if spark.sparkContext._jsc is not None:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _FOLDERS.clear()


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors see, which goes when the driver ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: what one machine writes others could not read")
        shared = f"file://{tempfile.gettempdir()}/tallyweir-written"
    if not _FOLDERS:
        atexit.register(_delete_folders)
    _FOLDERS.append((spark, f"{shared.rstrip('/')}/written-{uuid.uuid4().hex}"))
    return _FOLDERS[-1][1]


def _captures(spark, sf_dir, files: int = 4, **options) -> DataFrame:
    """The event trace as captures of so many files, each a run of the trace, read again."""
    capture.register(spark)
    path = _folder(spark)
    p = events(spark, sf_dir).withColumns({"tcp_seq": F.lit(None).cast("long"), "tcp_ack": F.lit(None).cast("long")})
    p.repartitionByRange(files, "pkt_no").sortWithinPartitions("pkt_no").write.format("capture").mode("append").save(path)
    return spark.read.format("capture").options(**options).load(path)


@query(f"WITH {EVENTS} SELECT ts_us, src_ip_n, dst_ip_n, src_port, dst_port, proto, ip_len, tcp_flags FROM packets")
def capture_round_trip(spark, sf_dir):
    return _captures(spark, sf_dir).select("ts_us", "src_ip_n", "dst_ip_n", "src_port", "dst_port", "proto", "ip_len", "tcp_flags")


@query(f"WITH {EVENTS}, n AS (SELECT {K}, ip_len, row_number() OVER (PARTITION BY {K} ORDER BY pkt_no) AS n FROM canon) SELECT {K}, ip_len, n FROM n WHERE n <= 5")
def capture_trace_order(spark, sf_dir):
    # the first packets of each flow over several files as one trace
    t = keys.canon_numeric(traces.one_trace(_captures(spark, sf_dir)))
    return t.withColumn("n", F.row_number().over(sessions.by_flow())).where("n <= 5").select(*KEY, "ip_len", F.col("n").cast("long").alias("n"))


@query(f"WITH {EVENTS} SELECT count(*) AS packets, sum(ip_len)::BIGINT AS bytes, count(DISTINCT ({K})) AS flows, sum(CASE WHEN proto = 6 THEN 1 ELSE 0 END)::BIGINT AS tcp_packets, sum(CASE WHEN proto = 17 THEN 1 ELSE 0 END)::BIGINT AS udp_packets FROM canon")
def capture_totals(spark, sf_dir):
    # files in ranges of bytes, with a row for frames that do not decode
    return flows.totals(_captures(spark, sf_dir, splitbytes=1 << 16, frames="all", onelinktype="true", suffix=".pcap"))


def _lines_of(spark, write) -> str:
    """The folder of what `write` has written."""
    path = _folder(spark)
    write(path)
    return path


@query(f"SELECT CASE WHEN proto = 17 THEN 'UDP' ELSE 'TCP' END AS protocol, line FROM ({SQL['flow_csv_lines']})")
def sink_vector_files(spark, sf_dir):
    path = _lines_of(spark, lambda p: sinks.vector_files(_records(spark, sf_dir), p, CAP))
    return spark.read.text(path).select("protocol", F.col("value").alias("line"))


@query(f"WITH {EVENTS} SELECT {ip('ip1')} AS src_ip, port1 AS src_port, {ip('ip2')} AS dst_ip, port2 AS dst_port, proto, count(*) AS packets FROM canon GROUP BY {K}")
def sink_count_files(spark, sf_dir):
    path = _lines_of(spark, lambda p: sinks.count_files(flows.packet_counts(canon(spark, sf_dir)), p))
    return spark.read.option("header", True).schema("src_ip string, src_port int, dst_ip string, dst_port int, proto int, packets long").csv(path)


@query(
    f"""SELECT ts_us, {ip('winner_ip1')} AS winner_ip1, winner_port1, {ip('winner_ip2')} AS winner_ip2, winner_port2, proto AS winner_proto, {ip('loser_ip1')} AS loser_ip1, loser_port1, {ip('loser_ip2')} AS loser_ip2, loser_port2, proto AS loser_proto,
  winner_was_incumbent, winner_pkts, loser_pkts, winner_ge40, loser_ge40 FROM ({SQL['collision_log']})"""
)
def sink_collision_files(spark, sf_dir):
    path = _lines_of(spark, lambda p: sinks.collision_files(collision_log(spark, sf_dir), p))
    side = "{0}_ip1 string, {0}_port1 int, {0}_ip2 string, {0}_port2 int, {0}_proto int"
    return spark.read.option("header", True).schema(f"ts_us long, {side.format('winner')}, {side.format('loser')}, winner_was_incumbent int, winner_pkts long, loser_pkts long, winner_ge40 int, loser_ge40 int").csv(path)


@query(f"SELECT * REPLACE ({ip('ip1')} AS ip1, {ip('ip2')} AS ip2) FROM ({SQL['collision_summary']})")
def sink_summary_files(spark, sf_dir):
    path = _lines_of(spark, lambda p: sinks.summary_files(collision_summary(spark, sf_dir), p, timing=True))
    return spark.read.option("header", True).schema(f"ip1 string, port1 int, ip2 string, port2 int, proto int, pkts long, ge40 int, collisions long, wins long, losses long, {', '.join(f'{c} long' for c in sinks.TIMING)}").csv(path)


@query(f"SELECT cli_ip, srv_ip, cli_port, srv_port, proto, count, offsets_us, lengths FROM ({SQL['flow_messages_read']})")
def sink_json_files(spark, sf_dir):
    path = _lines_of(spark, lambda p: sinks.json_files(_records(spark, sf_dir), p))
    return spark.read.schema("cli_ip string, srv_ip string, cli_port int, srv_port int, proto string, count int, ts array<double>, len array<int>").json(path).select("cli_ip", "srv_ip", "cli_port", "srv_port", "proto", "count", *_us())


@query(
    f"""SELECT in_table, {ip('ip1')} || port1::VARCHAR || {ip('ip2')} || port2::VARCHAR || CASE WHEN proto = 17 THEN 'UDP' ELSE 'TCP' END AS flowid, total AS count_total,
  '[' || array_to_string(list_transform(list_zip(string_split(offsets_us, ' '), string_split(lengths, ' ')), lambda x: '(' || printf('%.6f', (CASE WHEN x[2]::BIGINT < 0 THEN -(x[1]::BIGINT) ELSE x[1]::BIGINT END) / 1e6) || ', ' || printf('%.1f', x[2]::DOUBLE) || ')'), ', ') || ']' AS features
FROM ({SQL['policy_duel_revised']})"""
)
def sink_table_files(spark, sf_dir):
    path = _lines_of(spark, lambda p: sinks.table_files(flows_of(catalog.run(events(spark, sf_dir), "duel_revised", SMALL)), p))
    return spark.read.option("header", True).schema("flowid string, count_total long, features string, in_table string").csv(path).select("in_table", "flowid", "count_total", "features")


@query(f"WITH {EVENTS} SELECT pkt_no, ts_us, proto, ip_len FROM packets")
def stream_json_sink(spark, sf_dir):
    path = _folder(spark)
    packets = _stream(spark, sf_dir)
    jobs.to_json_sink(packets.select("pkt_no", "ts_us", "proto", "ip_len"), f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.schema("pkt_no long, ts_us long, proto int, ip_len int").json(f"{path}/out")


def _stream(spark, sf_dir) -> DataFrame:
    """The packets of the event trace as a stream of files, in their order."""
    path = _folder(spark)
    adapted = events(spark, sf_dir)
    third = (adapted.agg(F.max("pkt_no")).first()[0] or 0) // 3 + 1
    for i in range(3):  # one after the other: a stream takes files by their age
        adapted.where((F.col("pkt_no") >= i * third) & (F.col("pkt_no") < (i + 1) * third)).coalesce(1).write.parquet(f"{path}/{i}")
    return spark.readStream.schema(adapted.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


@query(f"SELECT bucket, {K}, count, wins, end_reason FROM ({_slots_sql('fcfs', **_SLOT_POLICIES['fcfs'], give='during')})")
def stream_first_come(spark, sf_dir):
    # flows that end while the stream runs, of a first-come table kept as state
    path = _folder(spark)
    found = jobs.first_come(_stream(spark, sf_dir), SMALL)
    found.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{path}/out")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_records(spark, sf_dir)

