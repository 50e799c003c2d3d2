"""Flow keys: orders of the two endpoints, printed forms and hashes. All are column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweir.schema import UDP

#: The 32-bit FNV-1a offset basis and prime, and the multipliers of the 32-bit finaliser.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619
MIX_1, MIX_2 = 0x7FEB352D, 0x846CA68B
MASK = 0xFFFFFFFF
#: The multipliers of the 64-bit finaliser, and what the second hash of a Bloom filter is made with.
MIX64_1, MIX64_2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
BLOOM_XOR, BLOOM_STEP = 0x9E3779B9, 0x27D4EB2D


def ip_text(n: Column) -> Column:
    """Dotted form of an IPv4 address held as a number in host order."""
    return F.concat_ws(".", *[F.shiftrightunsigned(n, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def ip_number(text: Column) -> Column:
    """The number of a dotted IPv4 address; null if it is none."""
    parts = [F.try_element_at(F.split(text, r"\."), F.lit(i)).try_cast("long") for i in range(1, 5)]
    good = F.size(F.split(text, r"\.")) == 4
    for p in parts:
        good = good & p.between(0, 255)
    return F.when(good, ((parts[0] * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3])


def swapped_bytes(n: Column) -> Column:
    """A 32-bit number with its bytes in the other order."""
    byte = lambda s: F.shiftrightunsigned(n, s).bitwiseAND(255)
    return byte(0) * 16777216 + byte(8) * 65536 + byte(16) * 256 + byte(24)


def swapped_port(n: Column) -> Column:
    return n.bitwiseAND(255) * 256 + F.shiftrightunsigned(n, 8).bitwiseAND(255)


def ordered(df: DataFrame, first: Column) -> DataFrame:
    """df with ip1, port1, ip2, port2: the source is the first endpoint where `first` holds."""
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return df.withColumns({"ip1": pick("src_ip_n", "dst_ip_n"), "port1": pick("src_port", "dst_port"), "ip2": pick("dst_ip_n", "src_ip_n"), "port2": pick("dst_port", "src_port")})


def canon_numeric(df: DataFrame) -> DataFrame:
    """The smaller address first, with its port; of equal addresses the smaller port."""
    s, d = F.col("src_ip_n"), F.col("dst_ip_n")
    return ordered(df, (s < d) | ((s == d) & (F.col("src_port") <= F.col("dst_port"))))


def canon_raw(df: DataFrame) -> DataFrame:
    """As canon_numeric, on the numbers that a little-endian machine reads from the wire."""
    s, d = swapped_bytes(F.col("src_ip_n")), swapped_bytes(F.col("dst_ip_n"))
    return ordered(df, (s < d) | ((s == d) & (swapped_port(F.col("src_port")) <= swapped_port(F.col("dst_port")))))


def canon_lex(df: DataFrame) -> DataFrame:
    """The order of (address text, other address text, port, other port)."""
    s, d = ip_text(F.col("src_ip_n")), ip_text(F.col("dst_ip_n"))
    return ordered(df, (s < d) | ((s == d) & (F.col("src_port") <= F.col("dst_port"))))


def canon_endpoint_lex(df: DataFrame) -> DataFrame:
    """The order of the endpoints (address text, port)."""
    a, b = F.struct(ip_text(F.col("src_ip_n")), F.col("src_port")), F.struct(ip_text(F.col("dst_ip_n")), F.col("dst_port"))
    return ordered(df, a <= b)


def directional(df: DataFrame) -> DataFrame:
    """The packet's own direction: each direction is a flow of its own."""
    return ordered(df, F.lit(True))


CANONS = {"numeric": canon_numeric, "raw": canon_raw, "lex": canon_lex, "endpoint": canon_endpoint_lex, "none": directional}


def proto_name(proto: Column) -> Column:
    return F.when(proto == UDP, "UDP").otherwise("TCP")


def flow_id() -> Column:
    """ip1 port1 ip2 port2 protocol without separators, as the vector lines name a flow."""
    return F.concat(ip_text(F.col("ip1")), F.col("port1").cast("string"), ip_text(F.col("ip2")), F.col("port2").cast("string"), proto_name(F.col("proto")))


def key_text() -> Column:
    """The hexadecimal text that the bucket hash reads; addresses with their bytes swapped."""
    long = lambda c: c.cast("long")
    return F.format_string("%08x%04x%08x%04x%02x", swapped_bytes(F.col("ip1")), long(F.col("port1")), swapped_bytes(F.col("ip2")), long(F.col("port2")), long(F.col("proto")))


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a of an ASCII text."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(FNV_BASIS).cast("long"), lambda h, c: (h.bitwiseXOR(c) * FNV_PRIME).bitwiseAND(MASK))


def let(value: Column, f) -> Column:
    """f(value), with the value computed once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def product32(a: Column, m: int) -> Column:
    """a * m modulo 2^32 of 32-bit numbers; by halves, as the whole product may exceed a long."""
    low, high = a.bitwiseAND(0xFFFF), F.shiftrightunsigned(a, 16)
    return (low * m + F.shiftleft((high * m).bitwiseAND(0xFFFF), 16)).bitwiseAND(MASK)


def mix32(x: Column) -> Column:
    """A 32-bit finaliser: shifts of 16, 15 and 16 bits around two products."""
    folded = lambda n: lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, n))
    x = let(let(x.cast("long"), folded(16)), lambda v: product32(v, MIX_1))
    x = let(let(x, folded(15)), lambda v: product32(v, MIX_2))
    return let(x, folded(16))


def with_bucket(df: DataFrame, buckets: int) -> DataFrame:
    """df with the flow's hash and its bucket; buckets is a power of two."""
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    return df.withColumn("hash", fnv1a32(key_text())).withColumn("bucket", F.col("hash").bitwiseAND(buckets - 1))


def register(spark: SparkSession) -> None:
    """SQL functions flow_ip, flow_fnv and flow_id, as SQL expressions without Python."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION flow_ip(n BIGINT) RETURNS STRING RETURN concat_ws('.', shiftrightunsigned(n, 24) & 255, shiftrightunsigned(n, 16) & 255, shiftrightunsigned(n, 8) & 255, n & 255)")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION flow_fnv(s STRING) RETURNS BIGINT RETURN aggregate(transform(filter(split(s, ''), c -> c <> ''), c -> CAST(ascii(c) AS BIGINT)), CAST({FNV_BASIS} AS BIGINT), (h, c) -> ((h ^ c) * {FNV_PRIME}) & {MASK})"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION flow_id(ip1 BIGINT, port1 INT, ip2 BIGINT, port2 INT, proto INT) RETURNS STRING RETURN concat(concat_ws('.', shiftrightunsigned(ip1, 24) & 255, shiftrightunsigned(ip1, 16) & 255, shiftrightunsigned(ip1, 8) & 255, ip1 & 255), port1, concat_ws('.', shiftrightunsigned(ip2, 24) & 255, shiftrightunsigned(ip2, 16) & 255, shiftrightunsigned(ip2, 8) & 255, ip2 & 255), port2, CASE WHEN proto = 17 THEN 'UDP' ELSE 'TCP' END)"
    )


def fnv_fields() -> Column:
    """32-bit FNV over the key's numbers, each taken as a whole: addresses with their bytes swapped, then ports, then the protocol."""
    h = F.lit(FNV_BASIS).cast("long")
    for field in (swapped_bytes(F.col("ip1")), swapped_bytes(F.col("ip2")), F.col("port1"), F.col("port2"), F.col("proto")):
        h = (h.bitwiseXOR(field.cast("long")) * FNV_PRIME).bitwiseAND(MASK)
    return h


def bloom_positions(bits: int, k: int) -> Column:
    """The k positions of a key in a Bloom filter of 2^n bits: two hashes, the second one times 0, 1, 2 ..."""
    if bits & (bits - 1):
        raise ValueError("bits must be a power of two")
    step = lambda two: F.when(two == 0, F.lit(BLOOM_STEP).cast("long")).otherwise(two)
    hashes = let(fnv_fields(), lambda one: F.array(one, let(mix32(one.bitwiseXOR(BLOOM_XOR)), step)))
    return let(hashes, lambda h: F.array(*[(h[0] + h[1] * i).bitwiseAND(bits - 1) for i in range(k)]))


def has_bit(word: Column, bit: Column) -> Column:
    """Whether a bit of a number is set."""
    return F.getbit(word, bit) == 1


def bit_set(bits: Column) -> Column:
    """An aggregate: a 64-bit number with the given bits set."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int")))


@F.pandas_udf(T.LongType())
def mix64(x: pd.Series) -> pd.Series:
    """A 64-bit finaliser: shifts of 33 bits around two products modulo 2^64, which SQL has no whole numbers for."""
    h = x.to_numpy(np.int64).view(np.uint64).copy()
    for m in (MIX64_1, MIX64_2):
        h = (h ^ h >> np.uint64(33)) * np.uint64(m)
    return pd.Series((h ^ h >> np.uint64(33)).view(np.int64))


def signature() -> Column:
    """The 64-bit signature of a key, for sets of keys that are asked often: addresses with their bytes swapped; 0 is given as 1."""
    wide = lambda c, n: F.shiftleft(F.col(c).cast("long"), n)
    x = F.shiftleft(swapped_bytes(F.col("ip1")).cast("long"), 32).bitwiseXOR(swapped_bytes(F.col("ip2")))
    mixed = mix64(x.bitwiseXOR(wide("port1", 48)).bitwiseXOR(wide("port2", 32)).bitwiseXOR(F.col("proto").cast("long")))
    return F.when(mixed == 0, F.lit(1).cast("long")).otherwise(mixed)
