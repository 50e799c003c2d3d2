"""Ground truth: what each flow really sends, and how contention for buckets treats it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweir.functions.keys import with_bucket
from tallyweir.schema import CAP, KEY


def timing(packets: DataFrame, nth: int = 30, target: int = CAP) -> DataFrame:
    """Packets of each flow, and when the first, the nth and the last came; durations are 0 where there is no nth."""
    n = F.row_number().over(Window.partitionBy(*KEY).orderBy("pkt_no"))
    g = packets.withColumn("n", n).groupBy(*KEY).agg(F.count("*").alias("pkts"), F.min_by("ts_us", "n").alias("first_ts_us"), F.max(F.when(F.col("n") == nth, F.col("ts_us"))).alias("hit"), F.max_by("ts_us", "n").alias("last_ts_us"))
    zero = F.lit(0).cast("long")
    return g.select(
        *KEY, "pkts", (F.col("pkts") >= target).cast("int").alias("ge40"), "first_ts_us", F.coalesce("hit", zero).alias("hit30_ts_us"), "last_ts_us",
        F.coalesce(F.col("hit") - F.col("first_ts_us"), zero).alias("dur_to_30_us"), F.coalesce(F.col("last_ts_us") - F.col("hit"), zero).alias("dur_30_to_last_us"), (F.col("last_ts_us") - F.col("first_ts_us")).alias("dur_total_us"),
    )


def flow_buckets(packets: DataFrame, buckets: int) -> DataFrame:
    """(key, packets, hash, bucket): the hash is computed once per flow."""
    return with_bucket(packets.groupBy(*KEY).agg(F.count("*").alias("packets")), buckets)


def occupancy(packets: DataFrame, buckets: int) -> DataFrame:
    """Flows and packets of each protocol's buckets."""
    return flow_buckets(packets, buckets).groupBy("proto", "bucket").agg(F.count("*").alias("flows"), F.sum("packets").alias("packets"))


def contention(packets: DataFrame, buckets: int) -> DataFrame:
    """How many pairs of flows share each bucket. Pairs are counted, not made."""
    o = occupancy(packets, buckets)
    return o.select("proto", "bucket", "flows", (F.col("flows") * (F.col("flows") - 1) / 2).cast("long").alias("pairs"))


def collision_table(collisions: DataFrame, truth: DataFrame) -> DataFrame:
    """The collision log with both sides' true packet counts: 0 where a flow has none. truth: one row per flow."""
    out = collisions
    for side in ("winner", "loser"):
        t = truth.select(*[F.col(k).alias(f"{side}_{k}") for k in KEY if k != "proto"], F.col("proto").alias("proto"), F.col("pkts").alias(f"{side}_pkts"))
        out = out.join(t, [f"{side}_ip1", f"{side}_port1", f"{side}_ip2", f"{side}_port2", "proto"], "left").withColumn(f"{side}_pkts", F.coalesce(f"{side}_pkts", F.lit(0).cast("long")))
        out = out.withColumn(f"{side}_ge40", (F.col(f"{side}_pkts") >= CAP).cast("int"))
    return out


def collision_summary(collisions: DataFrame, truth: DataFrame) -> DataFrame:
    """Each flow's packets, timing, and collisions won and lost."""
    sides = [collisions.select(*[F.col(f"{s}_{k}").alias(k) for k in KEY if k != "proto"], "proto", F.lit(int(s == "winner")).alias("won")) for s in ("winner", "loser")]
    n = sides[0].union(sides[1]).groupBy(*KEY).agg(F.count("*").alias("collisions"), F.sum("won").cast("long").alias("wins"), F.sum(1 - F.col("won")).cast("long").alias("losses"))
    return truth.join(n, KEY, "left").fillna(0, ["collisions", "wins", "losses"])


def duel_outcomes(table: DataFrame) -> DataFrame:
    """How many winners and losers of collisions really reach the cap."""
    count = lambda c: F.count(F.when(c, 1))
    return table.agg(F.count("*").alias("collisions"), count(F.col("winner_ge40") == 1).alias("winners_ge40"), count(F.col("loser_ge40") == 1).alias("losers_ge40"), count((F.col("winner_ge40") == 1) & (F.col("loser_ge40") == 0)).alias("right"), count((F.col("winner_ge40") == 0) & (F.col("loser_ge40") == 1)).alias("wrong"))
