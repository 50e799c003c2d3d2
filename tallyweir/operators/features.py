"""Features of a flow's first packets, and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweir.schema import CAP, KEY

EPSILON = 1e-9


def first_packets(packets: DataFrame, n: int, order: list[str], signed: bool = False) -> DataFrame:
    """(key, packets, ts, size) of the flows with at least n packets: the first n times in seconds and sizes."""
    w = Window.partitionBy(*KEY)
    p = packets.withColumn("n", F.row_number().over(w.orderBy(*order))).withColumn("packets", F.count("*").over(w)).where((F.col("n") <= n) & (F.col("packets") >= n))
    held = F.sort_array(F.collect_list(F.struct("n", (F.col("ts_us") / F.lit(1e6)).alias("t"), F.col("ip_len").cast("double").alias("size"))))
    r = p.groupBy(*KEY).agg(held.alias("held"), F.first("packets").alias("packets"))
    return r.select(*KEY, "packets", F.transform("held", lambda x: x["t"]).alias("ts"), F.transform("held", lambda x: x["size"]).alias("size"))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def statistics(a: Column) -> tuple[Column, Column, Column, Column, Column]:
    """Mean, population deviation, least, greatest and sum of an array."""
    s = total(a)
    mean = s / F.size(a)
    variance = total(F.transform(a, lambda x: (x - mean) * (x - mean))) / F.size(a)
    return mean, F.when(variance > 0, F.sqrt(variance)).otherwise(0.0), F.array_min(a), F.array_max(a), s


def first_n_features(flows: DataFrame, n: int, digits: int | None = 6) -> DataFrame:
    """The 2n + 11 features of flows with arrays ts and size, in their fixed order, and label: CAP packets or more."""
    ts, size = F.col("ts"), F.col("size")
    gaps = F.zip_with(F.slice(ts, 2, n - 1), F.slice(ts, 1, n - 1), lambda b, a: b - a)
    f = flows.withColumn("gaps", gaps)
    span = ts[n - 1] - ts[0]
    mean_size, std_size, min_size, max_size, sum_size = statistics(size)
    mean_dt, std_dt, min_dt, max_dt, _ = statistics(F.col("gaps"))
    columns = {f"s{i + 1}": size[i] for i in range(n)} | {f"dt{i + 2}": F.col("gaps")[i] for i in range(n - 1)}
    columns |= {"mean_size": mean_size, "std_size": std_size, "min_size": min_size, "max_size": max_size, "sum_size": sum_size, "mean_dt": mean_dt, "std_dt": std_dt, "min_dt": min_dt, "max_dt": max_dt, f"span_{n}": span, f"pps_{n}": n / (span + EPSILON), f"bps_{n}": sum_size / (span + EPSILON)}
    made = {k: F.round(v, digits) if digits is not None else v for k, v in columns.items()}
    return f.select(*KEY, *[c.alias(k) for k, c in made.items()], label().alias("label"))


def feature_names(n: int) -> list[str]:
    return [*[f"s{i}" for i in range(1, n + 1)], *[f"dt{i}" for i in range(2, n + 1)], "mean_size", "std_size", "min_size", "max_size", "sum_size", "mean_dt", "std_dt", "min_dt", "max_dt", f"span_{n}", f"pps_{n}", f"bps_{n}"]


def label(target: int = CAP) -> Column:
    return (F.col("packets") >= target).cast("int")
