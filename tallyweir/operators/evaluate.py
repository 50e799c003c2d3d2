"""Evaluation of scores: confusion, sweeps, areas under curves, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(scored: DataFrame, threshold: Column | float = 0.5, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 of (p, label)."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    hit = F.col("p") >= t
    n = lambda c: F.count(F.when(c, 1))
    g = scored.groupBy(*(by or [])).agg(n(hit & (F.col("label") == 1)).alias("tp"), n(hit & (F.col("label") == 0)).alias("fp"), n(~hit & (F.col("label") == 1)).alias("fn"), n(~hit & (F.col("label") == 0)).alias("tn"))
    precision, recall = safe_div(F.col("tp"), F.col("tp") + F.col("fp")), safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    return g.withColumn("precision", F.round(precision, 6)).withColumn("recall", F.round(recall, 6)).withColumn("f1", F.round(safe_div(2 * precision * recall, precision + recall), 6))


def sweep(scored: DataFrame, steps: int = 9) -> DataFrame:
    """The confusion at thresholds 0.1, 0.2, ...: rows are counted by the number of thresholds they reach, then added up."""
    reached = F.aggregate(F.array(*[F.lit(i / 10) for i in range(1, steps + 1)]), F.lit(0), lambda a, t: a + (F.col("p") >= t).cast("int"))
    c = scored.withColumn("r", reached).groupBy("r", "label").agg(F.count("*").alias("c"))  # (steps + 1) * 2 rows
    s = c.crossJoin(F.broadcast(scored.sparkSession.range(1, steps + 1).withColumnRenamed("id", "step")))  # a few rows each
    n = lambda hit, y: F.sum(F.when(hit & (F.col("label") == y), F.col("c")).otherwise(0)).cast("long")
    hit = F.col("r") >= F.col("step")
    g = s.groupBy("step").agg(n(hit, 1).alias("tp"), n(hit, 0).alias("fp"), n(~hit, 1).alias("fn"), n(~hit, 0).alias("tn"))
    precision, recall = safe_div(F.col("tp"), F.col("tp") + F.col("fp")), safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    return g.select((F.col("step") / 10).alias("threshold"), "tp", "fp", "fn", "tn", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(safe_div(2 * precision * recall, precision + recall), 6).alias("f1"))


def by_score(scored: DataFrame) -> DataFrame:
    """Positives and negatives at each distinct score, with sums over all higher or equal ones.

    Scores are pooled first. The running sums go over score bands (thousandths), then within a band, so that no task sees
    all distinct scores.
    """
    g = scored.groupBy("p").agg(F.sum("label").cast("long").alias("pos"), F.sum(1 - F.col("label")).cast("long").alias("neg")).withColumn("band", F.floor(F.col("p") * 1000))
    bands = g.groupBy("band").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    higher = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)  # a thousand bands at most
    over = bands.select("band", F.coalesce(F.sum("bp").over(higher), F.lit(0)).alias("hp"), F.coalesce(F.sum("bn").over(higher), F.lit(0)).alias("hn"))
    w = Window.partitionBy("band").orderBy(F.desc("p"))
    return g.join(F.broadcast(over), "band").select("p", "pos", "neg", (F.sum("pos").over(w) + F.col("hp")).alias("tp"), (F.sum("neg").over(w) + F.col("hn")).alias("fp"))


def areas(scored: DataFrame) -> DataFrame:
    """Average precision (step-wise), area under the ROC curve, and the share of positives."""
    c = by_score(scored)
    t = c.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"), F.sum(F.col("pos") * F.col("fp") - F.col("pos") * F.col("neg") / 2).alias("above"))
    return t.select(F.round(safe_div(F.col("ap"), F.col("P")), 6).alias("pr_auc"), F.round(F.lit(1.0) - safe_div(F.col("above"), F.col("P") * F.col("N")), 6).alias("roc_auc"), F.round(safe_div(F.col("P"), F.col("P") + F.col("N")), 6).alias("positive_rate"))


def top_k(scored: DataFrame, k: int, tie: str) -> DataFrame:
    """The k highest scores; the earlier row first of equal ones."""
    return scored.orderBy(F.desc("p"), F.asc(tie)).limit(k)


def nearest_rank(values: DataFrame, column: str, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Nearest-rank percentiles, with mean and count."""
    p = [F.expr(f"percentile_disc({s}) WITHIN GROUP (ORDER BY {column})").cast("long").alias(f"p{round(100 * s)}") for s in shares]
    return values.agg(F.count("*").alias("n"), F.round(F.avg(column), 6).alias("mean"), *p)


def weighted_accuracy(scored: DataFrame, weight: str) -> DataFrame:
    """Share of the weight that is classified rightly."""
    ok = ((F.col("p") >= 0.5).cast("int") == F.col("label")).cast("int")
    return scored.agg(F.round(safe_div(F.sum(ok * F.col(weight)), F.sum(weight)), 6).alias("weighted_accuracy"), F.round(F.avg(ok), 6).alias("accuracy"))


def argmax(scores: Column) -> Column:
    """The place of the greatest value, from 0."""
    return F.array_position(scores, F.array_max(scores)) - 1
