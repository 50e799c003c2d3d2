"""All policies by name, and repeated runs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.policies import duel, probes, single
from tallyweir.policies.engine import Settings, dealt, fold_runs, simulate
from tallyweir.policies.replicates import capped_runs

POLICIES = {
    "drop_challenger": single.DropChallenger,
    "fcfs": single.FirstCome,
    "reservoir_shared": single.ReservoirShared,
    "reservoir": single.Reservoir,
    "random": single.RandomChance,
    "weighted": single.WeightedChance,
    "random_replicate": single.RandomReplicate,
    "protected": single.Protected,
    "duel_shared": duel.SharedDuel,
    "duel": duel.Duel,
    "duel_gated": duel.GatedDuel,
    "duel_revised": duel.RevisedDuel,
    "duel_even": duel.EvenDuel,
    "duel_logged": duel.LoggedDuel,
    "three_probe": probes.ThreeProbe,
    "gated_probe": probes.GatedProbe,
}


def run(packets: DataFrame, policy: str, settings: Settings | None = None, **options) -> DataFrame:
    """RECORDS of a policy by name."""
    return simulate(packets, POLICIES[policy], replace(settings or Settings(), policy=policy, **options))


def replicates(packets: DataFrame, runs: int, settings: Settings, policy: str = "random_replicate") -> DataFrame:
    """(run, full_flows): flows that reach the cap in each of several runs with seeds of their own."""
    own = replace(settings, policy=policy)
    together = policy == "random_replicate" and own.rng == "counter"  # all runs in one step
    fold = capped_runs(own, runs) if together else fold_runs(POLICIES[policy], own, runs)
    counts = dealt(packets, POLICIES[policy], own).mapInArrow(fold, "run long, name string, value long")
    out = counts.where("name = 'flows_cap'").groupBy("run").agg(F.sum("value").alias("full_flows"))
    n = packets.sparkSession.range(runs).withColumnRenamed("id", "run")
    return n.join(out, "run", "left").fillna(0)
