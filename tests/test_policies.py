"""Policies against the plain simulator, packet by packet."""

import random

import pytest
from pyspark.sql import functions as F

from tallyweir.policies import catalog
from tallyweir.policies.engine import CounterRng, Settings, Xorshift32, collisions_of, counts_of, flows_of, noted
from tallyweir.schema import KEY
from tests.simulator import gated_probe, simulate, three_probe

PACKET = "pkt_no long, ts_us long, src_ip_n long, dst_ip_n long, src_port int, dst_port int, proto int, ip_len int, tcp_flags int"


def trace(seed, n=900, flows=14):
    """Packets in order, with quiet times, SYNs, FINs and both directions."""
    rng = random.Random(seed)
    ends = [(167772160 + rng.randrange(9), rng.randrange(1000, 1005), 3232235520 + rng.randrange(3), rng.choice((53, 80))) for _ in range(flows)]
    now, out = 1_000_000_000, []
    for i in range(n):
        now += rng.choice((0, 10, 1_000, 400_000, 2_000_000)) if rng.random() < 0.97 else 12_000_000
        k = rng.randrange(flows)
        a, ap, b, bp = ends[k]
        if rng.random() < 0.4:
            a, ap, b, bp = b, bp, a, ap
        proto = 17 if k % 2 else 6
        flags = rng.choice((16, 16, 16, 2, 18, 17)) if proto == 6 else None
        out.append({"no": i, "ts": now, "src": a, "sport": ap, "dst": b, "dport": bp, "proto": proto, "flags": flags or 0, "size": rng.randrange(40, 1500)})
    return out


def frame(spark, packets):
    return spark.createDataFrame([(p["no"], p["ts"], p["src"], p["dst"], p["sport"], p["dport"], p["proto"], p["size"], p["flags"] if p["proto"] == 6 else None) for p in packets], PACKET).repartition(3)


def long_enough(t, s):
    return sum(s) > 2200


def scorer(f):
    n = (len(f) - 11) // 2
    return 1.0 if sum(f[:n]) > 2200 else 0.0


def got_flows(records):
    return sorted((tuple(r[k] for k in KEY), r["count"], r.wins, r.end_reason, r.in_table, r.first_ts_us, tuple(r.ts), tuple(r["len"])) for r in flows_of(records).collect())


def got_log(records):
    return sorted((r.pkt_no, tuple(r[f"winner_{k}"] for k in KEY[:4]) + (r.proto,), tuple(r[f"loser_{k}"] for k in KEY[:4]) + (r.proto,), r.winner_was_incumbent) for r in collisions_of(records).collect())


@pytest.mark.parametrize("policy", [p for p in catalog.POLICIES if not p.endswith("_probe") and p not in ("duel",)])
def test_policy_against_simulator(spark, policy):
    for seed, rng in ((1, "counter"), (2, "counter"), (3, "global")):
        packets = trace(seed)
        options = {"buckets": 4, "aux_buckets": 2 if policy == "duel_even" else 4, "cap": 7, "first_n": 3, "idle": 10, "evict_start": 4, "seed": seed, "rng": rng}
        records = catalog.run(frame(spark, packets), policy, Settings(scorer=scorer, **options)).cache()
        flows, log = simulate(packets, policy, score=long_enough, **options)
        assert got_flows(records) == sorted(flows)
        assert got_log(records) == sorted(log)
        assert len(flows) > 3
        records.unpersist()


def test_first_come_ignores_the_seed_and_gates_udp(spark):
    packets = frame(spark, trace(5))
    a, b = (got_flows(catalog.run(packets, "fcfs", Settings(buckets=8, cap=7, idle=10, seed=s))) for s in (1, 2))
    assert a == b
    udp = [k for k, *_ in a if k[4] == 17]
    assert len(udp) == len(set(udp))


def test_wins_and_losses_make_up_the_collisions(spark):
    records = catalog.run(frame(spark, trace(6)), "random", Settings(buckets=4, cap=7, idle=10))
    counts = {r.name: r.value for r in counts_of(records).collect()}
    assert counts["collisions"] == counts["challenger_wins"] + counts["incumbent_wins"] == collisions_of(records).count()
    assert counts["packets"] == 900


def test_three_probe_tables(spark):
    packets = trace(7, 1500, 40)
    records = catalog.run(frame(spark, packets), "three_probe", Settings(buckets=8, aux_buckets=4, cap=7))
    got = sorted((r.in_table, tuple(r[k] for k in KEY), r["count"], r.total) for r in flows_of(records).collect())
    assert got == three_probe(packets, 8, 4, 7)


def test_gated_probe_tables_keep_their_promises(spark):
    packets = trace(8, 2000, 40)
    records = catalog.run(frame(spark, packets), "gated_probe", Settings(buckets=8, aux_buckets=4, cap=7, idle=10)).cache()
    flows = flows_of(records).collect()
    udp = [tuple(r[k] for k in KEY) for r in flows if r.proto == 17]
    assert len(udp) == len(set(udp)) and all(0 < r["count"] <= 7 for r in flows)
    counts = {r.name: r.value for r in counts_of(records).collect()}
    assert counts["inserted_main"] + counts["inserted_aux"] - counts.get("aux_overwritten", 0) >= len(flows) and counts["promotions"] > 0
    # with room for all, every flow that begins is there
    wide = flows_of(catalog.run(frame(spark, packets), "gated_probe", Settings(buckets=1 << 16, aux_buckets=4, cap=7, idle=10)))
    assert wide.where("in_table = 'aux'").count() == 0


@pytest.mark.parametrize("seed", [8, 9, 10])
def test_gated_probe_tables_against_simulator(spark, seed):
    packets = trace(seed, 1500, 40)
    records = catalog.run(frame(spark, packets), "gated_probe", Settings(buckets=8, aux_buckets=4, cap=7, idle=10))
    got = sorted((r.in_table, tuple(r[k] for k in KEY), r["count"], r.total, r.end_reason) for r in flows_of(records).collect())
    assert got == gated_probe(packets, 8, 4, 7, 10) and {r[4] for r in got} == {"idle", "cap", "fin", "eof"}


def test_classified_and_competing_flows(spark):
    packets, options = trace(12), {"buckets": 4, "aux_buckets": 4, "cap": 7, "first_n": 3, "idle": 10, "seed": 1}
    records = catalog.run(frame(spark, packets), "duel_logged", Settings(scorer=scorer, **options))
    _, log = simulate(packets, "duel_logged", score=long_enough, **options)
    got = {r.name: (r.total, r.unique_flows) for r in noted(records).collect()}
    sides = [k for _, a, b, _ in log for k in (a, b)]
    assert got == {"classified": (len(sides), len(set(sides))), "competed": (len(sides), len(set(sides)))} and sides


def test_replicates(spark):
    r = catalog.replicates(frame(spark, trace(9)), 3, Settings(buckets=4, cap=5, idle=10)).collect()
    assert len(r) == 3 and any(x.full_flows for x in r)


def test_many_replicates_are_one_simulation(spark):
    packets, settings = frame(spark, trace(9)), Settings(buckets=4, cap=5, idle=10)
    r = {x.run: x.full_flows for x in catalog.replicates(packets, 1000, settings).collect()}
    assert sorted(r) == list(range(1000)) and len(set(r.values())) > 1
    for k in (0, 1, 999):
        assert r[k] == catalog.run(packets, "random_replicate", settings, seed=settings.seed + k).where("kind = 'flow' and end_reason = 'cap'").count()


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_together_are_runs_alone(spark, seed):
    packets, settings = frame(spark, trace(20 + seed)), Settings(buckets=2, cap=3, idle=4, seed=seed)
    r = {x.run: x.full_flows for x in catalog.replicates(packets, 40, settings).collect()}
    alone = [catalog.run(packets, "random_replicate", settings, seed=seed + k).where("kind = 'flow' and end_reason = 'cap'").count() for k in range(0, 40, 5)]
    assert [r[k] for k in range(0, 40, 5)] == alone and len(set(r.values())) > 3


def test_draws():
    x = Xorshift32(0)
    assert [x.draw() for _ in range(3)] == [270369, 67634689, 2647435461]
    a, b = CounterRng(5), CounterRng(5)
    assert [a.draw((1, 2)) for _ in range(4)] == [b.draw((1, 2)) for _ in range(4)] and a.draw((1, 3)) != b.draw((1, 4))


def test_empty_trace(spark):
    assert catalog.run(spark.createDataFrame([], PACKET), "fcfs").where(F.col("kind") == "flow").count() == 0
