"""Every query of the engine with SQL against that SQL, and the others for their shape."""

import json

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tallyweir.plans import queries
from tallyweir.plans.queries import QUERIES, SQL
from tallyweir.schema import KEY
from tests.conftest import SF
from tests.simulator import gated_probe, simulate, three_probe

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return str(v)
    x = float(v)
    return str(int(x)) if x == int(x) else repr(round(x, 9))


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, sql, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    r = sql.sql(SQL[name])
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    want = sorted(tuple(plain(x[i]) for i in at) for x in r.fetchall())
    assert sorted(tuple(plain(x[c]) for c in columns) for x in df.collect()) == want


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_query_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(df.collect()) >= 0 and df.columns == QUERIES[name](spark, SF).columns


def events_of(spark):
    """The packets of the event trace as the simulator takes them."""
    rows = queries.events(spark, SF).orderBy("pkt_no").collect()
    return [{"no": r.pkt_no, "ts": r.ts_us, "src": r.src_ip_n, "sport": r.src_port, "dst": r.dst_ip_n, "dport": r.dst_port, "proto": r.proto, "flags": r.tcp_flags or 0, "size": r.ip_len} for r in rows]


@pytest.mark.parametrize("name, policy, options", [("policy_duel_even", "duel_even", {"aux_buckets": 4}), ("policy_random_seeded", "random", {"rng": "global"}), ("policy_weighted_seeded", "weighted", {"rng": "global"})])
def test_policy_queries_against_simulator(spark, name, policy, options):
    own = {"buckets": 16, "aux_buckets": 16, "cap": 40, "first_n": 8, "idle": queries.IDLE, "seed": queries.SMALL.seed, "score": lambda t, s: 0} | options
    want, _ = simulate(events_of(spark), policy, **own)
    got = [(tuple(r[k] for k in KEY), r["count"], r.wins, r.end_reason, r.in_table, r.first_ts_us, tuple(map(int, r.offsets_us.split())), tuple(map(int, r.lengths.split()))) for r in QUERIES[name](spark, SF).collect()]
    assert sorted(got) == sorted(want) and len(got) > 3


def test_probe_queries_against_simulator(spark):
    packets = events_of(spark)
    got = sorted((r.in_table, tuple(r[k] for k in KEY), r["count"], r.total) for r in QUERIES["policy_three_probe"](spark, SF).collect())
    assert got == three_probe(packets, 16, 16, 40) and got
    got = sorted((r.in_table, tuple(r[k] for k in KEY), r["count"], r.total, r.end_reason) for r in QUERIES["policy_gated_probe"](spark, SF).collect())
    assert got == gated_probe(packets, 16, 16, 40, queries.IDLE) and got


def test_json_queries_hold_the_records(spark):
    records = {(tuple(r[k] for k in KEY), r.session_no): r for r in queries._records(spark, SF).collect()}
    dotted = lambda n: ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    plain = lambda r: {"cli_ip": dotted(r.cli_ip), "srv_ip": dotted(r.srv_ip), "cli_port": r.cli_port, "srv_port": r.srv_port, "proto": "UDP", "count": r["count"], "ts": r.ts, "len": r["len"]}
    got = {(tuple(r[k] for k in KEY), r.session_no): json.loads(r.json) for r in QUERIES["flow_json"](spark, SF).collect()}
    assert got == {k: plain(r) for k, r in records.items()} and got
    sent = [f for r in QUERIES["flow_messages"](spark, SF).collect() for f in json.loads(r.message)]
    assert sorted(map(repr, sent)) == sorted(repr(plain(r)) for r in records.values())


def test_statistics_of_every_policy_add_up(spark):
    counts = {}
    for r in QUERIES["policy_statistics"](spark, SF).collect():
        counts.setdefault(r.policy, {})[r.name] = r.value
    packets = spark.read.parquet(f"{SF}/events.parquet").count()
    assert set(counts) == set(queries.catalog.POLICIES) and all(c["packets"] == packets for c in counts.values())
    for policy in ("random", "duel_gated", "gated_probe"):
        flows = QUERIES[f"policy_{policy}"](spark, SF).count()
        assert sum(v for k, v in counts[policy].items() if k.startswith("flows_")) == flows
    for policy in ("random", "weighted", "reservoir"):
        assert counts[policy]["collisions"] >= counts[policy].get("challenger_wins", 0) + counts[policy].get("incumbent_wins", 0) > 0


def test_the_first_of_a_thousand_runs_are_the_five(spark):
    settings = queries.SMALL
    runs = queries.catalog.replicates(queries.events(spark, SF), 1000, settings).orderBy("run").collect()
    assert len(runs) == 1000 and [r.full_flows for r in runs[:5]] == [r.full_flows for r in queries.catalog.replicates(queries.events(spark, SF), 5, settings).orderBy("run").collect()]
    assert QUERIES["monte_carlo_1000"](spark, SF).first().n == 1000


def test_random_merge_is_ordered_and_whole(spark):
    got = [(r.out_us, r.session_no, r.file_no, r.pkt_no) for r in QUERIES["merge_sessions_random"](spark, SF).collect()]
    assert got == sorted(got) and len(got) == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_classes_are_the_networks(spark):
    network = queries.sequence.random_network(1)
    full = {tuple(r[k] for k in KEY) + (r.session_no,): (r.ts, r["len"]) for r in queries._records(spark, SF).where("count = 40").collect()}
    got = {tuple(r[k] for k in KEY) + (r.session_no,): r["class"] for r in QUERIES["sequence_classes"](spark, SF).collect()}
    want = {k: int(network(np.array([list(zip(t, n))], float)).argmax()) for k, (t, n) in full.items()}
    assert got == want


def test_network_weights_go_through_a_file(tmp_path):
    network = queries.sequence.random_network(3, (4, 3, 5, 2))
    queries.sequence.save_network(network, str(tmp_path / "w.npz"))
    x = np.random.default_rng(0).normal(size=(6, 40, 2))
    assert (queries.sequence.load_network(str(tmp_path / "w.npz"))(x) == network(x)).all()
    np.savez(tmp_path / "bad.npz", first_kernel=np.zeros((2, 4)))
    with pytest.raises(ValueError):
        queries.sequence.load_network(str(tmp_path / "bad.npz"))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_forest_is_as_large_as_it_can_be(spark, monkeypatch):
    made = []
    monkeypatch.setattr(queries.learning, "train", lambda rows, pipeline: made.append(pipeline.getStages()[-1]))
    monkeypatch.setattr(queries.learning, "score", lambda model, rows: rows)
    QUERIES["rf_scores"](spark, SF)
    assert [(f.getNumTrees(), f.getMaxDepth(), f.getMinInstancesPerNode()) for f in made] == [(400, 30, 2)]
