"""The fold that all policies share: packets of a bucket in order, through a table slot, to flows, collisions and counts.

Packets are dealt by bucket and sorted within partitions by Spark, which can spill. Each partition is then read once as a
stream of Arrow batches; only the state of the bucket at hand is in memory, however many packets it has. With
rng="global" one xorshift stream serves all buckets in packet order, so the whole trace is one partition; with
rng="counter" the nth draw of a bucket is a hash of (seed, bucket, n), and buckets are independent.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.functions.keys import canon_numeric, with_bucket
from tallyweir.schema import CAP, FIRST_N, IDLE_SECONDS, KEY, UDP


@dataclass(frozen=True)
class Settings:
    """buckets, aux_buckets: powers of two. scorer: 27 features of the first eight packets -> probability of a long flow."""

    policy: str = "fcfs"
    buckets: int = 4096
    aux_buckets: int = 4096
    cap: int = CAP
    first_n: int = FIRST_N
    idle: int = IDLE_SECONDS
    evict_start: int = 30
    seed: int = 123456789
    rng: str = "counter"
    scorer: Callable[[list[float]], float] | None = field(default=None, compare=False)


class Xorshift32:
    """The 13, 17, 5 generator; a seed of 0 counts as 1."""

    def __init__(self, seed: int):
        self.x = seed & 0xFFFFFFFF or 1

    def draw(self, where: object = None) -> int:
        x = self.x
        x ^= x << 13 & 0xFFFFFFFF
        x ^= x >> 17
        x ^= x << 5 & 0xFFFFFFFF
        self.x = x
        return x


class CounterRng:
    """The nth draw at a place depends on the seed, the place and n alone."""

    def __init__(self, seed: int):
        self.seed, self.n = seed, Counter()

    def draw(self, where: tuple) -> int:
        n = self.n[where]
        self.n[where] = n + 1
        z = self.seed & 0xFFFFFFFFFFFFFFFF
        for part in (*where, n):
            z = (z ^ part) + 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
            z = (z ^ z >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
            z ^= z >> 31
        return z >> 32


@dataclass(slots=True)
class Packet:
    pkt_no: int
    ts_us: int
    src: int
    sport: int
    dst: int
    dport: int
    proto: int
    flags: int
    size: int
    key: tuple
    hash: int

    @property
    def second(self) -> int:
        return self.ts_us // 1_000_000

    @property
    def udp(self) -> bool:
        return self.proto == UDP

    @property
    def syn(self) -> bool:
        return bool(self.flags & 2)

    @property
    def pure_syn(self) -> bool:
        return self.flags == 2

    @property
    def fin(self) -> bool:
        return bool(self.flags & 1)


class Entry:
    """A flow in a slot."""

    __slots__ = ("client", "count", "fins", "key", "last", "lengths", "protected", "seen", "server", "times", "total", "udp", "wins")

    def __init__(self, p: Packet, seen: int = 1):
        self.key, self.udp = p.key, p.udp
        self.client, self.server = (p.src, p.sport), (p.dst, p.dport)
        self.times: list[int] = []
        self.lengths: list[int] = []
        self.count = self.wins = self.total = 0
        self.seen, self.last, self.fins, self.protected = seen, p.second, set(), None

    def add(self, p: Packet, cap: int) -> bool:
        """Whether the packet was stored."""
        self.last = p.second
        self.total += 1
        if self.count >= cap:
            return False
        self.times.append(p.ts_us)
        self.lengths.append(p.size if (p.src, p.sport) == self.client else -p.size)
        self.count += 1
        return True

    def fin(self, p: Packet) -> bool:
        """Notes a FIN; whether both sides have sent one."""
        self.fins.add((p.src, p.sport) == self.client)
        return len(self.fins) == 2

    def idle(self, now: int, limit: int) -> bool:
        return self.udp and now - self.last >= limit

    def features(self, n: int) -> list[float]:
        """The 2n + 11 features of the first n packets; sizes without sign."""
        t, s = [x / 1e6 for x in self.times[:n]], [float(abs(x)) for x in self.lengths[:n]]
        gaps = [b - a for a, b in zip(t, t[1:])]

        def spread(v: list[float]) -> tuple[float, float]:
            mean = sum(v) / len(v)
            variance = sum((x - mean) ** 2 for x in v) / len(v)
            return mean, variance**0.5 if variance > 0 else 0.0

        span = t[-1] - t[0]
        return [*s, *gaps, *spread(s), min(s), max(s), sum(s), *spread(gaps), min(gaps), max(gaps), span, n / (span + 1e-9), sum(s) / (span + 1e-9)]


def plain_scorer(f: list[float]) -> float:
    """A stand-in for a trained model: many large packets in a short time promise a long flow."""
    n = (len(f) - 11) // 2
    mean, span = f[2 * n - 1], f[2 * n + 8]
    return 1 / (1 + 2.718281828459045 ** -((mean - 70) / 20 + (300_000 - span) / 300_000))


RECORDS = "kind string, policy string, bucket long, proto int, pkt_no long, ts_us long, ip1 long, port1 int, ip2 long, port2 int, cli_ip long, cli_port int, srv_ip long, srv_port int, count long, wins long, total long, ts array<long>, len array<int>, end_reason string, in_table string, loser_ip1 long, loser_port1 int, loser_ip2 long, loser_port2 int, winner_was_incumbent int, name string, value long"
_NAMES = [x.split()[0] for x in RECORDS.split(", ")]
_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
_SCHEMA = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in RECORDS.split(", ")])


class Output:
    """What a fold says: flows, collisions, counts."""

    def __init__(self, policy: str):
        self.policy, self.rows, self.counts = policy, [], Counter()

    def flow(self, bucket: int, e: Entry, reason: str, table: str = "main") -> None:
        self.counts[f"flows_{reason}"] += 1
        ip1, port1, ip2, port2, proto = e.key
        self.rows.append({"kind": "flow", "bucket": bucket, "proto": proto, "ts_us": e.times[0] if e.times else None, "ip1": ip1, "port1": port1, "ip2": ip2, "port2": port2, "cli_ip": e.client[0], "cli_port": e.client[1], "srv_ip": e.server[0], "srv_port": e.server[1], "count": e.count, "wins": e.wins, "total": e.total, "ts": [t - e.times[0] for t in e.times], "len": list(e.lengths), "end_reason": reason, "in_table": table})

    def collision(self, bucket: int, p: Packet, winner: tuple, loser: tuple, incumbent_won: bool) -> None:
        self.rows.append({"kind": "collision", "bucket": bucket, "proto": winner[4], "pkt_no": p.pkt_no, "ts_us": p.ts_us, "ip1": winner[0], "port1": winner[1], "ip2": winner[2], "port2": winner[3], "loser_ip1": loser[0], "loser_port1": loser[1], "loser_ip2": loser[2], "loser_port2": loser[3], "winner_was_incumbent": int(incumbent_won)})

    def note(self, bucket: int, name: str, key: tuple) -> None:
        """That something was done with a flow."""
        self.rows.append({"kind": "note", "bucket": bucket, "name": name, "proto": key[4], "ip1": key[0], "port1": key[1], "ip2": key[2], "port2": key[3], "value": 1})

    def batch(self) -> pa.RecordBatch:
        for r in self.rows:
            r["policy"] = self.policy
        b = pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in self.rows], f.type) for n, f in zip(_NAMES, _SCHEMA)], schema=_SCHEMA)
        self.rows = []
        return b

    def totals(self) -> pa.RecordBatch:
        self.rows = [{"kind": "stat", "name": k, "value": v} for k, v in sorted(self.counts.items())]
        return self.batch()


class Policy:
    """A policy's rules over one group of slots. `shared`: TCP and UDP in one table. `whole`: buckets depend on each other."""

    shared = False
    whole = False

    def __init__(self, settings: Settings, out: Output, rng):
        self.s, self.out, self.rng = settings, out, rng
        self.score = settings.scorer or plain_scorer

    def groups(self) -> int:
        """How many groups of slots a protocol has."""
        return self.s.buckets

    def open(self, group: tuple[int, int]) -> object:
        """An empty state."""
        raise NotImplementedError

    def packet(self, state: object, p: Packet) -> None:
        raise NotImplementedError

    def close(self, state: object) -> None:
        """The trace has ended."""
        raise NotImplementedError


COLUMNS = ["pkt_no", "ts_us", "src_ip_n", "src_port", "dst_ip_n", "dst_port", "proto", "tcp_flags", "ip_len", "ip1", "port1", "ip2", "port2", "hash"]


def packet_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], Packet]]:
    for batch in batches:
        for shard, bucket, no, ts, src, sport, dst, dport, proto, flags, size, ip1, port1, ip2, port2, h in zip(*(c.to_pylist() for c in batch.columns)):
            yield (shard, bucket), Packet(no, ts, src, sport, dst, dport, proto, flags or 0, size, (ip1, port1, ip2, port2, proto), h)


def fold(policy: type[Policy], settings: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Output(settings.policy)
        apart = settings.rng != "global"
        rules = policy(settings, out, CounterRng(settings.seed) if apart else Xorshift32(settings.seed))
        states: dict[tuple[int, int], object] = {}
        seen = False
        for group, p in packet_stream(batches):
            seen = True
            if group not in states:
                if apart:  # sorted by group: the one before has ended
                    for g in list(states):
                        rules.close(states.pop(g))
                    rules.rng.n.clear()
                states[group] = rules.open(group)
            rules.packet(states[group], p)
            if len(out.rows) >= 10_000:
                yield out.batch()
        for g in sorted(states):
            rules.close(states[g])
        if out.rows:
            yield out.batch()
        if seen:
            yield out.totals()

    return run


def fold_runs(policy: type[Policy], settings: Settings, runs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Several runs side by side over one stream of packets, each with a seed of its own: (run, name, value) of their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = settings.rng != "global"
        all_rules = []
        for r in range(runs):
            own = replace(settings, seed=settings.seed + r)
            all_rules.append(policy(own, Output(own.policy), CounterRng(own.seed) if apart else Xorshift32(own.seed)))
        states: dict[tuple[int, int], list] = {}

        def close(group: tuple[int, int]) -> None:
            for rules, state in zip(all_rules, states.pop(group)):
                rules.close(state)
                rules.out.rows.clear()

        for group, p in packet_stream(batches):
            if group not in states:
                if apart:  # sorted by group: the one before has ended
                    for g in list(states):
                        close(g)
                    for rules in all_rules:
                        rules.rng.n.clear()
                states[group] = [rules.open(group) for rules in all_rules]
            for rules, state in zip(all_rules, states[group]):
                rules.packet(state, p)
                rules.out.rows.clear()
        for g in sorted(states):
            close(g)
        got = [(r, k, v) for r, rules in enumerate(all_rules) for k, v in sorted(rules.out.counts.items())]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.string()), pa.array([x[2] for x in got], pa.int64())], names=["run", "name", "value"])

    return run


def simulate(packets: DataFrame, policy: type[Policy], settings: Settings, partitions: int | None = None) -> DataFrame:
    """RECORDS of a policy over a trace: flows, collisions, and counts per partition."""
    return dealt(packets, policy, settings, partitions).mapInArrow(fold(policy, settings), RECORDS)


def dealt(packets: DataFrame, policy: type[Policy], settings: Settings, partitions: int | None = None) -> DataFrame:
    """Packets by group of slots, in order."""
    if settings.rng not in ("counter", "global"):
        raise ValueError(f"rng: {settings.rng}")
    probe = policy(settings, Output(""), None)
    keyed = with_bucket(canon_numeric(packets), settings.buckets)
    # the shard is the protocol where each has its own table, and 0 elsewhere
    shard = F.lit(0) if policy.shared else F.col("proto")
    rows = keyed.select(shard.alias("shard"), (F.lit(0) if policy.whole else F.col("hash").bitwiseAND(probe.groups() - 1)).cast("long").alias("group"), *COLUMNS)
    if settings.rng == "global":
        return rows.coalesce(1).sortWithinPartitions("pkt_no")  # one stream of draws: one task by nature
    n = partitions or int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(min(n, 2 * max(1, 1 if policy.whole else probe.groups())), "shard", "group").sortWithinPartitions("shard", "group", "pkt_no")


def flows_of(records: DataFrame) -> DataFrame:
    return records.where("kind = 'flow'").select("policy", "bucket", *KEY, "cli_ip", "cli_port", "srv_ip", "srv_port", "count", "wins", "total", "ts", "len", "end_reason", "in_table", F.col("ts_us").alias("first_ts_us"))


def collisions_of(records: DataFrame) -> DataFrame:
    return records.where("kind = 'collision'").select("policy", "bucket", "proto", "pkt_no", "ts_us", *[F.col(k).alias(f"winner_{k}") for k in KEY[:4]], *[f"loser_{k}" for k in KEY[:4]], "winner_was_incumbent")


def noted(records: DataFrame) -> DataFrame:
    """How often a policy classified flows or let them compete, and how many different flows."""
    return records.where("kind = 'note'").groupBy("policy", "name", *KEY).agg(F.count("*").alias("n")).groupBy("policy", "name").agg(F.sum("n").alias("total"), F.count("*").alias("unique_flows"))


def counts_of(records: DataFrame) -> DataFrame:
    return records.where("kind = 'stat'").groupBy("policy", "name").agg(F.sum("value").alias("value"))
