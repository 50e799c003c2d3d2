"""Keys, sessions, records, features, evaluation and traces on small traces."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from tallyweir.functions import keys
from tallyweir.operators import evaluate, features, flows, groundtruth, learning, sessions, traces
from tallyweir.policies.engine import Entry, Packet
from tallyweir.policies.probes import mix32
from tallyweir.schema import KEY
from tallyweir.sources import training
from tests.simulator import bucket_hash, canonical
from tests.test_policies import frame, trace


def packets(spark, rows):
    return spark.createDataFrame(rows, "pkt_no long, ts_us long, src_ip_n long, dst_ip_n long, src_port int, dst_port int, proto int, ip_len int, tcp_flags int")


def udp(no, second, forward=True, a=1, ap=5, b=2, bp=6, size=100):
    return (no, int(second * 1e6), a if forward else b, b if forward else a, ap if forward else bp, bp if forward else ap, 17, size, None)


@pytest.mark.parametrize("name", ["numeric", "raw", "lex", "endpoint"])
def test_both_directions_have_one_key(spark, name):
    rng = random.Random(1)
    rows = []
    for i in range(200):
        a, b, ap, bp = rng.randrange(1 << 32), rng.randrange(1 << 32), rng.randrange(1 << 16), rng.randrange(1 << 16)
        if i % 4 == 0:
            b = a
        if i % 8 == 0:
            bp = ap
        rows += [udp(2 * i, i, True, a, ap, b, bp), udp(2 * i + 1, i, False, a, ap, b, bp)]
    found = keys.CANONS[name](packets(spark, rows)).withColumn("pair", F.floor(F.col("pkt_no") / 2)).groupBy("pair").agg(F.countDistinct(*KEY).alias("n"))
    assert found.where("n <> 1").count() == 0


def test_hash_and_buckets_against_scalar(spark):
    rows = trace(3, 60)
    got = {tuple(r[k] for k in KEY): r.hash for r in keys.with_bucket(keys.canon_numeric(frame(spark, rows)), 16).collect()}
    assert got == {canonical(p): bucket_hash(canonical(p)) for p in rows}
    numbers = [0, 1, 2**31, 2**32 - 1, 123456789]
    assert [r.m for r in spark.createDataFrame([(n,) for n in numbers], "n long").select(keys.mix32(F.col("n")).alias("m")).collect()] == [mix32(n) for n in numbers]
    keys.register(spark)
    assert spark.sql("SELECT flow_ip(3232235521) a, flow_fnv('') b, flow_fnv('a') c").first() == ("192.168.0.1", 2166136261, 0xE40C292C)
    assert spark.sql("SELECT flow_id(16909060, 5, 3232235521, 53, 17) a").first().a == "1.2.3.45192.168.0.153UDP"
    assert [r.n for r in spark.createDataFrame([("1.2.3.4",), ("256.1.1.1",), ("a",), ("1.2.3",)], "s string").select(keys.ip_number(F.col("s")).alias("n")).collect()] == [16909060, None, None, None]


def test_idle_boundaries(spark):
    """Whole seconds count, not time elapsed; a gap with and without another packet in it."""
    rows = [udp(0, 0.0), udp(1, 29.999), udp(2, 59.0), udp(3, 89.5), udp(4, 119.4), udp(5, 119.9, a=8), udp(6, 150.0), udp(7, 200.0, a=8), udp(8, 200.5)]
    p = keys.canon_numeric(packets(spark, rows))
    wheel = {r.pkt_no: r.session_no for r in sessions.udp_sessions_wheel(p, 30).collect()}
    assert [wheel[i] for i in (0, 1, 2, 3, 4, 6, 8)] == [1, 1, 2, 3, 4, 5, 6]
    scan = {r.pkt_no: r.session_no for r in sessions.udp_sessions_scan(p, 30).collect()}
    # only packet 8 comes after another flow's packet that is 30 s after this flow's last one
    assert [scan[i] for i in (0, 1, 2, 3, 4, 6, 8)] == [1, 1, 1, 1, 1, 1, 2]


def test_previous_second_over_runs(spark, monkeypatch):
    monkeypatch.setattr(sessions, "RUN", 4)
    rows = [udp(i, i * 3) for i in (0, 1, 2, 9, 10, 30, 31)]
    got = [r.prev_sec for r in sessions.previous_second(packets(spark, rows)).orderBy("pkt_no").collect()]
    assert got == [None, 0, 3, 6, 27, 30, 90]


def test_records_sign_cap_and_zero_span(spark):
    rows = [udp(i, 5.0 if i < 3 else 5.0 + i, i % 2 == 0) for i in range(45)]
    r = flows.flow_records(packets(spark, rows), 40, 30).first()
    assert (r["count"], r.total, r.cli_ip, r.srv_ip) == (40, 45, 1, 2)
    assert r["len"][:3] == [100, -100, 100] and r.ts[:3] == [0.0, 0.0, 0.0]
    line = flows.csv_lines(flows.flow_records(packets(spark, rows), 40, 30), 40).first().line
    assert line.startswith('0.0.0.150.0.0.26UDP,"[(0.000000, 100.0), (-0.000000, -100.0), (0.000000, 100.0), (-3.000000')
    short = flows.flow_records(packets(spark, rows[:39]), 40, 30)
    assert flows.csv_lines(short, 40).count() == 0 and flows.json_records(short).count() == 1
    assert sum(m.flows_in for m in flows.messages(short).collect()) == 1


def test_tcp_records(spark):
    """A SYN begins, the FINs of both sides end once the cap is reached, and the next SYN begins anew."""

    def tcp(no, forward, flags, size=60):
        return (no, no * 1_000_000, 1 if forward else 2, 2 if forward else 1, 5 if forward else 6, 6 if forward else 5, 6, size, flags)

    rows = [tcp(0, True, 16), tcp(1, False, 18), tcp(2, True, 16), tcp(3, True, 17), tcp(4, False, 17), tcp(5, True, 17, 99), tcp(6, False, 16), tcp(7, True, 2), tcp(8, True, 17), tcp(9, False, 1)]
    got = flows.tcp_flow_records(packets(spark, rows).repartition(3), 3).collect()
    # the flow's client is the sender of the first SYN; both FINs at packet 4 with three packets held
    assert [(r.session_no, r.cli_ip, r.cli_port, r["count"], r.total, r.ts, r["len"]) for r in got] == [(1, 2, 6, 3, 4, [0.0, 1.0, 2.0], [60, -60, -60]), (2, 1, 5, 3, 3, [0.0, 1.0, 2.0], [60, 60, -60])]
    assert flows.tcp_flow_records(packets(spark, rows), 4).select("total").collect() == [(4,)]
    text = flows.dump_text(flows.tcp_flow_records(packets(spark, rows), 4)).first().text
    assert text.split("\n")[:2] == ["=== Flow 0.0.0.2:6 ⇆ 0.0.0.1:5 (TCP) packets:4 ===", "0.000000  len=60"]


def wheel(rows, idle, slots):
    """A wheel of slots, second by second: the session of each packet."""
    clock, table, out, count = None, {}, {}, {}
    for no, ts, a, b, ap, bp, *_ in sorted(rows):
        s = ts // 1_000_000
        clock = s if clock is None else clock
        while clock < s:
            clock += 1
            for k in [k for k, slot in table.items() if slot == clock % slots]:
                del table[k]
        k = min((a, ap), (b, bp)), max((a, ap), (b, bp))
        if k not in table:
            count[k] = count.get(k, 0) + 1
        table[k] = (s + idle) % slots
        out[no] = count[k]
    return out


def test_late_packets_on_a_wheel(spark):
    rng = random.Random(12)
    now, rows = 1000, []
    for i in range(600):
        now += rng.choice((0, 0, 1, 3, 40)) if rng.random() < 0.95 else 300
        late = rng.choice((0, 0, 0, 5, 40, 100, 400))
        rows.append(udp(i, max(0, now - late), rng.random() < 0.5, a=rng.randrange(1, 6)))
    p = keys.canon_numeric(packets(spark, rows).repartition(3))
    got = {r.pkt_no: r.session_no for r in sessions.udp_sessions_strict(p, 30).collect()}
    assert got == wheel(rows, 30, 256)
    in_order = [udp(i, 3 * i if i % 7 else 3 * i) for i in range(50)]
    q = keys.canon_numeric(packets(spark, in_order))
    assert sorted(sessions.udp_sessions_strict(q, 30).select("pkt_no", "session_no").collect()) == sorted(sessions.udp_sessions_wheel(q, 30).select("pkt_no", "session_no").collect())


def test_field_hashes_bits_and_signatures(spark):
    rng = random.Random(13)
    rows = [(rng.randrange(1 << 32), rng.randrange(1 << 16), rng.randrange(1 << 32), rng.randrange(1 << 16), rng.choice((6, 17))) for _ in range(100)]
    df = spark.createDataFrame(rows, "ip1 long, port1 int, ip2 long, port2 int, proto int").select("*", keys.fnv_fields().alias("h"), keys.bloom_positions(1 << 28, 4).alias("at"), keys.signature().alias("s"))
    wire = lambda n: int.from_bytes(n.to_bytes(4, "little"), "big")
    for r in df.collect():
        h = 2166136261
        for v in (wire(r.ip1), wire(r.ip2), r.port1, r.port2, r.proto):
            h = (h ^ v) * 16777619 % 2**32
        two = mix32(h ^ 0x9E3779B9) or 0x27D4EB2D
        assert r.h == h and r["at"] == [(h + i * two) % 2**32 & (1 << 28) - 1 for i in range(4)]
        x = wire(r.ip1) << 32 ^ wire(r.ip2) ^ r.port1 << 48 ^ r.port2 << 32 ^ r.proto
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * m % 2**64
        x ^= x >> 33
        assert r.s % 2**64 == (x or 1)
    bits = spark.createDataFrame([(b,) for b in (0, 5, 63, 5)], "b int").agg(keys.bit_set(F.col("b")).alias("w"))
    assert bits.first().w % 2**64 == 1 | 1 << 5 | 1 << 63
    assert [r.x for r in bits.select(F.explode(F.array(*[keys.has_bit(F.col("w"), F.lit(i)) for i in (0, 1, 5, 63)])).alias("x")).collect()] == [True, False, True, True]


def test_features_equal_the_policies_features(spark):
    rng = random.Random(4)
    rows = [udp(i, 100 + i * rng.random(), rng.random() < 0.5, size=rng.randrange(40, 1500)) for i in range(8)]
    got = features.first_n_features(features.first_packets(keys.canon_numeric(packets(spark, rows)), 8, ["pkt_no"]), 8, None).first()
    e = None
    for r in sorted(rows):
        p = Packet(r[0], r[1], r[2], r[4], r[3], r[5], 17, 0, r[7], (), 0)
        e = e or Entry(p)
        e.add(p, 40)
    want = e.features(8)
    assert [got[n] for n in features.feature_names(8)] == pytest.approx(want, rel=1e-9)
    single = [struct.unpack("f", struct.pack("f", x))[0] for x in want]
    assert want == pytest.approx(single, rel=1e-6, abs=1e-6)


def test_timing(spark):
    rows = [udp(i, i) for i in range(35)] + [udp(100, 50, a=9)]
    got = {r.ip1: r for r in groundtruth.timing(keys.canon_numeric(packets(spark, rows))).collect()}
    assert (got[1].pkts, got[1].hit30_ts_us, got[1].dur_to_30_us, got[1].dur_30_to_last_us) == (35, 29_000_000, 29_000_000, 5_000_000)
    assert (got[2].hit30_ts_us, got[2].dur_to_30_us, got[2].dur_total_us) == (0, 0, 0)


def test_evaluation_against_plain_counts(spark):
    rng = random.Random(6)
    rows = [(round(rng.random(), 2), rng.randrange(2)) for _ in range(300)]
    s = spark.createDataFrame(rows, "p double, label int")
    pos = sum(y for _, y in rows)
    ap = sum((sum(y for p, y in rows if p == t)) * sum(y for p, y in rows if p >= t) / sum(1 for p, _ in rows if p >= t) for t in {p for p, _ in rows}) / pos
    pairs = sum((a > b) + 0.5 * (a == b) for a, x in rows for b, y in rows if x == 1 and y == 0)
    got = evaluate.areas(s).first()
    assert got.pr_auc == pytest.approx(ap, abs=1e-6) and got.roc_auc == pytest.approx(pairs / pos / (300 - pos), abs=1e-6)
    c = evaluate.confusion(s).first()
    assert (c.tp, c.fp) == (sum(y for p, y in rows if p >= 0.5), sum(1 - y for p, y in rows if p >= 0.5))
    sweep = {round(r.threshold, 1): r.tp for r in evaluate.sweep(s).collect()}
    assert sweep == {t / 10: sum(y for p, y in rows if p >= t / 10) for t in range(1, 10)}
    assert evaluate.confusion(s.limit(0)).first().precision == 0.0
    ranks = evaluate.nearest_rank(spark.range(1, 11).withColumnRenamed("id", "v"), "v").first()
    assert (ranks.p25, ranks.p75) == (3, 8)
    assert spark.range(1).select(evaluate.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(2.0))).alias("a")).first().a == 1


def test_sessions_take_files_in_turn():
    assert traces.assign_sessions({0: 10, 1: 3, 2: 4, 3: 1}, [0, 1, 2, 3], 2) == {0: (0, 0, 0), 1: (1, 0, 0), 2: (1, 1, 3), 3: (1, 2, 7)}


def test_merge_rebases_files(spark):
    p = spark.createDataFrame([(0, 0, 100), (0, 1, 160), (1, 0, 500), (2, 0, 7), (2, 1, 9)], "file_no int, pkt_no long, ts_us long")
    assert sorted(tuple(r) for r in traces.merged(p, 2).collect()) == [(0, 0, 0, 0), (0, 0, 1, 60), (0, 2, 0, 60), (0, 2, 1, 62), (1, 1, 0, 0)]
    assert sorted(r.out_us for r in traces.merged_dynamic(p, 2).collect()) == [0, 0, 0, 2, 60]


def test_random_merges_are_drawn_by_their_seed(spark):
    p = spark.createDataFrame([(f, i, 1000 * f + i * 500_000) for f in range(9) for i in range(4)], "file_no int, pkt_no long, ts_us long")
    rows = [traces.in_time_order(traces.merged_dynamic(p, 3, seed=s)).collect() for s in (1, 1, 2)]
    assert rows[0] == rows[1] != rows[2] and all([r.out_us for r in x] == sorted(r.out_us for r in x) for x in rows)
    first = {}
    for r in rows[0]:
        first.setdefault(r.session_no, r.out_us)
    assert len(set(first.values())) == 3 and all(0 <= t <= 2_000_000 for t in first.values()) and [first[s] for s in range(3)] == traces.random_starts(3, 1)
    assert traces.shuffled([3, 1, 2], 5) == traces.shuffled([1, 2, 3], 5) and sorted(traces.shuffled(list(range(50)), 5)) == list(range(50)) != traces.shuffled(list(range(50)), 5)


def test_a_target_for_each_file(spark):
    rows = packets(spark, [udp(i, 0, a=0x98170102, b=0x01020304) for i in range(3)]).withColumn("file", F.element_at(F.array(F.lit("b.pcap"), F.lit("a.pcap"), F.lit("c.pcap")), (F.col("pkt_no") + 1).cast("int")))
    got = {r.file: (r.src_ip_n, r.dst_ip_n, r.target) for r in traces.rewrite_files(rows, 0x98170000, 16, 0x98170001, 32).collect()}
    assert got == {f: (0x98170001 + i, 0x01020304, 0x98170001 + i) for i, f in enumerate(("a.pcap", "b.pcap", "c.pcap"))}
    assert {r.src_ip_n for r in traces.rewrite_files(rows, 0x98170000, 16, 0x0A000001, 8).collect()} == {0x0A170102}


def test_prefix_rewrite(spark):
    got = traces.rewrite_prefix(packets(spark, [udp(0, 0, a=0x98170102, b=0x01020304)]), 0x98170000, 16, 0x0A000000).first()
    assert (got.src_ip_n, got.dst_ip_n) == (0x0A000102, 0x01020304)


def test_training_lines(spark):
    lines = [
        "l1,l2,10.0.0.2,5,10.0.0.1,80,UDP,1.5,nan,2.5,x,,100,200,300", "l,10.0.0.1,80,10.0.0.2,5,UDP,2.0,,-50, ,", "no,address,at,all,1,2,3,4,5,6,7", "l,10.0.0.1,eighty,10.0.0.2,5,UDP,2.0,,50,60,70",
        "l,10.0.0.1,80,10.0.0.2,5,UDP,2.0,3.0,4.0,5.0", "short,1.1.1.1", "l,::1,1,fe80::2,2,TCP,1,2,,9,8", "", "l,10.0.0.1,80,10.0.0.2,5,UDP,,1,2,3,4,5",
    ]
    parsed = training.parse(spark.createDataFrame([("f.csv", x) for x in lines], "group string, line string"))
    got = {(r.ip1, r.port1, r.ip2, r.port2): list(zip(r.ts, r["size"])) for r in training.flows(parsed).collect()}
    assert got == {("10.0.0.1", 80, "10.0.0.2", 5): [(1.5, 100.0), (2.0, -50.0), (2.5, 200.0)], ("::1", 1, "fe80::2", 2): [(1.0, 9.0), (2.0, 8.0)]}


def test_training_lines_of_single_packets(spark):
    one, other, third = 0x0A000001, 0x0A000002, 0x0A000009
    rows = [udp(0, 0, True, one, b=other, size=60), udp(1, 5, False, one, b=other, size=70), udp(2, 7, False, one, b=other, size=80), udp(3, 9, False, third, b=other, size=90)]
    lines = training.lines_of(packets(spark, rows).withColumn("turn", F.col("pkt_no")))
    got = {r.ip1: (r.packets, list(zip(r.ts, r["size"]))) for r in training.flows(training.parse(lines)).collect()}
    assert got == {"10.0.0.1": (3, [(0.0, 60.0), (5.0, 70.0), (7.0, 80.0)]), "10.0.0.2": (1, [(9.0, 90.0)])}


def test_training_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.csv", "sub/b.csv", "c_labeled.csv", "d_with_domain_name.csv", "e.txt"):
        (tmp_path / name).write_text("l,10.0.0.1,80,10.0.0.2,5,UDP,2.0,,50,60,70\n")
    assert sorted(r.group for r in training.read_lines(spark, str(tmp_path)).collect()) == ["a.csv", "b.csv"]
    for name in ("a.csv", "sub/b.csv"):
        (tmp_path / name).unlink()
    with pytest.raises(FileNotFoundError):
        training.read_lines(spark, str(tmp_path))


def test_addresses(spark):
    cells = ["1.2.3.4", " 10.0.0.255 ", "256.1.1.1", "1.2.3", "1.2.3.4.5", "a.b.c.d", "::1", "fe80::2", "12:30", "1::2::3", "", "01.002.3.4", "1.2.3.", "0.0.0.0", "1e1.2.3.4"]
    got = [r.x for r in spark.createDataFrame([(c,) for c in cells], "c string").select(training.is_address(F.col("c")).alias("x")).collect()]
    assert got == [True, True, False, False, False, False, True, True, False, True, False, True, False, True, False]

def test_models_score_save_and_serve_duels(spark, tmp_path):
    rng = random.Random(8)
    names = features.feature_names(3)
    rows = [(1, 1, i, 1, 17, *[rng.random() + (y if j % 2 else 0) for j in range(len(names))], y) for i in range(120) for y in [i % 3 == 0]]
    rows = [(*r[:-1], int(r[-1])) for r in rows]
    data = spark.createDataFrame(rows, ", ".join(["ip1 long, port1 int, ip2 long, port2 int, proto int", *[f"{n} double" for n in names], "label int"]))
    model = learning.train(data, learning.logistic(3))
    scored = learning.score(model, data)
    assert learning.report(scored).first().roc_auc > 0.95
    p = learning.as_scorer(model)
    by = {r.ip2: r.p for r in scored.collect()}
    assert all(p(list(r[5:-1])) == pytest.approx(by[r[2]], abs=1e-6) for r in rows[:20])
    with pytest.raises(ValueError):
        p([1.0])
    with pytest.raises(ValueError):
        learning.score(model, data.drop("s1"))
    learning.save(model, str(tmp_path / "m"), 3)
    assert learning.score(learning.load(str(tmp_path / "m")), data).count() == 120
    assert learning.score(learning.train(data, learning.forest(3, 5, 3)), data).where("p between 0 and 1").count() == 120
