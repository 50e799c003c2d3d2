import csv
import glob

import numpy as np

from tallyweir.functions.keys import canon_numeric
from tallyweir.operators import flows, groundtruth, sequence, sinks
from tallyweir.policies import catalog
from tallyweir.policies.engine import Settings, collisions_of, flows_of
from tallyweir.sources import capture
from tests.test_flows import packets, udp
from tests.test_policies import frame, trace


def lines(pattern):
    out = []
    for name in sorted(glob.glob(pattern, recursive=True)):
        with open(name) as f:
            out += list(csv.reader(f))
    return out


def test_layouts(spark, tmp_path):
    p = frame(spark, trace(21))
    records = catalog.run(p, "random", Settings(buckets=4, cap=7, idle=10)).cache()
    truth = groundtruth.timing(canon_numeric(p))
    log = groundtruth.collision_table(collisions_of(records), truth)
    sinks.collision_files(log, str(tmp_path / "c"))
    sinks.summary_files(groundtruth.collision_summary(collisions_of(records), truth), str(tmp_path / "s"), timing=True)
    sinks.count_files(flows.packet_counts(canon_numeric(p)), str(tmp_path / "n"))
    c, s, n = (lines(str(tmp_path / x / "*.csv")) for x in "csn")
    assert c[0] == sinks.COLLISIONS and len([r for r in c if r != c[0]]) == log.count()
    assert s[0] == sinks.SUMMARY + sinks.TIMING and n[0] == sinks.COUNTS
    assert sum(int(r[5]) for r in n if r != n[0]) == 900
    wins, losses = sum(int(r[8]) for r in s if r != s[0]), sum(int(r[9]) for r in s if r != s[0])
    assert wins == losses == log.count()
    sinks.table_files(flows_of(catalog.run(p, "three_probe", Settings(buckets=4, aux_buckets=4, cap=7))), str(tmp_path / "t"))
    assert {g.rsplit("=", 1)[1].split("/")[0] for g in glob.glob(str(tmp_path / "t/in_table=*/*.csv"))} == {"main", "aux"}


def test_vectors_and_json(spark, tmp_path):
    rows = [udp(i, i, i % 3 > 0) for i in range(45)]
    r = flows.flow_records(packets(spark, rows), 40, 30)
    sinks.vector_files(r, str(tmp_path / "v"))
    assert glob.glob(str(tmp_path / "v/protocol=UDP/*.txt"))
    sinks.json_files(r, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["count"] == 40


def test_network_step_by_step(spark):
    net = sequence.random_network(3, (4, 3, 5, 2))
    x = np.random.default_rng(1).normal(size=(2, 6, 2))

    def lstm(layer, seq):
        u = layer.recurrent.shape[0]
        h, c, out = np.zeros(u), np.zeros(u), []
        for v in seq:
            z = v @ layer.kernel + h @ layer.recurrent + layer.bias
            for k in range(u):
                gate = lambda j, k=k, z=z: 1 / (1 + np.exp(-z[j * u + k]))
                c[k] = gate(1) * c[k] + gate(0) * np.tanh(z[2 * u + k])
            h = np.array([1 / (1 + np.exp(-z[3 * u + k])) * np.tanh(c[k]) for k in range(u)])
            out.append(h)
        return out

    for row, got in zip(x, net(x)):
        h = lstm(net.second, lstm(net.first, row))[-1]
        z = np.maximum(h @ net.dense[0] + net.dense[1], 0) @ net.last[0] + net.last[1]
        assert np.allclose(got, np.exp(z) / np.exp(z).sum())
    r = flows.flow_records(packets(spark, [udp(i, i) for i in range(45)] + [udp(100, 9, a=7)]), 40, 30)
    assert sequence.classify(r, sequence.random_network(1)).count() == 1


def test_capture_stream(spark, tmp_path):
    capture.register(spark)
    for i in range(3):
        (tmp_path / f"{i}.pcap").write_bytes(b"".join(capture.capture_bytes(iter([(i, capture.frame_of(1, 2, 3, 4, 17, 40), 54)] * (i + 1)))))
    q = spark.readStream.format("capture").load(str(tmp_path)).writeStream.format("memory").queryName("captured").start()
    q.processAllAvailable()
    assert spark.table("captured").count() == 6
    (tmp_path / "3.pcap").write_bytes((tmp_path / "2.pcap").read_bytes())
    q.processAllAvailable()
    q.stop()
    assert spark.table("captured").count() == 9
