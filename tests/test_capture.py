import random
import struct

import pytest

from tallyweir.operators import flows, traces
from tallyweir.sources import capture

UDP = capture.frame_of(0x0A000001, 0x0A000002, 1234, 53, 17, 60)
TCP = capture.frame_of(0x0A000001, 0xC0A80001, 4000, 443, 6, 52, 7, 9, 18)


def test_both_orders_and_units():
    for order in "<>":
        for nano in (False, True):
            data = b"".join(capture.capture_bytes(iter([(1_500_000, UDP, 74), (2_000_001, TCP, 66)]), nano, order))
            got = list(capture.rows("f", data))
            assert [(r[1], r[2], r[5], r[6], r[7], r[8], r[11]) for r in got] == [(0, 1_500_000, 1234, 53, 17, 60, None), (1, 2_000_001, 4000, 443, 6, 52, 18)]


def test_block_format():
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

    data = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0) + struct.pack("<HHB3x", 9, 1, 9) + struct.pack("<HH", 0, 0))
    ns = 1_700_000_000_123_456_789
    data += block(6, struct.pack("<IIIII", 0, ns >> 32, ns & 0xFFFFFFFF, len(UDP), 74) + UDP)
    assert [r[2] for r in capture.rows("f", data)] == [1_700_000_000_123_456]


def test_decoding_rules():
    tagged = UDP[:12] + struct.pack(">HH", 0x8100, 5) + UDP[12:]
    assert capture.decode(tagged) is None and capture.decode(tagged, vlan=True)[4] == 17
    arp = UDP[:12] + b"\x08\x06" + UDP[14:]
    icmp = capture.frame_of(1, 2, 0, 0, 1, 84)
    assert capture.decode(arp) is None and capture.decode(icmp) is None and capture.decode(icmp, every=True)[2:6] == (0, 0, 1, 84)
    options = UDP[:14] + b"\x46" + UDP[15:34] + b"\1\1\1\1" + UDP[34:]
    assert capture.decode(options)[2:4] == (1234, 53)
    assert capture.decode(UDP[:20]) is None and capture.decode(b"") is None


def test_cut_off_and_bad_files():
    data = b"".join(capture.capture_bytes(iter([(1, UDP, 74), (2, UDP, 74)])))
    assert len(list(capture.rows("f", data[:-5]))) == 1
    assert list(capture.rows("f", b"junk")) == [] and list(capture.rows("f", data[:10])) == []
    with pytest.raises(capture.BadCapture):
        list(capture.rows("f", data[:20] + struct.pack("<I", 105) + data[24:], tolerant=False))


def test_frames_that_do_not_decode():
    arp = UDP[:12] + b"\x08\x06" + UDP[14:]
    data = b"".join(capture.capture_bytes(iter([(1, UDP, 74), (2, arp, 60), (3, b"x", 1), (4, TCP, 66)])))
    assert [r[1] for r in capture.rows("f", data)] == [0, 3]
    every = list(capture.rows("f", data, undecoded=True))
    assert [(r[1], r[2], r[7], r[8]) for r in every] == [(0, 1, 17, 60), (1, 2, None, 0), (2, 3, None, 0), (3, 4, 6, 52)]


@pytest.mark.parametrize("order", "<>")
def test_ranges_of_a_file_give_each_packet_once(order):
    rng = random.Random(3)
    made = [(1_600_000_000_000_000 + 1000 * i, rng.choice((UDP, TCP)) + bytes(rng.randrange(256) for _ in range(rng.randrange(200))), 400) for i in range(400)]
    data = b"".join(capture.capture_bytes(iter(made), order=order))
    want = [r[2:] for r in capture.rows("f", data)]
    for size in (97, 1000, 4096, 10**6):
        got = [r for a in range(0, len(data), size) for r in capture.rows("f", data, part=(a, a + size))]
        assert [r[2:] for r in got] == want and [r[1] for r in got] == sorted({r[1] for r in got})


def test_options_of_the_source(spark, tmp_path):
    capture.register(spark)
    arp = UDP[:12] + b"\x08\x06" + UDP[14:]
    for name in ("a.pcap", "b.PCAP", "c.pcapng"):
        (tmp_path / name).write_bytes(b"".join(capture.capture_bytes(iter([(1_000_000 * i, (UDP, TCP, arp)[i % 3], 74) for i in range(30)]))))
    (tmp_path / "empty.pcap").write_bytes(b"")
    read = lambda **o: spark.read.format("capture").options(**o).load(str(tmp_path))
    assert read().count() == 60 and read(suffix=".pcap").count() == 20 and read(splitbytes=300).count() == 60
    every = read(frames="all")
    t = flows.totals(every).first()
    assert (every.count(), t.packets, t.tcp_packets, t.udp_packets, t.flows) == (90, 90, 30, 30, 2)
    assert capture.read_captures(spark, str(tmp_path), undecoded=True).count() == 90
    trace = traces.one_trace(read())
    assert trace.select("pkt_no").distinct().count() == 60 and trace.agg({"file_no": "max"}).first()[0] == 2
    (tmp_path / "token.pcap").write_bytes((tmp_path / "a.pcap").read_bytes()[:20] + struct.pack("<I", 105) + b"")
    assert read().count() == 60
    with pytest.raises(Exception, match="link types"):
        read(onelinktype="true").count()


def test_overwriting_leaves_no_old_files(spark, tmp_path):
    capture.register(spark)
    target = str(tmp_path / "out")
    packets = spark.createDataFrame([("x", i, i, 1, 2, 3, 4, 17, 40, None, None, None) for i in range(8)], capture.PACKETS)
    for parts, mode in ((4, "append"), (1, "overwrite")):
        packets.repartition(parts).write.format("capture").mode(mode).save(target)
    assert spark.read.format("capture").load(target).count() == 8 and len(capture.listed(target)) == 1


def test_source_writes_and_reads(spark, tmp_path):
    capture.register(spark)
    rows = [("x", i, 1_000_000 * i + i, 0x0A000000 + i, 0xC0A80001, 1000 + i, 443, 6 if i % 2 else 17, 40 + i, 5 if i % 2 else None, 6 if i % 2 else None, 16 if i % 2 else None) for i in range(50)]
    packets = spark.createDataFrame(rows, capture.PACKETS)
    target = str(tmp_path / "out")
    packets.repartitionByRange(2, "pkt_no").sortWithinPartitions("ts_us").write.format("capture").mode("append").save(target)
    columns = ["ts_us", "src_ip_n", "dst_ip_n", "src_port", "dst_port", "proto", "ip_len", "tcp_seq", "tcp_ack", "tcp_flags"]
    want = sorted(packets.select(*columns).collect())
    (tmp_path / "out" / ".hidden.pcap").write_bytes(b"no")
    (tmp_path / "out" / "bad.PCAP").write_bytes(b"no")
    back = spark.read.format("capture").load(target)
    assert sorted(back.select(*columns).collect()) == want
    assert sorted(capture.read_captures(spark, target).select(*columns).collect()) == want
    assert back.where("proto = 17").count() == 25
