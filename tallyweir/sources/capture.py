"""Capture files as a Spark data source: read headers into packets, and write packets as captures.

`spark.read.format("capture").load(path)` takes a file, a folder or a glob. Files are mapped, not held in memory; only headers
are decoded, and rows go to Spark as Arrow batches. A file is read in one pass by one task, as the format has no index; with
the option splitbytes, a file of the plain format is read in ranges, each from the first place on at which a chain of sound
records begins, and packets are then numbered by their place in bytes. The option frames=all gives a row for each frame that
does not decode, too, without addresses and protocol: whole-trace counts and clocks are made of all frames. With the option
onelinktype, files of different link types are an error, else other files than Ethernet are passed over. Inputs that only
Spark's file systems reach are read by `read_captures`, which takes the bytes from Spark's binary file source.
"""

from __future__ import annotations

import glob
import mmap
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tallyweir.schema import PACKETS

# The magic numbers of capture files, by byte order and unit of the fraction of a second.
MAGICS = {b"\xa1\xb2\xc3\xd4": (">", 1), b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1000)}
SECTION, INTERFACE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 3, 6
ETHERNET, IPV4, VLAN = 1, 0x0800, 0x8100
ROWS = 50_000


class BadCapture(ValueError):
    """The file is no Ethernet capture."""


def link_type(data) -> int | None:
    """The link type that a capture's head names; None if it has no such head."""
    if bytes(data[:4]) in MAGICS and len(data) >= 24:
        return struct.unpack_from(MAGICS[bytes(data[:4])][0] + "I", data, 20)[0] & 0x0FFFFFFF
    return None


def plain_head(data) -> tuple[str, int]:
    """Byte order, and units of the fraction in a microsecond, of a capture of the plain format."""
    if bytes(data[:4]) not in MAGICS:
        raise BadCapture("no capture")
    if len(data) < 24:
        raise BadCapture("cut off")
    if link_type(data) != ETHERNET:
        raise BadCapture("not Ethernet")
    return MAGICS[bytes(data[:4])]


def frames(data, start: int = 24, stop: int | None = None) -> Iterator[tuple[int, bytes, int]]:
    """(time in microseconds, captured bytes, length on the wire) of a capture, of either format; a cut-off record ends it."""
    if bytes(data[:4]) == struct.pack(">I", SECTION):
        yield from _blocks(data)
        return
    for _, *frame in plain_frames(data, start, stop):
        yield tuple(frame)


def plain_frames(data, start: int = 24, stop: int | None = None) -> Iterator[tuple[int, int, bytes, int]]:
    """(place in bytes, and as in `frames`) of the records of the plain format that begin from start to before stop."""
    order, unit = plain_head(data)
    at, head, end = start, struct.Struct(order + "IIII"), len(data)
    stop = end if stop is None else stop
    while at < stop and at + 16 <= end:
        sec, part, held, wire = head.unpack_from(data, at)
        if at + 16 + held > end:
            return
        yield at, sec * 1_000_000 + part // unit, data[at + 16 : at + 16 + held], wire
        at += 16 + held


#: Records in a row that make a place a sound one, and what a record may be: bytes at most, seconds off the file's first packet.
CHAIN, LARGEST, FURTHEST = 6, 1 << 18, 400 * 86_400


def next_record(data, start: int, stop: int) -> int:
    """The first place from start to before stop at which a chain of sound records begins, or stop."""
    order, unit = plain_head(data)
    head, end = struct.Struct(order + "IIII"), len(data)
    first = head.unpack_from(data, 24)[0] if end >= 40 else 0

    def sound(at: int) -> bool:
        for n in range(CHAIN):
            if at == end:
                return n > 0
            if at + 16 > end:
                return False
            sec, part, held, wire = head.unpack_from(data, at)
            if not (held <= wire <= LARGEST and held and part < 1_000_000 * unit and abs(sec - first) <= FURTHEST):
                return False
            if at + 16 + held > end:  # cut off
                return n > 0
            at += 16 + held
        return True

    return next((at for at in range(max(start, 24), stop) if sound(at)), stop)


def _blocks(data: bytes) -> Iterator[tuple[int, bytes, int]]:
    at, order, units = 0, "<", []
    while at + 12 <= len(data):
        kind = struct.unpack_from(order + "I", data, at)[0]
        if kind == SECTION:
            order = "<" if bytes(data[at + 8 : at + 12]) == b"\x4d\x3c\x2b\x1a" else ">"
            units = []
        kind, size = struct.unpack_from(order + "II", data, at)
        if size < 12 or at + size > len(data):
            return
        if kind == INTERFACE:
            link = struct.unpack_from(order + "H", data, at + 8)[0]
            if link != ETHERNET:
                raise BadCapture("not Ethernet")
            unit, option = 1_000_000, at + 16
            while option + 4 <= at + size - 4:
                code, length = struct.unpack_from(order + "HH", data, option)
                if code == 9 and length:
                    r = data[option + 4]
                    unit = 1 << (r & 127) if r & 128 else 10**r
                if not code:
                    break
                option += 4 + (length + 3 & ~3)
            units.append(unit)
        elif kind == ENHANCED:
            interface, high, low, held, wire = struct.unpack_from(order + "IIIII", data, at + 8)
            unit = units[interface] if interface < len(units) else 1_000_000
            yield (high << 32 | low) * 1_000_000 // unit, data[at + 28 : at + 28 + held], wire
        elif kind == SIMPLE:
            wire = struct.unpack_from(order + "I", data, at + 8)[0]
            yield 0, data[at + 12 : at + 12 + min(wire, size - 16)], wire
        at += size


def decode(frame: bytes, vlan: bool = False, every: bool = False) -> tuple | None:
    """(src, dst, src port, dst port, proto, IP length, seq, ack, flags) of an Ethernet frame; None if it is not wanted.

    Only IPv4, and only TCP and UDP unless `every`. A VLAN tag is looked through if `vlan`.
    """
    if len(frame) < 34:
        return None
    kind, at = struct.unpack_from(">H", frame, 12)[0], 14
    if kind == VLAN and vlan and len(frame) >= 38:
        kind, at = struct.unpack_from(">H", frame, 16)[0], 18
    if kind != IPV4:
        return None
    head = (frame[at] & 15) * 4
    if frame[at] >> 4 != 4 or head < 20 or len(frame) < at + head:
        return None
    length, proto = struct.unpack_from(">H", frame, at + 2)[0], frame[at + 9]
    src, dst = struct.unpack_from(">II", frame, at + 12)
    at += head
    if proto == 6 and len(frame) >= at + 14:
        sport, dport, seq, ack = struct.unpack_from(">HHII", frame, at)
        return src, dst, sport, dport, proto, length, seq, ack, frame[at + 13]
    if proto == 17 and len(frame) >= at + 4:
        return (src, dst, *struct.unpack_from(">HH", frame, at), proto, length, None, None, None)
    return (src, dst, 0, 0, proto, length, None, None, None) if every else None


def rows(name: str, data, vlan: bool = False, every: bool = False, tolerant: bool = True, undecoded: bool = False, part: tuple[int, int] | None = None) -> Iterator[tuple]:
    """Packets of one capture, numbered by place in the file over all frames. A file that is no capture gives none, or fails.

    undecoded: frames that do not decode give a row with place, time and length 0 only. part: the records that begin in
    this range of bytes, numbered by their place in bytes.
    """
    try:
        if part is None:
            found = ((n, *f) for n, f in enumerate(frames(data)))
        else:
            start, stop = part
            found = plain_frames(data, 24 if start <= 24 else next_record(data, start, min(stop, len(data))), stop)
        for n, ts, frame, _ in found:
            if p := decode(frame, vlan, every):
                src, dst, sport, dport, proto, length, seq, ack, flags = p
                yield name, n, ts, src, dst, sport, dport, proto, length, seq, ack, flags
            elif undecoded:
                yield name, n, ts, None, None, None, None, None, 0, None, None, None
    except BadCapture:
        if not tolerant:
            raise


ARROW = pa.schema([("file", pa.string()), ("pkt_no", pa.int64()), ("ts_us", pa.int64()), ("src_ip_n", pa.int64()), ("dst_ip_n", pa.int64()), ("src_port", pa.int32()), ("dst_port", pa.int32()), ("proto", pa.int32()), ("ip_len", pa.int32()), ("tcp_seq", pa.int64()), ("tcp_ack", pa.int64()), ("tcp_flags", pa.int32())])


def batches(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in found:
        held.append(row)
        if len(held) == ROWS:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), ARROW)], schema=ARROW)


def wanted(name: str) -> bool:
    base = os.path.basename(name)
    return not base.startswith(".") and base.lower().endswith((".pcap", ".pcapng"))


def listed(path: str, suffix: str | None = None) -> list[str]:
    """The captures of a file, a folder (not its subfolders) or a glob, sorted; with a suffix, a folder's files that end in exactly it."""
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        fits = (lambda n: n.endswith(suffix)) if suffix else wanted
        return sorted(p for p in (os.path.join(path, n) for n in os.listdir(path)) if fits(p) and os.path.isfile(p))
    return sorted(glob.glob(path))


class mapped:
    """A file's bytes, mapped; an empty file has none."""

    def __init__(self, path: str):
        self.path = path

    def __enter__(self):
        self.file = open(self.path, "rb")
        self.data = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ) if os.fstat(self.file.fileno()).st_size else b""
        return self.data

    def __exit__(self, *_) -> None:
        if self.data:
            self.data.close()
        self.file.close()


class CaptureFile(InputPartition):
    def __init__(self, path: str, part: tuple[int, int] | None = None):
        super().__init__(path)
        self.path, self.part = path, part


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        flag = lambda k, d: str(options.get(k, d)).lower() == "true"
        self.paths, self.suffix, self.vlan, self.every, self.tolerant = options["path"], options.get("suffix"), flag("vlan", "false"), flag("everyprotocol", "false"), flag("tolerant", "true")
        self.undecoded, self.one_link_type, self.split = options.get("frames", "decoded") == "all", flag("onelinktype", "false"), int(options.get("splitbytes", 0))

    def partitions(self) -> list[CaptureFile]:
        paths = listed(self.paths, self.suffix)
        if self.one_link_type:
            kinds = {}
            for p in paths:
                with mapped(p) as data:
                    kinds[p] = link_type(data)
            if len(set(kinds.values())) > 1:
                raise BadCapture(f"captures of different link types: {kinds}")
        if not self.split:
            return [CaptureFile(p) for p in paths]
        out = []
        for p in paths:
            size = os.path.getsize(p)
            with open(p, "rb") as f:
                plain = f.read(4) in MAGICS
            out += [CaptureFile(p, (a, a + self.split)) for a in range(0, size, self.split)] if plain else [CaptureFile(p)]
        return out

    def of(self, partition: CaptureFile) -> Iterator[tuple]:
        with mapped(partition.path) as data:
            yield from rows(partition.path, data, self.vlan, self.every, self.tolerant, self.undecoded, partition.part)

    def read(self, partition: CaptureFile) -> Iterator[pa.RecordBatch]:
        yield from batches(self.of(partition))


class CaptureStream(DataSourceStreamReader):
    """A growing folder of captures as a stream: each batch reads the files that came since, in the order of their names.

    Files must be moved in whole, under names that sort after those that are there.
    """

    def __init__(self, options: dict):
        self.reader = CaptureReader(options)

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        names = listed(self.reader.paths)
        return {"after": names[-1] if names else ""}

    def partitions(self, start: dict, end: dict) -> list[CaptureFile]:
        return [CaptureFile(p) for p in listed(self.reader.paths) if start["after"] < p <= end["after"]]

    def read(self, partition: CaptureFile) -> Iterator[tuple]:
        yield from self.reader.of(partition)


def frame_of(src: int, dst: int, sport: int, dport: int, proto: int, length: int, seq: int | None = None, ack: int | None = None, flags: int | None = None) -> bytes:
    """An Ethernet frame with the headers of a packet; its payload is left out of the capture."""
    ip = struct.pack(">BBHHHBBHII", 0x45, 0, length, 0, 0, 64, proto, 0, src, dst)
    if proto == 6:
        body = struct.pack(">HHIIBBHHH", sport, dport, seq or 0, ack or 0, 0x50, flags or 0, 0, 0, 0)
    else:
        body = struct.pack(">HHHH", sport, dport, max(8, length - 20) & 0xFFFF, 0)
    return b"\0" * 12 + struct.pack(">H", IPV4) + ip + body


def capture_bytes(packets: Iterator[tuple[int, bytes, int]], nanoseconds: bool = False, order: str = "<") -> Iterator[bytes]:
    """A capture file, piece by piece, of (time in microseconds, frame, length on the wire)."""
    magic = 0xA1B23C4D if nanoseconds else 0xA1B2C3D4
    yield struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, ETHERNET)
    for ts, frame, wire in packets:
        yield struct.pack(order + "IIII", ts // 1_000_000, ts % 1_000_000 * (1000 if nanoseconds else 1), len(frame), wire) + frame


class Written(WriterCommitMessage):
    def __init__(self, path: str, packets: int):
        self.path, self.packets = path, packets


class CaptureWriter(DataSourceWriter):
    """Each partition becomes one capture; rows are written in the partition's order."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].removeprefix("file://"), overwrite

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        target, n = os.path.join(self.path, f"part-{context.partitionId():05d}.pcap"), 0
        hidden = os.path.join(self.path, f".part-{context.partitionId():05d}-{context.taskAttemptId()}.tmp")

        def made() -> Iterator[tuple[int, bytes, int]]:
            nonlocal n
            for r in iterator:
                n += 1
                yield r.ts_us, frame_of(r.src_ip_n, r.dst_ip_n, r.src_port, r.dst_port, r.proto, r.ip_len, r.tcp_seq if "tcp_seq" in r else None, r.tcp_ack if "tcp_ack" in r else None, r.tcp_flags), r.ip_len + 14

        with open(hidden, "wb") as f:
            for piece in capture_bytes(made()):
                f.write(piece)
        os.replace(hidden, target)  # a lost task leaves no half file
        return Written(target, n)

    def commit(self, messages: list) -> None:
        if self.overwrite and os.path.isdir(self.path):
            kept = {m.path for m in messages if m}
            for p in listed(self.path):
                if p not in kept:
                    os.remove(p)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self):
        return PACKETS

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)

    def streamReader(self, schema) -> CaptureStream:
        return CaptureStream(self.options)

    def writer(self, schema, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CaptureSource)


def read_captures(spark: SparkSession, path: str, vlan: bool = False, every: bool = False, tolerant: bool = True, undecoded: bool = False) -> DataFrame:
    """Packets of captures in any store that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pcap,pcapng,PCAP,PCAPNG}").load(path).select("path", "content")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from batches(rows(name, memoryview(data.as_buffer()).toreadonly(), vlan, every, tolerant, undecoded))

    return files.mapInArrow(run, PACKETS)
