"""Media columns: baseline JPEG (ITU-T T.81) written and read in numpy.

A payload is stored as the quantised coefficients of a one-component baseline JPEG, 64 bytes to a block in zigzag
order: byte b becomes coefficient b-128, or b-127 from 128 on, so that no coefficient of a payload block is zero and an
all-zero block is padding. With a quantisation step of 1 nothing is lost. Each block is a restart interval of its own,
so the scan falls into segments that are coded and decoded side by side: one numpy step handles the same symbol of all
segments. Scans without restart intervals, or with several components, go through a scalar bit reader with the same
results.

Read back: markers are parsed, scans Huffman-decoded, the luminance DC coefficients alone give a thumbnail of one
pixel for each 8x8 block, and dimensions with thumbnail hashes make the feature.

Defined results: a null text is empty; its payload is 64 zero bytes. Equal texts give equal rows, repeated rows are
repeated, an empty table gives an empty table. A text of any length is coded in runs of blocks; the picture has at most
8191 blocks in a line. A binary that is no baseline JPEG gives null features in `read_features`, and no failure. Only id
and text, or the binary column, are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.llm.common import bounded_batches, sliced

BLOCK = 64
LINE_BLOCKS = 8191
#: Blocks coded at once: bounds the memory of the numpy steps.
RUN_BLOCKS = 1 << 14
#: Code lengths of our Huffman tables: 12 categories of DC, and for AC end-of-block, 16 zeros and ten sizes after no zeros.
DC_BITS, DC_SYMBOLS = (0, 0, 2, 5, 4, 1) + (0,) * 10, (5, 6, 4, 3, 7, 2, 1, 0, 8, 9, 10, 11)
AC_BITS, AC_SYMBOLS = (0, 2, 1, 2, 2, 2, 3) + (0,) * 9, (0x05, 0x04, 0x06, 0x07, 0x03, 0x02, 0x01, 0x08, 0x00, 0x09, 0xF0, 0x0A)


class NotBaseline(ValueError):
    """The bytes are no JPEG, or one of another process than baseline."""


def canonical(bits: tuple[int, ...], symbols: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a Huffman table as a DHT segment gives it."""
    out, code, k = [], 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out.append((symbols[k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


@lru_cache(64)
def lookup(bits: tuple[int, ...], symbols: tuple[int, ...]) -> np.ndarray:
    """For each 16-bit window: length << 8 | symbol of the code it starts with; 0 where there is none."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, code, length in canonical(bits, symbols):
        table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return table


@lru_cache(1)
def coders() -> tuple[np.ndarray, np.ndarray]:
    """For DC and AC, by byte of payload: bits of the symbol with its value's bits, and their number."""
    out = []
    for bits, symbols in ((DC_BITS, DC_SYMBOLS), (AC_BITS, AC_SYMBOLS)):
        codes = {s: (c, n) for s, c, n in canonical(bits, symbols)}
        rows = []
        for b in range(256):
            value = b - 128 if b < 128 else b - 127
            size = abs(value).bit_length()
            code, n = codes[size]
            rows.append((code << size | (value if value > 0 else value + (1 << size) - 1), n + size))
        out.append(rows)
    both = np.array(out, np.uint64)
    return both[:, :, 0], both[:, :, 1]


def code_blocks(payload: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded, stuffed segments of the payload's blocks in a row, and the segments' offsets."""
    n = len(payload) // BLOCK
    codes, lengths = coders()
    symbols = payload.reshape(n, BLOCK)
    value, width = codes[1][symbols], lengths[1][symbols]
    value[:, 0], width[:, 0] = codes[0][symbols[:, 0]], lengths[0][symbols[:, 0]]
    ends = np.cumsum(width, axis=1, dtype=np.uint64)
    n_bytes = (ends[:, -1] + np.uint64(7)) >> np.uint64(3)
    # ones fill the last byte of a segment
    fill = (n_bytes << np.uint64(3)) - ends[:, -1]
    begins = np.concatenate([[0], np.cumsum(n_bytes)]).astype(np.int64)
    at = ends - width
    at += (begins[:-1].astype(np.uint64) << np.uint64(3))[:, None]
    at, value, width = at.ravel(), value.ravel(), width.ravel()
    tail = (begins[1:].astype(np.uint64) << np.uint64(3)) - fill
    at, value, width = np.concatenate([at, tail]), np.concatenate([value, (np.uint64(1) << fill) - np.uint64(1)]), np.concatenate([width, fill])
    word, shift = (at >> np.uint64(5)).astype(np.int64), at & np.uint64(31)
    placed = value << (np.uint64(64) - width - shift) if len(value) else value
    placed[width == 0] = 0
    size = int(begins[-1] + 3) // 4 + 2
    # the bits of a word are disjoint, so sums stand for ors; halves of 32 bits are exact as doubles
    words = np.bincount(word, (placed >> np.uint64(32)).astype(np.float64), size) + np.bincount(word + 1, (placed & np.uint64(0xFFFFFFFF)).astype(np.float64), size + 1)[:size]
    data = words.astype(np.uint64).astype(">u4").view(np.uint8)[: int(begins[-1])]
    full = data == 0xFF
    if not full.any():
        return data, begins
    shifted = np.arange(len(data)) + np.cumsum(full) - full
    stuffed = np.zeros(len(data) + int(full.sum()), np.uint8)
    stuffed[shifted] = data
    return stuffed, begins + np.concatenate([[0], np.cumsum(full)])[begins]


def header(width: int, height: int) -> bytes:
    segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    return (
        b"\xff\xd8"
        + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
        + segment(0xDB, b"\0" + b"\1" * 64)
        + segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + b"\1\x11\0")
        + segment(0xC4, b"\0" + bytes(DC_BITS) + bytes(DC_SYMBOLS))
        + segment(0xC4, b"\x10" + bytes(AC_BITS) + bytes(AC_SYMBOLS))
        + segment(0xDD, struct.pack(">H", 1))
        + segment(0xDA, b"\1\1\0\0\x3f\0")
    )


def pad_block() -> bytes:
    """One all-zero block: DC category 0, then end of block."""
    (dc, a), (ac, b) = next((c, k) for s, c, k in canonical(DC_BITS, DC_SYMBOLS) if s == 0), next((c, k) for s, c, k in canonical(AC_BITS, AC_SYMBOLS) if s == 0)
    total = -(-(a + b) // 8) * 8
    return (((dc << b | ac) << (total - a - b)) | ((1 << (total - a - b)) - 1)).to_bytes(total // 8, "big").replace(b"\xff", b"\xff\0")


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload; payload lengths are positive multiples of 64."""
    out, run, held = [b""] * len(payloads), [], 0
    for k, payload in enumerate(payloads):
        run.append(k)
        held += len(payload) // BLOCK
        if held >= RUN_BLOCKS or k + 1 == len(payloads):
            _encode_run(payloads, run, out)
            run, held = [], 0
    return out


def _encode_run(payloads: list[bytes], run: list[int], out: list[bytes]) -> None:
    flat = np.frombuffer(b"".join(payloads[k] for k in run), np.uint8)
    n_blocks = len(flat) // BLOCK
    pieces, sizes = [], []
    for a in range(0, n_blocks, RUN_BLOCKS):
        data, begins = code_blocks(flat[a * BLOCK : (a + RUN_BLOCKS) * BLOCK])
        pieces.append(data)
        sizes.append(np.diff(begins))
    data, begins = np.concatenate(pieces), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    # room for the two bytes of a restart marker after each segment; the last of a picture is cut off
    first = np.cumsum([0, *(len(payloads[k]) // BLOCK for k in run)])
    number = np.arange(n_blocks) - np.repeat(first[:-1], np.diff(first))
    marked = np.empty(len(data) + 2 * n_blocks, np.uint8)
    ends = begins[1:] + 2 * np.arange(n_blocks)
    hole = np.ones(len(marked), bool)
    hole[ends], hole[ends + 1] = False, False
    marked[hole] = data
    marked[ends], marked[ends + 1] = 0xFF, 0xD0 + number % 8
    for i, k in enumerate(run):
        n = int(first[i + 1] - first[i])
        w = min(n, LINE_BLOCKS)
        h = -(-n // w)
        scan = marked[begins[first[i]] + 2 * first[i] : ends[first[i + 1] - 1]].tobytes()
        blank = pad_block()
        extra = b"".join(bytes((0xFF, 0xD0 + (j - 1) % 8)) + blank for j in range(n, w * h))
        out[k] = header(8 * w, 8 * h) + scan + extra + b"\xff\xd9"


def parse(data: bytes) -> dict:
    """Frame, tables and scan of a baseline JPEG with one scan of all components."""
    if data[:2] != b"\xff\xd8":
        raise NotBaseline("no SOI")
    found = {"dht": {}, "dqt": {}, "interval": 0}
    at = 2
    try:
        while True:
            if data[at] != 0xFF:
                raise NotBaseline(f"no marker at {at}")
            marker = data[at + 1]
            if marker == 0xFF:  # fill byte
                at += 1
                continue
            if marker == 0xD9:
                raise NotBaseline("no scan")
            (length,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + length]
            if marker in (0xC0, 0xC1):
                depth, found["height"], found["width"], n = struct.unpack_from(">BHHB", body)
                if depth != 8 or not found["height"] or not found["width"]:
                    raise NotBaseline("not 8 bits, or no lines")
                found["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise NotBaseline("another process")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    found["dht"][body[0]] = (tuple(body[1:17]), tuple(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    found["dqt"][body[0] & 15] = struct.unpack_from(">64H" if wide else ">64B", body, 1)
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xDD:
                (found["interval"],) = struct.unpack(">H", body)
            elif marker == 0xDA:
                found["scan"] = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                if "parts" not in found or len(found["scan"]) != len(found["parts"]):
                    raise NotBaseline("scans of single components")
                return found | {"at": at + 2 + length}
            at += 2 + length
    except (IndexError, struct.error) as e:
        raise NotBaseline("cut off") from e


def segments(data: bytes, at: int) -> tuple[np.ndarray, np.ndarray]:
    """The scan's bytes without stuffing and markers, and the offsets of its restart segments."""
    raw = np.frombuffer(data, np.uint8)[at:]
    full = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[full + 1]
    ends = full[(after != 0) & (after != 0xFF) & ((after < 0xD0) | (after > 0xD7))]
    stop = int(ends[0]) if len(ends) else len(raw)
    full, after = full[full < stop], after[full < stop]
    restart = full[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(stop, bool)
    keep[(full + 1)[(after == 0) & (full + 1 < stop)]] = False
    keep[restart], keep[restart + 1] = False, False
    clean = raw[:stop][keep]
    before = np.concatenate([[0], np.cumsum(keep)])
    return clean, np.concatenate([[0], before[restart], [len(clean)]])


def decode_lanes(clean: np.ndarray, begins: np.ndarray, dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """Zigzag coefficients of one-component segments of one block each, all segments at once."""
    n = len(begins) - 1
    padded = np.concatenate([clean, np.full(16, 0xFF, np.uint8)]).astype(np.uint64)
    four = padded[:-3] << np.uint64(24) | padded[1:-2] << np.uint64(16) | padded[2:-1] << np.uint64(8) | padded[3:]
    eight = four[:-4] << np.uint64(32) | four[4:]
    coefficients = np.zeros((BLOCK, n), np.int16)
    position = begins[:-1] * 8
    k = np.zeros(n, np.int64)
    lanes, table = np.arange(n), dc
    all_at_k = True
    step = 0
    while len(lanes):
        window = eight[position >> 3] << (position & 7).astype(np.uint64)
        entry = table[(window >> np.uint64(48)).astype(np.int64)]
        length, symbol = entry >> 8, entry & 255
        if not length.all():
            raise NotBaseline("no such code")
        size = (symbol & 15).astype(np.uint64)
        extra = ((window << length.astype(np.uint64)) >> np.uint64(1) >> (np.uint64(63) - size)).astype(np.int64)
        size = size.astype(np.int64)
        value = np.where(extra >> np.maximum(size - 1, 0) == 0, extra - (1 << size) + 1, extra)
        value[size == 0] = 0
        position = position + length + size
        run = symbol >> 4
        simple = all_at_k and not run.any() and (step == 0 or size.all())
        if simple:
            coefficients[step] = value
            step += 1
            k += 1
            if step == BLOCK:
                break
        else:
            if all_at_k:
                k, all_at_k = np.full(n, step), False
            if step == 0:
                coefficients[0, lanes] = value
                k, step = np.ones(n, np.int64), 1
            else:
                done = symbol == 0
                k = np.where(symbol == 0xF0, k + 16, k + run)
                put = ~done & (symbol != 0xF0)
                if (k[put] >= BLOCK).any():
                    raise NotBaseline("too many coefficients")
                coefficients[k[put], lanes[put]] = value[put]
                k = k + put
                live = ~done & (k < BLOCK)
                lanes, position, k = lanes[live], position[live], k[live]
        table = ac
    return coefficients.T


def decode_scalar(clean: np.ndarray, begins: np.ndarray, frame: dict) -> dict[int, np.ndarray]:
    """Zigzag coefficients of each component's blocks, as (lines, columns, 64), by a scalar bit reader."""
    tables = {p[0]: (lookup(*frame["dht"][d]), lookup(*frame["dht"][16 + a])) for p, (_, d, a) in zip(frame["parts"], frame["scan"])}
    alone = len(frame["parts"]) == 1
    h_most, v_most = max(p[1] for p in frame["parts"]), max(p[2] for p in frame["parts"])
    units = [(p[0], 1, 1) if alone else p[:3] for p in frame["parts"]]
    step = (8, 8) if alone else (8 * h_most, 8 * v_most)
    columns, lines = -(-frame["width"] // step[0]), -(-frame["height"] // step[1])
    out = {c: np.zeros((lines * v, columns * h, BLOCK), np.int32) for c, h, v in units}
    interval = frame["interval"] or columns * lines
    for s in range(min(len(begins) - 1, -(-columns * lines // interval))):
        data = bytes(clean[begins[s] : begins[s + 1]]) + b"\xff" * 8
        at, last = 0, dict.fromkeys(out, 0)

        def take(table: np.ndarray, at: int, data: bytes = data) -> tuple[int, int, int]:
            window = int.from_bytes(data[at >> 3 : (at >> 3) + 5].ljust(5, b"\xff"), "big") << (at & 7) & 0xFFFFFFFFFF
            entry = int(table[window >> 24])
            if not entry:
                raise NotBaseline("no such code")
            at += entry >> 8
            size = entry & 15
            bits = int.from_bytes(data[at >> 3 : (at >> 3) + 4].ljust(4, b"\xff"), "big") << (at & 7) & 0xFFFFFFFF
            value = bits >> (32 - size) if size else 0
            return entry & 255, value if not size or value >> (size - 1) else value - (1 << size) + 1, at + size

        for unit in range(s * interval, min((s + 1) * interval, columns * lines)):
            y, x = divmod(unit, columns)
            for c, h, v in units:
                for i in range(h * v):
                    block = out[c][y * v + i // h, x * h + i % h]
                    _, difference, at = take(tables[c][0], at)
                    last[c] += difference
                    block[0], k = last[c], 1
                    while k < BLOCK:
                        symbol, value, at = take(tables[c][1], at)
                        if symbol == 0:
                            break
                        if symbol == 0xF0:
                            k += 16
                            continue
                        k += symbol >> 4
                        if k >= BLOCK:
                            raise NotBaseline("too many coefficients")
                        block[k], k = value, k + 1
    return out


def read_blocks(data: bytes, ready: np.ndarray | None = None) -> tuple[dict, np.ndarray]:
    """The parsed frame, and the luminance blocks' zigzag coefficients as (lines, columns, 64)."""
    frame = parse(data)
    part = frame["parts"][0]
    if ready is None:
        clean, begins = segments(data, frame["at"])
        if len(frame["parts"]) == 1 and frame["interval"] == 1:
            ready = decode_lanes(clean, begins, lookup(*frame["dht"][frame["scan"][0][1]]), lookup(*frame["dht"][16 + frame["scan"][0][2]]))
        else:
            return frame, decode_scalar(clean, begins, frame)[part[0]]
    columns, lines = -(-frame["width"] // 8), -(-frame["height"] // 8)
    if len(ready) != columns * lines:
        raise NotBaseline(f"{len(ready)} blocks, not {columns * lines}")
    return frame, ready.reshape(lines, columns, BLOCK)


def payload_of(blocks: np.ndarray) -> bytes:
    """The payload that the blocks hold: padding blocks end it."""
    flat = blocks.reshape(-1, BLOCK)
    n = len(flat)
    while n and not flat[n - 1].any():
        n -= 1
    v = flat[:n]
    return (v + 127 + (v < 0)).astype(np.uint8).tobytes()


def thumbnail(frame: dict, blocks: np.ndarray) -> np.ndarray:
    """DC-only luminance: the mean of each 8x8 block."""
    step = frame["dqt"][frame["parts"][0][3]][0]
    return np.clip(np.rint(blocks[:, :, 0] * (step / 8) + 128), 0, 255).astype(np.uint8)


def mean_hash(pixels: np.ndarray) -> int:
    """64 bits: which cells of an 8x8 grid over the thumbnail are brighter than their mean."""
    h, w = pixels.shape
    rows, columns = np.arange(8) * h // 8, np.arange(8) * w // 8
    # where a start repeats, reduceat takes the one line or column there
    sums = np.add.reduceat(np.add.reduceat(pixels.astype(np.int64), rows, axis=0), columns, axis=1)
    sizes = np.maximum(np.diff([*rows, h]), 1)[:, None] * np.maximum(np.diff([*columns, w]), 1)
    means = (sums / sizes).ravel()
    return int.from_bytes(np.packbits(means > means.mean()).tobytes(), "big")


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % BLOCK or (0 if text else BLOCK))


def _own_blocks(media: list[bytes]) -> list[np.ndarray | None]:
    """Coefficients of the media that have the layout of `encode_payloads`, decoded together in bounded runs."""
    out: list[np.ndarray | None] = [None] * len(media)
    fixed = len(header(8, 8))
    dimension = 2 + 18 + 69 + 5  # where SOF0 has height and width
    blank = lambda head: head[:dimension] + b"\0\0\0\0" + head[dimension + 4 :]
    known = blank(header(8, 8))
    run: list[tuple[int, np.ndarray, np.ndarray]] = []

    def flush() -> None:
        if not run:
            return
        data = np.concatenate([x[1] for x in run])
        starts, base = [], 0
        for _, clean, begins in run:
            starts.append(begins[:-1] + base)
            base += len(clean)
        begins = np.concatenate([*starts, [base]])
        done, at = [], 0
        for a in range(0, len(begins) - 1, RUN_BLOCKS):
            b = min(a + RUN_BLOCKS, len(begins) - 1)
            lo, hi = begins[a], begins[b]
            done.append(decode_lanes(data[lo:hi], begins[a : b + 1] - lo, lookup(DC_BITS, DC_SYMBOLS), lookup(AC_BITS, AC_SYMBOLS)))
        blocks = np.concatenate(done)
        for k, _, begins in run:
            out[k] = blocks[at : at + len(begins) - 1]
            at += len(begins) - 1
        run.clear()

    held = 0
    for k, data in enumerate(media):
        if data is not None and blank(data[:fixed]) == known:
            clean, begins = segments(data, fixed)
            run.append((k, clean, begins))
            held += len(begins) - 1
            if held >= RUN_BLOCKS:
                flush()
                held = 0
    flush()
    return out


def store(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with a column of baseline JPEGs that hold the padded UTF-8 of each whole text."""
    kept = bounded_batches(docs).drop(media)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"`{media}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, text):
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                stored = encode_payloads([padded((t or "").encode()) for t in texts])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(stored, pa.binary())], names=[*part.schema.names, media])

    return kept.mapInArrow(run, schema)


FEATURES = "media_bytes long, media_sha256 string, width int, height int, payload_bytes long, payload_sha256 string, tail_crc32 long, thumb_hash string, feature string"


def read_features(table: DataFrame, media: str = "media") -> DataFrame:
    """table, without its media, with what is read back from each JPEG; nulls where it is no baseline JPEG."""
    names = [x.split()[0] for x in FEATURES.split(", ")]
    kept = bounded_batches(table).drop(*[n for n in names if n != media])
    others = [f for f in kept.schema if f.name != media]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), FEATURES])
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, media):
                stored = part.column(part.schema.get_field_index(media)).to_pylist()
                rows = [features(data, ready) for data, ready in zip(stored, _own_blocks(stored))]
                columns = [part.column(part.schema.get_field_index(f.name)) for f in others]
                made = [pa.array([r[i] for r in rows], kinds[x.split()[1]]) for i, x in enumerate(FEATURES.split(", "))]
                yield pa.RecordBatch.from_arrays([*columns, *made], names=[*(f.name for f in others), *names])

    return kept.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    held = start = 0
    for i, x in enumerate(batch.column(batch.schema.get_field_index(column))):
        held += x.as_buffer().size if x.is_valid else 0
        if held >= most:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def features(data: bytes | None, ready: np.ndarray | None = None) -> tuple:
    """The values of FEATURES for one stored medium."""
    if data is None:
        return (None,) * 9
    try:
        frame, blocks = read_blocks(data, ready)
    except NotBaseline:
        return (len(data), hashlib.sha256(data).hexdigest(), *(None,) * 7)
    payload, pixels = payload_of(blocks), thumbnail(frame, blocks)
    thumb = f"{mean_hash(pixels):016x}"
    return (
        len(data), hashlib.sha256(data).hexdigest(), frame["width"], frame["height"], len(payload), hashlib.sha256(payload).hexdigest(),
        zlib.crc32(payload[-BLOCK:]), thumb, f"{frame['width']}x{frame['height']}:{thumb}:{zlib.crc32(pixels.tobytes()):08x}",
    )


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The media features of each row's whole text, stored and read back."""
    chosen = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    stored = store(chosen).drop("text")
    return read_features(stored).withColumnRenamed("key", key)
