import hashlib
import zlib

import numpy as np
import pytest

from tallyweir.llm import media
from tests.llm.conftest import documents


def test_round_trip_of_all_bytes():
    rng = np.random.default_rng(1)
    payloads = [bytes(range(256)), b"\0" * 64, b"\xff" * 640, rng.integers(0, 256, 64 * 9000, np.uint8).tobytes()]
    stored = media.encode_payloads(payloads)
    for p, s, ready in zip(payloads, stored, media._own_blocks(stored)):
        frame, blocks = media.read_blocks(s, ready)
        assert media.payload_of(blocks) == p
        assert np.array_equal(media.read_blocks(s)[1], blocks)
    frame, blocks = media.read_blocks(stored[3])
    assert frame["width"] == 8 * media.LINE_BLOCKS and blocks.shape[0] == 2  # padding blocks end the picture


def test_scalar_reader_agrees_and_predicts_dc_without_restarts():
    payload = bytes(range(64, 128)) * 5
    data = media.encode_payloads([payload])[0]
    frame = media.parse(data)
    clean, begins = media.segments(data, frame["at"])
    want = media.read_blocks(data)[1]
    assert np.array_equal(media.decode_scalar(clean, begins, frame)[1], want)


def _bits(pairs):
    text = "".join(format(c, f"0{n}b") for c, n in pairs if n)
    text += "1" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\0")


def test_colour_picture_without_restart_intervals():
    """4:2:0, one 16x16 unit: four luminance blocks with predicted DC, runs of zeros, and two chrominance blocks."""
    dc = {s: (c, n) for s, c, n in media.canonical(media.DC_BITS, media.DC_SYMBOLS)}
    ac = {s: (c, n) for s, c, n in media.canonical(media.AC_BITS, media.AC_SYMBOLS)}

    def number(v):
        size = abs(v).bit_length()
        return size, (v if v > 0 else v + (1 << size) - 1, size)

    def block(difference, first=None):
        size, bits = number(difference)
        out = [dc[size], bits]
        if first:
            out += [ac[0xF0]]  # sixteen zeros, then a value at place 17
            size, bits = number(first)
            out += [ac[size], bits]
        return out + [ac[0]]

    scan = _bits([x for d, f in ((40, 3), (-10, None), (5, None), (0, -2), (7, None), (-7, None)) for x in block(d, f)])
    head = media.header(16, 16)
    frame = b"\xff\xc0\0\x11\x08\0\x10\0\x10\x03\x01\x22\0\x02\x11\0\x03\x11\0"
    start = head.index(b"\xff\xc0")
    head = head[:start] + frame + head[start + 13 :]
    head = head[: head.index(b"\xff\xdd")] + b"\xff\xda\0\x0c\x03\x01\0\x02\0\x03\0\0\x3f\0"
    frame, blocks = media.read_blocks(head + scan + b"\xff\xd9")
    assert blocks[:, :, 0].tolist() == [[40, 30], [35, 35]] and blocks[0, 0, 17] == 3 and blocks[1, 1, 17] == -2
    assert media.thumbnail(frame, blocks).tolist() == [[133, 132], [132, 132]]


@pytest.mark.parametrize("data", [b"", b"\xff\xd8", b"GIF89a", b"\xff\xd8\xff\xc2\0\x0b\x08\0\x08\0\x08\x01\x01\x11\0", media.header(8, 8)[:40]])
def test_what_is_no_baseline_jpeg_gives_nulls(data):
    assert media.features(data)[2:] == (None,) * 7


def test_query_reads_back_every_text(spark):
    docs = documents(spark)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    got = media.digests(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        payload = media.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.encode_payloads([payload])[0]
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
