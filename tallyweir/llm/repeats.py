"""Suffix-array deduplication: remove every byte inside a repeated string of `length` bytes that also starts earlier.

`maximal_repeats` is the core: an enhanced suffix array (suffixes sorted eight bytes at a time, with the common prefix of
neighbours), the common-prefix interval tree by a stack scan over it, and the test of left-extension diversity. An
interval whose suffixes are all preceded by the same byte extends to the left and is passed over; the others are the
maximal repeats, each with all of its occurrences. All occurrences but the earliest are removed.

To run over a corpus, suffixes that could share `length` bytes must meet. Each string of `length` bytes is owned by the
minimum of a hash over its 24-byte grams (the leftmost one of equals), which depends on the string alone; so equal
strings have equal owners. Neighbouring strings of one owner form a record, a context of at most 2 * length bytes.

1. Per run of texts, records that may have one owner and content are whole-context suffixes of an enhanced suffix array:
   `maximal_repeats` gives each repeated context with all its occurrences in the run, compared byte by byte. The earliest
   stands for them, the others are removed. What stands is dealt by owner as packed arrays.
2. Per bucket, the contexts are asked for of each content that several runs have, and of each owner with several contents.
3. Texts, dealt by document once, give those contexts; an owner with very many contents gives its strings one by one,
   dealt by the string itself, so that no owner's contents pile up in a task.
4. Per bucket, `maximal_repeats` runs over the contexts: from each one's begin, where it is a copy of another, and from all
   of its windows of `length` bytes, where its owner has several contents. All occurrences of a repeat but the earliest are
   removed; so every byte that goes, goes for a repeat of the interval tree, and was compared as bytes.
5. Texts meet the removals of their document, and are cut.

The second and third uses of the texts are one exchange in Spark's plan. Hashes say only what may be equal, and so what has
to meet. Positions order by id, then start.

Defined results: a null or short text loses nothing; bytes are UTF-8, and what is kept need not be. Rows of one id and
one text are the same document and get equal results; rows of one id and different texts order by the texts' crc32. A
null id comes first. A very long text is read in overlapping pieces; an empty table gives an empty table. Only id (an
integer) and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.llm.common import BYTE_VALUES, bounded_batches, cut, flat_utf8, forget, mixed, sliced, trim
from tallyweir.llm.ngram_join import by_slot, pack, unpacked

GRAM = 24
BASE = 0x9E3779B97F4A7C15
#: Bytes handled at once; their positions fit in the low bits of what minima are taken of.
PIECE, PLACE_BITS = 1 << 19, 20
BYTES_PER_SLOT, RECORDS_PER_BUCKET = 8 << 20, 250_000
#: Records, and bytes of their texts, that are compared with each other before they are dealt out.
RECORDS_HELD, BYTES_HELD = 300_000, 24 << 20
#: Windows whose suffixes are sorted at once.
WINDOWS_HELD = 400_000
#: Contents of one owner beyond which its strings are dealt one by one.
MANY_CONTENTS = 4096
NO_ID = -(1 << 63)


# ---- the enhanced suffix array -------------------------------------------------------------------------------------


def suffix_array(flat: np.ndarray, offsets: np.ndarray, starts: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes that begin at `starts` and end with their text: (starts in order, text ends, lcp with the one before).

    Suffixes are refined eight bytes at a time, and only those that are not told apart yet. With `group`, suffixes of
    different groups are kept apart, with an lcp of 0.
    """
    ends = offsets[np.searchsorted(offsets, starts, "right")]
    group = np.zeros(len(starts), np.int64) if group is None else group
    wide = np.concatenate([flat, np.zeros(8, np.uint8)])
    order = np.argsort(group, kind="stable")
    cls = np.zeros(len(starts), np.int64)  # of the suffix at each place of the order
    if len(order):
        g = group[order]
        cls[1:] = np.cumsum(g[1:] != g[:-1])
    lcp = np.zeros(len(starts), np.int64)
    places = np.arange(len(starts))
    depth = 0
    while True:
        c = cls[places]
        same_next = np.zeros(len(places), bool)
        same_next[:-1] = c[1:] == c[:-1]
        keep = same_next.copy()
        keep[1:] |= same_next[:-1]
        places = places[keep]
        if not len(places):
            break
        at, end = starts[order[places]], ends[order[places]]
        left = end - at - depth
        if (left <= 0).all():
            # equal to the end of the longest: lcp is the shorter one's length
            n = ends[order] - starts[order]
            tied = np.concatenate([[False], cls[1:] == cls[:-1]])
            lcp[1:] = np.where(tied[1:], np.minimum(n[1:], n[:-1]), lcp[1:])
            break
        word = np.zeros(len(places), np.uint64)
        for k in range(8):
            here = np.minimum(at + depth + k, len(wide) - 1)
            word = word << np.uint64(8) | np.where(depth + k < end - at, wide[here], 0).astype(np.uint64)
        filled = np.clip(left, 0, 8)  # a text's end sorts before a zero byte
        resort = np.lexsort((filled, word, cls[places]))
        order[places] = order[places][resort]
        word, filled, c = word[resort], filled[resort], cls[places]
        new = np.zeros(len(places), bool)
        new[1:] = (c[1:] == c[:-1]) & ((word[1:] != word[:-1]) | (filled[1:] != filled[:-1]))
        if new.any():
            differ = word[1:][new[1:]] ^ word[:-1][new[1:]]
            same = 7 - np.floor(np.log2(np.maximum(differ.astype(np.float64), 1))).astype(np.int64) // 8
            # a double may round a difference up to the next power of two: check the byte
            same = np.where((same < 8) & ((differ >> ((7 - np.minimum(same, 7)).astype(np.uint64) * np.uint64(8))) == 0), same + 1, same)
            same = np.where(differ == 0, 8, same)
            lcp[places[new]] = depth + np.minimum(same, np.minimum(filled[1:], filled[:-1])[new[1:]])
            fresh = np.zeros(len(cls), np.int64)
            fresh[places[new]] = 1
            boundary = np.concatenate([[0], (cls[1:] != cls[:-1]).astype(np.int64)])
            cls = np.cumsum(np.maximum(boundary, fresh))
        depth += 8
    starts, ends = starts[order], ends[order]
    n = ends - starts
    lcp[1:] = np.minimum(lcp[1:], np.minimum(n[1:], n[:-1]))
    return starts, ends, lcp


def maximal_repeats(flat: np.ndarray, offsets: np.ndarray, least: int, starts: np.ndarray | None = None, group: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(length, starts of all occurrences) of each repeat of at least `least` bytes that extends neither way.

    A stack scan over the lcp values makes the interval tree; an interval is given if the bytes before its suffixes differ,
    the start of a text counting as a byte of its own.
    """
    if starts is None:
        starts = np.flatnonzero(np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(flat)) >= least)
    starts, _, lcp = suffix_array(flat, offsets, starts, group)
    before = np.where(np.isin(starts, offsets), -1 - starts, flat[np.maximum(starts - 1, 0)].astype(np.int64)) if len(starts) else starts
    long = lcp >= least
    edges = np.flatnonzero(np.diff(np.concatenate([[False], long, [False]]).astype(np.int8)))
    for a, b in zip(edges[::2], edges[1::2]):  # lcp[a:b] are long: suffixes a-1 .. b-1
        if b - a == 1:
            if before[a - 1] != before[a]:
                yield int(lcp[a]), starts[a - 1 : a + 1]
            continue
        values = lcp[a:b]
        if (values == values[0]).all():
            if (before[a - 1 : b] != before[a]).any():
                yield int(values[0]), starts[a - 1 : b]
            continue
        # diversity of a range: the last place up to which the byte before has changed
        change = np.concatenate([[a - 1], np.where(before[a:b] != before[a - 1 : b - 1], np.arange(a, b), 0)])
        change = np.maximum.accumulate(change)
        stack: list[tuple[int, int]] = []  # (length, first suffix)
        for i, value in enumerate([*values.tolist(), 0], a):
            first = i - 1
            while stack and stack[-1][0] > value:
                length, first = stack.pop()
                if change[i - 1 - (a - 1)] > first:
                    yield length, starts[first:i]
            if value and (not stack or stack[-1][0] < value):
                stack.append((value, first))


# ---- records -------------------------------------------------------------------------------------------------------


def _power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def _joined(a: np.ndarray, b: np.ndarray, n: int, m: int) -> np.ndarray:
    """Hashes of n + m bytes from those of n bytes and of m bytes."""
    size = len(b) - n
    return a[:size] * _power(m) + b[n : n + size] if size > 0 else np.zeros(0, np.uint64)


def gram_hashes(flat: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Mixed polynomial hashes of the GRAM bytes, and plain ones of the `length` bytes, from each place."""
    powers = {1: BYTE_VALUES[flat]}
    n = 1
    while 2 * n <= max(length, GRAM):
        powers[2 * n] = _joined(powers[n], powers[n], n, n)
        n *= 2

    def of(size: int) -> np.ndarray:
        made, have = None, 0
        for n in sorted(powers, reverse=True):
            if size & n:
                made = powers[n] if made is None else _joined(made, powers[n], have, n)
                have += n
        return made

    return mixed(of(GRAM)), of(length)


def records(flat: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(owner hash, content hash, first start, last start) of the records in a piece.

    ends: for each byte, the end of its document; strings that cross it are none.
    """
    empty = np.zeros(0, np.uint64)
    if len(flat) < length:
        return empty, empty, np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams, whole = gram_hashes(flat, length)
    v = grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
    width, n = length - GRAM + 1, 1
    least = v
    while 2 * n <= width:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if width > n:
        least = np.minimum(least[: len(v) - width + 1], least[width - n :])
    owner = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    starts = np.arange(len(owner))
    valid = starts + length <= ends[: len(owner)]
    first = valid.copy()
    first[1:] &= (owner[1:] != owner[:-1]) | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= (owner[1:] != owner[:-1]) | ~valid[1:]
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    content = mixed(mixed(whole[a], 3) + mixed(whole[b], 4) * np.uint64(BASE) + ((b - a) << 16 | (owner[a] - a)).astype(np.uint64))
    # an owner is a minimum: mixed again, its high bits deal evenly
    return mixed(grams[owner[a]], 5), content, a, b


def pieces(flat: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(owner, content, document number, start, bytes) of the records of all documents; long ones in overlapping pieces."""
    n = len(flat)
    step = PIECE
    for s in range(0, max(n, 1), step):
        part = flat[s : s + step + length - 1]
        if not len(part):
            break
        number = np.searchsorted(offsets, np.arange(s, s + len(part)), "right") - 1 if len(offsets) > 2 else np.zeros(len(part), np.int64)
        owner, content, a, b = records(part, offsets[number + 1] - s, length)
        mine = a < step
        owner, content, a, b = owner[mine], content[mine], a[mine], np.minimum(b[mine], step - 1)
        # a record that the piece's end cuts has another content; such strings still meet through their owner
        cut_off = np.flatnonzero(b == step - 1)
        content[cut_off] = mixed(content[cut_off] + np.uint64(s + 1) + (b[cut_off] - a[cut_off]).astype(np.uint64), 9)
        d = number[a]
        yield owner, content, d, a + s - offsets[d], b - a + length


def spark_slot(keys: np.ndarray, slots: int) -> np.ndarray:
    """pmod(xxhash64(key), slots) of long keys, as Spark has it (seed 42)."""
    one, two, three, four, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, r: x << np.uint64(r) | x >> np.uint64(64 - r)
    h = np.full(len(keys), 42 + 8, np.uint64) + five
    h = turned(h ^ turned(keys.astype(np.int64).view(np.uint64) * two, 31) * one, 27) * one + four
    h = (h ^ h >> np.uint64(33)) * two
    h = (h ^ h >> np.uint64(29)) * three
    h ^= h >> np.uint64(32)
    return h.view(np.int64) % slots


RECORD = ("<u8", "<u8", "<i8", "<u4", "<i4", "<i4")  # owner, content, id, crc32 of the text, start, bytes
REMOVAL = ("<i8", "<u4", "<i4", "<i4")  # id, crc32, start, bytes
#: How a context is used: from its begin alone, from all its windows, or string by string.
BEGIN, WINDOWS, STRINGS = 0, 1, 2
REQUEST = (*REMOVAL, "<u8", "u1")  # and the owner, and the use
CONTEXT = (*REMOVAL, "<u8", "u1", "u1")  # and the owner, the use, and the bytes themselves
ROW = "kind int, slot int, payload binary"


def rows_of(made: list[tuple[int, int, bytes]]) -> pa.Table:
    kinds, slots, payloads = zip(*made) if made else ((), (), ())
    return pa.table({"kind": pa.array(kinds, pa.int32()), "slot": pa.array(slots, pa.int32()), "payload": pa.array(payloads, pa.binary())})


def dealt_rows(kind: int, slot: np.ndarray, columns: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
    order, slots, bounds = by_slot(slot)
    return [(kind, int(s), pack(*(c[order[a:b]] for c in columns))) for s, a, b in zip(slots, bounds[:-1], bounds[1:])]


def grouped(owner: np.ndarray, content: np.ndarray, ids: np.ndarray, crc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records in order of owner, content and position, and where each content begins in that order."""
    order = np.lexsort((start, crc, ids, content, owner))
    o, c = owner[order], content[order]
    first = np.ones(len(order), bool)
    first[1:] = (o[1:] != o[:-1]) | (c[1:] != c[:-1])
    return order, first


def repeated_contexts(owner: np.ndarray, content: np.ndarray, ids: np.ndarray, crc: np.ndarray, start: np.ndarray, size: np.ndarray, place: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a run's records: which stand, and which go, as whole contexts that are maximal repeats with an earlier one. place: of the records in flat."""
    order, first = grouped(owner, content, ids, crc, start)
    group = np.cumsum(first) - 1
    several = np.repeat(np.diff(np.append(np.flatnonzero(first), len(order))) > 1, np.diff(np.append(np.flatnonzero(first), len(order))))
    k, g = order[several], group[several]
    if not len(k):
        return order, k
    sizes = size[k].astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    bytes_of = flat[np.repeat(place[k] - offsets[:-1], sizes) + np.arange(offsets[-1])]
    gone = np.zeros(len(k), bool)
    for n, found in maximal_repeats(bytes_of, offsets, 1, offsets[:-1], g):
        at = np.searchsorted(offsets, found)
        whole = np.sort(at[sizes[at] == n])  # in order of position
        gone[whole[1:]] = True
    first_of = k[~gone]
    same = np.zeros(len(k), bool)  # one place in two rows of a document is no repeat
    same[1:] = (g[1:] == g[:-1]) & (ids[k[1:]] == ids[k[:-1]]) & (crc[k[1:]] == crc[k[:-1]]) & (start[k[1:]] == start[k[:-1]])
    return np.concatenate([order[~several], first_of]), k[gone & ~same]


def deal(docs: DataFrame, length: int, buckets: int, slots: int) -> DataFrame:
    """kind 0: records by owner; kind 1: removals by document."""

    def sent(held: list[tuple], texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        owner, content, ids, crc, start, size, place = [np.concatenate(x) for x in zip(*held)]
        held.clear()
        flat = np.concatenate(texts)
        texts.clear()
        stand, gone = repeated_contexts(owner, content, ids, crc, start, size, place, flat)
        del flat
        made = dealt_rows(1, spark_slot(ids[gone], slots), [x[gone] for x in (ids, crc, start, size)])
        stand = np.sort(stand)  # by document again, which compresses
        bucket = ((owner[stand] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        made += dealt_rows(0, bucket, [x[stand] for x in (owner, content, ids, crc, start, size)])
        for a in range(0, len(made), 64):
            yield from rows_of(made[a : a + 64]).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, texts, n, before = [], [], 0, 0
        for batch in batches:
            for part in sliced(batch, "text", PIECE):
                flat, offsets = flat_utf8(part.column(1))
                ids = np.array(part.column(0).to_numpy(zero_copy_only=False), np.int64)
                crc = np.array([zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], np.uint32)
                for owner, content, d, start, size in pieces(flat, offsets, length):
                    held.append((owner, content, ids[d], crc[d], start.astype(np.int32), size.astype(np.int32), before + offsets[d] + start))
                    n += len(owner)
                texts.append(flat)
                before += len(flat)
                if n >= RECORDS_HELD or before >= BYTES_HELD:
                    yield from sent(held, texts)
                    n = before = 0
        if held:
            yield from sent(held, texts)
        trim()

    return docs.select("key", "text").mapInArrow(run, ROW)


def settled(dealt: DataFrame, slots: int) -> DataFrame:
    """kind 1: removals by document; kind 2: requests for the contexts of contents that several runs have, and of owners with several contents."""

    def run(key: tuple, got: pa.Table) -> pa.Table:
        payloads = got.column("payload").to_pylist()
        if key[0].as_py() == 1:
            return rows_of([(1, key[1].as_py(), p) for p in payloads])
        owner, content, ids, crc, start, size = unpacked(payloads, *RECORD)
        del payloads
        order, first = grouped(owner, content, ids, crc, start)
        copies = np.diff(np.append(np.flatnonzero(first), len(order)))
        copies = np.repeat(copies, copies)
        o = owner[order]
        begins = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]])) if len(o) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(begins, len(o)))
        contents = np.repeat(np.add.reduceat(first.astype(np.int64), begins) if len(o) else sizes, sizes)
        # the first of a content is used whole where its owner has others
        use = np.where(first & (contents > 1), np.where(contents > MANY_CONTENTS, STRINGS, WINDOWS), BEGIN).astype(np.uint8)
        wanted = (copies > 1) | (contents > 1)
        asked, use = order[wanted], use[wanted]
        # what goes string by string is wanted from its begin, too, where it has copies
        again = (use == STRINGS) & (copies[wanted] > 1)
        asked, use = np.concatenate([asked, asked[again]]), np.concatenate([use, np.full(int(again.sum()), BEGIN, np.uint8)])
        return rows_of(dealt_rows(2, spark_slot(ids[asked], slots), [*(x[asked] for x in (ids, crc, start, size, owner)), use]))

    return dealt.groupBy("kind", "slot").applyInArrow(run, ROW)


def texts_of(got: pa.Table) -> dict[tuple[int, int], bytes]:
    texts = got.column("text").combine_chunks() if got.num_rows else None
    out = {}
    for k, t in zip(got.column("key").to_pylist(), texts if texts is not None else ()):
        data = t.as_buffer().to_pybytes() if t.is_valid else b""
        out[k, zlib.crc32(data)] = data
    return out


def contexts(by_document: DataFrame, requests: DataFrame, length: int, buckets: int) -> DataFrame:
    """kind 3: the asked contents, by owner."""

    def run(docs: pa.Table, got: pa.Table) -> pa.Table:
        if not got.num_rows:
            return rows_of([])
        ids, crc, start, size, owner, use = unpacked(got.column("payload").to_pylist(), *REQUEST)
        texts = texts_of(docs)
        chunks = [texts[k][s : s + n] for *k, s, n in zip(ids.tolist(), crc.tolist(), start.tolist(), size.tolist()) for k in [tuple(k)]]
        columns = [ids, crc, start, size, owner, use]
        if (use == STRINGS).any():
            # strings of owners with very many contents: each is its own owner
            k = np.flatnonzero(use == STRINGS)
            single = [(i, s) for i in k for s in range(size[i] - length + 1)]
            where, shift = np.array([i for i, _ in single]), np.array([s for _, s in single], np.int32)
            strings = [chunks[i][s : s + length] for i, s in single]
            own = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") for x in strings], np.uint64)
            rest = np.flatnonzero(use != STRINGS)
            chunks = [chunks[i] for i in rest] + strings
            columns = [np.concatenate([a[rest], b]) for a, b in zip(columns, (ids[where], crc[where], start[where] + shift, np.full(len(where), length, np.int32), own, np.full(len(where), BEGIN, np.uint8)))]
        bucket = ((columns[4] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order, found, bounds = by_slot(bucket)
        made = []
        for b, lo, hi in zip(found, bounds[:-1], bounds[1:]):
            k = order[lo:hi]
            made.append((3, int(b), pack(*(x[k] for x in columns), np.frombuffer(b"".join(chunks[i] for i in k), np.uint8))))
        return rows_of(made)

    return by_document.groupBy("slot").cogroup(requests.groupBy("slot")).applyInArrow(run, ROW)


def later_occurrences(ids: np.ndarray, crc: np.ndarray, start: np.ndarray, size: np.ndarray, owner: np.ndarray, use: np.ndarray, flat: np.ndarray, length: int) -> list[np.ndarray]:
    """(id, crc32, start, bytes) of all occurrences but the earliest of the maximal repeats among contexts; one owner's meet."""
    offsets = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    windows = np.where(use == WINDOWS, size - length + 1, 1).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(windows)])
    number = np.repeat(np.arange(len(size)), windows)
    places = offsets[number] + np.arange(first[-1]) - first[number]
    # the order of the places by id, text and start; one place has one rank
    at = start[number] + (places - offsets[number])
    order = np.lexsort((at, crc[number], ids[number]))
    k = number[order]
    new = np.ones(len(order), bool)
    new[1:] = (ids[k][1:] != ids[k][:-1]) | (crc[k][1:] != crc[k][:-1]) | (at[order][1:] != at[order][:-1])
    rank = np.zeros(len(flat), np.int32)
    rank[places[order]] = np.cumsum(new)
    del order, k, new, at
    gone_at, gone_n = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for n, found in maximal_repeats(flat, offsets, length, places, np.unique(owner, return_inverse=True)[1][number]):
        r = rank[found]
        later = found[r != r.min()]
        gone_at.append(later)
        gone_n.append(np.full(len(later), n, np.int32))
    at, n = np.concatenate(gone_at), np.concatenate(gone_n)
    # of one start, the longest removal covers the others
    order = np.lexsort((-n, at))
    keep = order[np.concatenate([[True], at[order][1:] != at[order][:-1]])] if len(order) else order
    k = np.searchsorted(offsets, at[keep], "right") - 1
    return [ids[k], crc[k], (start[k] + (at[keep] - offsets[k])).astype(np.int32), n[keep]]


def repeat_removals(contents: DataFrame, length: int, slots: int) -> DataFrame:
    """kind 1: the later occurrences of the maximal repeats among the contexts of each bucket; so many windows at once, at ends of owners."""

    def run(key: tuple, got: pa.Table) -> pa.Table:
        *columns, flat = unpacked(got.column("payload").to_pylist(), *CONTEXT)
        size, owner, use = columns[3:6]
        offsets = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        order = np.argsort(owner, kind="stable")
        o = owner[order]
        windows = np.cumsum(np.where(use == WINDOWS, size - length + 1, 1).astype(np.int64)[order])
        ends = np.append(np.flatnonzero(o[1:] != o[:-1]) + 1, len(o))
        made, a = [], 0
        while a < len(o):
            limit = (windows[a - 1] if a else 0) + WINDOWS_HELD
            fit = ends[(ends > a) & (windows[ends - 1] <= limit)]
            b = int(fit[-1]) if len(fit) else int(ends[ends > a][0])
            k = order[a:b]
            local = np.cumsum(size[k], dtype=np.int64)
            part = flat[np.repeat(offsets[k] - local + size[k], size[k]) + np.arange(local[-1])]
            gone = later_occurrences(*(c[k] for c in columns), part, length)
            made += dealt_rows(1, spark_slot(gone[0], slots), gone)
            a = b
        trim()
        return rows_of(made)

    return contents.groupBy("slot").applyInArrow(run, ROW)


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finished(by_document: DataFrame, removals: DataFrame, kind: str, with_bytes: bool) -> DataFrame:
    def run(docs: pa.Table, got: pa.Table) -> pa.Table:
        ids, crc, start, size = unpacked(got.column("payload").to_pylist(), *REMOVAL)
        order = np.lexsort((start, crc, ids))
        ids, crc, start, size = (x[order] for x in (ids, crc, start, size))
        bounds = np.append(np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (crc[1:] != crc[:-1])])) if len(ids) else np.zeros(0, np.int64), len(ids))
        of = {(int(ids[a]), int(crc[a])): (a, b) for a, b in zip(bounds[:-1], bounds[1:])}
        out: list[list] = [[] for _ in range(6)]
        for k, t, null in zip(docs.column("key").to_pylist(), docs.column("text"), docs.column("no_id").to_pylist()):
            data = t.as_buffer().to_pybytes() if t.is_valid else b""
            removed = spans = 0
            kept = data
            if found := of.get((k, zlib.crc32(data))):
                a, b = start[found[0] : found[1]].astype(np.int64), start[found[0] : found[1]] + size[found[0] : found[1]].astype(np.int64)
                change = np.bincount(a, minlength=len(data) + 1) - np.bincount(b, minlength=len(data) + 1)
                gone = np.cumsum(change)[:-1] > 0
                removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            for column, value in zip(out, (None if null else k, len(data), removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None)):
                column.append(value)
        arrays = [pa.array(out[0], docs.schema.field("key").type), *(pa.array(c, pa.int64()) for c in out[1:4]), pa.array(out[4], pa.string())]
        names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_bytes:
            arrays.append(pa.array(out[5], pa.binary()))
            names.append("kept")
        return pa.table(dict(zip(names, arrays)))

    schema = f"key {kind}, {RESULT}" + (", kept binary" if with_bytes else "")
    return by_document.groupBy("slot").cogroup(removals.groupBy("slot")).applyInArrow(run, schema)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, with_bytes: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row, without the repeats of `length` bytes."""
    if not GRAM <= length <= 4096:
        raise ValueError(f"length must be from {GRAM} to 4096")
    spark = docs.sparkSession
    rows = bounded_batches(docs).select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("key"), F.col(key).isNull().alias("no_id"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first().bytes
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    records_expected = 2 * size // (length - GRAM + 2)
    buckets, slots = max(2 * parts, records_expected // RECORDS_PER_BUCKET), max(2 * parts, size // BYTES_PER_SLOT)
    first = cut(settled(deal(rows, length, buckets, slots), slots), "removals")
    by_document = rows.withColumn("slot", F.pmod(F.xxhash64("key"), F.lit(slots)).cast("int"))
    contents = contexts(by_document, first.where("kind = 2").select("slot", "payload"), length, buckets)
    later = repeat_removals(contents, length, slots)
    removals = first.where("kind = 1").select("slot", "payload").union(later.select("slot", "payload"))
    return _finished(by_document, removals, "long", with_bytes).withColumnRenamed("key", key)
