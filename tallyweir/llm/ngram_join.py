"""N-gram Jaccard join: exact links between documents whose sets of word n-grams are similar, and their components.

Two sets that are similar enough share a token among the first n - ceil(t n) + 1 tokens of each (its prefix), under any
global order of tokens. Here tokens are ordered by the class of their document frequency (its logarithm), rare ones
first, and within a class by one of several hashes, which gives several orders. A candidate pair must share a prefix
token under every one of them before its intersection is counted.

1. Sets of hashed n-grams are made twice, never shuffled as texts. The first pass gives each row's set size and
   signature, and the frequent n-grams. Those keep the last places of every order, and are not dealt out by token here.
2. The other n-grams are dealt into buckets, once for each distinct set of a run of rows: sorted, as differences in byte
   planes, with the set's number in the run. A bucket counts each n-gram's sets, and answers each run with those that
   have two or more. The run's signatures and frequent n-grams go once, to where the answers meet.
3. A set with enough n-grams of its own to fill its prefix has no partner, and is done. The rest ("live" sets) keep
   their shared n-grams: intersections only ever hold those, so pairs are verified without the texts.
4. Stars: in each prefix token's list every set is paired with the list's leader, pairs are verified, and verified links
   make components. What then remains are sets of one list in different components. Such a set first meets the other
   component as a whole: if it shares too little with all its sets together, it is similar to none. Where it shares
   enough it meets the component's leaders, and only if no link comes of that, its sets that pass the size filter and the
   positional filter. No group's pairs are all emitted.
5. Pairs come from the lists of the first order. The other orders are tested next, on 16 bits of each of the sets' prefix
   tokens (which loses no pair); only the pairs that are left have their sets' n-grams sent for verification.

Pairs are verified in tiles of a bounded number of hubs, and of other sets and n-grams; a component's n-grams are split by
token, and the counts of the parts added up; components come from alternating stars in Spark. Nothing that grows with the
input is collected or broadcast. Of the frequent n-grams 65,536 are kept off the deal, so that none that is dealt has over a
65,536th of all places; in lists of prefixes a frequent n-gram is met by token, in joins that Spark may split.

Defined results: a null text, or one without words, has no n-grams, is linked with nothing, and is its own component;
with fewer words than n the whole sequence is the one n-gram. Equal sets are linked. Repeated rows are repeated; where a
component has several rows of one id it is that id's component still; a null id is never the smallest unless alone. An
empty table gives an empty table. A very long text is one set, and goes through a task by itself. Only id and text are
read, so extra columns cannot clash. N-grams are 64-bit hashes. Sets are told apart by 128 bits: 64 name a set, and names
that two sets have are replaced by the other 64.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.llm.common import bounded_batches, cut, flat_utf8, forget, mixed, scratch, sliced, trim, word_hashes

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, *range(9, 14)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
COEFFICIENTS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
#: Frequent n-grams: in at least this share of a run's rows, and in so many of them; so many are kept at most.
FREQUENT_SHARE, FREQUENT_ROWS, FREQUENT_MOST = 0.002, 8, 1 << 16
TOKENS_PER_BUCKET, SETS_PER_GROUP = 1_000_000, 5_000
#: N-grams held at once by a task that makes sets.
TOKENS_HELD = 1_000_000
#: Sets of a run at most, as their numbers have 16 bits.
SETS_HELD = 1 << 16
#: Of a tile: hubs; other sets, and their n-grams, before it is split. N-grams of a component's part.
TILE_HUBS, TILE_OTHERS, TILE_TOKENS, PART_TOKENS = 500, 5_000, 2_000_000, 100_000
#: Names that two sets have, at most; ten thousand million sets have three.
COLLIDED_MOST = 10_000
#: Hash seeds of the global orders.
ORDERS = (1, 2, 3)
FREQUENT_CLASS = 63


def pack(*arrays: np.ndarray) -> bytes:
    return struct.pack(f"<{len(arrays)}q", *(a.nbytes for a in arrays)) + b"".join(a.tobytes() for a in arrays)


def unpack(data, *kinds: str) -> list[np.ndarray]:
    sizes, at, out = struct.unpack_from(f"<{len(kinds)}q", data), 8 * len(kinds), []
    for size, kind in zip(sizes, kinds):
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def unpacked(payloads: list[bytes], *kinds: str) -> list[np.ndarray]:
    """The arrays of all payloads, each joined."""
    parts = [unpack(p, *kinds) for p in payloads]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)]


def squeezed(*arrays: np.ndarray) -> bytes:
    data = pack(*arrays)
    return struct.pack("<q", len(data)) + pa.compress(data, "zstd", asbytes=True)


def released(data, *kinds: str) -> list[np.ndarray]:
    """The arrays of squeezed bytes."""
    return unpack(pa.decompress(memoryview(data)[8:], struct.unpack_from("<q", data)[0], "zstd", asbytes=True), *kinds)


def sets_of(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct hashed word n-grams of each text."""
    flat, offsets = flat_utf8(texts)
    words, _, _, at = word_hashes(FOLD[flat], offsets, SEPARATOR)
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n if len(grams) else 0):
        grams += words[i : len(words) - n + 1 + i] * COEFFICIENTS[i]
    grams = mixed(grams)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(mixed((words[a:b] * COEFFICIENTS[: b - a]).sum(keepdims=True), int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set apart, in two halves; 0 for the empty set."""
    if not len(s):
        return 0, 0
    sums = np.array([mixed(s, 77).sum(), mixed(s, 79).sum()], np.uint64) + np.uint64(len(s))
    return tuple(mixed(sums).view(np.int64).tolist())


def needed(n: int | np.ndarray, percent: int):
    """The fewest elements that a set of n shares with any similar set."""
    return -(-percent * n // 100)


def overlap(n: np.ndarray, m: np.ndarray, percent: int):
    """The fewest elements that similar sets of n and m share."""
    return -(-percent * (n + m) // (100 + percent))


def first_pass(rows: DataFrame, n: int) -> DataFrame:
    """(key, n, sig, other) of every row, and (token, rows) of the n-grams frequent in a run."""
    kind = rows.schema["key"].dataType.simpleString()

    names = ["key", "n", "sig", "other", "token", "rows"]

    def frequent(held: list[np.ndarray], key_type: pa.DataType) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= max(FREQUENT_ROWS, FREQUENT_SHARE * len(held))
        held.clear()
        none = pa.nulls(int(often.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([pa.nulls(int(often.sum()), key_type), none, none, none, pa.array(tokens[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: list[np.ndarray] = []
        tokens, key_type = 0, None
        for batch in batches:
            key_type = batch.column(0).type
            for part in sliced(batch):
                sets = sets_of(part.column(1), n)
                none = pa.nulls(len(sets), pa.int64())
                sigs, others = zip(*map(signature, sets))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.int64()), pa.array(others, pa.int64()), none, none], names=names)
                held.extend(sets)
                tokens += sum(map(len, sets))
                if tokens >= TOKENS_HELD:
                    yield frequent(held, key_type)
                    tokens = 0
        if held:
            yield frequent(held, key_type)
        trim()

    return rows.mapInArrow(run, f"key {kind}, n long, sig long, other long, token long, rows long")


def by_slot(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by slot, the slots there are, and their bounds in that order."""
    order = np.argsort(slots, kind="stable")
    found, starts = np.unique(slots[order], return_index=True)
    return order, found, np.append(starts, len(slots))


def planes(tokens: np.ndarray) -> np.ndarray:
    """Sorted tokens as differences, in planes of bytes from the lowest on: the upper ones are nearly all zeros."""
    return np.ascontiguousarray(np.diff(tokens, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T).ravel()


def from_planes(data: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(data.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def low_high(numbers: np.ndarray) -> np.ndarray:
    """Numbers of 16 bits in two planes of bytes."""
    return np.ascontiguousarray(numbers.astype("<u2").view(np.uint8).reshape(-1, 2).T).ravel()


def from_low_high(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(2, -1).T).view("<u2").ravel()


def run_name(sigs: np.ndarray) -> int:
    """Runs of the same sets in the same order have one name."""
    return int(mixed(np.array([(mixed(sigs.view(np.uint64)) * (2 * np.arange(len(sigs), dtype=np.uint64) + np.uint64(1))).sum()], np.uint64))[0].view(np.int64))


DEALT = ("<i8", "u1", "u1")  # run, planes of the sets' numbers, planes of the tokens
RUN = ("<i8", "<i8", "<i4", "<i4", "<u2")  # run and number of dealt tokens, signatures, sizes, numbers of frequent tokens, those
ANSWER = ("<i8", "u1", "u1", "u1")  # run and number of its tokens that were counted, planes of the sets' numbers, classes, planes of the tokens


def deal(rows: DataFrame, n: int, frequent, collided: dict[int, set[int]], buckets: int, groups: int) -> DataFrame:
    """kind 0: a bucket's n-grams of a run of sets; kind 1: the run's signatures and frequent n-grams. frequent: a broadcast, sorted."""

    def sent(found: dict[int, np.ndarray], often: np.ndarray) -> Iterator[pa.RecordBatch]:
        sigs, sets = np.array(list(found), np.int64), list(found.values())
        found.clear()
        name = run_name(sigs)
        sizes = np.array([len(s) for s in sets], np.int64)
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
        sets.clear()
        at = np.minimum(np.searchsorted(often, tokens), max(0, len(often) - 1))
        hot = often[at] == tokens if len(often) else np.zeros(len(tokens), bool)
        hot_counts = np.bincount(owner[hot], minlength=len(sigs))
        out = [(1, int(name % groups), pack(np.array([name, len(tokens) - int(hot.sum())]), sigs, sizes.astype(np.int32), hot_counts.astype(np.int32), at[hot].astype(np.uint16)))]
        tokens, owner = tokens[~hot], owner[~hot]
        del at, hot
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        slots, starts = np.unique((tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), return_index=True)
        for bucket, a, b in zip(slots, starts, np.append(starts[1:], len(tokens))):
            out.append((0, int(bucket), squeezed(np.array([name]), low_high(owner[a:b]), planes(tokens[a:b]))))
        del tokens, owner, order
        for a in range(0, len(out), 64):
            kinds, slots, payloads = zip(*out[a : a + 64])
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(slots, pa.int32()), pa.array(payloads, pa.binary())], names=["kind", "slot", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        found: dict[int, np.ndarray] = {}
        tokens = 0
        for batch in batches:
            for part in sliced(batch):
                for s in sets_of(part.column(0), n):
                    name = named(*signature(s), collided)
                    if len(s) and name not in found:
                        found[name] = s
                        tokens += len(s)
                        if tokens >= TOKENS_HELD or len(found) >= SETS_HELD:
                            yield from sent(found, frequent.value)
                            tokens = 0
        if found:
            yield from sent(found, frequent.value)
        trim()

    return rows.select("text").mapInArrow(run, "kind int, slot int, payload binary")


def named(sig: int, other: int, collided: dict[int, set[int]]) -> int:
    """A set's name: the half of its signature that no other set has."""
    return other if other in collided.get(sig, ()) else sig


def shared(dealt: DataFrame, groups: int) -> DataFrame:
    """For each run: kind 0, its n-grams that several sets have, with the class of their number; kind 1 as dealt.

    A set that several runs have counts once for each: its n-grams are then answered though no other set has them, which
    keeps the set live and loses nothing.
    """

    def run(key: tuple, got: pa.Table) -> pa.Table:
        kind, slot = key[0].as_py(), key[1].as_py()
        payloads = got.column("payload")
        if kind == 1:
            return pa.table({"slot": pa.array([slot] * len(payloads), pa.int32()), "kind": pa.array([1] * len(payloads), pa.int32()), "payload": payloads})
        runs: dict[int, tuple] = {}
        for p in payloads:
            (name,), numbers, data = released(p.as_buffer(), *DEALT)
            runs.setdefault(int(name), (from_low_high(numbers), data))
        names, counts = list(runs), np.array([len(x) for x, _ in runs.values()])
        owner = np.concatenate([x for x, _ in runs.values()])
        tokens = np.concatenate([from_planes(x) for _, x in runs.values()])
        runs.clear()
        of = np.repeat(np.arange(len(names), dtype=np.int32), counts)
        order = np.argsort(tokens, kind="stable")
        tokens, owner, of = tokens[order], owner[order], of[order]
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        df = np.diff(np.append(starts, len(tokens)))
        several = np.repeat(df >= 2, df)
        classes = np.repeat(np.log2(df).astype(np.uint8), df)[several]
        tokens, owner, of = tokens[several], owner[several], of[several]
        order = np.argsort(of, kind="stable")
        bounds = np.searchsorted(of[order], np.arange(len(names) + 1))
        out = [squeezed(np.array([name, count]), low_high(owner[k]), classes[k], planes(tokens[k])) for name, count, a, b in zip(names, counts.tolist(), bounds[:-1], bounds[1:]) for k in [order[a:b]]]
        del tokens, owner, classes, order, several, of, df
        trim()
        return pa.table({"slot": pa.array([name % groups for name in names], pa.int32()), "kind": pa.array([0] * len(out), pa.int32()), "payload": pa.array(out, pa.binary())})

    return dealt.groupBy("kind", "slot").applyInArrow(run, "slot int, kind int, payload binary")


LIVE = "sig long, n int, alone int, tokens binary, classes binary, marks array<array<smallint>>"


def live_sets(found: DataFrame, frequent, percent: int) -> DataFrame:
    """The sets whose own n-grams do not fill their prefix, with the n-grams they share with others, sorted, their classes, and 16 bits of each prefix token under the orders but the first."""

    def of_run(head: list, answers: list[list], often: np.ndarray) -> Iterator[tuple]:
        (_, dealt), sigs, sizes, hot_counts, hot = head
        counted, owner, classes, data = 0, [], [], []
        for p in answers:
            (_, n), numbers, c, d = p
            counted += int(n)
            owner.append(from_low_high(numbers))
            classes.append(c)
            data.append(from_planes(d))
        if counted != dealt:
            raise RuntimeError(f"{counted} of a run's {dealt} n-grams were counted: its rows have changed their order between two attempts")
        owner, classes, tokens = (np.concatenate([*x, np.zeros(0, k)]) for x, k in ((owner, np.uint16), (classes, np.uint8), (data, np.uint64)))
        order = np.argsort(owner, kind="stable")
        classes, tokens = classes[order], tokens[order]
        bounds = np.searchsorted(owner[order], np.arange(len(sigs) + 1))
        hot_at = np.concatenate([[0], np.cumsum(hot_counts)])
        sizes = sizes.astype(np.int64)
        alone = sizes - np.diff(bounds) - hot_counts
        for i in np.flatnonzero(alone < sizes - needed(sizes, percent) + 1).tolist():
            t = np.concatenate([tokens[bounds[i] : bounds[i + 1]], often[hot[hot_at[i] : hot_at[i + 1]]]])
            c = np.concatenate([classes[bounds[i] : bounds[i + 1]], np.full(hot_counts[i], FREQUENT_CLASS, np.uint8)])
            o = np.argsort(t)
            t, c = t[o], c[o]
            marks = [np.unique(prefix(t, c, int(sizes[i]), int(alone[i]), k, percent).astype(np.uint16).view(np.int16)) for k in ORDERS[1:]]
            yield int(sigs[i]), int(sizes[i]), int(alone[i]), t.tobytes(), c.tobytes(), marks

    def run(key: tuple, got: pa.Table) -> pa.Table:
        heads: dict[int, list] = {}
        answers: dict[int, list] = {}
        for kind, p in zip(got.column("kind").to_pylist(), got.column("payload")):
            if kind:
                head = unpack(p.as_buffer(), *RUN)
                heads.setdefault(int(head[0][0]), head)
            else:
                answer = released(p.as_buffer(), *ANSWER)
                answers.setdefault(int(answer[0][0]), []).append(answer)
        if answers.keys() - heads.keys():
            raise RuntimeError("n-grams of a run without signatures: its rows have changed their order between two attempts")
        rows = [r for name, head in heads.items() for r in of_run(head, answers.pop(name, []), frequent.value)]
        columns = list(zip(*rows)) if rows else [()] * 6
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.list_(pa.int16())))
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds)], names=["sig", "n", "alone", "tokens", "classes", "marks"])

    return found.groupBy("slot").applyInArrow(run, LIVE)


def prefix(tokens: np.ndarray, classes: np.ndarray, n: int, alone: int, order: int, percent: int) -> np.ndarray:
    """A set's shared n-grams in its prefix under one order; they follow `alone` ones that no other set has."""
    return tokens[np.lexsort((mixed(tokens, order), classes))[: n - needed(n, percent) + 1 - alone]]


def postings(live: DataFrame, percent: int) -> DataFrame:
    """(token, sig, n, place, alone) of the prefixes under the first order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, owners, sizes, places, alones = [], [], [], [], []
            for sig, n, alone, t, c in zip(*(x.to_pylist() for x in batch.columns)):
                p = prefix(np.frombuffer(t, "<u8"), np.frombuffer(c, "u1"), n, alone, ORDERS[0], percent)
                tokens.append(p)
                owners.append(np.full(len(p), sig, np.int64))
                sizes.append(np.full(len(p), n, np.int32))
                places.append(np.arange(alone, alone + len(p), dtype=np.int32))
                alones.append(np.full(len(p), alone, np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places)), pa.array(np.concatenate(alones))], names=["token", "sig", "n", "place", "alone"])

    return live.select("sig", "n", "alone", "tokens", "classes").mapInArrow(run, "token long, sig long, n int, place int, alone int")


def verified(pairs: DataFrame, live: DataFrame, n_live: int, percent: int) -> DataFrame:
    """The pairs (a: a hub, b; na, nb: their sizes) that share prefix n-grams under all orders and are similar."""
    marks = lambda name: live.select(F.col("sig").alias(name), F.col("marks").alias(f"marks_{name}"))
    every = [F.arrays_overlap(F.col("marks_a")[k], F.col("marks_b")[k]) for k in range(len(ORDERS) - 1)]
    pairs = cut(pairs, "pairs")
    # few files of small tables: a bucketed scan has a task for each bucket
    hubs = cut(pairs.select("a").distinct().join(marks("a"), "a").hint("rebalance"), "hubs")  # a hub of many pairs is then a join's hot key, which Spark splits
    met = pairs.join(marks("b"), "b").join(hubs, "a")
    for meets in every:
        met = met.where(meets)
    tile = F.pmod(F.xxhash64("a"), F.lit(max(1, n_live // TILE_HUBS)))
    met = cut(met.select("a", "b", "na", "nb", tile.alias("tile")).hint("rebalance"), "candidates")
    # a tile of many others is split by them, so that a hub goes to few of its parts
    chunks = cut(met.groupBy("tile").agg(F.ceil(F.greatest(F.count("*") / TILE_OTHERS, F.sum("nb") / TILE_TOKENS)).alias("chunks")), "tiles")
    tiled = met.join(chunks, "tile").select("a", "b", "tile", F.pmod(F.xxhash64("b", F.lit(1)), F.col("chunks")).alias("chunk"))
    sets = live.select("sig", "n", "tokens")
    sent = [tiled.select("tile", "chunk", F.col(c).alias("sig")).distinct().join(sets, "sig").select("tile", "chunk", F.lit(side).alias("side"), "sig", F.lit(None).cast("long").alias("b"), "n", "tokens") for side, c in enumerate("ab")]
    parts = sent[0].union(sent[1]).union(tiled.select("tile", "chunk", F.lit(2), "a", "b", F.lit(None).cast("int"), F.lit(None).cast("binary")))

    def run(key: tuple, got: pa.Table) -> pa.Table:
        sides: list[dict[int, tuple]] = [{}, {}]
        asked: list[tuple[int, int]] = []
        for side, sig, b, n, tokens in zip(*(got.column(c).to_pylist() for c in ("side", "sig", "b", "n", "tokens"))):
            if side == 2:
                asked.append((sig, b))
            else:
                sides[side][sig] = n, np.frombuffer(tokens, "<u8")
        good = []
        for a, b in asked:
            (n, x), (m, y) = sides[0][a], sides[1][b]
            least = overlap(n, m, percent)
            if min(len(x), len(y)) >= least and common(x, y) >= least:
                good.append((a, b))
        return pa.table({"a": pa.array([g[0] for g in good], pa.int64()), "b": pa.array([g[1] for g in good], pa.int64())})

    return parts.groupBy("tile", "chunk").applyInArrow(run, "a long, b long")


def near_components(asked: DataFrame, members: DataFrame, live: DataFrame, n_live: int, percent: int) -> DataFrame:
    """Of (a: a component, b, lo: the size of the component's smallest set, m: of b): those where b shares so much with all the component's sets (label, n, tokens) together that it may be similar to one.

    A component's n-grams, and those of the sets asked about, are split by token into parts of a bounded size.
    """
    held = members.join(asked.select(F.col("a").alias("label")).distinct(), "label", "left_semi")
    volume = held.groupBy("label").agg(F.sum("n").alias("own")).join(asked.groupBy(F.col("a").alias("label")).agg(F.sum("m").alias("other")), "label")
    parts = cut(volume.select("label", F.ceil((F.col("own") + F.col("other")) / PART_TOKENS).cast("int").alias("parts")), "parts")
    least = F.expr(f"({percent} * (greatest(lo, ({percent} * m + 99) div 100) + m) + {99 + percent}) div {100 + percent}").alias("least")
    of_component = members.join(parts, "label").select("label", "parts", F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("least"), "tokens")
    of_sets = asked.join(live.select(F.col("sig").alias("b"), "tokens"), "b").withColumnRenamed("a", "label").join(parts, "label").select("label", "parts", "b", least, "tokens")
    schema = "label long, part int, b long, least long, tokens binary"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            together: dict[tuple, list[np.ndarray]] = {}
            for label, n, b, enough, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                together.setdefault((label, n, b, enough), []).append(np.frombuffer(tokens, "<u8"))
            rows = []
            for (label, n, b, enough), held in together.items():
                t = np.unique(np.concatenate(held)) if len(held) > 1 else held[0]
                if n == 1:
                    rows.append((label, 0, b, enough, t.tobytes()))
                    continue
                order, found, bounds = by_slot((mixed(t, 5) % np.uint64(n)).astype(np.int64))
                rows += [(label, int(p), b, enough, t[order[x:y]].tobytes()) for p, x, y in zip(found, bounds[:-1], bounds[1:])]
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["label", "part", "b", "least", "tokens"])

    def run(key: tuple, got: pa.Table) -> pa.Table:
        whole: dict[int, list[np.ndarray]] = {}
        sets: list[tuple] = []
        for label, b, enough, tokens in zip(*(got.column(c).to_pylist() for c in ("label", "b", "least", "tokens"))):
            t = np.frombuffer(tokens, "<u8")
            if b is None:
                whole.setdefault(label, []).append(t)
            else:
                sets.append((label, b, enough, t))
        together = {label: np.unique(np.concatenate(held)) for label, held in whole.items()}
        found = [(label, b, enough, n) for label, b, enough, t in sets if label in together and (n := common(np.sort(t), together[label]))]
        columns = list(zip(*found)) if found else [()] * 4
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("a", "b", "least", "shared"), columns)})

    dealt = of_component.union(of_sets).mapInArrow(split, schema).withColumn("tile", F.pmod(F.xxhash64("label"), F.lit(max(1, n_live // TILE_HUBS))))
    counts = dealt.groupBy("tile", "part").applyInArrow(run, "a long, b long, least long, shared long")
    return counts.groupBy("a", "b", "least").agg(F.sum("shared").alias("shared")).where("shared >= least").select("a", "b")


def common(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements two sorted arrays of distinct elements share."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def connected(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(sig, label): the smallest node of the component of each node that an edge (a, b) has. Alternating stars.

    The rounds needed grow with the logarithm of a component's size; more than `rounds` is an error.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    for _ in range(rounds):
        # large star: a node's larger neighbours go to its smallest neighbour
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = cut(small, "edges")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components were not complete after {rounds} rounds")
    return now.select(F.col("u").alias("sig"), F.col("v").alias("label")).union(now.select(F.col("v").alias("sig"), F.col("v").alias("label")).distinct())


def links(live: DataFrame, percent: int) -> DataFrame:
    """(sig, label) of the live sets that are linked: stars first, then what remains between components.

    Tables that are joined are written first: Spark can split a join's hot keys where no other step needs them together.
    """
    n_live = live.count()
    lists = cut(postings(live, percent), "postings")
    fits = lambda n, m: (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)
    pairs = lambda df: df.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"))
    # the leader is the set with the smallest share of n-grams of its own: the least edited copy is near most others
    central = F.min(F.struct((F.col("alone") / F.col("n")).alias("h"), F.xxhash64("sig").alias("i"), F.col("sig").alias("a"), F.col("n").alias("na"))).alias("l")
    leaders = cut(lists.groupBy("token").agg(central, F.count("*").alias("c")).where("c > 1").select("token", "l.a", "l.na"), "leaders")
    stars = lists.join(leaders, "token").where("sig <> a").where(fits("n", "na")).select("a", F.col("sig").alias("b"), "na", F.col("n").alias("nb"))
    edges = cut(verified(pairs(stars), live, n_live, percent), "star-links")
    labels = connected(edges)
    sizes = cut(labels.groupBy("label").agg(F.count("*").alias("size")), "sizes")
    own = cut(lists.join(labels.join(sizes, "label"), "sig", "left").withColumn("label", F.coalesce("label", "sig")).withColumn("size", F.coalesce("size", F.lit(1))), "own")
    several = cut(own.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token"), "several")
    own = cut(own.join(several, "token", "left_semi").select("token", "sig", "n", "place", "alone", "label", "size"), "own")

    # a set of the smaller component against the larger component as a whole
    x = own.select("token", F.col("sig").alias("b"), F.col("n").alias("m"), (F.col("n") - F.col("place")).alias("reach"), F.col("label").alias("of"), F.col("size").alias("of_size"))
    whole = cut(own.groupBy("token", "label", "size").agg(F.max(F.col("n") - F.col("place")).alias("reaches"), F.min("n").alias("lo"), F.max("n").alias("hi")), "whole")
    smaller = (F.col("of_size") < F.col("size")) | ((F.col("of_size") == F.col("size")) & (F.col("of") < F.col("label")))
    least = F.col("m") + F.greatest(F.col("lo"), F.col("m") * percent / 100)
    near = (F.col("hi") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("lo") * percent) & (F.least("reach", "reaches") * (100 + percent) >= least * percent)
    asked = cut(x.join(whole, "token").where((F.col("of") != F.col("label")) & smaller & near).groupBy(F.col("label").alias("a"), "b").agg(F.min("lo").cast("long").alias("lo"), F.max("m").cast("long").alias("m")), "set-component")
    members = live.select("sig", "n", "tokens").join(labels, "sig", "left").select(F.coalesce("label", "sig").alias("label"), "n", "tokens")
    maybe = cut(near_components(asked, members, live, n_live, percent), "maybe")

    # then against the component's leaders in their lists
    leaders = cut(own.groupBy("token", "label").agg(central).select("token", "label", "l.a", "l.na"), "leaders")
    few = own.select("token", F.col("sig").alias("b"), F.col("n").alias("nb")).join(maybe.withColumnRenamed("a", "label"), "b").join(leaders, ["token", "label"]).where(fits("nb", "na"))
    edges = cut(edges.union(verified(pairs(few), live, n_live, percent)), "links")
    labels = cut(connected(edges), "components")

    # and what is still apart against all its sets
    of = lambda name: labels.select(F.col("sig").alias(name), F.col("label").alias(f"{name}_label"))
    apart = maybe.join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(a_label, a) <> coalesce(b_label, b)").select(F.col("a").alias("label"), "b")
    x = own.select("token", F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb")).join(apart, "b")
    y = own.select("token", "label", F.col("sig").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"))
    reach = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))  # what the sets can share from this n-gram on
    rest = x.join(y, ["token", "label"]).where(fits("na", "nb") & (reach * (100 + percent) >= (F.col("na") + F.col("nb")) * percent))
    more = verified(pairs(rest), live, n_live, percent)
    return connected(edges.union(more))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """(key, n_shingles, component_id) of every row: the smallest key that links of at least `percent` similarity reach."""
    spark = docs.sparkSession
    rows = bounded_batches(docs).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    seen = cut(first_pass(rows, words), "shingle-sets", keep=True)
    # FREQUENT_MOST values at most
    frequent = spark.sparkContext.broadcast(np.sort(np.array([r.token for r in seen.where("token is not null").groupBy("token").agg(F.sum("rows").alias("rows")).orderBy(F.desc("rows"), "token").limit(FREQUENT_MOST).collect()], np.int64).view(np.uint64)))
    sizes = seen.where("token is null").select("key", "n", "sig", "other")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("rows")).first()
    with scratch():
        sets = cut(sizes.where("n > 0").groupBy("sig", "other").agg(F.min("key").alias("least")), "sets")
        several = sets.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1")
        found = sets.join(several, "sig").select("sig", "other").limit(COLLIDED_MOST + 1).collect()
        if len(found) > COLLIDED_MOST:
            raise ValueError("signatures of 64 bits are too short for so many sets")
        collided = {sig: {r.other for r in found if r.sig == sig} for sig in {r.sig for r in found}}
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        buckets, groups = max(2 * parts, total.tokens // TOKENS_PER_BUCKET), max(2 * parts, total.tokens // TOKENS_HELD)
        live = cut(live_sets(shared(deal(rows, words, frequent, collided, buckets, groups), groups), frequent, percent).dropDuplicates(["sig"]), "live-sets", "sig")
        labels = cut(links(live, percent), "labels")
        name = F.when(F.array_contains(F.lit(sorted(collided)), F.col("sig")), F.col("other")).otherwise(F.col("sig")) if collided else F.col("sig")
        least = sets.select(name.alias("sig"), "least")
        smallest = cut(least.join(labels, "sig").groupBy("label").agg(F.min("least").alias("component_id")), "smallest")
        linked = labels.join(smallest, "label").select("sig", "component_id")
        of_set = cut(least.join(linked, "sig", "left").select("sig", F.coalesce("component_id", "least").alias("component_id")), "components", keep=True)
    full = sizes.where("n > 0").select("key", "n", name.alias("sig")).join(of_set, "sig").select("key", "n", "component_id")
    empty = sizes.where("n = 0").select("key", "n", F.col("key").alias("component_id"))
    return full.union(empty).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")
