"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Seeds are three words of a benchmark item, side by side or with a gap of one, so that single replaced words leave some.
A first pass counts the documents that have each seed; every item keeps its rare ones. A seed is too common if more than
COMMON of all documents have it, and more than RARE times as many as have the item's median seed that occurs at all, so
a passage that was copied everywhere keeps its seeds; and so that a common part of an item keeps some as well, every run of
RUN words keeps its rarest, whatever their count. A second pass joins
documents to items through these seeds, puts windows around the hits, and aligns item and window by words: a match
scores 2, a replacement or a gap costs 1. The score is the best local alignment over that of the whole item; from
`threshold` on the document holds the item, where seven words at least (or the whole item) match.

The benchmark is the stated query set: it is taken in blocks of a bounded size, each broadcast, against all rows. There
is no shuffle of texts, and no pairs but the joined ones are made.

Defined results: null or empty texts hold nothing, and items of under three words, or without text, are never found; an
empty table of either kind gives an empty one. Each row of the documents is judged by itself: a row that holds several
items gives one row for each item, with the item's best score in it and, of places that score the same, the first; so
repeated rows are repeated, and rows without an id stay apart. Repeated items count once; of an item id's different texts
the best counts. Very long texts are aligned in windows, and lose nothing. Ids may have any type. Only id and text of
either table are read by `leaks`, so other columns cannot clash; `clean` keeps all columns of the documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyweir.llm.common import bounded_batches, flat_utf8, mixed, sliced, word_hashes

#: Bytes of benchmark text in a block, which is collected and broadcast.
BLOCK_BYTES = 4 << 20
THRESHOLD, LEAST_SCORE = 0.35, 14
RARE, COMMON = 3, 0.01
#: Words that match at least, for LEAST_SCORE.
RUN = 7
SHAPES = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
CELLS = 1 << 21
BITS = 22
SEPARATOR = np.ones(256, bool)
SEPARATOR[128:] = False
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
    SEPARATOR[_c] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def folded(flat: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case."""
    out = LOWER[flat]
    upper = (flat[1:] >= 0x80) & (flat[1:] <= 0x9E) & (flat[1:] != 0x97) & (flat[:-1] == 0xC3)
    out[1:][upper] += 32
    return out


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each text's offsets in them."""
    flat, offsets = flat_utf8(texts)
    words, _, _, at = word_hashes(folded(flat), offsets, SEPARATOR)
    return words, at


def seeds_of(words: np.ndarray) -> list[np.ndarray]:
    """For each shape, the seed hashes from each word on."""
    c = mixed(np.arange(11, 14, dtype=np.uint64)) | np.uint64(1)
    out = []
    for k, (_, a, b) in enumerate(SHAPES):
        n = max(0, len(words) - b)
        out.append(mixed(words[:n] * c[0] + words[a : a + n] * c[1] + words[b : b + n] * c[2], k + 1))
    return out


@dataclass
class Block:
    """A block of the benchmark: items, their words, and the seeds with the items that have them."""

    ids: list
    words: list[np.ndarray]
    seeds: np.ndarray  # sorted
    starts: np.ndarray  # of each seed's items
    items: np.ndarray

    def __post_init__(self) -> None:
        self.bitmap = np.zeros(1 << BITS, bool)
        self.bitmap[(self.seeds >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def hits(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, number of the seed) of all seeds in the texts."""
        found = []
        for seeds, (_, _, last) in zip(seeds_of(words), SHAPES):
            p = np.flatnonzero(self.bitmap[(seeds >> np.uint64(64 - BITS)).astype(np.int64)])
            k = np.searchsorted(self.seeds, seeds[p])
            k[k == len(self.seeds)] = 0
            good = self.seeds[k] == seeds[p] if len(self.seeds) else np.zeros(len(p), bool)
            p, k = p[good], k[good]
            text = np.searchsorted(at, p, "right") - 1
            inside = p + last < at[text + 1]
            found.append((text[inside], p[inside], k[inside]))
        return tuple(np.concatenate(x) for x in zip(*found))


def block_of(rows: list[tuple]) -> Block:
    words, at = words_of(pa.array([t or "" for _, t in rows], pa.string()))
    items = [words[a:b] for a, b in zip(at[:-1], at[1:])]
    seeds = [np.unique(np.concatenate(seeds_of(w))) for w in items]
    return _indexed([k for k, _ in rows], items, seeds)


def _indexed(ids: list, words: list[np.ndarray], seeds: list[np.ndarray]) -> Block:
    flat = np.concatenate([*seeds, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
    order = np.argsort(flat, kind="stable")
    unique, starts = np.unique(flat[order], return_index=True)
    return Block(ids, words, unique, np.append(starts, len(flat)), owner[order])


def local_seeds(block: Block, words: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Numbers of an item's seeds that are among the rarest, up to RARE times the least count, of a run of RUN words."""
    size = min(RUN, len(words))
    least = np.full(len(words) - size + 1, np.inf)  # by the first word of a run
    found = []
    for seeds, (_, _, last) in zip(seeds_of(words), SHAPES):
        if len(seeds):
            k = np.searchsorted(block.seeds, seeds)
            n = size - last  # seeds of the shape in a run
            found.append((k, n))
            least = np.minimum(least, sliding_window_view(np.where(df[k] > 0, df[k], np.inf), n).min(axis=1))
    kept = [np.zeros(0, np.int64)]
    for k, n in found:
        of = np.concatenate([np.zeros(n - 1), least, np.zeros(n - 1)])
        kept.append(k[df[k] <= RARE * sliding_window_view(of, n).max(axis=1)])
    return np.concatenate(kept)


def rare_block(block: Block, counts: dict[int, int], documents: int) -> Block:
    """The block with the rare seeds of each item, and the rarest of each run of its words, only."""
    df = np.array([counts.get(int(s), 0) for s in block.seeds.view(np.int64)], np.int64)
    of: dict[int, list[int]] = defaultdict(list)
    for k in range(len(block.seeds)):
        for i in block.items[block.starts[k] : block.starts[k + 1]]:
            of[int(i)].append(k)
    kept = [np.zeros(0, np.uint64)] * len(block.ids)
    for i, ks in of.items():
        k = np.array(ks)
        seen = df[k][df[k] > 0]
        most = max(COMMON * documents, RARE * np.median(seen)) if len(seen) else 0
        rare = df[k] <= most
        if not rare.all():
            rare |= np.isin(k, local_seeds(block, block.words[i], df))
        kept[i] = block.seeds[k[rare]]
    return _indexed(block.ids, block.words, kept)


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best Smith-Waterman score of each pair, and where in the window it ends; pairs of like size go together."""
    score, end = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    order = sorted(range(len(items)), key=lambda i: (len(items[i]), len(windows[i])))
    a = 0
    while a < len(order):
        n, m, b = 0, 0, a
        while b < len(order):
            n2, m2 = max(n, len(items[order[b]])), max(m, len(windows[order[b]]))
            if b > a and m2 * (b + 1 - a) > CELLS // 16:
                break
            n, m, b = n2, m2, b + 1
        group = order[a:b]
        x, y = np.zeros((len(group), n), np.uint64), np.ones((len(group), m), np.uint64)  # 0 and 1 are padding
        for r, i in enumerate(group):
            x[r, : len(items[i])] = items[i] | np.uint64(2)
            y[r, : len(windows[i])] = windows[i] | np.uint64(2)
        places = np.arange(m, dtype=np.int32)
        h = np.zeros((len(group), m), np.int32)
        best, at = np.zeros(len(group), np.int32), np.zeros(len(group), np.int64)
        for i in range(n):
            step = np.where(x[:, i : i + 1] == y, 2, -1).astype(np.int32)
            step[:, 1:] += h[:, :-1]
            np.maximum(step, h - 1, out=step)
            np.maximum(step, 0, out=step)
            h = np.maximum.accumulate(step + places, axis=1) - places
            top = h.argmax(axis=1)
            value = h[np.arange(len(group)), top]
            better = value > best
            best[better], at[better] = value[better], top[better]
        score[group], end[group] = best, at
        a = b
    return score, end


def windows_of(places: np.ndarray, size: int, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Windows of words around the sorted places, for an item of `size` words in a text from word lo to hi."""
    cuts = np.flatnonzero(np.diff(places) > size) + 1
    for run in np.split(places, cuts):
        a, b = max(lo, int(run[0]) - size), min(hi, int(run[-1]) + size + 4)
        while True:
            stop = b if b - a <= 6 * size + 8 else a + 4 * size + 8
            yield a, stop
            if stop >= b:
                break
            a = stop - 2 * size


def found_in(block: Block, words: np.ndarray, at: np.ndarray, threshold: float) -> list[tuple[int, int, float, int]]:
    """(text, item, score, word at which the alignment ends) of all items found in the texts."""
    text, place, seed = block.hits(words, at)
    if not len(text):
        return []
    n = block.starts[seed + 1] - block.starts[seed]
    number = np.concatenate([block.items[block.starts[s] : block.starts[s + 1]] for s in seed])
    text, place = np.repeat(text, n), np.repeat(place, n)
    order = np.lexsort((place, number, text))
    text, number, place = text[order], number[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (number[1:] != number[:-1])]))
    out: dict[tuple[int, int], tuple[float, int]] = {}
    asked: list[tuple[int, int, int, int]] = []

    def done() -> None:
        score, end = align([block.words[i] for _, i, _, _ in asked], [words[a:b] for *_, a, b in asked])
        for (t, i, a, _), s, e in zip(asked, score.tolist(), end.tolist()):
            size = len(block.words[i])
            share = s / (2 * size)
            if share >= threshold and s >= min(LEAST_SCORE, 2 * size) and share > out.get((t, i), (0.0, 0))[0]:
                out[t, i] = (share, a + e - int(at[t]))
        asked.clear()

    for a, b in zip(first, np.append(first[1:], len(text))):
        t, i = int(text[a]), int(number[a])
        for lo, hi in windows_of(place[a:b], len(block.words[i]), int(at[t]), int(at[t + 1])):
            asked.append((t, i, lo, hi))
        if len(asked) >= 4096:
            done()
    done()
    return [(t, i, s, e) for (t, i), (s, e) in sorted(out.items())]


def seed_counts(rows: DataFrame, block) -> DataFrame:
    """(seed, rows): documents that have each seed, and all under a null seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows_seen = block.value, 0
        counts = np.zeros(len(own.seeds), np.int64)
        for batch in batches:
            rows_seen += batch.num_rows
            for part in sliced(batch):
                text, _, seed = own.hits(*words_of(part.column(0)))
                pairs = np.unique(text * max(1, len(own.seeds)) + seed)
                counts += np.bincount(pairs % max(1, len(own.seeds)), minlength=len(own.seeds))
        k = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([*own.seeds[k].view(np.int64).tolist(), None], pa.int64()), pa.array([*counts[k].tolist(), rows_seen], pa.int64())], names=["seed", "rows"])

    return rows.select("text").mapInArrow(run, "seed long, rows long").groupBy("seed").agg(F.sum("rows").alias("rows"))


def blocks(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, block_bytes: int) -> Iterator:
    """Broadcast blocks of the benchmark, with rare seeds. All texts of one item id are in one block."""
    rows = bounded_batches(docs).select(F.col(text).cast("string").alias("text")).where("text is not null")
    asked = benchmark.select(F.col(item).alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null").distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // block_bytes))
    for p in range(parts):
        some = asked.where(F.pmod(F.xxhash64(F.col("item").cast("string")), F.lit(parts)) == p) if parts > 1 else asked
        own = block_of(sorted(((r.item, r.text) for r in some.collect()), key=lambda r: (str(r[0]), r[1])))  # a block: block_bytes
        spread = docs.sparkSession.sparkContext.broadcast(own)
        counts = {r.seed: r.rows for r in seed_counts(rows, spread).collect()}  # seeds of the block at most
        yield docs.sparkSession.sparkContext.broadcast(rare_block(own, counts, counts.get(None, 0)))


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, item, score, end_word) of the documents that hold benchmark items."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kinds = [rows.schema["key"].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()]
    item_type = to_arrow_type(benchmark.schema[item].dataType)
    schema = "key {}, item {}, score double, end_word long".format(*kinds)
    out = None
    for block in blocks(docs, benchmark, text, item, item_text, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            own = block.value
            for batch in batches:
                for part in sliced(batch):
                    best: dict[tuple, tuple[float, int]] = {}
                    for t, i, score, end in found_in(own, *words_of(part.column(1)), threshold):
                        best[t, own.ids[i]] = max(best.get((t, own.ids[i]), (0.0, 0)), (score, -end))
                    values = [pa.array([own_id for _, own_id in best], item_type), pa.array([s for s, _ in best.values()], pa.float64()), pa.array([-e for _, e in best.values()], pa.int64())]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([t for t, _ in best], pa.int64())), *values], names=["key", "item", "score", "end_word"])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out.withColumnsRenamed({"key": key, "item": item})


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no benchmark item, with all columns."""
    i = docs.columns.index(text)
    for block in blocks(docs, benchmark, text, item, item_text, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            own = block.value
            for batch in batches:
                for part in sliced(batch, text):
                    gone = {t for t, *_ in found_in(own, *words_of(part.column(i)), threshold)}
                    yield part.take(pa.array([r for r in range(part.num_rows) if r not in gone], pa.int64())) if gone else part

        docs = docs.mapInArrow(run, docs.schema)
    return docs
