"""Quality: random Fourier features of document statistics, ridge regression by summed normal equations, isotonic calibration.

Statistics of each whole text (lengths, shares of character classes, repetition of words and lines, entropy) are
standardised and mapped to cosines of random projections, which approximate a Gaussian kernel. Each partition of the
labelled rows adds up its part of the normal equations, the parts are summed row by row of the matrix, and the driver
solves one system of fixed size. On labelled rows kept back from the fit, raw scores are pooled into a rising step
function and joined by straight lines, so that scores are calibrated and still tell documents apart.

Defined results: a null or empty text has statistics of zero and gets their score; without labelled rows of both
classes every score is 0. Equal texts get equal rows, whatever rows they come with, and repeated rows are repeated; rows of
one id are judged by their own texts, and share the id's label, 1 if its labels differ. Raw scores that tie are pooled
together. A very long text is described whole; an empty table gives an empty table. Only ids, texts and labels are read, so
other columns cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.llm.common import bounded_batches, cut, flat_utf8, id_remainder, sliced

WIDTH = 256
RIDGE = 1.0
ROWS_PER_PART = 20_000
_is = lambda f: np.array([f(chr(b)) if b < 128 else 0 for b in range(256)], float)
CLASSES = np.array([_is(str.islower), _is(str.isupper), _is(str.isdigit), _is(str.isspace), _is(lambda c: c in ".,;:!?"), _is(lambda c: c in "#$%&*|<>{}[]=_~^\\/@+"), np.arange(256) >= 128])
STATISTICS = 26


def describe(text: str, counts: np.ndarray) -> list[float]:
    """The statistics of one whole text; counts: how often it has each byte."""
    n = int(counts.sum())
    if not n:
        return [0.0] * STATISTICS
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    w = max(1, len(words))
    tally = Counter(words)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    p = counts[counts > 0] / n
    distinct_lines = len(set(lines))
    marked = sum(x.rstrip()[-1:] in ".!?:" for x in lines) if lines else 0
    sentences = counts[46] + counts[33] + counts[63]
    top = tally.most_common(2)
    pairs = len(set(zip(words, words[1:])))
    capital = sum(x[0].isupper() for x in words)
    return [
        math.log1p(n), math.log1p(len(words)), math.log1p(len(lines)), float(lengths.mean()), float(lengths.std()), math.log1p(lengths.max()),
        *(CLASSES @ counts / n).tolist(), float(-(p * np.log2(p)).sum()), len(tally) / w, sum(c for _, c in top) / w, pairs / max(1, len(words) - 1),
        1 - distinct_lines / max(1, len(lines)), marked / max(1, len(lines)), math.log1p(w / max(1, sentences)), capital / w, math.log1p(w / max(1, len(lines))),
        float(counts.max()) / n, len(tally) / math.sqrt(w), math.log1p(counts[124]), math.log1p(counts[34]),
    ]


def statistics(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows, without their text, with the array of the text's statistics."""
    others = [f for f in bounded_batches(rows).schema if f.name not in (text, "stats")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, text):
                column = part.column(part.schema.get_field_index(text))
                flat, offsets = flat_utf8(column)
                made = [describe(t or "", np.bincount(flat[a:b], minlength=256)) for t, a, b in zip(column.to_pylist(), offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(f.name)) for f in others), pa.array(made, pa.list_(pa.float64()))], names=[*(f.name for f in others), "stats"])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "stats array<double>"]))


@dataclass
class Fourier:
    """cos(z W + b) of the standardised statistics z."""

    mean: np.ndarray
    scale: np.ndarray
    width: int = WIDTH
    bandwidth: float = 6.0
    seed: int = 11

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.directions = rng.normal(0, 1 / self.bandwidth, (len(self.mean), self.width))
        self.phases = rng.uniform(0, 2 * np.pi, self.width)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        # added up one statistic after another, so that a row's sums do not depend on the rows beside it
        angles = np.tile(self.phases, (len(z), 1))
        for i, direction in enumerate(self.directions):
            angles += z[:, i : i + 1] * direction
        return np.column_stack([np.cos(angles) * np.sqrt(2 / self.width), np.ones(len(z))])


@dataclass
class Model:
    fourier: Fourier
    weights: np.ndarray
    x: np.ndarray  # raw scores of the pooled blocks
    y: np.ndarray  # their shares of label 1

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return (self.fourier(stats) * self.weights).sum(axis=1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.x, self.y), 0.0, 1.0)


def isotonic(x: np.ndarray, positives: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean raw score and share of positives of each block, both rising."""
    blocks: list[list[float]] = []
    for v, p, n in sorted(zip(x, positives, counts)):
        blocks.append([v * n, p, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column(batch.schema.get_field_index("stats")).to_pylist(), np.float64).reshape(-1, STATISTICS)


def train(stats: DataFrame) -> Model | None:
    """stats: (key, y, stats) of labelled rows. Four fifths fit the weights, the rest calibrates; None without both classes."""
    rows = stats.withColumn("back", F.xxhash64(F.col("key").cast("string"), F.lit("calibration")) % 5 == 0)
    # bounded sums over all rows: moments for standardising
    moments = rows.select(F.count("*").alias("n"), F.countDistinct("y").alias("classes"), *(f(F.col("stats")[i]).alias(f"{name}{i}") for i in range(STATISTICS) for name, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if moments.classes < 2:
        return None
    fourier = Fourier(np.array([moments[f"m{i}"] for i in range(STATISTICS)]), np.maximum([moments[f"s{i}"] for i in range(STATISTICS)], 1e-6))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((WIDTH + 1, WIDTH + 2))
        for batch in batches:
            z = fourier(_matrix(batch))
            total += z.T @ np.column_stack([z, np.array(batch.column(batch.schema.get_field_index("y")).to_pylist(), float)])
        yield pa.RecordBatch.from_arrays([pa.array(range(WIDTH + 1), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["line", "sums"])

    def added(key: tuple, parts: pa.Table) -> pa.Table:
        sums = np.array(parts.column("sums").to_pylist()).sum(axis=0)
        return pa.table({"line": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([sums.tolist()], pa.list_(pa.float64()))})

    fitted = rows.where("not back").select("key", "y", "stats")
    parts = max(1, moments.n // ROWS_PER_PART)
    lines = fitted.repartition(parts, "key").select("y", "stats").mapInArrow(equations, "line int, sums array<double>").groupBy("line").applyInArrow(added, "line int, sums array<double>").collect()
    system = np.zeros((WIDTH + 1, WIDTH + 2))
    for r in lines:
        system[r.line] = r.sums
    penalty = np.full(WIDTH + 1, RIDGE)
    penalty[-1] = 0.0
    model = Model(fourier, np.linalg.solve(system[:, :-1] + np.diag(penalty), system[:, -1]), np.zeros(1), np.zeros(1))
    raw = apply(rows.where("back").select("key", "y", "stats"), lambda m: model.raw(m))
    # raw scores rounded to thousandths: a bounded number of groups
    pooled = raw.groupBy(F.round(F.greatest(F.least("score", F.lit(3.0)), F.lit(-3.0)), 3).alias("x")).agg(F.sum("y").alias("p"), F.count("*").alias("n")).orderBy("x").collect()
    if pooled:
        model.x, model.y = isotonic(np.array([r.x for r in pooled]), np.array([float(r.p) for r in pooled]), np.array([float(r.n) for r in pooled]))
    else:
        model.x, model.y = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def apply(stats: DataFrame, f) -> DataFrame:
    """stats, without the statistics, with a score of them."""
    others = [x for x in stats.schema if x.name not in ("stats", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(x.name)) for x in others), pa.array(f(_matrix(batch)), pa.float64())], names=[*(x.name for x in others), "score"])

    return stats.mapInArrow(run, ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in others), "score double"]))


def held_out(column, modulus: int = 4, remainder: int = 2):
    return id_remainder(column, modulus) == F.lit(remainder)


def predictions(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.7) -> DataFrame:
    """Trained on the labelled rows that are not held out, applied to all rows."""
    stats = cut(statistics(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))), "quality-stats")
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).where("key is not null and y is not null").groupBy("key").agg(F.max("y").alias("y"))
    model = train(marked.where(~held_out(F.col("key"))).join(stats, "key").select("key", "y", "stats"))
    scored = apply(stats, model.score) if model else stats.select("key", F.lit(0.0).alias("score"))
    return scored.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
