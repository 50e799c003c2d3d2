"""Language identification: averaged hashed subword embeddings, a linear softmax, stochastic gradient descent in numpy.

Subwords are the byte 3- and 4-grams of the text after folding: ASCII letters lower-cased, other ASCII bytes turned into
a space. A text's vector is the mean of its subwords' embeddings. As the output layer is linear, embeddings times output
weights are multiplied once after training, and a text's logits are the mean of its subwords' rows of that product.

Training takes a bounded sample of the labelled rows (`sample` rows, the smallest by a hash of their id). A fifth of it is
held back from the gradient to calibrate: a temperature for the probabilities, and the rejection threshold, the lowest
probability from which accepted predictions reach `precision` there. Predictions cover every row and whole texts, with
no shuffle.

Defined results: a null text, or one without a letter, gets `und` with score 0 and is rejected; with no labelled row at
all every row does. Equal texts get equal rows; ties between languages go to the first in alphabetical order; repeated
rows stay; a very long text is counted whole, and an empty table gives an empty table. Only id, text and, for training,
language are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.llm.common import bounded_batches, flat_utf8, id_remainder, segment_sums, sliced

BUCKETS = 1 << 13
WIDTH = 16
GRAMS = (3, 4)
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
FOLD = np.full(256, 32, np.uint8)
FOLD[128:] = np.arange(128, 256)
for _c in b"abcdefghijklmnopqrstuvwxyz":
    FOLD[_c] = FOLD[_c - 32] = _c


def subwords(flat: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each gram size: the buckets of all grams, and each text's offsets in them."""
    folded = FOLD[flat].astype(np.uint32)
    for n in GRAMS:
        if len(folded) < n:
            yield np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
            continue
        h = np.full(len(folded) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ folded[k : len(folded) - n + 1 + k]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        inside = np.ones(len(h), bool)  # a gram lies in one text
        for k in range(1, n):
            cut = offsets[1:-1] - k
            inside[cut[(cut >= 0) & (cut < len(h))]] = False
        counts = np.concatenate([[0], np.cumsum(inside)])
        yield (h >> np.uint32(32 - 13)).astype(np.int64)[inside], counts[np.minimum(offsets, len(h))]


def histograms(flat: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the buckets it has, and how often."""
    both = list(subwords(flat, offsets))
    out = []
    for i in range(len(offsets) - 1):
        counts = np.bincount(np.concatenate([g[o[i] : o[i + 1]] for g, o in both]), minlength=BUCKETS)
        found = np.flatnonzero(counts)
        out.append((found, counts[found]))
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: embeddings times output weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float], list[bool]]:
        flat, offsets = flat_utf8(texts)
        logits, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for grams, at in subwords(flat, offsets):
            logits += segment_sums(self.table[grams], at)
            n += np.diff(at)
        p = softmax((logits / np.maximum(n, 1)[:, None] + self.bias) / self.temperature)
        best = p.argmax(axis=1)
        known = [bool(t and LETTER.search(t)) for t in texts.to_pylist()]
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
        scores = [float(p[i, b]) if k else 0.0 for i, (b, k) in enumerate(zip(best, known))]
        return names, scores, [k and s >= self.threshold for k, s in zip(known, scores)]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], epochs: int = 10, rate: float = 0.8, batch: int = 32, precision: float = 0.99, seed: int = 7) -> Model:
    """Embeddings and softmax by SGD on four fifths of the rows; temperature and rejection threshold on the rest."""
    languages = sorted({r[2] for r in rows})
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (buckets, counts, _) in enumerate(rows):
        x[i, buckets] = counts / max(1, counts.sum())
    y = np.array([languages.index(r[2]) for r in rows])
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 1 / np.sqrt(WIDTH), (BUCKETS, WIDTH)).astype(np.float32)
    weights, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    order = rng.permutation(len(rows))
    held, trained = order[: len(rows) // 5], order[len(rows) // 5 :]
    onehot = np.eye(len(languages), dtype=np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        rng.shuffle(trained)
        for a in range(0, len(trained), batch):
            k = trained[a : a + batch]
            hidden = x[k] @ embedding
            error = (softmax(hidden @ weights + bias) - onehot[y[k]]) / len(k)
            back = error @ weights.T
            weights -= step * hidden.T @ error
            bias -= step * error.sum(axis=0)
            used = np.flatnonzero(x[k].any(axis=0))
            # averages over many subwords give each a small gradient: embeddings take larger steps
            embedding[used] -= 50 * step * x[k][:, used].T @ back
    table = embedding @ weights
    model = Model(languages, table, bias.astype(np.float64), 1.0, 0.0)
    if len(held):
        z = x[held] @ table + bias
        loss = lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(held)), y[held]], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.05, 5, 41), key=loss))
        p = softmax(z / model.temperature)
        scores, right = p.max(axis=1), p.argmax(axis=1) == y[held]
        down = np.argsort(-scores, kind="stable")
        reached = np.flatnonzero(np.cumsum(right[down]) / np.arange(1, len(down) + 1) >= precision)
        model.threshold = float(scores[down[reached[-1]]]) if len(reached) else 1.0
    return model


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 4000, **options) -> Model | None:
    """A model of a bounded sample of the rows that have a language and a text; None if there are none."""
    rows = bounded_batches(docs).select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null")
    ids = rows.select("key", "lang").orderBy(F.xxhash64(F.col("key").cast("string")), "key", "lang").limit(sample).select("key").distinct()
    chosen = rows.join(F.broadcast(ids), "key", "left_semi").where("text is not null")  # ids: `sample` rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                found = histograms(*flat_utf8(part.column(part.schema.get_field_index("text"))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([str(k) for k in part.column(0).to_pylist()]), part.column(1), pa.array([b.astype("<u2").tobytes() for b, _ in found], pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in found], pa.binary())],
                    names=["key", "lang", "buckets", "counts"],
                )

    got = chosen.select("key", "lang", "text").mapInArrow(run, "key string, lang string, buckets binary, counts binary").orderBy("key", "lang", "buckets", "counts").limit(2 * sample).collect()  # in order: ids may repeat
    rows = sorted((r.key, r.lang, bytes(r.buckets), bytes(r.counts)) for r in got if r.buckets)
    if not rows:
        return None
    return fit([(np.frombuffer(b, "<u2").astype(np.int64), np.frombuffer(c, "<u4"), language) for _, language, b, c in rows], **options)


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, accepted) for each row's whole text."""
    chosen = bounded_batches(docs).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = chosen.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                n = part.num_rows
                names, scores, accepted = model.predict(part.column(1)) if model else ([UNKNOWN] * n, [0.0] * n, [False] * n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], names=["key", "lang_pred", "score", "accepted"])

    return chosen.mapInArrow(run, f"key {kind}, lang_pred string, score double, accepted boolean").withColumnRenamed("key", key)


def held_out(column, modulus: int = 4, remainder: int = 2):
    return id_remainder(column, modulus) == F.lit(remainder)


def predictions(docs: DataFrame) -> DataFrame:
    """Trained on the rows that are not held out, applied to all."""
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
