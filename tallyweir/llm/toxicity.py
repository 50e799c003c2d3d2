"""Toxicity: a Levenshtein automaton intersected with a lexicon trie, and context windows that tell quotation from abuse.

The lexicon is learned: words that are much more frequent in toxic training documents than in clean ones. One
deterministic automaton accepts all words within the allowed distance of a lexicon word. Its states are sets of
(trie node, edits so far), so the Levenshtein automata of all words are walked together down the trie. A misspelled form
counts unless it is a word of clean training documents itself.

Each match is seen in a window of tokens: inside quotation marks, and more so near a word of reporting, it counts as
quotation; other matches close by strengthen it. A logistic regression over the document's match counts, quoted counts,
densities and strongest window gives the score.

Training takes a bounded sample of labelled rows (`sample`): half of it for the lexicon, the other half for the
regression, so that chance words of the first half get no weight. The lexicon is bounded too: LEXICON words, those that tell
most toxic documents apart, of LONGEST_WORD letters at most. Words are counted and chosen in Spark. Every row's whole text is
scored, tokens of any length are walked, and there is no shuffle of texts.

Defined results: a null or empty text has no tokens and gets the score of a document without matches; without labelled
rows the lexicon is empty and every score is 0. Equal texts get equal rows, repeated rows are repeated, ties of lexicon
words go to alphabetical order; an id with several labels is toxic if one of them says so. A very long text is scored whole,
and an empty table gives an empty table. Only ids, texts and labels are read, so other columns cannot clash; `accepted` keeps
all columns.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.llm.common import bounded_batches, cut, held_by_worker, id_remainder, sliced, trim

#: Labelled rows used for training at most, and words of the lexicon at most.
SAMPLE, LEXICON = 20_000, 512
WINDOW = 8
#: Results that a worker keeps, of tokens of so many letters.
TOKENS_KEPT, LONGEST_KEPT = 120_000, 40
LONGEST_WORD = 40
#: Look-alikes of letters, quotation marks, words of reporting.
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
OPENING, CLOSING = "\"'“„«‘‹", "\"'”“»’›"
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes word term sagte sagt schrieb nannte zitat wort dit écrit appelé cite mot dijo dice escribió llamó cita palabra".split())
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’‹›…–—¡¿"
N_FEATURES = 9


def edits_for(word: str) -> int:
    """Edits allowed: none below 5 letters, one below 9, else two."""
    return 0 if len(word) < 5 else 1 if len(word) < 9 else 2


@dataclass
class Automaton:
    """A deterministic automaton of all words near the lexicon's, made as far as it is walked."""

    words: list[str]
    children: list[dict[str, int]] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    budget: list[int] = field(default_factory=list)
    states: dict[frozenset, int] = field(default_factory=dict)
    sets: list[frozenset] = field(default_factory=list)
    moves: list[dict[str, int]] = field(default_factory=list)
    accepts: list[tuple[int, int] | None] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.children, self.ends, self.budget = [{}], [-1], [0]
        for w, word in enumerate(self.words):
            node = 0
            for c in word:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.budget.append(0)
                self.budget[node] = max(self.budget[node], edits_for(word))
                node = self.children[node][c]
            self.budget[node] = max(self.budget[node], edits_for(word))
            self.ends[node] = w
        self.alphabet = {c for x in self.children for c in x}
        self.start = self._state({(0, 0)})

    def _closed(self, pairs: set[tuple[int, int]]) -> frozenset:
        """With the moves that delete a letter of the lexicon word; only the fewest edits of each node are kept."""
        best: dict[int, int] = {}
        todo = deque(pairs)
        while todo:
            node, edits = todo.popleft()
            if edits > self.budget[node] or best.get(node, 99) <= edits:
                continue
            best[node] = edits
            todo.extend((child, edits + 1) for child in self.children[node].values())
        return frozenset(best.items())

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        closed = self._closed(pairs)
        if closed not in self.states:
            self.states[closed] = len(self.sets)
            self.sets.append(closed)
            self.moves.append({})
            found = [(edits, self.ends[node]) for node, edits in closed if self.ends[node] >= 0 and edits <= edits_for(self.words[self.ends[node]])]
            self.accepts.append(min(found) if found else None)
        return self.states[closed]

    def _step(self, state: int, c: str) -> int:
        after = set()
        for node, edits in self.sets[state]:
            after.add((node, edits + 1))  # a letter too many
            for letter, child in self.children[node].items():
                after.add((child, edits + (letter != c)))
        return self._state(after)

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, number of the lexicon word) of the nearest lexicon word that is near enough."""
        state = self.start
        for c in word:
            c = c if c in self.alphabet else "\0"
            to = self.moves[state].get(c)
            if to is None:
                to = self.moves[state][c] = self._step(state, c)
            state = to
            if not self.sets[state]:
                return None
        return self.accepts[state]


def stripped(token: str) -> str:
    return token.strip(EDGES)


class TokenTable(dict):
    """token -> (edits, lexicon word, weight) or None; starts anew when full."""

    def __init__(self, model: Model):
        super().__init__()
        self.automaton, self.weights, self.clean = Automaton(model.words), model.weights, model.clean

    def __missing__(self, token: str) -> tuple[int, int, float] | None:
        word = stripped(token)
        found = None
        if word:
            m = self.automaton.match(word)
            if m is None and (folded := word.translate(LOOKALIKE)) != word and any(c.isalpha() for c in word):
                m = self.automaton.match(folded)
                m = m and (m[0] + 1, m[1])
            if m is not None and not (m[0] and word in self.clean):
                found = (m[0], m[1], self.weights[m[1]] / (1 + 0.5 * m[0]))
        if len(token) <= LONGEST_KEPT:
            if len(self) >= TOKENS_KEPT:
                self.clear()
            self[token] = found
        return found


def quoted(tokens: list[str], i: int) -> bool:
    """Whether a quotation opens at or shortly before token i and closes at or shortly after it."""
    opens = next((j for j in range(i, max(-1, i - WINDOW - 1), -1) if tokens[j][0] in OPENING), None)
    if opens is None or any(tokens[j][-1] in CLOSING for j in range(opens, i) if len(tokens[j]) > 1):
        return False
    return any(tokens[j].rstrip(".,;:!?")[-1:] in CLOSING and (j > opens or len(tokens[j]) > 1) for j in range(i, min(len(tokens), i + WINDOW + 1)) if tokens[j].rstrip(".,;:!?"))


def describe(text: str, table: TokenTable) -> list[float]:
    """The regression's features of one whole text."""
    tokens = text.lower().split()
    hits = [(i, m) for i, m in enumerate(map(table.__getitem__, tokens)) if m]
    if not hits:
        return [0.0] * (N_FEATURES - 1) + [math.log1p(len(tokens))]
    plain = fuzzy = cited = 0.0
    strengths = []
    for i, (edits, _, weight) in hits:
        about = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
        if quoted(tokens, i):
            share = 0.1 if any(stripped(t) in REPORTING for t in about) else 0.3
            cited += 1
        else:
            share = 1.0
            plain += edits == 0
            fuzzy += edits > 0
        strengths.append(share * weight)
    strongest, a, held = 0.0, 0, 0.0
    for b, (i, _) in enumerate(hits):
        held += strengths[b]
        while hits[a][0] < i - 2 * WINDOW:
            held -= strengths[a]
            a += 1
        strongest = max(strongest, held)
    total = sum(strengths)
    distinct = len({m[1] for _, m in hits})
    return [math.log1p(plain), math.log1p(fuzzy), math.log1p(cited), math.log1p(total), math.log1p(100 * total / len(tokens)), math.log1p(strongest), math.log1p(distinct), float(plain + fuzzy >= 2), math.log1p(len(tokens))]


@dataclass
class Model:
    words: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    clean: frozenset = frozenset()
    coefficients: tuple = (0.0,) * N_FEATURES
    intercept: float = -50.0

    def sent(self, spark: SparkSession) -> tuple[str, Broadcast]:
        """The model as a broadcast, with a name: its words are bounded by the lexicon and the training sample."""
        return uuid.uuid4().hex, spark.sparkContext.broadcast(self)


def _table(name: str, sent: Broadcast) -> TokenTable:
    return held_by_worker("toxicity", name, lambda: TokenTable(sent.value))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[tuple, float]:
    """Logistic regression by Newton's method with a ridge."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    b = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        move = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * b)
        b += move
        if np.abs(move).max() < 1e-8:
            break
    return tuple((b[:-1] / scale).tolist()), float(b[-1] - (b[:-1] * mean / scale).sum())


def learn_lexicon(counts: DataFrame, n_toxic: int, n_clean: int, most: int = LEXICON) -> tuple[list[str], list[float], frozenset]:
    """Words, weights (log odds of their document frequencies) and the clean words near them; counts: (word, toxic, clean) documents."""
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    scored = counts.withColumn("odds", odds).where((F.col("toxic") >= max(4, 0.002 * n_toxic)) & (F.col("odds") >= 2.5) & (F.length("word") >= 3))
    chosen = scored.orderBy(F.desc(F.col("toxic") * F.col("odds")), "word").limit(most).collect()
    words, weights = [r.word for r in chosen], [min(r.odds, 6.0) / 6 for r in chosen]
    known = set(words)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(words)
        for batch in batches:
            yield batch.filter(pa.array([w not in known and automaton.match(w) is not None for w in batch.column(0).to_pylist()], pa.bool_()))

    # words of the sample within two edits of the lexicon
    clean = counts.where("clean > 0").select("word").mapInArrow(near, "word string").collect() if words else []
    return words, weights, frozenset(r.word for r in clean)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model of a bounded sample of the labelled rows, the smallest by a hash of their id."""
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).where("key is not null and y is not null").groupBy("key").agg(F.max("y").alias("y"))
    ids = marked.orderBy(F.xxhash64(F.col("key").cast("string")), "key").limit(sample).withColumn("half", F.xxhash64(F.col("key").cast("string"), F.lit("half")) % 2)
    chosen = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("text is not null").join(F.broadcast(ids), "key")  # ids: `sample` rows at most

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, clean, n = Counter(), Counter(), [0, 0]
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n[y > 0] += 1
                (toxic if y > 0 else clean).update({w for x in t.lower().split() if 0 < len(w := stripped(x)) <= LONGEST_WORD})
            toxic[""], clean[""] = n[1], n[0]
            words = sorted(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()), pa.array([clean[w] for w in words], pa.int64())], names=["word", "toxic", "clean"])

    first = chosen.where("half = 0").select("text", "y").mapInArrow(vocabulary, "word string, toxic long, clean long")
    counts = first.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic + clean >= 2 or word = ''")
    counts = cut(counts, "vocabulary")
    n = counts.where("word = ''").first()
    if n is None or not n.toxic or not n.clean:
        return Model()
    model = Model(*learn_lexicon(counts.where("word <> ''"), n.toxic, n.clean))
    seen = features(chosen.where("half <> 0").select("y", "text"), model).select("y", "features").collect()
    if len({r.y > 0 for r in seen}) == 2:
        order = sorted((tuple(r.features), r.y) for r in seen)
        model.coefficients, model.intercept = fit_logistic(np.array([f for f, _ in order]), np.array([float(y > 0) for _, y in order]))
    return model


def features(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """rows, without their text, with the array of the regression's features."""
    others = [f for f in bounded_batches(rows).schema if f.name not in (text, "features")]
    name, sent = model.sent(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(name, sent)
        for batch in batches:
            for part in sliced(batch, text):
                made = [describe(t or "", table) for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(f.name)) for f in others), pa.array(made, pa.list_(pa.float64()))], names=[*(f.name for f in others), "features"])
        trim()

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "features array<double>"]))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted, n_matches) of each row's whole text."""
    found = features(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), model)
    z = F.lit(model.intercept)
    for i, c in enumerate(model.coefficients):
        z = z + F.lit(c) * F.col("features")[i]
    scored = found.select("key", (F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumnRenamed("key", key)


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose whole text scores below the threshold, with all columns; a null text is clean."""
    (name, sent), i = model.sent(docs.sparkSession), bounded_batches(docs).columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(name, sent)
        weights, intercept = np.array(sent.value.coefficients), sent.value.intercept
        limit = math.log(threshold / (1 - threshold))
        for batch in batches:
            for part in sliced(batch, text):
                rows = np.array([describe(t or "", table) for t in part.column(i).to_pylist()])
                yield part.filter(pa.array(rows @ weights + intercept < limit))
        trim()

    return docs.mapInArrow(run, docs.schema)


def held_out(column, modulus: int = 5, remainder: int = 0):
    return id_remainder(column, modulus) == F.lit(remainder)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Trained on the labelled rows that are not held out, applied to all rows."""
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
