"""Language identification, toxicity and quality: held-out accuracy, and their parts against brute force."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa

from tallyweir.llm import langid, quality, toxicity
from tallyweir.llm.common import flat_utf8
from tests.llm.conftest import SF, documents

BIG = SF.replace("0.001", "0.01")


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.where("lang is not null").collect()}
    got = [r for r in langid.predictions(docs).collect() if r.held_out and r.doc_id in truth]
    assert len(got) > 100 and np.mean([r.lang_pred == truth[r.doc_id] for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_every_document_against_plain_sums(spark):
    """The query's rows from its model, text by text and gram by gram."""
    docs = documents(spark)
    model = langid.train(docs.where(~langid.held_out(docs.doc_id)))

    def bucket(gram):
        h = len(gram) * 0x9E3779B1 % 2**32
        for c in gram:
            h = (h ^ c) * 0x01000193 % 2**32
        return ((h ^ h >> 15) * 0x2C1B3C6D % 2**32) >> 19

    def plain(text):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        folded = bytes(c | 32 if chr(c).isalpha() and c < 128 else c if c >= 128 else 32 for c in text.encode())
        grams = [bucket(folded[i : i + n]) for n in (3, 4) for i in range(len(folded) - n + 1)]
        z = [(sum(float(model.table[g, k]) for g in grams) / max(1, len(grams)) + model.bias[k]) / model.temperature for k in range(len(model.languages))]
        e = [math.exp(x - max(z)) for x in z]
        return max(zip(e, model.languages), key=lambda x: x[0])[1], max(e) / sum(e)

    texts = {r.doc_id: r.text for r in docs.collect()}
    got = langid.predictions(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        language, score = plain(texts[r.doc_id])
        assert r.lang_pred == language and abs(r.score - score) < 1e-6
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_language_needs_letters():
    model = langid.Model(["en"], np.zeros((langid.BUCKETS, 1)), np.zeros(1), 1.0, 0.5)
    assert model.predict(pa.array([None, "", "12 !", "a"]))[0] == ["und", "und", "und", "en"]


def test_subwords_stay_in_their_text():
    texts = ["abcd", "", "xy", "zabcdé"]
    together = langid.histograms(*flat_utf8(pa.array(texts)))
    for t, (buckets, counts) in zip(texts, together):
        alone = langid.histograms(*flat_utf8(pa.array([t])))[0]
        assert buckets.tolist() == alone[0].tolist() and counts.tolist() == alone[1].tolist()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_against_edit_distance():
    rng = random.Random(2)
    words = ["idiot", "moron", "disgusting", "scum", "patheticly"]
    automaton = toxicity.Automaton(words)
    for _ in range(5000):
        w = rng.choice(words)
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcdiotm") + w[i:], w[:i] + rng.choice("xyzio") + w[i + 1 :]])
        near = sorted((distance(w, x), k) for k, x in enumerate(words) if distance(w, x) <= toxicity.edits_for(x))
        assert automaton.match(w) == (near[0] if near else None), w


def test_quotation_counts_less_than_abuse():
    model = toxicity.Model(["idiot", "moron"], [1.0, 1.0])
    table = toxicity.TokenTable(model)
    abuse, cited = toxicity.describe("you are an idiot and a m0ron today", table), toxicity.describe('he wrote "idiot and moron" in the text today', table)
    assert abuse[0] > 0 and abuse[1] > 0 and abuse[2] == 0 and cited[0] == 0 and cited[2] > 0 and cited[3] < abuse[3]


def test_toxicity_of_every_document_against_edit_distances(spark):
    """The query's rows from its model, with each token held against each word of the lexicon."""
    docs, labels = documents(spark), spark.read.parquet(f"{BIG}/labels.parquet")
    big = spark.read.parquet(f"{BIG}/documents.parquet")
    model = toxicity.train(big, labels.where(~toxicity.held_out(labels.doc_id)))
    seen = {}

    def nearest(word):
        near = [(distance(word, x), k) for k, x in enumerate(model.words) if abs(len(x) - len(word)) <= 2]
        return min(((d, k) for d, k in near if d <= toxicity.edits_for(model.words[k])), default=None)

    class Plain(dict):
        def __missing__(self, token):
            if token not in seen:
                word = toxicity.stripped(token)
                m = nearest(word) if word else None
                folded = word.translate(toxicity.LOOKALIKE)
                if word and m is None and folded != word and any(c.isalpha() for c in word):
                    m = nearest(folded)
                    m = m and (m[0] + 1, m[1])
                seen[token] = None if m is None or (m[0] and word in model.clean) else (*m, model.weights[m[1]] / (1 + 0.5 * m[0]))
            return seen[token]

    sample = docs.collect()
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(sample) and any(p for _, p in got.values()) and len(model.words) > 3
    for r in sample:
        z = model.intercept + sum(c * x for c, x in zip(model.coefficients, toxicity.describe(r.text or "", Plain())))
        score = 1 / (1 + math.exp(-z))
        assert abs(got[r.doc_id][0] - score) < 1e-9 and got[r.doc_id][1] == (got[r.doc_id][0] >= 0.5)


def test_long_tokens_are_walked():
    table = toxicity.TokenTable(toxicity.Model(["disgusting" * 5], [1.0]))
    word = "disgusting" * 5
    assert table[word][0] == 0 and table[word[:20] + "x" + word[20:]][0] == 1 and table["y" * 100_000] is None and len(table) == 0


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = [r for r in toxicity.predictions(docs, labels).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in got]) > 0.9
    kept = toxicity.accepted(docs, toxicity.train(docs, labels.where(~toxicity.held_out(labels.doc_id))))
    rejected = {r.doc_id for r in docs.select("doc_id").subtract(kept.select("doc_id")).collect()}
    assert rejected == {r.doc_id for r in toxicity.predictions(docs, labels).where("predicted = 1").collect()} and kept.columns == docs.columns


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = [r for r in quality.predictions(docs, labels).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in got]) > 0.93


def test_quality_of_every_document_against_plain_sums(spark):
    """The query's rows from its model: cosines one by one, and the calibration's lines by hand."""
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    stats = quality.statistics(docs.selectExpr("doc_id as key", "text"))
    marked = labels.selectExpr("doc_id as key", "cast(quality as int) as y").where("y is not null")
    model = quality.train(marked.where(~quality.held_out(marked.key)).join(stats, "key").select("key", "y", "stats"))
    f = model.fourier

    def plain(s):
        z = [min(6.0, max(-6.0, (a - m) / d)) for a, m, d in zip(s, f.mean, f.scale)]
        raw = sum(math.cos(sum(a * f.directions[i, k] for i, a in enumerate(z)) + f.phases[k]) * math.sqrt(2 / f.width) * model.weights[k] for k in range(f.width)) + model.weights[-1]
        if raw <= model.x[0] or raw >= model.x[-1]:
            return float(model.y[0] if raw <= model.x[0] else model.y[-1])
        i = int(np.searchsorted(model.x, raw, "right"))
        return float(model.y[i - 1] + (raw - model.x[i - 1]) * (model.y[i] - model.y[i - 1]) / (model.x[i] - model.x[i - 1]))

    of = {r.key: r.stats for r in stats.collect()}
    got = quality.predictions(docs, labels).collect()
    assert len(got) == len(of)
    for r in got:
        assert abs(r.score - plain(of[r.doc_id])) < 1e-6 and r.predicted == (r.score >= 0.7)


def test_isotonic_is_monotone_and_keeps_sums():
    rng = np.random.default_rng(3)
    x, n = rng.normal(size=200), rng.integers(1, 9, 200)
    p = rng.binomial(n, 1 / (1 + np.exp(-x)))
    bx, by = quality.isotonic(x, p, n)
    assert (np.diff(bx) > 0).all() and (np.diff(by) > 0).all() and 0 <= by[0] and by[-1] <= 1


def test_normal_equations_equal_direct_ridge(spark):
    rng = np.random.default_rng(4)
    stats = rng.normal(size=(300, quality.STATISTICS))
    y = (stats[:, 0] + 0.1 * rng.normal(size=300) > 0).astype(int)
    rows = spark.createDataFrame([(i, int(y[i]), stats[i].tolist()) for i in range(300)], "key long, y int, stats array<double>").repartition(5)
    model = quality.train(rows)
    back = {r.key for r in rows.selectExpr("key", "xxhash64(cast(key as string), 'calibration') % 5 = 0 as b").where("b").collect()}
    k = [i for i in range(300) if i not in back]
    z = model.fourier(stats[k])
    penalty = np.eye(z.shape[1]) * quality.RIDGE
    penalty[-1, -1] = 0
    assert np.allclose(np.linalg.solve(z.T @ z + penalty, z.T @ y[k]), model.weights, atol=1e-6)
    assert documents(spark).count() > 0
