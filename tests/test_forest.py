"""The forest: trees against a plain search of splits, and what fitting costs and gives however rows are dealt."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweir.operators import features, forest, learning
from tallyweir.schema import KEY


def plain(values, label, drawn, depth, least, weights):
    """The leaves of a tree on one feature: (rows, probability), by trying each split of each node."""
    ones = sum(d for d, y in zip(drawn, label) if y)
    a, b = (sum(drawn) - ones) * weights[0], ones * weights[1]
    best = (-1, 0)
    if a and b and depth and len(values) >= 2 * least:
        for cut in sorted(set(values))[:-1]:
            left = [v <= cut for v in values]
            if min(sum(left), len(left) - sum(left)) >= least:
                l1 = sum(d for d, y, w in zip(drawn, label, left) if y and w) * weights[1]
                l0 = sum(d for d, y, w in zip(drawn, label, left) if not y and w) * weights[0]
                r0, r1 = a - l0, b - l1
                score = (l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1)
                if score > best[0]:
                    best = (score, cut)
    if best[0] < 0:
        return [(tuple(sorted(values)), b / (a + b))]
    side = lambda s: [[x for x, v in zip(xs, values) if (v <= best[1]) == s] for xs in (values, label, drawn)]
    return plain(*side(True), depth - 1, least, weights) + plain(*side(False), depth - 1, least, weights)


@pytest.mark.parametrize("n, bins, depth, least", [(9, 5, 30, 2), (60, 20, 30, 1), (700, 200, 30, 2), (1500, 256, 4, 3), (300, 1, 30, 2)])
def test_a_tree_is_that_of_a_plain_search(n, bins, depth, least):
    rng = np.random.default_rng(n)
    x = rng.integers(0, bins, (n, 1)).astype(np.uint8)
    y = (rng.random(n) < x[:, 0] / bins).astype(np.uint8)
    y[:2] = 0, 1
    feature, cut, link = forest.grow(x, y, np.random.default_rng(5), depth, least)
    drawn = np.bincount(np.random.default_rng(5).integers(0, n, n), minlength=n)
    ones, r = drawn[y == 1].sum(), np.flatnonzero(drawn)
    want = plain(x[r, 0].tolist(), y[r].tolist(), drawn[r].tolist(), depth, least, (n / (2 * (n - ones)), n / (2 * ones)))
    leaf = np.zeros(n, int)
    while (feature[leaf] >= 0).any():
        leaf = np.where(feature[leaf] >= 0, link[leaf] + (x[:, 0] > cut[leaf]), leaf)
    got = [(tuple(sorted(x[r][leaf[r] == i, 0].tolist())), float(link[i : i + 1].view(np.float32)[0])) for i in np.flatnonzero(feature < 0)]
    assert sorted(got) == [(v, pytest.approx(p, abs=1e-6)) for v, p in sorted(want)]
    assert forest.probabilities((feature, cut, link), x).tolist() == link[leaf].view(np.float32).tolist()


def test_large_nodes_are_counted_as_small_ones(monkeypatch):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 256, (3000, 9)).astype(np.uint8), rng.integers(0, 2, 3000).astype(np.uint8)
    x[:, :6] = 7  # constant: further features are looked at
    grown = []
    for dense, step in ((512, 1 << 17), (1, 1 << 17), (1 << 40, 1 << 17), (512, 600)):
        monkeypatch.setattr(forest, "DENSE", dense)
        monkeypatch.setattr(forest, "STEP", step)
        grown.append(forest.grow(x, y, np.random.default_rng(1), 30, 2))
    assert len(grown[0][0]) > 500 and set(grown[0][0]) == {-1, 6, 7, 8}
    assert all((a == b).all() for g in grown[1:] for a, b in zip(g, grown[0]))


def rows(spark, n=400):
    rng = random.Random(8)
    names = features.feature_names(3)
    made = [(1, 1, i, 1, 17, *[rng.random() + (y if j % 5 == 0 else 0) / 2 for j in range(len(names))], y) for i in range(n) for y in [int(rng.random() < 0.3)]]
    return spark.createDataFrame(made, ", ".join(["ip1 long, port1 int, ip2 long, port2 int, proto int", *[f"{c} double" for c in names], "label int"]))


def test_a_forest_takes_few_jobs_and_is_the_same_however_rows_are_dealt(spark):
    data = rows(spark)
    spark.sparkContext.setJobGroup("forest", "")
    try:
        model = learning.train(data, learning.forest(3, 30))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("forest"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 14  # a job for each level took more than depth alone
    got = {r.ip2: r.p for r in learning.score(model, data).collect()}
    again = learning.score(learning.train(data.repartition(7), learning.forest(3, 30)), data.repartition(5))
    assert {r.ip2: r.p for r in again.collect()} == got and len(got) == 400


def test_a_forest_scores_rows_it_has_not_seen_and_is_saved(spark, tmp_path):
    data = rows(spark, 1200)
    held = F.col("ip2") % 3 == 0
    model = learning.train(data.where(~held), learning.forest(3, 40))
    scored = learning.score(model, data.where(held).unionByName(data.where("ip2 = 3")))  # equal rows stay
    assert learning.report(scored).first().roc_auc > 0.8
    assert scored.columns == [*KEY, "label", "p"] and scored.count() == 401 and scored.where("ip2 = 3").count() == 2
    learning.save(model, str(tmp_path / "m"), 3)
    rows_of = lambda s: sorted(map(tuple, s.collect()))
    assert rows_of(learning.score(learning.load(str(tmp_path / "m")), data.where(held).unionByName(data.where("ip2 = 3")))) == rows_of(scored)
    assert learning.score(model, data.where("false")).count() == 0
    with pytest.raises(ValueError):
        learning.train(data.where("false"), learning.forest(3, 4))
    alone = learning.score(learning.train(data.where("label = 0"), learning.forest(3, 4)), data)
    assert alone.where("p = 0").count() == 1200
