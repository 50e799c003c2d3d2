"""A random forest whose trees are grown side by side: each task has all rows, as one byte for each feature, and grows its trees whole.

A tree is grown level by level on arrays over all rows of the level, so that deep trees of small leaves cost what their rows
cost. Neither rows nor trees come to the driver: rows go to the tasks in blocks, trees stay on the executors' disks, and rows to
be scored go to the trees. The same bins of rows give the same trees, however the rows are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bins of a feature, rows of a block, and rows that a step over nodes takes at once.
BINS, BLOCK, STEP = 256, 4096, 1 << 17
#: From so many rows for each node on, rows are counted into a table of all bins; below, they are sorted.
DENSE = 512
#: Error of the quantiles that bound the bins, as a share of all rows.
QUANTILE_ERROR = 0.0005

PARCELS = "part long, kind int, block string, n int, data binary, payload binary"
TREE, ROWS = 0, 1


# ---- one tree ---------------------------------------------------------------------------------------------------------


def _cells(x, rows, value, bits, sizes, chosen):
    """The bins that rows fall in, by node, chosen feature and bin in order; with how many rows, draws and draws of label 1
    there are up to the end of each, counted over the nodes and features before it too."""
    m, k = chosen.shape
    feature = np.arange(k) * BINS
    dense = len(rows) >= DENSE * m
    if dense:
        count, draws = np.zeros(m * k * BINS, np.int64), np.zeros(2 * m * k * BINS)
    for a in range(0, len(rows), STEP):  # only a single node has more
        r = rows[a : a + STEP]
        node = np.repeat(np.arange(m), sizes) if m > 1 else np.zeros(len(r), np.int64)
        key = x.ravel()[r[:, None] * x.shape[1] + chosen[node]] + (node[:, None] * (k * BINS) + feature)
        v = value[r]
        if dense:
            count += np.bincount(key.ravel(), minlength=len(count))
            draws += np.bincount((key * 2 + (v >> bits)[:, None]).ravel(), np.repeat(v & (1 << bits) - 1, k), len(draws))
    if dense:
        at, draws = np.flatnonzero(count), draws.reshape(-1, 2)
        return at, np.cumsum(count[at]), np.cumsum(draws[at].sum(1)), np.cumsum(draws[at, 1])
    small = m * k * BINS << bits + 1 < 1 << 31
    key = np.sort(((key << bits + 1) + v[:, None]).astype(np.int32 if small else np.int64).ravel())
    cell = key >> bits + 1
    last = np.append(np.flatnonzero(cell[1:] != cell[:-1]), len(cell) - 1)
    drawn = key & (1 << bits) - 1
    return cell[last].astype(np.int64), last + 1, np.cumsum(drawn, dtype=np.int64)[last].astype(float), np.cumsum(drawn * (key >> bits & 1), dtype=np.int64)[last].astype(float)


def _best_of(x, rows, value, bits, sizes, draws, ones, chosen, balance, least):
    """For each node (its rows are a run of `rows`): whether a split was found, its feature, the last bin of its left side, and
    the left side's rows, draws and draws of label 1; and whether all chosen features are constant."""
    m, k = chosen.shape
    at, count, all_, one = _cells(x, rows, value, bits, sizes, chosen)
    segment = at // BINS
    node = segment // k
    within = segment - node * k
    before = lambda totals: k * (np.cumsum(totals) - totals)[node] + within * totals[node]
    count, all_, one = count - before(sizes), all_ - before(draws), one - before(ones)
    good = (count >= least) & (sizes[node] - count >= least)
    left_1, left_0 = one * balance[1], (all_ - one) * balance[0]
    right_1, right_0 = ones[node] * balance[1] - left_1, (draws - ones)[node] * balance[0] - left_0
    with np.errstate(divide="ignore", invalid="ignore"):  # the sum that is greatest where the Gini impurity is least
        score = np.where(good, (left_0**2 + left_1**2) / (left_0 + left_1) + (right_0**2 + right_1**2) / (right_0 + right_1), -1.0)
    first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    cells = np.diff(np.append(first, len(node)))
    top = np.maximum.reduceat(score, first)
    best = np.flatnonzero(score == np.repeat(top, cells))
    best = best[np.append(True, node[best[1:]] != node[best[:-1]])]
    after = np.minimum(best + 1, len(at) - 1)
    return top >= 0, chosen[np.arange(m), within[best]], (at[best] % BINS + at[after] % BINS - 1) // 2, count[best], all_[best], one[best], cells == k


def _splits(x, rows, value, bits, sizes, draws, ones, order, k, balance, least):
    """The best splits over the first k features of each node's order; further ones where all of these are constant."""
    m, d = order.shape
    out = [np.zeros(m, t) for t in (bool, np.int64, np.int64, np.int64, float, float)]
    ends = np.cumsum(sizes)
    for s, e in _runs(ends):
        todo, a = np.arange(s, e), ends[s] - sizes[s]
        r = rows[a : ends[e - 1]]
        for g in range(0, d, k):
            *found, constant = _best_of(x, r, value, bits, sizes[todo], draws[todo], ones[todo], order[todo, g : g + k], balance, least)
            for o, f in zip(out, found):
                o[todo] = f
            if not constant.any():
                break
            r, todo = r[np.repeat(constant, sizes[todo])], todo[constant]
    return out


def _runs(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of nodes that have STEP rows together at most, or one node."""
    s = 0
    while s < len(ends):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + STEP, "right")))
        yield s, e
        s = e


def grow(x: np.ndarray, label: np.ndarray, rng: np.random.Generator, depth: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree on a bootstrap sample of rows of bins: each node's feature (-1: a leaf), last bin of the left side, and left child
    (the right one follows it) or, in a leaf, the probability of label 1 as the bits of a float.

    Both labels weigh the same in the sample. A node has `least` different rows at least; each split looks at the root of the
    number of features, and at further ones while those are constant.
    """
    n, d = x.shape
    k = max(1, int(d**0.5))
    drawn = np.bincount(rng.integers(0, n, n), minlength=n)
    bits = int(drawn.max()).bit_length()
    value = drawn + (label.astype(np.int64) << bits)
    rows = np.flatnonzero(drawn)
    sizes, draws, ones = np.array([len(rows)]), np.array([float(n)]), np.array([float(drawn[label == 1].sum())])
    balance = (n / (2 * max(1.0, n - ones[0])), n / (2 * max(1.0, ones[0])))
    tree, nodes, level = [], 1, 0
    while True:
        one = ones * balance[1]
        feature, cut, link = np.full(len(sizes), -1, np.int16), np.zeros(len(sizes), np.uint8), (one / (one + (draws - ones) * balance[0])).astype(np.float32).view(np.int32)
        tree.append((feature, cut, link))
        splits = (ones > 0) & (ones < draws) & (sizes >= 2 * least) & (level < depth)
        if splits.any():
            rows = rows[np.repeat(splits, sizes)]
            order = rng.random((int(splits.sum()), d), np.float32).argsort(1)
            found, *best = _splits(x, rows, value, bits, sizes[splits], draws[splits], ones[splits], order, k, balance, least)
            rows = rows[np.repeat(found, sizes[splits])]
            splits[splits] = found
            best = [b[found] for b in best]
        if not splits.any():
            return tuple(np.concatenate(part) for part in zip(*tree))
        feature[splits], cut[splits], left = best[0], best[1], best[2]
        link[splits] = nodes + 2 * np.arange(len(left))
        size = sizes[splits]
        begin, node = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
        goes = x.ravel()[rows * d + best[0][node]] <= best[1][node]
        lefts = np.cumsum(goes) - goes  # of the rows before
        lefts -= lefts[begin][node]
        place = begin[node] + np.where(goes, lefts, left[node] + np.arange(len(rows)) - begin[node] - lefts)
        moved = np.empty_like(rows)
        moved[place] = rows
        both = lambda of_left, of_all: np.stack([of_left, of_all - of_left], 1).ravel()
        rows, sizes, draws, ones = moved, both(left, size), both(best[3], draws[splits]), both(best[4], ones[splits])
        nodes, level = nodes + len(sizes), level + 1


def probabilities(tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The probability of label 1 that a tree gives to rows of bins."""
    feature, cut, link = tree
    node, live = np.zeros(len(x), np.int64), np.arange(len(x))
    while True:
        f = feature[node[live]]
        live, f = live[f >= 0], f[f >= 0]
        if not len(live):
            return link[node].view(np.float32).astype(float)
        at = node[live]
        node[live] = link[at] + (x[live, f] > cut[at])


def _packed(tree) -> bytes:
    return b"".join(part.tobytes() for part in tree)


def _unpacked(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(data, np.int16, n), np.frombuffer(data, np.uint8, n, 2 * n), np.frombuffer(data, np.int32, n, 3 * n)


# ---- rows and trees in tasks --------------------------------------------------------------------------------------------


def _bins(lists: pa.Array, bounds: list[np.ndarray]) -> np.ndarray:
    values = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), len(bounds))
    return np.stack([np.searchsorted(b, values[:, i]) for i, b in enumerate(bounds)], 1).astype(np.uint8)


def _parcel(**columns) -> pa.RecordBatch:
    types = {"part": pa.int64(), "kind": pa.int32(), "block": pa.string(), "n": pa.int32(), "data": pa.binary(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([columns.get(c)], t) for c, t in types.items()], names=list(types))


def _blocks(bounds: list[np.ndarray], features: str, label: str | None):
    """Rows as blocks of bins: with the label as their last byte, or, without a label, with the rows themselves as payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(a, BLOCK)
                data, payload = _bins(rows.column(rows.schema.get_field_index(features)), bounds), None
                if label:
                    data = np.column_stack([data, rows.column(rows.schema.get_field_index(label)).to_numpy(zero_copy_only=False) == 1]).astype(np.uint8)
                else:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, rows.schema) as writer:
                        writer.write_batch(rows)
                    payload = sink.getvalue().to_pybytes()
                no += 1
                name = f"{task}-{no}-{hashlib.blake2b(payload or b'', digest_size=8).hexdigest()}"
                yield _parcel(part=no + task, kind=ROWS, block=name, n=rows.num_rows, data=data.tobytes(), payload=payload)

    return run


def _in_order(rows: np.ndarray) -> np.ndarray:
    """rows sorted, so that their order does not depend on how they came."""
    words = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    words[:, : rows.shape[1]] = rows
    return rows[np.lexsort(words.view(np.uint64).T)]


def _growers(parts: list[int], trees: int, d: int, depth: int, least: int, seed: int):
    """Trees of the parts that a task is given. Each part has all blocks, so those of one are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, blocks = {}, []
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(4)):
                if mine.setdefault(part, not mine):
                    blocks.append(np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, d + 1).copy())
        if not blocks:
            return
        rows = np.concatenate(blocks)
        blocks.clear()
        rows = _in_order(rows)
        x, label = np.ascontiguousarray(rows[:, :d]), rows[:, d].copy()
        del rows
        for part in sorted(mine):
            for t in range(parts.index(part), trees, len(parts)):
                tree = grow(x, label, np.random.default_rng([seed, t]), depth, least)
                yield _parcel(part=part, kind=TREE, block=str(t), n=len(tree[0]), data=_packed(tree))

    return run


def _scorers(d: int):
    """Sums over a part's trees for each block; the trees of a part come before its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, trees = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != at:
                    at, trees = r["part"], []
                if r["kind"] == TREE:
                    trees.append(_unpacked(r["n"], r["data"]))
                else:
                    x, total = np.frombuffer(r["data"], np.uint8).reshape(-1, d), np.zeros(r["n"])
                    for tree in trees:
                        total += probabilities(tree, x)
                    yield _parcel(part=at, kind=len(trees), block=r["block"], n=r["n"], data=total.tobytes(), payload=r["payload"])

    return run


def _joined(trees: int, name: str):
    """The rows of a block with the mean over all trees, under a name."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")  # sums of floats depend on their order
        if sum(group["kind"].to_pylist()) != trees:
            raise RuntimeError("rows came to other blocks when a stage was run again")
        total = np.sum([np.frombuffer(b, float) for b in group["data"].to_pylist()], axis=0)
        payload = next(p for p in group["payload"].to_pylist() if p is not None)
        rows = pa.ipc.open_stream(payload).read_all()
        return pa.Table.from_arrays([*rows.columns, pa.chunked_array([pa.array(total / trees)])], names=[*rows.column_names, name])

    return run


def _parts(spark: SparkSession, trees: int) -> list[int]:
    """Names of parts, of which each falls in a partition of its own: three for each core, 24 at least, one for each tree at most."""
    n = min(trees, max(24, 3 * spark.sparkContext.defaultParallelism))
    found = spark.range(0, 64 * n, 1, 1).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("at")).agg(F.min("id").alias("id")).collect()
    return sorted(r.id for r in found)


class _Forest(HasFeaturesCol, HasLabelCol, HasSeed):
    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "greatest depth of a tree", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "different rows that a node has at least", TypeConverters.toInt)

    def getNumTrees(self) -> int:
        return self.getOrDefault(self.numTrees)

    def getMaxDepth(self) -> int:
        return self.getOrDefault(self.maxDepth)

    def getMinInstancesPerNode(self) -> int:
        return self.getOrDefault(self.minInstancesPerNode)


class Forest(Estimator, _Forest, DefaultParamsReadable, DefaultParamsWritable):
    """Fits a ForestModel to labels 0 and 1, which weigh the same in each tree's sample."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", numTrees=400, maxDepth=30, minInstancesPerNode=2, seed=7):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(featuresCol="features", labelCol="label", numTrees=400, maxDepth=30, minInstancesPerNode=2, seed=7)

    def _fit(self, rows: DataFrame) -> ForestModel:
        spark, column = rows.sparkSession, self.getFeaturesCol()
        r = rows.select(vector_to_array(column).alias("x"), F.col(self.getLabelCol()).cast("int").alias("y"))
        first = r.first()
        if first is None:
            raise ValueError("no rows to learn from")
        d = len(first.x)
        names = [f"x{i}" for i in range(d)]
        quantiles = r.select(*[F.col("x")[i].alias(c) for i, c in enumerate(names)]).approxQuantile(names, [i / BINS for i in range(1, BINS)], QUANTILE_ERROR)
        bounds = [np.unique(q) for q in quantiles]
        parts = _parts(spark, self.getNumTrees())
        blocks = r.mapInArrow(_blocks(bounds, "x", "y"), PARCELS).withColumn("part", F.explode(F.array(*[F.lit(p).cast("long") for p in parts])))
        grown = blocks.repartition(len(parts), "part").mapInArrow(_growers(parts, self.getNumTrees(), d, self.getMaxDepth(), self.getMinInstancesPerNode(), self.getSeed()), PARCELS)
        trees = grown.persist(StorageLevel.DISK_ONLY)
        if trees.count() != self.getNumTrees():
            raise RuntimeError("not all trees were grown")
        return self._copyValues(ForestModel(trees, bounds))


class ForestModel(Model, _Forest, MLWritable, MLReadable):
    """Trees (PARCELS) and the bounds of bins; `probability` is the mean over all trees. The trees are kept while the session lasts."""

    def __init__(self, trees: DataFrame | None = None, bounds: list[np.ndarray] | None = None):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", numTrees=400, maxDepth=30, minInstancesPerNode=2, seed=7)
        self.trees, self.bounds = trees, bounds

    def _transform(self, rows: DataFrame) -> DataFrame:
        column, schema = self.getFeaturesCol(), rows.schema
        plain = rows.withColumn(column, vector_to_array(column))
        parts = sorted(r.part for r in self.trees.select("part").distinct().collect())
        # a block goes to all parts, its rows to one
        sent = plain.mapInArrow(_blocks(self.bounds, column, None), PARCELS).withColumn("home", F.pmod("part", F.lit(len(parts))))
        sent = sent.select("*", F.posexplode(F.array(*[F.lit(p).cast("long") for p in parts])).alias("no", "to"))
        blocks = sent.select(F.col("to").alias("part"), "kind", "block", "n", "data", F.when(F.col("no") == F.col("home"), F.col("payload")).alias("payload"))
        met = self.trees.unionByName(blocks).repartition(len(parts), "part").sortWithinPartitions("part", "kind")
        sums = met.mapInArrow(_scorers(len(self.bounds)), PARCELS)
        out = T.StructType([*plain.schema.fields, T.StructField("p_1", T.DoubleType())])
        scored = sums.groupBy("block").applyInArrow(_joined(self.getNumTrees(), "p_1"), out)
        return scored.select(*[array_to_vector(f.name).alias(f.name) if f.name == column else f.name for f in schema.fields], array_to_vector(F.array(1 - F.col("p_1"), "p_1")).alias("probability"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"bounds": [b.tolist() for b in self.model.bounds]})
        self.model.trees.write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> ForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(self.sparkSession.read.parquet(f"{path}/trees"), [np.array(b) for b in metadata["bounds"]])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
