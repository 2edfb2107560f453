"""Gradient boosting for squared error, grown from histograms (M6, M7).

``GBTRegressor`` of ``pyspark.ml`` finds every level of every tree in passes over
row objects. Here the same trees grow from blocks of rows: a feature's value is kept
as the number of its bin, a byte each, and numpy adds up count and residual by node
and bin. Small features share one histogram, from which their own are summed. The
bins, the candidates, the gain and the rules by which a node ends are MLlib's, and so
is the fitted ``GBTRegressionModel``; equal gains go to the first feature and bin.

What a level hands to the driver is one histogram per partition, of a size that
depends on the nodes of the level and the bins. Predictions so far are kept beside
the blocks and cut from their lineage as ``checkpointInterval`` says.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel, GBTRegressor
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.files import delete_path, scratch_path

BLOCK_ROWS = 32_768
# Rows from which on blocks are made: with fewer, the jobs of a tree take longer to
# start than MLlib's passes take.
ROWS_IN_BLOCKS = 1_000_000
# Features share a histogram while its cells, over all nodes of a level, stay in a
# processor's cache.
JOINT_CELLS = 4_096
# Partitions of the blocks, as a multiple of the tasks that run at once.
WAVES = 2
EPSILON = float(np.finfo(float).eps)
# Gains as close as this differ by rounding alone.
SAME_GAIN = 1e-11
KEPT = StorageLevel.MEMORY_AND_DISK


class BlockGBTRegressor(GBTRegressor):
    """A ``GBTRegressor`` that fits the same trees from blocks of rows. Few rows, and
    settings that sample rows or features, weigh rows or watch a validation set, other
    losses and nominal features are fitted by MLlib."""

    def _fit(self, dataset: DataFrame) -> GBTRegressionModel:
        model = _boosted(self, dataset) if _supported(self, dataset) else None
        return model or super()._fit(dataset)


def _supported(est: GBTRegressor, df: DataFrame) -> bool:
    kinds = df.schema[est.getFeaturesCol()].metadata.get("ml_attr", {}).get("attrs", {})
    return (est.getLossType() == "squared" and est.getSubsamplingRate() == 1.0 and est.getFeatureSubsetStrategy() == "all"
            and not est.isDefined(est.validationIndicatorCol) and not est.isDefined(est.weightCol)
            and est.getMinWeightFractionPerNode() == 0.0 and est.getMaxBins() <= 65_536 and set(kinds) <= {"numeric"})


# ------------------------------------------------------------------ bins

def candidate_splits(values: np.ndarray, share: float, rows: int, most: int) -> np.ndarray:
    """MLlib's thresholds of one feature from the values of a sample: between all
    distinct values, or ``most`` of about equal distance in rows. As there, zeros are
    what the sample, at its expected size, lacks of other values."""
    found, counts = np.unique(values[values != 0.0], return_counts=True)
    if not len(found):
        return np.empty(0)
    counts = counts.astype(float)
    expected, n = share * rows, counts.sum()
    if expected - n > EPSILON * n * 100:
        at = np.searchsorted(found, 0.0)
        found, counts = np.insert(found, at, 0.0), np.insert(counts, at, expected - n)
    middle = (found[:-1] + found[1:]) / 2.0
    if len(middle) <= most:
        return middle
    stride = expected / (most + 1)
    chosen, target, before = [], stride, counts[0]
    for i, after in enumerate(before + np.cumsum(counts[1:])):
        if abs(before - target) < abs(after - target):
            chosen.append(middle[i])
            target += stride
        before = after
    return np.array(chosen)


def _thresholds(est: GBTRegressor, rows: DataFrame, n: int, width: int) -> list[np.ndarray]:
    """Thresholds per feature, from the sample of rows that MLlib draws (at most about
    ``maxBins`` squared, or 10,000)."""
    spark, bins = rows.sparkSession, min(est.getMaxBins(), n)
    share = min(1.0, max(bins * bins, 10_000) / n)
    drawn = rows.select("features")
    if share < 1.0:
        seed = spark._jvm.org.apache.spark.util.random.XORShiftRandom(est.getSeed()).nextInt()
        sample = drawn._jdf.javaRDD().sample(False, share, seed)
        drawn = DataFrame(spark._jsparkSession.createDataFrame(sample, drawn._jdf.schema()), spark)
    parts = drawn.select(vector_to_array("features").alias("v")).toArrow().column(0).chunks    # the sample
    values = np.concatenate([c.flatten().to_numpy().reshape(-1, width) for c in parts if len(c)] or [np.empty((0, width))])
    return [candidate_splits(values[:, i], share, n, bins - 1) for i in range(width)]


def _joint(sizes: list[int], n_open: int) -> list[list[int]]:
    """Features that share a histogram of so many nodes; a feature without a split has none."""
    groups: list[tuple[int, list[int]]] = []
    for f in sorted((f for f, s in enumerate(sizes) if s > 1), key=lambda f: -sizes[f]):
        for i, (size, members) in enumerate(groups):
            if size * sizes[f] * n_open <= JOINT_CELLS:
                groups[i] = (size * sizes[f], [*members, f])
                break
        else:
            groups.append((sizes[f], [f]))
    return [members for _, members in groups]


def _blocks(rows: DataFrame, thresholds: list[np.ndarray], width: int) -> RDD:
    """RDD of (codes by feature and row, labels)."""
    kind = np.uint8 if all(len(t) < 256 for t in thresholds) else np.uint16

    def pack(batches):
        held, size = [], 0

        def block():
            values = np.concatenate([v for v, _ in held])
            codes = np.stack([np.searchsorted(t, values[:, i]).astype(kind) for i, t in enumerate(thresholds)])
            return pa.RecordBatch.from_arrays(
                [pa.array([codes.tobytes()], pa.binary()), pa.array([np.concatenate([y for _, y in held]).tobytes()], pa.binary())],
                names=["codes", "labels"])

        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            held.append((values, batch.column(1).to_numpy(zero_copy_only=False)))
            size += batch.num_rows
            if size >= BLOCK_ROWS:
                yield block()
                held, size = [], 0
        if held:
            yield block()

    tasks = rows.sparkSession.sparkContext.defaultParallelism
    found = rows.rdd.getNumPartitions()
    packed = rows.select(vector_to_array("features").alias("v"), "label").mapInArrow(pack, "codes binary, labels binary")
    if found < tasks:
        packed = packed.repartition(tasks)
    elif found > WAVES * tasks:
        packed = packed.coalesce(WAVES * tasks)
    blocks = packed.rdd.map(lambda r: (np.frombuffer(r[0], kind).reshape(width, -1), np.frombuffer(r[1])))
    return _one_by_one(blocks)


def _one_by_one(rdd: RDD) -> RDD:
    """Elements are blocks: each is written by itself, and two such RDDs can be zipped."""
    return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1))


# ------------------------------------------------------------------ trees

@dataclass
class Node:
    count: float
    total: float
    squares: float = 0.0
    gain: float = -1.0
    feature: int = -1
    cut: int = -1
    left: Node | None = None
    right: Node | None = None

    @property
    def prediction(self) -> float:
        return self.total / self.count

    @property
    def impurity(self) -> float:
        return (self.squares - self.total * self.total / self.count) / self.count

    @property
    def leaf(self) -> bool:
        return self.left is None


@dataclass
class Tree:
    """Levels as rows walk them: (place, feature, cut) of the nodes that split there,
    and for twice the place, plus one to the right, the place on the next level."""
    root: Node
    levels: list = field(default_factory=list)
    ends: list = field(default_factory=list)     # nodes by place after the last level

    def values(self) -> np.ndarray:
        return np.array([x.prediction for x in self.ends])


def _walk(codes: np.ndarray, levels: list) -> np.ndarray:
    """The place of every row after the levels."""
    place = np.zeros(codes.shape[1], np.uint8)
    here, beyond = np.empty(len(place), bool), np.empty(len(place), bool)
    for splits, following in levels:
        right = np.zeros(len(place), bool)
        for k, f, cut in splits:
            np.equal(place, k, out=here), np.greater(codes[f], cut, out=beyond)
            np.logical_and(here, beyond, out=here), np.logical_or(right, here, out=right)
        at = place.astype(np.intp)
        at += at
        at += right
        place = following.take(at)
    return place


def _residuals(labels: np.ndarray, so_far) -> np.ndarray:
    return labels if so_far is None else 2.0 * (labels - so_far)


def _level_sums(pairs, levels: list, n_open: int, sizes: list[int]):
    """Of one partition: by node of a level (count, sum, sum of squares) of the
    residuals, by node and bin, feature after feature, their count and sum, and of the
    tree before what :func:`_advance` says of its last nodes."""
    starts = np.cumsum([0, *sizes])
    nodes, ends = np.zeros((n_open, 3)), 0.0
    groups = _joint(sizes, n_open)
    cells = [(n_open + 1) * int(np.prod([sizes[f] for f in members])) for members in groups]
    joint = [(np.zeros(k), np.zeros(k)) for k in cells]
    for (codes, labels), state in pairs:
        r = _residuals(labels, None if state is None else state[0])
        ends = ends + (0.0 if state is None else state[1])
        place = np.minimum(_walk(codes, levels), n_open).astype(np.intp)     # rows of ended nodes come last
        for i, w in enumerate((None, r, r * r)):
            nodes[:, i] += np.bincount(place, w, n_open + 1)[:n_open]
        for members, k, both in zip(groups, cells, joint):
            at = np.zeros_like(place)
            for base, f in zip((place, *[at] * len(members)), members):
                np.multiply(base, sizes[f], out=at), np.add(at, codes[f], out=at)
            for out, w in zip(both, (None, r)):
                out += np.bincount(at, w, k)
    own = [np.zeros((n_open, starts[-1])) for _ in range(2)]
    for members, both in zip(groups, joint):
        for out, found in zip(own, both):
            found = found.reshape(n_open + 1, *[sizes[f] for f in members])[:n_open]
            for i, f in enumerate(members):
                others = tuple(j + 1 for j in range(len(members)) if j != i)
                out[:, starts[f]:starts[f + 1]] = found.sum(axis=others) if others else found
    yield nodes, *own, ends


def best_splits(nodes: np.ndarray, counts: np.ndarray, sums: np.ndarray, sizes: list[int], least: int, floor: float):
    """Per node (gain, feature, cut, count and sum to the left); gain -1: none."""
    starts = np.cumsum([0, *sizes])
    n, total = nodes[:, :1], nodes[:, 1:2]
    gains, where, lefts = [], [], []
    for f, size in enumerate(sizes):
        if size < 2:
            continue
        nl = np.cumsum(counts[:, starts[f]:starts[f + 1]], axis=1)[:, :-1]
        sl = np.cumsum(sums[:, starts[f]:starts[f + 1]], axis=1)[:, :-1]
        nr = n - nl
        with np.errstate(divide="ignore", invalid="ignore"):
            left, right = sl / nl, (total - sl) / nr
            gap = np.where(np.abs(left - right) <= 8 * EPSILON * (np.abs(left) + np.abs(right)), 0.0, left - right)
            gain = (nl / n) * (nr / n) * gap * gap       # variance less the weighted variances of the sides
        gains.append(np.where((nl >= least) & (nr >= least) & (gain >= floor), gain, -1.0))
        where += [(f, cut) for cut in range(size - 1)]
        lefts.append(np.stack([nl, sl]))
    if not gains:
        return [(-1.0, -1, -1, 0.0, 0.0)] * len(nodes)
    gains, lefts = np.concatenate(gains, axis=1), np.concatenate(lefts, axis=2)
    out = []
    for i, row in enumerate(gains):
        j = int(np.argmax(row >= row.max() * (1 - SAME_GAIN))) if row.max() > 0 else int(np.argmax(row))
        out.append((float(row[j]), *where[j], float(lefts[0, i, j]), float(lefts[1, i, j])))
    return out


def _grow(est: GBTRegressor, pairs: RDD, sizes: list[int], before: Tree | None) -> Tree:
    """The next tree; the last nodes of the one before get their sums of squares."""
    depth, least, floor = est.getMaxDepth(), max(1, est.getMinInstancesPerNode()), est.getMinInfoGain()
    tree, frontier, n_open = None, [], 1
    for level in range(max(1, depth)):
        levels = tree.levels if tree else []
        parts = pairs.mapPartitions(lambda it: _level_sums(it, levels, n_open, sizes)).collect()
        nodes, counts, sums, ends = (sum(x) for x in zip(*parts))
        if tree is None:
            _complete(before, ends)
            tree = Tree(Node(*nodes[0]))
            frontier = [tree.root]
        for node, (_, _, squares) in zip(frontier, nodes):
            node.squares = float(squares)
        splits, opened, ended, follow = [], [], list(range(n_open, len(frontier))), {}
        for k, (gain, f, cut, count, total) in enumerate(best_splits(nodes, counts, sums, sizes, least, floor)):
            node = frontier[k]
            if gain <= 0 or depth == 0 or abs(node.impurity) < EPSILON:
                ended.append(k)
                continue
            node.gain, node.feature, node.cut = gain, f, cut
            node.left, node.right = Node(count, total), Node(node.count - count, node.total - total)
            splits.append((k, f, cut))
            opened += [(2 * k, node.left), (2 * k + 1, node.right)]
        if not splits:
            break
        after = [x for _, x in opened] + [frontier[k] for k in ended]
        following = np.zeros(2 * len(frontier), np.min_scalar_type(len(after)))
        for i, (at, _) in enumerate(opened):
            following[at] = i
        for i, k in enumerate(ended, len(opened)):
            following[2 * k] = following[2 * k + 1] = i
        tree.levels.append((splits, following))
        frontier, n_open = after, len(opened)
    tree.ends = frontier
    return tree


def _complete(tree: Tree | None, ends) -> None:
    for node, squares in zip(tree.ends, ends[2]) if tree else ():
        node.squares = float(squares)


def _advance(pairs, levels: list, values: np.ndarray, weight: float):
    """The predictions with one more tree, and by its last nodes the count, sum and
    sum of squares of the residuals that it was grown on."""
    for (codes, labels), state in pairs:
        so_far = None if state is None else state[0]
        r = _residuals(labels, so_far)
        at = _walk(codes, levels).astype(np.intp)
        stats = np.stack([np.bincount(at, w, len(values)) for w in (None, r, r * r)])
        step = values.take(at) * weight
        yield (step if so_far is None else so_far + step), stats


def _boosted(est: BlockGBTRegressor, dataset: DataFrame) -> GBTRegressionModel | None:
    """None: too few rows, or rows that MLlib refuses."""
    spark = dataset.sparkSession
    ensure_checkpoint_dir(spark)
    rows = dataset.select(F.col(est.getFeaturesCol()).alias("features"), F.col(est.getLabelCol()).cast("double").alias("label"))
    n = rows.count()
    if n < max(1, ROWS_IN_BLOCKS):
        return None
    width = rows.select("features").first()["features"].size
    finite = lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))  # noqa: E731  not of NaN, the largest
    whole = finite(F.col("label")) & F.coalesce(F.forall(vector_to_array("features"), finite), F.lit(False))
    if rows.where(~whole).limit(1).count():
        return None
    thresholds = _thresholds(est, rows, n, width)
    sizes = [len(t) + 1 for t in thresholds]
    blocks = _blocks(rows, thresholds, width).persist(KEPT)
    trees, weights, state, old, saved, every = [], [], None, None, [], est.getCheckpointInterval()
    try:
        for m in range(est.getMaxIter()):
            pairs = blocks.map(lambda block: (block, None)) if state is None else blocks.zip(state)
            tree = _grow(est, pairs, sizes, trees[-1] if trees else None)    # its first job makes the state
            if old is not None:
                old.unpersist()
            while len(saved) > 1:
                delete_path(spark, saved.pop(0).getCheckpointFile())
            trees.append(tree)
            weights.append(1.0 if m == 0 else est.getStepSize())
            levels, values, weight = tree.levels, tree.values(), weights[-1]
            old, state = state, _one_by_one(pairs.mapPartitions(lambda it: _advance(it, levels, values, weight))).persist(KEPT)
            if every > 0 and (m + 1) % every == 0:
                state.checkpoint()
                saved.append(state)
        _complete(trees[-1], state.map(lambda x: x[1]).treeReduce(lambda a, b: a + b))
        return _model(est, spark, trees, weights, thresholds, width)
    finally:
        for rdd in (blocks, old, state):
            if rdd is not None:
                rdd.unpersist()
        for path in filter(None, (rdd.getCheckpointFile() for rdd in saved)):
            delete_path(spark, path)


# ------------------------------------------------------------------ MLlib's model

def _listed(node: Node, thresholds: list[np.ndarray], out: list) -> int:
    """Rows of MLlib's node table, a node before its children; its place. Leaves of
    one parent with the same prediction are that parent, as there."""
    _pruned(node)
    at = len(out)
    stats = [float(node.count), float(node.total), float(node.squares)]
    own = [at, float(node.prediction), float(node.impurity), stats, int(node.count)]
    out.append(None)
    if node.leaf:
        out[at] = (*own, -1.0, -1, -1, (-1, [], -1))
    else:
        left = _listed(node.left, thresholds, out)
        right = _listed(node.right, thresholds, out)
        out[at] = (*own, float(node.gain), left, right, (node.feature, [float(thresholds[node.feature][node.cut])], -1))
    return at


def _pruned(node: Node) -> None:
    if not node.leaf:
        _pruned(node.left)
        _pruned(node.right)
        if node.left.leaf and node.right.leaf and node.left.prediction == node.right.prediction:
            node.left = node.right = None


_NODES = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint,"
          " gain: double, leftChild: int, rightChild: int,"
          " split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>")


def _model(est: GBTRegressor, spark: SparkSession, trees: list[Tree], weights: list[float],
           thresholds: list[np.ndarray], width: int) -> GBTRegressionModel:
    """The trees as MLlib's own model, by way of its saved form."""
    params = est.extractParamMap()
    given, unset = ({p.name: v for p, v in params.items() if est.isSet(p) == own} for own in (True, False))
    single = DecisionTreeRegressor()

    def metadata(kind: str, uid: str, has=lambda name: True, **more) -> str:
        maps = {k: {name: v for name, v in m.items() if has(name)} for k, m in (("paramMap", given), ("defaultParamMap", unset))}
        return json.dumps({"class": f"org.apache.spark.ml.regression.{kind}", "timestamp": int(time.time() * 1000),
                           "sparkVersion": spark.version, "uid": uid} | maps | more)

    nodes, described = [], []
    for i, tree in enumerate(trees):
        listed: list = []
        _listed(tree.root, thresholds, listed)
        nodes += [(i, row) for row in listed]
        described.append((i, metadata("DecisionTreeRegressionModel", f"dtr_{i}_{est.uid}", single.hasParam), float(weights[i])))
    path = scratch_path(spark, "boosted")
    head = metadata("GBTRegressionModel", est.uid, numFeatures=width, numTrees=len(trees))
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(described, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(nodes, _NODES).coalesce(1).write.parquet(f"{path}/data")
    model = GBTRegressionModel.load(path)
    delete_path(spark, path)
    return est._copyValues(model)
