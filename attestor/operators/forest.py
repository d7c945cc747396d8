"""Bagged regression trees, those of all folds at once: what a row of a fold gets from the trees of the other folds.

Rows lie in bins of their features (32 quantiles of the rows that a fold's trees learn from). A node of many rows is split by
figures of its bins, summed over all tasks; the rows of a node that is small enough go to one task, which grows all below it. Bags,
features of a node and sums (of whole numbers) depend on the rows alone, so the trees are the same however the work is dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .rasters import spread

#: Bins of a feature, what a label of 1 counts as in sums, rows that one task grows a tree of, nodes that are split in one pass.
BINS, ONE, MOST_ROWS, MOST_NODES = 32, 1 << 30, 1 << 19, 2048
#: A node of a tree by its place (1: the root; 2i and 2i + 1: below i): the feature that splits it, or -1; rows of bins up to `cut` go to 2i.
NODE = np.dtype([("at", "<i4"), ("feature", "<i2"), ("cut", "u1"), ("value", "<f8")])


@dataclass(frozen=True)
class Shape:
    """Parameters of the trees, as MLlib names them."""

    folds: int
    features: int
    numTrees: int
    maxDepth: int
    minInstancesPerNode: int
    featureSubsetStrategy: str
    subsamplingRate: float
    seed: int

    def weights(self, rows: np.ndarray, fold: int, tree: int) -> np.ndarray:
        """How often a tree has each row (its hash) in its bag: Poisson."""
        k = np.arange(1, 24)
        share = np.exp(-self.subsamplingRate) * np.cumprod(np.concatenate([[1.0], self.subsamplingRate / k]))
        u = mixed(rows ^ mixed(np.uint64(self.seed << 32 | fold * self.numTrees + tree))) >> np.uint64(11)
        return np.searchsorted(np.cumsum(share), u.astype(np.float64) / (1 << 53), side="right").astype(np.uint8)

    def allowed(self, nodes: np.ndarray, fold: int, tree: int) -> np.ndarray:
        """Which features may split each node: a share of them, drawn for each node."""
        of = mixed(np.uint64(~self.seed & 0xFFFFFFFF) << np.uint64(32) | np.uint64(fold * self.numTrees + tree))
        drawn = mixed(mixed(nodes.astype(np.uint64) ^ of)[:, None] + np.arange(self.features, dtype=np.uint64))
        return drawn.argsort(1).argsort(1) < ceil(float(self.featureSubsetStrategy) * self.features)

    def splits(self, nodes: np.ndarray, fold: int, tree: int, cells: Callable[[int], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(tree nodes, rows of their lower sides) by cells(feature): counts and sums of labels by node and bin."""
        allowed, best = self.allowed(nodes, fold, tree), np.zeros(len(nodes))
        found, low = np.zeros(len(nodes), NODE), np.zeros(len(nodes))
        found["at"], found["feature"] = nodes, -1
        each = np.arange(len(nodes))
        for f in range(self.features):
            n, s = (np.cumsum(x, 1, dtype=np.float64) for x in cells(f))
            total, sums = n[:, -1:], s[:, -1:]
            if f == 0:
                whole = (sums * sums / total)[:, 0]
                found["value"] = (sums / total)[:, 0] / ONE
                best = whole * (1 + 1e-12)
            n, s = n[:, :-1], s[:, :-1]
            rest = total - n
            good = allowed[:, f : f + 1] & (n >= self.minInstancesPerNode) & (rest >= self.minInstancesPerNode)
            gain = np.where(good, s * s / np.maximum(n, 1) + (sums - s) ** 2 / np.maximum(rest, 1), 0)
            cut = gain.argmax(1)
            gain = gain[each, cut]
            better = (gain > best) & (nodes < 1 << self.maxDepth)
            found["feature"][better], found["cut"][better] = f, cut[better]
            best[better], low[better] = gain[better], n[each, cut][better]
        return found, low


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits that look random, of 64 bits."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def grown(shape: Shape, fold: int, tree: int, root: int, rows: np.ndarray) -> np.ndarray:
    """The tree below a node by all its rows (bins, weight, label), level by level; parts that nothing can split leave at once."""
    bins, weight = np.ascontiguousarray(rows["bins"].T).astype(np.int64), rows["weight"].astype(np.float64)
    label = weight * rows["label"]
    nodes, own, out = np.array([root]), np.zeros(len(rows), np.int64), []

    def keep(of: np.ndarray) -> None:
        nonlocal own, bins, weight, label, nodes
        stay = of[own]
        own, bins, weight, label = (np.cumsum(of) - 1)[own[stay]], bins[:, stay], weight[stay], label[stay]
        nodes = nodes[of]

    def cells(f: int) -> tuple[np.ndarray, np.ndarray]:
        key = own * BINS + bins[f]
        return tuple(np.bincount(key, x, len(nodes) * BINS).reshape(-1, BINS) for x in (weight, label))

    while len(nodes):
        n, total = (np.bincount(own, x, len(nodes)) for x in (weight, label))
        last = (n < 2 * shape.minInstancesPerNode) | (nodes >= 1 << shape.maxDepth)
        leaves = np.zeros(last.sum(), NODE)
        leaves["at"], leaves["feature"], leaves["value"] = nodes[last], -1, (total / n)[last] / ONE
        out.append(leaves)
        keep(~last)
        if not len(nodes):
            break
        found, _ = shape.splits(nodes, fold, tree, cells)
        out.append(found)
        split = found["feature"] >= 0
        found = found[split]
        keep(split)
        own = 2 * own + (bins[found["feature"][own], np.arange(len(own))] > found["cut"][own])
        nodes = (2 * nodes[:, None] + (0, 1)).ravel()
    return np.concatenate(out)


def reached(tree: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Where each row ends in the nodes of a tree: a leaf of it, or the place below its last split. Rows of bins go down side by side."""
    place = np.ones(len(bins), np.int64)
    if not len(tree):
        return place
    feature, cut = np.full(int(tree["at"].max()) + 1, -1), np.zeros(int(tree["at"].max()) + 1, np.int64)
    feature[tree["at"]], cut[tree["at"]] = tree["feature"], tree["cut"]
    live = np.arange(len(bins))
    while len(live):
        live = live[place[live] < len(feature)]
        f = feature[place[live]]
        live, f = live[f >= 0], f[f >= 0]
        place[live] = 2 * place[live] + (bins[live, f] > cut[place[live]])
    return place


def scored(rows: DataFrame, key: list[str], features: str, label: str, fold: str, folds: int, many: int, most: int = MOST_ROWS, **shape) -> DataFrame:
    """The rows with `score`: the mean of what the trees of the other folds give. `key` tells rows apart; labels are from 0 to 1.

    `many` features; `most`: rows of a node that one task grows a tree of. What comes to the driver are bins, and trees, whose
    size the parameters bound.
    """
    shape = Shape(folds=folds, features=many, **shape)
    row = np.dtype([("bins", "u1", (many,)), ("weight", "u1"), ("label", "<i8")])
    data = rows.select(F.xxhash64(*key).alias("row"), F.col(fold).cast("int").alias("fold"), F.col(features).alias("x"), F.round(F.col(label) * ONE).cast("long").alias("y"))
    others = F.filter(F.array(*map(F.lit, range(folds))), lambda k: k != F.col("fold"))
    values = data.select(F.explode(others).alias("of"), "x").select("of", F.posexplode("x").alias("f", "v"))
    ends = values.groupBy("of", "f").agg(F.percentile_approx("v", [i / BINS for i in range(1, BINS)]).alias("ends"), F.count("*").alias("n")).collect()
    n, cuts = dict.fromkeys(range(folds), 0), {k: [np.zeros(1)] * many for k in range(folds)}
    for r in ends:
        n[r.of], cuts[r.of][r.f] = r.n, np.unique(r.ends)

    def binned(k: int, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v) for c, v in zip(cuts[k], x.T, strict=True)], -1).astype(np.uint8)

    def learning(b: pa.RecordBatch, known: dict[tuple[int, int], np.ndarray]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(fold, tree, places, rows) of the bags of a batch."""
        ids, own, y = (np.asarray(b.column(i)) for i in (0, 1, 3))
        x = np.asarray(b.column(2).flatten(), np.float64).reshape(-1, many)
        for k in range(folds):
            mine = own != k
            made = np.zeros(mine.sum(), row)
            made["bins"], made["label"] = binned(k, x[mine]), y[mine]
            for t in range(shape.numTrees):
                made["weight"] = shape.weights(ids[mine].view(np.uint64), k, t)
                bag = made[made["weight"] > 0]
                yield k, t, reached(known.get((k, t), np.zeros(0, NODE)), bag["bins"]), bag

    def parts(rows: np.ndarray, place: np.ndarray, wanted: set[int]) -> Iterator[tuple[int, np.ndarray]]:
        for at in [int(i) for i in np.unique(place) if int(i) in wanted]:
            yield at, rows[place == at]

    trees: dict[tuple[int, int], list[np.ndarray]] = {(k, t): [] for k in range(folds) if n[k] for t in range(shape.numTrees)}
    known = lambda: {k: np.concatenate(v) for k, v in trees.items() if v}
    large, small = {}, {}
    for k, t in trees:
        (large if n[k] > most else small).setdefault((k, t), set()).add(1)

    while large:
        flat = [(k, t, at) for (k, t), places in large.items() for at in sorted(places)]
        large = {}
        for i in range(0, len(flat), MOST_NODES):
            for k, t, found, low, high in _divided(data, shape, learning, parts, known(), flat[i : i + MOST_NODES]):
                trees[k, t].append(found)
                for j, size in enumerate((low, high) if found["feature"][0] >= 0 else ()):
                    (large if size > most else small).setdefault((k, t), set()).add(2 * int(found["at"][0]) + j)

    top = known()

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(k, t, at, r.tobytes()) for k, t, place, bag in learning(b, top) for at, r in parts(bag, place, small.get((k, t), set()))]
            yield _batch(out, ["fold", "tree", "at", "rows"], [pa.int32(), pa.int32(), pa.int32(), pa.binary()])

    def grow(table: pa.Table) -> pa.Table:
        k, t, at = (table.column(i)[0].as_py() for i in range(3))
        nodes = grown(shape, k, t, at, np.frombuffer(b"".join(table.column(3).to_pylist()), row))
        return pa.Table.from_batches([_batch([(k, t, nodes.tobytes())], ["fold", "tree", "nodes"], [pa.int32(), pa.int32(), pa.binary()])])

    bags = spread(data.mapInArrow(dealt, "fold int, tree int, at int, rows binary"), "fold", "tree", "at")
    for k, t, nodes in bags.groupBy("fold", "tree", "at").applyInArrow(grow, "fold int, tree int, nodes binary").collect():
        trees[k, t].append(np.frombuffer(nodes, NODE))
    whole = rows.sparkSession.sparkContext.broadcast(known())

    def given(k: int, x: np.ndarray) -> np.ndarray:
        total, bins = np.zeros(len(x)), binned(k, x)
        for t in range(shape.numTrees):
            tree = whole.value[k, t]
            value = np.zeros(int(tree["at"].max()) + 1)
            value[tree["at"]] = tree["value"]
            total += value[reached(tree, bins)]
        return total / shape.numTrees

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, score = np.asarray(b.column(fold)), np.zeros(b.num_rows)
            x = np.asarray(b.column(features).flatten(), np.float64).reshape(-1, many)
            for k in np.unique(own).tolist():
                if (k, 0) not in whole.value:
                    raise ValueError("a fold whose trees have no rows of other folds to learn from")
                score[own == k] = given(k, x[own == k])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=[*b.schema.names, "score"])

    return rows.mapInArrow(score, StructType([*rows.schema, StructField("score", DoubleType())]))


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)


def _divided(data: DataFrame, shape: Shape, learning: Callable, parts: Callable, known: dict, nodes: list[tuple[int, int, int]]) -> Iterator[tuple]:
    """(fold, tree, node, rows below on either side) of nodes, each split by the figures of its bins in all tasks."""
    wanted: dict[tuple[int, int], set[int]] = {}
    for k, t, at in nodes:
        wanted.setdefault((k, t), set()).add(at)
    size = shape.features * BINS

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], np.ndarray] = {}
        for b in batches:
            for k, t, place, bag in learning(b, known):
                for at, r in parts(bag, place, wanted.get((k, t), set())):
                    key = (np.arange(shape.features) * BINS + r["bins"]).ravel()
                    n = np.repeat(r["weight"].astype(np.float64), shape.features)
                    now = np.stack([np.bincount(key, x, size) for x in (n, n * np.repeat(r["label"], shape.features))]).astype(np.int64)
                    total[k, t, at] = total[k, t, at] + now if (k, t, at) in total else now
        yield _batch([(*key, x.tobytes()) for key, x in total.items()], ["fold", "tree", "at", "cells"], [pa.int32(), pa.int32(), pa.int32(), pa.binary()])

    def divide(table: pa.Table) -> pa.Table:
        k, t, at = (table.column(i)[0].as_py() for i in range(3))
        n, s = sum(np.frombuffer(x, np.int64) for x in table.column(3).to_pylist()).reshape(2, shape.features, 1, BINS)
        found, low = shape.splits(np.array([at]), k, t, lambda f: (n[f], s[f]))
        return pa.Table.from_batches([_batch([(k, t, found.tobytes(), int(low[0]), int(n[0].sum() - low[0]))], ["fold", "tree", "node", "low", "high"], [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()])])

    cells = spread(data.mapInArrow(figures, "fold int, tree int, at int, cells binary"), "fold", "tree", "at")
    for k, t, node, low, high in cells.groupBy("fold", "tree", "at").applyInArrow(divide, "fold int, tree int, node binary, low long, high long").collect():
        yield k, t, np.frombuffer(node, NODE), low, high
