"""Exact top-k search by inner product, with a KD-tree per shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Stands for a null vec_id, which is larger than any other; no real id may be it.
UNKNOWN = 2**63 - 1
Best = tuple[int, int, int]  # score, -id, -row: larger is better


def numbers(values: np.ndarray, *others: np.ndarray) -> type:
    """Doubles if inner products of these integers are exact in them, else Python's integers; the same code runs on either."""
    top = [max((abs(int(x.min())), abs(int(x.max())))) if x.size else 0 for x in (values, *others)]
    return np.float64 if values.shape[-1] * top[0] * max(top[1:] or top) < 2**53 else object


class Tree:
    """A KD-tree over integer vectors: median splits of the widest axis, tight boxes, the least id below each node."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, spans: np.ndarray, children: np.ndarray):
        self.ids, self.rows, self.vectors, self.spans, self.children = ids, rows, vectors, spans, children
        self.low = np.array([vectors[a:b].min(0) for a, b in spans])
        self.high = np.array([vectors[a:b].max(0) for a, b in spans])
        self.first = [int(ids[a:b].min()) for a, b in spans]

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, leaf: int = 64) -> Tree:
        order, spans, children, stack = np.arange(len(ids)), [], [], [(0, len(ids), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            node = len(spans)
            spans.append((a, b))
            children.append([-1, -1])
            if parent >= 0:
                children[parent][side] = node
            if b - a > leaf and vectors.shape[1]:
                part = vectors[order[a:b]]
                axis = _widest(part)
                order[a:b] = order[a:b][np.argpartition(part[:, axis], (b - a) // 2)]
                stack += [((a + b) // 2, b, node, 1), (a, (a + b) // 2, node, 0)]
        return cls(ids[order], rows[order], vectors[order], np.array(spans), np.array(children))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node the largest inner product that the node's box allows."""
        kind = queries.dtype
        return np.maximum(queries, 0) @ self.high.T.astype(kind) + np.minimum(queries, 0) @ self.low.T.astype(kind)

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, floors: list[Best | None]) -> list[list[Best]]:
        """For each query its k best of this tree but its own row, those left out that its floor beats.

        floors: the k-th best found elsewhere. Best-first: the node with the largest bound is opened next, until that bound
        can't beat the k-th best; a bound that equals its score can, if a smaller id is below.
        """
        kind = numbers(queries, self.low, self.high)
        queries, vectors = queries.astype(kind), self.vectors.astype(kind)
        out = []
        for mine, q, bound, floor in zip(own.tolist(), queries, self.bounds(queries).tolist(), floors, strict=True):
            best: list[Best] = []  # the worst first
            kth = floor or (-(2**200), 0, 0)
            heap = [(-bound[0], 0)]
            while heap:
                b, node = heapq.heappop(heap)
                if -b < kth[0]:
                    break
                if (-b, -self.first[node]) < kth[:2]:
                    continue
                left, right = self.children[node].tolist()
                if left >= 0:
                    heapq.heappush(heap, (-bound[left], left))
                    heapq.heappush(heap, (-bound[right], right))
                    continue
                a, z = self.spans[node].tolist()
                scores = vectors[a:z] @ q
                for i in np.flatnonzero(scores >= kth[0]).tolist():
                    x = (int(scores[i]), -int(self.ids[a + i]), -int(self.rows[a + i]))
                    if x[2] != -mine and x >= kth:
                        if len(best) < k:
                            heapq.heappush(best, x)
                        elif x > best[0]:
                            heapq.heapreplace(best, x)
                        if len(best) == k:
                            kth = max(kth, best[0])
            out.append(best)
        return out


def _widest(part: np.ndarray) -> int:
    return int((part.max(0).astype(np.float64) - part.min(0)).argmax())


def splits(sample: np.ndarray, shards: int) -> list[tuple[int, int, int, int]]:
    """A tree of median splits of a sample into `shards` parts at most: (axis, value, below, above); -1 - n is part n."""
    nodes: list[list[int]] = []
    parts = 0
    stack = [(sample, shards, -1, 0)]
    while stack:
        part, many, parent, side = stack.pop()
        axis = _widest(part) if len(part) and part.shape[1] else 0
        if many > 1 and len(part) > 1 and part[:, axis].min() < part[:, axis].max():
            value = int(np.sort(part[:, axis])[len(part) // 2])
            if value == part[:, axis].min():
                value = int(part[:, axis][part[:, axis] > value].min())
            here = len(nodes)
            nodes.append([axis, value, 0, 0])
            below = part[:, axis] < value
            stack += [(part[~below], many - many // 2, here, 3), (part[below], many // 2, here, 2)]
        else:
            here = -1 - parts
            parts += 1
        if parent >= 0:
            nodes[parent][side] = here
    return [tuple(x) for x in nodes]


def parts_of(vectors: np.ndarray, tree: list[tuple[int, int, int, int]]) -> np.ndarray:
    """The part of each vector."""
    at = np.zeros(len(vectors), np.int64) if tree else np.full(len(vectors), -1)
    nodes = np.array(tree).reshape(-1, 4)
    while (inner := np.flatnonzero(at >= 0)).size:
        axis, value, below, above = nodes[at[inner]].T
        at[inner] = np.where(vectors[inner, axis] < value, below, above)
    return -1 - at


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(rows, -1)


_LONGS = ("ids", "rows", "vectors", "spans", "children")
PLANTED = "dim int, shard int, part int, " + ", ".join(f"{x} array<long>" for x in (*_LONGS, "low", "high"))


def _plant(t: pa.Table) -> pa.Table:
    tree = Tree.build(t.column("id").to_numpy(), t.column("row").to_numpy(), _matrix(t.column("vector"), t.num_rows))
    flat = [getattr(tree, x).ravel() for x in _LONGS] + [tree.low[0], tree.high[0]]
    names = [x.split()[0] for x in PLANTED.split(", ")]
    return pa.table([*(t.column(x).slice(0, 1) for x in ("dim", "shard", "part")), *(pa.array([x.astype(np.int64)], pa.list_(pa.int64())) for x in flat)], names=names)


FOUND = "row long, query_id long, score decimal(38,0), id long, other long"


def _search(k: int):
    def run(trees: pa.Table, asked: pa.Table) -> pa.Table:
        cols: list[list] = [[], [], [], [], []]
        if trees.num_rows and asked.num_rows:
            dim = trees.column("dim")[0].as_py()
            ids, rows, vectors, spans, children = (np.asarray(trees.column(x)[0].values) for x in _LONGS)
            tree = Tree(ids, rows, vectors.reshape(len(ids), dim), spans.reshape(-1, 2), children.reshape(-1, 2))
            own, names = asked.column("row").to_numpy(), asked.column("id").to_pylist()
            floors = [x and (int(x["score"]), -x["id"], -x["other"]) for x in asked.column("floor").to_pylist()]
            found = tree.search(own, _matrix(asked.column("vector"), asked.num_rows), k, floors)
            for row, name, best in zip(own.tolist(), names, found, strict=True):
                for score, other_id, other in best:
                    for c, x in zip(cols, (row, name, score, -other_id, -other), strict=True):
                        c.append(x)
        kinds = (pa.int64(), pa.int64(), pa.decimal128(38, 0), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["row", "query_id", "score", "id", "other"])

    return run


def search(vectors: DataFrame, is_query: str = "vec_id % 50 = 0", k: int = 5, scale: int = 256, shard_rows: int = 16384, block_rows: int = 2048, sample: int = 20_000) -> DataFrame:
    """The k best candidates of each query: query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id.

    vectors: vec_id and embedding, an array. Components become floor(scale * x) (64 bits; larger ones are cut to that); the
    score is their inner product, exact, and cut to 64 bits when returned. Queries are the rows that `is_query` holds for;
    candidates all rows but the query's own, of as many components.

    Candidates are dealt into shards of about `shard_rows` by median splits of `sample` vectors (chosen by hash; it only
    shapes the shards: every row is indexed and results are exact), each with a KD-tree of its own; where many vectors are
    alike a shard has several trees. Queries first search a tree of the shard they are in. Their k-th best is the floor that
    the box of every other tree must reach; only such pairs of a query and a tree are formed, in blocks of about `block_rows`
    queries, and the floor prunes on in them.

    Vectors that are null or hold null or non-finite components take no part. A null vec_id is larger than any other. Rows
    that repeat a vec_id are rows like any other: each is a candidate, and each query among them gets its own ranks. An empty
    table gives no rows; other columns are ignored.
    """
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    id_ = F.coalesce(F.col("vec_id").cast("long"), F.lit(UNKNOWN)).alias("id")
    rows = vectors.where(F.coalesce(good, F.lit(False))).select("vec_id", id_, ints.alias("vector"), F.size("embedding").alias("dim"))
    rows = rows.select("*", F.expr(is_query).alias("asked")).withColumn("row", F.monotonically_increasing_id())
    rows = common.materialise(rows, "vectors")
    shapes: dict[int, list] = {}
    for dim, many in rows.groupBy("dim").count().collect():  # one row per dimension
        seen = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "row").limit(sample).select("vector").toArrow()
        shapes[dim] = splits(_matrix(seen.column("vector"), seen.num_rows), common.groups_for(many, shard_rows))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.asarray(b.column("dim"))
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                shard = parts_of(_matrix(part.column("vector"), part.num_rows), shapes[dim])
                yield part.append_column("shard", pa.array(shard.astype(np.int32)))

    placed = rows.select("id", "row", "vector", "dim", F.coalesce("asked", F.lit(False)).alias("asked"))
    placed = common.materialise(placed.mapInArrow(dealt, "id long, row long, vector array<long>, dim int, asked boolean, shard int"), "placed")
    sizes = placed.groupBy("dim", "shard").count().select("dim", "shard", F.ceil(F.col("count") / (2 * shard_rows)).cast("int").alias("parts"))
    placed = placed.join(sizes, ["dim", "shard"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")
    key = ["dim", "shard", "part"]
    trees = common.materialise(placed.groupBy(key).applyInArrow(_plant, PLANTED), "trees")
    no_floor = F.lit(None).cast("struct<score:decimal(38,0),id:long,other:long>").alias("floor")
    asked = common.materialise(placed.where("asked").select("row", "id", "vector", *key, no_floor), "asked")

    def met(asked: DataFrame, planted: DataFrame) -> DataFrame:
        return planted.groupBy(*key, "block").cogroup(asked.groupBy(*key, "block")).applyInArrow(_search(k), FOUND)

    order = Window.partitionBy("row").orderBy(F.desc("score"), "id", "other")
    blocks = common.groups_for(asked.count(), block_rows)
    planted = trees.select(*key, *_LONGS)
    one = F.lit(0).alias("block")
    home = common.materialise(met(asked.select("*", one), planted.select("*", one)), "home")
    floors = home.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("row", F.struct("score", "id", "other").alias("floor"))
    # the boxes of all trees against all queries, in the JVM: a bound that the floor beats forms no pair
    boxes = trees.select(*(F.col(x).alias(f"to_{x}") for x in key), "low", "high")
    products = "zip_with(vector, zip_with(low, high, (a, b) -> struct(a, b)), (q, x) -> cast(q as double) * if(q > 0, x.b, x.a))"
    bound = f"aggregate({products}, struct(0D as s, 0D as t), (s, x) -> struct(s.s + x as s, s.t + abs(x) as t), s -> s.s + s.t * 1e-9)"  # doubles round
    pairs = asked.drop("floor").join(floors, "row", "left").join(boxes, F.col("dim") == F.col("to_dim"))
    pairs = pairs.where("shard <> to_shard or part <> to_part").where(f"floor is null or {bound} >= cast(floor.score as double)")
    pairs = pairs.select("row", "id", "vector", "floor", "dim", F.col("to_shard").alias("shard"), F.col("to_part").alias("part"), F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"))
    needed = pairs.select(*((F.col(x) + 0).alias(x) for x in (*key, "block"))).distinct()
    rest = met(pairs, planted.join(needed, key))
    fits = lambda x: F.least(F.greatest(x, F.lit(-(2**63)).cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    return (
        home.union(rest)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.when(F.col("id") != UNKNOWN, F.col("id")).alias("vec_id"), fits(F.col("score")).alias("score"))
    )
