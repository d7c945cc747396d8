"""Embedding near-dedup by binary codes of randomly rotated vectors.

Each distinct vector, scaled to length 1 and rotated at random, keeps the signs of its components (a code of one bit a
component) and a correction factor, its inner product with the code's direction. The inner product of a code with another
vector, over the factor, is an unbiased estimate of the two vectors' cosine, with an error that the factor bounds. Only where
that bound leaves room for the wanted cosine are vectors fetched and compared exactly, in doubles.

Vectors lie in cells, each with its nearest pivot. A vector also visits the cells whose border with its own is near enough that
a vector that alike may lie beyond; homes of a cell are compared with homes and visitors. Cells of many members are cut into
blocks that meet pairwise, so that no task holds a whole cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

#: How many standard errors an estimate may be off before a pair is lost.
ERRORS = 5.0


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same for each call."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, first by their largest component: no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def encode(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign codes (packed bits) of rotated unit vectors, and their correction factors: cosines with the codes' directions."""
    signs = rotated >= 0
    return np.packbits(signs, axis=1), np.abs(rotated).sum(axis=1) / np.sqrt(rotated.shape[1])


def may_reach(exact: np.ndarray, codes: np.ndarray, factors: np.ndarray, least: float) -> np.ndarray:
    """For each rotated unit vector and code whether their cosine may be `least` or more.

    The estimate <code, vector> / factor has the standard error sqrt(1 - factor ** 2) / factor * sqrt(1 - cosine ** 2) /
    sqrt(dim - 1), since only what is orthogonal to the coded vector adds to it.
    """
    dim = exact.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * np.float32(2 / np.sqrt(dim)) - np.float32(1 / np.sqrt(dim))
    estimates = (exact.astype(np.float32) @ signs.T) / factors
    error = np.sqrt(np.maximum(1 - factors**2, 0)) / factors * np.sqrt(max(1 - least * least, 0)) / np.sqrt(max(dim - 1, 1))
    return estimates >= least - ERRORS * error - 1e-5


def spread_pivots(sample: np.ndarray, many: int, alike: float = 0.7) -> np.ndarray:
    """At most `many` unit vectors of the sample, none more `alike` to an earlier one, so that a crowd of near copies has one."""
    out = np.empty((0, sample.shape[1]))
    for at in range(0, len(sample), 256):
        part = sample[at : at + 256]
        part = part[(part @ out.T < alike).all(axis=1)]
        inside = np.triu(part @ part.T, 1) >= alike  # column: later
        kept = np.ones(len(part), bool)
        for i in range(len(part)):
            if kept[i]:
                kept &= ~inside[i]
        out = np.concatenate([out, part[kept]])
        if len(out) >= many:
            break
    return out[:many]


def cells_of(vectors: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each unit vector's own cell, that of the nearest pivot, and the others whose border with it is within `reach`."""
    if not len(pivots):
        return np.zeros(len(vectors), np.int32), [np.empty(0, np.int32)] * len(vectors)
    near = vectors @ pivots.T
    home = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * (pivots[home] @ pivots.T), 0))  # the border is the plane between two pivots
    visits = near[np.arange(len(vectors)), home][:, None] - near <= reach * apart
    visits[np.arange(len(vectors)), home] = False
    return home.astype(np.int32), [np.flatnonzero(x).astype(np.int32) for x in visits]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _blocks(members: DataFrame, most: int) -> DataFrame:
    """Members of cells with their blocks: each cell's are dealt into parts of about `most`, and any two parts meet in one block."""
    # one row a cell: there are at most as many as pivots
    parts = members.groupBy("dim", "cell").count().select("dim", "cell", F.ceil(F.col("count") / most).cast("int").alias("parts"))
    out = members.join(parts, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return out.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).drop("other")


def _sides(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of a block the rows that are compared: homes of one part with all of the other, then the rest of the other's homes."""
    part, home = np.asarray(t.column("part")), np.asarray(t.column("is_home"))
    low, high = t.column("low")[0].as_py(), t.column("high")[0].as_py()
    yield np.flatnonzero((part == low) & home), np.flatnonzero(part == high)
    if low != high:
        yield np.flatnonzero((part == high) & home), np.flatnonzero((part == low) & ~home)


def _chunks(rows: np.ndarray, size: int = 1024) -> Iterator[np.ndarray]:
    for at in range(0, len(rows), size):
        yield rows[at : at + size]


def _candidates(least: float) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        """Members of the block for which an estimate leaves room for the cosine."""
        t = t.combine_chunks()
        dim = t.column("dim")[0].as_py()
        node, home = np.asarray(t.column("node")), np.asarray(t.column("is_home"))
        codes = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(node), -1)
        factors = np.asarray(t.column("factor"))
        exact = np.zeros((len(node), dim), np.float32)
        exact[home] = _matrix(t.column("rotated").chunk(0), dim)  # visitors have none
        seen = np.zeros(len(node), bool)
        for left, right in _sides(t):
            for i in _chunks(left):
                for j in _chunks(right):
                    ok = may_reach(exact[i], codes[j], factors[j], least) & (node[i][:, None] != node[j][None])
                    seen[i] |= ok.any(axis=1)
                    seen[j] |= ok.any(axis=0)
        t = t.filter(pa.array(seen))
        return pa.table([t.column(x) for x in ("dim", "cell", "node", "is_home")], names=["dim", "cell", "node", "is_home"])

    return run


def _join(root: np.ndarray, a: int, others: np.ndarray) -> None:
    """Gives all members of the parts of a and the others one root, their least."""
    if (root[others] != root[a]).any():
        parts = np.unique(np.r_[root[others], root[a]])
        root[np.isin(root, parts)] = parts[0]


LINKED = "node long, linked long, other long"


def _linked(least: float) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        """For each member of the block how many rows it links with, by exact cosines, and a member that it is joined to.

        A pair of different homes that both visit the other's cell is met twice; the cell with the smaller number counts it.
        """
        t = t.combine_chunks()
        dim, cell = t.column("dim")[0].as_py(), t.column("cell")[0].as_py()
        node, own, many = (np.asarray(t.column(x)) for x in ("node", "home", "many"))
        vectors = unit(_matrix(t.column("vector").chunk(0), dim))
        visits = [set(x) for x in t.column("visits").to_pylist()]
        linked, root = np.zeros(len(node), np.int64), np.arange(len(node))
        alone = t.column("low")[0] == t.column("high")[0]
        for left, right in _sides(t):
            for i in _chunks(left):
                for j in _chunks(right):
                    ok = vectors[i] @ vectors[j].T >= least
                    if alone:  # two homes meet in either order
                        ok &= (own[j] != cell)[None] | (node[i][:, None] < node[j][None])
                    for b in np.flatnonzero((own[j] < cell) & ok.any(axis=0)).tolist():
                        ok[:, b] &= [own[j[b]] not in visits[a] for a in i.tolist()]
                    linked[i] += ok @ many[j]
                    linked[j] += many[i] @ ok
                    for a in np.flatnonzero(ok.any(axis=1)).tolist():
                        _join(root, int(i[a]), j[ok[a]])
        some = linked > 0
        return pa.table([pa.array(x[some]) for x in (node, linked, node[root])], names=["node", "linked", "other"])

    return run


def links(classes: DataFrame, least: float, cell_rows: int, most_cells: int, most: int, sample_values: int, sigmas: float) -> DataFrame:
    """(node, linked, other): partial sums of how many rows each of the classes (node, dim, vector, many) links with, and joins.

    A vector's displacement to one that alike has a length of sqrt(2 - 2 * least) at most. Of two such vectors in different
    cells neither visits the other's only if the displacement crosses the border by more than twice the reach: the reach is
    half of `sigmas` standard deviations of a random direction's part across it, or half the length, when nothing is missed.
    """
    chord = float(np.sqrt(2 - 2 * least))
    fits: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim, rows in classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(16).collect():
        many = min(most_cells, rows // cell_rows)
        seen = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("node")).limit(max(1, sample_values // dim)).select("vector").toArrow() if many > 1 else None
        fits[dim] = rotation(dim), spread_pivots(unit(_matrix(seen.column("vector").combine_chunks(), dim)), many) if seen else np.empty((0, dim))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches, 1000):
            dims = np.asarray(b.column(1))
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                vectors = unit(_matrix(part.column(2), dim))
                turn, pivots = fits.get(dim) or (rotation(dim), np.empty((0, dim)))
                home, visits = cells_of(vectors, pivots, min(chord, sigmas * chord / np.sqrt(dim)) / 2)
                rotated = vectors @ turn
                codes, factors = encode(rotated)
                columns = [pa.array(home), pa.array(visits, pa.list_(pa.int32())), pa.array([*rotated.astype(np.float32)], pa.list_(pa.float32()))]
                columns += [pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(factors.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["node", "dim", "home", "visits", "rotated", "code", "factor"])

    schema = "node long, dim int, home int, visits array<int>, rotated array<float>, code binary, factor float"
    rows = common.materialise(classes.select("node", "dim", "vector").mapInArrow(placed, schema), "codes")
    homes = rows.select("dim", F.col("home").alias("cell"), "node", F.lit(True).alias("is_home"), "rotated", "code", "factor")
    visitors = rows.select("dim", F.explode("visits").alias("cell"), "node", F.lit(False), F.lit(None).cast("array<float>"), "code", "factor")
    key = ["dim", "cell", "low", "high"]
    near = _blocks(homes.union(visitors), most).groupBy(key).applyInArrow(_candidates(least), "dim int, cell int, node long, is_home boolean")
    near = common.materialise(near.distinct(), "near")
    vectors = classes.select("node", "vector", "many").join(rows.select("node", "home", "visits"), "node")
    return _blocks(near, most).join(vectors, "node").groupBy(key).applyInArrow(_linked(least), LINKED)


def near_duplicates(vectors: DataFrame, least: float = 0.95, cell_rows: int = 128, most_cells: int = 4096, most: int = 2048, sample_values: int = 1 << 20, sigmas: float = 5.0) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id and kept.

    vectors: vec_id and embedding, an array. Two rows link when the cosine of their vectors, of as many components, is `least` or
    more, in doubles; equal vectors always do. n_links: how many other rows a row links with; component_id: the least vec_id
    that links reach, the row's own included; kept: whether it is the row's own. No pair below `least` links.

    Pivots of cells come from `sample_values` components of vectors chosen by hash, a cell for `cell_rows` distinct vectors and
    `most_cells` at most; all vectors are indexed. Up to 25 components no link is missed but by an estimate off by five standard
    errors; with more, also a pair whose displacement crosses a border by over `sigmas` standard deviations of a random direction.

    Vectors that are null, zero or hold null or non-finite components link with nothing. Rows that repeat a vec_id are rows
    like any other; a null vec_id takes part but never names a component (one of nulls only has a null id and keeps all). An
    empty table gives none; other columns are ignored.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    good = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    values = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", F.when(good, values).alias("vector"))
    rows = common.materialise(rows.withColumn("digest", F.sha2(F.col("vector").cast("string"), 256)), "vectors")
    classes = rows.where("vector is not null").groupBy("digest").agg(F.count("*").alias("many"), F.min("vec_id").alias("low"), F.any_value("vector").alias("vector"))
    classes = common.materialise(classes.select("*", F.size("vector").alias("dim"), F.monotonically_increasing_id().alias("node")), "classes")
    found = common.materialise(links(classes, least, cell_rows, most_cells, most, sample_values, sigmas), "links")
    joined = components(found.select(F.col("node").alias("u"), F.col("other").alias("v")))
    n = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    classes = classes.drop("vector").join(n, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = classes.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = classes.join(lowest, "component").select("digest", (F.coalesce("linked", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id", F.lit(True).alias("found"))
    out = rows.drop("vector").join(classes, "digest", "left").withColumn("component_id", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("vec_id")))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
