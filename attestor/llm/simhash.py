"""SimHash near-dedup with bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import common
from .components import components
from .winnow import Words, rolling

#: Of a bucket with more fingerprints, the bits that its members need not share are cut into blocks again.
MOST = 4096
#: Buckets of so many fingerprints at most are compared side by side in one set of planes.
SMALL = 32


def shingle_hashes(text: bytes, words: int) -> bytes:
    """XXH64 (seed 42, big-endian) of each shingle, one after the other."""
    w = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not w:
        return b""
    joined = b" ".join(w)
    ends = [*accumulate(len(x) + 1 for x in w)]
    starts = [0, *ends[:-1]]
    size = min(words, len(w))
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[size - 1 :], strict=False)])


def fingerprints(texts: list[bytes], words: int) -> np.ndarray:
    """A bit is set if it is set in over half the shingles' hashes; without words the fingerprint is 0."""
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        raw = shingle_hashes(text, words)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(raw), 8 << 15):
            part = np.frombuffer(raw[at : at + (8 << 15)], np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
        if raw:
            out[i] = np.packbits(2 * ones > len(raw) // 8).view(">u8")[0]
    return out


def fingerprint(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): fp as the long with the same 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches, 1000):
            fp = fingerprints(b.column(1).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """64 bit planes, each with one bit per fingerprint, in 64-bit words."""
    many = -(-len(fps) // 64) * 64
    bits = np.zeros((64, many), np.uint8)
    bits[:, : len(fps)] = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).T
    return np.packbits(bits, axis=1).view(np.uint64)


def _counted(plane: Callable[[int, np.ndarray], np.ndarray], blocks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of `blocks` of 64 those that come through all planes of differing bits, and which of their members are near.

    A counter of two bits per member and a sticky overflow plane add up differing bits plane by plane; when a whole block has
    passed the radius (3 at most) it is left out of the further planes.
    """
    ones, twos, over = (np.zeros(len(blocks), np.uint64) for _ in range(3))
    far = over
    for p in range(64):
        diff = plane(p, blocks)
        carry = ones & diff
        ones ^= diff
        over |= twos & carry
        twos ^= carry
        if p % 8 == 7:
            far = over | (twos & ones) if radius == 2 else over | twos if radius == 1 else over | twos | ones if radius == 0 else over
            keep = far != np.uint64(0xFFFFFFFFFFFFFFFF)
            if not keep.all():
                blocks, ones, twos, over, far = blocks[keep], ones[keep], twos[keep], over[keep], far[keep]
            if not len(blocks):
                break
    return blocks, np.unpackbits((~far).view(np.uint8)).reshape(-1, 64)


def within(fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each fingerprint the later ones within `radius` bits (3 at most), by vertical counters."""
    sliced = planes(fps)
    for i in range(len(fps) - 1):
        fp = int(fps[i])
        plane = lambda p, at: ~sliced[p, at] if fp >> (63 - p) & 1 else sliced[p, at]  # noqa: E731, B023
        blocks, near = _counted(plane, np.arange((i + 1) // 64, sliced.shape[1]), radius)
        if len(blocks):
            block, bit = np.nonzero(near)
            j = blocks[block] * 64 + bit
            yield i, j[(j > i) & (j < len(fps))]


@cache
def _all_pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def within_each(buckets: list[np.ndarray], radius: int, at_once: int = 1 << 16) -> dict[int, list[tuple[int, np.ndarray]]]:
    """For each of many small buckets that has any: its near members as within() gives them. Pairs of all lie side by side in one set of planes."""
    out: dict[int, list[tuple[int, np.ndarray]]] = {}
    if not buckets:
        return out
    which = [_all_pairs(len(x)) for x in buckets]
    i, j = (np.concatenate([w[k] for w in which]) for k in range(2))
    bucket = np.repeat(np.arange(len(buckets)), [len(w[0]) for w in which])
    start = np.cumsum([0, *map(len, buckets[:-1])])[bucket]
    fps = np.concatenate(buckets)
    for at in range(0, len(i), at_once):
        part = slice(at, at + at_once)
        left, right = planes(fps[start[part] + i[part]]), planes(fps[start[part] + j[part]])
        blocks, near = _counted(lambda p, b: left[p, b] ^ right[p, b], np.arange(left.shape[1]), radius)  # noqa: B023
        block, bit = np.nonzero(near)
        found = at + blocks[block] * 64 + bit
        for x in found[found < min(at + at_once, len(i))].tolist():
            out.setdefault(int(bucket[x]), []).append((int(i[x]), j[x : x + 1]))
    return out


def join_bucket(fps: np.ndarray, found: Iterable[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the members found near each other: each member with the least of its part of the bucket."""
    n = len(fps)
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, js in found:
        for j in js.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    roots = np.array([root(x) for x in range(n)])
    other = np.flatnonzero(roots != np.arange(n))
    return fps[other], fps[roots[other]]


#: So many links are joined by one task before components are found.
LINKS = 1 << 18


def joined_links(links: DataFrame, count: int, most: int = LINKS) -> DataFrame:
    """(u, v) with the components of the `count` links (a, b): of each task's `most` or so, joined there, a link for each node that isn't the least of its part.

    Few tasks take part, so what is left is stars already, or nearly, and components() needs few rounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty((2, 0), np.int64)]

        def joined() -> pa.RecordBatch:
            both = np.concatenate(held, axis=1)
            nodes, at = np.unique(both, return_inverse=True)
            i, j = at.reshape(both.shape)
            u, v = join_bucket(nodes, zip(i.tolist(), j.reshape(-1, 1), strict=True)) if both.size else both
            held[:] = [np.stack([u, v])]
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for b in batches:
            held.append(np.array([b.column(0).to_numpy(), b.column(1).to_numpy()], np.int64))
            if sum(x.shape[1] for x in held) > 4 * most:
                done = joined()
                if done.num_rows > 2 * most:
                    yield done
                    held[:] = [np.empty((2, 0), np.int64)]
        yield joined()

    return links.select("a", "b").coalesce(common.groups_for(count, most)).mapInArrow(run, "u long, v long")


def _blocks(value: Column, width: int) -> list[Column]:
    return [F.shiftrightunsigned(value, width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(4)]


def _keys(value: Column, width: int) -> Column:
    """For each pair of the four blocks of `width` bits: which pair, the pair's bits, the other bits."""
    b = _blocks(value, width)
    out = []
    for which, (i, j) in enumerate(combinations(range(4), 2)):
        rest = [x for x in range(4) if x not in (i, j)]
        both = lambda x, y: F.shiftleft(b[x], width).bitwiseOR(b[y])  # noqa: E731, B023
        out.append(F.struct(F.lit(which).alias("pair"), both(i, j).alias("key"), both(*rest).alias("rest")))
    return F.array(*out)


def links(fps: DataFrame, radius: int = 2, most: int = MOST) -> DataFrame:
    """(u, v): links that join all distinct fingerprints within `radius` (2 at most, or ValueError) bits of each other.

    Of four blocks of 16 bits, two differing bits leave two alike, so near fingerprints meet under one of six pairs of
    blocks. Where more than `most` share a pair, the other 32 bits are cut the same way; then 48 bits are shared, and a
    bucket cannot hold more than 65,536 distinct fingerprints. A bucket yields a link for each member at most.
    """
    if not 0 <= radius <= 2:
        raise ValueError("two of four blocks are sure to be alike only up to a radius of 2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [np.array(x, np.int64).view(np.uint64) for x in b.column(0).to_pylist()]
            small = [x for x in fps if len(x) <= SMALL]
            pairs = [join_bucket(small[i], found) for i, found in within_each(small, radius).items()]
            pairs += [join_bucket(x, within(x, radius)) for x in fps if len(x) > SMALL]
            u, v = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.uint64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    keyed = fps.select("fp", F.explode(_keys(F.col("fp"), 16)).alias("k")).select("fp", "k.*")
    large = keyed.groupBy("pair", "key").count().where(F.col("count") > most).select("pair", "key")
    small = keyed.join(large, ["pair", "key"], "left_anti").groupBy("pair", "key").agg(F.collect_list("fp").alias("fps"))
    again = (
        keyed.join(large, ["pair", "key"], "left_semi")
        .select("fp", F.col("pair").alias("pair1"), F.col("key").alias("key1"), F.explode(_keys(F.col("rest"), 8)).alias("k"))
        .groupBy("pair1", "key1", "k.pair", "k.key")
        .agg(F.collect_list("fp").alias("fps"))
    )
    buckets = small.select("fps").union(again.select("fps")).where(F.size("fps") > 1)
    return buckets.mapInArrow(run, "u long, v long").distinct()


def _prefix(hashes: np.ndarray, common_: np.ndarray, counts: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """Of a set's hashes the rarest first, as many as one must share with any set whose Jaccard similarity is `least`."""
    n, slot = len(hashes), hashes & (SLOTS - 1)
    at = np.minimum(np.searchsorted(common_, slot), max(len(common_) - 1, 0))
    weight = np.where(common_[at] == slot, counts[at], 0) if len(common_) else np.zeros(n, np.int64)
    return hashes[np.lexsort((hashes, weight))[: n - -(-least[0] * n // least[1]) + 1]]


def _set_of(text: bytes, words: int) -> np.ndarray:
    """The set of a text's shingles as sorted 64-bit hashes; they only find candidates."""
    units = Words.units(text.lower())
    return np.unique(rolling(Words.codes(units), min(words, len(units)))).view(np.int64) if units else np.empty(0, np.int64)


def _parities(hashes: np.ndarray) -> np.ndarray:
    """1024 bits: whether each slot holds an odd number of the set. Two sets differ in as many members at least as in bits."""
    return np.packbits(np.bincount(hashes >> 22 & 1023, minlength=1024).astype(np.uint8) & 1).view(np.int64)


def _words_of(text: bytes, words: int) -> set[bytes]:
    w = text.lower().split()
    size = min(words, len(w))
    return {b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()


def _may_match(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], least: tuple[int, int]) -> np.ndarray:
    """Whether sets of these sizes that first share their hash at these places of their orders can have the similarity."""
    (size, at), (size_, at_) = one, other
    possible = np.minimum(size - at, size_ - at_)
    p, q = least
    return ((p + q) * possible >= p * (size + size_)) & (q * size_ >= p * size) & (q * size >= p * size_)


class Bucket:
    """The documents of one block of a shingle's bucket, by size: of one part, or of two parts that meet."""

    def __init__(self, part: np.ndarray, size: np.ndarray, at: np.ndarray, node: np.ndarray, component: np.ndarray, parities: np.ndarray | None):
        self.part, self.size, self.at, self.node, self.component, self.parities = part, size, at, node, component, parities
        self.both = (part != part[0]).any()

    def few(self, least: tuple[int, int], next_: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Each member with the first whose size allows the similarity and with the next few."""
        own = np.arange(len(self.node))
        pivot, i = np.zeros(len(own), np.int64), 0
        while i < len(own):
            j = i + int(np.searchsorted(self.size[i:], self.size[i] * least[1] // least[0], "right"))
            pivot[i:j] = i
            i = j
        one = np.concatenate([pivot, *(own[:-k] for k in range(1, next_ + 1))])
        two = np.concatenate([own, *(own[k:] for k in range(1, next_ + 1))])
        ok = (one != two) & _may_match((self.size[one], self.at[one]), (self.size[two], self.at[two]), least)
        return self.node[one[ok]], self.node[two[ok]]

    def across(self, least: tuple[int, int], most: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of different components that may have the similarity, by size, place and parities: for each member all, or the `most` with the fewest differing parities."""
        none = self.node[:0], self.node[:0]
        if (self.component == self.component[0]).all() or not self.both and len(self.node) < 2:
            return none
        p, q = least
        to = np.searchsorted(self.size, self.size * q // p, "right")
        left, right = [], []
        for i in range(len(self.node) - 1):
            j = np.arange(i + 1, to[i])
            ok = self.component[j] != self.component[i]
            if self.both:
                ok &= self.part[j] != self.part[i]
            j = j[ok]
            j = j[_may_match((self.size[i], self.at[i]), (self.size[j], self.at[j]), least)]
            if not len(j):
                continue
            # sets of such a similarity differ in at most (1 - least) / (1 + least) of their members, so in no more parities
            differ = np.bitwise_count(self.parities[j] ^ self.parities[i]).sum(axis=1, dtype=np.int64)
            near = (p + q) * differ <= (q - p) * (self.size[i] + self.size[j])
            j, differ = j[near], differ[near]
            if most and len(j) > most:
                j = j[np.argsort(differ, kind="stable")[:most]]
            if len(j):
                right.append(self.node[j])
                left.append(np.full(len(j), self.node[i]))
        return (np.concatenate(left), np.concatenate(right)) if left else none


#: Columns of a member of a bucket's block before its parities.
MEMBER = ("h", "low", "high", "part", "size", "at", "node", "component")


def _paired(batches: Iterator[pa.RecordBatch], pairs: Callable[[Bucket], tuple[np.ndarray, np.ndarray]], most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """(a, b) that `pairs` makes of each block of members; rows come sorted by h, low, high, size and node."""
    held: list[np.ndarray] = []
    many, wide = 0, len(MEMBER)

    def out(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        start = np.flatnonzero(np.r_[True, (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)]) if rows.shape[1] else np.empty(0, np.int64)
        end = np.r_[start[1:], rows.shape[1]]
        for s, e in zip(start[end - start > 1].tolist(), end[end - start > 1].tolist(), strict=True):
            parities = np.ascontiguousarray(rows[wide:, s:e].T).view(np.uint64) if len(rows) > wide else None  # bits of signed numbers aren't counted right
            yield pairs(Bucket(*rows[3:wide, s:e], parities))

    def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left = None
        for b in batches:
            rows = np.array([b.column(i).to_numpy(zero_copy_only=False) for i in range(wide)], np.int64)
            if b.num_columns > wide:
                rows = np.concatenate([rows, np.asarray(b.column(wide).flatten(), np.int64).reshape(b.num_rows, -1).T])
            rows = rows if left is None else np.concatenate([left, rows], axis=1)
            same = (rows[:3] == rows[:3, -1:]).all(axis=0) if rows.shape[1] else np.empty(0, bool)
            cut = int(np.argmax(same)) if same.size else 0  # the last block may go on
            yield from out(rows[:, :cut])
            left = rows[:, cut:].copy()
        if left is not None:
            yield from out(left)

    def batch() -> pa.RecordBatch:
        a, b = np.unique(np.concatenate(held, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for a, b in found():
        if len(a):
            held.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
            many += len(a)
            if many >= most:
                yield batch()
                held, many = [], 0
    if held:
        yield batch()


#: Shingles are counted in so many slots, by the low bits of their hashes.
SLOTS = 1 << 22


def common_shingles(docs: DataFrame, overlap: int, known: int) -> tuple[np.ndarray, np.ndarray]:
    """The slots whose shingles occur most often, sorted, and how often: each document counts.

    A task sums up its own slots and reports the `known` fullest of those counted twice, so memory and traffic are bounded.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for b in common.sliced(batches, 2000):
            h = np.concatenate([*(_set_of(t, overlap) for t in b.column(0).to_pylist()), np.empty(0, np.int64)])
            np.add.at(n, h & (SLOTS - 1), 1)
        twice = np.flatnonzero(n > 1)
        twice = twice[np.argsort(-n[twice], kind="stable")[:known]]
        yield pa.RecordBatch.from_arrays([pa.array(twice), pa.array(n[twice])], names=["slot", "n"])

    sums = docs.select("text").mapInArrow(counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    top = sums.orderBy(F.desc("n"), "slot").limit(known).toArrow()
    slot, n = (np.asarray(top.column(i).to_numpy(), np.int64) for i in range(2))
    order = np.argsort(slot)
    return slot[order], n[order]


def marked(docs: DataFrame, words: int, overlap: int, least: tuple[int, int], known: int) -> DataFrame:
    """(doc_id, digest, fp, size, parities, firsts) of docs (doc_id, text, digest): fingerprint, and of the shingle set size, parities and prefix."""
    h, counts = common_shingles(docs, overlap, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches, 1000):
            raw = b.column(1).to_pylist()
            sets = [_set_of(t, overlap) for t in raw]
            firsts = pa.array([_prefix(s, h, counts, least) if len(s) else s for s in sets], pa.list_(pa.int64()))
            size = pa.array([len(s) for s in sets], pa.int64())
            parities = pa.array([_parities(s) for s in sets], pa.list_(pa.int64()))
            columns = [b.column(0), b.column(2), pa.array(fingerprints(raw, words).view(np.int64)), size, parities, firsts]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "fp", "size", "parities", "firsts"])

    own = {"digest": StringType(), "fp": LongType(), "size": LongType(), "parities": ArrayType(LongType()), "firsts": ArrayType(LongType())}
    schema = StructType([docs.schema["doc_id"], *(StructField(n, t) for n, t in own.items())])
    return docs.select("doc_id", "text", "digest").mapInArrow(run, schema)


#: A bucket of one shingle with more members is dealt into parts, any two of which meet in one block.
PART = 4096


def similar_texts(docs: DataFrame, words: int = 3, radius: int = 2, overlap: int = 5, least: tuple[int, int] = (4, 5), known: int = 100_000, part: int = PART) -> DataFrame:
    """A row per document: doc_id, digest (SHA-256 of the text, hex) and component, a number for each group of similar texts.

    Two texts link when their sets of `overlap`-word shingles have a Jaccard similarity of `least` (a fraction, at least 1 / 2)
    or more; no words at all are similar to no words. Every link is verified by the shingles themselves. Candidates are, in
    rounds, each of which pairs only what earlier links have not joined, so that a group of copies isn't expanded:

    1. texts whose SimHash fingerprints of `words` words are equal or differ in up to `radius` bits (links());
    2. each text with five others at most that share a rare shingle with it;
    3. with the three whose shingles' parities differ least, of each such bucket;
    4. all that is left. Nothing is lost: with shingles in one order for all, two such sets share one among the first
       n - ceil(least * n) + 1 of either, what is left of both orders from there must be long enough, and the parities of 1,024
       slots of their shingles can't differ in more than the sets.

    Common shingles come last in the order, so few texts meet; `known` tells of how many slots of shingles the frequency is
    kept; both decide only how many candidates there are. Buckets of over `part` texts are cut into blocks.

    Null text counts as empty; very long texts are read whole; an empty table gives none; rows that repeat a doc_id, or have
    none, are judged by their texts; other columns are ignored.
    """
    raw = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    raw = raw.select("doc_id", F.col("text").cast("binary").alias("text"), F.sha2("text", 256).alias("digest"))
    marks = marked(raw, words, overlap, least, known).drop("doc_id").dropDuplicates(["digest"])
    nodes = common.materialise(marks.withColumn("node", F.monotonically_increasing_id()), "nodes")
    placed = nodes.select("node", "size", F.posexplode("firsts").alias("at", "h"))
    met = placed.groupBy("h").count().where("count > 1").select("h", F.ceil(F.col("count") / part).cast("int").alias("parts"))
    placed = placed.join(met, "h").select("h", "parts", "size", F.col("at").cast("long").alias("at"), "node", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"))
    placed = common.materialise(placed, "prefixes")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches):
            near = []
            for x, y in zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist(), strict=True):
                p, q = _words_of(x, overlap), _words_of(y, overlap)
                both = len(p & q)
                near.append(least[1] * both >= least[0] * (len(p) + len(q) - both))
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    def close(pairs: DataFrame, label: str) -> DataFrame:
        pairs = common.materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), f"{label}-pairs")
        if pairs.isEmpty():
            return pairs
        needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "digest"), "node")
        texts = common.materialise(raw.join(needed, "digest").dropDuplicates(["digest"]).select("node", "text"), f"{label}-texts")
        side = lambda k: texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}"))
        near = common.materialise(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(verified, "a long, b long"), label)
        common.discard(texts)
        common.discard(pairs)
        return near

    def of(links: DataFrame, count: int) -> DataFrame:
        return components(joined_links(links, count))

    def members(component: DataFrame) -> DataFrame:
        """Rows of the buckets that still hold several components."""
        now = placed.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = now.groupBy("h").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("h")
        return now.join(mixed, "h")

    def met_in_blocks(rows: DataFrame, pairs: Callable[[Bucket], tuple[np.ndarray, np.ndarray]], *more: str) -> DataFrame:
        rows = rows.select(*MEMBER, *more).repartition("h", "low", "high").sortWithinPartitions("h", "low", "high", "size", "node")
        return rows.mapInArrow(lambda x: _paired(x, pairs), "a long, b long")

    def in_parts(rows: DataFrame) -> DataFrame:
        return rows.withColumn("low", F.col("part")).withColumn("high", F.col("part"))

    def crossing(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(nodes.select("node", "parities"), "node")
        return rows.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))

    same = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    fp = lambda k, name: same.select(F.col("fp").alias(k), F.col("first").alias(name))
    by_bits = links(same.select("fp"), radius).join(fp("u", "a"), "u").join(fp("v", "b"), "v").select("a", "b")
    found = close(nodes.join(same, "fp").select(F.col("node").alias("a"), F.col("first").alias("b")).union(by_bits), "by-bits")
    many = found.count()
    joined = of(found, many)
    rounds = {
        "few": lambda: met_in_blocks(in_parts(members(joined)), lambda x: x.few(least)),
        "nearest": lambda: met_in_blocks(crossing(members(joined)), lambda x: x.across(least, 3), "parities"),
        "rest": lambda: met_in_blocks(crossing(members(joined)), lambda x: x.across(least), "parities"),
    }
    for label, pairs in rounds.items():
        more = close(pairs(), label)
        if n := more.count():  # else components are what they were
            found, many = found.union(more), many + n
            joined = of(found, many)
    labels = nodes.select("digest", "node").join(joined, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    return raw.select("doc_id", "digest").join(labels, "digest")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, most: int = MOST) -> DataFrame:
    """A row per document: doc_id, fp (64 bits as long) and component_id (the smallest doc_id reachable by links).

    Documents link when their fingerprints differ in `radius` bits at most; equal fingerprints are taken as one before any
    comparison.

    Null, empty and blank texts have fingerprint 0 and link like any other; very long texts are read whole; an empty table
    gives none; rows that repeat a doc_id are kept, each by its own text; a null doc_id takes part but never names a component
    (one of nulls only has a null id); other columns are ignored.
    """
    rows = common.materialise(fingerprint(docs, words), "fingerprints")
    classes = common.materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    joined = components(links(classes.select("fp"), radius, most)).withColumnRenamed("node", "fp")
    classes = classes.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = classes.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = classes.join(lowest, "component").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")
