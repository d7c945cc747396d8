"""Finds every window of `length` consecutive units (bytes or words) that occurs more than once in a corpus.

Shared by the two repeat removers; they differ in the unit, in the engine that compares windows inside a bucket, and in
which repeats count.

1. Route. Each window takes the least hash of its sub-windows as its route, so equal windows have equal routes. Runs of
   consecutive windows with one route are cut out as one span. Routes that occur once cannot hold a repeat and go.
2. Collapse. Spans with the same bytes (they are compared, not their hashes) become one, with their count and least doc_id.
3. Compare. Routes are dealt into buckets of a bounded size; in each, an engine numbers equal windows alike, by content.
   Spans that stand for several go in twice, so that the engine finds their windows repeated like any other. A route too
   large for a bucket is cut again by longer sub-windows, and its parts go through the same steps.
4. Map back. Repeated windows go from spans to the documents that hold them, and become intervals there.

Hashes only partition: they never decide that two windows or spans are equal, they only make sure that equal ones meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MULT = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)]
#: Documents of more units are cut into pieces that overlap by a window less one, to bound the arrays.
PIECE = 1 << 18
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        base = int(MULT[which])
        size = 1 << max(12, (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        _powers[which] = have = (both[0], both[1])
    return have


def sums(codes: np.ndarray, which: int) -> np.ndarray:
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(which, len(codes) + 1)[0][: len(codes)], out=out[1:])
    return out


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive codes."""
    p = sums(codes, 0)
    return _mixed((p[k:] - p[:-k]) * powers(0, len(codes) + 1)[1][: len(codes) - k + 1])


def sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values, by prefix and suffix minima of blocks of w."""
    n = len(h) - w + 1
    a = np.full(-(-len(h) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    a[: len(h)] = h
    a = a.reshape(-1, w)
    before = np.minimum.accumulate(a, axis=1).ravel()
    after = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


_BYTE_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256).astype(np.uint64)


class Bytes:
    """Units are the bytes of the UTF-8 text."""

    @staticmethod
    def units(text: bytes) -> bytes:
        return text

    @staticmethod
    def codes(units: bytes) -> np.ndarray:
        return _BYTE_CODES[np.frombuffer(units, np.uint8)]

    @staticmethod
    def cut(units: bytes, a: int, b: int) -> bytes:
        return units[a:b]

    @staticmethod
    def symbols(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols from 1 of all parts one after the other, and where each part begins (one more: the end)."""
        return np.frombuffer(b"".join(parts), np.uint8).astype(np.int32) + 1, np.cumsum([0, *map(len, parts)])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MULT[1]
    return h ^ (h >> np.uint64(29))


_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


class WordsOf:
    """The words of a text, as places in it."""

    def __init__(self, text: bytes, starts: np.ndarray, ends: np.ndarray):
        self.text, self.starts, self.ends = text, starts, ends

    def __len__(self) -> int:
        return len(self.starts)

    def __getitem__(self, part: slice) -> WordsOf:
        return WordsOf(self.text, self.starts[part], self.ends[part])

    def __iter__(self) -> Iterator[bytes]:
        return iter([self.text[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)])


def _of_bytes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The polynomial of the bytes of each part."""
    p = sums(_BYTE_CODES[raw], 0)
    return (p[ends] - p[starts]) * powers(0, len(raw) + 1)[1][starts]


class Words:
    """Units are the words: maximal runs without ASCII white space (as bytes.split() cuts them)."""

    @staticmethod
    def units(text: bytes) -> WordsOf:
        edge = np.flatnonzero(np.diff(np.r_[True, _SPACE[np.frombuffer(text, np.uint8)], True]))
        return WordsOf(text, edge[::2], edge[1::2])

    @staticmethod
    def codes(units: WordsOf) -> np.ndarray:
        """A 64-bit hash of each word's bytes, by parts of `PIECE` bytes at most."""
        raw, starts, ends = np.frombuffer(units.text, np.uint8), units.starts, units.ends
        out, i = np.empty(len(units), np.uint64), 0
        while i < len(units):
            at = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, at + PIECE, "right")))
            if ends[i] - at <= PIECE:
                out[i:j] = _of_bytes(raw[at : ends[j - 1]], starts[i:j] - at, ends[i:j] - at)
            else:  # one word of many parts
                h, far, step = 0, 1, pow(int(MULT[0]), PIECE, 1 << 64)
                for a in range(at, int(ends[i]), PIECE):
                    part = raw[a : min(a + PIECE, ends[i])]
                    h += far * int(_of_bytes(part, np.array([0]), np.array([len(part)]))[0])
                    far = far * step % (1 << 64)
                out[i] = h % (1 << 64)
            i = j
        return _mixed(out)

    @staticmethod
    def cut(units: WordsOf, a: int, b: int) -> bytes:
        return b" ".join(units.text[units.starts[a] : units.ends[b - 1]].split()) if a < b else b""

    @staticmethod
    def symbols(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = [p.split() for p in parts]
        known: dict[bytes, int] = {}
        flat = [known.setdefault(w, len(known) + 1) for ws in words for w in ws]
        return np.array(flat, np.int32), np.cumsum([0, *map(len, words)])


ROWS = "route long, sub long, n int, start long, met int, dkey long, rid long"


def times_met(h: np.ndarray, least: np.ndarray, w: int, routes: np.ndarray) -> np.ndarray:
    """How often each route's hash is the least of a window here: over 1 where a run may repeat itself."""
    wide = np.full(len(h) + w - 1, np.uint64(0xFFFFFFFFFFFFFFFF))
    wide[w - 1 : w - 1 + len(least)] = ~least
    chosen, times = np.unique(h[h == ~sliding_least(wide, w)], return_counts=True)
    return times[np.searchsorted(chosen, routes)]


def span_rows(batches: Iterator[pa.RecordBatch], unit: type, length: int, k: int) -> Iterator[pa.RecordBatch]:
    """Of (dkey, rid, text): a row for each run of windows with one route. sub: a hash of the run's whole content."""
    for batch in common.sliced(batches, 2000):
        keys, rids, texts = (batch.column(i) for i in range(3))
        out: list[list[np.ndarray]] = [[], [], [], [], [], []]
        for row, text in enumerate(texts.to_pylist()):
            units = unit.units(text)
            if len(units) < length:
                continue
            for at in range(0, len(units) - length + 1, PIECE):
                codes = unit.codes(units[at : at + PIECE + length - 1])
                h = rolling(codes, k)
                least = sliding_least(h, length - k + 1)
                begin = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
                n = np.diff(begin, append=len(least))
                whole = sums(codes, 1)
                sub = content_hash(whole, begin, n + length - 1, len(codes))
                for c, x in zip(out, (least[begin], sub, n, begin + at, times_met(h, least, length - k + 1, least[begin]), np.full(len(n), row)), strict=True):
                    c.append(x)
        if out[0]:
            route, sub, n, start, met, row = map(np.concatenate, out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(route.view(np.int64)), pa.array(sub.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(met.astype(np.int32)), keys.take(pa.array(row)), rids.take(pa.array(row))],
                names=["route", "sub", "n", "start", "met", "dkey", "rid"],
            )


def content_hash(whole: np.ndarray, begin: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """A hash of the units [begin, begin + size), of their sums(codes, 1)."""
    return (whole[begin + size] - whole[begin]) * powers(1, n + 1)[1][begin]


CUT = "route long, sub long, n int, start long, dkey long, rid long, content binary"


def cut_spans(batches: Iterator[pa.RecordBatch], unit: type, length: int) -> Iterator[pa.RecordBatch]:
    """Of (dkey, rid, text, spans): each span with its content."""
    for batch in common.sliced(batches, 1000):
        cols: list[list] = [[], [], [], [], [], []]
        for row, (text, spans) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            units = unit.units(text)
            for s in spans:
                for c, x in zip(cols, (s["route"], s["sub"], s["n"], s["start"], row, unit.cut(units, s["start"], s["start"] + s["n"] + length - 1)), strict=True):
                    c.append(x)
        if cols[0]:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
            route, sub, n, start, row, content = (pa.array(c, k) for c, k in zip(cols, kinds, strict=True))
            yield pa.RecordBatch.from_arrays([route, sub, n, start, batch.column(0).take(row), batch.column(1).take(row), content], names=["route", "sub", "n", "start", "dkey", "rid", "content"])


AGAIN = "parent long, start long, route long, n int, count long, least long, content binary"


def cut_again(batches: Iterator[pa.RecordBatch], unit: type, length: int, k: int) -> Iterator[pa.RecordBatch]:
    """Of spans (id, content, count, least): their runs of windows with one route by sub-windows of k; if these are whole windows, each window."""
    for batch in common.sliced(batches, 200):
        cols: list[list] = [[], [], [], [], [], []]
        size = 0

        def out() -> pa.RecordBatch:
            row, start, route, n, content = cols[:5]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            start, route, n, content = (pa.array(c, k) for c, k in zip((start, route, n, content), kinds, strict=True))
            at = pa.array(row, pa.int32())  # noqa: B023
            return pa.RecordBatch.from_arrays([batch.column("id").take(at), start, route, n, batch.column("count").take(at), batch.column("least").take(at), content], names=["parent", "start", "route", "n", "count", "least", "content"])  # noqa: B023

        for row, text in enumerate(batch.column("content").to_pylist()):
            units = unit.units(text)
            route = sliding_least(rolling(unit.codes(units), k), length - k + 1)
            new = np.ones(len(route), bool) if k == length else np.r_[True, route[1:] != route[:-1]]
            begin = np.flatnonzero(new)
            n = np.diff(begin, append=len(route))
            for a, r, m in zip(begin.tolist(), route[begin].view(np.int64).tolist(), n.tolist(), strict=True):
                content = unit.cut(units, a, a + m + length - 1)
                for c, x in zip(cols, (row, a, r, m, content), strict=False):
                    c.append(x)
                size += len(content)
                if size > 16 << 20:
                    yield out()
                    cols, size = [[], [], [], [], [], []], 0
        if cols[0]:
            yield out()


def runs_of(flag: np.ndarray) -> np.ndarray:
    """(begin, end) of the maximal runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
    return edge.reshape(-1, 2)


#: engine(symbols, starts, length) -> class numbers, equal for equal windows.
Engine = Callable[[np.ndarray, np.ndarray, int], np.ndarray]
FOUND = "id long, repeats array<struct<a:int,b:int,least:long>>"


def compare(t: pa.Table, unit: type, length: int, engine: Engine, among: str) -> pa.Table:
    """Of a bucket's spans: the runs of windows that count as repeats, with the least doc_id that holds each.

    among 'occurrences': a window repeats if it occurs twice anywhere. 'documents': if a document with a lesser doc_id
    than the span's own least has it, or several documents have the span; runs are then cut where the least doc_id changes,
    and `least` compares per document. A span that stands for several is there twice: a repeat is what the engine finds in
    two places.
    """
    own = t.num_rows
    several = np.flatnonzero(t.column("count").to_numpy() >= 2)
    t = pa.concat_tables([t, t.take(pa.array(several))])
    s, at = unit.symbols(t.column("content").to_pylist())
    n, least = (t.column(c).to_numpy() for c in ("n", "least"))
    span = np.repeat(np.arange(len(n)), n)
    starts = at[:-1][span] + np.arange(len(span)) - np.repeat(np.cumsum(n) - n, n)
    cls = engine(s, starts, length)
    low = np.full(int(cls.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, cls, least[span])
    met = np.bincount(cls, minlength=len(low))
    if among == "occurrences":
        repeated, low = met[cls] >= 2, np.zeros(len(cls), np.int64)
    else:
        twice = np.zeros(len(n), bool)
        twice[several] = True
        low = low[cls]
        repeated = (met[cls] >= 2) & ((low < least[span]) | twice[span])
    mine = span < own  # the second copies have done their part
    span, repeated, low, n = span[mine], repeated[mine], low[mine], n[:own]
    new = np.ones(len(span), bool)
    new[1:] = (span[1:] != span[:-1]) | (repeated[1:] != repeated[:-1]) | (low[1:] != low[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(span))
    keep = repeated[begin]
    begin, end = begin[keep], end[keep]
    of = span[begin]
    first = np.cumsum(n) - n
    offsets = np.searchsorted(of, np.arange(len(n) + 1)).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array((begin - first[of]).astype(np.int32)), pa.array((end - first[of]).astype(np.int32)), pa.array(low[begin])], names=["a", "b", "least"])
    out = pa.table({"id": t.column("id").slice(0, own).combine_chunks(), "repeats": pa.ListArray.from_arrays(pa.array(offsets), items)})
    return out.filter(pa.array(np.diff(offsets) > 0))


def compared(spans: DataFrame, unit: type, length: int, widths: list[int], engine: Engine, among: str, bucket_units: int, most_units: int) -> DataFrame:
    """(id, repeats) of distinct spans (id, route, n, count, least, content) by the engine, in buckets of whole routes.

    Routes of more than `most_units` bytes are cut again by sub-windows of the next of `widths`. The last is `length`: then
    a route is one window, so any bucket has its bounds.
    """
    by_route = spans.groupBy("route").agg(F.sum(F.octet_length("content")).alias("size"))
    total, largest = by_route.agg(F.sum("size"), F.max("size")).first()
    fits, again = spans, None
    if (largest or 0) > most_units and widths:
        large = by_route.where(F.col("size") > most_units)
        fits, again = spans.join(large, "route", "left_anti"), spans.join(large, "route", "left_semi")
    buckets = common.groups_for(total, bucket_units)
    found = (
        fits.withColumn("bucket", F.pmod(F.hash("route"), F.lit(buckets)))
        .repartition(min(buckets, 16 * int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "bucket")  # a task takes its buckets one by one
        .groupBy("bucket")
        .applyInArrow(lambda t: compare(t, unit, length, engine, among), FOUND)
    )
    if again is None:
        return found
    parts = common.materialise(again.select("id", "count", "least", "content").mapInArrow(lambda it: cut_again(it, unit, length, widths[0]), AGAIN), "parts")
    count = F.sum("count") if among == "occurrences" else F.when((F.max("count") > 1) | (F.min("least") < F.max("least")), 2).otherwise(1).cast("long")
    distinct = parts.groupBy("route", "n", "content").agg(count.alias("count"), F.min("least").alias("least")).withColumn("id", F.monotonically_increasing_id())
    distinct = common.materialise(distinct, "part-contents")
    inner = compared(distinct, unit, length, widths[1:], engine, among, bucket_units, most_units)
    inner = inner.join(distinct.select("id", "route", "content"), "id")
    one = F.struct((F.col("start").cast("int") + F.col("r.a")).alias("a"), (F.col("start").cast("int") + F.col("r.b")).alias("b"), F.col("r.least").alias("least"))
    back = parts.select("parent", "start", "route", "content").join(inner, ["route", "content"]).select("parent", "start", F.explode("repeats").alias("r"))
    return found.union(back.groupBy(F.col("parent").alias("id")).agg(F.collect_list(one).alias("repeats")))


def find(docs: DataFrame, unit: type, length: int, k: int, engine: Engine, among: str, bucket_units: int, most_units: int) -> DataFrame:
    """(dkey, rid, covered): intervals [a, b) of units that repeated windows cover, for documents that have any.

    bucket_units: about how many bytes of distinct spans a bucket holds. most_units: routes with more are cut again.
    """
    same = ["route", "sub", "n"]
    keyed = docs.select(*common.row_key(), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    every = common.materialise(keyed.mapInArrow(lambda it: span_rows(it, unit, length, k), ROWS), "spans")
    if among == "occurrences":
        live = every.groupBy("route").agg(F.sum("met").alias("c")).where("c >= 2").select("route")
    else:
        live = every.groupBy("route").agg(F.min("dkey").alias("lo"), F.max("dkey").alias("hi")).where("lo < hi").select("route")
    rows = common.materialise(every.join(live, "route", "left_semi").drop("met"), "live")
    common.discard(every)

    def contents(rows: DataFrame) -> DataFrame:
        wanted = rows.groupBy("dkey", "rid").agg(F.collect_set(F.struct("route", "sub", "n", "start")).alias("spans"))
        return wanted.join(keyed, ["dkey", "rid"]).select("dkey", "rid", "text", "spans").mapInArrow(lambda it: cut_spans(it, unit, length), CUT)

    # equal bytes become one span, with map-side sums
    count = F.count("*") if among == "occurrences" else F.when(F.min("dkey") < F.max("dkey"), 2).otherwise(1).cast("long")
    distinct = contents(rows).groupBy(*same, "content").agg(count.alias("count"), F.min(_known("dkey")).alias("least"))
    distinct = common.materialise(distinct.withColumn("id", F.monotonically_increasing_id()), "contents")
    found = compared(distinct, unit, length, [(k + length) // 2, length], engine, among, bucket_units, most_units)
    found = common.materialise(found.join(distinct.select("id", *same), "id"), "repeats")
    # a document's span is known by its hash, unless several contents have that hash: then by its content
    unsure = common.materialise(distinct.groupBy(*same).count().where("count > 1").select(*same), "unsure")
    sure, places = rows, found
    if unsure.isEmpty():
        common.discard(distinct)
    else:
        sure, places = rows.join(unsure, same, "left_anti"), found.join(unsure, same, "left_anti")
    hits = sure.join(places, same).select("dkey", "rid", "start", F.explode("repeats").alias("r"))
    if sure is not rows:
        other = contents(rows.join(unsure, same, "left_semi")).join(distinct.select("id", *same, "content"), [*same, "content"]).join(found.select("id", "repeats"), "id")
        hits = hits.union(other.select("dkey", "rid", "start", F.explode("repeats").alias("r")))
    if among == "documents":  # a null doc_id is neither less nor greater than another
        hits = hits.where((F.col("r.least") < F.col("dkey")) & (F.col("dkey") != common.NULL_KEY))
    hits = hits.select("dkey", "rid", (F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.b") + (length - 1)).alias("b"))
    return hits.groupBy("dkey", "rid").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("covered"))


def _known(key: str) -> Column:
    """The key as least doc_id of a group: a null id must not win."""
    return F.when(F.col(key) == common.NULL_KEY, F.lit(2**63 - 1)).otherwise(F.col(key))


def merge(covered: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x in covered or ():
        if out and x["a"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x["b"])
        else:
            out.append([x["a"], x["b"]])
    return [(a, b) for a, b in out]


def cleaned(batches: Iterator[pa.RecordBatch], unit: type) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, text, covered): sizes, the removed intervals and what is kept."""
    for batch in common.sliced(batches, 1000):
        cols: list[list] = [[], [], [], []]
        for text, covered in zip(batch.column("text").to_pylist(), batch.column("covered").to_pylist(), strict=True):
            units, gone = unit.units(text), merge(covered)
            ends = [0, *(x for ab in gone for x in ab), len(units)]
            if unit is Bytes:
                kept = b"".join(units[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
            else:
                kept = b" ".join([unit.cut(units, a, b) for a, b in zip(ends[::2], ends[1::2], strict=True) if a < b])
            for c, x in zip(cols, (len(units), sum(b - a for a, b in gone), [{"a": a, "b": b} for a, b in gone], kept), strict=True):
                c.append(x)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_units", "n_removed", "removed", "kept"])


def remove(docs: DataFrame, unit: type, length: int, k: int, engine: Engine, among: str, bucket_units: int, most_units: int) -> DataFrame:
    found = find(docs, unit, length, k, engine, among, bucket_units, most_units)
    keyed = docs.select("doc_id", *common.row_key(), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return keyed.join(found, ["dkey", "rid"], "left").select("doc_id", "text", "covered").mapInArrow(
        lambda it: cleaned(it, unit), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_units long, n_removed long, removed array<struct<a:long,b:long>>, kept binary"
    )
