"""Runs of repeated words: Crochemore's partition refinement of equal factors.

Positions are put into classes of equal factors of 1, 2, 3, ... words. Two neighbouring members of a class, at a distance equal
to the factors' length, are a square with a primitive root; squares of one period that start at consecutive words are one run.
A class of factors one word longer is split off by the classes that follow its members by one word. Only those parts need be
looked at that were not the largest of the class they came from, so a position is touched at most log2(n) times.

The first three levels are done for a whole batch of documents at once, by sorting. What can't be part of a long run is left
out after that: most texts end there. The rest goes on stretch by stretch with linked lists.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import common

#: A run has so many words at least, and so many times its period.
SHORTEST, TIMES = 6, 4
#: Levels that are refined for all documents of a batch at once.
TOGETHER = 3
Run = tuple[int, int, int]  # start, length, period


def squares(codes: list[int], level: int, most: int) -> Iterator[tuple[int, list[int]]]:
    """For each period p of level + 1 to `most`: p and the places, ascending, whose next equal factor of p words is p further on.

    Periods with too few such places for a run of TIMES * p words are left out.
    codes: the classes of equal factors of `level` words at each place; a factor that passes the end is equal to no other. Ends
    early once too few places are left that equal another for a run of TIMES * p words.
    """
    n = len(codes)
    members: dict[int, list[int]] = defaultdict(list)
    for i, c in enumerate(codes):
        members[c].append(i)
    of, before, after = [0] * n, [-1] * n, [-1] * n
    size, head = [], []
    due: dict[int, list[int]] = defaultdict(list)  # places whose next member was so far away when it last changed
    for k, at in enumerate(members.values()):
        size.append(len(at))
        head.append(at[0])
        for i in at:
            of[i] = k
        for i, j in pairwise(at):
            after[i], before[j] = j, i
            if level < j - i <= most:
                due[j - i].append(i)
    live = n - size.count(1)
    small = [*members.values(), [n]]
    for p in range(level + 1, most + 1):
        if live <= (TIMES - 1) * p:
            return
        parts: dict[int, list[int]] = {}
        for splitter in small:
            met: dict[int, list[int]] = {}
            for j in splitter:
                if j:
                    met.setdefault(of[j - 1], []).append(j - 1)
            for c, at in met.items():
                if len(at) == size[c]:
                    continue
                new = len(size)
                parts.setdefault(c, [c]).append(new)
                size[c] -= len(at)
                size.append(len(at))
                head.append(at[0])
                last = -1
                for i in at:
                    of[i] = new
                    b, a = before[i], after[i]
                    if b < 0:
                        head[c] = a
                    else:
                        after[b] = a
                    if a >= 0:
                        before[a] = b
                        if b >= 0 and p <= a - b <= most:
                            due[a - b].append(b)
                    before[i] = last
                    if last >= 0:
                        after[last] = i
                        if p <= i - last <= most:
                            due[i - last].append(last)
                    last = i
                after[last] = -1
        small = []
        for ids in parts.values():
            largest = max(ids, key=size.__getitem__)
            for k in ids:
                live -= size[k] == 1
                if k != largest:
                    at, i = [], head[k]
                    while i >= 0:
                        at.append(i)
                        i = after[i]
                    small.append(at)
        if len(at := {i for i in due.pop(p, ()) if after[i] == i + p}) > (TIMES - 2) * p:
            yield p, sorted(at)


def _stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of True begin and how long they are."""
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False]))
    return edge[::2], edge[1::2] - edge[::2]


def _of_squares(at: np.ndarray, many: np.ndarray, period: int) -> Iterator[Run]:
    """The runs of squares that start at `many` consecutive words from `at` on, if they are long enough."""
    length = many + 2 * period - 1
    ok = length >= max(SHORTEST, TIMES * period)
    for a, n in zip(at[ok].tolist(), length[ok].tolist(), strict=True):
        yield a, n, period


def _classes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each value's class and how far its next member is (0: it is the last)."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    number, gap = np.empty(len(key), np.int64), np.zeros(len(key), np.int64)
    number[order] = np.cumsum(np.r_[False, ~same])
    gap[order[:-1][same]] = np.diff(order)[same]
    return number, gap


def runs_of(docs: list[list[int]]) -> list[list[Run]]:
    """The runs (start, length, period) of each document, given as numbers of its words, by start and period."""
    out: list[list[Run]] = [[] for _ in docs]
    length = np.fromiter(map(len, docs), np.int64, len(docs))
    begin = np.cumsum(length) - length
    doc = np.repeat(np.arange(len(docs)), length)
    if not len(doc):
        return out
    words = np.fromiter(chain.from_iterable(docs), np.int64, len(doc))
    last = (begin + length - 1)[doc]  # each word's last of its document
    place, longest = np.arange(len(doc)), (length // TIMES)[doc]

    def found(runs: Iterator[Run]) -> None:
        for start, n, period in runs:
            out[doc[start]].append((start - int(begin[doc[start]]), n, period))

    number, gap = _classes(doc * (int(words.max()) + 1) + words)
    found(_of_squares(*_stretches(gap == 1), 1))
    for p in range(2, TOGETHER + 1):
        inside = place <= last - (p - 1)  # a factor that passes the end is a class of its own
        follow = np.where(inside, number[np.minimum(place + 1, len(doc) - 1)], -1 - place)
        number, gap = _classes(number * (2 * len(doc) + 2) + follow)
        found(_of_squares(*_stretches(gap == p), p))
    # a run of a longer period q has 2q + 1 places at least whose next equal factor is q further on at most
    for a, m in zip(*(x.tolist() for x in _stretches((gap > 0) & (gap <= longest))), strict=True):
        if m > 2 * TOGETHER + 2:
            end = min(a + 2 * m, int(last[a]) + 1)
            for p, at in squares(number[a:end].tolist(), TOGETHER, min((m - 1) // 2, (end - a) // TIMES)):
                mine = np.zeros(m, bool)
                mine[[i for i in at if i < m]] = True
                first, many = _stretches(mine)
                found(_of_squares(a + first, many, p))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def _collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words but those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, n, period in runs:
        kept[start + period : start + n] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def find(docs: DataFrame, prepare: Callable[[object, list[bytes]], list[bytes]] | None = None, at_once: int = 1 << 18) -> DataFrame:
    """A row per document: doc_id, n_words, runs (array of start, length, period; by start, then period) and collapsed.

    Words are maximal runs of anything but ASCII white space. A run is a stretch of words with a smallest period q that is at
    least 6 words and 4 periods long and that no neighbouring word extends; `collapsed` is the text without the words that a
    run holds after its first q, joined by a space. `prepare` may make other words of a document's (doc_id, words) first. Batches of about
    `at_once` words are refined together; documents never mix.

    Null, empty and blank texts have no words and no runs; a text of any length is refined whole; rows that repeat a doc_id or
    have none are judged one by one; an empty table gives none; other columns are ignored.
    """
    kind = docs.schema["doc_id"]
    run = StructType([StructField(x, LongType()) for x in ("start", "length", "period")])
    schema = StructType([kind, StructField("n_words", LongType()), StructField("runs", ArrayType(run)), StructField("collapsed", StringType())])
    arrow = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))

    def judged(held: list[tuple[object, list[bytes]]]) -> list[list[Run]]:
        number: dict[bytes, int] = defaultdict(count().__next__)
        return runs_of([[*map(number.__getitem__, words)] for _, words in held])

    def refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[object, list[bytes]]] = []
        many, type_ = 0, None

        def out() -> pa.RecordBatch:
            runs = judged(held)
            texts = [_collapsed(words, r) for (_, words), r in zip(held, runs, strict=True)]
            n = pa.array([len(words) for _, words in held], pa.int64())
            rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in runs]
            return pa.RecordBatch.from_arrays([pa.array([d for d, _ in held], type_), n, pa.array(rows, arrow), pa.array(texts, pa.binary()).cast(pa.string())], names=schema.names)

        for b in batches:
            type_ = b.schema.field(0).type
            for i in range(b.num_rows):
                doc_id, words = b.column(0)[i].as_py(), (b.column(1)[i].as_py() or b"").split()
                held.append((doc_id, prepare(doc_id, words) if prepare else words))
                many += len(held[-1][1])
                if many >= at_once:
                    yield out()
                    held, many = [], 0
        if held:
            yield out()

    return docs.selectExpr("doc_id", "cast(text as binary) text").mapInArrow(lambda x: refined(common.sliced(x)), schema)
