"""Secret scans with a trigram inverted index."""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants, _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The kinds in order, with pattern, flags and the least length of the match or (assign) of its group 2.
RULES: list[tuple[str, str, int, int, int]] = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 12),
    ("access", r"AKIA[A-Z0-9]+", re.A, 0, 18),
    ("hex", r"[0-9a-f]+", re.A, 0, 16),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", re.A, 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", re.A, 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", re.A, 0, 20),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", re.A, 0, 30),
]

#: A Boolean query: alternatives, each a set of trigrams that all must occur. [frozenset()] is true of every text.
Query = list[frozenset[str]]
TRUE: Query = [frozenset()]
#: More literal strings than this are not multiplied out.
MANY = 64


def _least(q: Query) -> Query:
    """Without alternatives that another one implies."""
    q = sorted(set(q), key=len)
    return [x for i, x in enumerate(q) if not any(y <= x for y in q[:i])]


def _and(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MANY**2:
        return a if min(map(len, a)) >= min(map(len, b)) else b
    return _least([x | y for x in a for y in b])


def _of_strings(strings: set[str]) -> Query:
    """Only ASCII trigrams are asked for: the index folds the case of A-Z alone."""
    return _least([frozenset(s[i : i + 3] for i in range(len(s) - 2) if s[i : i + 3].isascii()) for s in strings])


def _node(op, av) -> tuple[set[str] | None, Query]:
    """(the strings it matches, if few; what any match must contain)."""
    if op is _constants.LITERAL:
        return {chr(av).lower()}, TRUE
    if op is _constants.IN:
        chars = {chr(v).lower() for o, v in av if o is _constants.LITERAL}
        return (chars, TRUE) if len(chars) <= MANY and all(o is _constants.LITERAL for o, _ in av) else (None, TRUE)
    if op is _constants.SUBPATTERN:
        return _sequence(av[-1])
    if op is _constants.BRANCH:
        parts = [_sequence(p) for p in av[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MANY:
            return set().union(*(s for s, _ in parts)), TRUE
        return None, _least([x for s, q in parts for x in (q if s is None else _of_strings(s))])
    if op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT):
        low, high, inner = av
        strings, query = _sequence(inner)
        if high == 1 and strings is not None:
            return (strings | {""} if low == 0 else strings), TRUE
        if low == 0:
            return None, TRUE
        return None, query if strings is None else _of_strings(strings)
    if op is _constants.AT:
        return {""}, TRUE
    return None, TRUE


def _sequence(nodes) -> tuple[set[str] | None, Query]:
    run, query, whole = {""}, TRUE, True
    for op, av in nodes:
        strings, inner = _node(op, av)
        if strings is not None and len(run) * len(strings) <= MANY:
            run = {a + b for a in run for b in strings}
            continue
        query, whole = _and(_and(query, _of_strings(run)), inner), False
        run = strings if strings is not None else {""}
    return (run, TRUE) if whole else (None, _and(query, _of_strings(run)))


def trigram_query(pattern: str, flags: int) -> Query:
    """The trigrams, in lower case, that every text with a match contains; TRUE if none are mandatory."""
    strings, query = _sequence(_parser.parse(pattern, flags))
    query = query if strings is None else _of_strings(strings)
    if flags & re.I and not flags & re.A:  # there i, k and s match letters beyond ASCII as well
        query = _least([frozenset(t for t in x if not set(t) & set("iks")) for x in query])
    return query


#: A segment is indexed by parts of so many bytes.
PART = 1 << 22


class Scanner:
    def __init__(self, rules: list[tuple[str, str, int, int, int]]):
        self.rules = [(kind, re.compile(p, flags), group, least, trigram_query(p, flags)) for kind, p, flags, group, least in rules]
        self.trigrams = sorted({t for *_, q in self.rules for x in q for t in x})
        self.number = np.zeros(1 << 24, np.uint16)  # of each trigram's 24 bits, from 1
        for i, t in enumerate(self.trigrams):
            self.number[int.from_bytes(t.encode(), "big")] = i + 1

    def _numbers(self, raw: bytes) -> np.ndarray:
        b = np.frombuffer(raw, np.uint8).astype(np.int32)
        return self.number[(b[:-2] << 16) | (b[1:-1] << 8) | b[2:]]

    def postings(self, texts: list[str]) -> dict[str, np.ndarray]:
        """The inverted index of this segment: for each trigram that a query names the texts that hold it, in order.

        One pass over the bytes. Texts lie side by side, parted by two zeros, which no named trigram holds.
        """
        pairs = [np.empty(0, np.int64)]
        part: list[bytes] = []
        first = size = 0
        for i, text in enumerate(texts):
            raw = text.encode().lower()
            part.append(raw)
            size += len(raw)
            if size < PART and i < len(texts) - 1:
                continue
            joined = b"\0\0".join(part)
            start = np.cumsum([0, *(len(x) + 2 for x in part[:-1])])
            for at in range(0, len(joined), PART):
                number = self._numbers(joined[at : at + PART + 2])
                hit = np.flatnonzero(number)
                doc = first + np.searchsorted(start, hit + at, "right") - 1
                pairs.append(np.unique(number[hit].astype(np.int64) * len(texts) + doc))
            first, part, size = i + 1, [], 0
        number, doc = np.divmod(np.unique(np.concatenate(pairs)), max(1, len(texts)))
        cut = np.searchsorted(number, np.arange(1, len(self.trigrams) + 2))
        return {t: doc[cut[i] : cut[i + 1]] for i, t in enumerate(self.trigrams)}

    def candidates(self, texts: list[str]) -> list[np.ndarray]:
        """For each rule the texts to verify: postings intersected and united as its query says."""
        everything = np.arange(len(texts))
        postings = self.postings(texts)
        out = []
        for *_, query in self.rules:
            hits = []
            for alternative in query:
                rows = everything
                for t in sorted(alternative, key=lambda t: len(postings[t])):
                    rows = np.intersect1d(rows, postings[t], assume_unique=True)
                hits.append(rows)
            out.append(np.unique(np.concatenate(hits)) if hits else everything[:0])
        return out

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Of each text (start, number of the rule, end), in order."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for number, ((_, pattern, group, least, _), rows) in enumerate(zip(self.rules, self.candidates(texts), strict=True)):
            for i in rows.tolist():
                for m in pattern.finditer(texts[i]):
                    if m.end(group) - m.start(group) >= least:
                        found[i].append((m.start(), number, m.end()))
        for x in found:
            x.sort()
        return found


def scan(docs: DataFrame, rules: list[tuple[str, str, int, int, int]] | None = None, segment: int = 2000) -> DataFrame:
    """A row per document: doc_id and spans, an array of (kind, start, end) in code points, by start and then kind.

    Each segment of documents gets an inverted index of the trigrams that the rules' Boolean queries name. A rule's
    candidates come from its postings and are verified by the regular expression over the whole text; a rule without
    mandatory trigrams scans every text. Matches of a kind are leftmost and don't overlap; too short ones are dropped, but
    use up their text. Null text counts as empty; very long texts are indexed by parts and verified whole; an empty table
    gives no rows; rows are independent, so repeated rows and null ids stay as they are;
    other columns are ignored.
    """
    rules = rules or RULES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        names = [r[0] for r in rules]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in common.sliced(batches, segment):
            spans = [[{"kind": names[k], "start": s, "end": e} for s, k, e in x] for x in scanner.scan(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")
