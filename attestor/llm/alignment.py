"""Aligns the tokens that two tokenizers make of the same texts.

Texts are cut where both tokenizers are sure to end a token, before a space that follows anything but white space; a segment's
tokens depend on nothing outside it, so each distinct segment of a block of documents is encoded and merged once. Two pointers
run over the cumulative ends of its tokens: places where both stand on the same end close a group, and each step is a link
between the tokens that they stand in. Spark counts the pairs of ids over all blocks, finds each id's most frequent partner,
and joins the counts back to the blocks.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A character, then all that is no space, or is a space after white space (or what B writes for a space) or at the end.
SEGMENT = r"(?s).(?:[^ ]+|(?<=[\s▁\x1c-\x1f]) | \Z)*"
#: Longer segments are not kept from one block to the next.
KEPT_CHARS = 64
#: Ends and starts of segments, which only those of a text have, over which white space may join what follows or goes before.
OPEN, OPEN_TO_ALL, SPACES = (re.compile(x) for x in (r"[\s▁\x1c-\x1f]\Z", r"[ ▁]\Z", r" [\s▁\x1c-\x1f]"))
Merged = tuple[int, int, int, str, bytes]  # tokens of A, of B, groups, the groups as text, links (each A's id << 32 | B's in eight bytes)


def merge(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The places of both pointers at each step, which are the links, and how many tokens of either side end with each group.

    Two pointers walk the ascending ends of both sides, that with the smaller end (or both) going on. All steps are made at once:
    the ends are merged (a stable sort of two runs only merges), and running counts of either side's are the pointers' places.
    """
    ends = np.concatenate([ends_a, ends_b])
    order = np.argsort(ends, kind="stable")
    ends, of_a = ends[order], order < len(ends_a)
    step = np.flatnonzero(np.r_[ends[1:] != ends[:-1], True]) if len(ends) else np.empty(0, np.int64)
    i, j = np.cumsum(of_a)[step], np.cumsum(~of_a)[step]
    from_i, from_j = np.r_[0, i][:-1], np.r_[0, j][:-1]
    both = (i > from_i) & (j > from_j)
    return from_i, from_j, i[both], j[both]


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Two tokenizers, the bytes of their tokens, and merged segments: a byte-level BPE (A) and a piece model that adds a space (B)."""

    def __init__(self, path_a: str, path_b: str, cache: int = 300_000):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        entries = {k: bytes(letters.get(c, 0) for c in x) for x, k in self.a.get_vocab().items()}
        self.bytes_a = [entries.get(k, b"") for k in range(max(entries) + 1)]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([*map(len, x)]) for x in (self.bytes_a, self.bytes_b))
        many = max(len(self.bytes_a), len(self.bytes_b))
        self.names = np.array([[f"{k}{mark}" for k in range(many)] for mark in (",", "|", ";", "\n")], object)
        self.local = self._ends_before_spaces(pieces)
        self.cut = re.compile(SEGMENT).findall if self.local else lambda text: [text]
        self.known: dict[str, Merged | None] = {}
        self.older: dict[str, Merged | None] = {}
        self.most = cache // 2

    def _ends_before_spaces(self, pieces: list[str]) -> bool:
        """Whether A splits by the pattern of byte-level BPE and no piece of B goes on with a space after anything else."""
        spec = json.loads(self.a.to_str())
        before = spec["pre_tokenizer"] or {}
        return spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not any("▁" in x.lstrip("▁") for x in pieces)

    def learn(self, segments: list[str]) -> list[Merged | None]:
        """What becomes of each of these segments: None if the bytes of either side's tokens aren't those of the segment."""
        known = [*map(self.known.get, segments)]
        out: dict[str, Merged | None] = {}
        new = []
        for s in (segments[k] for k, m in enumerate(known) if m is None):
            if s in self.known:
                out[s] = None
            elif s in self.older:
                out[s] = self.known[s] = self.older[s]
            else:
                new.append(s)
        ends, alone = [], []
        if self.local:  # white space at an end goes before none but one space and a word, spaces and the like before nothing
            ends = [s for s in new if OPEN.search(s[-1:])]
            alone = [s for s in ends if OPEN_TO_ALL.search(s[-1:]) or SPACES.match(s)]
            apart, last = {*ends}, {*alone}
            new, ends = [s for s in new if s not in apart], [s for s in ends if s not in last]
        for part in (new, ends):
            for at in range(0, len(part), 1024):
                self._encode(part[at : at + 1024], out)
        for s in alone:
            self._encode([s], out)
        self.known.update((s, out[s]) for s in chain(new, ends, alone) if len(s) <= KEPT_CHARS)
        if len(self.known) > self.most:  # what was used since the last time stays
            self.known, self.older = {}, self.known
        return [out[s] if m is None else m for s, m in zip(segments, known, strict=True)]

    def _encode(self, segments: list[str], out: dict[str, Merged | None]) -> None:
        """Encodes segments as one text, where none depends on what surrounds it, and halves them where bytes aren't given back."""
        if not self.local and len(segments) > 1:
            for s in segments:
                self._encode([s], out)
            return
        text = "".join(segments)
        a, b = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:])
        raw = text.encode()
        if b"".join([self.bytes_a[k] for k in a]) == raw and b"".join([self.bytes_b[k] for k in b]) == raw:
            self._merge(segments, np.array(a, np.int64), np.array(b, np.int64), out)
        elif len(segments) == 1:
            out[segments[0]] = None
        else:
            self._encode(segments[: len(segments) // 2], out)
            self._encode(segments[len(segments) // 2 :], out)

    def _merge(self, segments: list[str], a: np.ndarray, b: np.ndarray, out: dict[str, Merged | None]) -> None:
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        at_a, at_b, group_a, group_b = merge(ends_a, ends_b)
        pairs = (a[at_a] << 32 | b[at_b]).tobytes()
        ends = np.cumsum([len(s) if s.isascii() else len(s.encode()) for s in segments])
        i, j, g = (np.r_[0, np.searchsorted(x, ends, "right")] for x in (ends_a, ends_b, ends_a[group_a - 1]))
        k = [0, *(8 * np.searchsorted(at_a, i[1:])).tolist()]
        # as text: a group's tokens of A, then those of B; what follows a token tells whether it is its side's last, its group's, its segment's
        after_a, after_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        after_a[group_a - 1], after_b[group_b - 1], after_b[j[1:] - 1] = 1, 2, 3
        place_a = np.arange(len(a)) + np.r_[0, group_b][np.searchsorted(group_a, np.arange(len(a)), "right")]
        place_b = np.arange(len(b)) + group_a[np.searchsorted(group_b, np.arange(len(b)), "right")]
        names = np.empty(len(a) + len(b), object)
        names[place_a], names[place_b] = self.names[after_a, a], self.names[after_b, b]
        counts = (np.diff(x).tolist() for x in (i, j, g))
        groups = "".join(names.tolist()).split("\n")[:-1]
        links = map(pairs.__getitem__, map(slice, k[:-1], k[1:]))
        out.update(zip(segments, zip(*counts, groups, links, strict=True), strict=True))


DOCUMENT = "id string, groups string, n_a long, n_b long, n_groups long, n_links long"
BLOCK = f"block long, documents array<struct<{DOCUMENT.replace(' ', ':').replace(',:', ',')}>>, doc_ends binary, segments binary, pair_ends binary, pairs binary, a array<int>, b array<int>, n array<long>"


def _packed(x: np.ndarray) -> bytes:
    """The integers in two or four bytes each; the first byte tells how many."""
    kind = np.uint16 if x.max(initial=0) < 1 << 16 else np.uint32
    return bytes([kind().itemsize]) + x.astype(kind).tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint16 if x[0] == 2 else np.uint32, offset=1).astype(np.int64)


class Places(dict[str, int]):
    """The place of each distinct segment, in the order in which they come."""

    def __missing__(self, segment: str) -> int:
        self[segment] = place = len(self)
        return place


@contextmanager
def _uncollected() -> Iterator[None]:
    """Python doesn't look for cycles meanwhile: a block's many small objects make none, and the search goes through all that are kept."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


@_uncollected()
def _block(number: int, ids: list[str | None], texts: list[str | None], t: Tokenizers) -> dict[str, object]:
    """Each document as places of its segments among the block's distinct ones, and each of these with the places of its links among the block's pairs."""
    place = Places()
    of = [[*map(place.__getitem__, t.cut(" " + text))] if text else [] for text in texts]
    merged = t.learn([*place])
    bad = {k for k, m in enumerate(merged) if m is None}
    if bad:
        of = [[] if bad.intersection(doc) else doc for doc in of]
        merged = [m or (0, 0, 0, "", b"") for m in merged]
    *counts, written, links = zip(*merged, strict=True) if merged else [()] * 5
    doc_ends = np.cumsum([0, *map(len, of)])[1:]
    flat = np.fromiter(chain.from_iterable(of), np.int64, doc_ends[-1])
    many = np.array([*map(len, links)], np.int64) // 8
    pair, at = np.unique(np.frombuffer(b"".join(links), np.int64), return_inverse=True)
    used = np.bincount(flat, minlength=len(merged))
    n = np.bincount(at, np.repeat(used, many), len(pair)).astype(np.int64)  # whole numbers below 2 ** 53
    total = [_sums(np.array(x, np.int64)[flat], doc_ends).tolist() for x in (*counts, many)]
    groups = [";".join(map(written.__getitem__, doc)) for doc in of]
    return {
        "block": number, "documents": [*zip(ids, groups, *total, strict=True)], "doc_ends": _packed(doc_ends), "segments": _packed(flat),
        "pair_ends": _packed(np.cumsum(many)), "pairs": _packed(at), "a": pair >> 32, "b": pair & 0xFFFFFFFF, "n": n,
    }


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of the values of each part; parts end at `ends`."""
    total = np.r_[0, np.cumsum(values)]
    return total[ends] - total[np.r_[0, ends[:-1]]] if len(ends) else np.zeros(0, np.int64)


COUNTED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "n_best_a", "count_sum"]


def _documents(r: object, n: np.ndarray, most_a: np.ndarray, most_b: np.ndarray) -> pd.DataFrame:
    """A block's documents with sums over their segments; n, most_a, most_b: of each pair of the block."""
    segments, doc_ends, pairs, pair_ends = map(_unpacked, (r.segments, r.doc_ends, r.pairs, r.pair_ends))
    out = pd.DataFrame([*map(dict, r.documents)] if isinstance(r.documents[0], dict) else [*r.documents])
    for name, each in (("n_best", n == most_b), ("n_best_a", n == most_a), ("count_sum", n)):
        out[name] = _sums(_sums(each.astype(np.int64)[pairs], pair_ends)[segments], doc_ends)
    return out


def align(docs: DataFrame, path_a: str, path_b: str, keep: Callable[[Column], Column] = lambda groups: groups, at_once: int = 1 << 20, most_sent: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Two tables. Documents: doc_id, groups, n_a, n_b, n_groups, n_links, n_best, n_best_a, count_sum. Pairs: a, b, n, most_a, most_b.

    A encodes a space and the text, B the text, to which it adds the space; neither adds special tokens, and their strings in a
    text are plain text. Byte offsets where tokens of both sides end cut these into groups, written as `a1,a2|b1;a3|b2,b3`
    (`keep` makes of it what goes on, a digest, say). A link is a pair of tokens whose bytes overlap. n: how many links of all
    documents join these two ids; most_a, most_b: the highest n of the id of that side. n_best: a document's links whose n is
    the highest of their B id, ties included (n_best_a: of their A id); count_sum: the sum of n over its links.

    Up to `most_sent` distinct pairs of ids go to all tasks; more are joined to the blocks that hold them.

    Null and empty texts, and those whose bytes the tokens of either side don't give back, have no tokens: zeros and an empty
    text. A text of any length is aligned whole; rows that repeat a doc_id or have none are aligned one by one (and all count);
    an empty table gives empty ones; other columns are ignored. Documents are handled in blocks of about `at_once` characters.
    """

    def aligned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = Tokenizers(path_a, path_b)
        number = TaskContext.get().partitionId() << 33
        ids, texts, chars = [], [], 0
        for frame in frames:
            for id_, text in zip(frame["id"], frame["text"], strict=True):
                ids.append(id_)
                texts.append(text)
                chars += len(text or "") + 1
                if chars >= at_once:
                    yield pd.DataFrame([_block(number, ids, texts, t)])
                    number, ids, texts, chars = number + 1, [], [], 0
        if ids:
            yield pd.DataFrame([_block(number, ids, texts, t)])

    blocks = docs.selectExpr("cast(doc_id as string) id", "text").mapInPandas(aligned, BLOCK)
    kept = lambda d: F.struct(d.id.alias("id"), keep(d.groups).alias("groups"), *(d[x].alias(x) for x in ("n_a", "n_b", "n_groups", "n_links")))
    blocks = common.materialise(blocks.withColumn("documents", F.transform("documents", kept)), "blocks")
    each = blocks.select("block", F.posexplode(F.arrays_zip("a", "b", "n")).alias("place", "x")).select("block", "place", "x.*")
    pairs = common.materialise(each.groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    most = lambda side: pairs.groupBy(side).agg(F.max("n").alias(f"most_{side}"))
    pairs = common.materialise(pairs.join(most("a"), "a").join(most("b"), "b").select("a", "b", "n", "most_a", "most_b"), "counted-pairs")
    if pairs.count() <= most_sent:
        out = _with_all_pairs(blocks.drop("n"), pairs)
    else:
        out = _with_own_pairs(blocks.drop("a", "b", "n"), each.drop("n").join(pairs, ["a", "b"]))
    return out.select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "groups", *COUNTED), pairs


def _output(blocks: DataFrame) -> str:
    kind = blocks.schema["documents"].dataType.elementType["groups"].dataType.simpleString()
    return f"id string, groups {kind}, " + ", ".join(f"{x} long" for x in COUNTED)


def _with_all_pairs(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Looks pairs up in a table that each task holds whole, in the order of a and b."""
    t = pairs.orderBy("a", "b").toArrow()
    columns = [np.asarray(t.column(x).to_numpy(), np.int64) for x in ("a", "b", "n", "most_a", "most_b")]
    sent = blocks.sparkSession.sparkContext.broadcast((columns[0] << 32 | columns[1], *columns[2:]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, *values = sent.value
        for frame in frames:
            for r in frame.itertuples():
                at = np.searchsorted(key, np.asarray(r.a, np.int64) << 32 | np.asarray(r.b, np.int64))
                yield _documents(r, *(x[at] for x in values))

    return blocks.mapInPandas(run, _output(blocks))


def _with_own_pairs(blocks: DataFrame, each: DataFrame) -> DataFrame:
    """Joins to each block the counts of its own pairs, in their order: as many as its characters allow."""
    listed = F.array_sort(F.collect_list(F.struct("place", "n", "most_a", "most_b")))
    found = each.groupBy("block").agg(listed.alias("x")).select("block", *(F.col(f"x.{x}").alias(x) for x in ("n", "most_a", "most_b")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                yield _documents(r, *(np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in (r.n, r.most_a, r.most_b)))

    return blocks.join(found, "block", "left").mapInPandas(run, _output(blocks))
