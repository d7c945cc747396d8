"""Token counts that follow edits: only what an edit touches is encoded again."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from . import common
from .bpe import Encoder, encoder

#: A pre-token's end depends on two characters after it at most: the white-space rules look past the next one.
LOOK = 2


class SumTree:
    """A segment tree over the pre-tokens of a document: characters and tokens below each node.

    A leaf begins as one pre-token. An edit that replaces leaves i to j puts all new pre-tokens into leaf i and empties the
    others, so that the tree keeps its shape and only their paths change.
    """

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.n = len(chars)
        self.edited: dict[int, list[tuple[int, int]]] = {}
        level = np.zeros((1 << max(0, self.n - 1).bit_length(), 2), np.int64)
        level[: self.n, 0], level[: self.n, 1] = chars, tokens
        self.levels = [level]
        while len(level) > 1:
            level = level[::2] + level[1::2]
            self.levels.append(level)

    def parts(self, leaf: int) -> list[tuple[int, int]]:
        """(characters, tokens) of the pre-tokens in a leaf."""
        if leaf in self.edited:
            return self.edited[leaf]
        chars, tokens = self.levels[0][leaf].tolist()
        return [(chars, tokens)]

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of every pre-token, in order: what a tree is kept as."""
        out, at = [], 0
        for leaf in sorted(self.edited):
            out += [self.levels[0][at:leaf], np.array(self.edited[leaf], np.int64).reshape(-1, 2)]
            at = leaf + 1
        both = np.concatenate([*out, self.levels[0][at : self.n]])
        return both[:, 0], both[:, 1]

    @property
    def tokens(self) -> int:
        return int(self.levels[-1][0, 1])

    def before(self, leaf: int) -> int:
        """Characters before a leaf."""
        out = 0
        for level in self.levels[:-1]:
            if leaf & 1:
                out += int(level[leaf - 1, 0])
            leaf >>= 1
        return out

    def leaf_at(self, char: int) -> int:
        """The leaf that holds a character; the last with any if there is none."""
        node = 0
        for level in self.levels[-2::-1]:
            node *= 2
            left = int(level[node, 0])
            if char >= left and level[node + 1, 0] > 0:
                char -= left
                node += 1
        return min(node, max(0, self.n - 1))

    def put(self, first: int, last: int, parts: list[tuple[int, int]]) -> None:
        """Replaces leaves first to last (inclusive)."""
        for leaf in range(first, last + 1):
            self.edited[leaf] = parts if leaf == first else []
            new = (sum(c for c, _ in self.edited[leaf]), sum(t for _, t in self.edited[leaf]))
            delta = np.array(new) - self.levels[0][leaf]
            if delta.any():
                at = leaf
                for level in self.levels:
                    level[at] += delta
                    at >>= 1


class Document:
    """A text and its tree."""

    def __init__(self, text: str, words: list[str], ids: list[bytes], enc: Encoder, pattern: regex.Pattern, tree: SumTree | None = None):
        self.text, self.enc, self.pattern, self.encoded = text, enc, pattern, 0
        self.tree = tree or SumTree(*sizes(words, ids))

    def edit(self, start: int, stop: int, insert: str) -> None:
        """Replaces characters start to stop (exclusive). Positions are cut to the text."""
        start = min(max(start, 0), len(self.text))
        stop = min(max(stop, start), len(self.text))
        grow = len(insert) - (stop - start)
        self.text = self.text[:start] + insert + self.text[stop:]
        tree = self.tree
        if not tree.n:
            words = self.pattern.findall(self.text)
            self.tree = SumTree(*sizes(words, self._encode(words)))
            return
        first = tree.leaf_at(max(0, start - LOOK - 1))
        begin = tree.before(first)
        while first and begin + 1 > start - LOOK:
            first -= 1
            begin = tree.before(first)
        last, old, parts, words, at = first - 1, [begin], [], [], begin
        while True:
            if at >= start + len(insert):  # beyond the edit: stop where an old pre-token began
                while old[-1] < at - grow:
                    last += 1
                    parts += tree.parts(last)
                    old += list(accumulate((c for c, _ in tree.parts(last)), initial=old[-1]))[1:]
                i = bisect_left(old, at - grow)
                if old[i] == at - grow:
                    break
            word = self.pattern.match(self.text, at)[0]
            words.append(word)
            at += len(word)
        if last < first and words:  # an insertion between two leaves joins the second
            last, parts = first, tree.parts(first)
        if last >= first:
            tree.put(first, last, [*((len(w), len(x) // 4) for w, x in zip(words, self._encode(words), strict=True)), *parts[i:]])

    def _encode(self, words: list[str]) -> list[bytes]:
        self.encoded += len(words)
        new = {w for w in words if w not in self.enc.cache}
        if new:
            if len(self.enc.cache) + len(new) > self.enc.most:
                new = set(words)
            self.enc.learn(new)
        return [self.enc.cache[w] for w in words]


def sizes(words: list[str], ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of each pre-token."""
    return np.fromiter(map(len, words), np.int64, len(words)), np.fromiter(map(len, ids), np.int64, len(ids)) // 4


def _tree_schema(docs: DataFrame, *first: str) -> StructType:
    counts = [StructField(x, LongType()) for x in first]
    return StructType([docs.schema["doc_id"], *counts, StructField("text", StringType()), *(StructField(x, ArrayType(IntegerType())) for x in ("chars", "tokens"))])


def _arrays(columns: list[np.ndarray]) -> pa.Array:
    return pa.array([x.astype(np.int32) for x in columns], pa.list_(pa.int32()))


def plant(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """A row per document: doc_id, text, and its tree as leaves: chars and tokens of each pre-token. To be written and kept.

    Null text counts as empty and has no leaves; rows are independent, so repeated rows and null ids stay as they are; very
    long texts are read whole; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches):
            leaves = [sizes(words, ids) for part in encoder(path, pattern).pieces(b.column(1).to_pylist()) for words, ids in part]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _arrays([c for c, _ in leaves]), _arrays([t for _, t in leaves])], names=["doc_id", "text", "chars", "tokens"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, _tree_schema(docs))


def revise(trees: DataFrame, path: str, pattern: str, edits: str = "edits", keep: bool = True) -> DataFrame:
    """Applies edits to kept trees: only what they touch is encoded again, and sums follow along the paths of the tree.

    trees: plant() (or an earlier revise()) and a column of edits, an array of (start, stop, insert) in order; positions are
    characters of the text as the edits before left it, and are cut to it. Join only the documents that have edits: no other
    need be read. Null edits count as none, a null insert as empty. Returns a row per document: doc_id, n_tokens,
    n_tokens_edited, n_pretokens, n_reencoded (the pre-tokens that the edits made it encode again) and, with `keep`, the new
    text, chars and tokens.
    """
    counts = ("n_tokens", "n_tokens_edited", "n_pretokens", "n_reencoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for b in common.sliced(batches):
            enc = encoder(path, pattern)
            rows, texts, leaves = [], [], []
            for text, chars, tokens, wanted in zip(b.column(1).to_pylist(), b.column(2), b.column(3), b.column(4).to_pylist(), strict=True):
                doc = Document(text, [], [], enc, compiled, SumTree(np.asarray(chars.values), np.asarray(tokens.values)))
                before, many = doc.tree.tokens, doc.tree.n
                for e in wanted or ():
                    if e is not None:
                        doc.edit(e["start"] or 0, e["stop"] or 0, e["insert"] or "")
                rows.append((before, doc.tree.tokens, many, doc.encoded))
                if keep:
                    texts.append(doc.text)
                    leaves.append(doc.tree.leaves())
            cols = [pa.array(c, pa.int64()) for c in (list(zip(*rows, strict=True)) or [(), (), (), ()])]
            kept = [pa.array(texts, pa.string()), _arrays([c for c, _ in leaves]), _arrays([t for _, t in leaves])] if keep else []
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, *kept], names=["doc_id", *counts, *(("text", "chars", "tokens") if keep else ())])

    schema = _tree_schema(trees, *counts)
    return trees.select("doc_id", "text", "chars", "tokens", F.col(edits).alias("edits")).mapInArrow(run, schema if keep else StructType(schema.fields[:5]))


def count(docs: DataFrame, path: str, pattern: str, edits: str = "edits") -> DataFrame:
    """plant() and revise() in one, for documents that come with their edits; nothing is kept."""
    planted = plant(docs.select(F.struct("doc_id", F.col(edits).alias("edits")).alias("doc_id"), "text"), path, pattern)
    return revise(planted.select("doc_id.doc_id", "text", "chars", "tokens", "doc_id.edits"), path, pattern, keep=False)


def revision_edits() -> F.Column:
    """The edits of a production revision: a heading is put in front, 16 characters at the middle go, a note is appended."""
    n = F.char_length(F.coalesce("text", F.lit("")))
    edit = lambda a, b, x: F.struct(a.cast("int").alias("start"), b.cast("int").alias("stop"), F.lit(x).alias("insert"))
    half = F.floor((n + 10) / 2)
    return F.array(edit(F.lit(0), F.lit(0), "# Revised\n"), edit(half, half + 16, ""), edit(n + 10, n + 10, "\n\nRevised text; see the first version."))
