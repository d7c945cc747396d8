"""Substring dedup of words, by prefix-partitioned suffix trees."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import winnow


def prefix_groups(s: np.ndarray, starts: np.ndarray, most: int, depth: int) -> list[tuple[np.ndarray, int]]:
    """Splits suffixes into groups of `most` at most by prefixes of varying length (`depth` at most); groups of one go."""
    out, stack = [], [(starts, 0)]
    while stack:
        group, d = stack.pop()
        if len(group) <= most or d == depth:
            if len(group) > 1:
                out.append((group, d))
            continue
        first = s[group + d]
        by = np.argsort(first, kind="stable")
        cuts = np.flatnonzero(np.diff(first[by])) + 1
        small: list[np.ndarray] = []
        for part in np.split(group[by], cuts):
            if len(part) > most:
                stack.append((part, d + 1))
            elif len(part) > 1:
                small.append(part)
        # small siblings share a group; the tree below parts them at depth d
        size, run = 0, []
        for part in small:
            if size + len(part) > most and run:
                out.append((np.concatenate(run), d))
                size, run = 0, []
            run.append(part)
            size += len(part)
        if run:
            out.append((np.concatenate(run), d))
    return out


def deep_nodes(s: np.ndarray, group: np.ndarray, begin: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The subtree of a group of suffixes, top down to string depth `depth`: (suffixes, number of their node at that depth).

    Nodes are grown level by level. An edge all of whose suffixes read on alike is followed without sorting; a node with one
    suffix is a leaf and goes. What is left at `depth` are internal nodes (or their edges): repeats of at least that length.
    """
    node = np.zeros(len(group), np.int64)
    at = group
    for d in range(begin, depth):
        if not len(at):
            break
        sym = s[at + d]
        heads = np.flatnonzero(np.diff(node, prepend=-1))
        if (np.maximum.reduceat(sym, heads) == np.minimum.reduceat(sym, heads)).all():
            continue
        by = np.argsort((node << 32) | sym, kind="stable")
        at, node, sym = at[by], node[by], sym[by]
        new = np.ones(len(at), bool)
        new[1:] = (node[1:] != node[:-1]) | (sym[1:] != sym[:-1])
        node = np.cumsum(new) - 1
        keep = np.bincount(node)[node] > 1
        at, node = at[keep], node[keep]
        if len(node):
            node = np.cumsum(np.diff(node, prepend=node[0]) != 0)
    return at, node


def tree_classes(s: np.ndarray, starts: np.ndarray, length: int, most: int = 1 << 16) -> np.ndarray:
    """Class numbers of the windows at starts: those below one node of string depth `length` share a number."""
    out = np.full(int(starts.max(initial=-1)) + 1, -1, np.int64)
    many = 0
    for group, d in prefix_groups(s, starts, most, length):
        at, node = deep_nodes(s, group, d, length)
        if len(at):
            out[at] = many + node
            many += int(node.max()) + 1
    cls = out[starts]
    alone = cls < 0
    cls[alone] = many + np.arange(int(alone.sum()))
    return cls


def remove_repeated_words(docs: DataFrame, length: int = 50, k: int = 20, bucket_bytes: int = 2 << 20, most_bytes: int = 6 << 20) -> DataFrame:
    """Removes every word covered by a window of `length` words whose sequence also starts in a document with a smaller doc_id.

    Candidate spans are dealt so that equal windows meet in one bounded bucket. There, prefixes of varying length split the
    suffixes into groups that fit memory; each group grows a suffix tree down to string depth `length`, whose surviving
    nodes are the repeats.

    Words are maximal runs without ASCII white space, unchanged. Returns a row per document: doc_id, n_units (words),
    n_removed, removed (intervals of words), kept (words joined by one space, UTF-8). Null text has no words; texts of fewer
    words lose nothing; rows with equal doc_id do not count as smaller than each other; a null doc_id is neither smaller nor
    greater, so such rows lose nothing and cost no other row anything; other columns are ignored.
    """
    return winnow.remove(docs, winnow.Words, length, k, tree_classes, "documents", bucket_bytes, most_bytes)
