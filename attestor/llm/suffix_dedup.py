"""Suffix-array dedup of byte strings, by difference cover."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import winnow
from .suffix_order import equal_windows


def remove_repeated_bytes(docs: DataFrame, length: int = 200, k: int = 48, bucket_bytes: int = 1 << 20, most_bytes: int = 3 << 20) -> DataFrame:
    """Removes every byte covered by a `length`-byte string that also starts anywhere else in the corpus.

    Candidate spans are dealt so that equal strings meet in one bounded bucket. Each bucket builds a suffix array over its
    spans by the difference-cover method (sampled triples are sorted and named, the names are recursed on, the remaining
    suffixes merged in) and compares the prefixes of neighbours.

    Returns a row per document: doc_id, n_units (bytes), n_removed, removed (intervals of bytes), kept (what is left, which
    may cut inside a character). Null text counts as empty; empty and short texts lose nothing; equal rows are different
    places, so both go; columns other than doc_id and text are ignored; a null doc_id is an id like any other here.
    """
    return winnow.remove(docs, winnow.Bytes, length, k, equal_windows, "occurrences", bucket_bytes, most_bytes)
