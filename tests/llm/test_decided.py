"""What decides that windows repeat: the suffix structures, on bytes, whatever the hashes do."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.llm import substring_dedup, suffix_dedup, suffix_order, winnow

from .test_repeats import brute_bytes, multiset


@pytest.mark.parametrize("most", [3 << 20, 700])
def test_colliding_hashes_change_nothing(hard, hard_rows, monkeypatch, most):
    """Spans of different bytes under one hash stay apart."""
    write = winnow.common.materialise
    monkeypatch.setattr(winnow.common, "materialise", lambda df, label: write(df.withColumn("sub", F.lit(0).cast("long")) if label == "spans" else df, label))
    got = suffix_dedup.remove_repeated_bytes(hard, 60, k=16, bucket_bytes=2000, most_bytes=most).collect()
    assert Counter((r.doc_id, bytes(r.kept)) for r in got) == multiset(hard_rows, brute_bytes(hard_rows, 60))


def spans(contents, length, unit, count):
    import pyarrow as pa

    n = [len(unit.units(c)) - length + 1 for c in contents]
    return pa.table({"id": list(range(len(n))), "content": pa.array(contents, pa.binary()), "n": pa.array(n, pa.int32()), "count": pa.array(count, pa.int64()), "least": pa.array([0] * len(n), pa.int64())})


@pytest.mark.parametrize(("unit", "engine"), [(winnow.Bytes, suffix_order.equal_windows), (winnow.Words, substring_dedup.tree_classes)])
def test_copies_are_found_by_the_engine(unit, engine):
    """Without the engine's word for it nothing is a repeat, however many a span stands for."""
    length = 5
    t = spans([b"a b c d e f g h i", b"q r s t u v w x y", b"a b c d e f 1 2 3"], length, unit, [1, 7, 1])
    blind = lambda s, starts, length: np.arange(len(starts))
    for among in ("occurrences", "documents"):
        assert winnow.compare(t, unit, length, blind, among).num_rows == 0
        assert 1 in winnow.compare(t, unit, length, engine, among).column("id").to_pylist()
    assert winnow.compare(t, unit, length, engine, "occurrences").column("id").to_pylist() == [0, 1, 2]


def test_word_hashes(monkeypatch):
    text = b"  one two\tone \x0btwo " + b"z" * 100 + b" one\n" + b"z" * 100 + b" " + b"z" * 101
    whole = winnow.Words.codes(winnow.Words.units(text))
    assert list(winnow.Words.units(text)) == text.split()
    monkeypatch.setattr(winnow, "PIECE", 7)
    assert (winnow.Words.codes(winnow.Words.units(text)) == whole).all()
    words = text.split()
    assert len(set(whole.tolist())) == len(set(words)) == len(set(zip(whole.tolist(), words)))
    assert winnow.Words.cut(winnow.Words.units(text), 1, 4) == b"two one two" and len(winnow.Words.units(b" \n")) == 0
