"""Repeat removal by words and by bytes, against brute force."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attestor.llm import substring_dedup, suffix_dedup, winnow
from attestor.llm.substring_dedup import tree_classes
from attestor.llm.suffix_order import equal_windows, suffix_ranks


def brute_bytes(rows, length):
    data = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(bytes(x for x, g in zip(b, gone) if not g))
    return out


def brute_words(rows, length):
    first = {}
    data = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    for d, w in data:
        if d is not None:
            for i in range(len(w) - length + 1):
                key = tuple(w[i : i + length])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in data:
        gone = set()
        for i in range(len(w) - length + 1):
            if d is not None and first[tuple(w[i : i + length])] < d:
                gone.update(range(i, i + length))
        out.append(b" ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def multiset(rows, kept):
    return Counter(zip((r[0] for r in rows), kept))


@pytest.mark.parametrize("most", [3 << 20, 400])
def test_bytes(hard, hard_rows, most):
    got = suffix_dedup.remove_repeated_bytes(hard, 60, k=16, bucket_bytes=2000, most_bytes=most).collect()
    assert Counter((r.doc_id, bytes(r.kept)) for r in got) == multiset(hard_rows, brute_bytes(hard_rows, 60))
    assert all(r.n_removed == sum(x.b - x.a for x in r.removed) and r.n_units - r.n_removed == len(r.kept) for r in got)


@pytest.mark.parametrize("most", [6 << 20, 400])
def test_words(hard, hard_rows, most):
    got = substring_dedup.remove_repeated_words(hard, 12, k=5, bucket_bytes=2000, most_bytes=most).collect()
    assert Counter((r.doc_id, bytes(r.kept)) for r in got) == multiset(hard_rows, brute_words(hard_rows, 12))


def test_pieces(spark, hard_rows, monkeypatch):
    monkeypatch.setattr(winnow, "PIECE", 37)
    unit = winnow.Bytes
    text = (hard_rows[40][1] * 3).encode()
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text])], names=["dkey", "rid", "text"])
    out = list(winnow.span_rows([batch], unit, 20, 6))[0].to_pydict()
    assert sum(out["n"]) == len(text) - 19
    content = lambda i: text[out["start"][i] : out["start"][i] + out["n"][i] + 19]
    by_content = defaultdict(set)
    for i in range(len(out["n"])):
        by_content[content(i)].add((out["route"][i], out["sub"][i]))
    assert all(len(x) == 1 for x in by_content.values())


def test_empty(empty):
    assert suffix_dedup.remove_repeated_bytes(empty).count() == 0
    assert substring_dedup.remove_repeated_words(empty).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=70), st.integers(1, 12))
def test_suffix_order(symbols, length):
    s = np.array(symbols, np.int32)
    order = np.argsort(suffix_ranks(s, len(s) + 3))
    assert [tuple(s[i:]) for i in order] == sorted(tuple(s[i:]) for i in range(len(s)))
    starts = np.arange(max(0, len(s) - length + 1))
    for engine in (equal_windows, lambda *a: tree_classes(*a, most=4)):
        cls = engine(s, starts, length)
        pairs = {(c, tuple(s[i : i + length])) for c, i in zip(cls, starts)}
        assert len(pairs) == len({c for c, _ in pairs}) == len({w for _, w in pairs})
