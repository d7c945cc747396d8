"""BPE against the tiktoken library, and counts that follow edits against encoding anew."""

import random
from collections import Counter

import public_tokenizers
import pytest
import regex
import tiktoken

from attestor.llm import bpe, token_counts

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_round_trip(hard, hard_rows, reference):
    out = bpe.decode(bpe.encode(hard, PATH, PATTERN), PATH).collect()
    ids = lambda t: b"".join(i.to_bytes(4, "little") for i in reference.encode_ordinary(t or ""))
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in out) == Counter((d, len(ids(t)) // 4, ids(t), (t or "").encode()) for d, t, *_ in hard_rows)


def test_small_cache(reference):
    e = bpe.Encoder(PATH, PATTERN, cache=5)
    texts = ["one two three four five six seven", "", "  one\n\n two's", "z" * 500, "eight nine ten eleven " * 30]
    assert [len(x) // 4 for x in e.encode_many(texts)] == [len(reference.encode_ordinary(t)) for t in texts]


def test_edits(reference):
    e, compiled = bpe.encoder(PATH, PATTERN), regex.compile(PATTERN)
    r = random.Random(4)
    for text in ["", "a", "   ", "It's a test.  Of two\n\nlines 123 !?", "word " * 50, "x" * 100, "é中 \t" * 9]:
        for _ in range(25):
            words = e.split(text)
            e.learn(set(words))
            doc = token_counts.Document(text, words, [e.cache[w] for w in words], e, compiled)
            for _ in range(6):
                n = len(doc.text)
                a = r.randint(0, n)
                doc.edit(a, a + r.choice([0, 1, 2, 9, 60]), r.choice(["", " ", "  ", "x", "\n\n", "new words", "'s", " 12 "]))
                assert doc.tree.tokens == len(reference.encode_ordinary(doc.text))


def test_edits_touch_little():
    e, compiled = bpe.encoder(PATH, PATTERN), regex.compile(PATTERN)
    text = "some words go on " * 500
    words = e.split(text)
    e.learn(set(words))
    doc = token_counts.Document(text, words, [e.cache[w] for w in words], e, compiled)
    doc.edit(4000, 4003, "new")
    assert doc.encoded < 12


def test_count_operator(hard, hard_rows, reference):
    got = token_counts.count(hard.select("doc_id", "text", token_counts.revision_edits().alias("edits"), "n"), PATH, PATTERN).collect()

    def edited(t):
        t = "# Revised\n" + t
        half = len(t) // 2
        t = t[:half] + t[half + 16 :]
        return t + "\n\nRevised text; see the first version."

    n = lambda t: len(reference.encode_ordinary(t))
    assert Counter((r.doc_id, r.n_tokens, r.n_tokens_edited) for r in got) == Counter((d, n(t or ""), n(edited(t or ""))) for d, t, *_ in hard_rows)


def test_empty(empty):
    assert bpe.decode(bpe.encode(empty, PATH, PATTERN), PATH).count() == 0
    assert token_counts.count(empty.select("doc_id", "text", token_counts.revision_edits().alias("edits")), PATH, PATTERN).count() == 0
