"""Alignment of two tokenizers against whole texts, encoded and compared range by range."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from attestor.llm import alignment
from attestor.llm.queries import QUERIES

from ..compare import SF, duck

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def letters():
    """As byte-level BPE is published: bytes without a printable letter take the next ones from 256 on, in order."""
    out, extra = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            out[chr(b)] = b
        else:
            out[chr(extra)], extra = b, extra + 1
    return out


class Plain:
    def __init__(self):
        self.a, self.b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        self.a.encode_special_tokens = True
        self.letters = letters()

    def tokens(self, text):
        """(ids, byte ranges) of both sides of the whole text, or none."""
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        raw = (" " + text).encode()
        piece = lambda k: bytes([int(self.b.id_to_piece(k)[3:5], 16)]) if self.b.is_byte(k) else self.b.id_to_piece(k).replace("▁", " ").encode()
        sides = []
        for ids, parts in ((a, [bytes(self.letters[c] for c in self.a.id_to_token(k)) for k in a]), (b, [piece(k) for k in b])):
            if b"".join(parts) != raw:
                return None
            at, ranges = 0, []
            for p in parts:
                ranges.append((at, at + len(p)))
                at += len(p)
            sides.append((ids, ranges))
        return sides

    def owners(self, sides):
        """For each byte the token of either side that covers it."""
        return [[k for k, (s, e) in enumerate(ranges) for _ in range(s, e)] for _, ranges in sides]

    def groups(self, sides):
        (a, ra), (b, rb) = sides
        own_a, own_b = self.owners(sides)
        both = sorted({e for _, e in ra} & {e for _, e in rb})
        inside = lambda ids, own, lo, hi: ",".join(str(ids[k]) for k in range(own[lo], own[hi - 1] + 1))
        return [f"{inside(a, own_a, lo, hi)}|{inside(b, own_b, lo, hi)}" for lo, hi in zip([0, *both[:-1]], both, strict=True)]

    def links(self, sides):
        return [(sides[0][0][x], sides[1][0][y]) for x, y in dict.fromkeys(zip(*self.owners(sides), strict=True))]


@pytest.fixture(scope="module")
def plain():
    return Plain()


def held(plain, texts):
    """What each text gives: counts, groups and links over all of them."""
    sides = [plain.tokens(t) for t in texts]
    links = [plain.links(s) if s else [] for s in sides]
    count = Counter(x for part in links for x in part)
    best_a, best_b = {}, {}
    for (a, b), n in count.items():
        best_a[a], best_b[b] = max(n, best_a.get(a, 0)), max(n, best_b.get(b, 0))
    for s, part in zip(sides, links, strict=True):
        groups = plain.groups(s) if s else []
        n_best, n_best_a = sum(count[x] == best_b[x[1]] for x in part), sum(count[x] == best_a[x[0]] for x in part)
        yield ";".join(groups), len(s[0][0]) if s else 0, len(s[1][0]) if s else 0, len(groups), len(part), n_best, n_best_a, sum(count[x] for x in part)


def test_segments_give_the_tokens_of_whole_texts(plain):
    t = alignment.Tokenizers(*PATHS)
    texts = [" ", "  ", "a ", " a", "a  b", "a\n b", "a \n\nb", "don't  we'll 'tis", "\ta", "a  b", "a   b", "▁", "a▁ b", "a ▁b", "x\x1c y", "<|endoftext|> <s> </s><unk>", "12 345,6", "中文 中", "é ́", "\x00 \x7f", "a" * 500 + " " + "1" * 500, "\U0001f600 \U0001f468‍\U0001f469"]
    texts += [r[0] for r in duck().sql("SELECT text FROM documents WHERE text <> ''").fetchall()]
    ok = 0
    for text in texts:
        parts = t.cut(" " + text)
        assert "".join(parts) == " " + text
        sides = plain.tokens(text)
        merged = t.learn(parts)
        if sides is None:
            assert None in merged
            continue
        ok += 1
        assert ";".join(m[3] for m in merged) == ";".join(plain.groups(sides)) if len(text) < 4000 else sum(m[0] for m in merged) == len(sides[0][0])
    assert ok > 100 and len(t.cut("a b c")) == 3


def test_white_space_at_the_end_of_a_text_joins_no_other_text(plain):
    r = random.Random(3)
    ends = ["", " ", "  ", "\n", "\n\n", "\t ", "\u00a0", "\u3000 ", " \n", "\x1c", "▁", "     "]
    texts = [r.choice(ends) + r.choice(["a", "中", "The word", "12", ""]) + r.choice(ends) for _ in range(400)]
    found = alignment._block(0, [*map(str, range(len(texts)))], texts, alignment.Tokenizers(*PATHS))["documents"]
    assert [(d[1], *d[2:6]) for d in found] == [x[:5] for x in held(plain, texts)]


def test_nothing_looks_for_cycles_while_a_block_is_made():
    import gc

    seen, t = [], alignment.Tokenizers(*PATHS)
    look = lambda phase, info: seen.append(info) if phase == "start" else None
    texts = [" ".join(f"w{i * 31 + k}" for k in range(200)) for i in range(40)]
    gc.callbacks.append(look)
    try:
        alignment._block(0, [*map(str, range(len(texts)))], texts, t)
    finally:
        gc.callbacks.remove(look)
    assert not seen and gc.isenabled()


def test_merge():
    def two_pointers(a, b):
        links, groups, i, j = [], [], 0, 0
        while i < len(a):
            links.append((i, j))
            x, y = a[i], b[j]
            i, j = i + (x <= y), j + (y <= x)
            if x == y:
                groups.append((i, j))
        return links, groups

    def merged(a, b):
        x, y, i, j = (v.tolist() for v in alignment.merge(np.array(a, np.int64), np.array(b, np.int64)))
        return [*zip(x, y, strict=True)], [*zip(i, j, strict=True)]

    assert merged([2, 5, 6], [2, 3, 6]) == ([(0, 0), (1, 1), (1, 2), (2, 2)], [(1, 1), (3, 3)])
    r = random.Random(0)
    for _ in range(300):
        n = r.randint(0, 20)
        a, b = (sorted({*r.sample(range(1, n + 1), r.randint(0, n)), n} - {0}) for _ in range(2))
        assert merged(a, b) == two_pointers(a, b)


def test_hard_rows(spark, hard, hard_rows, empty, plain):
    rows = [r for r in hard_rows if len(r[1] or "") < 10000]
    short = hard.where("text is null or length(text) < 10000")
    want = sorted(((r[0] is None, r[0] or 0), *x) for r, x in zip(rows, held(plain, [r[1] for r in rows]), strict=True))
    for most_sent in (0, 1 << 20):  # counts joined to blocks, and sent to all tasks
        found, pairs = alignment.align(short, *PATHS, at_once=3000, most_sent=most_sent)
        assert sorted(((r.doc_id is None, r.doc_id or 0), r.groups, *(r[x] for x in alignment.COUNTED)) for r in found.collect()) == want
    counts = Counter(x for r in rows if (s := plain.tokens(r[1])) for x in plain.links(s))
    assert {(r.a, r.b): r.n for r in pairs.collect()} == counts
    long = hard.where("length(text) >= 10000")
    assert {r.n_a for r in alignment.align(long, *PATHS)[0].collect()} == {len(plain.tokens(r[1])[0][0]) for r in hard_rows if len(r[1] or "") >= 10000}
    assert alignment.align(empty, *PATHS)[0].collect() == []


def test_op12(spark, plain):
    texts = dict(duck().sql("SELECT doc_id, text FROM documents").fetchall())
    rows = {r.doc_id: r for r in QUERIES["op12_token_alignment"](spark, SF).collect()}
    assert set(rows) == set(texts)
    for (doc_id, _), (groups, n_a, n_b, n_groups, n_links, n_best, _, total) in zip(texts.items(), held(plain, texts.values()), strict=True):
        r = rows[doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == (n_a, n_b, n_groups, n_links, n_best, total)
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
