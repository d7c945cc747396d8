"""Runs of repeated words against a plain search, on lists of words and through the query."""

import hashlib
import random
import zlib

from attestor.llm import periodic
from attestor.llm.queries import QUERIES

from ..compare import SF, duck


def plain_runs(words):
    """Every maximal stretch of each period, its smallest, by comparing words one by one."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(6, 4 * q) and not any(words[s : e - p] == words[s + p : e] for p in range(1, q)):
                out.append((s, e - s, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_small_texts():
    r = random.Random(1)
    for _ in range(400):
        docs = []
        for _ in range(r.randint(1, 4)):
            k = r.randint(1, 4)
            words = [r.randrange(k) for _ in range(r.randint(0, 60))]
            if r.random() < 0.6:
                part = [r.randrange(k + 2) for _ in range(r.randint(1, 20))]
                words += part * r.randint(1, 7) + part[: r.randint(0, 20)] + words
            docs.append(words)
        assert periodic.runs_of(docs) == [plain_runs(d) for d in docs]


def test_known_runs():
    assert periodic.runs_of([[7] * 5, [7] * 6, [1, 2] * 4, [1, 2] * 3 + [1], [1, 1, 1, 2] * 4]) == [[], [(0, 6, 1)], [(0, 8, 2)], [], [(0, 16, 4)]]


def test_long_periods_within_long_texts():
    r = random.Random(2)
    docs = []
    for times in (3, 4, 5, 9):
        part = [r.randrange(3000) for _ in range(700)]
        docs.append([r.randrange(3000) for _ in range(500)] + part * times + part[:50] + [r.randrange(3000) for _ in range(900)])
    docs += [[1] * 30000, [1, 2, 3, 4, 5] * 4000, part + [9] + part + [8] + part]
    runs = periodic.runs_of(docs)
    assert [[x[1:] for x in d] for d in runs] == [[], [(2850, 700)], [(3550, 700)], [(6350, 700)], [(30000, 1)], [(20000, 5)], []]


def test_hard_rows(spark, hard, hard_rows, empty):
    got = sorted(((x.doc_id is None, x.doc_id or 0, x.n_words, [tuple(y) for y in x.runs], x.collapsed) for x in periodic.find(hard, at_once=700).collect()))
    want = []
    for doc_id, text, *_ in hard_rows:
        words = (text or "").encode().split()
        runs = plain_runs(words)
        want.append((doc_id is None, doc_id or 0, len(words), runs, plain_collapsed(words, runs).decode()))
    assert got == sorted(want)
    assert any(runs for *_, runs, _ in want)
    assert periodic.find(empty).collect() == []


def test_op13(spark):
    """The whole small scale, with the periods of the contract made here a second time."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    texts = dict(duck().sql("SELECT doc_id, text FROM documents").fetchall())
    assert set(rows) == set(texts)
    changed = 0
    for doc_id, text in texts.items():
        words = (text or "").encode().split()
        h = zlib.crc32(b"%d" % doc_id)
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words) if len(words) < 3000 else periodic.runs_of([[sorted(set(words)).index(w) for w in words]])[0]
        changed += bool(runs)
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()
        r = rows[doc_id]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), s, n, q, n and 1000 * n // q)
        assert (r.runs_sha256, r.collapsed_sha256) == (sha(listed), sha(plain_collapsed(words, runs)))
    assert changed > 5
