"""The registered queries over a whole small scale, against their SQL; those without SQL against plain Python."""

import hashlib
import zlib

import public_tokenizers
import pytest
import tiktoken

from attestor.llm import bpe
from attestor.llm.queries import ORACLE_SQL, QUERIES

from ..compare import SF, assert_same, duck
from .test_duplicates import brute_fingerprint
from .test_search_and_scores import spans_of

con = duck()


@pytest.fixture(scope="module")
def texts():
    return dict(con.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), con, ORACLE_SQL[name])


def test_op2(spark, texts):
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in QUERIES["op2_byte_bpe"](spark, SF).collect():
        ids = t.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha(texts[r.doc_id].encode()))


def test_op6(spark, texts):
    rows = {r.doc_id: r for r in QUERIES["op6_simhash_dedup"](spark, SF).collect()}
    fps = {d: brute_fingerprint(t) for d, t in texts.items()}
    label = {d: d for d in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            low = min(label[b] for b in texts if (fps[a] ^ fps[b]).bit_count() <= 2)
            changed, label[a] = changed or low != label[a], low
    assert {d: (r.fingerprint, r.component_id) for d, r in rows.items()} == {d: (f"{fps[d]:016x}", label[d]) for d in texts}


def test_op8(spark, texts):
    rows = QUERIES["op8_toxicity"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_op9(spark, texts):
    names = ["assign", "access", "hex"]
    for r in QUERIES["op9_secret_scan"](spark, SF).collect():
        spans = spans_of(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
        assert set(f"{names[k]}:{a}:{b}" for a, k, b in spans) <= set(filter(None, r.spans.split(",")))


def test_op5(spark, texts):
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert all(r.n_tokens == len(t.encode_ordinary(texts[r.doc_id])) for r in QUERIES["op5_token_counts"](spark, SF).collect())
