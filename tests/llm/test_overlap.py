"""The near-dedup stage against brute force: five words, a similarity of 0.8 or more, no other."""

import random

import numpy as np
import pytest

import corpus_pipeline
from attestor.llm import simhash
from attestor.llm.components import components

from .test_duplicates import brute_fingerprint


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def edited(r, words, n):
    out = list(words)
    for i in r.sample(range(len(out)), n):
        out[i] = f"new{r.randint(0, 999)}"
    return " ".join(out)


def test_stage_drops_all_near_copies(spark, hard_rows):
    r = random.Random(3)
    texts = [t for _, t, *_ in hard_rows]
    for n, edits in ((60, 1), (100, 2), (200, 4), (400, 8), (45, 1), (300, 7)):
        words = [f"v{r.randint(0, 5000)}" for _ in range(n)]
        texts += [" ".join(words), *(edited(r, words, edits) for _ in range(3)), " ".join(words).upper(), " ".join(words[: n * 4 // 5 + 1])]
    sets, fps = [shingles(t) for t in texts], [brute_fingerprint(t) for t in texts]
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    far_in_bits = 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                far_in_bits += (fps[i] ^ fps[j]).bit_count() > 2
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    assert far_in_bits > 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    groups = {i: root(i) for i in range(len(texts))}
    got = {x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert got == {i for i, g in groups.items() if g == i}
    # buckets cut into blocks
    found = {x.doc_id: x.component for x in simhash.similar_texts(docs, part=2).collect()}
    assert len(set(found.values())) == len(set(groups.values())) == len({(found[i], g) for i, g in groups.items()})


def test_stage_keeps_unlike_texts(spark):
    """Texts that share 60 words and end in 12 of a few others: not similar enough, but their fingerprints are often near."""
    r = random.Random(4)
    shared = [f"c{i}" for i in range(60)]
    texts = [" ".join(shared + [f"own{r.randint(0, 40)}" for _ in range(12)]) for _ in range(400)]
    fps = [brute_fingerprint(t) for t in texts]
    assert sum((a ^ b).bit_count() <= 2 for i, a in enumerate(fps) for b in fps[:i]) > 0
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert corpus_pipeline.drop_near_copies(spark, docs, "").count() == 400


def test_links_are_joined_in_tasks_first(spark):
    """What is left has the same components, in one task as stars, which take no round: before, each round was some eleven of the driver's jobs."""
    r, n = random.Random(4), 3000
    links = [(i, i - 1) for i in range(1, 300)] + [(r.randrange(300, n), r.randrange(300, n)) for _ in range(2500)]
    least = list(range(n))
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    want = {x: least[x] for link in links for x in link if link[0] != link[1]}
    df = spark.createDataFrame(links, "a long, b long").repartition(7).cache()
    assert dict(simhash.joined_links(df, len(links)).collect()) == {x: y for x, y in want.items() if x != y}
    some = simhash.joined_links(df, len(links), 500)
    assert some.rdd.getNumPartitions() == 6
    assert dict(components(some).collect()) == want
    assert simhash.joined_links(df.where("a < 0"), 0).collect() == []


def test_blocks_of_a_bucket():
    """All pairs of different components come out once over a bucket's blocks, the nearest ones with a limit."""
    r = np.random.default_rng(0)
    n = 60
    size, part, component = np.sort(r.integers(90, 110, n)), r.integers(0, 3, n), r.integers(0, 20, n)
    parities = np.zeros((n, 16), np.uint64)
    parities[:, 0] = r.integers(0, 1 << 12, n, np.uint64) << np.uint64(52)
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if component[i] != component[j] and 9 * int(parities[i, 0] ^ parities[j, 0]).bit_count() <= size[i] + size[j]}
    got, few = [], set()
    for low in range(3):
        for high in range(low, 3):
            at = np.flatnonzero((part == low) | (part == high))
            bucket = simhash.Bucket(part[at], size[at], np.zeros(len(at), np.int64), at, component[at], parities[at])
            for most, out in ((0, got.append), (2, few.add)):
                for pair in zip(*(x.tolist() for x in bucket.across((4, 5), most)), strict=True):
                    out(tuple(sorted(pair)))
    assert len(got) == len(set(got)) and set(got) == want and few < want


def test_radius_beyond_the_blocks(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), radius=3)
