"""Mixing against a plain simulation of the schedule with exact fractions."""

import hashlib
import math
import random
from fractions import Fraction

import pytest

from attestor.llm import mixing
from attestor.llm.mixing import OTHER


def simulate(rows, weights, size):
    pools = {}
    for d, s, t in rows:
        pools.setdefault(s if s in weights and s != OTHER else OTHER, []).append((hashlib.md5(("" if d is None else str(d)).encode()).hexdigest(), -1 if d is None else d))
    for members in pools.values():
        members.sort()
    q = {p: weights.get(p, 1) for p in pools}
    blocks = {p: -(-len(m) // size) for p, m in pools.items()}
    fluid = lambda v: sum(min(Fraction(blocks[p]), q[p] * v) for p in pools)
    jobs = [(math.ceil(fluid(Fraction(k + 1, q[p]))), p, k, math.floor(fluid(Fraction(k, q[p])))) for p in pools for k in range(blocks[p])]
    out, position = [], 0
    for slot in range(len(jobs)):
        job = min(j for j in jobs if j[3] <= slot)
        assert job[0] > slot, "a deadline was missed"
        jobs.remove(job)
        for _, d in pools[job[1]][job[2] * size : (job[2] + 1) * size]:
            out.append((d, job[1], job[2], slot, position))
            position += 1
    return out


@pytest.mark.parametrize("weights,size,n", [({"a": 3, "b": 2, "c": 1}, 1, 300), ({"a": 1, "b": 1}, 4, 700), ({"b": 7, "c": 5, OTHER: 2}, 3, 400), ({"a": 5}, 2, 1)])
def test_schedule(spark, weights, size, n):
    r = random.Random(n)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", None, "z"]), f"t{i}") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = sorted((x.position, x.doc_id, x.pool, x.block, x.slot) for x in mixing.mix(df, weights, size, 50).collect())
    want = [(p, d, pool, k, s) for d, pool, k, s, p in simulate(rows, weights, size)]
    assert got == sorted(want)


def test_deviation_is_less_than_a_block(spark):
    rows = [(i, "abc"[i % 3], "t") for i in range(600)]
    weights = {"a": 5, "b": 3, "c": 1}
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    order = [x.pool for x in mixing.mix(df, weights, 1).orderBy("position").collect()]
    have = dict.fromkeys(weights, 0)
    for t, pool in enumerate(order[:350], 1):
        have[pool] += 1
        assert all(abs(have[p] - t * w / 9) < 1 for p, w in weights.items())


def test_hard_rows(hard, empty):
    weights = {"src0": 3, "src1": 2}
    out = mixing.mix(hard, weights, 2).collect()
    assert sorted(x.position for x in out) == list(range(hard.count()))
    assert {x.start for x in out} == {"extra"}
    ordered = mixing.mixed_order(hard, weights, 2)
    assert ordered.columns == hard.columns and ordered.count() == hard.count()
    assert mixing.mix(empty, weights).count() == 0
    assert mixing.mixed_order(empty, weights).count() == 0


def test_bad_weights(hard):
    with pytest.raises(ValueError):
        mixing.mix(hard, {"a": 0})


def test_plan_runs_no_python(hard):
    plan = mixing.mix(hard, {"src0": 2}, 2)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
