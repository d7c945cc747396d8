"""Chains of digests, nested records and changes of a tree, on planted cases."""

import os

from attestor.operators import chains


def test_chains_with_breaks(spark):
    d = lambda i: f"digest{i}"
    rows = [(0, None, d(0), None)] + [(i, i - 1, d(i), d(i - 1)) for i in range(1, 600)]  # a long one
    rows += [(1000, 9999, d(1000), d(9999)), (1001, 1000, d(1001), d(1000)), (1002, 1001, d(1002), d(1001))]  # no such parent
    rows += [(2000, 5, d(2000), "other"), (2001, 2000, d(2001), d(2000))]  # names another digest
    rows += [(3000, 3002, d(3000), d(3002)), (3001, 3000, d(3001), d(3000)), (3002, 3001, d(3002), d(3001)), (3003, 3002, d(3003), d(3002)), (3004, 3003, d(3004), d(3003)), (3100, 3100, d(3100), d(3100))]
    rows += [(4000, 0, d(4000), d(0)), (4000, 0, d(4000), d(0)), (4001, 4000, d(4001), d(4000)), (5000, 0, d(5000), None), (6000, None, None, None), (6001, 6000, d(6001), None), (None, 0, "x", d(0))]
    df = spark.createDataFrame(rows, "id long, parent long, digest string, parent_digest string")
    got = {r.id: (r.depth, r.finding) for r in chains.trust_chain(df).collect()}
    want = {i: (i, None) for i in range(600)} | {1000: (None, "missing parent"), 1001: (None, "untrusted parent"), 1002: (None, "untrusted parent"), 2000: (None, "parent digest"), 2001: (None, "untrusted parent")}
    want |= dict.fromkeys((3000, 3001, 3002, 3100), (None, "cycle")) | dict.fromkeys((3003, 3004), (None, "untrusted parent"))
    want |= {4000: (None, "repeated id"), 4001: (None, "untrusted parent"), 5000: (None, "parent digest"), 6000: (0, None), 6001: (1, None)}
    assert got == want
    assert chains.trust_chain(df.limit(0)).collect() == []


def test_leaves_at_any_depth(spark):
    deep = "1"
    for i in range(30):
        deep = f'{{"k{i}": [{deep}, null]}}'
    rows = [(1, '{"a": {"b": [1, {"c": "C:\\\\Users x"}, [true, null]]}, "e": {}, "f": []}'), (2, "no json"), (3, None), (4, '"https://a.ngrok.io"'), (5, deep), (6, '{"a": 1.5, "b": "/data/ok"}')]
    df = spark.createDataFrame(rows, "id long, j string")
    got = {}
    for r in chains.leaves(df, "id", "j").collect():
        got.setdefault(r.id, {})[r.path] = r.value
    assert got[1] == {"$.a.b[0]": "1", "$.a.b[1].c": "C:\\Users x", "$.a.b[2][0]": "true", "$.a.b[2][1]": None}
    assert got[4] == {"$": "https://a.ngrok.io"} and got[6] == {"$.a": "1.5", "$.b": "/data/ok"} and set(got) == {1, 4, 5, 6}
    assert len(got[5]) == 31 and "1" in got[5].values()
    assert {(r.id, r.path) for r in chains.private_values(df, "id", "j").collect()} == {(1, "$.a.b[1].c"), (4, "$")}
    assert chains.leaves(df.limit(0), "id", "j").collect() == []


def test_two_looks_at_a_tree(spark, tmp_path):
    for name in ("same", "gone", "other", "longer", "touched"):
        (tmp_path / f"{name}.txt").write_text(name)
    first = spark.createDataFrame(chains.tree(spark, str(tmp_path)).collect(), "path string, size long, modified timestamp, digest string")
    (tmp_path / "gone.txt").unlink()
    (tmp_path / "other.txt").write_text("OTHER")
    (tmp_path / "longer.txt").write_text("longer one")
    (tmp_path / "new").mkdir()
    (tmp_path / "new/one.txt").write_text("x")
    os.utime(tmp_path / "touched.txt", (1, 1))
    got = {r.path.split(f"{tmp_path}/")[1]: r.change for r in chains.changed(first, chains.tree(spark, str(tmp_path))).collect()}
    assert got == {"gone.txt": "removed", "other.txt": "changed", "longer.txt": "changed", "new/one.txt": "added", "touched.txt": "touched"}
