"""Streams with state: rooms of sessions, late rows, sliding windows, two streams that meet."""

import datetime as dt
import random


from attestor.streaming import journal, rooms

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def fed(spark, folder, batches, schema):
    """Files that a stream reads one at a time, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def ran(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None and not q.isActive
    return q, stream.sparkSession.table(name).collect()


def plain(events, most, at_rest, at_work):
    """A room by its rules, second by second."""
    held, out, todo = {}, [], sorted(events)
    for now in range(todo[0][0], todo[-1][0] + max(at_rest, at_work) + 1):
        for name in sorted(n for n, (seen, working) in held.items() if now - seen == (at_work if working else at_rest)):
            del held[name]
            out.append((now, name, "over"))
        for _, name, kind in [e for e in todo if e[0] == now]:
            if name not in held:
                if len(held) == most:
                    resting = sorted((seen, n) for n, (seen, working) in held.items() if not working)
                    if not resting:
                        out.append((now, name, "refused"))
                        continue
                    del held[resting[0][1]]
                    out.append((now, resting[0][1], "made room"))
                out.append((now, name, "opened"))
            was = held.get(name, (0, False))[1]
            held[name] = now, True if kind == "begin" else False if kind == "end" else was
    return out


def test_rooms_by_their_rules():
    r = random.Random(1)
    for _ in range(200):
        events = sorted((r.randint(0, 60), r.choice("abcdef"), r.choice(["begin", "end", "touch"])) for _ in range(r.randint(1, 40)))
        held = {}
        got = rooms.admitted(events, held, 3, 20, 7)
        got += rooms._over(held, 200, 20, 7)
        assert sorted(got) == sorted(plain(events, 3, 20, 7)) and not held


def test_rooms_in_a_stream(spark, tmp_path):
    """Sessions end, make room and are refused, over several micro-batches of two rooms; the last ones end by the watermark alone."""
    events = [(0, "a", "begin"), (1, "b", "touch"), (2, "c", "touch"), (3, "d", "begin"), (40, "a", "touch"), (60, "e", "begin"), (65, "f", "touch"), (70, "g", "touch"), (95, "e", "end"), (100, "h", "touch"), (300, "b", "touch")]
    batches = [[("r1", s, k, at(t)) for t, s, k in events if lo <= t < hi] + [("r2", "a", "touch", at(lo))] for lo, hi in ((0, 3), (3, 50), (50, 99), (99, 250), (250, 301))]
    batches.append([("r9", "z", "touch", at(5000))])
    batches.append([("r9", "z", "touch", at(9000))])
    stream = rooms.rooms(fed(spark, tmp_path, batches, "room string, session string, kind string, at timestamp"), most=2, at_rest=100, at_work=50, late="1 second")
    _, rows = ran(stream, "rooms")
    got = sorted((int((r["at"].replace(tzinfo=dt.UTC) - START).total_seconds()), r.session, r.outcome) for r in rows if r.room == "r1")
    want = sorted(plain(events, 2, 100, 50))
    assert got == want and {o for *_, o in want} == {"opened", "over", "made room", "refused"}
    assert [r.outcome for r in rows if r.room == "r2"].count("over") >= 1


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    day = 86400
    rows = [[(i, at(i * 3600), "a", float(i)) for i in range(48)], [(100, at(2 * day + 60), "b", 1.0)], [(200, at(5 * 3600), "a", 50.0), (201, at(2 * day + 120), "a", 2.0), (202, at(2 * day - 600), "a", 7.0)], [(300, at(9 * day), "b", 3.0)]]
    schema = "event_id long, ts timestamp, event_type string, value double"
    events = fed(spark, tmp_path, rows, schema)
    named_late = {200}
    table = spark.createDataFrame([x for b in rows for x in b if x[0] not in named_late], schema)
    for width, slide in (("1 day", None), ("12 hours", "3 hours")):
        q, got = ran(journal.tumbling(events, width, slide), f"late{len(width)}")
        assert journal.dropped(q) == (1 if slide is None else 4)  # a row is in four sliding windows
        want = {(r.start, r.event_type, r.n, r["mean"]) for r in journal.tumbling(table, width, slide).collect()}
        got = {(r.start, r.event_type, r.n, r["mean"]) for r in got}
        open_ = max(r[0] for r in got)
        assert got == {r for r in want if r[0] <= open_} and len(got) > 3  # windows that are not over yet stay back


def test_two_streams_meet_within_a_time(spark, tmp_path):
    r = random.Random(3)
    schema = "id long, user_id long, ts timestamp"
    sides = []
    for name in ("first", "second"):
        rows = [(i, r.randint(0, 4), at(r.randint(60 * (i // 10) * 10, 60 * ((i // 10) * 10 + 9)))) for i in range(60)]
        (tmp_path / name).mkdir()
        sides.append((fed(spark, tmp_path / name, [rows[k : k + 10] for k in range(0, 60, 10)], schema), spark.createDataFrame(rows, schema)))
    streamed = journal.followed_by(sides[0][0], sides[1][0], "user_id", "15 minutes")
    q, got = ran(streamed, "met")
    want = journal.followed_by(sides[0][1], sides[1][1], "user_id", "15 minutes").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 20
    kept = [op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]]
    assert kept[-1] < 120 and journal.dropped(q) == 0  # rows that no partner can meet any more are gone
