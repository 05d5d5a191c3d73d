import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemill.operators import members
from tidemill.streaming import ordered, tables

START = datetime(2024, 1, 1)


def put(spark, path, shape, rows):
    spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(path))


def test_counts_follow_time_across_batches(spark, tmp_path):
    """Two batches bring (5, 6) and then (1, 2): the early rows count first."""
    shape = "grp string, event_id long, ts timestamp"
    row = lambda i, minute=None: ("g", i, START + timedelta(minutes=i if minute is None else minute))
    for ids in ((5, 6), (1, 2), (70,), (400,)):
        put(spark, tmp_path / "in", shape, [row(i) for i in ids])
    stream = tables.in_batches(spark, str(tmp_path / "in"), shape)
    run = lambda: ordered.run_ordered(ordered.ordered_counts(stream, "1 hour"), checkpoint=str(tmp_path / "state"), out=str(tmp_path / "out"))
    found = lambda: {r["id"]: r["n"] for r in ordered.running_totals(run()).collect()}
    assert found() == {1: 1, 2: 2, 5: 3, 6: 4, 70: 5}  # the last row is still held back
    put(spark, tmp_path / "in", shape, [row(399), row(401), row(500)])
    assert found() == {1: 1, 2: 2, 5: 3, 6: 4, 70: 5, 399: 6, 400: 7, 401: 8}


class Held(list):
    """A list state, or a value state of one element, that tells its elements."""

    appendList, exists = list.extend, list.__len__

    def put(self, rows):
        self[:] = rows

    def get(self):
        return self if not self or isinstance(self[0][0], bytes) else self[0]

    def update(self, row):
        self[:] = [row]


def test_buffers_move_runs_of_rows():
    """A key's 100,000 rows are a few elements of state, and leave in the order of time whatever frames bring them."""
    states, timers = {}, []
    handle = SimpleNamespace(getListState=lambda name, _: states.setdefault(name, Held()), getValueState=lambda name, _: states.setdefault(name, Held()), registerTimer=timers.append)
    counting, clock = ordered.Counting(), lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    counting.init(handle)
    ms = np.random.default_rng(5).permutation(100_000)
    frames = [pd.DataFrame({"ms": part, "id": part * 2}) for part in np.split(ms, 10)]
    assert list(counting.handleInputRows(("g", 0), iter(frames), clock(0))) == [] and timers == [1]
    assert len(states["pending"]) == 2
    first, second = (pd.concat(counting.handleExpiredTimer(("g", 0), clock(at), None)) for at in (69_999, 100_000))
    assert timers[1:] == [70_000] and not states["pending"]
    out = pd.concat([first, second])
    assert len(first) == 70_000 and (out["ms"] == range(100_000)).all() and (out["id"] == 2 * out["ms"]).all() and (out["n"] == out["ms"] + 1).all()


def stepwise(signs, limits):
    """Changes of each host by a clock that looks at every millisecond."""
    out, last = [], max(t for _, t, _ in signs)
    for host in {h for h, _, _ in signs}:
        clock = members.MemberClock(*limits)
        for t, k in sorted((t, ["JOIN", "ALIVE", "LEAVE"].index(k)) for h, t, k in signs if h == host):
            out += [(host, *c) for c in clock.sign(t, k)]
        out += [(host, *c) for c in clock.until(last + 1)]
    return sorted(out)


def test_states_of_a_host():
    clock = members.MemberClock(10, 5, 3)
    assert clock.sign(0, members.JOIN) == [(0, "JOINING")] and clock.until(500) == []
    assert clock.sign(500, members.ALIVE) == [(500, "ACTIVE")]
    assert clock.sign(510, members.ALIVE) == []  # at the limit, in time
    assert clock.sign(523, members.ALIVE) == [(520, "SUSPECTED"), (523, "ACTIVE")]
    assert clock.sign(540, members.LEAVE) == [(533, "SUSPECTED"), (538, "FAILED"), (540, "LEFT")]
    assert clock.sign(542, members.ALIVE) == []  # what a host says after it left
    assert clock.sign(544, members.ALIVE) == [(543, "REMOVED"), (544, "ACTIVE")]
    assert clock.until(600) == [(554, "SUSPECTED"), (559, "FAILED"), (562, "REMOVED")] and clock.deadline() is None


def test_intervals_tell_the_same_changes(spark):
    draw = random.Random(4)
    signs = [(f"h{draw.randrange(6)}", draw.randrange(60) * 1000, draw.choice(["JOIN", "ALIVE", "ALIVE", "ALIVE", "LEAVE"])) for _ in range(150)]
    df = spark.createDataFrame(signs, "host string, ms long, kind string")
    found = members.status_changes(df, 5, 3, 4)
    assert sorted(map(tuple, found.collect())) == stepwise(signs, (5000, 3000, 4000))
    assert members.status_changes(df.where("false"), 5, 3, 4).collect() == []


def test_stream_of_signs_out_of_order_and_restarted(spark, tmp_path):
    draw, shape = random.Random(9), "host string, ts timestamp, kind string"
    signs = [(f"h{draw.randrange(3)}", draw.randrange(200) * 500, draw.choice(["JOIN", "ALIVE", "ALIVE", "LEAVE"])) for _ in range(60)]
    batches = sorted(range(60), key=lambda i: signs[i][1] + draw.randrange(10_000))
    run = lambda: ordered.run_ordered(ordered.member_states(tables.in_batches(spark, str(tmp_path / "in"), shape), 5, 3, 4, "10 seconds"), checkpoint=str(tmp_path / "state"), out=str(tmp_path / "out"))
    for part in (batches[:20], batches[20:45], batches[45:]):
        put(spark, tmp_path / "in", shape, [(signs[i][0], START + timedelta(milliseconds=signs[i][1]), signs[i][2]) for i in part])
        states = run()
    zero = int(START.timestamp() * 1000) if spark.conf.get("spark.sql.session.timeZone") != "UTC" else int((START - datetime(1970, 1, 1)).total_seconds() * 1000)
    found = sorted((r["host"], r["ms"] - zero, r["status"]) for r in states.collect())
    released = max(t for _, t, _ in signs) - 10_000
    assert found == [c for c in stepwise(signs, (5000, 3000, 4000)) if c[1] <= released]


UPDATE = "host long, incarnation long, heartbeat long, arrival long, status string"


def test_repeated_batches_change_nothing_twice(spark, tmp_path):
    table = tables.KeyedTable(spark, str(tmp_path / "t"), {"status": "string"}, buckets=4)
    rows = lambda: sorted(tuple(r) for r in table.read().collect())
    first = spark.createDataFrame([(1, 0, 5, 0, "a"), (2, 0, 1, 0, "b"), (1, 0, 5, 1, "late tie")], UPDATE)
    second = spark.createDataFrame([(1, 1, 0, 2, "new"), (3, 0, 0, 0, "c")], UPDATE)
    table.upsert(first, 0)
    assert rows() == [(1, 0, 5, 0, "a"), (2, 0, 1, 0, "b")]
    table.upsert(second, 1)
    done = [(1, 1, 0, 2, "new"), (2, 0, 1, 0, "b"), (3, 0, 0, 0, "c")]
    assert rows() == done
    table.upsert(second, 1)
    assert rows() == done and table.vacuum() >= 1 and rows() == done
    table.upsert(first.where("false"), 2)
    assert rows() == done


def test_upserts_of_a_restarted_stream(spark, tmp_path):
    table = tables.KeyedTable(spark, str(tmp_path / "t"), {"status": "string"})
    run = lambda: sorted(tuple(r) for r in table.run(tables.in_batches(spark, str(tmp_path / "in"), UPDATE), str(tmp_path / "state")).collect())
    put(spark, tmp_path / "in", UPDATE, [(1, 0, 1, 0, "a")])
    put(spark, tmp_path / "in", UPDATE, [(1, 0, 2, 1, "b"), (2, 0, 0, 0, "x")])
    assert run() == [(1, 0, 2, 1, "b"), (2, 0, 0, 0, "x")]
    put(spark, tmp_path / "in", UPDATE, [(1, 0, 1, 2, "old")])
    assert run() == [(1, 0, 2, 1, "b"), (2, 0, 0, 0, "x")]


def test_late_rows_are_listed_and_not_counted(spark, tmp_path):
    shape = "id long, ts timestamp_ntz, key string"
    at = lambda i, minutes: (i, START + timedelta(minutes=minutes), "k")
    for rows in ([at(1, 10), at(2, 190)], [at(3, 20), at(4, 130), at(5, 59)], [at(6, 200)]):
        put(spark, tmp_path / "in", shape, rows)
    table = tables.WindowedRates(spark, str(tmp_path / "t"), 3600)
    counts, late = table.run(tables.in_batches(spark, str(tmp_path / "in"), shape), str(tmp_path / "state"))
    assert {r["window"].hour: r["n"] for r in counts.collect()} == {0: 1, 2: 1, 3: 2}
    assert sorted((r["id"], r["watermark"].hour, r["watermark"].minute) for r in late.collect()) == [(3, 2, 10), (5, 2, 10)]
    table.take(spark.createDataFrame([at(6, 200)], shape), 2)
    assert table.rates().where(F.hour("window") == 3).first()["n"] == 2
