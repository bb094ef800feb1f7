"""Streams against plain loops over the same rows, whatever the batches."""

import random

import pytest
from pyspark.sql import functions as F

from framewise.sources.shared import Store
from framewise.streaming import detector, lateness, ordering, progress, replay, requests

EVENTS = "key string, seq long, at long, event string, batch int"


def lived(rules, events, end):
    """A request's changes by a loop over every moment at which something is due."""
    out = []
    for key in sorted({e[0] for e in events}):
        state, since = "new", 0
        for at, _, event in [*sorted((at, seq, event) for k, seq, at, event, _ in events if k == key), (end, 0, None)]:
            while state in rules.limits and since + rules.limits[state][0] <= at:
                then, now = rules.limits[state][1], since + rules.limits[state][0]
                out.append((key, now, "timed out", state, then, now - since, False))
                state, since = ("new", 0) if then in rules.last else (then, now)
            if event is None:
                continue
            then = rules.moves.get((state, event))
            out.append((key, at, event, state, then or state, 0 if state == "new" else at - since, then is None))
            if then:
                state, since = ("new", 0) if then in rules.last else (then, at)
    return sorted(out)


def test_lives_depend_on_events_alone(spark):
    """Two arrival orders within the delay; ties go by number; timers fire for states that no event ends."""
    lot, end = random.Random(11), 10**9
    events = []
    for key in "abcdefghijkl":
        at = 1_000
        for seq in range(lot.randrange(1, 14)):
            at += lot.choice([0, 1_000, 20_000, 70_000, 75_000, 200_000])
            events.append((key, seq, at, lot.choice(["loaded", "asked", "asked", "answered", "answered", "broken", "closed"]), 0))
    want = lived(requests.PICTURE, events, end)
    assert {r[2] for r in want} == {"timed out", "loaded", "asked", "answered", "broken", "closed"}
    for late in (0, 50_000):
        dealt = [(*e[:4], (e[2] + (late * (i % 2))) // 400_000) for i, e in enumerate(events)]
        ticks = [("tick", i, end + 60_000 + i, None, 10_000 + i) for i in range(2)]
        store = Store(spark, "lives")
        replay.replayed(spark.createDataFrame(dealt + ticks, EVENTS), "batch", replay.to_table(lambda s: requests.lives(s.drop("batch"), "key")), store)
        assert sorted(tuple(r) for r in spark.read.schema(requests.CHANGES.format(kind="key string")).parquet(store.path("out")).collect()) == want


ROWS = "key string, at long, value double, last boolean, batch int"


def test_rows_leave_in_order_and_wait_behind_gaps(spark):
    """One key is whole, one lacks a row, one comes twice; the place in the sink's batches is the order."""
    lot = random.Random(9)
    rows = [(key, i, float(i), i == 9, lot.randrange(4)) for key in ("whole", "gap", "twice") for i in range(10) if (key, i) != ("gap", 6)]
    rows += [(*r[:4], 3) for r in rows if r[0] == "twice" and r[4] < 3]
    store, left = Store(spark, "ordered"), []

    def seen(run, batch):
        now = spark.read.schema(ordering.ORDERED.format(kind="key string")).parquet(store.path("out")).collect()
        left.append({k: sorted(r.at for r in now if r.key == k) for k in ("whole", "gap", "twice")})

    replay.replayed(spark.createDataFrame(rows, ROWS), "batch", replay.to_table(lambda s: ordering.in_order(s, "key")), store, seen)
    for batch, now in enumerate(left):
        for key, found in now.items():
            come = {i for k, i, _, _, b in rows if k == key and b <= batch}
            assert found == [*range(next(i for i in range(11) if i not in come))]
    out = sorted(spark.read.schema(ordering.ORDERED.format(kind="key string")).parquet(store.path("out")).collect(), key=lambda r: (r.key, r.place))
    assert [r.at for r in out] == [*range(6), *range(10), *range(10)] and all(r.place == r.at == r.value for r in out)
    assert all(a.left_in <= b.left_in for a, b in zip(out, out[1:], strict=False) if a.key == b.key)


def test_late_rows_are_kept_apart_and_none_is_lost(spark):
    """Kept and refused rows are the input together; a batch that is tried again replaces what the first try left."""
    rows = spark.createDataFrame([(i, f"2024-01-01 {h:02}:00:00" if h is not None else None, b) for i, (h, b) in enumerate([(1, 0), (5, 0), (4, 1), (2, 1), (9, 1), (3, 2), (8, 2), (None, 2), (7, 3), (12, 3)])], "id long, ts string, batch int").withColumn("ts", F.col("ts").cast("timestamp")).withColumnRenamed("batch", "arrival")
    store = Store(spark, "late")
    gate = lateness.Gate(store, "ts", "2 hours")
    replay.replayed(rows, "arrival", lateness.gated(gate), store)
    kept = {(r.id, r.batch) for r in gate.kept(rows).collect()}
    refused = {(r.id, r.batch, r.watermark and r.watermark.hour) for r in gate.refused(rows).collect()}
    assert kept == {(0, 0), (1, 0), (2, 1), (4, 1), (6, 2), (8, 3), (9, 3)}
    assert refused == {(3, 1, 3), (5, 2, 7), (7, 2, 7)}
    gate(rows.where("arrival = 1"), 1)
    assert {(r.id, r.batch) for r in gate.kept(rows).collect()} == kept and gate.clock().count() == 4


def test_progress_can_be_read_while_the_run_goes_on(spark):
    rows = spark.range(100).withColumn("batch", (F.col("id") % 5).cast("int"))
    store, during = Store(spark, "progress"), []

    class Told(progress.Progress):
        def onQueryProgress(self, event):
            super().onQueryProgress(event)
            during.append((self.lines().where("not ended").count(), self.over.is_set()))

    original, progress.Progress = progress.Progress, Told
    try:
        seen = progress.watched(rows, "batch", store, replay.to_table(lambda s: s))
    finally:
        progress.Progress = original
    assert during[0] == (1, False)
    lines = seen.lines()
    assert lines.where("ended").count() == 1
    told = progress.remaining(lines, 100).orderBy("batch").collect()
    assert [(r.rows, r.done, r.share, r.left) for r in told] == [(20, 20 * i, i / 5, 100 - 20 * i) for i in range(1, 6)]
    assert told[-1].seconds_left == 0 and all(r.seconds_left > 0 for r in told[:-1])
    assert progress.remaining(seen.lines().limit(0), 0).count() == 0


@pytest.mark.parametrize("conf", [None, "x"])
def test_state_store_setting_is_put_back(spark, conf):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    try:
        if conf:
            spark.conf.set(name, conf)
        with replay.keyed_state(spark):
            assert spark.conf.get(name) == replay.ROCKS
        assert spark.conf.get(name, None) == (conf or before)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


SHOTS = "source_id long, shot long, i long, value double, last boolean, batch int"


def test_slices_of_many_shots_share_groups(spark):
    """A few groups hold all shots, not a state a shot; open shots go on over batches that lack them; a null is no value."""
    lot, rows = random.Random(5), []
    for shot in range(300):
        n, cut = lot.randrange(1, 9), sorted(lot.randrange(4) for _ in range(8))
        rows += [(shot % 7, shot, i, None if lot.random() < 0.2 else float(lot.randrange(100)), i == n - 1, cut[i]) for i in range(n)]
    store, states = Store(spark, "slices"), []
    replay.replayed(spark.createDataFrame(rows, SHOTS), "batch", replay.to_table(lambda s: detector.causal_slices(s.drop("batch"), deals=5)), store, lambda run, _: states.append(run.lastProgress["stateOperators"][0]["numRowsTotal"]))
    values, want = {r[:3]: r[3] for r in rows}, {}
    for source, shot, i in values:
        near = [x for x in (values.get((source, shot, j)) for j in range(i - 2, i + 1)) if x is not None]
        want[source, shot, i] = sum(near) / len(near) if near else None
    out = spark.read.schema("source_id long, shot long, i long, causal double").parquet(store.path("out")).collect()
    assert len(out) == len(want) and {(r.source_id, r.shot, r.i) for r in out} == set(want)
    assert all(r.causal == pytest.approx(want[r.source_id, r.shot, r.i]) for r in out)
    assert 0 < max(states) <= 5 and states[-1] == 0


@pytest.mark.parametrize("most", [200_000, 50])
def test_waiting_rows_share_entries_of_the_state(spark, most):
    """A state has entries by key and a thousand numbers, not by row, also where a part of a batch has to go back to it;
    rows behind a key's end are forgotten with it."""
    lot, long = random.Random(3), 2_600
    rows = [("long", i, float(i), i == long - 1, 2 if i == 1 else lot.randrange(3)) for i in range(long)]
    rows += [(f"k{k}", i, None if i == 4 else float(i), i == 29, 2 if i == 0 else lot.randrange(2)) for k in range(20) for i in range(30)]
    rows += [("ends", i, float(i), i == 5, 0 if i > 5 else 1) for i in (0, 1, 2, 3, 4, 5, 7, 3_000)]
    store, states = Store(spark, "ordered"), []
    replay.replayed(spark.createDataFrame(rows, ROWS), "batch", replay.to_table(lambda s: ordering.in_order(s, "key", 3, most)), store, lambda run, _: states.append(run.lastProgress["stateOperators"][0]["numRowsTotal"]))
    out = sorted(tuple(r) for r in spark.read.schema(ordering.ORDERED.format(kind="key string")).parquet(store.path("out")).collect())
    gone, want = {}, []
    for key, at, value, _, batch in sorted(r[:5] for r in rows if r[:2] not in (("ends", 7), ("ends", 3_000))):
        gone[key] = max(gone.get(key, 0), batch)
        want.append((key, at, value, at, gone[key]))
    assert [(*r[:2], r[3], r[4]) for r in out] == [(*r[:2], r[3], r[4]) for r in want]
    assert all(a[2] == b[2] for a, b in zip(out, want, strict=True))
    assert 0 < max(states) <= 2 * 21 + 3 + 4 and states[-1] == 0


def test_events_and_deadlines_share_entries_of_the_state(spark):
    """What waits for the watermark is an entry a group and span of time, not an entry and a timer an event."""
    lot, end, base = random.Random(2), 10**9, 600_000
    events = [(f"r{k}", seq, base + seq * 12_000 + lot.randrange(3) * 1_000, lot.choice(["loaded", "asked", "answered", "broken", "closed"]), 0) for k in range(300) for seq in range(4)]
    ticks = [("tick", i, end + 60_000 + i, None, 1 + i) for i in range(2)]
    store, states = Store(spark, "lives"), []
    replay.replayed(spark.createDataFrame(events + ticks, EVENTS), "batch", replay.to_table(lambda s: requests.lives(s.drop("batch"), "key", deals=4)), store, lambda run, _: states.append(run.lastProgress["stateOperators"][0]["numRowsTotal"]))
    out = spark.read.schema(requests.CHANGES.format(kind="key string")).parquet(store.path("out")).collect()
    assert sorted(tuple(r) for r in out) == lived(requests.PICTURE, events, end)
    assert 0 < states[0] <= 4 * 6 and states[-1] == 0


def test_state_has_partitions_for_its_rows(spark):
    """A small stream opens and commits a state for each core, however many partitions the session shuffles to."""
    name, cores = "spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism
    before = spark.conf.get(name)
    try:
        for session, rows, want in ((600, 1_000, cores), (600, replay.STATE_ROWS * cores * 10, cores * 10), (2, 1_000, 2)):
            spark.conf.set(name, session)
            with replay.keyed_state(spark, rows):
                assert spark.conf.get(name) == str(want)
            assert spark.conf.get(name) == str(session)
    finally:
        spark.conf.set(name, before)
