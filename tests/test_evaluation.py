"""Records, draws and thresholds against plain Python."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.operators import reading, records, sampling
from framewise.sources.shared import Store


def nested(lot, depth=0):
    kind = lot.choice("ssssoa" if depth else "oa") if depth < 3 else "s"
    if kind == "o":
        return {k: nested(lot, depth + 1) for k in lot.sample("abcde", lot.randrange(4))}
    if kind == "a":
        return [nested(lot, depth + 1) for _ in range(lot.randrange(4))]
    return lot.choice([None, True, False, 0, 1, 1.0, -2.5, "", "x", "ä b", '"q"', 10**12])


def changed(value, lot):
    if lot.random() < 0.15:
        return nested(lot, 2)
    if isinstance(value, dict):
        out = {k: changed(v, lot) for k, v in value.items() if lot.random() < 0.9}
        return out | ({"z": nested(lot, 2)} if lot.random() < 0.1 else {})
    if isinstance(value, list):
        return [changed(v, lot) for v in value] + ([7] if lot.random() < 0.1 else [])
    return value


def sort(v):
    return "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "number" if isinstance(v, (int, float)) and not isinstance(v, bool) else type(v).__name__


def differences(a, b, at, bare, ignored):
    if bare in ignored:
        return
    if sort(a) != sort(b):
        yield at, "kind"
    elif isinstance(a, dict):
        for k in {*a, *b}:
            inner, plain = (f"{at}.{k}" if at else k), (f"{bare}.{k}" if bare else k)
            if k in a and k in b:
                yield from differences(a[k], b[k], inner, plain, ignored)
            elif plain not in ignored:
                yield inner, "missing"
    elif isinstance(a, list):
        if len(a) != len(b):
            yield at, "length"
        else:
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                yield from differences(x, y, f"{at}[{i}]", bare, ignored)
    elif a != b:
        yield at, "value"


@pytest.mark.parametrize("ignored", [(), ("a", "b.c")])
def test_deep_differences(spark, ignored):
    lot = random.Random(2)
    old = {i: nested(lot) for i in range(120)}
    new = {i: changed(v, lot) for i, v in old.items() if i % 20}
    new[500] = {"only": "new"}
    frame = lambda of: spark.createDataFrame([(k, json.dumps(v)) for k, v in of.items()], "k long, r string").repartition(3)
    out = records.deep_diff(frame(old), frame(new), ["k"], "r", Store(spark, "diff"), ignored).collect()
    want = {(k, *d) for k in old.keys() & new.keys() for d in differences(old[k], new[k], "", "", ignored)} | {(k, "", "missing") for k in old.keys() ^ new.keys()}
    assert {(r.k, r.path, r.why) for r in out} == want and len(out) == len(want)
    assert {r.why for r in out} == {"missing", "length", "kind", "value"}
    assert all(r.old is None for r in out if r.k == 500) and all(r.new is None for r in out if r.k not in new)


def test_no_records_and_bad_ones(spark):
    none = spark.createDataFrame([], "k long, r string")
    assert records.deep_diff(none, none, ["k"], "r", Store(spark, "diff")).count() == 0
    null = spark.createDataFrame([(1, None)], "k long, r string")
    assert records.deep_diff(null, null, ["k"], "r", Store(spark, "diff")).count() == 0
    with pytest.raises(Exception, match="MALFORMED"):
        records.deep_diff(spark.createDataFrame([(1, "{")], "k long, r string"), null, ["k"], "r", Store(spark, "diff")).count()


def lot_of(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def count_of(number):
    return sum(number >= b for b in sampling.poisson_bounds())


def test_counts_are_poisson():
    drawn = [count_of(lot_of(1, i)) for i in range(40_000)]
    assert abs(np.mean(drawn) - 1) < 0.02 and abs(np.var(drawn) - 1) < 0.05


def test_stratified_bootstrap(spark):
    lot, draws = random.Random(6), 41
    rows = [(i, lot.choice("abc"), lot.random() < 0.4, lot.random() < 0.5, lot.random() < 0.2) for i in range(150)] + [(900, "rare", True, True, False)]
    sizes = {"a": 1000, "b": 50, "c": 300, "rare": 4}
    out = sampling.stratified(spark.createDataFrame(rows, "id long, s string, truth boolean, one boolean, two boolean"), spark.createDataFrame([*sizes.items()], "s string, size long"), ["s"], ["id"], "truth", ["one", "two"], "one", draws, 8).collect()

    def metrics(draw):
        w = {r[0]: 1 if draw == 0 else count_of(lot_of(8, draw, r[0])) for r in rows}
        scale = {s: n / t if (t := sum(w[r[0]] for r in rows if r[1] == s)) else None for s, n in sizes.items()}
        total = lambda rule: sum(w[r[0]] * scale[r[1]] for r in rows if scale[r[1]] and rule(r))
        found = {}
        for name, at in (("one", 3), ("two", 4)):
            both, cuts, hits = total(lambda r: r[at] and r[2]), total(lambda r: r[2]), total(lambda r: r[at])
            found[name, "recall"], found[name, "precision"] = both / cuts, both / hits
        return found

    all_draws = [metrics(k) for k in range(draws + 1)]
    assert len(out) == 4
    for r in out:
        value = np.array([d[r.rule, r.metric] for d in all_draws])
        gap = value - np.array([d["one", r.metric] for d in all_draws])
        want = [value[0], *np.quantile(value[1:], [0.05, 0.95]), gap[0], *np.quantile(gap[1:], [0.05, 0.95])]
        assert np.allclose([r.point, r.low, r.high, r.difference, r.difference_low, r.difference_high], want)
        assert r.low <= r.point <= r.high


def test_moving_blocks(spark):
    lot = random.Random(1)
    series = {1: [lot.randrange(100) for _ in range(73)], 2: [5], 3: [lot.randrange(9) for _ in range(8)]}
    frame = spark.createDataFrame([(g, i, v) for g, of in series.items() for i, v in enumerate(of)], "g long, i long, v long")
    for r in sampling.blocks(frame, "g", "i", "v", 10, Store(spark, "blocks"), 60, 4).collect():
        v = series[r.g]
        n, size = len(v), min(10, len(v))
        means = []
        for draw in range(1, 61):
            part = []
            for block in range(-(-n // size)):
                start = lot_of(4, r.g, draw, block) % (n - size + 1)
                part += v[start : start + size]
            means.append(np.mean(part[:n]))
        assert np.allclose([r["mean"], r.low, r.high], [np.mean(v), *np.quantile(means, [0.025, 0.975])])


def test_running_sums_of_a_hot_group(spark):
    """Nine tenths of the rows in one group, which lies over several ranges."""
    rows = [("hot" if i % 10 else f"g{i}", i, i % 7) for i in range(2000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = sampling.running(spark.createDataFrame(rows, "g string, i long, v long"), ["g"], ["i"], {"total": "v"}, Store(spark, "running")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sums, want = {}, {}
    for g, i, v in rows:
        want[g, i] = sums[g] = sums.get(g, 0) + v
    assert {(r.g, r.i): r.total for r in found} == want


def test_every_threshold(spark):
    lot = random.Random(3)
    rows = [(lot.choice("ab"), lot.choice([0.1, 0.2, 0.2, 0.5, 0.9, None]), lot.random() < 0.5, float(lot.randrange(1, 4))) for _ in range(80)] + [("none", 0.3, False, 1.0)]
    hours = {"a": 2.0, "b": 0.0, "none": 1.0}
    out = sampling.thresholds(spark.createDataFrame(rows, "g string, p double, t boolean, w double"), ["g"], "p", "t", "w", spark.createDataFrame([*hours.items()], "g string, hours double"), Store(spark, "sweep")).collect()
    assert {(r.g, r.threshold) for r in out} == {(g, p) for g, p, _, _ in rows if p is not None}
    for r in out:
        of = [x for x in rows if x[0] == r.g]
        hit = [x for x in of if x[1] is not None and x[1] >= r.threshold]
        tp, there, all_ = sum(x[3] for x in hit if x[2]), sum(x[3] for x in of if x[2]), sum(x[3] for x in hit)
        assert (r.found, r.recall, r.precision) == (all_, tp / there if there else None, tp / all_)
        assert (r.missed_per_hour, r.false_per_hour) == (((there - tp) / hours[r.g], (all_ - tp) / hours[r.g]) if hours[r.g] else (None, None))


def test_samples_weigh_what_they_stand_for(spark):
    rows = spark.createDataFrame([(i, "big" if i % 4 else None if i % 8 else "small") for i in range(800)] + [(9999, "one")], "id long, s string")
    out = sampling.sampled(rows, ["s"], ["id"], 40, 2).collect()
    sizes = {"big": 600, "small": 100, None: 100, "one": 1}
    for s, n in sizes.items():
        of = [r for r in out if r.s == s]
        assert of and sum(r.weight for r in of) == pytest.approx(n) and {r.stratum_size for r in of} == {n}
        ids = [i for i in range(800) if ("big" if i % 4 else None if i % 8 else "small") == s] if s != "one" else [9999]
        assert {r.id for r in of} == {*sorted(ids, key=lambda i: (lot_of(2, i), i))[: len(of)]}
    assert {r.id for r in sampling.sampled(rows.repartition(7), ["s"], ["id"], 40, 2).collect()} == {r.id for r in out}
    assert "WindowGroupLimit" in sampling.sampled(rows, ["s"], ["id"], 40, 2)._jdf.queryExecution().executedPlan().toString()


def test_errors_by_label(spark):
    rows = spark.createDataFrame([("cut", 2.0, True, None), ("cut", 1.0, False, True), ("fade", 3.0, True, True)], "label string, w double, one boolean, two boolean")
    assert {tuple(r) for r in sampling.errors_by_label(rows, ["one", "two"], "label", "cut", "w").collect()} == {("one", "cut", 2.0, 1.0), ("one", "fade", 3.0, 0.0), ("two", "cut", 1.0, 2.0), ("two", "fade", 3.0, 0.0)}


def test_reads_go_back_until_they_agree(spark):
    """One try a keyframe, then two, four, ... before it; ranges before all keyframes, with a frame missing, and never right."""
    keys, digest = [2, 10, 20, 30, 40, 50, 60, 70], {i: f"d{i}" for i in range(90) if i != 85}
    good = {75: 70, 65: 50, 45: 10, 33: 99}  # the latest keyframe from which a range comes out right
    frames = spark.createDataFrame([("a", i, d) for i, d in digest.items()], "source_id string, frame long, digest string")
    wants = spark.createDataFrame([("a", first, first + 4) for first in (0, 75, 65, 45, 33, 83)], "source_id string, first long, end long")
    rows = frames.withColumn("_bound", F.coalesce(*[F.when(F.col("frame").between(k, k + 3), F.lit(v if v < 99 else -1)) for k, v in good.items()], F.lit(1000)))
    out = reading.verified_ranges(rows, spark.createDataFrame([("a", k) for k in keys], "source_id string, frame long"), frames, wants, lambda start: F.when(start <= F.col("_bound"), F.col("digest")), Store(spark, "reads"))
    assert {(r["first"], r["tries"], r["start"], r["found"]) for r in out.collect()} == {(0, 0, None, False), (75, 1, 70, True), (65, 2, 50, True), (45, 3, 10, True), (33, 3, 2, False), (83, 4, 2, False)}
