"""Cases that a reviewer found: results on large keys and halves, whole pairs, and steps whose work must not outgrow the rows."""

import random

import duckdb
from pyspark.sql import functions as F

from framewise import registry
from framewise.functions import text
from framewise.operators import ledger, records, sampling
from framewise.sources.shared import Store


def written(spark, tmp_path, **tables):
    """A folder of tables as a query reads them."""
    for name, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def same_as_sql(spark, name, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    found, told = registry.QUERIES[name](spark, folder), con.sql(registry.ORACLES[name])
    at = [told.columns.index(c) for c in found.columns]
    rows = sorted((tuple(r) for r in found.collect()), key=str)
    assert rows == sorted((tuple(r[i] for i in at) for r in told.fetchall()), key=str)
    return rows


def test_halves_of_a_size_go_to_even_and_nothing_said_of_no_time(spark):
    counts = [0, 1023, 1024, 1152, 1408, 1 << 20, (1 << 20) + (1 << 17), (1 << 20) * 999 + (5 << 17), (1 << 30) + (3 << 27), (1 << 40) + (1 << 37), 1048575, None]
    n = lambda b: next((f"{b / 1024**p:.2f} {u}" for p, u in ((4, "TiB"), (3, "GiB"), (2, "MiB"), (1, "KiB")) if b >= 1024**p), f"{b} B")
    told = spark.createDataFrame([(c,) for c in counts], "b long").select("b", text.size_said(F.col("b")).alias("s"), text.duration_said(F.col("b")).alias("t")).collect()
    assert {r["b"]: r["s"] for r in told} == {c: None if c is None else n(c) for c in counts}
    assert [r["t"] for r in told if r["b"] is None] == [None]


def test_names_of_long_keys_are_those_of_the_sql(spark, tmp_path):
    rows = spark.createDataFrame([(k,) for k in (0, 42, 999_999, 1_000_000, 12_345_678, None)], "o_orderkey long")
    assert (1_000_000, "seg_100000", "seg_100000.partial") in same_as_sql(spark, "prj14_names", written(spark, tmp_path, orders=rows), "orders")




def events(spark, rows):
    """(source, kind, value), in order."""
    return spark.createDataFrame([(i, s, k, v) for i, (s, k, v) in enumerate(rows)], "event_id long, user_id long, event_type string, value double").select(
        "event_id", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, event_id)").alias("ts"), "user_id", "event_type", "value", F.concat(F.lit('{"k": '), F.col("event_id").cast("string"), F.lit("}")).alias("props"))


def test_seeds_within_five_are_pairs_wherever_they_lie(spark, tmp_path):
    rows = [(s, "view", float(s * s % 17)) for s in (-7, -3, 0, 3, 4, 5, 6, 9, 11, 17) for _ in range(2)]
    told = same_as_sql(spark, "jn09_seed_pairs", written(spark, tmp_path, events=events(spark, rows)), "events")
    assert {(r[1], r[2]) for r in told} == {(-7, -3), (-3, 0), (0, 3), (0, 4), (0, 5), (3, 4), (3, 5), (3, 6), (4, 5), (4, 6), (4, 9), (5, 6), (5, 9), (6, 9), (6, 11), (9, 11)}


def test_mixed_windows_are_those_of_the_sql_without_a_shuffle_of_places(spark, tmp_path):
    keys = spark.createDataFrame([(k,) for k in (*range(-62, 130), 7, 7, 59, None)], "o_orderkey long")
    folder = written(spark, tmp_path, orders=keys)
    assert len(same_as_sql(spark, "wn08_overlap_mix", folder, "orders")) > 3000
    # the one shuffle is that of the shots, under all that is exploded
    plan = registry.QUERIES["wn08_overlap_mix"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") > plan.rindex("Generate")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_first_fit_of_listed_twice_and_unsized_parts_without_exploded_settings(spark, tmp_path):
    parts = spark.createDataFrame([(1, 1), (2, 12), (2, 30), (3, None), (4, 50), (5, None), (5, 7), (None, 3), (6, 45), (7, 46)], "p_partkey long, p_size int")
    folder = written(spark, tmp_path, part=parts)
    assert len(same_as_sql(spark, "flt14_first_fit", folder, "part")) == 7
    assert "Generate" not in plan_of(registry.QUERIES["flt14_first_fit"](spark, folder))


def test_three_simplest_fractions_are_found_in_the_row(spark, tmp_path):
    parts = spark.createDataFrame([(1, 1000.0), (2, 31.0), (3, 333.33), (4, 0.01), (5, None), (6, 2099.99), (6, 1500.0), (6, 1500.0)], "p_partkey long, p_retailprice double")
    told = same_as_sql(spark, "st09_simplest_fractions", written(spark, tmp_path, part=parts), "part")
    assert (6, 3, 2, 1) in told and (6, 3, 2, 2) in told
    rows = spark.createDataFrame([(x,) for x in (0, 1, 3100, 33333, 100000, 199999, None)], "x long")
    every = text.fractions_near(rows, "x", 100_000, 4, 30).collect()
    first = {x: sorted((r["den"], r["num"]) for r in every if r["x"] == x)[:3] for x in (3100, 33333, 100000, 199999)}
    found = text.simplest_near(rows, "x", 100_000, 4, 30, 3).collect()
    assert {x: sorted((r["den"], r["num"]) for r in found if r["x"] == x) for x in first} == first and len(found) == sum(map(len, first.values()))


def test_entries_that_are_null_or_alike_in_deep_records(spark, tmp_path):
    pairs = ['{"a":null}', "{}"], ['{"a":null}', '{"a":1}'], ['{"a":[null,1]}', '{"a":[2,1.0]}'], ['{"a":null}', '{"a":null}'], ['{"b":{"c":[]}}', '{"b":{"c":[],"d":{}}}'], ["[]", "[]"], ["[[1]]", "[[1,2]]"]
    side = lambda i: spark.createDataFrame([(k, p[i]) for k, p in enumerate(pairs)], "k long, r string")
    out = records.deep_diff(side(0), side(1), ["k"], "r", Store(spark, "diff", str(tmp_path)))
    assert {tuple(r) for r in out.collect()} == {(0, "a", "null", None, "missing"), (1, "a", "null", "1", "kind"), (2, "a[0]", "null", "2", "kind"), (4, "b.d", None, "{}", "missing"), (6, "[0]", "1", "2", "length")}
    # what is alike goes no level further
    levels = spark.read.parquet(*[str(f) for f in tmp_path.iterdir()])
    assert levels.where("path in ('b.c', 'a[1]')").isEmpty()


def test_totals_of_a_closure_are_those_of_its_pairs_but_follow_rings_as_one(spark, tmp_path):
    lot = random.Random(4)
    edges = {(lot.randrange(30), lot.randrange(30)) for _ in range(36)} | {(100 + i, 100 + (i + 1) % 8) for i in range(8)} | {(200 + i, 100 + i % 8) for i in range(50)} | {(5, 5), (300, 301), (301, 300), (103, 300), (None, 1), (1, None)}
    frame = spark.createDataFrame(sorted(edges, key=str), "a long, b long")
    roots = spark.createDataFrame([(i,) for i in (*range(32), *range(100, 108), *range(200, 250), 300, 999, 7, None)], "root long")
    pairs = ledger.closure(frame, roots, Store(spark, "t")).groupBy("root").agg(F.count("*").alias("needs"), F.max("node").alias("last"))
    told = ledger.closure_totals(frame, roots, Store(spark, "t", str(tmp_path)))
    assert {tuple(r) for r in told.collect()} == {tuple(r) for r in pairs.collect()} and told.count() == 32 + 8 + 50 + 2
    # fifty roots before a ring of eight: one pair each for it, and for the ring behind it
    found = spark.read.parquet(*[str(f) for f in tmp_path.iterdir() if f.name.endswith("-found")])
    assert found.where("root >= 200 and root < 250").count() == 150


def test_draws_of_a_few_series_are_spread_over_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(g, i, i * i % 7) for g in range(3) for i in range(30)], "g long, i long, v long")
    out = sampling.blocks(rows, "g", "i", "v", 10, Store(spark, "blocks", str(tmp_path)), 60, 4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [g" in plan and plan.index("RepartitionByExpression") > plan.index("Generate")
    assert out.count() == 3


def test_verified_ranges_meet_their_checksums_without_a_hash_table(spark, tmp_path):
    rows = [(s, "signup" if (s, i) in {(1, 0), (1, 30), (2, 31), (3, 7), (None, 2)} else "view", 1.0) for i in range(45) for s in (1, 2, 3, None)]
    folder = written(spark, tmp_path, events=events(spark, rows))
    told = same_as_sql(spark, "src07_verified_range", folder, "events")
    assert {(r[0], r[1] - r[2]) for r in told} == {(1, 30), (3, 7)} and {r[3] for r in told} == {True, False}
    plan = registry.QUERIES["src07_verified_range"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "HashJoin" not in plan


