"""Queries over times and grids, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framewise.operators import timeline as T
from framewise.sources.bindings import FRAMES_SQL, frames, table

QUERIES, ORACLES = {}, {}
HOUR = 3_600_000_000


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


W = "window w as (partition by source_id order by frame)"
PLACES = f"""with {FRAMES_SQL}, rel as (select *, pts - min(pts) over (partition by source_id) as after from frames),
placed as (select *, cast(-floor((cast({HOUR} - 2 * after as hugeint)) / (2.0 * {HOUR})) as bigint) as place from rel),
devs as (select *, after - place * {HOUR} as off from placed),
shown as (select * from (select *, row_number() over (partition by source_id, place order by frame) as i from devs) where i = 1),
nexts as (select *, lead(place) over (partition by source_id order by place) as nx, lag(p, 1, cast(0 as float)) over (partition by source_id order by place) as before from shown)
"""


@query("src02_frames", f"with {FRAMES_SQL} select source_id, frame, pts, p, error from frames")
def src02_frames(spark, d):
    return frames(spark, d).select("source_id", "frame", "pts", "p", "error")


@query("src03_keyframes", f"with {FRAMES_SQL} select distinct source_id, pts from frames where is_key")
def src03_keyframes(spark, d):
    return frames(spark, d).where("is_key").select("source_id", "pts").distinct()


@query("set05_keyframe_times", f"with {FRAMES_SQL} select distinct pts from frames where is_key")
def set05_keyframe_times(spark, d):
    return frames(spark, d).where("is_key").select("pts").distinct()


@query("src08_sequential_skip", f"with {FRAMES_SQL} select source_id, frame, round(value / 65535.0, 9) as sample from frames where frame >= 10")
def src08_sequential_skip(spark, d):
    return frames(spark, d).where("frame >= 10").select("source_id", "frame", F.round(F.col("value") / 65535.0, 9).alias("sample"))


@query("src18_trim_window", f"with {FRAMES_SQL}, r as (select *, pts - min(pts) over (partition by source_id) as since from frames) select source_id, count(*) as frames, min(frame) as first, max(frame) as last from r where since between {HOUR} and {24 * HOUR} group by 1")
def src18_trim_window(spark, d):
    at = F.col("pts") - F.min("pts").over(Window.partitionBy("source_id"))
    return frames(spark, d).withColumn("at", at).where(F.col("at").between(HOUR, 24 * HOUR)).groupBy("source_id").agg(F.count("*").alias("frames"), F.min("frame").alias("first"), F.max("frame").alias("last"))


@query("src05_error_follows", """with t as (select conv_id, turn, role, case when role = 'user' then turn end as u from conversations),
f as (select conv_id, role, last_value(u ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) as after from t)
select conv_id, after, cast(max(case when role = 'assistant' then 1 else 0 end) as bigint) as answered from f group by 1, 2""")
def src05_error_follows(spark, d):
    by = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    f = table(spark, d, "conversations").select("conv_id", "role", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(by).alias("after"))
    return f.groupBy("conv_id", "after").agg(F.max((F.col("role") == "assistant").cast("long")).alias("answered"))


@query("jn02_asof_keyframe", f"with {FRAMES_SQL}, keys as (select distinct source_id, pts as key_pts from frames where is_key) select f.source_id, f.frame, coalesce(k.key_pts, -1) as key_pts from frames f asof left join keys k on f.source_id = k.source_id and f.pts >= k.key_pts")
def jn02_asof_keyframe(spark, d):
    return T.asof_keyframe(frames(spark, d))


@query("jn02_first_from_keyframe", f"with {FRAMES_SQL}, keys as (select distinct source_id, pts as key_pts from frames where is_key) select k.source_id, k.key_pts, min(f.frame) as frame from keys k join frames f on f.source_id = k.source_id and f.pts >= k.key_pts group by 1, 2")
def jn02_first_from_keyframe(spark, d):
    return T.first_from_keyframe(frames(spark, d))


@query("jn01_positional_join", f"with {FRAMES_SQL}, a as (select source_id, frame, pts from frames), b as (select source_id, frame, p from frames), j as (select * from a full join b using (source_id, frame)) select source_id, cast(count(*) as bigint) as frames, cast(count_if(pts is null or p is null) as bigint) as unmatched from j group by 1")
def jn01_positional_join(spark, d):
    f = frames(spark, d)
    j = f.select("source_id", "frame", "pts").join(f.select("source_id", "frame", "p"), ["source_id", "frame"], "full")
    return j.groupBy("source_id").agg(F.count("*").alias("frames"), F.count_if(F.col("pts").isNull() | F.col("p").isNull()).alias("unmatched"))


@query("jn05_nearest_place", PLACES + "select source_id, frame, place, off from devs")
def jn05_nearest_place(spark, d):
    return T.places(frames(spark, d), HOUR).select("source_id", "frame", "place", "off")


@query("ag02_timeline_summary", PLACES + f"""select source_id, min(place) as first_place, max(place) as last_place, max(abs(off)) as most_off, cast(count_if(abs(off) > {HOUR // 4}) as bigint) as n_off, min(case when abs(off) > {HOUR // 4} then frame end) as first_off from devs group by 1""")
def ag02_timeline_summary(spark, d):
    return T.summary(T.places(frames(spark, d), HOUR), HOUR // 4)


@query("wn04_densified", PLACES + "select source_id, frame, place + k as place, k as copy from (select source_id, frame, place, unnest(range(0, coalesce(nx, place + 1) - place)) as k from nexts)")
def wn04_densified(spark, d):
    return T.densified(T.places(frames(spark, d), HOUR))


@query("wn05_spread", PLACES + ", each as (select source_id, place + k as place, p, before, k = coalesce(nx, place + 1) - place - 1 as last from (select *, unnest(range(0, coalesce(nx, place + 1) - place)) as k from nexts)) select source_id, place, case when last then p else least(p, before) end as p from each")
def wn05_spread(spark, d):
    return T.spread(T.places(frames(spark, d), HOUR))


@query("ag05_holes", PLACES + """, g as (select *, nx - place - 1 as gap from nexts)
select source_id, cast(count_if(gap > 0) as bigint) as n_runs, min(case when gap > 0 then place + 1 end) as first, coalesce(max(gap), 0) as longest, cast(coalesce(sum(gap), 0) as bigint) as missing, max(place) - min(place) + 1 as places from g group by 1""")
def ag05_holes(spark, d):
    return T.holes(T.places(frames(spark, d), HOUR))


@query("ag01_steps", f"with {FRAMES_SQL}, s as (select *, pts - lag(pts) over w as step from frames {W}) select source_id, count(step) as n, min(step) as least, max(step) as most from s group by 1")
def ag01_steps(spark, d):
    return T.steps(frames(spark, d))


@query("wn02_steps_of_frames", f"with {FRAMES_SQL} select source_id, frame, pts - lag(pts) over w as step from frames {W}")
def wn02_steps_of_frames(spark, d):
    return frames(spark, d).select("source_id", "frame", (F.col("pts") - F.lag("pts").over(T.by_source())).alias("step"))


@query("flt05_constant_rate", f"with {FRAMES_SQL}, s as (select *, pts - lag(pts) over w as step from frames {W}) select source_id, count(step) as n, min(step) as least, max(step) as most from s group by 1 having max(step) - min(step) <= {200 * HOUR}")
def flt05_constant_rate(spark, d):
    return T.constant_rate(frames(spark, d), 200 * HOUR)


@query("flt06_discontinuity", f"with {FRAMES_SQL}, s as (select *, pts - lag(pts) over w as step from frames {W}), l as (select *, min(step) over (partition by source_id) as least from s), b as (select *, row_number() over (partition by source_id order by frame) as i from l where step < -100000 or (step > {10 * HOUR} and step > least + 1000)) select source_id, frame, step from b where i = 1")
def flt06_discontinuity(spark, d):
    return T.discontinuity(frames(spark, d), 10 * HOUR, 100_000)


@query("flt03_seek_selects", f"with {FRAMES_SQL} select source_id, frame, coalesce(max(pts) over (partition by source_id order by frame rows between unbounded preceding and 1 preceding) < pts, true) and min(pts) over (partition by source_id order by frame rows between current row and unbounded following) = pts as exact from frames")
def flt03_seek_selects(spark, d):
    return T.selects(frames(spark, d))


@query("wn03_running", f"with {FRAMES_SQL} select source_id, frame, max(pts) over (partition by source_id order by frame rows between unbounded preceding and current row) as highest, min(pts) over r as lowest_after, bool_or(error) over r as error_after from frames window r as (partition by source_id order by frame rows between current row and unbounded following)")
def wn03_running(spark, d):
    return T.running(frames(spark, d))


@query("ss04_refused_times", f"with {FRAMES_SQL}, s as (select *, pts - max(pts) over (partition by source_id order by event_id rows between unbounded preceding and 1 preceding) as step from frames) select source_id, cast(count_if(step < 0) as bigint) as backward, cast(count_if(step = 0) as bigint) as held from s group by 1")
def ss04_refused_times(spark, d):
    by = Window.partitionBy("source_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    s = frames(spark, d).withColumn("step", F.col("pts") - F.max("pts").over(by))
    return s.groupBy("source_id").agg(F.count_if(F.col("step") < 0).alias("backward"), F.count_if(F.col("step") == 0).alias("held"))


@query("sc01_rescaled_times", f"with {FRAMES_SQL}, r as (select source_id, frame, cast(pts - min(pts) over (partition by source_id) as hugeint) - 7200000000 as v from frames) select source_id, frame, cast(sign(v) * ((abs(v) * 2 * 24000 + 1001000000) // (2 * 1001000000)) as bigint) as ticks from r")
def sc01_rescaled_times(spark, d):
    v = F.col("pts") - F.min("pts").over(Window.partitionBy("source_id")) - 7_200_000_000
    return frames(spark, d).select("source_id", "frame", v.alias("v")).select("source_id", "frame", T.rescaled(F.col("v"), 24000, 1001000000).alias("ticks"))


@query("wn15_cumulative_offsets", """with c as (select l_orderkey, l_linenumber, cast(l_quantity as bigint) as n from lineitem),
s as (select *, sum(n) over (partition by l_orderkey order by l_linenumber, n rows between unbounded preceding and current row) as e from c)
select l_orderkey, l_linenumber, n, cast((2 * cast(e - n as bigint) * 1001000 + 24000) // 48000 as bigint) as begin_ms, cast((2 * cast(e as bigint) * 1001000 + 24000) // 48000 - (2 * cast(e - n as bigint) * 1001000 + 24000) // 48000 as bigint) as duration_ms from s""")
def wn15_cumulative_offsets(spark, d):
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "n").rowsBetween(Window.unboundedPreceding, 0)
    c = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("n"))
    s = c.withColumn("e", F.sum("n").over(by))
    ms = lambda x: T.rescaled(x, 1001000, 24000)
    return s.select("l_orderkey", "l_linenumber", "n", ms(F.col("e") - F.col("n")).alias("begin_ms"), (ms(F.col("e")) - ms(F.col("e") - F.col("n"))).alias("duration_ms"))


@query("st01_merged_events", f"with {FRAMES_SQL}, m as (select source_id, frame, 'cut' as kind from frames where is_key union all select source_id, frame, 'error' from frames where error) select source_id, frame, kind, row_number() over (partition by source_id order by frame, kind) as seq from m")
def st01_merged_events(spark, d):
    f = frames(spark, d)
    m = f.where("is_key").select("source_id", "frame", F.lit("cut").alias("kind")).unionByName(f.where("error").select("source_id", "frame", F.lit("error").alias("kind")))
    return m.withColumn("seq", F.row_number().over(Window.partitionBy("source_id").orderBy("frame", "kind")).cast("long"))


@query("st07_in_order", f"with {FRAMES_SQL} select source_id, frame, event_id from frames")
def st07_in_order(spark, d):
    return frames(spark, d).select("source_id", "frame", "event_id").repartition("source_id").sortWithinPartitions("source_id", "frame")


@query("wn20_clock_pace", f"""with {FRAMES_SQL}, a as (select source_id, frame, pts, event_id, first_value(pts) over w as p0, first_value(event_id) over w as e0 from frames {W})
select source_id, frame, round((pts - p0) / 1e6 / (event_id - e0), 3) as pace, case when (pts - p0) / 1e6 / (event_id - e0) between 0.8 * 300 and 1.25 * 300 then 'steady' else 'off' end as judged from a where event_id <> e0""")
def wn20_clock_pace(spark, d):
    w = T.by_source()
    a = frames(spark, d).select("source_id", "frame", (F.col("pts") - F.first("pts").over(w)).alias("dp"), (F.col("event_id") - F.first("event_id").over(w)).alias("de")).where("de <> 0")
    pace = F.col("dp") / F.lit(1e6) / F.col("de")
    return a.select("source_id", "frame", F.round(pace, 3).alias("pace"), F.when(pace.between(0.8 * 300, 1.25 * 300), "steady").otherwise("off").alias("judged"))


@query("wn12_rolling_median", f"""with {FRAMES_SQL}, r as (select source_id, frame + 1 as seq, value / 50 as ratio from frames union all select distinct source_id, 0, 1.0 from frames)
select source_id, seq, round(quantile_cont(ratio, 0.5) over (partition by source_id order by seq rows between 4 preceding and current row), 6) as ratio from r""")
def wn12_rolling_median(spark, d):
    f = frames(spark, d)
    r = f.select("source_id", (F.col("frame") + 1).alias("seq"), (F.col("value") / 50).alias("ratio")).unionByName(f.select("source_id").distinct().select("source_id", F.lit(0).cast("long").alias("seq"), F.lit(1.0).alias("ratio")))
    by = Window.partitionBy("source_id").orderBy("seq").rowsBetween(-4, 0)
    return r.select("source_id", "seq", F.round(F.percentile("ratio", 0.5).over(by), 6).alias("ratio"))


@query("wn18_phase_changes", f"with {FRAMES_SQL}, c as (select source_id, frame, event_type, coalesce(lag(event_type) over w <> event_type, true) as enters from frames {W}) select source_id, event_type, cast(count_if(enters) as bigint) as entries, count(*) as units from c group by 1, 2")
def wn18_phase_changes(spark, d):
    c = frames(spark, d).withColumn("enters", F.coalesce(F.lag("event_type").over(T.by_source()) != F.col("event_type"), F.lit(True)))
    return c.groupBy("source_id", "event_type").agg(F.count_if("enters").alias("entries"), F.count("*").alias("units"))
