"""Queries over shots and cuts, with their SQL twins. A name starts with the inventory row it answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewise.operators import cuts as C
from framewise.sources.bindings import FRAMES_SQL, frames

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


RUNS = f"""with {FRAMES_SQL}, hit as (select *, frame - row_number() over (partition by source_id order by frame) as island from frames where cast(p as double) >= 0.3),
ranked as (select *, row_number() over (partition by source_id, island order by p desc, frame) as i, min(frame) over (partition by source_id, island) as first, max(frame) over (partition by source_id, island) as last from hit),
peaks as (select source_id, first, last, frame, p from ranked where i = 1),
ends as (select source_id, max(frame) as last_frame from frames group by 1),
cuts as (select source_id, frame + 1 as cut, p from peaks join ends using (source_id) where frame < last_frame),
bounds as (select source_id, cut as start from cuts union all select source_id, 0 from ends),
shots as (select source_id, row_number() over w - 1 as shot, start, coalesce(lead(start) over w, last_frame + 1) as "end" from bounds join ends using (source_id) window w as (partition by source_id order by start)),
marked as (select f.*, count(c.cut) over (partition by f.source_id order by f.frame) as shot from frames f left join cuts c on f.source_id = c.source_id and f.frame = c.cut)
"""


@query("flt01_detections", RUNS + "select source_id, frame, p from hit")
def flt01_detections(spark, d):
    return C.detections(frames(spark, d)).select("source_id", "frame", "p")


@query("flt02_possible_cuts", f"""with {FRAMES_SQL}, hit as (select *, frame - row_number() over (partition by source_id order by frame) as island from frames where cast(p as double) >= 0.1),
ranked as (select *, row_number() over (partition by source_id, island order by p desc, frame) as i from hit)
select source_id, frame, p from ranked where i = 1 and cast(p as double) < 0.3""")
def flt02_possible_cuts(spark, d):
    return C.possible(frames(spark, d)).select("source_id", "frame", "p")


@query("wn01_runs", RUNS + "select source_id, first, last, last - first + 1 as length from peaks")
def wn01_runs(spark, d):
    return C.peaks(frames(spark, d), 0.3).select("source_id", "first", "last", (F.col("last") - F.col("first") + 1).alias("length"))


@query("ag04_run_peaks", RUNS + "select source_id, frame, p from peaks")
def ag04_run_peaks(spark, d):
    return C.peaks(frames(spark, d), 0.3).select("source_id", "frame", "p")


@query("shots_of_sources", RUNS + 'select source_id, shot, start, "end", "end" - start as frames from shots')
def shots_of_sources(spark, d):
    return C.shots(frames(spark, d)).withColumn("frames", F.col("end") - F.col("start"))


@query("wn13_adjacent_bounds", RUNS + 'select source_id, start, "end" from shots')
def wn13_adjacent_bounds(spark, d):
    return C.shots(frames(spark, d)).select("source_id", "start", "end")


@query("jn04_frame_to_shot", RUNS + "select source_id, frame, shot from marked")
def jn04_frame_to_shot(spark, d):
    return C.with_shot(frames(spark, d)).select("source_id", "frame", "shot")


@query("ss03_shot_sessions", RUNS + "select source_id, shot, count(*) as frames, min(pts) as first_pts, max(pts) as last_pts from marked group by 1, 2")
def ss03_shot_sessions(spark, d):
    return C.with_shot(frames(spark, d)).groupBy("source_id", "shot").agg(F.count("*").alias("frames"), F.min("pts").alias("first_pts"), F.max("pts").alias("last_pts"))


@query("ag13_shot_statistics", RUNS + ''', edged as (select *, row_number() over (partition by source_id order by start) as i, count(*) over (partition by source_id) as n from shots)
select source_id, count(*) as shots, min("end" - start) as shortest, quantile_cont("end" - start, 0.5) as median_frames, cast(count_if("end" - start < 5) as bigint) as under_5 from edged where i > 1 and i < n group by 1''')
def ag13_shot_statistics(spark, d):
    from pyspark.sql import Window

    by = Window.partitionBy("source_id")
    edged = C.shots(frames(spark, d)).withColumn("n", F.count("*").over(by)).where((F.col("shot") > 0) & (F.col("shot") < F.col("n") - 1))
    length = F.col("end") - F.col("start")
    return edged.groupBy("source_id").agg(F.count("*").alias("shots"), F.min(length).alias("shortest"), F.percentile(length, 0.5).alias("median_frames"), F.count_if(length < 5).alias("under_5"))


@query("prj09_shot_seeds", RUNS + "select source_id, shot, 1000 + start as seed from shots")
def prj09_shot_seeds(spark, d):
    return C.shots(frames(spark, d)).select("source_id", "shot", (F.lit(1000) + F.col("start")).alias("seed"))


@query("prj07_latent_place", RUNS + """, placed as (select source_id, shot, frame - min(frame) over (partition by source_id, shot) as i from marked)
select source_id, shot, i, case when i = 0 then -1 else (i - 1) % 4 end as place, case when i = 0 then 0 else (i + 3) // 4 end as latent from placed""")
def prj07_latent_place(spark, d):
    from pyspark.sql import Window

    i = F.col("frame") - F.min("frame").over(Window.partitionBy("source_id", "shot"))
    placed = C.with_shot(frames(spark, d)).select("source_id", "shot", i.alias("i"))
    return placed.select("source_id", "shot", "i", F.when(F.col("i") == 0, F.lit(-1).cast("long")).otherwise((F.col("i") - 1) % 4).alias("place"), F.when(F.col("i") == 0, F.lit(0).cast("long")).otherwise(F.floor((F.col("i") + 3) / 4)).alias("latent"))


@query("prj08_timecodes", f"""with {FRAMES_SQL}, t as (select source_id, frame, (pts - min(pts) over (partition by source_id) + 999) // 1000 as ms, p from frames)
select source_id, frame, printf('%d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) as timecode,
 printf('%.3f', cast(floor(cast(cast(p as double) as decimal(38,18)) * 1000) as double) / 1000) as probability from t""")
def prj08_timecodes(spark, d):
    from pyspark.sql import Window

    ms = F.floor((F.col("pts") - F.min("pts").over(Window.partitionBy("source_id")) + 999) / 1000)
    return frames(spark, d).select("source_id", "frame", ms.alias("ms"), "p").select("source_id", "frame", C.timecode(F.col("ms")).alias("timecode"), C.truncated(F.col("p")).alias("probability"))


@query("snk10_cut_list", RUNS + f""", weak_hit as (select *, frame - row_number() over (partition by source_id order by frame) as island from frames where cast(p as double) >= 0.1),
weak as (select source_id, frame, p from (select *, row_number() over (partition by source_id, island order by p desc, frame) as i from weak_hit) where i = 1 and cast(p as double) < 0.3),
lines as (select source_id, cut as place, '' as mark, p from cuts union all select source_id, frame + 1, '# ', p from weak)
select source_id, place, mark || cast(place as varchar) || ' ' || printf('%.3f', cast(floor(cast(cast(p as double) as decimal(38,18)) * 1000) as double) / 1000) as line from lines""")
def snk10_cut_list(spark, d):
    f = frames(spark, d)
    both = C.cuts(f).select("source_id", F.col("cut").alias("place"), F.lit("").alias("mark"), "p").unionByName(C.possible(f).select("source_id", (F.col("frame") + 1).alias("place"), F.lit("# ").alias("mark"), "p"))
    return both.select("source_id", "place", F.concat("mark", F.col("place").cast("string"), F.lit(" "), C.truncated(F.col("p"))).alias("line"))


@query("snk11_playlist", RUNS + """, t as (select source_id, frame, (pts - min(pts) over w) // 1000 as at, (max(pts) over w - min(pts) over w) // 1000 as last from frames window w as (partition by source_id))
select c.source_id, c.cut, greatest(t.at - 1000, 0) as start_ms, least(t.at + 3000, t.last) as stop_ms from cuts c join t on c.source_id = t.source_id and c.cut = t.frame""")
def snk11_playlist(spark, d):
    from pyspark.sql import Window

    f, w = frames(spark, d), Window.partitionBy("source_id")
    t = f.select("source_id", F.col("frame").alias("cut"), F.floor((F.col("pts") - F.min("pts").over(w)) / 1000).alias("at"), F.floor((F.max("pts").over(w) - F.min("pts").over(w)) / 1000).alias("last"))
    return C.playlist(C.cuts(f).join(t, ["source_id", "cut"])).select("source_id", "cut", "start_ms", "stop_ms")


@query("wn10_local_maxima", f"""with {FRAMES_SQL}, near as (select *, lag(p) over w as b, lead(p) over w as a from frames window w as (partition by source_id order by frame))
select source_id, frame, p from near where cast(p as double) > 0.1 and (b is null or p > b) and (a is null or p >= a)""")
def wn10_local_maxima(spark, d):
    return C.local_maxima(frames(spark, d)).select("source_id", "frame", "p")


@query("wn11_neighbour_ratio", f"""with {FRAMES_SQL}, near as (select *, (sum(value) over w - value) / 4 as around, count(value) over w as n from frames window w as (partition by source_id order by frame rows between 2 preceding and 2 following))
select source_id, frame, round(case when n = 5 and around <> 0 then least(value / around, 255.0) end, 6) as ratio from near""")
def wn11_neighbour_ratio(spark, d):
    return C.neighbour_ratio(frames(spark, d), "value").select("source_id", "frame", F.round("ratio", 6).alias("ratio"))


@query("wn09_moving_mean", RUNS + "select source_id, frame, round(avg(value) over (partition by source_id, shot order by frame rows between 2 preceding and 2 following), 6) as mean from marked")
def wn09_moving_mean(spark, d):
    return C.moving_mean(C.with_shot(frames(spark, d)), "value").select("source_id", "frame", F.round("mean", 6).alias("mean"))


@query("wn16_reach", RUNS + """, seen as (select source_id, shot, row_number() over (partition by source_id, shot order by frame) - 1 as d,
 count_if(value >= 60) over w as b, count(*) over w as n from marked window w as (partition by source_id, shot order by frame rows between current row and 2 following))
select source_id, shot, min(case when b = 0 and n = 3 then d end) as reach from seen group by 1, 2""")
def wn16_reach(spark, d):
    return C.reach(C.with_shot(frames(spark, d)), F.col("value") >= 60)


@query("wn07_detector_windows", f"""with {FRAMES_SQL}, counts as (select source_id, max(frame) + 1 as n from frames group by 1),
wins as (select source_id, n, unnest(range(0, cast(ceil(n / 50) as bigint))) as "window" from counts),
each as (select source_id, n, "window", unnest(range(0, 100)) as position from wins)
select source_id, "window", position, least(greatest("window" * 50 - 25 + position, 0), n - 1) as frame from each""")
def wn07_detector_windows(spark, d):
    return C.slid(frames(spark, d))


@query("flt08_combed_warning", f"""with {FRAMES_SQL}, c as (select source_id, cast(count_if(event_type = 'error') as bigint) as combed, cast(count_if(event_type <> 'view') as bigint) as analysed from frames group by 1)
select source_id, combed, analysed from c where analysed > 0 and 10 * combed >= analysed""")
def flt08_combed_warning(spark, d):
    c = frames(spark, d).groupBy("source_id").agg(F.count_if(F.col("event_type") == "error").alias("combed"), F.count_if(F.col("event_type") != "view").alias("analysed"))
    return c.where("analysed > 0 and 10 * combed >= analysed")


@query("set06_exact_cover", RUNS + 'select source_id, sum("end" - start) = max("end") and min(start) = 0 as whole, cast(count(*) as bigint) as shots from shots group by 1')
def set06_exact_cover(spark, d):
    s = C.shots(frames(spark, d))
    return s.groupBy("source_id").agg(((F.sum(F.col("end") - F.col("start")) == F.max("end")) & (F.min("start") == 0)).alias("whole"), F.count("*").alias("shots"))


@query("ag23_boundary_means", RUNS + """, placed as (select *, frame = min(frame) over (partition by source_id, shot) as edge from marked)
select source_id, round(avg(value) filter (where edge), 6) as at_edge, round(avg(value) filter (where not edge), 6) as inside, round(avg(value) filter (where edge) / avg(value) filter (where not edge), 6) as ratio from placed group by 1""")
def ag23_boundary_means(spark, d):
    from pyspark.sql import Window

    placed = C.with_shot(frames(spark, d)).withColumn("edge", F.col("frame") == F.min("frame").over(Window.partitionBy("source_id", "shot")))
    at, inside = F.avg(F.when(F.col("edge"), F.col("value"))), F.avg(F.when(~F.col("edge"), F.col("value")))
    return placed.groupBy("source_id").agg(F.round(at, 6).alias("at_edge"), F.round(inside, 6).alias("inside"), F.round(at / inside, 6).alias("ratio"))
