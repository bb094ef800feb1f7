"""Queries over layouts, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framewise.operators import cuts as C
from framewise.operators import layout as L
from framewise.plans.cuts import RUNS
from framewise.sources.bindings import VECTORS_SQL, frames, table, vectors
from framewise.sources.shared import Store

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


LATENTS = "lat as (select o_orderkey as shot_id, 3 + o_orderkey % 60 as n from orders)"
WINDOWS = f"""with {LATENTS}, k as (select *, greatest(cast(ceil((n - 2) / 10.0) as bigint), 1) as c from lat),
b as (select *, (n + 2 * (c - 1)) // c as q, (n + 2 * (c - 1)) % c as r from k),
win as (select *, unnest(range(0, c)) as i from b),
w as (select shot_id, n, i as "window", i * q + least(i, r) - 2 * i as w_start, i * q + least(i, r) - 2 * i + q + cast(i < r as bigint) as w_end from win)
"""


def latents(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("shot_id"), (3 + F.col("o_orderkey") % 60).alias("n"))


@query("wn06_balanced_windows", WINDOWS + 'select shot_id, n, "window", w_start, w_end from w')
def wn06_balanced_windows(spark, d):
    return L.windows(latents(spark, d), "n", 12)


@query("wn08_overlap_mix", WINDOWS + """, each as (select *, unnest(range(w_start, w_end)) as place from w),
val as (select shot_id, place, "window", (place * 7 + "window" * 3) % 11 + 0.0 as x, case when "window" > 0 and place < w_start + 2 then 0.5 - 0.5 * cos(pi() * (place - w_start + 1) / 3) when place >= w_end - 2 and w_end < n then 0.5 + 0.5 * cos(pi() * (place - (w_end - 2) + 1) / 3) else 1.0 end as wt from each)
select shot_id, place, round(sum(wt * x) / sum(wt), 6) + 0.0 as blended from val group by 1, 2""")
def wn08_overlap_mix(spark, d):
    # the SQL gives a place of a shot once, however often the shot is listed
    value = lambda place, window: ((place * 7 + window * 3) % 11).cast("double")
    mixed = L.blended_windows(latents(spark, d).distinct(), "n", 12, value)
    return mixed.select("shot_id", "place", (F.round("blended", 6) + 0.0).alias("blended"))


@query("wn19_batch_boundaries", WINDOWS + """select shot_id, "window", w_end - 2 + k as place, round(0.5 - 0.5 * cos(pi() * (k + 1) / 3), 6) as weight from (select *, unnest(range(0, 2)) as k from w where w_end < n)""")
def wn19_batch_boundaries(spark, d):
    each = L.windows(latents(spark, d), "n", 12).where("w_end < n").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(1))))
    return each.select("shot_id", "window", (F.col("w_end") - 2 + F.col("k")).alias("place"), F.round(0.5 - 0.5 * F.cos(F.pi() * (F.col("k") + 1) / 3), 6).alias("weight"))


@query("jn16_tile_grid", """with p as (select p_partkey, 16 + p_size * 3 as h, 24 + p_size * 5 as w from part),
r as (select p_partkey, h, w, unnest(range(0, case when h <= 64 then 1 else cast(ceil((h - 8) / 56.0) as bigint) end)) as i from p),
c as (select *, unnest(range(0, case when w <= 64 then 1 else cast(ceil((w - 8) / 56.0) as bigint) end)) as j from r)
select p_partkey, i * 56 as top, cast(least(i * 56 + 64, h) as bigint) as bottom, j * 56 as "left", cast(least(j * 56 + 64, w) as bigint) as "right" from c""")
def jn16_tile_grid(spark, d):
    p = table(spark, d, "part").select("p_partkey", (16 + F.col("p_size") * 3).cast("long").alias("h"), (24 + F.col("p_size") * 5).cast("long").alias("w"))
    return L.tiles(p, "h", "w", F.lit(64).cast("long")).drop("h", "w")


@query("wn14_run_choice", RUNS + """, idx as (select source_id, shot, frame - min(frame) over (partition by source_id, shot) as i from marked),
each as (select *, unnest([0, 1, 2, 3]) as run from idx), fit as (select *, case when i = run then -1 else (i - run - 1) % 4 end as place from each where i >= run),
best as (select *, row_number() over (partition by source_id, shot, i order by list_position([-1, 3, 2, 0, 1], place), run) as k from fit)
select source_id, shot, i, cast(run as bigint) as run from best where k = 1""")
def wn14_run_choice(spark, d):
    i = F.col("frame") - F.min("frame").over(Window.partitionBy("source_id", "shot"))
    idx = C.with_shot(frames(spark, d)).select("source_id", "shot", i.alias("i"))
    return L.chosen_runs(idx, (0, 1, 2, 3), ("source_id", "shot"))


@query("sc08_ramps", "with n as (select distinct p_size as n from part where p_size > 0), i as (select n, unnest(range(0, n)) as i from n) select cast(n as bigint) as n, i, round(case when n = 1 then 0.5 else 0.5 - 0.5 * cos(pi() * i / (n - 1)) end, 6) as weight from i")
def sc08_ramps(spark, d):
    """A ramp of each length that the parts have."""
    n = table(spark, d, "part").where("p_size > 0").select(F.col("p_size").cast("long").alias("n")).distinct()
    return n.select("n", F.posexplode(L.ramp(F.col("n"))).alias("i", "weight")).select("n", F.col("i").cast("long").alias("i"), F.round("weight", 6).alias("weight"))


#: One merge a step; a source's bounds are a list.
MERGED = RUNS.replace("with ", "with recursive ", 1) + """, b0 as (select source_id, list_append(list(start order by start), max("end")) as b from shots group by 1),
m(source_id, b) as (select source_id, b from b0 union all select source_id, list_filter(b, lambda x: x <> b[case when i > 1 and (i = len(z) or z[i - 1] <= z[i + 1]) then i else i + 1 end])
 from (select *, list_position(z, list_min(z)) as i from (select source_id, b, list_transform(range(1, len(b)), lambda k: b[k + 1] - b[k]) as z from m where len(b) > 2)) where list_min(z) < 5),
f as (select source_id, arg_min(b, len(b)) as b from m group by 1), e as (select source_id, b, unnest(range(1, len(b))) as k from f)
select source_id, k - 1 as segment, b[k] as start, b[k + 1] as "end" from e"""


@query("st04_merged_segments", MERGED)
def st04_merged_segments(spark, d):
    return L.merge_short(C.shots(frames(spark, d)), 5)


@query("jn03_shot_to_segment", RUNS + ', seg as (select *, start // 20 as segment from shots) select source_id, shot, segment, start, "end", "end" > (segment + 1) * 20 as crosses from seg')
def jn03_shot_to_segment(spark, d):
    segment = F.floor(F.col("start") / 20)
    return C.shots(frames(spark, d)).select("source_id", "shot", segment.alias("segment"), "start", "end", (F.col("end") > (segment + 1) * 20).alias("crosses"))


@query("snk04_routed_segments", RUNS + "select source_id, frame // 20 as segment, count(*) as frames, min(frame) as first from frames group by 1, 2")
def snk04_routed_segments(spark, d):
    return frames(spark, d).groupBy("source_id", F.floor(F.col("frame") / 20).alias("segment")).agg(F.count("*").alias("frames"), F.min("frame").alias("first"))


@query("ag21_tile_mean", f"""with {VECTORS_SQL}, px as (select vec_id, unnest(v) as x, unnest(range(0, 64)) as i from vectors), t as (select *, unnest(range(0, 3)) as tile from px), ins as (select *, i - tile * 24 as o from t where i >= tile * 24 and i < least(tile * 24 + 32, 64)),
w as (select *, least(o, least(32, 64 - tile * 24) - 1 - o) + 1.0 as wt from ins) select vec_id, i, round(sum(wt * (x + tile)) / sum(wt), 6) + 0.0 as mean from w group by 1, 2""")
def ag21_tile_mean(spark, d):
    px = vectors(spark, d).select("vec_id", F.posexplode("v").alias("i", "x")).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(2))))
    o, n = F.col("i") - F.col("tile") * 24, F.least(F.lit(32), 64 - F.col("tile") * 24)
    ins = px.where((o >= 0) & (o < n)).select("vec_id", F.col("i").cast("long").alias("i"), (F.least(o, n - 1 - o) + 1.0).alias("w"), (F.col("x") + F.col("tile")).alias("x"))
    return L.blended(ins, ("vec_id",), "i", "w", "x").select("vec_id", "i", (F.round("blended", 6) + 0.0).alias("mean"))


@query("st08_pool_load", """with r as (select o_custkey, epoch(o_orderdate) // 86400 as came, epoch(o_orderdate) // 86400 + 90 as gone, cast(floor(o_totalprice) as bigint) as need from orders),
e as (select o_custkey, came as at_day, need as more from r union all select o_custkey, gone, -need from r), s as (select o_custkey, at_day, sum(more) as more from e group by 1, 2), u as (select o_custkey, sum(more) over (partition by o_custkey order by at_day) as used from s)
select o_custkey, cast(max(used) as bigint) as peak, count(*) filter (where used > 300000) as over from u group by 1""")
def st08_pool_load(spark, d):
    """What orders hold of a customer's limit, each for ninety days."""
    day = F.unix_date(F.col("o_orderdate").cast("date"))
    r = table(spark, d, "orders").select("o_custkey", day.alias("came"), (day + 90).alias("left"), F.floor("o_totalprice").alias("need"))
    return L.pool_load(r, ["o_custkey"], 300_000)


KNAPSACK = """with recursive o as (select p_partkey % 40 as item, p_size * 100 as bytes, min(cast(round(p_retailprice * 100) as bigint)) as error from part group by 1, 2),
pareto as (select * from (select *, min(error) over (partition by item order by bytes rows between unbounded preceding and 1 preceding) as best from o) where best is null or error < best),
hull as (select item, bytes, error from pareto p where not exists (select 1 from pareto a join pareto b on a.item = b.item where a.item = p.item and a.bytes < p.bytes and b.bytes > p.bytes and (p.error - a.error) * (b.bytes - a.bytes) >= (b.error - a.error) * (p.bytes - a.bytes))),
st as (select *, bytes - lag(bytes) over w as more, (lag(error) over w - error) / (bytes - lag(bytes) over w) as gain from hull window w as (partition by item order by bytes)),
seq as (select *, row_number() over (order by gain desc, item, bytes) as k from st where more is not null),
r(k, rest, gone, taken) as (select cast(0 as bigint), cast(60000 - sum(bytes) as bigint), cast([] as bigint[]), false from st where more is null
 union all select s.k, r.rest - case when s.more <= r.rest and not list_contains(r.gone, s.item) then s.more else 0 end, case when s.more <= r.rest or list_contains(r.gone, s.item) then r.gone else list_append(r.gone, s.item) end, s.more <= r.rest and not list_contains(r.gone, s.item) from r join seq s on s.k = r.k + 1),
got as (select item, bytes, error from st where more is null union all select item, bytes, error from seq join r using (k) where taken)
select item, max(bytes) as bytes, min(error) as error from got group by 1"""


@query("st05_knapsack", KNAPSACK)
def st05_knapsack(spark, d):
    options = table(spark, d, "part").select((F.col("p_partkey") % 40).alias("item"), (F.col("p_size") * 100).alias("bytes"), F.round(F.col("p_retailprice") * 100).cast("long").alias("error"))
    return L.chosen_options(options, 60_000, Store(spark, "st05"))


@query("wn17_deadline", """with u as (select o_custkey, o_orderkey, cast(floor(o_totalprice) as bigint) as cost from orders), s as (select *, sum(cost) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and current row) - cost as begin from u)
select o_custkey, cast(sum(cost) as bigint) as total, min(case when 100 * begin + 115 * cost > 90000000 then o_orderkey end) as first_missed from s group by 1""")
def wn17_deadline(spark, d):
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    u = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("cost")).withColumn("begin", F.sum("cost").over(by) - F.col("cost"))
    return u.groupBy("o_custkey").agg(F.sum("cost").alias("total"), F.min(F.when(100 * F.col("begin") + 115 * F.col("cost") > 90000000, F.col("o_orderkey"))).alias("first_missed"))


@query("st02_presentation_order", "select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey) as place from lineitem")
def st02_presentation_order(spark, d):
    by = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(by).cast("long").alias("place"))


@query("st11_best_windows", """with g as (select l_suppkey, l_partkey, l_linenumber, l_partkey // 50 as cell, l_extendedprice as score from lineitem), b as (select *, row_number() over (partition by l_suppkey, cell order by score desc, l_partkey, l_linenumber) as i from g)
select l_suppkey, cell, l_partkey, score from (select *, row_number() over (partition by l_suppkey order by score desc, cell, l_partkey) as k from b where i = 1) where k <= 3""")
def st11_best_windows(spark, d):
    g = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber", F.floor(F.col("l_partkey") / 50).alias("cell"), F.col("l_extendedprice").alias("score"))
    b = g.withColumn("i", F.row_number().over(Window.partitionBy("l_suppkey", "cell").orderBy(F.desc("score"), "l_partkey", "l_linenumber"))).where("i = 1")
    k = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("score"), "cell", "l_partkey"))
    return b.withColumn("k", k).where("k <= 3").select("l_suppkey", "cell", "l_partkey", "score")
