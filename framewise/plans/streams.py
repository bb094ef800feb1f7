"""Streaming queries: the provided tables replayed as streams, every row of the result written once, then read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewise.operators import cuts as C
from framewise.operators import timeline as T
from framewise.plans.cuts import RUNS
from framewise.sources.bindings import FRAMES_SQL, frames, micros, table
from framewise.sources.shared import Store
from framewise.streaming import detector as S
from framewise.streaming import lateness as L
from framewise.streaming import ordering as O
from framewise.streaming import progress as P
from framewise.streaming import replay as RP
from framewise.streaming import requests as R

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


def replayed(rows: DataFrame, order: str, make, batches: int = 4) -> DataFrame:
    """Runs ``make`` over ``rows`` as a stream of ``batches`` in ``order`` and returns what its sink holds. The rows are
    written once, by batch; then the files of one batch after the other come to the stream, which each time goes on from
    its checkpoint, all in the folder of spark.checkpoint.dir. A batch has as many files as its size asks for."""
    spark = rows.sparkSession
    store = Store(spark, "stream")
    top = rows.agg(F.max(order)).first()[0] or 0
    kept = store.write(rows.withColumn("batch", F.floor(F.col(order) * batches / (top + 1)).cast("int")), "rows", "batch")
    for i in range(batches):
        kept.where(F.col("batch") == i).drop("batch").write.mode("append").parquet(store.path("in"))
        sink = make(spark.readStream.schema(rows.schema).parquet(store.path("in")))
        run = sink.writeStream.format("parquet").option("path", store.path("out")).option("checkpointLocation", store.path("state")).trigger(availableNow=True).start()
        run.awaitTermination()
    return store.read(sink, "out")


@query("ss01_push_detector", f"with {FRAMES_SQL} select source_id, frame, round(avg(value) over (partition by source_id order by frame rows between 2 preceding and 2 following), 6) as score from frames")
def ss01_push_detector(spark, d):
    f = frames(spark, d).select("source_id", "frame", "value")
    ends = f.groupBy("source_id").agg(F.max("frame").alias("end"))
    rows = f.join(ends, "source_id").select("source_id", "frame", "value", (F.col("frame") == F.col("end")).alias("last"))
    return replayed(rows, "frame", S.pushed).select("source_id", "frame", F.round("score", 6).alias("score"))


@query("ss10_request_states", """with s as (select conv_id, turn, case role when 'system' then 'starting' when 'user' then 'running' when 'assistant' then 'ready' else 'failed' end as state from conversations),
c as (select *, cast(lag(state, 1, 'new') over (partition by conv_id order by turn) <> state as int) as changed from s) select conv_id, turn, state, cast(sum(changed) over (partition by conv_id order by turn) as bigint) as changes from c""")
def ss10_request_states(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return replayed(rows, "turn", S.lifecycle, 2)


SLICED = RUNS + """, idx as (select source_id, shot, frame - min(frame) over (partition by source_id, shot) as i, value from marked), e as (select source_id, shot, max(i) + 1 as n from idx group by 1, 2),
w as (select *, case when n = 1 then 1 else greatest(5, 5 + cast(ceil((n - 5) / 4.0) as bigint) * 4) end as whole from e),
pad as (select source_id, shot, unnest(range(n, whole)) as i, n from w), every as (select source_id, shot, i, value, false as padded from idx union all select p.source_id, p.shot, p.i, x.value, true from pad p join idx x on x.source_id = p.source_id and x.shot = p.shot and x.i = p.n - 1)
select source_id, shot, case when i < 5 then 0 else (i - 5) // 4 + 1 end as slice, i, padded, round(avg(value) over (partition by source_id, shot order by i rows between 2 preceding and current row), 6) as causal from every"""


@query("ss02_shot_slices", SLICED)
def ss02_shot_slices(spark, d):
    """Shots in slices of five, then four frames, each slice with what the one before left it; the last is padded."""
    i = F.col("frame") - F.min("frame").over(Window.partitionBy("source_id", "shot"))
    idx = C.with_shot(frames(spark, d)).select("source_id", "shot", i.alias("i"), "value")
    sliced = T.slices(idx, ["source_id", "shot"])
    ends = F.max("i").over(Window.partitionBy("source_id", "shot"))
    rows = Store(spark, "slices").stage(sliced.withColumn("last", F.col("i") == ends), "rows")
    deals = max(64, rows.count() // 50_000)
    told = replayed(rows.select("source_id", "shot", "i", "value", "last"), "i", lambda s: S.causal_slices(s, deals=deals))
    return rows.join(told, ["source_id", "shot", "i"]).select("source_id", "shot", "slice", "i", "padded", F.round("causal", 6).alias("causal"))


#: When a turn happens and when it arrives, in milliseconds: later than it happens by up to a minute, as the watermark allows.
AT = "1704067200000 + turn * 60000 + (conv_id * 7919 + turn * 104729) % 97 * 1000"
ARRIVES = f"({AT}) + (conv_id * 13 + turn * 7) % 60 * 1000"
EVENT = """case role when 'system' then 'loaded' when 'user' then 'asked' else case when text like '%.' and length(text) % 9 <> 0 then 'answered' else 'broken' end end"""


def _moves_sql() -> str:
    return ", ".join(f"('{a}', '{e}', '{b}')" for (a, e), b in R.PICTURE.moves.items())


def _limits_sql() -> str:
    return ", ".join(f"('{s}', {n}, '{b}')" for s, (n, b) in R.PICTURE.limits.items())


#: The clock goes first where a limit is over before the next event; each step makes one change.
LIVES = f"""with recursive m(a, e, b) as (values {_moves_sql()}), t(a, ms, b) as (values {_limits_sql()}),
ev as (select conv_id, tm, event, row_number() over (partition by conv_id order by tm, turn) as n from (select conv_id, turn, {AT} as tm, {EVENT} as event from conversations)),
r as (select distinct conv_id, cast(1 as bigint) as n, 'new' as now, cast(0 as bigint) as since, cast(null as bigint) as tm, cast(null as varchar) as event, cast(null as varchar) as before, cast(null as varchar) as state, cast(0 as bigint) as spent, false as refused, 0 as i from ev
union all select r.conv_id, case when late then r.n else r.n + 1 end, case when s in ('failed', 'ended') then 'new' else s end, case when s in ('failed', 'ended') then 0 when refused_ then r.since else moved end,
 moved, case when late then 'timed out' else x_event end, r.now, s, case when r.now = 'new' then 0 else moved - r.since end, refused_, r.i + 1
 from (select r.conv_id, r.n, r.now, r.since, r.i, x.event as x_event, t.ms is not null and (x.tm is null or r.since + t.ms <= x.tm) as late,
  case when t.ms is not null and (x.tm is null or r.since + t.ms <= x.tm) then r.since + t.ms else x.tm end as moved,
  case when t.ms is not null and (x.tm is null or r.since + t.ms <= x.tm) then t.b else coalesce(m.b, r.now) end as s,
  not (t.ms is not null and (x.tm is null or r.since + t.ms <= x.tm)) and m.b is null as refused_
  from r left join ev x on x.conv_id = r.conv_id and x.n = r.n left join t on t.a = r.now left join m on m.a = r.now and m.e = x.event where x.tm is not null or t.ms is not null) r)
select conv_id, tm as "at", event, before, state, spent, refused from r where i > 0"""


@query("ss10_request_lifecycle", LIVES)
def ss10_request_lifecycle(spark, d):
    """Every turn an event at its time, arriving up to a minute late; states that time out, and what ends. Two ticks at the
    end move the watermark past all deadlines."""
    turns = table(spark, d, "conversations").selectExpr("conv_id", "turn as seq", f"cast({AT} as bigint) as at", f"{EVENT} as event", f"cast(floor((({ARRIVES}) - 1704067200000) / 150000.0) as int) as batch")
    ticks = spark.createDataFrame([(-1, 0, 1704067200000 + (1 + i) * 86_400_000, None, 1_000_000 + i) for i in range(2)], "conv_id long, seq long, at long, event string, batch int")
    store = Store(spark, "lives")
    deals = max(64, turns.count() // 5_000)
    RP.replayed(turns.unionByName(ticks), "batch", RP.to_table(lambda s: R.lives(s.drop("batch"), "conv_id", deals=deals)), store)
    return spark.read.schema(R.CHANGES.format(kind="conv_id long")).parquet(store.path("out"))


SHUFFLED = FRAMES_SQL + ", a as (select source_id, frame, value, cast((frame * 31 + source_id * 17) % 4 as int) as batch, max(frame) over (partition by source_id) as top from frames), k as (select * from a where not (source_id % 5 = 0 and frame = top // 2))"


@query("st07_reorder_buffer", f"with {SHUFFLED} select source_id, frame, value, frame as place, cast(max(batch) over (partition by source_id order by frame rows unbounded preceding) as bigint) as left_in from k qualify row_number() over (partition by source_id order by frame) - 1 = frame")
def st07_reorder_buffer(spark, d):
    """Frames dealt over four batches in no order; every fifth source lacks a frame in the middle, behind which all wait."""
    f = frames(spark, d).select("source_id", "frame", "value")
    top = F.max("frame").over(Window.partitionBy("source_id"))
    rows = f.select("source_id", F.col("frame").alias("at"), "value", (F.col("frame") == top).alias("last"), ((F.col("frame") * 31 + F.col("source_id") * 17) % 4).cast("int").alias("batch"), top.alias("top"))
    rows = rows.where(~((F.col("source_id") % 5 == 0) & (F.col("at") == F.expr("top div 2")))).drop("top")
    store = Store(spark, "ordered")
    RP.replayed(rows, "batch", RP.to_table(lambda s: O.in_order(s, "source_id")), store)
    out = spark.read.schema(O.ORDERED.format(kind="source_id long")).parquet(store.path("out"))
    return out.withColumnRenamed("at", "frame")


#: Events in six batches by time, but for one in seven, which comes a batch late.
LATE = """e as (select event_id, event_type, value, ts, cast(floor(ntile_ * 1.0) as bigint) as batch from (select *, least(5, (epoch_us(ts) - 1704067200000000) // 432000000000) + case when event_id % 7 = 3 then 1 else 0 end as ntile_ from events)),
w as (select *, (select max(x.top) from (select batch, max(ts) as top from e group by 1) x where x.batch < e.batch) - interval 36 hours as mark from e),
j as (select *, mark is null or ts >= mark as ok from w)"""


def late_events(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value", "ts")
    by_time = F.least(F.lit(5), F.floor((micros("ts") - 1704067200000000) / 432000000000))
    return e.withColumn("arrival", (by_time + F.when(F.col("event_id") % 7 == 3, 1).otherwise(0)).cast("int"))


@query("ss04_late_rows", f"with {LATE} select event_id, batch, ok as kept from j")
def ss04_late_rows(spark, d):
    rows, store = late_events(spark, d), Store(spark, "late")
    gate = L.Gate(store, "ts", "36 hours")
    RP.replayed(rows, "arrival", L.gated(gate), store)
    both = gate.kept(rows).withColumn("kept", F.lit(True)).unionByName(gate.refused(rows).withColumn("kept", F.lit(False)).drop("watermark"))
    return both.select("event_id", "batch", "kept")


@query("ss04_hourly_of_kept", f"with {LATE} select strftime(ts, '%Y-%m-%d %H') as hour, event_type, count(*) as n, round(sum(value), 4) as total from j where ok group by 1, 2")
def ss04_hourly_of_kept(spark, d):
    """What the gate keeps, counted by hour in a stream under a watermark of the same delay, so that nothing more is lost."""
    rows, store = late_events(spark, d), Store(spark, "late-hours")
    gate = L.Gate(store, "ts", "36 hours")
    RP.replayed(rows, "arrival", L.gated(gate), store)
    kept = gate.kept(rows).select("ts", "event_type", "value", F.col("batch").cast("int").alias("batch"))
    end = kept.agg((F.max("ts") + F.expr("interval 30 days")).alias("ts")).select("ts", F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit(1_000_000).alias("batch"))
    hours = Store(spark, "hours")
    timed = kept.unionByName(end).withColumn("ts", F.col("ts").cast("timestamp"))
    RP.replayed(timed.unionByName(timed.where("batch = 1000000").withColumn("batch", F.lit(1_000_001))), "batch", RP.to_table(lambda s: S.hourly(s, "36 hours")), hours)
    out = spark.read.parquet(hours.path("out"))
    return out.select(F.date_format(F.col("window.start").cast("timestamp_ntz"), "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("ss08_live_progress", "with b as (select cast(event_id % 5 as bigint) as batch, count(*) as n from events group by 1), s as (select batch, n, cast(sum(n) over (order by batch) as bigint) as done, cast(sum(n) over () as bigint) as whole from b) select batch, n as rows, done, round(done / whole, 6) as share, whole - done as left_over from s")
def ss08_live_progress(spark, d):
    rows, store = table(spark, d, "events").select("event_id", "value", (F.col("event_id") % 5).cast("int").alias("batch")), Store(spark, "progress")
    seen = P.watched(rows, "batch", store, RP.to_table(lambda s: s))
    whole = rows.count()
    return P.remaining(seen.lines(), whole).select("batch", "rows", "done", F.round("share", 6).alias("share"), F.col("left").alias("left_over"))
