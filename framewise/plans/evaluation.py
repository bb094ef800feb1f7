"""Queries over records, labels and draws, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framewise.operators import reading as G
from framewise.operators import records as R
from framewise.operators import sampling as S
from framewise.plans.analytics import LABELLED, labelled
from framewise.sources.bindings import FRAMES_SQL, frames, table
from framewise.sources.shared import Store

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


#: Orders with their lines as nested records, and the same with changes that arithmetic on the keys decides.
DEEP = """with l as (select l_orderkey as k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as i, cast(l_quantity as bigint) as qty, l_partkey as part from lineitem),
n as (select k, count(*) as n, '[' || string_agg('{"part":' || part || ',"qty":' || qty || '}', ',' order by i) || ']' as lines from l group by 1),
o as (select o_orderkey as k, o_orderstatus as status, o_orderpriority as priority, o_custkey as customer, n, lines from orders join n on n.k = o_orderkey)
select k, 'order.status' as path, '"' || status || '"' as old, '"X"' as new, 'value' as why from o where k % 5 = 0 and k % 13 <> 0 and status <> 'X'
union all select k, 'order.priority', '"' || priority || '"', null, 'missing' from o where k % 7 = 0 and k % 13 <> 0
union all select k, 'lines', cast(n as varchar), cast(n - 1 as varchar), 'length' from o where k % 11 = 0 and k % 13 <> 0
union all select k, 'lines[' || i || '].qty', cast(qty as varchar), cast(qty + 1 as varchar), 'value' from l where k % 2 = 0 and i % 3 = 1 and k % 11 <> 0 and k % 13 <> 0
union all select k, 'order.customer', cast(customer as varchar), '"' || customer || '"', 'kind' from o where k % 17 = 0 and k % 13 <> 0
union all select k, '', '{"lines":' || lines || ',"order":{"customer":' || customer || ',"priority":"' || priority || '","status":"' || status || '"},"seen":1}', null, 'missing' from o where k % 13 = 0"""


@query("jn12_deep_diff", DEEP)
def jn12_deep_diff(spark, d):
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("qty")).alias("line"))
    lines = i.groupBy("k").agg(F.array_sort(F.collect_list("line")).alias("lines"))  # a few an order
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "k").join(lines, "k")
    item = lambda more: F.transform("lines", lambda x, j: F.struct(F.struct(x["l_partkey"].alias("part"), (x["qty"] + more(j)).alias("qty")).alias("x")))
    plain = lambda a: F.transform(a, lambda x: x["x"])
    old = o.select("k", F.to_json(F.struct(plain(item(lambda j: F.lit(0))).alias("lines"), F.struct(F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).alias("order"), F.lit(1).alias("seen"))).alias("record"))
    more = lambda j: F.when((F.col("k") % 2 == 0) & (j % 3 == 1), 1).otherwise(0)
    changed = plain(item(more))
    cut = F.when(F.col("k") % 11 == 0, F.slice(changed, F.lit(1), F.size(changed) - 1)).otherwise(changed)
    order = F.struct(F.when(F.col("k") % 17 != 0, F.col("o_custkey")).alias("customer"), F.when(F.col("k") % 7 != 0, F.col("o_orderpriority")).alias("priority"), F.when(F.col("k") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"))
    record = F.to_json(F.struct(cut.alias("lines"), order.alias("order"), F.lit(2).alias("seen")))
    quoted = F.when(F.col("k") % 17 == 0, F.regexp_replace(record, '"order":\\{', F.concat(F.lit('"order":{"customer":"'), F.col("o_custkey").cast("string"), F.lit('",')))).otherwise(record)
    new = o.where("k % 13 <> 0").select("k", quoted.alias("record"))
    return R.deep_diff(old, new, ["k"], "record", Store(spark, "diff"), ignored=("seen",))


BOUNDS = S.poisson_bounds()
TIMES = "case " + " ".join(f"when u < {b} then {k}" for k, b in enumerate(BOUNDS)) + f" else {len(BOUNDS)} end"
DRAWS = 201


DOUBLES = LABELLED + ", v as (select * replace (cast(wt as double) as wt) from w)"


def lot_sql(text: str) -> str:
    return f"cast('0x' || substr(md5({text}), 1, 8) as bigint)"


STRATA = LABELLED + f""", p as (select doc_id, lang, truth, n_chars > 1500 as long, n_chars > 400 as fair, toxic = 0 as clean from w), sizes as (select lang, count(*) as size from documents group by 1),
x as (select *, unnest(range(0, {DRAWS + 1})) as draw from p), u as (select *, {lot_sql("'3:' || draw || ':' || doc_id")} as u from x), t as (select *, case when draw = 0 then 1 else {TIMES} end as t from u),
r as (select doc_id, lang, truth, draw, t, unnest(['long', 'fair', 'clean']) as rule, unnest([long, fair, clean]) as hit from t),
c as (select draw, lang, rule, sum(t) as a, sum(case when truth then t else 0 end) as cuts, sum(case when hit then t else 0 end) as hits, sum(case when hit and truth then t else 0 end) as both_ from r group by 1, 2, 3),
s as (select draw, rule, sum(size * cuts / nullif(a, 0)) as cuts, sum(size * hits / nullif(a, 0)) as hits, sum(size * both_ / nullif(a, 0)) as both_ from c join sizes using (lang) group by 1, 2),
m as (select draw, rule, 'recall' as metric, both_ / nullif(cuts, 0) as v from s union all select draw, rule, 'precision', both_ / nullif(hits, 0) from s),
g as (select m.*, m.v - o.v as gap from m join m o on o.draw = m.draw and o.metric = m.metric and o.rule = 'long')
select rule, metric, round(max(v) filter (where draw = 0), 6) as point, round(quantile_cont(v, 0.05) filter (where draw > 0), 6) as low, round(quantile_cont(v, 0.95) filter (where draw > 0), 6) as high,
 round(max(gap) filter (where draw = 0), 6) as difference, round(quantile_cont(gap, 0.05) filter (where draw > 0), 6) as difference_low, round(quantile_cont(gap, 0.95) filter (where draw > 0), 6) as difference_high from g group by 1, 2"""


@query("ag17_stratified", STRATA)
def ag17_stratified(spark, d):
    rows = labelled(spark, d).select("doc_id", "lang", "truth", (F.col("n_chars") > 1500).alias("long"), (F.col("n_chars") > 400).alias("fair"), (F.col("toxic") == 0).alias("clean"))
    sizes = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("size"))
    out = S.stratified(rows, sizes, ["lang"], ["doc_id"], "truth", ["long", "fair", "clean"], "long", DRAWS, 3)
    return out.select("rule", "metric", *[F.round(c, 6).alias(c) for c in ("point", "low", "high", "difference", "difference_low", "difference_high")])


MOVING = f"""with {FRAMES_SQL}, cents as (select source_id, frame, cast(round(value * 100) as bigint) as cents from frames), n as (select source_id as grp, count(*) as n, avg(cents) as mean, least(10, count(*)) as size from cents group by 1),
k as (select *, unnest(range(1, {DRAWS + 1})) as draw from n), b as (select *, unnest(range(0, (n + size - 1) // size)) as block from k),
s as (select *, {lot_sql("'5:' || grp || ':' || draw || ':' || block")} % (n - size + 1) as start, least(size, n - block * size) as length from b),
m as (select grp, draw, sum(cents) / any_value(n) as m from s join cents f on f.source_id = grp and f.frame >= start and f.frame < start + length group by 1, 2),
q as (select grp, quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high from m group by 1) select grp, mean / 100 as mean, low / 100 as low, high / 100 as high from n join q using (grp)"""


@query("ag17_bootstrap", MOVING)
def ag17_bootstrap(spark, d):
    """In whole cents, so that every sum is exact in any order."""
    rows = frames(spark, d).select(F.col("source_id").alias("grp"), "frame", F.round(F.col("value") * 100).cast("long").alias("cents"))
    out = S.blocks(rows, "grp", "frame", "cents", 10, Store(spark, "blocks"), DRAWS, 5)
    return out.select("grp", *[(F.col(c) / 100).alias(c) for c in ("mean", "low", "high")])


@query("ag14_thresholds", DOUBLES + """, e as (select lang, n_chars, sum(case when truth then wt else 0 end) as r, sum(wt) - sum(case when truth then wt else 0 end) as x from v group by 1, 2),
h as (select lang, sum(n_chars) / 100000.0 as hours, sum(case when truth then wt else 0 end) as there from v group by 1), s as (select lang, n_chars, sum(r) over q as r, sum(x) over q as x from e window q as (partition by lang order by n_chars desc rows unbounded preceding))
select lang, n_chars as threshold, round(r + x, 6) as found, round(r / nullif(there, 0), 6) as recall, round(r / nullif(r + x, 0), 6) as precision, round((there - r) / hours, 6) as missed_per_hour, round(x / hours, 6) as false_per_hour from s join h using (lang)""")
def ag14_thresholds(spark, d):
    rows = labelled(spark, d)
    hours = rows.groupBy("lang").agg((F.sum("n_chars") / 100000.0).alias("hours"))
    out = S.thresholds(rows, ["lang"], "n_chars", "truth", "wt", hours, Store(spark, "thresholds"))
    return out.select("lang", "threshold", *[F.round(c, 6).alias(c) for c in ("found", "recall", "precision", "missed_per_hour", "false_per_hour")])


@query("ag14_errors_by_label", DOUBLES + """, k as (select case when toxic = 1 then 'toxic' when quality = 1 then 'good' else 'poor' end as label, wt, unnest(['hit', 'short']) as rule, unnest([hit, n_chars < 400]) as h from v)
select rule, label, sum(case when h then wt else 0 end) as found, sum(case when not h and label = 'good' then wt else 0 end) as missed from k group by 1, 2""")
def ag14_errors_by_label(spark, d):
    label = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    rows = labelled(spark, d).withColumn("label", label).withColumn("short", F.col("n_chars") < 400)
    return S.errors_by_label(rows, ["hit", "short"], "label", "good", "wt")


@query("st03_sample", f"""with s as (select lang, source, count(*) as size from documents group by 1, 2), a as (select *, cast(size * 100 // sum(size) over () as bigint) as share, cast(size * 100 % sum(size) over () as bigint) as rest from s), g as (select *, sum(share) over () as given, row_number() over (order by rest desc, lang, source) as i from a),
t as (select lang, source, size, least(greatest(share + cast(i <= 100 - given as bigint), 1), size) as take from g), r as (select doc_id, lang, source, row_number() over (partition by lang, source order by {lot_sql("'7:' || doc_id")}, doc_id) as i from documents)
select doc_id, r.lang, r.source, size as stratum_size, size / take as weight from r join t on t.lang is not distinct from r.lang and t.source is not distinct from r.source where i <= take""")
def st03_sample(spark, d):
    return S.sampled(table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], ["doc_id"], 100, 7)


@query("src14_read_once", """with p as (select source, doc_id, coalesce(strlen(text) || ':' || text, '-') || coalesce(strlen(lang) || ':' || lang, '-') as whole from documents),
r as (select source, doc_id, cast(strlen(whole) as bigint) as size, sha256(whole) as digest, row_number() over (partition by source order by doc_id) - 1 as place from p),
c as (select source, place // 64 as chunk, sha256(string_agg(digest, '' order by place)) as digest from r group by 1, 2), f as (select source, sha256(string_agg(digest, '' order by chunk)) as file_digest from c group by 1)
select source, doc_id, place, cast(sum(size) over (partition by source order by doc_id) - size as bigint) as "offset", size, cast(sum(size) over (partition by source) as bigint) as file_size, file_digest from r join f using (source)""")
def src14_read_once(spark, d):
    return R.read_once(table(spark, d, "documents"), "source", "doc_id", ["text", "lang"], Store(spark, "once"), 64)


#: Reads that start at a keyframe with an odd event come out wrong up to the frame 8 * (event mod 5) behind it.
FALLBACK = f"""with recursive {FRAMES_SQL}, keys as (select source_id, frame as start, event_id, row_number() over (partition by source_id order by frame) - 1 as k from frames where is_key),
wants as (select source_id, frame as first, least(frame + 6, n) as "end" from (select *, count(*) over (partition by source_id) as n from frames) where frame % 5 = 0),
t0 as (select w.source_id, w.first, w."end", max(k.k) as k from wants w left join keys k on k.source_id = w.source_id and k.start <= w.first group by 1, 2, 3),
t as (select source_id, first, "end", k, cast(1 as bigint) as step, 1 as tries from t0 where k is not null union all select source_id, first, "end", greatest(k - step, 0), step * 2, tries + 1 from t where k > 0),
j as (select t.*, k.start, case when k.event_id % 2 = 1 then t.first >= k.start + 8 * (k.event_id % 5) else true end as ok from t join keys k on k.source_id = t.source_id and k.k = t.k),
b as (select source_id, first, "end", arg_min(tries, case when ok then tries else 1000 - tries end) as tries, arg_min(start, case when ok then tries else 1000 - tries end) as start, bool_or(ok) as found from j group by 1, 2, 3)
select source_id, first, "end", tries, start, found from b union all select source_id, first, "end", 0, null, false from t0 where k is null"""


@query("src07_fallback", FALLBACK)
def src07_fallback(spark, d):
    """Ranges of six frames from every fifth one on, each read from a keyframe that gives them right."""
    f = Store(spark, "frames").stage(frames(spark, d).select("source_id", "frame", "is_key", "event_id", "props"), "frames")
    n = F.count("*").over(Window.partitionBy("source_id"))
    wants = f.withColumn("n", n).where("frame % 5 = 0").select("source_id", F.col("frame").alias("first"), F.least(F.col("frame") + 6, "n").alias("end"))
    bad = f.where("is_key and event_id % 2 = 1").select("source_id", F.col("frame").alias("bad"), (F.col("frame") + 8 * (F.col("event_id") % 5)).alias("until"))
    wrong = bad.groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("bad", "until"))).alias("wrong"))  # the keyframes of one source
    rows = f.join(wrong, "source_id", "left").drop("event_id", "is_key")
    decoded = lambda start: F.md5(F.concat("props", F.when(F.col("frame") < F.coalesce(F.get(F.map_values(F.map_filter("wrong", lambda k, v: k == start)), F.lit(0)), F.lit(0)), "?").otherwise("")))
    index = f.select("source_id", "frame", F.md5("props").alias("digest"))
    return G.verified_ranges(rows, f.where("is_key"), index, wants, decoded, Store(spark, "ranges"))
