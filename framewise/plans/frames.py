"""Queries over samples, colours, sinks and progress, with their SQL twins."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewise.operators import metrics as M
from framewise.operators import pictures as P
from framewise.sources.bindings import FRAMES_SQL, VECTORS_SQL, frames, table, vectors
from framewise.sources.shared import Store, Units

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


SAMPLES = "s as (select l_orderkey, l_linenumber, l_partkey, l_quantity / 50 as r, l_discount * 10 as g, l_tax * 12 as b from lineitem)"


def samples(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") / 50).alias("r"), (F.col("l_discount") * 10).alias("g"), (F.col("l_tax") * 12).alias("b"))


@query("prj02_limited_range", f"with {SAMPLES}, y as (select *, 0.2126 * r + 0.7152 * g + 0.0722 * b as y from s) select l_orderkey, l_linenumber, l_partkey, cast(round_even(y * 56064 + 4096, 0) as bigint) as luma from y")
def prj02_limited_range(spark, d):
    y = 0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")
    return samples(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", F.rint(y * 56064 + 4096).cast("long").alias("luma"))


@query("prj01_full_range", f"with {SAMPLES}, c as (select *, cast(floor(r * 65535) as bigint) as code from s) select l_orderkey, l_linenumber, l_partkey, round(least(greatest((code - 4096) / 56064.0::double, 0), 1), 9) as y from c")
def prj01_full_range(spark, d):
    code = F.floor(F.col("r") * 65535)
    return samples(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.least(F.greatest((code - 4096) / F.lit(56064.0), F.lit(0.0)), F.lit(1.0)), 9).alias("y"))


@query("prj03_read_choice", "select p_partkey, case when p_size > 30 then 'bt2020' when p_type like '%BRASS%' then null when p_size > 15 then 'bt709' else 'bt601' end as matrix, case when p_type like '%BRASS%' and p_size <= 30 then 'refused' else 'read' end as way from part")
def prj03_read_choice(spark, d):
    brass, big = F.contains("p_type", F.lit("BRASS")), F.col("p_size") > 30
    return table(spark, d, "part").select("p_partkey", F.when(big, "bt2020").when(brass, F.lit(None)).when(F.col("p_size") > 15, "bt709").otherwise("bt601").alias("matrix"), F.when(brass & ~big, "refused").otherwise("read").alias("way"))


@query("prj11_upright", f"with {VECTORS_SQL}, x as (select vec_id, unnest(v) as x, unnest(range(0, 64)) as i from vectors) select vec_id, case vec_id % 4 when 0 then i when 1 then (i % 8) * 8 + 7 - i // 8 when 2 then 63 - i else (7 - i % 8) * 8 + i // 8 end as i, x from x")
def prj11_upright(spark, d):
    x = vectors(spark, d).select("vec_id", F.posexplode("v").alias("p", "x"))
    i, k = F.col("p").cast("long"), F.col("vec_id") % 4
    row, col = F.floor(i / 8), i % 8
    place = F.when(k == 0, i).when(k == 1, col * 8 + 7 - row).when(k == 2, 63 - i).otherwise((7 - col) * 8 + row)
    return x.select("vec_id", place.alias("i"), "x")


@query("ag19_lab", f"""with {SAMPLES}, l as (select *, case when r <= 0.04045 then r / 12.92 else pow((r + 0.055) / 1.055, 2.4) end as lr, case when g <= 0.04045 then g / 12.92 else pow((g + 0.055) / 1.055, 2.4) end as lg, case when b <= 0.04045 then b / 12.92 else pow((b + 0.055) / 1.055, 2.4) end as lb from s),
y as (select *, 0.2126 * lr + 0.7152 * lg + 0.0722 * lb as y from l) select l_orderkey, l_linenumber, l_partkey, round(116 * case when y > 216.0 / 24389 then pow(y, 1.0 / 3) else (24389.0 / 27 * y + 16) / 116 end - 16, 4) + 0.0 as lightness from y""")
def ag19_lab(spark, d):
    linear = lambda c: F.when(F.col(c) <= 0.04045, F.col(c) / 12.92).otherwise(F.pow((F.col(c) + 0.055) / 1.055, F.lit(2.4)))
    y = 0.2126 * linear("r") + 0.7152 * linear("g") + 0.0722 * linear("b")
    s = samples(spark, d).withColumn("y", y)
    f = F.when(F.col("y") > 216.0 / 24389, F.pow("y", F.lit(1.0 / 3))).otherwise((24389.0 / 27 * F.col("y") + 16) / 116)
    return s.select("l_orderkey", "l_linenumber", "l_partkey", (F.round(116 * f - 16, 4) + 0.0).alias("lightness"))


@query("ag28_matched_bins", """with h as (select l_returnflag, cast(l_quantity as bigint) as bin, count(*) as n from lineitem group by 1, 2), c as (select *, sum(n) over (partition by l_returnflag order by bin) as below, sum(n) over (partition by l_returnflag) as total from h),
a as (select * from c where l_returnflag = 'A'), r as (select * from c where l_returnflag = 'N')
select a.bin, min(r.bin) as matched from a join r on cast(r.below as hugeint) * a.total >= cast(a.below as hugeint) * r.total group by 1""")
def ag28_matched_bins(spark, d):
    h = table(spark, d, "lineitem").groupBy("l_returnflag", F.col("l_quantity").cast("long").alias("bin")).agg(F.count("*").alias("n"))
    c = h.withColumn("below", F.sum("n").over(Window.partitionBy("l_returnflag").orderBy("bin"))).withColumn("total", F.sum("n").over(Window.partitionBy("l_returnflag")))
    # histograms have as many rows as bins, fifty here, whatever the table's size
    total = lambda flag: F.max(F.when(F.col("l_returnflag") == flag, F.col("total"))).over(Window.partitionBy("one"))
    c = c.withColumn("one", F.lit(1)).withColumn("ta", total("A")).withColumn("tr", total("N"))
    at = lambda flag, other, name: c.where(F.col("l_returnflag") == flag).select("one", (F.col("below").cast("decimal(38,0)") * F.col(other)).cast("decimal(38,0)").alias("at"), F.col("bin").alias(name))
    return P.first_reaching(at("A", "tr", "bin"), at("N", "ta", "matched"), ["one"], "at").where("matched is not null").select("bin", "matched")


@query("snk13_interleaved", f"with {FRAMES_SQL}, m as (select source_id, pts as at_us, 0 as kind, frame as seq from frames union all select source_id, pts + 1, 1, event_id from frames where event_type = 'view') select source_id, at_us, cast(kind as bigint) as kind, seq, row_number() over (partition by source_id order by at_us, kind) as place from m")
def snk13_interleaved(spark, d):
    f = frames(spark, d)
    m = f.select("source_id", F.col("pts").alias("at_us"), F.lit(0).cast("long").alias("kind"), F.col("frame").alias("seq")).unionByName(f.where("event_type = 'view'").select("source_id", (F.col("pts") + 1).alias("at_us"), F.lit(1).cast("long").alias("kind"), F.col("event_id").alias("seq")))
    return m.withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy("at_us", "kind")).cast("long"))


@query("snk12_assembly", """with o as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as part from orders), p as (select o_custkey, part, l_orderkey, l_linenumber, l_partkey, cast(l_quantity as bigint) as n from o join lineitem on l_orderkey = o_orderkey)
select o_custkey, part, l_linenumber, l_partkey, cast(sum(n) over (partition by o_custkey order by part, l_linenumber, l_partkey, n rows between unbounded preceding and current row) - n as bigint) as begin from p""")
def snk12_assembly(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long").alias("part"))
    p = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("n")).join(o, "l_orderkey")
    by = Window.partitionBy("o_custkey").orderBy("part", "l_linenumber", "l_partkey", "n").rowsBetween(Window.unboundedPreceding, 0)
    return p.select("o_custkey", "part", "l_linenumber", "l_partkey", (F.sum("n").over(by) - F.col("n")).alias("begin"))


@query("snk05_png_filters", f"with {VECTORS_SQL}, x as (select vec_id, unnest(list_transform(v, lambda x: cast(floor((x + 4) * 31) as bigint) % 256)) as x, unnest(range(0, 64)) as i from vectors), n as (select vec_id, i, x, case when i % 8 = 0 then 0 else lag(x) over w end as a, coalesce(lag(x, 8) over w, 0) as b from x window w as (partition by vec_id order by i)) select vec_id, i, (x - a + 512) % 256 as sub, (x - b + 512) % 256 as up, (x - (a + b) // 2 + 512) % 256 as average from n")
def snk05_png_filters(spark, d):
    x = vectors(spark, d).select("vec_id", F.posexplode(F.transform("v", lambda x: F.floor((x + 4) * 31) % 256)).alias("p", "x")).withColumn("i", F.col("p").cast("long"))
    w, zero = Window.partitionBy("vec_id").orderBy("i"), F.lit(0).cast("long")
    n = x.withColumn("a", F.when(F.col("i") % 8 == 0, zero).otherwise(F.lag("x").over(w))).withColumn("b", F.coalesce(F.lag("x", 8).over(w), zero))
    out = lambda p: (F.col("x") - p + 512) % 256
    return n.select("vec_id", "i", out(F.col("a")).alias("sub"), out(F.col("b")).alias("up"), out(F.floor((F.col("a") + F.col("b")) / 2)).alias("average"))


@query("sc15_nested_records", "select o_custkey, cast(count(*) as bigint) as n, cast(sum(cast(json_extract_string(j, '$.key') as bigint)) as bigint) as keys from (select o_custkey, to_json({'key': o_orderkey, 'status': o_orderstatus}) as j from orders) group by 1")
def sc15_nested_records(spark, d):
    j = table(spark, d, "orders").select("o_custkey", F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))).alias("j"))
    return j.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.from_json("j", "key bigint, status string")["key"]).alias("keys"))


@query("sc20_identified", "select page_id, case when contains(html, '<article>') then 'article' when contains(html, '<table') then 'table' else 'other' end as kind from pages")
def sc20_identified(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.when(F.contains(h, F.lit("<article>")), "article").when(F.contains(h, F.lit("<table")), "table").otherwise("other").alias("kind"))


@query("ud05_similarity_band", f"with {VECTORS_SQL} select a.vec_id, b.vec_id - a.vec_id as step, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 6) + 0.0 as similarity from vectors a join vectors b on b.vec_id between a.vec_id - 5 and a.vec_id + 5 and b.vec_id <> a.vec_id")
def ud05_similarity_band(spark, d):
    v = vectors(spark, d).select("vec_id", "v")
    # the band as an equality: each vector is dealt to the ten it is compared with
    steps = F.explode(F.array(*[F.lit(s).cast("long") for s in range(-5, 6) if s]))
    near = v.select((F.col("vec_id")).alias("other"), F.col("v").alias("w"), steps.alias("step")).withColumn("vec_id", F.col("other") - F.col("step"))
    j = v.join(near, "vec_id")
    return j.select("vec_id", "step", (F.round(M.dot("v", "w") / F.sqrt(M.dot("v", "v") * M.dot("w", "w")), 6) + 0.0).alias("similarity"))


@query("ud04_seeded_noise")
def ud04_seeded_noise(spark, d):
    """A normal draw from (seed, index) alone: the same whatever the partitioning."""
    unit = lambda salt: (F.pmod(F.xxhash64("source_id", "frame", F.lit(salt)), F.lit(1 << 40)) + 0.5) / (1 << 40)
    noise = F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * F.pi() * unit(2))
    return frames(spark, d).select("source_id", "frame", noise.alias("noise"))


@query("ss08_progress", f"with {FRAMES_SQL}, p as (select source_id, frame, (frame + 1) / cast(count(*) over (partition by source_id) as double) as done, pts - min(pts) over (partition by source_id) as spent from frames) select source_id, frame, round(done, 6) as done, cast(floor(spent * (1 - done) / done) as bigint) // 1000000 as left_s from p")
def ss08_progress(spark, d):
    w = Window.partitionBy("source_id")
    p = frames(spark, d).select("source_id", "frame", ((F.col("frame") + 1) / F.count("*").over(w).cast("double")).alias("done"), (F.col("pts") - F.min("pts").over(w)).alias("spent"))
    return p.select("source_id", "frame", F.round("done", 6).alias("done"), F.floor(F.floor(F.col("spent") * (1 - F.col("done")) / F.col("done")) / 1000000).alias("left_s"))


@query("src22_scores_read", "select doc_id, case quality when 1 then 'good' when 0 then 'bad' end as quality, nullif(toxic, 0) as toxic from labels")
def src22_scores_read(spark, d):
    return table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("quality"), F.nullif("toxic", F.lit(0)).alias("toxic"))


@query("src24_samples", f"with {FRAMES_SQL} select event_type, pts // 3600000000 as hour, count(*) as n, max(value) as peak from frames group by 1, 2")
def src24_samples(spark, d):
    return frames(spark, d).groupBy("event_type", F.floor(F.col("pts") / 3_600_000_000).alias("hour")).agg(F.count("*").alias("n"), F.max("value").alias("peak"))


@query("src16_checksums", f"with {FRAMES_SQL} select source_id, frame, md5(props) as md5 from frames")
def src16_checksums(spark, d):
    return frames(spark, d).select("source_id", "frame", F.md5("props").alias("md5"))


@query("src07_verified_range", f"with {FRAMES_SQL}, k as (select source_id, max(frame) as seek from frames where is_key and frame <= 30 group by 1) select f.source_id, f.frame, f.frame - k.seek as from_key, f.event_id % 11 <> 0 as same from frames f join k using (source_id) where f.frame >= k.seek and f.frame < 40")
def src07_verified_range(spark, d):
    f = frames(spark, d)
    # frames lie by source already, and of a source only those before the range's end meet
    seek = F.max(F.when(F.col("is_key") & (F.col("frame") <= 30), F.col("frame"))).over(Window.partitionBy("source_id"))
    # the checksum list is a file of its own, in which some lines are of other frames
    told = F.md5(F.when(F.col("event_id") % 11 == 0, F.concat("props", F.lit("?"))).otherwise(F.col("props")))
    g = Store(spark, "src07").stage(f.select("source_id", "frame", told.alias("told")), "checksums")
    r = f.where("source_id is not null and frame < 40").select("source_id", "frame", "props", seek.alias("seek")).where("frame >= seek").hint("merge").join(g, ["source_id", "frame"])  # packed, they are far smaller than in a hash table
    return r.select("source_id", "frame", (F.col("frame") - F.col("seek")).alias("from_key"), (F.md5("props") == F.col("told")).alias("same"))


@query("sc02_ntsc_twins", "with r as (select p_partkey, p_size as n, cast(round(p_size * 1000000 / 1001.0::double) as bigint) as seen from part) select p_partkey, n, seen, case when abs(seen * 1001 - n * 1000000) <= 1001 then 'twin' else 'plain' end as reading from r")
def sc02_ntsc_twins(spark, d):
    r = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("n"), F.round(F.col("p_size") * 1000000 / F.lit(1001.0)).cast("long").alias("seen"))
    return r.select("p_partkey", "n", "seen", F.when(F.abs(F.col("seen") * 1001 - F.col("n") * 1000000) <= 1001, "twin").otherwise("plain").alias("reading"))


@query("ss06_resume", "select o_orderkey, o_custkey, sha256(cast(o_orderkey as varchar) || o_orderstatus) as digest from orders")
def ss06_resume(spark, d):
    """A run that stops after some units, and one that goes on from the ledger in its folder: it makes only the units
    that are not named there, and the rows are those of a run without a stop."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.sha2(F.concat(F.col("o_orderkey").cast("string"), "o_orderstatus"), 256).alias("digest"), (F.col("o_custkey") % 4).alias("unit"))
    store = Store(spark, "ss06")

    def run(todo: DataFrame) -> Units:
        units = Units(Store(spark, "ss06", store.root), o.drop("unit").schema)
        done = units.ledger().select(F.col("unit").cast("long").alias("unit"))
        units.save_all(todo.join(F.broadcast(done), "unit", "left_anti"), "unit")  # a line a unit
        return units

    run(o.where("unit < 2"))
    return run(o).take_all().select("o_orderkey", "o_custkey", "digest")
