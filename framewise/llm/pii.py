"""Personal data: fixed recognisers, then bootstrapped contextual extraction (DataFrame functions only).

The recognised entities, with the key-like strings below, are seeds. The two tokens before an entity are its pattern; a
pattern also selects other identifiers, words with a digit that no recogniser took. Patterns and instances are a
bipartite graph: a pattern's confidence is the mean belief in its instances, an instance's belief the mean confidence of
the patterns that have enough believed instances; seeds stay at 1. Each round, what is now believed counts like a seed,
so discovered identifiers induce further patterns. At the end the confident patterns hand over the identifiers that they
select: spans of kind ``id``.

A text is scanned once a kind; from there on every hit is a row, so a text with many hits costs no more than as many
texts with one. Positions are running sums of what stands between the hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty

#: The kinds in their order and their patterns. A match starts where its run starts or where the last
#: match ended, so the look-behind only spares tries that can't match; a doubled plus gives nothing back for the same
#: reason, and a group under one is a loop, not a recursion, whatever the text.
LOCAL = "A-Za-z0-9._%+-"
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # strings that are known keys by their shape: seeds
    "key": r"(?<![A-Za-z0-9])(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])",
    # words with a digit that may be identifiers
    "id": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_][A-Za-z0-9_-]{3,}+",
}
RANKS = (*KINDS, "key", "id")
HIT = "array<struct<kind:int,i:int,gap:int,size:int,surface:string,pattern:string>>"
SPAN = "array<struct<start:bigint,end:bigint,kind:string,surface:string>>"


def context(before: Column) -> Column:
    """The two last tokens of what stands before a hit, digits as 0, letters in lower case; empty without two tokens."""
    return F.regexp_replace(F.lower(F.regexp_extract(before, r"(?<!\S)\S++\s++\S*+$", 0)), "[0-9]", "0")


def hits(text: Column, kind: str) -> Column:
    """The leftmost matches of a kind and what stands between them: size of the gap before each, its last two tokens."""
    mark = F.instr(text, "@") > 0 if kind == "email" else F.instr(text, "+") > 0 if kind == "phone" else F.rlike(text, F.lit("[0-9]"))
    pattern = PATTERNS[kind]
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    told = F.transform(
        F.filter(F.arrays_zip(found.alias("hit"), gaps.alias("gap")), lambda x: x["hit"].isNotNull()),
        lambda x, i: F.struct(F.lit(RANKS.index(kind)).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"), x["hit"].alias("surface"), context(x["gap"]).alias("pattern")),
    )
    return F.when(mark, told).otherwise(F.array().cast(HIT))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    n = F.length(number)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(number, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def valid(kind: Column, s: Column) -> Column:
    """Whether a hit passes the test of its kind."""
    n = F.length(digits(s))
    byte = F.forall(F.split(s, r"\."), lambda p: F.rlike(p, F.lit("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$")))
    return (
        F.when(kind == RANKS.index("ip"), byte)
        .when(kind == RANKS.index("card"), F.when(n.between(12, 19), luhn(digits(s))).otherwise(False))
        .when(kind == RANKS.index("phone"), n.between(9, 15))
        .when(kind == RANKS.index("id"), ~F.rlike(s, F.lit(PATTERNS["key"])))
        .otherwise(True)
    )


def spans_of(found: DataFrame) -> DataFrame:
    """(row, kind, start, end, surface, pattern) of the valid hits: all of the base kinds, of the others those that no
    base span overlaps."""
    each = found.where(F.size("hits") > 0).select("row", F.explode("hits").alias("x")).select("row", "x.*")
    order = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(order)
    placed = each.withColumn("end", end).where(valid(F.col("kind"), F.col("surface")))
    placed = placed.select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "surface", "pattern")
    base = F.col("kind") < len(KINDS)
    # both windows run from the first row on, so each costs one pass over the sorted spans of a text
    before = F.max(F.when(base, F.col("end"))).over(Window.partitionBy("row").orderBy("start"))
    after = F.min(F.when(base, F.col("start"))).over(Window.partitionBy("row").orderBy(F.desc("start")))
    clear = (F.coalesce("before", "start") <= F.col("start")) & (F.coalesce("after", "end") >= F.col("end"))
    return placed.withColumn("before", before).withColumn("after", after).where(base | clear).drop("before", "after")


def extract(documents: DataFrame, work: Workspace, rounds: int = 3, seeds: int = 5, confidence: float = 0.8) -> DataFrame:
    """One row for every row of ``documents(doc_id, text)``: doc_id, base and spans, both arrays of (start, end, kind,
    surface) by start, then kind; positions are code points, end exclusive. ``base`` has what the recognisers find,
    ``spans`` also seeds of kind ``key`` and discovered spans of kind ``id``; none of those overlaps a base span.

    A pattern is the two tokens before a hit, as far as the hit before of the same kind; without two tokens there is
    none. It is used from ``seeds`` different believed strings (seeds, or of a belief of ``confidence``) and a mean belief
    of ``confidence`` on. Null or empty text has no spans; repeated rows are judged each for itself (a repeated string
    counts once as evidence); a null doc_id is a row like another; other columns are ignored; an empty table gives no
    rows. Texts and contexts are read whole.
    """
    docs = documents.select("doc_id", text_or_empty().alias("text")).withColumn("row", F.monotonically_increasing_id())
    found = work.stage(docs.select("row", "doc_id", F.concat(*[hits(F.col("text"), k) for k in RANKS]).alias("hits")), "hits")
    spans = work.stage(spans_of(found), "spans")

    told = spans.where("pattern <> ''").select("pattern", "surface", (F.col("kind") < RANKS.index("id")).alias("seed"))
    graph = told.groupBy("pattern", "surface").agg(F.bool_or("seed").alias("seed"))
    # a pattern of fewer instances never has enough that are believed
    able = graph.groupBy("pattern").count().where(F.col("count") >= seeds).select("pattern")
    graph = work.stage(graph.join(able, "pattern"), "graph")
    known = graph.where("seed").select("surface").distinct()
    beliefs = work.stage(known.withColumn("belief", F.lit(1.0)).withColumn("seed", F.lit(True)), "beliefs")
    pairs = graph.select("pattern", "surface")
    believed = F.coalesce("belief", F.lit(0.0))

    def scored() -> DataFrame:
        told = pairs.join(beliefs.select("surface", "belief"), "surface", "left").groupBy("pattern")
        return told.agg(F.avg(believed).alias("confidence"), F.count(F.when(believed >= confidence, 1)).alias("n")).where(F.col("n") >= seeds)

    for _ in range(rounds):
        spread = pairs.join(scored().select("pattern", "confidence"), "pattern").groupBy("surface").agg(F.avg("confidence").alias("belief"))
        new = spread.join(known, "surface", "left_anti").withColumn("seed", F.lit(False))
        beliefs = work.stage(known.withColumn("belief", F.lit(1.0)).withColumn("seed", F.lit(True)).unionByName(new), "beliefs")
    used = work.stage(scored().where(F.col("confidence") >= confidence).select("pattern"), "patterns")

    sure = spans.where(F.col("kind") < RANKS.index("id")).unionByName(spans.where(F.col("kind") == RANKS.index("id")).join(used, "pattern", "left_semi").select(spans.columns))
    each = F.struct("start", "kind", "end", "surface")
    lists = sure.groupBy("row").agg(F.sort_array(F.collect_list(F.when(F.col("kind") < len(KINDS), each))).alias("base"), F.sort_array(F.collect_list(each)).alias("spans"))
    out = found.select("row", "doc_id").join(lists, "row", "left")
    names = F.array(*[F.lit(k) for k in RANKS])
    said = lambda name: F.coalesce(F.transform(name, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["kind"]).alias("kind"), s["surface"].alias("surface"))), F.array()).cast(SPAN)
    return out.select("doc_id", said("base").alias("base"), said("spans").alias("spans"))


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
