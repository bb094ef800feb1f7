"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly (DataFrame functions only).

A test item of q distinct five-word shingles is contained in a document at a share t if the document has at least
ceil(t q) of them, so it lacks at most s = q - ceil(t q). The item's sketch is its s + 1 smallest shingle hashes: a
document that contains the item has one of them. Documents are partitioned by size, by powers of two of their number of
words; a partition can only contain items of up to its upper size / t shingles, and keeps the shingle hashes up to the
largest sketch value of those items. What is kept meets the sketches in an equality join, and every pair that meets is
verified on the shingles themselves. The search loses no pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty

WORD = r"[\p{L}\p{N}]+"
SIZES = 40


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def hashes_of(words: Column, n: int) -> Column:
    """Shingle hashes of a word array by position; ``words`` must be a column, as every element looks into it."""
    at = F.sequence(F.lit(0), F.size(words) - n)
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def shingles_of(words: Column, n: int) -> Column:
    at = F.sequence(F.lit(1), F.size(words) - (n - 1))
    return F.when(F.size(words) >= n, F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " ")))).otherwise(F.array().cast("array<string>"))


def contained_items(documents: DataFrame, benchmark: DataFrame, work: Workspace, n: int = 5, share: float = 0.8, few: int = 500_000) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) for every document that has at least ``share`` of the
    distinct ``n``-word shingles of an item.

    Words are maximal runs of letters and digits, lower-cased. Null or short texts (under ``n`` words) have no shingles
    and match nothing, on either side. Rows with equal doc_id count as versions of one document and give its best
    match; likewise item_id. Rows with a null id are left out. Other columns are ignored; empty tables give no rows.
    """
    items = benchmark.where("item_id is not null").select("item_id", words_of(text_or_empty()).alias("words"))
    items = items.select("item_id", shingles_of(F.col("words"), n).alias("shingles"), F.array_sort(F.array_distinct(hashes_of(F.col("words"), n))).alias("hashes")).where("size(shingles) > 0")
    items = items.withColumn("lacking", F.size("shingles") - F.ceil(F.size("shingles") * F.lit(share) - F.lit(1e-9)).cast("int"))
    items = work.stage(items.select("item_id", "shingles", F.slice("hashes", 1, F.col("lacking") + 1).alias("sketch")), "items")

    # largest sketch value by the power of two of the item's size: at most SIZES numbers
    power = F.floor(F.log2(F.size("shingles"))).cast("int")
    tops = {r["p"]: r["top"] for r in items.groupBy(power.alias("p")).agg(F.max(F.array_max("sketch")).alias("top")).collect()}
    limits, top = [], None
    for p in range(SIZES):  # a document of under 2^(p+1) words can only hold items of under 2^(p+1) / share shingles
        able = [v for k, v in tops.items() if 2**k * share <= 2 ** (p + 1)]
        top = max(able, default=None)
        limits.append(top)
    by_size = F.array(*[F.lit(x).cast("bigint") for x in limits])

    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    worded = docs.select("doc_id", words_of(F.col("text")).alias("words")).where(F.size("words") >= n)
    hashed = worded.select("doc_id", F.get(by_size, F.floor(F.log2(F.size("words"))).cast("int")).alias("limit"), hashes_of(F.col("words"), n).alias("hashes"))
    kept = hashed.where("limit is not null").select("doc_id", F.explode(F.filter("hashes", lambda h: h <= F.col("limit"))).alias("hash"))
    sketches = items.select("item_id", F.explode("sketch").alias("hash"))
    pairs = work.stage(kept.join(sketches, "hash").select("doc_id", "item_id").distinct(), "pairs")

    # verification reads the texts of the documents that met an item, once each
    wanted = pairs.groupBy("doc_id").agg(F.collect_set("item_id").alias("items"))
    # few documents leak, so their ids are sent to the texts; beyond ``few`` of them the texts are shuffled to the ids
    found = docs.join(F.broadcast(wanted) if pairs.count() <= few else wanted.hint("merge"), "doc_id").select("doc_id", "items", words_of(F.col("text")).alias("words"))
    found = found.select("doc_id", "items", shingles_of(F.col("words"), n).alias("has"))
    checked = found.select("doc_id", "has", F.explode("items").alias("item_id")).join(items.select("item_id", "shingles"), "item_id")
    n_shared = F.size(F.array_intersect("shingles", "has"))
    checked = checked.select("doc_id", "item_id", F.size("shingles").cast("long").alias("n_shingles"), n_shared.cast("long").alias("n_shared"))
    checked = checked.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("containment") >= share - 1e-9)
    best = checked.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_shared", "n_shingles")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_shingles", "best.n_shared", "best.containment")
