"""Order MinHash fingerprints of documents (DataFrame functions only).

A text's symbols are its runs of up to twelve non-space characters; a longer run, and one of a script without spaces,
gives its characters, so that an inserted one changes what stands around it and no more. White space only parts symbols.
The k-mers are three symbols, numbered by their occurrence in the text. One hash of (k-mer, occurrence) deals them into
buckets by its first bits, one permutation cut into parts in place of one a part, as every k-mer is then hashed once;
each bucket keeps its smallest hashes, puts them in the order of the text and hashes that tuple. Two texts agree in a
bucket if its smallest k-mers are the same and stand in the same order, so moved passages count as changes, as in edit
distance. A text of few k-mers leaves buckets empty; likeness is the share among the buckets in use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty

#: What makes words, by blocks, the signs of most texts first, as a class is tried in order. Left out, so
#: symbols of their own, are scripts that put no spaces between words: Thai, Lao, Myanmar, Khmer, Han, Kana.
INSIDE = r"[!-~\x{A1}-\x{DFF}\x{F00}-\x{FFF}\x{10A0}-\x{177F}\x{1800}-\x{1FFF}\x{2010}-\x{2027}\x{2030}-\x{2DFF}\x{A000}-\x{F8FF}\x{FB00}-\x{FEFF}\x{FF00}-\x{FFEF}\x{10000}-\x{1FFFF}]"
SYMBOL = rf"{INSIDE}{{1,12}}+(?!{INSIDE})|\S"
#: Bits of a packed number that hold a position in the text; the rest holds a hash. The longest text that Spark holds has
#: fewer than 2 ** 31 bytes, so no more symbols.
AT = 31
LOW = (1 << AT) - 1


def _pack(h: Column, at: Column) -> Column:
    return h.bitwiseAND(F.lit(~LOW)).bitwiseOR(F.pmod(at.cast("long"), F.lit(LOW + 1)))


def fingerprints(texts: DataFrame, text: str, out: str, k: int = 3, keep: int = 2, bits: int = 5) -> DataFrame:
    """Adds ``out`` array<int>: one number for each bucket that has k-mers, in bucket order.

    A null text is empty; an empty text, or one of spaces, has no numbers; a text of fewer than ``k`` symbols has one
    k-mer, all of it. Equal texts have equal fingerprints.
    """
    t, p, s, b, c = (f"_{out}_{x}" for x in "tpsbc")
    symbols, packed, chosen = F.col(t), F.col(p), F.col(s)
    df = texts.withColumn(t, F.regexp_extract_all(text_or_empty(text), F.lit(SYMBOL), F.lit(0)))
    grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size(symbols) - k, F.lit(0))), lambda i: _pack(F.xxhash64(*[F.get(symbols, i + j) for j in range(k)]), i))
    df = df.withColumn(p, F.sort_array(F.when(F.size(symbols) > 0, grams).otherwise(F.array().cast("array<bigint>")))).drop(t)
    high = lambda x: F.shiftright(x, AT)
    # equal k-mers are neighbours in the order of the text: where runs of them begin, and from that the numbers within
    # each run. Most short texts have no repeats and are spared both; a column used twice is not computed in here
    repeats = F.size(F.array_distinct(F.transform(packed, high))) < F.size(packed)
    begins = F.filter(F.sequence(F.lit(0), F.size(packed) - 1), lambda j: (j == 0) | (high(F.get(packed, j - 1)) != high(F.get(packed, j))))
    df = df.withColumn(b, F.when(repeats, begins).otherwise(F.array().cast("array<int>")))
    runs = F.transform(F.col(b), lambda start, k: F.sequence(F.lit(0), F.coalesce(F.get(F.col(b), k + 1), F.size(packed)) - start - 1))
    df = df.withColumn(c, F.when(F.size(F.col(b)) > 0, F.flatten(runs)).otherwise(F.array().cast("array<int>")))

    def numbered(x: Column, j: Column) -> Column:
        return _pack(F.xxhash64(high(x), F.when(F.size(F.col(c)) > 0, F.get(F.col(c), j)).otherwise(0)), x)

    df = df.withColumn(s, F.sort_array(F.transform(packed, numbered))).drop(p, b, c)
    bucket = lambda x: F.shiftright(x, 64 - bits)
    least = F.filter(chosen, lambda x, j: (j < keep) | (bucket(F.get(chosen, j - keep)) != bucket(x)))
    # again by bucket, now in the order of the text: (bucket, position, hash)
    turned = F.sort_array(F.transform(least, lambda x: F.struct(bucket(x).alias("b"), x.bitwiseAND(F.lit(LOW)).alias("i"), F.shiftright(x, AT).alias("h"))))
    df = df.withColumn(s, turned)
    first = F.filter(F.sequence(F.lit(0), F.size(chosen) - 1), lambda j: (j == 0) | (F.get(chosen, j - 1)["b"] != F.get(chosen, j)["b"]))
    tuple_of = lambda j: F.hash(F.get(chosen, j)["b"], *[F.when(F.get(chosen, j + i)["b"] == F.get(chosen, j)["b"], F.get(chosen, j + i)["h"]) for i in range(keep)])
    return df.withColumn(out, F.when(F.size(chosen) > 0, F.transform(first, tuple_of)).otherwise(F.array().cast("array<int>"))).drop(s)


def likeness(a: Column, b: Column) -> Column:
    """Share of buckets in which two fingerprints agree; two empty ones are alike."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / most)


def shown(a: Column) -> Column:
    """Eight hexadecimal digits a bucket."""
    unsigned = lambda x: x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(unsigned(x))), 8, "0")), " ")


def edited_neighbours(documents: DataFrame, work: Workspace) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, fp, edited_fp).

    The edited text of a document is its own without the last floor(n / 3) code points, then as many of the first ones
    (or all) of the document that follows in descending doc_id; the last is followed by the first. Ties of doc_id go by
    a hash of the text; repeated rows (equal doc_id and text) are one document; a null doc_id comes last; a null text is
    empty. One document follows itself. Other columns are ignored; an empty table gives no rows.

    The order needs ids alone: they are dealt by range, each range finds its followers, and the first row of every range
    (as many as partitions) joins the ranges. Texts move once by id, and a third of them once more as heads.
    """
    docs = documents.select("doc_id", text_or_empty().alias("text")).withColumn("th", F.xxhash64("text")).withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).drop("doc_id")
    # repeated rows go before anything is joined; the joins below are on the same columns, so the texts lie there already
    docs = docs.dropDuplicates(["id", "th"])
    ids = docs.select("id", "th", F.length("text").alias("n"))
    ids = work.stage(ids.repartitionByRange(F.desc("id"), F.desc("th")).withColumn("part", F.spark_partition_id()), "ids")
    key = F.struct("id", "th")
    firsts = ids.groupBy("part").agg(F.max(key).alias("first"))  # bounded by the number of partitions
    firsts = firsts.withColumn("one", F.lit(1))
    ring = Window.partitionBy("one").orderBy("part")
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(ring), F.first("first").over(ring)).alias("after"))
    within = Window.partitionBy("part").orderBy(F.desc("id"), F.desc("th"))
    ids = ids.withColumn("next", F.lead(key).over(within)).join(firsts, "part").select("id", "th", "n", F.coalesce("next", "after").alias("next"))
    ids = work.stage(ids.select("id", "th", "n", F.col("next.id").alias("next_id"), F.col("next.th").alias("next_th")), "order")
    heads = docs.join(ids.select(F.col("next_id").alias("id"), F.col("next_th").alias("th"), F.col("id").alias("own_id"), F.col("th").alias("own_th"), F.floor(F.col("n") / 3).cast("int").alias("need")), ["id", "th"])
    heads = heads.select(F.col("own_id").alias("id"), F.col("own_th").alias("th"), F.substring(F.col("text"), F.lit(1), F.col("need")).alias("head"))
    both = docs.join(heads, ["id", "th"]).withColumn("n", F.length("text"))
    both = both.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - F.floor(F.col("n") / 3).cast("int")), F.col("head")))
    both = both.select("id", "th", F.nullif("id", F.lit(-(2**63))).alias("doc_id"), "n", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "text", "edited")
    both = fingerprints(fingerprints(both, "text", "fp").drop("text"), "edited", "edited_fp").drop("edited")
    both = work.stage(both, "fingerprints")
    after = both.select(F.col("id").alias("next_id"), F.col("th").alias("next_th"), F.col("fp").alias("next_fp"))
    out = both.join(ids.select("id", "th", "next_id", "next_th"), ["id", "th"]).join(after, ["next_id", "next_th"])
    return out.select("doc_id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", shown(F.col("fp")).alias("fingerprint"), shown(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "fp", "edited_fp")
