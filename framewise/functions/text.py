"""Text functions: sizes and durations as said, escaping, option values, line readers, accepted media ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def size_said(count: Column) -> Column:
    """Whole bytes in the largest unit of 1,024 that leaves at least one, two places from KiB on; exact halves of the last
    place go to the even one, as printf has them (Java's format rounds them up)."""
    out = F.concat(count.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        size, bits = 1024**power, 10 * power
        parts = count.bitwiseAND(F.lit(size - 1)) * 100
        down, twice = F.shiftright(count, bits) * 100 + F.shiftright(parts, bits), parts.bitwiseAND(F.lit(size - 1)) * 2
        hundredths = down + F.when((twice > size) | ((twice == size) & (down % 2 == 1)), 1).otherwise(0)
        out = F.when(count >= size, F.concat(F.format_string("%d.%02d", F.floor(hundredths / 100), hundredths % 100), F.lit(f" {unit}"))).otherwise(out)
    return out


def duration_said(seconds: Column) -> Column:
    """1 h 02 min, 3 min 04 s or 5 s."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    return F.when(h > 0, F.format_string("%d h %02d min", h, m)).when(m > 0, F.format_string("%d min %02d s", m, s)).otherwise(F.concat(s.cast("string"), F.lit(" s")))


def shell_word(text: Column) -> Column:
    """A text as one word of a POSIX shell; plain words stay as they are."""
    return F.when(F.rlike(text, F.lit("^[A-Za-z0-9_@%+=:,./-]+$")), text).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def xml_text(text: Column) -> Column:
    for raw, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def cut_lines(lines: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, cut) of a cut list: the first token of each line is a frame, what follows a # is a comment, other
    fields are ignored, lines without a number are left out."""
    each = lines.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line", "value"))
    cut = F.regexp_extract(F.split_part("value", F.lit("#"), F.lit(1)), r"^\s*(\d{1,15})(?:\s|$)", 1)
    return each.select(key, (F.col("line") + 1).cast("long").alias("line"), F.when(cut != "", cut.cast("long")).alias("cut")).where("cut is not null")


def chosen_media(accepts: DataFrame, key: str, accept: str, offered: tuple[str, ...]) -> DataFrame:
    """(key, media, q) in order of preference: of the ranges of an Accept text that fit an offered type, the most
    specific one gives its weight; weight 0 refuses it."""
    ranges = accepts.select(key, F.explode(F.split(accept, ",")).alias("r"))
    ranges = ranges.select(key, F.trim(F.split_part("r", F.lit(";"), F.lit(1))).alias("range"), F.coalesce(F.nullif(F.regexp_extract("r", r";\s*q=([0-9.]+)", 1), F.lit("")), F.lit("1")).cast("double").alias("q"))
    each = ranges.withColumn("media", F.explode(F.array(*[F.lit(m) for m in offered])))
    kind = F.concat(F.split_part("media", F.lit("/"), F.lit(1)), F.lit("/*"))
    rank = F.when(F.col("range") == F.col("media"), 3).when(F.col("range") == kind, 2).when(F.col("range") == "*/*", 1)
    best = each.withColumn("rank", rank).where("rank is not null").withColumn("i", F.row_number().over(Window.partitionBy(key, "media").orderBy(F.desc("rank"), F.desc("q"))))
    return best.where("i = 1 and q > 0").select(key, "media", "q")


def fractions_near(rows: DataFrame, value: str, scale: int, hundredths: int, most: int) -> DataFrame:
    """``rows`` with num and den: all fractions in lowest terms, with denominators up to ``most``, that lie within
    ``hundredths`` of a hundredth part of the positive ``value / scale``. Bounds are whole numbers, so they are exact."""
    each = rows.withColumn("den", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(most).cast("long"))))
    ends = [F.expr(f"({100 - hundredths} * {value} * den + {100 * scale - 1}) div {100 * scale}"), F.expr(f"{100 + hundredths} * {value} * den div {100 * scale}")]
    low = F.greatest(ends[0], F.lit(1).cast("long"))
    each = each.where(low <= ends[1]).withColumn("num", F.explode(F.sequence(low, ends[1])))
    prime = lambda p: ~((F.col("num") % p == 0) & (F.col("den") % p == 0))
    for p in [p for p in range(2, most + 1) if all(p % q for q in range(2, p))]:
        each = each.where(prime(p))
    return each


def simplest_near(rows: DataFrame, value: str, scale: int, hundredths: int, most: int, take: int) -> DataFrame:
    """Of ``fractions_near`` the first ``take`` of each row, by denominator, then numerator. They are found within the row, and
    denominators are tried only until there are as many, so no more than these are exploded."""
    low = f"greatest(({100 - hundredths} * {value} * den + {100 * scale - 1}) div {100 * scale}, 1L)"
    high = f"{100 + hundredths} * {value} * den div {100 * scale}"
    prime = " and ".join(f"not (num % {p} = 0 and den % {p} = 0)" for p in range(2, most + 1) if all(p % q for q in range(2, p)))
    kind = "array<struct<den: bigint, num: bigint>>"
    of_den = f"transform(filter(case when {low} <= {high} then sequence({low}, {high}) else cast(array() as array<bigint>) end, num -> {prime}), num -> struct(den, num))"
    found = f"aggregate(sequence(1L, {most}L), cast(array() as {kind}), (got, den) -> case when size(got) >= {take} then got else concat(got, cast({of_den} as {kind})) end)"
    each = rows.withColumn("_f", F.explode(F.expr(f"slice({found}, 1, {take})")))
    return each.select(*rows.columns, "_f.den", "_f.num")
