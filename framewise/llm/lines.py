"""Line deduplication by a log-template tree.

A line's tokens are its words; words with a digit are variable fields. The tree has a fixed depth: the number of tokens,
the first three tokens, the stretch of the line that is one more variable field (none, or one of eight stretches of about
an eighth of the tokens, behind the first three), and the rest of the line. So a line is on the path of up to nine
templates, and two lines share one if they agree in every token outside a stretch. Lines with a template that occurs in
many documents are dropped; the more words a template has beside its fields, the fewer different texts it takes.

A template is what its path says and does not depend on the other lines, their order or their number: what a template
counts are groupings of hashes, whatever the size of a leaf. Only lines below nodes that enough documents reach are read
for their templates, each different line once, and only templates that enough documents can have are counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .common import Workspace, text_or_empty

FIELD = "<*>"
VARIABLE = re.compile(r"\S*\d\S*")
LEAD = 3


def _hash(parts: list[bytes]) -> np.ndarray:
    """64-bit hashes of short byte strings, spaces counted."""
    from xxhash import xxh3_64_intdigest

    return np.array([xxh3_64_intdigest(p) for p in parts], np.uint64).view(np.int64)


def masked_lines(text: str) -> list[tuple[int, int, str, str]]:
    """(place, number of tokens, first tokens, masked line) of each line that is not blank."""
    out = []
    for i, line in enumerate(text.split("\n")):
        if any(c.isdigit() for c in line):
            line = VARIABLE.sub(FIELD, line)
        tokens = line.split()
        if tokens:
            out.append((i, len(tokens), " ".join(tokens[:LEAD]), " ".join(tokens)))
    return out


def templates_of(line: str, stretches: int) -> list[tuple[str, int]]:
    """(template, number of its words that are no fields) of a masked line, the line itself first."""
    tokens = line.split(" ")
    fixed = [t != FIELD for t in tokens]
    total, free = sum(fixed), len(tokens) - LEAD
    found = [(line, total)]
    if free > 0:
        ends = sorted({LEAD + -(-free * (j + 1) // stretches) for j in range(stretches)})
        for start, end in zip([LEAD, *ends], ends, strict=False):
            found.append((" ".join([*tokens[:start], f"<{end - start}>", *tokens[end:]]), total - sum(fixed[start:end])))
    return found


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts to a row for each line: its place, and hashes of its leaf and of itself."""
    for batch in batches:
        rows = []
        for d, th, text in zip(batch["id"], batch["th"], batch["text"], strict=True):
            rows += [(d, th, *line) for line in masked_lines(text)]
        out = pd.DataFrame(rows, columns=["id", "th", "i", "n", "lead", "line"])
        out["leaf"] = _hash([f"{n} {lead}".encode("utf-8", "surrogatepass") for n, lead in zip(out["n"], out["lead"], strict=True)])
        out["mask"] = _hash([x.encode("utf-8", "surrogatepass") for x in out["line"]])
        yield out[["id", "th", "i", "n", "leaf", "mask"]]


def _templates(stretches: int):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, paths = [], []
            for text, wanted in zip(batch["text"], batch["wanted"], strict=True):
                some = set(wanted)
                for i, n, lead, line in masked_lines(text):
                    if i in some:
                        for template, fixed in templates_of(line, stretches):
                            rows.append((f"{n} {lead}", line, fixed))
                            paths.append(template.encode("utf-8", "surrogatepass"))
            leaf, mask, fixed = zip(*rows, strict=True) if rows else ([], [], [])
            coded = lambda parts: _hash([x.encode("utf-8", "surrogatepass") for x in parts])
            yield pd.DataFrame({"leaf": coded(leaf), "mask": coded(mask), "template": _hash(paths), "fixed": np.array(fixed, np.int32)})

    return read


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the lines of given places; null for null, so that other texts stay where they are."""

    def one(text: str | None, places: np.ndarray | None) -> str | None:
        if text is None or places is None:
            return None
        away = set(places.tolist())
        return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in away)

    return pd.Series([one(t, g) for t, g in zip(texts, gone, strict=True)], dtype=object)


def _enough(words: str, least_documents: int, least_words: int) -> Column:
    """Whether ``documents`` or ``texts`` suffice for a template of so many words: ``least_words`` in its texts together,
    two different texts at least; or ``least_documents``, whatever it says."""
    return (F.col("documents") >= least_documents) | (F.col("texts") >= F.greatest(F.lit(2), F.ceil(least_words / F.greatest(F.col(words), F.lit(1)))))


def _counted(rows: DataFrame, *by: str) -> DataFrame:
    """documents and texts, each counted once, of ``rows(*by, id, th)``."""
    each = rows.select(*by, "th", "id").distinct().groupBy(*by, "th").agg(F.count("*").alias("documents"))
    return each.groupBy(*by).agg(F.sum("documents").alias("documents"), F.count("*").alias("texts"))


def drop_recurring(documents: DataFrame, work: Workspace, least_documents: int = 10, least_words: int = 100, stretches: int = 8, few: int = 500_000) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) of ``documents(doc_id, text)`` without the lines that have a template which
    occurs in at least ``least_documents`` documents, or in so many different texts that its words beside the fields,
    counted once a text, are ``least_words``: two texts for 50 words or more, three for 34, five for 20. Exact copies of
    a document are one text, so they do not make its own lines recur.

    Lines end at ``\\n``; blank lines stay. Null or empty text: no lines, the text stays empty. A document is a pair of
    doc_id and text, so repeated rows are one document, given once; a null doc_id is one like others; other columns are
    ignored; an empty table gives no rows. The templates of recurring lines are broadcast up to ``few`` of them, else
    joined by a shuffle.
    """
    docs = documents.select("doc_id", text_or_empty().alias("text")).withColumn("th", F.xxhash64("text")).withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    keys = work.stage(docs.select("id", "th", "text").mapInPandas(_keys, "id long, th long, i int, n int, leaf long, mask long"), "keys")
    reached = _counted(keys, "leaf", "n").where(_enough("n", least_documents, least_words)).select("leaf").distinct()
    some = work.stage(keys.join(reached, "leaf", "left_semi").drop("n"), "some")

    # the templates of each different line, read from the first document that has it
    wanted = some.groupBy("leaf", "mask").agg(F.min(F.struct("id", "th", "i")).alias("at")).select("at.*").groupBy("id", "th").agg(F.collect_list("i").alias("wanted"))
    read = docs.join(wanted, ["id", "th"]).select("id", "th", "text", "wanted").dropDuplicates(["id", "th"])
    paths = work.stage(read.mapInPandas(_templates(stretches), "leaf long, mask long, template long, fixed int"), "paths")

    # no template has more documents than its lines have together
    most = paths.join(_counted(some, "leaf", "mask"), ["leaf", "mask"]).groupBy("leaf", "template", "fixed").agg(F.sum("documents").alias("documents"), F.sum("texts").alias("texts"))
    able = most.where(_enough("fixed", least_documents, least_words)).select("leaf", "template")
    paths = work.stage(paths.join(able, ["leaf", "template"], "left_semi"), "able")
    placed = some.join(F.broadcast(paths) if paths.count() <= few else paths.hint("merge"), ["leaf", "mask"])
    often = _counted(placed, "leaf", "template", "fixed").where(_enough("fixed", least_documents, least_words)).select("leaf", "template")
    lines = work.stage(paths.join(often, ["leaf", "template"], "left_semi").select("leaf", "mask").distinct(), "often")
    gone = some.join(F.broadcast(lines) if lines.count() <= few else lines.hint("merge"), ["leaf", "mask"], "left_semi").groupBy("id", "th").agg(F.collect_set("i").alias("gone"))
    out = docs.join(gone, ["id", "th"], "left").dropDuplicates(["id", "th"])
    n = F.when(F.col("text") == "", 0).otherwise(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1)
    text = F.coalesce(_without(F.when(F.col("gone").isNotNull(), F.col("text")), F.col("gone")), F.col("text"))
    return out.select("doc_id", text.alias("text"), n.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
