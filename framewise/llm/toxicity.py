"""Toxicity by non-negative positive-unlabelled learning.

A bounded number of confirmed toxic texts and all unlabelled ones train a linear classifier in numpy. With class prior p,
the risk is p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives)): where the second part falls below zero, the
step goes back up along it. Features are the words of a text and their first bytes, present or not; those that the
positives have much more often than the rest of the unlabelled texts can be are kept, by their 64-bit hashes; they are
some of the positives' own words, so the model is bounded as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import Workspace, free_name, with_column_from_text


@dataclass(frozen=True)
class Model:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float


def distinct_features(texts: list[bytes], keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs without repeats; with ``keys``, only those, as places in it."""
    hashed, of = hashing.word_features(texts)
    if keys is not None:
        table = np.zeros(1 << 16, bool)
        table[keys & np.uint64(0xFFFF)] = True
        maybe = table[hashed & np.uint64(0xFFFF)]
        hashed, of = hashed[maybe], of[maybe]
        at = np.searchsorted(keys, hashed)
        at[at == len(keys)] = 0
        real = keys[at] == hashed if len(keys) else np.zeros(0, bool)
        pairs = np.unique(of[real] * max(len(keys), 1) + at[real])
        return pairs // max(len(keys), 1), pairs % max(len(keys), 1)
    order = np.lexsort((hashed, of))
    hashed, of = hashed[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (of[1:] != of[:-1])
    return of[new], hashed[new]


def _kept_rows(keys: np.ndarray, *columns: str) -> Callable:
    """Rows of texts to the places of their features in ``keys``, as bytes."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for block in hashing.blocks(hashing.encoded(batch["text"])):
                of, at = distinct_features(block, keys)
                rows += [x.astype("<i4").tobytes() for x in np.split(at, np.searchsorted(of, np.arange(1, len(block))))]
            yield batch[list(columns)].assign(at=rows)

    return read


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial document counts of features, a block of texts at a time."""
    for batch in batches:
        for block in hashing.blocks(hashing.encoded(batch["text"])):
            key, n = np.unique(distinct_features(block)[1], return_counts=True)
            yield pd.DataFrame({"key": key.view(np.int64), "n": n.astype(np.int64)})


def _count_known(keys: np.ndarray) -> Callable:
    """A partition's document counts of the features ``keys``, and its number of documents at place -1."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, texts = np.zeros(len(keys), np.int64), 0
        for batch in batches:
            texts += len(batch)
            for block in hashing.blocks(hashing.encoded(batch["text"])):
                counts += np.bincount(distinct_features(block, keys)[1], minlength=len(keys))
        some = np.flatnonzero(counts)
        yield pd.DataFrame({"i": np.append(some, -1), "n": np.append(counts[some], texts)})

    return read


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Rows:
    """Texts as places of their features, with how many texts each row stands for."""

    def __init__(self, at: list[np.ndarray], n: np.ndarray):
        size = np.fromiter(map(len, at), np.int64, len(at))
        self.columns = np.concatenate(at) if size.sum() else np.zeros(0, np.int64)
        self.of, self.n = np.repeat(np.arange(len(at)), size), n

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, w[self.columns], len(self.n)) + w[-1]

    def along(self, g: np.ndarray, width: int) -> np.ndarray:
        """The sum of the rows, each times its ``g``; the bias last."""
        return np.append(np.bincount(self.columns, g[self.of], width - 1), g.sum())


def _losses(w: np.ndarray) -> Callable:
    """A partition's part of the unlabelled risk as negatives (place -1) and of its gradient."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loss, grad = 0.0, np.zeros(len(w))
        for batch in batches:
            rows = Rows([np.frombuffer(x, "<i4").astype(np.int64) for x in batch["at"]], batch["n"].to_numpy(float))
            z = rows.scores(w)
            loss += float(rows.n @ np.logaddexp(0, z))
            grad += rows.along(rows.n * sigmoid(z), len(w))
        some = np.flatnonzero(grad)
        yield pd.DataFrame({"i": np.append(some, -1), "x": np.append(grad[some], loss)})

    return read


def risk(w: np.ndarray, positives: Rows, unlabelled: tuple[float, np.ndarray], n_u: int, prior: float) -> tuple[float, np.ndarray, bool]:
    """The non-negative risk at ``w``, the direction to descend along, and whether the part for negatives stays above
    zero. ``unlabelled`` is the sum of losses of all unlabelled texts taken as negatives, and its gradient."""
    z = positives.scores(w)
    k, s = max(len(z), 1), sigmoid(z)
    toxic, as_negative = prior * np.logaddexp(0, -z).sum() / k, prior * np.logaddexp(0, z).sum() / k
    grad_toxic, grad_as_negative = positives.along(prior * (s - 1) / k, len(w)), positives.along(prior * s / k, len(w))
    negative = unlabelled[0] / n_u - as_negative
    if negative >= 0:
        return toxic + negative, grad_toxic + unlabelled[1] / n_u - grad_as_negative, True
    # back up along the part that went below zero
    return toxic, grad_as_negative - unlabelled[1] / n_u, False


def train_nnpu(positives: Rows, losses: Callable[[np.ndarray], tuple[float, np.ndarray]], n_u: int, prior: float, start: np.ndarray, steps: int = 60, rate: float = 0.2, decay: float = 1e-4) -> np.ndarray:
    """Weights, the bias last, that lower the non-negative risk: full-batch Adam with the logistic loss. ``losses`` gives
    the sum over all unlabelled texts at given weights."""
    w = start.copy()
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        _, grad, _ = risk(w, positives, losses(w), n_u, prior)
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w - rate / np.sqrt(step) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether a document is kept from training; one without a doc_id always is."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit(documents: DataFrame, labels: DataFrame, work: Workspace, most_positive: int = 4000, evidence: float = 25.0, steps: int = 60) -> Model:
    """Model from ``documents(doc_id, text)`` that are not held out and ``labels(doc_id, toxic)`` of those.

    Positives are the documents labelled toxic, about ``most_positive`` of them at most, chosen by a hash of doc_id. The
    unlabelled side is every document: all are counted for the features, and all are in the risk and its gradient at
    each of ``steps``. Documents with the same features are one row with a number, so what is kept for the steps is
    small; a step sends the weights out and brings one number a feature back. The class prior, which learning from
    positives alone can't know, is the share of toxic rows among the labelled ones; no other use is made of labelled
    negatives. A feature is used if its documents among the positives exceed what texts that are not toxic let expect by
    ``evidence`` (twice the log-likelihood ratio).

    A null label says nothing, the largest of several counts; a null doc_id or text is no positive, and a document
    without a doc_id is held out. Rows that repeat count as often as they come; other columns are ignored. Without
    positives, or without documents, the model says the prior, or 0.01, of every text.
    """
    told = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    counts = told.agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).first()
    n, k = counts["n"], counts["k"] or 0
    prior = min(max(k / n if n else 0.01, 0.001), 0.9)
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    texts = documents.where(~held_out()).select("doc_id", "text")
    share = F.pmod(F.xxhash64("doc_id", F.lit("nnpu")), F.lit(1 << 40)) / (1 << 40)
    known = told.where("toxic = 1").where(share < min(1.0, most_positive / max(k, 1))).select("doc_id")
    p = work.stage(texts.where("text is not null").join(F.broadcast(known), "doc_id", "left_semi").repartition(8, "doc_id"), "positives")  # bounded, so is the number of tasks
    n_p = p.count()
    if not n_p:
        return nothing

    # features that can be evidence stand in four positives at least; these are counted in all documents
    counted = p.select("text").mapInPandas(_count, "key long, n long").groupBy("key").agg(F.sum("n").alias("p")).where("p >= 4").collect()
    rows = sorted((np.int64(r["key"]).view(np.uint64), r["p"]) for r in counted)
    keys, in_p = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], float)
    found = {r["i"]: r["n"] for r in texts.select("text").mapInPandas(_count_known(keys), "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    n_u = found.pop(-1, 0)
    in_u = np.zeros(len(keys))
    in_u[list(found)] = list(found.values())
    in_n = np.maximum(in_u / n_u - prior * in_p / n_p, 0.0) / (1 - prior)
    lift = np.log((in_p + 0.5) / n_p) - np.log(in_n + 0.5 / n_u + 0.5 / n_p)
    due = n_p * (in_n + 0.5 / n_u)
    chosen = (lift > 1.0) & (2 * (in_p * np.log(in_p / due) - (in_p - due)) >= evidence)
    keys, lift = keys[chosen], lift[chosen]

    positives = Rows([np.frombuffer(r["at"], "<i4").astype(np.int64) for r in p.select("text").mapInPandas(_kept_rows(keys), "at binary").collect()], np.ones(n_p))
    sets = work.stage(texts.select("text").mapInPandas(_kept_rows(keys), "at binary").groupBy("at").agg(F.count("*").alias("n")), "unlabelled")
    schema = "i long, x double"

    def losses(w: np.ndarray) -> tuple[float, np.ndarray]:
        found = {r["i"]: r["x"] for r in sets.mapInPandas(_losses(w), schema).groupBy("i").agg(F.sum("x").alias("x")).collect()}
        loss, grad = found.pop(-1, 0.0), np.zeros(len(w))
        grad[list(found)] = list(found.values())
        return loss, grad

    # the features of a text say much the same, so each starts with a part of what it would say alone
    w = train_nnpu(positives, losses, n_u, prior, np.append(0.3 * np.minimum(lift, 3.0), nothing.bias), steps)
    return Model(keys, w[:-1], float(w[-1]))


def scores_of(model: Model, texts: list[str | None]) -> np.ndarray:
    out = [np.zeros(0)]
    for block in hashing.blocks(hashing.encoded(texts)):
        of, at = distinct_features(block, model.keys)
        out.append(sigmoid(np.bincount(of, model.weights[at], len(block)) + model.bias))
    return np.concatenate(out)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``documents(doc_id, text)``: 0 to 1, from the text alone. Null and empty texts
    have no features and get the model's bias; repeated rows and null doc_ids are scored like others; other columns are
    ignored; an empty table gives no rows."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_column_from_text(docs, "score", pa.float64(), lambda texts: scores_of(model, texts)).select("doc_id", "score")


def clean(documents: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents that score below ``least``, with all their columns and whatever those are called; null and empty
    texts and null doc_ids are scored like others, repeated rows each."""
    name = free_name(documents, "_toxicity")
    return with_column_from_text(documents, name, pa.float64(), lambda texts: scores_of(model, texts)).where(F.col(name) < least).drop(name)
