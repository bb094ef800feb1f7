"""Mixing sources to target weights, with soft membership.

A classifier trained on the labelled table gives every document a posterior over domains. Nonnegative document rates are
then fitted so that each domain's expected tokens, the sum of rate * tokens * posterior, meet their target: least squares
by projected gradient. Only one number a domain goes to the driver in each step; a document's rate follows from the
residuals of the steps so far, so nothing of the corpus is kept between steps but its staged posteriors and, now and
then, rates. A rate above one stands for copies.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import Workspace, free_name, with_column_from_text

BITS = 16


@dataclass(frozen=True)
class Classifier:
    domains: tuple[str, ...]
    weights: np.ndarray  # (1 << BITS, domains), float32
    bias: np.ndarray


def _hashed(block: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of distinct hashed words and word starts, every text of length 1, and words per text."""
    hashed, of = hashing.word_features(block, (3,))
    pairs = np.unique((of.astype(np.int64) << BITS) | (hashed >> np.uint64(64 - BITS)).astype(np.int64))
    of, at = pairs >> BITS, pairs & ((1 << BITS) - 1)
    size = np.bincount(of, minlength=len(block))
    _, starts = hashing.words(block)
    return of, at, 1 / np.sqrt(size[of]), np.diff(starts)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for block in hashing.blocks(hashing.encoded(batch["text"])):
            of, at, _, _ = _hashed(block)
            rows += [x.astype("<u2").tobytes() for x in np.split(at, np.searchsorted(of, np.arange(1, len(block))))]
        yield pd.DataFrame({"domain": batch["domain"], "at": rows})


def train_classifier(documents: DataFrame, labels: DataFrame, domain: str, work: Workspace, most: int = 4000, epochs: int = 40, rate: float = 0.5) -> Classifier:
    """Multinomial logistic regression in numpy on about ``most`` labelled documents at most, chosen by a hash of
    doc_id; ``domain`` is an SQL expression over the labelled table, null meaning no label. Without labels there is one
    domain, ``all``."""
    told = labels.where("doc_id is not null").select("doc_id", F.expr(domain).cast("string").alias("domain")).where("domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    share = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 40)) / (1 << 40)
    told = told.where(share < min(1.0, most / max(told.count(), 1)))
    sample = work.stage(documents.where("doc_id is not null").select("doc_id", "text").join(told, "doc_id").select("text", "domain").repartition(8), "labelled")
    drawn = sample.mapInPandas(_sparse, "domain string, at binary").collect()  # at most about ``most`` rows
    domains = tuple(sorted({r["domain"] for r in drawn})) or ("all",)
    k, weights, bias = len(domains), np.zeros((1 << BITS, len(domains)), np.float32), np.zeros(len(domains))
    if k == 1:
        return Classifier(domains, weights, bias)
    rows = [np.frombuffer(r["at"], "<u2").astype(np.int64) for r in sorted(drawn, key=lambda r: (r["domain"], r["at"]))]
    y = np.array([domains.index(r["domain"]) for r in sorted(drawn, key=lambda r: (r["domain"], r["at"]))])
    bias = np.log(np.bincount(y, minlength=k) / len(y))
    draw, squares = np.random.default_rng(0), np.full((1 << BITS, k), 1e-3, np.float32)
    for _ in range(epochs):
        for some in np.array_split(draw.permutation(len(rows)), max(1, len(rows) // 128)):
            size = np.array([len(rows[i]) for i in some])
            at, of = np.concatenate([rows[i] for i in some]), np.repeat(np.arange(len(some)), size)
            value = (1 / np.sqrt(np.maximum(size, 1)))[of]
            z = np.stack([np.bincount(of, weights[at, c] * value, len(some)) for c in range(k)], axis=1) + bias
            g = softmax(z)
            g[np.arange(len(some)), y[some]] -= 1
            g /= len(some)
            used, place = np.unique(at, return_inverse=True)
            step = np.stack([np.bincount(place, g[of, c] * value, len(used)) for c in range(k)], axis=1).astype(np.float32)
            squares[used] += step**2
            weights[used] -= rate * step / np.sqrt(squares[used])
            bias = bias - 0.1 * g.sum(axis=0)
    return Classifier(domains, weights, bias)


def posteriors_of(model: Classifier, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors and words of each text."""
    soft, tokens = [np.zeros((0, len(model.domains)))], [np.zeros(0, np.int64)]
    for block in hashing.blocks(hashing.encoded(texts)):
        of, at, value, words = _hashed(block)
        soft.append(softmax(np.stack([np.bincount(of, model.weights[at, c] * value, len(block)) for c in range(len(model.domains))], axis=1) + model.bias))
        tokens.append(words)
    return np.concatenate(soft), np.concatenate(tokens)


def _posteriors(model: Classifier) -> Callable:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            soft, tokens = posteriors_of(model, batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tokens": tokens, "posteriors": [x.astype("<f4").tobytes() for x in soft]})

    return read


@dataclass(frozen=True)
class Steps:
    """What a document's rate follows from: the steps' residuals over what each domain has, and the bounds of a rate."""

    scaled: np.ndarray  # (steps, domains)
    start: float
    most: float | None

    def rates(self, soft: np.ndarray, rates: np.ndarray | None = None) -> np.ndarray:
        """Rates after these steps, from ``start`` or given rates: each goes along the posteriors and is cut at the
        bounds."""
        r = np.full(len(soft), self.start) if rates is None else rates
        for residual in self.scaled:
            r = np.clip(r - soft @ residual, 0.0, self.most)
        return r


def _soft(batch: pd.DataFrame, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch["posteriors"]), "<f4").reshape(len(batch), k).astype(float)


def _totals(steps: Steps, k: int, started: bool) -> Callable:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                soft = _soft(batch, k)
                r = steps.rates(soft, batch["rate"].to_numpy() if started else None)
                yield pd.DataFrame([(r * batch["tokens"].to_numpy()) @ soft], columns=[f"m{i}" for i in range(k)])

    return read


def _rates(steps: Steps, k: int, started: bool, listed: bool) -> Callable:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            soft = _soft(batch, k)
            r = steps.rates(soft, batch["rate"].to_numpy() if started else None)
            yield batch[["doc_id", "tokens"]].assign(rate=r, posteriors=list(soft) if listed else batch["posteriors"])

    return read


@dataclass(frozen=True)
class Mix:
    rates: DataFrame
    domains: tuple[str, ...]
    available: np.ndarray
    targets: np.ndarray
    reached: np.ndarray
    model: Classifier
    steps: Steps
    tolerance: float

    @property
    def unmet(self) -> dict[str, float]:
        """Domains whose expected tokens miss their target by more than the tolerance, and by what share of it (of all
        targets where it is zero)."""
        base = np.where(self.targets > 0, self.targets, max(self.targets.sum(), 1e-9))
        off = (self.reached - self.targets) / base
        return {d: float(x) for d, x in zip(self.domains, off, strict=True) if abs(x) > self.tolerance}


def fit_rates(documents: DataFrame, labels: DataFrame, work: Workspace, weights: dict[str, float] | None = None, domain: str = "concat('quality=', quality, ' toxic=', toxic)", budget: float = 0.5, steps: int = 200, tolerance: float = 1e-3, most: float | None = None, every: int = 10) -> Mix:
    """Rates for every row of ``documents(doc_id, text)``: (doc_id, tokens, rate, posteriors).

    ``weights`` are the target shares of the domains (missing ones get none; without it, the square roots of what is
    there), ``budget`` the share of all tokens to be used, ``most`` the largest rate if there is one. Tokens are words.
    Each step subtracts, from every rate, the posteriors' product with the residuals scaled by what the domains have,
    which can't overshoot; the fit ends when every domain is within ``tolerance`` of its target, when a step changes
    no domain by a hundredth of that, or after ``steps``. What is then still missed, as no rates can give it or as
    ``most`` stands against it, is in ``Mix.unmet`` by domain and logged as a warning. Rates are written after ``every``
    steps, so a step costs the same however many came before.

    Null or empty text has no tokens: its rate says what a document like it would get. A null doc_id, repeated rows and
    other columns are rows like others or ignored; an empty table gives no rows.
    """
    model = train_classifier(documents, labels, domain, work)
    k = len(model.domains)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    soft = work.stage(docs.mapInPandas(_posteriors(model), "doc_id long, tokens long, posteriors binary"), "posteriors")
    none = Steps(np.zeros((0, k)), budget, most)

    def total(rows: DataFrame, steps: Steps, started: bool) -> np.ndarray:
        partial = rows.mapInPandas(_totals(steps, k, started), ", ".join(f"m{i} double" for i in range(k)))
        return np.array([x or 0.0 for x in partial.agg(*[F.sum(f"m{i}") for i in range(k)]).first()])

    available = total(soft, Steps(none.scaled, 1.0, None), False)
    share = np.array([weights.get(d, 0.0) for d in model.domains]) if weights else np.sqrt(available)
    targets = budget * available.sum() * share / share.sum() if share.sum() else np.zeros(k)
    # rates move along D = diag(1 / available): the curvature along posteriors is then at most 1
    scale, base = np.maximum(available, 1.0), np.where(targets > 0, targets, max(targets.sum(), 1e-9))
    now, started, done, since = soft, False, [], []
    reached = budget * available if most is None or budget <= most else total(soft, Steps(np.zeros((1, k)), budget, most), False)
    for _ in range(steps):
        if np.abs((reached - targets) / base).max(initial=0.0) <= tolerance:
            break
        since.append((reached - targets) / scale)
        if len(since) == every:
            held = now.mapInPandas(_rates(Steps(np.array(since), budget, most), k, started, False), "doc_id long, tokens long, rate double, posteriors binary")
            now, started, done, since = work.stage(held, "rates"), True, done + since, []
        before, reached = reached, total(now, Steps(np.array(since).reshape(-1, k), budget, most), started)
        if np.abs((reached - before) / base).max(initial=0.0) <= tolerance / 100:
            break
    rates = now.mapInPandas(_rates(Steps(np.array(since).reshape(-1, k), budget, most), k, started, True), "doc_id long, tokens long, rate double, posteriors array<double>")
    mix = Mix(rates, model.domains, available, targets, reached, model, Steps(np.array(done + since).reshape(-1, k), budget, most), tolerance)
    if mix.unmet:
        logging.getLogger(__name__).warning("targets missed, as shares: %s", mix.unmet)
    return mix


def kept(documents: DataFrame, mix: Mix, work: Workspace, few: int = 2_000_000) -> DataFrame:
    """The documents that their rates draw, with all their columns: the whole part of a rate as so many copies, and one
    more where a hash of doc_id and text, as a number from 0 to 1, lies below what is left of it; so rows without a doc_id,
    or with a shared one, are drawn each for itself. Rows that are equal in both are told apart by their place in the table;
    which there are is broadcast up to ``few`` of them, else joined by a shuffle. The rate follows from the text again, so
    texts are not shuffled to their rates."""
    model, steps = mix.model, mix.steps

    def rates(texts: list[str | None]) -> np.ndarray:
        return steps.rates(posteriors_of(model, texts)[0].astype("<f4").astype(float))

    name, same, mark = (free_name(documents, n) for n in ("_rate", "_same", "_again"))
    keyed = documents.withColumn(same, F.xxhash64("doc_id", "text", F.lit("draw")))
    again = work.stage(keyed.groupBy(same).count().where("count > 1").select(F.col(same).alias(mark)), "again")
    if not again.isEmpty():
        again = F.broadcast(again) if again.count() <= few else again.hint("merge")
        keyed = keyed.join(again, F.col(same) == F.col(mark), "left")
        keyed = keyed.withColumn(same, F.when(F.col(mark).isNull(), F.col(same)).otherwise(F.xxhash64(same, F.monotonically_increasing_id()))).drop(mark)
    rate = F.col(name)
    draw = F.pmod(F.col(same), F.lit(1 << 40)) / (1 << 40)
    copies = F.floor(rate).cast("int") + (draw < rate - F.floor(rate)).cast("int")
    drawn = with_column_from_text(keyed, name, pa.float64(), rates).withColumn(name, copies).where(rate > 0)
    if steps.most is None or steps.most > 1:
        drawn = drawn.withColumn(name, F.explode(F.sequence(F.lit(1), rate)))
    return drawn.drop(name, same)


def drawn_misses(kept: DataFrame, mix: Mix) -> dict[str, float]:
    """By how much, as shares, the expected tokens of the documents that were in fact drawn miss each domain's target.
    ``unmet`` says what the rates give on average; a draw of few documents is off by chance, too."""
    k = len(mix.domains)
    soft = kept.select(F.lit(0).cast("long").alias("doc_id"), "text").mapInPandas(_posteriors(mix.model), "doc_id long, tokens long, posteriors binary")
    totals = soft.mapInPandas(_totals(Steps(np.zeros((0, k)), 1.0, None), k, False), ", ".join(f"m{i} double" for i in range(k)))
    reached = np.array([x or 0.0 for x in totals.agg(*[F.sum(f"m{i}") for i in range(k)]).first()])
    base = np.where(mix.targets > 0, mix.targets, max(mix.targets.sum(), 1e-9))
    return dict(zip(mix.domains, ((reached - mix.targets) / base).tolist(), strict=True))
