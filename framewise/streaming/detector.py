"""Push-based forms on Structured Streaming: frames arrive in order, scores leave when their window is complete.

A source's state is the few frames whose windows are still open, whatever has passed before; a row with ``last`` flushes
them. The batch forms give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCORED = "source_id long, frame long, score double"
STATE = "next long, first long, held array<double>"
#: What a turn's role makes of a request.
STATES = {"system": "starting", "user": "running", "assistant": "ready"}


def _push(side: int):
    def push(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        todo, first, held = state.get if state.exists else (0, 0, [])
        held, ended, out = list(held), False, []
        rows = pd.concat(list(batches)).sort_values("frame")
        held += rows["value"].tolist()
        ended = bool(rows["last"].any())
        end = first + len(held)
        while todo < end and (ended or todo + side < end):
            near = held[max(todo - side, 0) - first : todo + side + 1 - first]
            out.append((key[0], todo, sum(near) / len(near)))
            todo += 1
        keep = max(todo - side, 0)
        if ended:
            state.remove()
        else:
            state.update((todo, keep, held[keep - first :]))
        yield pd.DataFrame(out, columns=["source_id", "frame", "score"])

    return push


def pushed(stream: DataFrame, side: int = 2) -> DataFrame:
    """(source_id, frame, score) of ``stream(source_id, frame, value, last)``: each value's mean with ``side`` neighbours
    on each side, fewer at the ends. Frames of a source must arrive in order over the batches."""
    return stream.groupBy("source_id").applyInPandasWithState(_push(side), SCORED, STATE, "append", GroupStateTimeout.NoTimeout)


def batch(frames: DataFrame, side: int = 2) -> DataFrame:
    by = Window.partitionBy("source_id").orderBy("frame").rowsBetween(-side, side)
    return frames.select("source_id", "frame", F.avg("value").over(by).alias("score"))


OPEN = "source array<long>, shot array<long>, held array<double>"


def _causal(reach: int):
    def slice_(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        source, shot, value = (np.array(x, t) for x, t in zip(state.get if state.exists else ([], [], []), ("int64", "int64", "float64"), strict=True))
        n = len(source)  # what is held comes before all new rows of its shot
        source, shot, value = (np.concatenate([x, rows[c].to_numpy(x.dtype)]) for x, c in ((source, "source_id"), (shot, "shot"), (value, "value")))
        i, last = np.concatenate([np.arange(-n, 0), rows["i"].to_numpy("int64")]), np.concatenate([np.zeros(n, bool), rows["last"].to_numpy(bool)])
        order = np.lexsort((i, shot, source))
        source, shot, value, i, last = source[order], shot[order], value[order], i[order], last[order]
        begins = np.r_[True, (source[1:] != source[:-1]) | (shot[1:] != shot[:-1])]
        starts = np.flatnonzero(begins)
        of = np.cumsum(begins) - 1
        place = np.arange(len(i))
        total, count, there = np.zeros(len(i)), np.zeros(len(i), "int64"), ~np.isnan(value)
        for back in range(reach, -1, -1):
            near = np.flatnonzero(place - starts[of] >= back)
            near = near[there[near - back]]
            total[near] += value[near - back]
            count[near] += 1
        new = i >= 0
        yield pd.DataFrame({"source_id": source, "shot": shot, "i": i, "causal": np.where(count > 0, total / np.maximum(count, 1), np.nan)})[new]
        keep = ~np.logical_or.reduceat(last, starts)[of] & (np.r_[starts[1:], len(i)][of] - place <= reach)
        if keep.any():
            state.update((source[keep].tolist(), shot[keep].tolist(), value[keep].tolist()))
        elif state.exists:
            state.remove()

    return slice_


def causal_slices(stream: DataFrame, reach: int = 2, deals: int = 256) -> DataFrame:
    """(source_id, shot, i, causal) of ``stream(source_id, shot, i, value, last)``: the mean of a frame and up to
    ``reach`` before it in its shot. What a slice leaves to the next is the last ``reach`` values; they are forgotten at the
    end of the shot. Slices of a shot must arrive in order. Shots are short and many, so they are dealt over ``deals``
    groups, each computed at once; a group's state is the open shots of its own, its memory their rows of one batch."""
    dealt = stream.withColumn("deal", F.pmod(F.xxhash64("source_id", "shot"), F.lit(deals)).cast("int"))
    return dealt.groupBy("deal").applyInPandasWithState(_causal(reach), "source_id long, shot long, i long, causal double", OPEN, "append", GroupStateTimeout.NoTimeout)


def _lifecycle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    before, count = state.get if state.exists else ("new", 0)
    out = []
    for r in pd.concat(list(batches)).sort_values("turn").itertuples():
        now = STATES.get(r.role, "failed")
        count += now != before
        out.append((key[0], r.turn, now, count))
        before = now
    state.update((before, count))
    yield pd.DataFrame(out, columns=["conv_id", "turn", "state", "changes"])


def lifecycle(stream: DataFrame) -> DataFrame:
    """(conv_id, turn, state, changes): a request's state after each turn and how often it has changed."""
    return stream.groupBy("conv_id").applyInPandasWithState(_lifecycle, "conv_id long, turn long, state string, changes long", "state string, changes long", "append", GroupStateTimeout.NoTimeout)


def hourly(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts and sums per hour and kind with a watermark: what comes later than ``late`` is dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
