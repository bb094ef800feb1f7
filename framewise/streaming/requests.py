"""The life of a request as a stream of events: states that events choose and that time out.

Events come in any order within the watermark's delay. They are held, by key, until the watermark has passed them, and then
applied in order of time; so is each deadline of a state. What comes out depends on the events alone, not on batches. A
request that has ended leaves nothing behind, and an event after that begins a new one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

NEW = "new"


@dataclass(frozen=True)
class Rules:
    """``moves``: the state that an event leads to from a state; an event that a state has no move for is refused and
    changes nothing. ``limits``: how many milliseconds a state may last, and the state after that. ``last``: the states
    that end a request."""

    moves: dict[tuple[str, str], str]
    limits: dict[str, tuple[int, str]] = field(default_factory=dict)
    last: frozenset[str] = frozenset()


#: A request for a picture: its model loads, it waits for its answer, it stays ready for the next question a while.
PICTURE = Rules(
    {
        (NEW, "loaded"): "starting",
        (NEW, "asked"): "running",
        ("starting", "asked"): "running",
        ("running", "answered"): "ready",
        ("running", "broken"): "failed",
        ("stalled", "answered"): "ready",
        ("stalled", "broken"): "failed",
        ("ready", "asked"): "running",
        ("ready", "closed"): "ended",
    },
    {"starting": (90_000, "failed"), "running": (70_000, "stalled"), "stalled": (30_000, "failed"), "ready": (80_000, "ended")},
    frozenset({"failed", "ended"}),
)

#: What a state's end by time is called among the events.
TIMED_OUT = "timed out"
CHANGES = "{kind}, at long, event string, before string, state string, spent long, refused boolean"


class Life:
    """One request: its state, since when, and what events and the clock make of it."""

    def __init__(self, rules: Rules, state: str = NEW, since: int = 0):
        self.rules, self.state, self.since = rules, state, since

    @property
    def due(self) -> int | None:
        limit = self.rules.limits.get(self.state)
        return None if limit is None else self.since + limit[0]

    def _to(self, state: str, at: int, event: str) -> tuple:
        told = at, event, self.state, state, 0 if self.state == NEW else at - self.since, False
        self.state, self.since = (NEW, 0) if state in self.rules.last else (state, at)
        return told

    def until(self, at: int) -> Iterator[tuple]:
        """What time alone changes up to and with ``at``."""
        while self.due is not None and self.due <= at:
            yield self._to(self.rules.limits[self.state][1], self.due, TIMED_OUT)

    def on(self, at: int, event: str) -> Iterator[tuple]:
        yield from self.until(at)
        then = self.rules.moves.get((self.state, event))
        if then is None:
            yield at, event, self.state, self.state, 0 if self.state == NEW else at - self.since, True
        else:
            yield self._to(then, at, event)


#: Milliseconds whose events, or whose deadlines, are one entry of a group's state; and events in memory before they are.
SPAN, MOST = 60_000, 100_000


class Requests(StatefulProcessor):
    """A group is a deal of requests. ``held``: events that the watermark hasn't passed, an entry a span of time; ``due``:
    requests with a deadline, likewise; ``life``: by request, its state and its beginning. A timer stands at the first
    moment of what came into a span, and any timer brings the requests that have something due up to the watermark."""

    def __init__(self, rules: Rules, key: str, kind: str, columns: list[str]):
        self.rules, self.key, self.kind, self.columns = rules, key, kind, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getMapState("life", f"key {self.kind}", "state string, since long")
        self.held = handle.getMapState("held", "span long", f"key array<{self.kind}>, at array<long>, seq array<long>, event array<string>")
        self.due = handle.getMapState("due", "span long", f"key array<{self.kind}>, at array<long>")

    def _keep(self, state, rows: dict[tuple, tuple]) -> None:
        """Adds ``rows``, (key, at, ...) to what follows from it, to the entries of their spans."""
        spans: dict[int, dict] = {}
        for name, more in rows.items():
            spans.setdefault(name[1] // SPAN, {})[name] = more
        for span, new in spans.items():
            told = self._rows(state, span) | new
            state.updateValue((span,), tuple(list(c) for c in zip(*(name + more for name, more in told.items()), strict=True)))
            self.handle.registerTimer(min(at for _, at, *_ in new))

    def _rows(self, state, span: int) -> dict[tuple, tuple]:
        told = state.getValue((span,))
        wide = 3 if state is self.held else 2
        return {row[:wide]: row[wide:] for row in zip(*told, strict=True)} if told else {}

    def _passed(self, state, now: int) -> list[tuple]:
        """Takes the rows up to ``now`` out of the state."""
        out, left = [], {}
        for span in [k[0] for k in state.keys() if k[0] * SPAN <= now]:
            for name, more in self._rows(state, span).items():
                if name[1] <= now:
                    out.append(name + more)
                else:
                    left[name] = more
            state.removeKey((span,))
        self._keep(state, left)
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = {}
        for part in rows:  # as Spark hands them over, never all at once
            part = part[part["event"].notna()]
            for k, at, seq, event in zip(*(part[c].tolist() for c in (self.key, "at", "seq", "event")), strict=True):
                new[k, at, seq] = (event,)
            if len(new) >= MOST:
                self._keep(self.held, new)
                new = {}
        self._keep(self.held, new)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        events: dict = {k: [] for k, _ in self._passed(self.due, now)}
        for k, at, seq, event in self._passed(self.held, now):
            events.setdefault(k, []).append((at, seq, event))
        out, due = [], {}
        for k, come in events.items():
            before = self.life.getValue((k,))
            life = Life(self.rules, *(before or ()))
            for at, _, event in sorted(come):
                out += [(k, *row) for row in life.on(at, event)]
            out += [(k, *row) for row in life.until(now)]
            if life.state != NEW:
                if (life.state, life.since) != before:
                    self.life.updateValue((k,), (life.state, life.since))
                if life.due is not None:
                    due[k, life.due] = ()
            elif before:
                self.life.removeKey((k,))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=self.columns)
                out = []
        self._keep(self.due, due)
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def lives(stream: DataFrame, key: str, rules: Rules = PICTURE, delay: str = "60 seconds", deals: int = 256) -> DataFrame:
    """The changes of ``stream(<key>, seq, at, event)``, ``at`` in milliseconds since 1970: (<key>, at, event, before, state,
    spent, refused), where ``spent`` is how long ``before`` had lasted. Events of one key and time go by ``seq``. A row
    whose event is null only moves the clock. Events later than the watermark allows, and those of 1970's first moment, are
    dropped by Spark; ``lateness`` keeps late rows where they are wanted. Requests are dealt over ``deals`` groups; a task
    holds what becomes due in one of them at once."""
    kind = stream.schema[key].dataType.simpleString()
    told = CHANGES.format(kind=f"{key} {kind}")
    clocked = stream.withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", delay).withColumn("deal", F.pmod(F.xxhash64(key), F.lit(deals)).cast("int"))
    columns = [key, *(c.split()[0] for c in told.split(", ")[1:])]
    return clocked.groupBy("deal").transformWithStateInPandas(Requests(rules, key, kind, columns), told, "Append", "EventTime")
