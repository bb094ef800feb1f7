"""Rows that arrive in any order and leave in theirs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ORDERED = "{kind}, at long, value double, place long, left_in long"


#: Rows of a key that are kept as one entry, by number; and rows in a task's memory before entries go back to the state.
BLOCK, MOST = 1024, 200_000


class InOrder(StatefulProcessor):
    """A group is a deal of keys. ``due``: by key, the number that must leave next and the last block that has come;
    ``held``: rows that came before their turn, by key and block of numbers. An entry is read and written when rows of its
    numbers come or leave, so a long wait costs nothing in the batches between."""

    def __init__(self, key: str, kind: str, columns: list[str], most: int = MOST):
        self.key, self.kind, self.columns, self.most = key, kind, columns, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.due = handle.getMapState("due", f"key {self.kind}", "next long, top long")
        self.held = handle.getMapState("held", f"key {self.kind}, block long", "at array<long>, value array<double>, last array<boolean>")

    def _block(self, key, block: int, kept: bool) -> dict:
        """The rows of a block by number, once read until they are written back."""
        found = self.blocks.get((key, block))
        if found is None:
            told = self.held.getValue((key, block)) if kept else None
            found = self.blocks[key, block] = dict(zip(told[0], zip(told[1], told[2], strict=True), strict=True)) if told else {}
            self.rows += len(found)
        return found

    def _write(self) -> None:
        for name, rows in self.blocks.items():
            if rows:
                value, last = zip(*rows.values(), strict=True)
                self.held.updateValue(name, (list(rows), list(value), list(last)))
            else:
                self.held.removeKey(name)
        self.blocks, self.rows = {}, 0

    def _drop(self, key, block: int, top: int) -> None:
        """Forgets what a key that has ended still holds."""
        for name in [k for k in self.blocks if k[0] == key] if top > block else [(key, block)]:
            self.blocks[name] = {}
        if top > block:
            for name in [tuple(k) for k in self.held.keys()]:
                if name[0] == key:
                    self.blocks[name] = {}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.blocks, self.rows, told, batches, out = {}, 0, {}, {}, []
        for part in rows:
            for k, at, value, last, batch in zip(*(part[c].tolist() for c in (self.key, "at", "value", "last", "batch")), strict=True):
                due = told.get(k)
                if due is None:
                    before = self.due.getValue((k,))
                    due = told[k] = [*(before or (0, -1)), before]
                    batches[k] = batch
                batches[k] = max(batches[k], batch)
                if at >= due[0]:  # what has left doesn't leave again
                    block = at // BLOCK
                    self._block(k, block, block <= due[1])[at] = (value, bool(last))
                    due[1] = max(due[1], block)
                    self.rows += 1
            if self.rows > self.most:
                self._write()
        for k, (due, top, before) in told.items():
            ended = False
            while not ended and due // BLOCK <= top:
                ready = self._block(k, due // BLOCK, True)
                if due not in ready:
                    break
                while not ended and due in ready:
                    value, ended = ready.pop(due)
                    out.append((k, due, value, due, batches[k]))
                    due += 1
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=self.columns)
                    out = []
                if self.rows > self.most and not ended:
                    self._write()
            if ended:
                self._drop(k, (due - 1) // BLOCK, top)
                if before:
                    self.due.removeKey((k,))
            elif (due, top) != before:
                self.due.updateValue((k,), (due, top))
        self._write()
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, key: str, deals: int = 256, most: int = MOST) -> DataFrame:
    """(<key>, at, value, place, left_in) of ``stream(<key>, at, value, last, batch)``: for each key the rows 0, 1, 2, ... as
    soon as all before them have come; ``place`` counts what has left, ``left_in`` is the batch that it left in. Behind a
    gap rows wait. A row that comes twice leaves once; the row that is ``last`` ends its key. Keys are dealt over ``deals``
    groups, each of which passes in parts; in memory are the numbers that are due, by key, and about ``most`` rows."""
    kind = stream.schema[key].dataType.simpleString()
    told = ORDERED.format(kind=f"{key} {kind}")
    columns = [key, *(c.split()[0] for c in told.split(", ")[1:])]
    dealt = stream.withColumn("deal", F.pmod(F.xxhash64(key), F.lit(deals)).cast("int"))
    return dealt.groupBy("deal").transformWithStateInPandas(InOrder(key, kind, columns, most), told, "Append", "None")
