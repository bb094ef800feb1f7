"""Repair of conversations at least cost: edits that make the roles ``(s?(ua)+)?``.

Rows are read as symbols: the initial of the role and the fault, if any. An automaton over the places of the grammar (start,
after a system, a user, an assistant turn) weighs what can be done with a row. It is made deterministic lazily: a state is a
vector of what each place costs from here to the end, less the least of them; a table keeps, for each state and symbol met,
the next state and what was taken off. Few vectors ever arise, so a conversation is a walk through that table
(``Table.scan``). The scan goes from the last row to the first. The trace then goes back against it, from the first row on,
along tight arcs alone, those whose weight is exactly what the vectors differ by; as it meets edits in reading order, ties
go to the ASCII-least edits by taking the least at each row, over all places that are still in.

A conversation of up to ``most`` rows is one stream in one task. A longer one is cut into ranges of rows: each range says
what it costs from any place to any other, the vectors at the cuts follow from these, then each range says where the trace
ends for any set of places that it can begin in, and at last all ranges are traced at once. Equal rows of one turn are one
row with a number of copies there, so not even they must meet.

Rows lie by turn, nulls first, then role and text; null roles and texts are read as empty (a blank text is a fault, an empty
role one to be changed). Repeated rows are duplicates. A null conversation is a conversation. Empty tables have no
conversations. Further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Workspace

#: What an edit costs, and what an undeleted truncated row adds.
DELETE, REROLE, INSERT, CUT_OFF = 4, 3, 3, 3
BLANKS, ENDS = " \t\n\v\f\r", ".!?"
FAULTS = ("", "truncated", "blank", "duplicate")
#: Places in the grammar, and where a turn of a role leads from each.
START, SYSTEM, USER, ASSISTANT = range(4)
LEADS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
FAR = 1 << 40


def inserted(place: int) -> list[tuple[int, int]]:
    """(number of inserted turns, place after them): none, one or two; more come back to where one was."""
    out = [(0, place)]
    for n in (1, 2):
        place = ASSISTANT if place == USER else USER
        out.append((n, place))
    return out


@cache
def arcs(symbol: str) -> list[list[tuple[str, int, int]]]:
    """(edits, cost, place after) from each place over one row; ``symbol`` is the initial and a letter of the fault."""
    initial, gone, cut = symbol[0], symbol[1] in "bd", symbol[1] == "t"
    out = []
    for place in range(4):
        found = []
        for n, p in inserted(place):
            said, cost = "I" * n, INSERT * n
            found.append((said + "D", cost + DELETE, p))
            if not gone:
                more = CUT_OFF if cut else 0
                if p in LEADS.get(initial, {}):
                    found.append((said + "K", cost + more, LEADS[initial][p]))
                found += [(said + "R", cost + REROLE + more, LEADS[role][p]) for role in "ua" if p in LEADS[role]]
        out.append(sorted(found))
    return out


#: What is inserted behind the last row, and its cost: nothing where the grammar may end.
LAST = {START: ("", 0), SYSTEM: ("II", 2 * INSERT), USER: ("I", INSERT), ASSISTANT: ("", 0)}


class Table:
    """The deterministic automaton as far as it was needed: states are vectors of costs to the end, less the least."""

    def __init__(self):
        self.vectors: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.moves: dict[tuple[int, str], tuple[int, int]] = {}
        self.traced: dict[tuple, tuple[str, tuple]] = {}
        self.end = self.state([LAST[p][1] for p in range(4)])[0]

    def state(self, costs: list[int]) -> tuple[int, int]:
        """The state of a vector and its least cost."""
        least = min(costs)
        vector = tuple(FAR if c - least >= FAR // 2 else c - least for c in costs)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector], least

    def before(self, state: int, symbol: str) -> tuple[int, int]:
        """The state before a row, and what its vector costs more."""
        if (state, symbol) not in self.moves:
            after = self.vectors[state]
            self.moves[state, symbol] = self.state([min(cost + after[q] for _, cost, q in found) for found in arcs(symbol)])
        return self.moves[state, symbol]

    def scan(self, symbols: list[str], copies: list[int], end: int) -> tuple[list[int], int]:
        """The states before each row and behind the last, and the cost, in all, that was taken off them. Copies of a row
        after its first are deleted, which leaves the state as it is."""
        states, cost = [end] * (len(symbols) + 1), 0
        for i in range(len(symbols) - 1, -1, -1):
            end, more = self.before(end, symbols[i])
            states[i] = end
            cost += more + DELETE * (copies[i] - 1)
        return states, cost

    def step(self, places: tuple, before: int, symbol: str, after: int) -> tuple[str, tuple]:
        """The least edits of a row on tight arcs from any of ``places``, and the places that they lead to."""
        key = places, before, symbol, after
        if key not in self.traced:
            here, there, more = self.vectors[before], self.vectors[after], self.before(after, symbol)[1]
            tight = [(edits, q) for p in places for edits, cost, q in arcs(symbol)[p] if cost + there[q] == here[p] + more]
            least = min(edits for edits, _ in tight)
            self.traced[key] = least, tuple(sorted({q for edits, q in tight if edits == least}))
        return self.traced[key]

    def trace(self, symbols: list[str], copies: list[int], states: list[int], places: tuple) -> tuple[list[str], tuple, int]:
        """The edits of each row, the places after them, and how many turns they leave."""
        out, turns = [], 0
        for i, symbol in enumerate(symbols):
            edits, places = self.step(places, states[i], symbol, states[i + 1])
            out.append(edits)
            turns += len(edits) - edits.endswith("D")
        return out, places, turns

    def last(self, places: tuple) -> str:
        """What is inserted behind the last row: the least of what costs least from the places."""
        return min((LAST[p] for p in places), key=lambda x: (x[1], x[0]))[0]


def seen_as(role: str, text: str, duplicate: bool) -> tuple[str, str]:
    """A row's symbol and its fault."""
    core = text.rstrip(BLANKS)
    fault = "blank" if not core else "duplicate" if duplicate else "truncated" if core[-1] not in ENDS else ""
    return (role[:1] if role[:1] in LEADS else "-") + (fault[:1] or "-"), fault


def said(edits: list[str], copies: list[int], turns: int, opened: bool) -> Iterator[tuple[str, list[str]]]:
    """Each row's edits, its copies' too, and the roles that its turns have: ``opened`` by a system turn or not, users and
    assistants take turns, so a turn's number says its role. ``turns`` came before."""
    for edit, n in zip(edits, copies, strict=True):
        made = len(edit) - edit.endswith("D")
        yield edit + "D" * (n - 1), ["system" if opened and i == 0 else "assistant" if (i - opened) % 2 else "user" for i in range(turns, turns + made)]
        turns += made


STEPS = "{kind}, place long, turn long, role string, text string, copies long, fault string, edits string, roles array<string>, cost long"


def _steps(conv, first: int, rows: list[tuple], symbols: list[str], faults: list[str], copies: list[int], edits: list[str], turns: int, opened: bool, cost: int | None, last: str | None) -> Iterator[tuple]:
    """What ``repaired`` returns of a conversation or a range of one; ``last`` ends it."""
    for i, (more, roles) in enumerate(said(edits, copies, turns, opened)):
        turn, role, text = rows[i]
        if edits[i][-1] == "K":
            roles[-1] = role
        yield conv, first + i, turn, role, text, copies[i], faults[i], more, roles, cost if first + i == 0 else None
    if last:
        turns += sum(len(e) - e.endswith("D") for e in edits)
        yield conv, first + len(rows), None, None, None, 0, None, last, next(said([last], [1], turns, opened))[1], None


def _whole(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Conversations that lie whole and in order in a task, one at a time."""
    table = Table()

    def told(conv, rows: list[tuple]) -> Iterable[tuple]:
        seen, symbols, faults = set(), [], []
        for _, role, text in rows:
            symbol, fault = seen_as(role, text, (role, text) in seen)
            seen.add((role, text))
            symbols.append(symbol)
            faults.append(fault)
        copies = [1] * len(rows)
        states, cost = table.scan(symbols, copies, table.end)
        edits, places, turns = table.trace(symbols, copies, states, (START,))
        last = table.last(places)
        cost += table.vectors[states[0]][START]
        return _steps(conv, 0, rows, symbols, faults, copies, edits, 0, bool((turns + len(last)) % 2), cost, last)

    now, held, first = None, [], True
    for batch in batches:
        out = []
        for conv, *row in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")], strict=True):
            if first or conv != now:
                out += told(now, held) if held else []
                now, held, first = conv, [], False
            held.append((row[0], row[1], row[2]))
        yield _batch(out, schema)
    if held:
        yield _batch([*told(now, held)], schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _in_ranges(rows: DataFrame, work: Workspace, most: int, kind: str) -> DataFrame:
    """The same for conversations of more than ``most`` rows, cut into ranges of about so many."""
    each = work.stage(rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")), "long-rows")
    order = ["conv_id", "turn", "role", "text"]
    cut = each.repartitionByRange(max(1, -(-each.count() // most)), *order).sortWithinPartitions(*order)
    cut = cut.withColumn("_i", F.monotonically_increasing_id()).withColumn("piece", F.shiftright("_i", 33)).withColumn("digest", F.sha2("text", 256))
    cut = work.stage(cut, "long-ranges")
    firsts = cut.groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest")).agg(F.min("_i").alias("_first"))
    cut = cut.join(firsts, F.expr("conv_id <=> _conv and role = _role and digest = _digest"))
    cut = cut.select("conv_id", "piece", "_i", F.col("turn").cast("string").alias("turn"), "role", "text", "copies", (F.col("_i") > F.col("_first")).alias("again"))
    cut = work.stage(cut, "long-seen")

    def read(part: pd.DataFrame) -> tuple:
        part = part.sort_values("_i")
        seen = [seen_as(*row) for row in zip(part["role"], part["text"], part["again"], strict=True)]
        return part, [s for s, _ in seen], [f for _, f in seen], part["copies"].tolist()

    def costs(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part, symbols, _, copies = read(part)
        table, out = Table(), []
        for q in range(4):
            states, cost = table.scan(symbols, copies, table.state([0 if p == q else FAR for p in range(4)])[0])
            out.append([min(FAR, cost + v) for v in table.vectors[states[0]]])
        return pd.DataFrame({"conv_id": [key[0]], "piece": [key[1]], "rows": [len(part)], "matrix": [[int(out[q][p]) for p in range(4) for q in range(4)]]})

    def ends(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        """The vector of costs behind each range, from the last range on."""
        parts = parts.sort_values("piece")
        vector, out = [LAST[p][1] for p in range(4)], []
        for matrix in reversed(parts["matrix"].tolist()):
            out.append([int(v) for v in vector])
            vector = [min(matrix[4 * p + q] + vector[q] for q in range(4)) for p in range(4)]
        begins = parts["rows"].cumsum() - parts["rows"]
        return pd.DataFrame({"conv_id": [key[0]] * len(parts), "piece": parts["piece"].tolist(), "begin": begins.tolist(), "behind": out[::-1], "cost": int(vector[START])})

    def leads(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        """Where the trace ends, and with how many turns, for each set of places that it may begin in."""
        _, symbols, _, copies = read(part)
        table, out = Table(), []
        states, _ = table.scan(symbols, copies, table.state(list(part["behind"].iloc[0]))[0])
        for mask in range(1, 16):
            _, places, turns = table.trace(symbols, copies, states, tuple(p for p in range(4) if mask >> p & 1))
            out += [sum(1 << p for p in places), turns]
        return pd.DataFrame({"conv_id": [key[0]], "piece": [key[1]], "leads": [out]})

    def begins(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("piece")
        mask, turns, out = 1 << START, 0, []
        for lead in parts["leads"].tolist():
            out.append((mask, turns))
            mask, turns = int(lead[2 * mask - 2]), turns + int(lead[2 * mask - 1])
        last = Table().last(tuple(p for p in range(4) if mask >> p & 1))
        return pd.DataFrame({"conv_id": [key[0]] * len(parts), "piece": parts["piece"].tolist(), "mask": [m for m, _ in out], "turns": [t for _, t in out], "opened": bool((turns + len(last)) % 2), "last": [None] * (len(parts) - 1) + [last]})

    def traced(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part, symbols, faults, copies = read(part)
        one, table = part.iloc[0], Table()
        states, _ = table.scan(symbols, copies, table.state(list(one["behind"]))[0])
        edits, _, _ = table.trace(symbols, copies, states, tuple(p for p in range(4) if one["mask"] >> p & 1))
        rows = [(None if pd.isna(t) else int(t), r, x) for t, r, x in zip(part["turn"], part["role"], part["text"], strict=True)]
        out = _steps(key[0], int(one["begin"]), rows, symbols, faults, copies, edits, int(one["turns"]), bool(one["opened"]), int(one["cost"]), one["last"])
        return pd.DataFrame([*out], columns=[c.split()[0] for c in STEPS.format(kind=kind).split(", ")]).astype({"turn": "Int64", "cost": "Int64"})

    of = ["conv_id", "piece"]
    matrices = work.stage(cut.groupBy(of).applyInPandas(costs, f"{kind}, piece long, rows long, matrix array<long>"), "long-costs")
    behind = work.stage(matrices.groupBy("conv_id").applyInPandas(ends, f"{kind}, piece long, begin long, behind array<long>, cost long"), "long-ends")
    met = lambda a, b: a.join(b.withColumnsRenamed({"conv_id": "_conv", "piece": "_piece"}), F.expr("conv_id <=> _conv and piece = _piece")).drop("_conv", "_piece")
    led = work.stage(met(cut, behind).groupBy(of).applyInPandas(leads, f"{kind}, piece long, leads array<long>"), "long-leads")
    begun = work.stage(led.groupBy("conv_id").applyInPandas(begins, f"{kind}, piece long, mask long, turns long, opened boolean, last string"), "long-begins")
    return met(met(cut, behind), begun).groupBy(of).applyInPandas(traced, STEPS.format(kind=kind))


@dataclass(frozen=True)
class Repaired:
    """``steps(conv_id, place, turn, role, text, copies, fault, edits, roles, cost)``: in order of place, each row with the
    edits of it and of what is inserted before it (``I``), and the roles of the turns that these leave; its own turn, if
    kept (``K``) or given another role (``R``), is the last of them and has its text, inserted ones have none. A last row
    without a text holds what is inserted at the end. The first row has the cost of all. ``conversations``: what
    ``summaries`` makes of the steps."""

    steps: DataFrame
    conversations: DataFrame


SUMMARY = "{kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def summaries(steps: DataFrame, kind: str) -> DataFrame:
    """A row for each conversation of ``steps``, which lie whole and in order in a task: its repaired turns pass by and only
    their digest stays. The audit is one text a conversation."""
    schema = to_arrow_schema(_schema(SUMMARY.format(kind=kind)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, one = None, None
        for batch in batches:
            out = []
            for conv, *row in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "fault", "edits", "roles", "cost")], strict=True):
                if one is None or conv != now:
                    if one:
                        out.append((now, *one.told()))
                    now, one = conv, Summary()
                one.add(*row)
            yield _batch(out, schema)
        if one:
            yield _batch([(now, *one.told())], schema)

    return steps.mapInArrow(read, SUMMARY.format(kind=kind))


class Summary:
    def __init__(self):
        self.least = self.most = self.before = self.cost = None
        self.turns, self.illegal, self.lines, self.audit = 0, 0, 0, []
        self.faults, self.digest = dict.fromkeys(FAULTS, 0), hashlib.sha256()

    def add(self, turn, role, text, copies: int, fault, edits: str, roles: list[str], cost) -> None:
        self.audit.append(edits)
        self.cost = self.cost or cost
        kept = edits.rstrip("D")[-1:] in ("K", "R")
        for i, said in enumerate(roles, 1):
            own = text if kept and i == len(roles) else ""
            self.digest.update(f"{chr(10) if self.lines else ''}{said}:{own}".encode())
            self.lines += 1
        if not copies:
            return
        if turn is not None:  # in order, so a new turn is a greater one
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.most
            self.most = turn
        self.faults[fault] += 1
        self.faults["blank" if fault == "blank" else "duplicate"] += copies - 1
        if self.before is not None:
            self.illegal += self.before + role[:1] not in ("su", "ua", "au")
        self.illegal += copies - 1
        self.before = role[:1]

    def told(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return gaps, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"], self.illegal, self.cost or 0, "".join(self.audit), self.digest.hexdigest()


def _schema(told: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(told)


def repaired(turns: DataFrame, work: Workspace, most: int = 10_000, few: int = 2_000_000) -> Repaired:
    """The repair of ``turns(conv_id, turn, role, text)``. The ids of long conversations, at most one in ``most`` rows, are
    broadcast up to ``few`` of them, then joined by a shuffle."""
    kind = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}"
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    order = ["conv_id", "turn", "role", "text"]
    long = work.stage(rows.groupBy("conv_id").count().where(F.col("count") > most).select(F.col("conv_id").alias("_long")), "long")
    some = not long.isEmpty()
    short = rows
    if some:
        is_long, long = F.col("conv_id").eqNullSafe(F.col("_long")), long.hint("broadcast" if long.count() <= few else "merge")
        short, rows = rows.join(long, is_long, "left_anti"), rows.join(long, is_long, "left_semi")
    schema = to_arrow_schema(_schema(STEPS.format(kind=kind)))
    steps = short.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(lambda batches: _whole(batches, schema), STEPS.format(kind=kind))
    told = summaries(steps, kind)
    if some:
        cut = work.stage(_in_ranges(rows, work, most, kind), "long-steps")
        steps, told = steps.unionByName(cut), told.unionByName(summaries(cut.repartition("conv_id").sortWithinPartitions("conv_id", "place"), kind))
    return Repaired(steps, told)
