"""Conversation repair against a search over all edits, and the damage, faults and digests of its query in plain Python."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from framewise.llm import queries, repair
from framewise.llm.common import Workspace, table

BLANK = " \t\n\v\f\r"


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        core = text.strip(BLANK)
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """The least (cost, audit) and its turns, by a search from the start over every edit: dearer ones come later, and of
    equally dear ones those with greater audits."""
    heap, done, n = [(0, "", 0, "", ())], set(), len(rows)
    while heap:
        cost, audit, i, roles, turns = heapq.heappop(heap)
        if i == n and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, list(turns)
        key = i, len(roles) and (roles[-1], roles[:1] == "s", len(roles) > 1)
        if key in done:
            continue
        done.add(key)
        more = [(3, "I", i, r, (f"{w}:",)) for r, w in (("u", "user"), ("a", "assistant"))]
        if i < n:
            _, role, text = rows[i]
            more.append((4, "D", i + 1, "", ()))
            if faults[i] not in ("blank", "duplicate"):
                late = 3 * (faults[i] == "truncated")
                more.append((late, "K", i + 1, role[:1] or "-", (f"{role}:{text}",)))
                more += [(3 + late, "R", i + 1, r, (f"{w}:{text}",)) for r, w in (("u", "user"), ("a", "assistant"))]
        for c, edit, at, r, t in more:
            if re.fullmatch("s?(ua)*u?", roles + r):
                heapq.heappush(heap, (cost + c, audit + edit, at, roles + r, turns + t))


def told(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults = faults_of(rows)
    cost, audit, turns = cheapest(rows, faults)
    at = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (max(at) - min(at) + 1 - len(set(at)) if at else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())


def drawn(seed, n, longest):
    """Conversations of few roles and texts, so that faults, ties and repeats are frequent."""
    lot, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(lot.randrange(1, longest)):
            for _ in range(lot.choice([1, 1, 1, 2, 3])):
                rows.append((conv, lot.choice([turn, turn, turn, None]), lot.choice(["system", "user", "user", "assistant", "assistant", "tool", "Sam", "umpire", ""]), lot.choice(["One.", "Two!", "Three? ", "cut", "cut off ,", "", " \t", "é.", f"{turn}."])))
    return rows


COLUMNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("most", [10_000, 3])
def test_repairs_are_the_cheapest(spark, most):
    """Also in ranges of three rows, where every longer conversation is cut."""
    rows = drawn(7, 60, 9) + [(None, 1, "user", "Hm."), (None, 0, "user", "cut")]
    out = repair.repaired(spark.createDataFrame(rows, COLUMNS).repartition(5), Workspace(spark, "repair"), most=most)
    found = {r[0]: tuple(r)[1:] for r in out.conversations.collect()}
    by = {}
    for conv, *row in rows:
        by.setdefault(conv, []).append(row)
    assert found == {conv: told(of) for conv, of in by.items()}
    steps = {}
    for s in sorted(out.steps.collect(), key=lambda s: s.place):
        steps.setdefault(s.conv_id, []).append(s)
    for conv, of in steps.items():
        assert "".join(s.edits for s in of) == found[conv][6] and of[0].cost == found[conv][5]
        turns = [f"{role}:{(s.text if k == len(s.roles) and s.edits.rstrip('D')[-1:] in ('K', 'R') else '')}" for s in of for k, role in enumerate(s.roles, 1)]
        assert hashlib.sha256("\n".join(turns).encode()).hexdigest() == found[conv][7]


def test_copies_need_not_meet(spark):
    """A row repeated 3,000 times is one row with copies in a long conversation, and gives what it gives in a short one."""
    rows = spark.range(3000).select(F.lit(5).alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("Again.").alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(5, 1, "assistant", "Yes."), (5, 2, "user", "So?")], COLUMNS).select("conv_id", "turn", "role", "text"))
    short, long = (repair.repaired(rows, Workspace(spark, "copies"), most=m) for m in (10_000, 100))
    assert short.conversations.collect() == long.conversations.collect()
    assert long.steps.agg(F.max("copies")).first()[0] == 3000


def test_states_stay_few():
    t, lot = repair.Table(), random.Random(3)
    for _ in range(300):
        t.scan([lot.choice("sua-") + lot.choice("-tbd") for _ in range(50)], [1] * 50, t.end)
    assert len(t.vectors) < 100 and len(t.moves) < 100 * 16


def test_query_on_whole_table(spark, data):
    """Damage, faults, repair and digests of every conversation of the provided table, in plain Python."""
    rows = [tuple(r) for r in table(spark, data, "conversations").select("conv_id", "turn", "role", "text").collect()]
    kept = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in rows:
        lot = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        kept[conv] += [(turn, "user" if lot == 4 else role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    found = {r[0]: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, data).collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found == {conv: told(of) if of else nothing for conv, of in kept.items()}


def test_nulls_empty_tables_and_clashing_names(spark, tmp_path):
    none = spark.createDataFrame([], COLUMNS)
    out = repair.repaired(none, Workspace(spark, "none"))
    assert out.conversations.count() == 0 and out.steps.count() == 0
    rows = [(1, None, None, None), (1, None, None, None), (1, 0, "user", None), (2, 0, None, "x" * 200_000 + "."), (None, None, "assistant", "Yes.")]
    frame = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit(1) for c in ("piece", "_i", "copies", "place", "edits", "_long", "count")})
    for most in (10_000, 1):
        found = {r[0]: tuple(r)[1:] for r in repair.repaired(frame, Workspace(spark, "odd"), most=most).conversations.collect()}
        assert found == {k: told([(t, r or "", x or "") for c, t, r, x in rows if c == k]) for k in (1, 2, None)}
    for name, kept in (("all", frame), ("empty", frame.limit(0))):
        kept.write.parquet(f"{tmp_path}/{name}/conversations.parquet")
        found = queries.op11_conversation_repair(spark, f"{tmp_path}/{name}").collect()
        assert len(found) == (3 if name == "all" else 0)


def test_query_damages_nulls_as_spaces(spark):
    rows = spark.createDataFrame([(None, None, None, None), (3, None, None, "a.b!")], COLUMNS)
    found = {(r.role, r.text) for r in queries.damaged(rows).collect()}
    want = set()
    for said, role, text in ((" : ", " ", " "), ("3: ", " ", "a.b!")):
        lot = zlib.crc32(said.encode()) % 20
        if lot:
            want.add(("user" if lot == 4 else role, "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text))
    assert found == want
