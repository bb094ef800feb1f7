"""The Merkle manifest against a tree in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from framewise.llm import manifest, queries
from framewise.llm.common import Workspace, table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def way_up(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 16 * 16
        out.append((level[a:i], level[i + 1 : a + 16]))
        i //= 16
    return out


def told(rows):
    """What the query returns of (doc_id, source, lang, n_chars, text), sorted."""
    by, out = {}, []
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    order = lambda r: (r[0] is not None, r[0] or 0, leaf(*r))
    trees = [levels_of([leaf(*r) for r in sorted(by[s], key=order)]) for s in names]
    top = levels_of([t[-1][0] for t in trees])
    for k, s in enumerate(names):
        for i, r in enumerate(sorted(by[s], key=order)):
            path = way_up(trees[k], i) + way_up(top, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            node = leaf(*r[:4], r[4].translate(LOWER) if hit else r[4])
            for before, after in path:
                node = h("".join([*before, node, *after]))
            out.append((r[0], leaf(*r), trees[k][-1][0], top[-1][0], h("".join("".join(b + a) for b, a in path)), node, node == top[-1][0]))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def found(spark, path):
    return sorted((tuple(r) for r in queries.op12_merkle_manifest(spark, path).collect()), key=str)


def test_query_on_whole_table(spark, data):
    assert found(spark, data) == told([tuple(r) for r in table(spark, data, "documents").select(*COLUMNS).collect()])


@pytest.mark.parametrize("n", [1, 17, 700])
def test_sizes_and_edges(spark, tmp_path, n):
    """One source and many, nulls anywhere, equal rows, shared ids, more files than runs; further columns with any name."""
    lot = random.Random(n)
    pick = lambda *x: lot.choice(x)
    rows = [(pick(i, i, i, None, 3), pick("one", "one", None, "é", "Z", "", f"s{i}") if n > 2 else "one", pick("en", None), pick(5, None), pick(f"Text {i}", "Same", None, "", "É Ü a" * 50)) for i in range(n)]
    rows += rows[:3]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    frame.withColumns({c: F.lit("x") for c in ("grp", "at", "digest", "path", "root", "_i")}).write.parquet(f"{tmp_path}/documents.parquet")
    assert found(spark, str(tmp_path)) == told(rows)


def test_empty_table_and_own_names(spark, tmp_path):
    frame = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    assert found(spark, str(tmp_path)) == []
    with pytest.raises(ValueError, match="own"):
        manifest.manifest(frame.select("doc_id", "source", F.lit("x").alias("digest"), F.lit(1).alias("grp")), "source", ["doc_id"], Workspace(spark, "clash"))


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_ranges_make_the_same_nodes(spark, parts):
    """However many ranges there are and where they begin, also in a wrong order."""
    n = 600
    leaves = spark.range(n).select(F.lit(0).cast("long").alias("grp"), F.col("id").alias("at"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    groups = spark.createDataFrame([(0, "x", n)], "grp long, source string, n long")
    for frame in (leaves.repartitionByRange(parts, "at").sortWithinPartitions("at"), leaves.repartitionByRange(parts, "at").sortWithinPartitions(F.desc("at"))):
        made = manifest.tree(frame, groups, Workspace(spark, "ranges"))
        want = {(level, at): d for level, nodes in enumerate(levels_of([h(str(i)) for i in range(n)])) for at, d in enumerate(nodes) if level}
        nodes = made.nodes.collect()
        assert {(r.level, r.at): r.digest for r in nodes} == want and len(nodes) == len(want)


def test_few_or_many_places_joined_alike(spark):
    rows = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 7).alias("source"), F.sha2(F.col("id").cast("string"), 256).alias("digest")).repartition(9)
    got = [sorted(r.root + r.subroot + str(r.path) for r in manifest.manifest(rows, "source", ["doc_id"], Workspace(spark, "few"), few=f).proofs.collect()) for f in (500_000, 0)]
    assert got[0] == got[1] and len(got[0]) == 300
