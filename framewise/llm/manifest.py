"""A Merkle manifest of a table: a tree a group, a tree over the groups' roots, and a proof for each row.

Nodes are lowercase hex SHA-256 digests; a parent is the digest of up to sixteen consecutive nodes put together as text.
The last run of a level may be short, even one node; it is hashed as it is, nothing is padded.

Rows get their place in their group by ranges (``numbered``), so a group of any size is spread over many tasks. Each task
then reads its rows in order with a stack of levels, like a range of mountains (``peaks``): sixteen nodes whose first has a
place that sixteen divides carry into one node of the level above. What a task holds is at most fifteen nodes a level. Runs
that lie across tasks, and short ones at a group's end, come out as loose nodes and are put together level by level in Spark
(``raised``). ``paths`` then goes down from the root and gives every node its way up, a run at a time.

Repeated rows each have their own leaf and place. Null groups are a group, the first. Rows without an id come first in their
group; rows of equal id go by their leaves. An empty table has no groups, roots or proofs. Further columns of the leaves are
kept; one that is called like a column of the operator's own (``OWN``) is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

#: Nodes a parent has.
BASE = 16
OWN = ("grp", "at", "level", "path", "subroot", "root", "_own", "_i", "_piece", "_from", "_n", "_by", "_p", "_g", "_shift", "_start", "_up")
NODE = "grp long, level int, at long, digest string, loose boolean"
STEP = "array<struct<before: string, after: string>>"


def field(value: Column) -> Column:
    """A value as a leaf holds it: ``-`` for null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def height(n: int) -> int:
    """Levels above ``n`` nodes until there is one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // BASE), levels + 1
    return levels


def heights(n: Column, most: int) -> Column:
    """``height`` as a column, for numbers that have at most ``most`` levels."""
    out = F.lit(0)
    for level in range(most):
        out = F.when(n > BASE**level, level + 1).otherwise(out)
    return out


def numbered(rows: DataFrame, by: str, order: list[str], work: Workspace, few: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``grp``, the number of their group in the order of ``by``, and ``at``, their place in it by ``order``;
    and the groups: (grp, ``by``, n). Rows are dealt by ranges of group, order and a number of their own, so not even equal
    rows must meet in one task. The counts of ranges and groups are broadcast up to ``few`` of them, then joined by a
    shuffle."""
    own = work.stage(rows.withColumn("_own", F.monotonically_increasing_id()), "own")
    cut = own.repartitionByRange(by, *order, "_own").sortWithinPartitions(by, *order, "_own")
    cut = work.stage(cut.drop("_own").withColumn("_i", F.monotonically_increasing_id()).withColumn("_piece", F.shiftright("_i", 33)), "ranges")
    work.drop(own)
    counts = work.stage(cut.groupBy(by, "_piece").agg(F.min("_i").alias("_from"), F.count("*").alias("_n")), "counts")
    # groups lie in order over the ranges, so a group's number is the number of groups that begin before it: those of
    # earlier ranges, summed one row a range, and those before it in its own
    starts = counts.groupBy(by).agg(F.min(F.struct("_piece", "_from")).alias("_start"), F.sum("_n").alias("n"))
    begun = starts.groupBy(F.col("_start._piece").alias("_piece")).count()
    earlier = begun.select("_piece", (F.sum("count").over(Window.orderBy("_piece")) - F.col("count")).alias("_earlier"))
    groups = starts.withColumn("_piece", F.col("_start._piece")).join(F.broadcast(earlier), "_piece")
    groups = groups.withColumn("grp", F.col("_earlier") + F.row_number().over(Window.partitionBy("_piece").orderBy("_start._from")) - 1)
    groups = work.stage(groups.select("grp", by, "n"), "groups")
    gone = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select(F.col(by).alias("_by"), F.col("_piece").alias("_p"), (F.col("_from") - gone).alias("_shift"))
    placed = placed.join(groups.select("grp", F.col(by).alias("_g")), F.col("_by").eqNullSafe(F.col("_g"))).drop("_g")
    placed = work.stage(placed, "placed")
    same = F.col(by).eqNullSafe(F.col("_by")) & (F.col("_piece") == F.col("_p"))
    if placed.count() <= few:
        out = cut.join(F.broadcast(placed), same)
    else:
        out = cut.join(placed.hint("merge"), same).sortWithinPartitions("_i")
    return out.select("grp", (F.col("_i") - F.col("_shift")).alias("at"), *rows.columns), groups


class Range:
    """The nodes of one group that a task has read and not yet carried up: a list a level, of consecutive places."""

    def __init__(self, group: int):
        self.group, self.levels, self.out = group, [], []

    def add(self, at: int, digest: str) -> None:
        level = 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            held = self.levels[level]
            held.append((at, digest))
            if level:
                self.out.append((self.group, level, at, digest, False))
            if at % BASE < BASE - 1:
                return
            if len(held) < BASE:  # the run began in another task
                self.let_go(level)
                return
            digest = hashlib.sha256("".join(d for _, d in held).encode()).hexdigest()
            held.clear()
            at, level = at // BASE, level + 1

    def let_go(self, level: int) -> None:
        self.out += [(self.group, level, at, digest, True) for at, digest in self.levels[level]]
        self.levels[level].clear()

    def end(self) -> None:
        for level in range(len(self.levels)):
            self.let_go(level)


def peaks(leaves: DataFrame) -> DataFrame:
    """(grp, level, at, digest, loose) of ``leaves(grp, at, digest)`` in order of (grp, at): nodes from level one on that
    are whole within a task, and, as loose ones, those of all levels whose run isn't. Where the order breaks, a new range
    begins: that makes more loose nodes, not other ones."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, due = None, -1
        schema = pa.schema([("grp", pa.int64()), ("level", pa.int32()), ("at", pa.int64()), ("digest", pa.string()), ("loose", pa.bool_())])

        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 5, schema, strict=True)], schema=schema)

        for batch in batches:
            out = []
            for group, at, digest in zip(*[batch.column(c).to_pylist() for c in ("grp", "at", "digest")], strict=True):
                if now is None or group != now.group or at != due:
                    if now:
                        now.end()
                        out += now.out
                    now = Range(group)
                now.add(at, digest)
                due = at + 1
            if now:
                out += now.out
                now.out.clear()
            yield told(out)
        if now:
            now.end()
            yield told(now.out)

    return leaves.select("grp", "at", "digest").mapInArrow(read, NODE)


def runs(nodes: DataFrame, *more: str) -> DataFrame:
    """(grp, run, nodes): the up to sixteen nodes of each run in order, with their place and digest and ``more``."""
    return nodes.groupBy("grp", F.shiftright("at", 4).alias("run")).agg(F.array_sort(F.collect_list(F.struct("at", "digest", *more))).alias("nodes"))


def raised(found: DataFrame, groups: DataFrame, top: int, work: Workspace) -> DataFrame:
    """All nodes above the leaves, (grp, level, at, digest), of what ``peaks`` found; ``groups`` has n and height."""
    tall = groups.select("grp", "height")
    loose = found.where("loose")
    whole = [found.where("not loose").select("grp", "level", "at", "digest")]
    carried = None
    for level in range(top):
        below = loose.where(F.col("level") == level).select("grp", "at", "digest")
        below = below if carried is None else below.unionByName(carried.select("grp", "at", "digest"))
        below = below.join(tall, "grp").where(F.col("height") > level)  # a root has nothing above
        carried = runs(below).select("grp", F.lit(level + 1).alias("level"), F.col("run").alias("at"), F.sha2(F.array_join("nodes.digest", ""), 256).alias("digest"))
        carried = work.stage(carried, f"level-{level + 1}")
        whole.append(carried)
    out = whole[0]
    for more in whole[1:]:
        out = out.unionByName(more)
    return out


def steps(nodes: str, name: str) -> Column:
    """The nodes of a run, each with the digests before and after it."""
    digests = F.col(f"{nodes}.digest")
    before = lambda i: F.array_join(F.slice(digests, F.lit(1), i), "")
    after = lambda i: F.array_join(F.slice(digests, i + 2, F.size(digests)), "")
    return F.transform(nodes, lambda x, i: F.struct(x.alias("node"), F.struct(before(i).alias("before"), after(i).alias("after")).alias("step"))).alias(name)


def paths(nodes: DataFrame, groups: DataFrame, top: int, work: Workspace) -> DataFrame:
    """(grp, level, at, path) of the nodes from level one on; ``path`` has a step for each level from the node's own up to
    the root. A group of one leaf has none."""
    tall = groups.select("grp", "height")
    above, out = None, None
    for level in range(top, 0, -1):
        roots = tall.where(F.col("height") == level).select("grp", F.lit(0).cast("long").alias("at"), F.array().cast(STEP).alias("path"))
        if above is not None:
            here = runs(nodes.where(F.col("level") == level)).join(above.select("grp", F.col("at").alias("run"), "path"), ["grp", "run"])
            here = here.select("grp", "path", F.explode(steps("nodes", "each")).alias("each"))
            roots = roots.unionByName(here.select("grp", F.col("each.node.at").alias("at"), F.concat(F.array("each.step"), "path").alias("path")))
        above = work.stage(roots, f"paths-{level}")
    return above


@dataclass(frozen=True)
class Tree:
    """``leaves(grp, at, digest, ...)`` as given, ``groups(grp, <by>, n, height, root)``, ``nodes(grp, level, at, digest)``
    above the leaves, and ``proofs``: the leaves with ``path``, a step a level up to the group's root."""

    groups: DataFrame
    nodes: DataFrame
    proofs: DataFrame


def tree(leaves: DataFrame, groups: DataFrame, work: Workspace) -> Tree:
    more = [c for c in leaves.columns if c not in ("grp", "at", "digest")]
    most = groups.agg(F.max("n")).first()[0] or 0
    top = height(most)
    groups = groups.withColumn("height", heights(F.col("n"), top))
    found = work.stage(peaks(leaves), "peaks")
    nodes = work.stage(raised(found, groups, top, work), "nodes")
    roots = nodes.join(groups.select("grp", "height"), "grp").where(F.col("level") == F.col("height")).select("grp", F.col("digest").alias("root"))
    lone = leaves.join(groups.where("height = 0").select("grp"), "grp").select("grp", F.col("digest").alias("root"))
    groups = work.stage(groups.join(roots.unionByName(lone), "grp"), "roots")
    one = groups.where("height = 0").select("grp", F.lit(0).cast("long").alias("run"), F.lit(None).cast(STEP).alias("path"))
    above = paths(nodes, groups, top, work)
    above = one if above is None else one.unionByName(above.select("grp", F.col("at").alias("run"), "path"))
    each = runs(leaves, *more).join(above, ["grp", "run"]).select("grp", "path", F.explode(steps("nodes", "each")).alias("each"))
    path = F.when(F.col("path").isNull(), F.array().cast(STEP)).otherwise(F.concat(F.array("each.step"), "path"))
    return Tree(groups, nodes, each.select("grp", "each.node.*", path.alias("path")))


def proof(path: Column) -> Column:
    """The digest of all siblings on a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings make."""
    return F.aggregate(path, digest, lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]), 256))


@dataclass(frozen=True)
class Manifest:
    """``sources``: the tree of the groups' rows; ``whole``: the tree of their roots; ``proofs(<columns of the leaves>,
    digest, subroot, root, path)``."""

    sources: Tree
    whole: Tree
    proofs: DataFrame


def manifest(leaves: DataFrame, by: str, order: list[str], work: Workspace, few: int = 500_000) -> Manifest:
    """The manifest of ``leaves(<by>, <order>, digest, ...)``. Paths of groups go to the rows by a broadcast up to ``few``
    groups, else by a shuffle."""
    if clash := {c.lower() for c in leaves.columns} & {*OWN}:
        raise ValueError(f"columns {sorted(clash)} are the manifest's own")
    placed, groups = numbered(leaves, by, [*order, "digest"], work)
    sources = tree(work.stage(placed.drop(by), "placed-leaves"), groups, work)
    tops = sources.groups.select(F.lit(0).alias("_all"), "grp", F.col("root").alias("digest"))
    placed_tops, all_groups = numbered(tops.withColumnRenamed("grp", "source_grp"), "_all", ["source_grp"], work)
    whole = tree(work.stage(placed_tops.drop("_all"), "placed-roots"), all_groups, work)
    upper = whole.proofs.join(F.broadcast(whole.groups.select("grp", "root")), "grp").select(F.col("source_grp").alias("grp"), F.col("digest").alias("subroot"), "root", F.col("path").alias("_up"))
    upper = work.stage(upper, "upper")
    upper = F.broadcast(upper) if groups.count() <= few // 100 else upper.hint("merge")
    return Manifest(sources, whole, sources.proofs.join(upper, "grp").withColumn("path", F.concat("path", "_up")).drop("grp", "_up", "at"))
