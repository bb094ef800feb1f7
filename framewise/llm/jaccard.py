"""N-gram Jaccard join by prefix trees.

Sets are the distinct shingle hashes of a text, ordered by value everywhere. Texts with equal sets are one class. A set
can only be linked if most of its hashes occur in other sets, so sets with too many hashes of their own are set aside,
exactly, before anything is joined; of the smallest hashes, a set may have as many more of its own as its head is longer
than the shortest head of a set that it can be linked with. The rest meet by hashes of their prefixes: of two linked sets, each has among its
first n - ceil(t n) + 1 hashes one that both have. What meets is joined by a prefix tree over the whole sets: a node
holds a run of hashes that its sets share, a probe counts its overlap with the run once for all of them, and leaves a
subtree as soon as the remaining lengths can't reach the overlap that a link needs.

Two passes: the first compares each set with what shares one of its smallest hashes and gives components at little cost;
the second takes every prefix hash that lies in sets of different components, of the sets that can still have a link to
another component. A link between texts that are in one
component by other links need not be looked at again, so a group of near copies costs about as many comparisons as it
has members, and every component is still exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hashing
from .common import Workspace
from .components import connected_components


def needed(a: int, b: int, num: int, den: int) -> int:
    """Least intersection of sets of ``a`` and ``b`` with den * intersection >= num * union."""
    return -(-num * (a + b) // (num + den))


def head_length(n: int, num: int, den: int) -> int:
    """How many of its smallest hashes are the head of a set of ``n``: twice the prefix."""
    return min(n, 2 * (n - -(-num * n // den) + 1))


def allowed_own(num: int, den: int) -> tuple[Column, Column]:
    """Most hashes of a set of ``n`` that a set linked with it can lack, and most of its head that the other's head can.

    If the other's head ends later, its head lacks only what the other set lacks; if it ends first, the hashes of this
    head beyond its end are missing too, so the difference of the lengths is added. A partner has at least ceil(t n)
    hashes, and no larger one has a shorter head."""
    n, least = F.col("n"), lambda n: F.ceil(n * num / den - F.lit(1e-9)).cast("long")
    head = lambda n: F.least(n, 2 * (n - least(n) + 1))
    allowed = n - least(n)
    return allowed, allowed + head(n) - head(least(n))


class Node:
    """A run of hashes below its parent's; ``low`` and ``high`` are the sizes of the sets below."""

    __slots__ = ("below", "high", "low", "member", "run", "sets", "uniform")

    def __init__(self, run: np.ndarray, size: int, member: int):
        self.run, self.below, self.sets, self.low, self.high, self.member, self.uniform = run, {}, [], size, size, member, True


class PrefixTree:
    """Sets with a growing relation of components; ``links`` has the pairs that joined two of them."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.root, self.parent, self.links = num, den, None, {}, []

    def find(self, x: int) -> int:
        up = self.parent.setdefault(x, x)
        while up != x:
            self.parent[x] = self.parent[up]
            x, up = up, self.parent[up]
        return x

    def add(self, member: int, component: int, hashes: np.ndarray) -> None:
        """Links a set with those in the tree, then inserts it."""
        self.parent[self.find(member)] = self.find(-1 - component)
        if self.root is None:
            self.root = Node(hashes[:0], len(hashes), member)
        elif len(hashes):
            self.probe(member, hashes)
        self.insert(member, hashes)

    def probe(self, member: int, hashes: np.ndarray) -> None:
        n, stack = len(hashes), [(self.root, 0, 0, 0)]
        while stack:
            node, depth, at, shared = stack.pop()
            if node.uniform and self.find(node.member) == self.find(member):
                continue
            if node.high * self.den < n * self.num or n * self.den < node.low * self.num:
                continue
            if len(node.run):
                places = np.searchsorted(hashes, node.run)
                inside = places < n
                shared += int((hashes[places[inside]] == node.run[inside]).sum())
                depth, at = depth + len(node.run), int(np.searchsorted(hashes, node.run[-1], "right"))
            if shared + min(n - at, node.high - depth) < needed(n, node.low, self.num, self.den):
                continue
            for other, size in node.sets:
                if shared >= needed(n, size, self.num, self.den) and self.find(other) != self.find(member):
                    self.links.append((member, other))
                    self.parent[self.find(member)] = self.find(other)
            stack += [(x, depth, at, shared) for x in node.below.values()]

    def insert(self, member: int, hashes: np.ndarray) -> None:
        node, depth, n = self.root, 0, len(hashes)
        while True:
            run = node.run
            if len(run):
                part = hashes[depth : depth + len(run)]
                differ = np.flatnonzero(part != run[: len(part)])
                same = int(differ[0]) if len(differ) else len(part)
                if same < len(run):  # the run is cut: what follows moves below
                    rest = Node(run[same:], 0, node.member)
                    rest.below, rest.sets, rest.low, rest.high, rest.uniform = node.below, node.sets, node.low, node.high, node.uniform
                    node.run, node.below, node.sets = run[:same], {int(run[same]): rest}, []
                depth += same
            node.low, node.high = min(node.low, n), max(node.high, n)
            node.uniform = node.uniform and self.find(node.member) == self.find(member)
            if depth == n:
                node.sets.append((member, n))
                return
            down = node.below.get(int(hashes[depth]))
            if down is None:
                leaf = node.below[int(hashes[depth])] = Node(hashes[depth:], n, member)
                leaf.sets.append((member, n))
                return
            node = down


def normal(text: bytes) -> bytes:
    """The words of a text, one space between two."""
    return b" ".join(text.lower().split())


def _read_sets(k: int, num: int, den: int, whole: bool, seed: int):
    """Rows of texts to rows of sets; ``head`` has all hashes, or the smallest of twice the prefix. The signature is a
    cryptographic digest of the words in order."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, texts = [], hashing.encoded(batch["text"])
            for t, s in zip(texts, hashing.shingle_sets(texts, k, seed), strict=True):
                n = len(s)
                kept = n if whole else head_length(n, num, den)
                sign = np.frombuffer(blake2b(normal(t), digest_size=16).digest(), "<i8") if n and not whole else (0, 0)
                rows.append((n, int(sign[0]), int(sign[1]), s[:kept].tobytes()))
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=["n", "sig_a", "sig_b", "head"])], axis=1)

    return read


def shingles_of(text: bytes, k: int) -> set[tuple[bytes, ...]]:
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def _false_links(k: int, num: int, den: int):
    """Rows of linked texts to those that are not linked by their shingles as they are written."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, had = None, set()
        for batch in batches:
            out = []
            for a, b, s, t in zip(batch["a"], batch["b"], hashing.encoded(batch["text_a"]), hashing.encoded(batch["text_b"]), strict=True):
                if last != b:
                    last, had = b, shingles_of(t, k)
                mine = shingles_of(s, k)
                both = len(mine & had)
                if both * den < num * (len(mine) + len(had) - both):
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return read


def false_links(links: DataFrame, docs: DataFrame, work: Workspace, k: int, num: int, den: int, block: int, few: int) -> DataFrame:
    """The links (a, b) that the shingles of the texts do not bear out. A text with many links is sent to as many places
    as its links fill blocks."""
    ids = links.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.join(F.broadcast(ids) if links.count() <= few else ids.hint("merge"), "doc_id", "left_semi")
    texts = work.stage(texts, "linked")
    parts = links.groupBy("b").agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
    there = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")).join(parts, "b").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).drop("k")
    here = links.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("k")).cast("int").alias("part"))
    here = here.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return here.join(there, ["b", "part"]).select("a", "b", "text_a", "text_b").mapInPandas(_false_links(k, num, den), "a long, b long")


def _spread(rows: pd.DataFrame, parts: list[np.ndarray], limit: int = 1 << 17) -> Iterator[pd.DataFrame]:
    """Each row again for each of its hashes, in frames of about ``limit`` rows: a batch of long texts has millions."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    frame = (np.cumsum(sizes) - sizes) // limit
    for k in np.unique(frame).tolist():
        some = np.flatnonzero(frame == k)
        yield rows.iloc[np.repeat(some, sizes[some])].reset_index(drop=True).assign(hash=np.concatenate([parts[i] for i in some]))


def _prefixes(num: int, den: int, take: Callable[[int, int], int]):
    """Rows of sets to a row for each of their first hashes: ``take`` says how many, from the size and the prefix."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [np.frombuffer(s, np.int64)[: take(n, n - -(-num * n // den) + 1)] for n, s in zip(batch["n"], batch["set"], strict=True)]
            yield from _spread(batch[["doc_id", "component", "n"]], parts)

    return read


def _heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield from _spread(batch[["doc_id"]], [np.frombuffer(s, np.int64) for s in batch["head"]])


def _join_groups(num: int, den: int):
    """Rows sorted by (leader, block) to the links of each such group; a group is bounded by its block."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tree = None, None
        for batch in batches:
            links = []
            for h, b, doc, comp, s in zip(batch["leader"], batch["block"], batch["doc_id"], batch["component"], batch["set"], strict=True):
                if (h, b) != key:
                    links += tree.links if tree else []
                    key, tree = (h, b), PrefixTree(num, den)
                tree.add(int(doc), int(comp), np.frombuffer(s, np.uint64))
            links += tree.links if tree else []
            if tree:
                tree.links = []
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return join


def _smallest(sets: DataFrame, parts: DataFrame, num: int, den: int) -> DataFrame:
    """(hash, doc_id, component) of the two smallest hashes of every set."""
    return sets.join(parts, "doc_id").select("doc_id", "component", "n", "set").mapInPandas(_prefixes(num, den, lambda n, p: 2), "doc_id long, component long, n long, hash long").select("hash", "doc_id", "component")


def _still_open(sets: DataFrame, parts: DataFrame, work: Workspace, num: int, den: int) -> DataFrame:
    """(hash, doc_id, component) of the prefixes that a link between components can still come from.

    A set can have such a link only if at most n - ceil(t n) of its hashes lie in no set of another component: asked first
    of the heads, with what their lengths differ by, then of all hashes. The prefixes are taken with the rarest hashes first, so they
    hold what is a set's own, which needs no looking up, and few others."""
    own = F.count("*") - F.count("c")
    allowed, in_head = allowed_own(num, den)
    for whole in (False, True):
        take = (lambda n, p: n) if whole else (lambda n, p: 2 * p)
        rows = sets.join(parts, "doc_id").select("doc_id", "component", "n", "set").mapInPandas(_prefixes(num, den, take), "doc_id long, component long, n long, hash long")
        rows = work.stage(rows, "hashes", "none")
        shared = rows.groupBy("hash").agg(F.count("*").alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("hash", "c")
        told = rows.join(shared, "hash", "left")
        if not whole:
            ids = told.groupBy("doc_id", "n").agg(own.alias("own")).where(F.col("own") <= in_head).select("doc_id")
            sets = work.stage(sets.join(ids, "doc_id", "left_semi"), "open", "none")
            work.drop(rows)
    by = Window.partitionBy("doc_id").orderBy(F.col("c").asc_nulls_first(), "hash")
    first = told.withColumn("i", F.row_number().over(by)).where((F.col("i") <= allowed + 1) & F.col("c").isNotNull())
    return first.select("hash", "doc_id", "component")


def _links(light: DataFrame, sets: DataFrame, work: Workspace, first: bool, num: int, den: int, block: int) -> DataFrame:
    """Links (a, b) between sets that share a hash of ``light(hash, doc_id, component)``.

    Hashes whose sets are all in one component are left out. The groups of hashes with the same smallest member are one
    group, as copies share many hashes, so that a set travels to few groups. A large group is dealt to every pair of its
    blocks; ``first``: only its smallest member to every block."""
    light = work.stage(light, "prefixes", "none")
    groups = light.groupBy("hash").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("doc_id").alias("leader")).where("lo < hi")
    met = work.stage(light.join(groups.select("hash", "leader"), "hash").select("leader", "doc_id").distinct(), "met", "none")
    placed = met.join(met.groupBy("leader").agg(F.ceil(F.count("*") / block).cast("int").alias("k")), "leader")
    own = F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int")
    every = F.sequence(F.lit(0), F.col("k") - 1)
    if first:
        to = F.when(F.col("doc_id") == F.col("leader"), every).otherwise(F.array(own))
    else:
        to = F.transform(every, lambda j: F.least(own, j) * F.col("k") + F.greatest(own, j))
    placed = placed.select("leader", "doc_id", F.explode(to).alias("block"))
    full = placed.join(sets, "doc_id").select("leader", "block", "doc_id", "component", "n", "set")
    full = full.repartition("leader", "block").sortWithinPartitions("leader", "block", "n", "doc_id").drop("n")
    return full.mapInPandas(_join_groups(num, den), "a long, b long").distinct()


def join_components(documents: DataFrame, work: Workspace, k: int = 3, num: int = 90, den: int = 100, block: int = 512, few: int = 2_000_000, tries: int = 3) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) for every row of ``documents(doc_id, text)`` with a doc_id.

    A text's set is its distinct ``k``-word shingles (words without ASCII white space, A-Z lower-cased); with fewer words
    the whole sequence is one; a null, empty or blank text has the empty set, is linked with nothing and is a class and
    component of its own. Two texts are linked if den * intersection >= num * union. ``class_id`` is the smallest
    doc_id with the same words in the same order, ``component_id`` the smallest one reachable by links. Rows that share a
    doc_id are one document, of the smallest of their texts; a null doc_id is left out; other columns are ignored; an empty table
    gives no rows.

    Shingles are compared by 64-bit hashes; then every link is held against the shingles themselves, and if one is not
    borne out, all is done again with another seed, up to ``tries`` times, then it is an error. What the hashes can still
    do is to count two shingles of one text as one, at a chance of n * n / 2 ** 65.

    The texts of sets that may be linked are read again: up to ``few`` of them by broadcasting their ids, else by a
    shuffle. Groups that share a hash are joined in blocks of about ``block`` sets, so no task holds an unbounded group.
    """
    docs = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    often = work.stage(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"), "often")
    if not often.isEmpty():
        often = F.broadcast(often) if often.count() <= few else often.hint("merge")
        one = docs.join(often, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
        docs = docs.join(often, "doc_id", "left_anti").unionByName(one)
    for seed in range(tries):
        found, links = _components(docs, work, k, num, den, block, few, seed)
        if links is None or false_links(links, docs, work, k, num, den, block, few).isEmpty():
            return found
    raise RuntimeError("links of shingle hashes are not borne out by the shingles")


def _components(docs: DataFrame, work: Workspace, k: int, num: int, den: int, block: int, few: int, seed: int) -> tuple[DataFrame, DataFrame | None]:
    """The result of ``join_components`` by hashes of one seed, and the links that made its components."""
    began, schema = len(work.staged), "doc_id long, n long, sig_a long, sig_b long, head binary"
    heads = work.stage(docs.mapInPandas(_read_sets(k, num, den, False, seed), schema), "heads", "none")
    same = ["n", "sig_a", "sig_b"]
    keys = work.stage(heads.select("doc_id", *same), "keys")
    classes = work.stage(keys.where("n > 0").groupBy(*same).agg(F.min("doc_id").alias("class_id")), "classes")
    _, in_head = allowed_own(num, den)

    # sets with more hashes of their own than a link allows are set aside; twice, as their partners go too
    live = heads.where("n > 0").join(classes.select("class_id"), F.col("doc_id") == F.col("class_id"), "left_semi").select("doc_id", "n", "head")
    for _ in range(2):
        posted = live.select("doc_id", "head").mapInPandas(_heads, "doc_id long, hash long")
        own = posted.groupBy("hash").agg(F.count("*").alias("c"), F.min("doc_id").alias("doc_id")).where("c = 1").groupBy("doc_id").agg(F.count("*").alias("own"))
        live = work.stage(live.join(own, "doc_id", "left").where(F.coalesce("own", F.lit(0)) <= in_head).select("doc_id", "n", "head"), "live", "none")
    work.drop(heads)
    ids = live.select("doc_id")
    sets = docs.join(F.broadcast(ids) if ids.count() <= few else ids.hint("merge"), "doc_id", "left_semi").mapInPandas(_read_sets(k, num, den, True, seed), schema)
    sets = work.stage(sets.select("doc_id", "n", F.col("head").alias("set")), "sets", "none")
    work.drop(live)

    parts = sets.select("doc_id", F.col("doc_id").alias("component"))
    links = work.stage(_links(_smallest(sets, parts, num, den), sets.join(parts, "doc_id"), work, True, num, den, block), "links")
    parts = work.stage(sets.select("doc_id").join(connected_components(links, work), F.col("node") == F.col("doc_id"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("component")), "parts")
    more = work.stage(_links(_still_open(sets, parts, work, num, den), sets.join(parts, "doc_id"), work, False, num, den, block), "links")
    told = [links, more]
    if not more.isEmpty():
        links = links.unionByName(more)
        parts = work.stage(sets.select("doc_id").join(connected_components(links, work), F.col("node") == F.col("doc_id"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("component")), "parts")
    # what follows reads no sets or hashes, so their room is free for the texts that are looked at again
    work.keep_only(keys, classes, parts, *told, since=began)
    # a class has the component of its smallest document
    classes = classes.join(parts.withColumnRenamed("doc_id", "class_id"), "class_id", "left").select(*same, "class_id", F.coalesce("component", "class_id").alias("component_id"))
    out = keys.join(classes, same, "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out, None if links.isEmpty() else links
