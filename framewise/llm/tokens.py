"""Token ids in a content-addressed store.

A rolling hash over the ids of a document cuts them into chunks, so equal passages make equal chunks; a chunk is named by
its digest and stored once, with the first document (by doc_id) that has it. Files, all Parquet:

``store``     a row for each document, in ascending doc_id: digests of its chunks in order, the chunks that it is first to have (compressed
              ids, little-endian, 16 bits for vocabularies of up to 65,536 ids, else 32), which of its chunks are
              borrowed from earlier documents and which are lent to later ones
``recipes``   in ascending doc_id: start among all ids, number of ids, Merkle root of the chunk digests
``manifest``  a Merkle tree over the recipes in order: nodes of 1,024 recipes or nodes of the level below, up to one
              corpus root

Reading rebuilds every document, borrowed chunks included, and checks each chunk against its digest, each document
against the number, place, size and root that its recipe has, and the recipes against the whole tree. A row that is
missing, added or altered in any of the files is an error.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing
from .common import Workspace

DIGEST = 16
#: Words that the normaliser and the splitter of a lower-casing byte-level vocabulary take letter by letter, and signs
#: that stay together behind them.
WORD, SIGNS = "[A-Za-zÀ-ÖØ-öø-ÿ]*", r"[!-&(-/:-@\[-`{-~]*"
ONE = re.compile(f"{WORD[:-1]}+|{SIGNS[:-1]}+")
PARTS = f"^(?P<word>{WORD})(?P<signs>{SIGNS})$"
STORED = "row long, doc_id long, n_tokens long, ids_crc32 long, m int, root binary, digests binary, lengths binary, payload binary"


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    while len(leaves) > 1:
        leaves = [digest(b"".join(leaves[i : i + 2])) for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else digest(b"")


class WordEncoder:
    """Ids of texts, word by word: white space parts the words of these vocabularies, so a word's ids can be kept.

    ``most`` bounds what is kept. All that is not known goes through the tokenizer, so ids are those of ``encode(text,
    add_special_tokens=False)``: such a string is that token, as the library reads it.
    """

    def __init__(self, path: str, most: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(ONE.fullmatch(x) or any(c.isspace() for c in x) for x in self.special):
            raise ValueError("a special token that is a word, or has white space, can't be found word by word")
        self.model = self.tokenizer.model
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = np.dtype("u4" if self.wide else "u2")  # little-endian machines
        self.known: dict[str, bytes] = {}
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in visible]
        self.letters = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def learn(self, piece: str) -> bytes:
        """Ids of a piece. One of letters or of signs alone is a single word to the splitter and goes to the model at once,
        its bytes shown as the letters that the vocabulary has for them; any other goes through the whole tokenizer."""
        if ONE.fullmatch(piece):
            shown = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
            ids = array(self.kind.char, [t.id for t in self.model.tokenize(shown)]).tobytes()
        else:
            ids = np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, self.kind).tobytes()
        self.known[piece] = ids
        return ids

    def parts(self, pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Pieces between white space as a word in lower case and the signs behind it, one of which may be empty; a piece
        that is not made so stays whole."""
        split = pc.extract_regex(pieces, PARTS)
        word, signs = pc.utf8_lower(split.field("word")), split.field("signs")
        plain = split.is_valid()
        return pc.if_else(plain, word, pieces), pc.if_else(plain, signs, "")

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, ``end_id`` behind each, and where each text's begin (one more entry at the end).
        Arrow finds the different words, so Python sees each of them once."""
        if len(self.known) > self.most:
            self.known.clear()
        pieces = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = pieces.flatten().dictionary_encode()
        halves = [x.dictionary_encode() for x in self.parts(coded.dictionary)]
        get, learn, found, shift, refs = self.known.get, self.learn, [], 0, []
        for half in halves:
            found += [get(p) or (learn(p) if p else b"") for p in half.dictionary.to_pylist()]
            refs.append(half.indices.to_numpy() + shift)
            shift = len(found)
        flat = np.frombuffer(b"".join(found), self.kind)
        length = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        begin = np.cumsum(length) - length
        at = np.stack(refs, axis=1)[coded.indices.to_numpy()].ravel()
        size = length[at]
        some = np.flatnonzero(size)
        at, size = at[some], size[some]
        stop = np.cumsum(size)
        ids = flat[np.repeat(begin[at] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
        # where the pieces of each text end, in ids
        ends = np.concatenate([[0], stop])
        offsets = 2 * (pieces.offsets.to_numpy() - pieces.offsets[0].as_py())
        bounds = ends[np.searchsorted(some, offsets)]
        return np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))


@lru_cache(maxsize=1)
def encoder_of(path: str) -> WordEncoder:
    """One encoder a Python worker: the tasks after its first find the words that it knows."""
    return WordEncoder(path)


def marks(ids: np.ndarray, bits: int) -> np.ndarray:
    """Places behind which a hash of the last four ids has ``bits`` zeros; the first three ids of all have fewer before."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = x.copy()
    for j, factor in enumerate((0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93), 1):
        h[j:] ^= x[:-j] * np.uint64(factor)
    return np.flatnonzero(hashing.mix(h) >> np.uint64(64 - bits) == 0) + 1


def cuts(marked: list[int], n: int, least: int, most: int) -> list[int]:
    """Ends of the chunks of ``n`` ids: at marks, with ``least`` to ``most`` ids each; the last may be shorter."""
    ends, last = [], 0
    for mark in [*marked, n]:
        while mark - last > most:
            last += most
            ends.append(last)
        if mark - last >= least or (mark == n and mark > last):
            ends.append(mark)
            last = mark
    return ends


def _blocks(texts: pa.Array, limit: int = 1 << 21) -> Iterator[pa.Array]:
    """Texts in stretches of about ``limit`` bytes."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
        yield texts.slice(at, to - at)
        at = to


def _encode(path: str, end_id: int, bits: int, least: int, most: int) -> Callable:
    if least < 4:
        raise ValueError("chunks of under four ids would depend on the document before")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = encoder_of(path), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            rows = []
            for texts in _blocks(batch.column("text")):
                ids, bounds = encoder.encode(texts, end_id)
                raw, wide, unit = ids.tobytes(), memoryview(ids.astype("<u4").tobytes()), encoder.kind.itemsize
                marked = marks(ids, bits)
                near = np.searchsorted(marked, bounds, "right").tolist()
                for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    at, digests, payloads = a, [], []
                    inside = (marked[near[k] : near[k + 1]] - a).tolist() if near[k] < near[k + 1] else []
                    for stop in cuts(inside, b - a, least, most):
                        part = raw[at * unit : (a + stop) * unit]
                        digests.append(digest(part))
                        payloads.append(packer.compress(part))
                        at = a + stop
                    lengths = np.fromiter(map(len, payloads), "<i4", len(payloads)).tobytes()
                    rows.append((b - a, zlib.crc32(wide[4 * a : 4 * b]), len(digests), merkle(digests), b"".join(digests), lengths, b"".join(payloads)))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *columns], [f.split(" ")[0] for f in STORED.split(", ")])
        pa.default_memory_pool().release_unused()  # the worker lives on

    return read


def _pieces(row: dict) -> dict[int, bytes]:
    """The compressed chunks that a row of the store holds, by their place in the document."""
    lengths, away, at, found = np.frombuffer(row["lengths"], "<i4"), set(row.get("borrowed") or ()), 0, {}
    for i, n in enumerate(lengths.tolist()):
        if i not in away:
            found[i] = row["payload"][at : at + n]
            at += n
    return found


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops the chunks that a document borrows."""
    for batch in batches:
        borrowed, payload = batch.column("borrowed"), batch.column("payload")
        if borrowed.null_count < len(batch):
            names = ("lengths", "payload")
            kept = []
            for i in range(len(batch)):
                away = borrowed[i].as_py()
                row = {n: batch.column(n)[i].as_py() for n in names}
                kept.append(b"".join(p for j, p in _pieces(row).items() if j not in set(away)) if away else row["payload"])
            payload = pa.array(kept, pa.binary())
        yield batch.set_column(batch.schema.get_field_index("payload"), "payload", payload)


def _chunks(which: str) -> Callable:
    """Rows of the store to a row for each chunk that they hold; ``lent``: only those that others borrow."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                wanted = set(row["lent"] or ()) if which == "lent" else None
                out += [(row["row"], i, row["digests"][i * DIGEST : (i + 1) * DIGEST], p) for i, p in _pieces(row).items() if wanted is None or i in wanted]
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["row", "i", "digest", "payload"])

    return read


def _rebuild(wide: bool) -> Callable:
    """Documents to number, checksum and root of their ids, from their chunks; chunks that don't agree are an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                pieces = [p["payload"] for p in row["pieces"]] if "pieces" in row else list(_pieces(row).values())
                parts = [opener.decompress(p) for p in pieces]
                told = [digest(p) for p in parts]
                if b"".join(told) != row["digests"]:
                    raise ValueError(f"document {row['doc_id']} can't be rebuilt from its chunks")
                ids = np.frombuffer(b"".join(parts), "<u4" if wide else "<u2")
                rows.append((row["row"], row["doc_id"], len(ids), zlib.crc32(ids.astype("<u4").tobytes()), merkle(told)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["row", "doc_id", "n_tokens", "ids_crc32", "root"])

    return read


def _each_digest(df: DataFrame, *others: str) -> DataFrame:
    i = F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i")
    return df.where("m > 0").select("row", *others, "digests", i).select("row", *others, "i", F.substring("digests", F.col("i") * DIGEST + 1, F.lit(DIGEST)).alias("digest"))


def running_start(sizes: DataFrame, order: list[str], size: str, work: Workspace) -> DataFrame:
    """Adds start, the sum of ``size`` over all rows before in ascending ``order``, and place, their number.
    Ranges are summed apart; only two numbers for each range are brought together."""
    dealt = work.stage(sizes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "dealt")
    sums = {r["part"]: (r["s"], r["n"]) for r in dealt.groupBy("part").agg(F.sum(size).alias("s"), F.count("*").alias("n")).collect()}  # one a partition
    before, rows, offsets = 0, 0, []
    for part in sorted(sums):
        offsets.append((part, before, rows))
        before, rows = before + sums[part][0], rows + sums[part][1]
    offsets = work.spark.createDataFrame(offsets, "part int, before long, rows long")
    window = Window.partitionBy("part").orderBy(*order)
    inside = F.sum(size).over(window.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
    placed = dealt.withColumn("inside", inside).withColumn("nth", F.row_number().over(window) - 1)
    placed = placed.join(F.broadcast(offsets), "part").withColumn("start", F.col("before") + F.col("inside")).withColumn("place", F.col("rows") + F.col("nth"))
    return placed.drop("before", "rows", "inside", "nth", "part")


def _manifest(recipes: DataFrame, n: int, fan: int = 1024) -> DataFrame:
    """(level, node, digest) of the Merkle tree over ``n`` recipes in order; its last level has one node."""
    said = F.concat_ws(":", F.col("place"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("start"), F.col("n_tokens"), F.hex("root"))
    below, level, levels = recipes.select("place", said.alias("leaf")), 0, []
    while level == 0 or n > 1:
        level, n = level + 1, -(-n // fan)
        leaves = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "leaf"))), lambda x: x["leaf"]), ",")
        nodes = below.groupBy(F.floor(F.col("place") / fan).alias("node")).agg(F.sha2(leaves, 256).alias("digest"))
        levels.append(nodes.select(F.lit(level).alias("level"), "node", "digest"))
        below = nodes.select(F.col("node").alias("place"), F.col("digest").alias("leaf"))
    whole = levels[0]
    for nodes in levels[1:]:
        whole = whole.unionByName(nodes)
    return whole


def corpus_root(work: Workspace, folder: str) -> str | None:
    """The digest that all files of a store follow from; None for an empty store."""
    top = work.spark.read.parquet(f"{folder}/manifest").orderBy(F.desc("level")).select("digest").first()
    return top["digest"] if top else None


def write_store(documents: DataFrame, work: Workspace, tokenizer: str, end_id: int = 1, bits: int = 10, least: int = 64, most: int = 8192, few: int = 2_000_000) -> str:
    """Writes the store of ``documents(doc_id, text)`` and returns its folder.

    Null or empty text: the end id alone. Repeated rows and rows that share a doc_id are stored each (their chunks once),
    in an arbitrary order among themselves; a null doc_id comes first. Other columns are ignored; an empty table makes an
    empty store. Which chunks are borrowed is broadcast to the documents up to ``few`` of them, else joined by a shuffle.
    """
    docs = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encoded = work.stage(docs.mapInArrow(_encode(tokenizer, end_id, bits, least, most), STORED), "encoded", "none")
    keys = _each_digest(encoded.select("row", "doc_id", "m", "digests"), "doc_id")
    shared = keys.groupBy("digest").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "row", "i")).alias("owner")).where("c > 1")
    refs = keys.join(shared.select("digest", "owner"), "digest").select("row", "i", ((F.col("row") == F.col("owner.row")) & (F.col("i") == F.col("owner.i"))).alias("own"))
    refs = work.stage(refs, "refs")
    flags = refs.groupBy("row").agg(F.collect_list(F.when(~F.col("own"), F.col("i"))).alias("borrowed"), F.collect_list(F.when(F.col("own"), F.col("i"))).alias("lent"))
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    flags = flags.select("row", some("borrowed"), some("lent"))
    flagged = encoded.join(F.broadcast(flags) if refs.count() <= few else flags.hint("merge"), "row", "left")
    # stripped before the shuffle that brings the rows in order, so a chunk moves once
    flagged.mapInArrow(_strip, flagged.schema).repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").write.option("compression", "none").parquet(f"{work.root}/store")
    recipes = running_start(encoded.select("doc_id", "row", "n_tokens", "m", "root"), ["doc_id", "row"], "n_tokens", work)
    recipes.repartitionByRange("place").sortWithinPartitions("place").write.option("compression", "zstd").parquet(f"{work.root}/recipes")
    recipes = work.spark.read.parquet(f"{work.root}/recipes")
    _manifest(recipes, recipes.count()).coalesce(1).write.parquet(f"{work.root}/manifest")
    work.drop(encoded)
    return work.root


def read_store(work: Workspace, folder: str, wide: bool = False, root: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, rebuilt from the files and verified; with ``root``, also
    against that corpus root. What does not agree is an error (ValueError; inside a task it fails the job)."""
    spark = work.spark
    store, recipes = spark.read.parquet(f"{folder}/store"), spark.read.parquet(f"{folder}/recipes")
    told = _manifest(recipes, recipes.count()).withColumnRenamed("digest", "now").join(spark.read.parquet(f"{folder}/manifest"), ["level", "node"], "full")
    if not told.where(~F.col("now").eqNullSafe(F.col("digest"))).isEmpty():
        raise ValueError("recipes differ from their manifest")
    if root is not None and corpus_root(work, folder) != root:
        raise ValueError("the store is not that of this corpus root")
    held = ["row", "doc_id", "m", "root", "digests", "lengths", "borrowed", "lent", "payload"]
    result = "row long, doc_id long, n_tokens long, ids_crc32 long, root binary"
    complete = store.where("borrowed is null").select(*held).mapInArrow(_rebuild(wide), result)
    chunk = "row long, i int, digest binary, payload binary"
    lent = store.where("lent is not null").select(*held).mapInArrow(_chunks("lent"), chunk).select("digest", "payload")
    partial = store.where("borrowed is not null")
    asked = partial.select("row", "digests", F.explode("borrowed").alias("i")).select("row", "i", F.substring("digests", F.col("i") * DIGEST + 1, F.lit(DIGEST)).alias("digest"))
    fetched = asked.join(lent, "digest").select("row", "i", "payload")
    own = partial.select(*held).mapInArrow(_chunks("own"), chunk).select("row", "i", "payload")
    pieces = own.unionByName(fetched).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("i", "payload"))).alias("pieces"))
    rebuilt = partial.select("row", "doc_id", "digests").join(pieces, "row", "left").select("row", "doc_id", "digests", F.coalesce("pieces", F.array().cast("array<struct<i:int,payload:binary>>")).alias("pieces"))
    counted = complete.unionByName(rebuilt.mapInArrow(_rebuild(wide), result)).toDF("row", "held_id", "held_tokens", "ids_crc32", "held_root")
    same = F.col("doc_id").eqNullSafe(F.col("held_id")) & F.col("n_tokens").eqNullSafe(F.col("held_tokens")) & F.col("root").eqNullSafe(F.col("held_root"))
    out = work.stage(recipes.join(counted, "row", "full").select("doc_id", "start", "n_tokens", "ids_crc32", (same & F.col("place").isNotNull()).alias("same")), "read")
    wrong = out.where(~F.coalesce("same", F.lit(False))).select("doc_id").first()
    if wrong:
        raise ValueError(f"the ids of document {wrong['doc_id']} are not those of its recipe")
    return out.drop("same")


def wide_ids(tokenizer: str) -> bool:
    return WordEncoder(tokenizer).wide
