"""Byte-level BPE against the library that reads the same rank file."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from framewise.llm import bpe, hashing, queries
from framewise.llm.common import table

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(PATH, PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_perfect_hash_gives_each_key_its_place():
    for n in (1, 2, 5, 1000, 20_000):
        keys = hashing.mix(np.arange(n, dtype=np.uint64))
        assert sorted(bpe.PerfectHash.of(keys).places(keys).tolist()) == [*range(n)]
    with pytest.raises(ValueError):
        bpe.PerfectHash.of(np.zeros(2, np.uint64))


def test_tokens_alone_are_found_whole(vocabulary):
    """Every token, and of strings that are none not one."""
    ends = np.cumsum([len(t) for t in vocabulary.tokens])
    assert (vocabulary.whole(b"".join(vocabulary.tokens), ends) == np.arange(len(vocabulary.tokens))).all()
    known = {*vocabulary.tokens}
    others = [x for i in range(20_000) if (x := f"{i * 7919:x}q{i}".encode()) not in known]
    assert (vocabulary.whole(b"".join(others), np.cumsum([len(o) for o in others])) == -1).all()


def test_cuts_of_every_character(vocabulary):
    """A letter, a digit and a sign before each code point, and white space behind: cut where the library cuts. A vocabulary
    that joins any two of these bytes shows the cuts in its ids."""
    firsts = [b"a", b"1", b"!", b" "]
    tokens = [bytes([i]) for i in range(256)] + [f + bytes([i]) for f in firsts for i in range(256)]
    own = bpe.Vocabulary.of(tokens, PATTERN)
    library = tiktoken.Encoding("pairs", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    texts = [f"a{c}1{c}!{c} {c}" for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"]
    wrong = [t[1] for t, packed in zip(texts, own.encode(texts), strict=True) if ids(packed) != library.encode_ordinary(t)]
    assert wrong == []


def test_texts_as_the_library(vocabulary, library):
    lot = random.Random(5)
    draw = [lambda: lot.randrange(32, 127), lambda: lot.choice(b" \t\n\r\x0b\x0c\x1c\x85'"), lambda: lot.randrange(0x80, 0x800), lambda: lot.randrange(0x800, 0xD800), lambda: lot.randrange(0x1F300, 0x1F700)]
    texts = ["".join(chr(lot.choice(draw)()) for _ in range(lot.randrange(80))) for _ in range(3000)]
    texts += ["", " ", "it's we'LL I'd", "aaaa" * 5000, "ab" * 3333 + "!" * 777, " " * 5000 + "x", "日本語" * 500, "́" * 300, "<|endoftext|>"]
    packed = vocabulary.encode(texts)
    assert [ids(p) for p in packed] == [library.encode_ordinary(t) for t in texts]
    assert [vocabulary.decode(p).decode() for p in packed] == texts


def test_blocks_and_memory_of_merges_change_nothing(vocabulary, library, monkeypatch):
    texts = ["Many strange wordlings, yes: zqxj " * 40, "x", "", "strange wordlings " * 60_000]
    monkeypatch.setattr(bpe, "BLOCK", 7)
    monkeypatch.setattr(bpe, "KEPT", 2)
    fresh = bpe.Vocabulary.of([*vocabulary.tokens], PATTERN)
    assert [ids(p) for p in fresh.encode(texts[:3])] == [library.encode_ordinary(t) for t in texts[:3]]
    monkeypatch.setattr(bpe, "BLOCK", 5000)
    assert ids(fresh.encode(texts)[3]) == library.encode_ordinary(texts[3])  # over a million characters: in several pieces


def digests(library, text):
    found = np.array(library.encode_ordinary(text or ""), "<u4").tobytes()
    return len(found) // 4, hashlib.sha256(found).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query_on_whole_table(spark, data, library):
    texts = {r.doc_id: r.text for r in table(spark, data, "documents").collect()}
    assert {r[0]: tuple(r)[1:] for r in queries.op13_byte_bpe(spark, data).collect()} == {k: digests(library, t) for k, t in texts.items()}


def test_nulls_repeats_empty_tables_and_clashing_names(spark, tmp_path, library):
    rows = [(None, None), (1, None), (1, None), (2, ""), (None, "Null id"), (3, "long " * 300_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("ids", "n_tokens", "decoded")})
    frame.write.parquet(f"{tmp_path}/all/documents.parquet")
    frame.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert sorted(map(tuple, queries.op13_byte_bpe(spark, f"{tmp_path}/all").collect()), key=str) == sorted(((k, *digests(library, t)) for k, t in rows), key=str)
    assert queries.op13_byte_bpe(spark, f"{tmp_path}/none").collect() == []
    with pytest.raises(ValueError, match="ids"):
        bpe.Codec(spark, PATH, PATTERN).encode(frame)


def test_wrong_ids_and_vocabularies_are_refused(vocabulary):
    with pytest.raises(ValueError, match="not below"):
        vocabulary.decode(np.array([len(vocabulary.tokens)], "<u4").tobytes())
    with pytest.raises(ValueError, match="256"):
        bpe.Vocabulary.of([b"a", b"b"], PATTERN)
