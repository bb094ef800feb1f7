"""The pipeline and its stages, as they run, against plain Python: nulls, repeated rows and clashing columns included."""

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from framewise.llm import mixing, toxicity
from framewise.llm.common import Workspace, with_row_key

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key int, _rate string, _toxicity string, component_id int"


def words(rng, n, vocabulary=3000):
    return [f"w{rng.integers(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, folder = np.random.default_rng(20), str(tmp_path_factory.mktemp("corpus"))
    items = [" ".join(words(rng, n)) for n in (8, 20, 40)]
    rows, labels = [], []
    for i in range(700):
        toxic, good = rng.random() < 0.12, rng.random() < 0.6
        text = [*words(rng, int(rng.integers(30, 90))), *(["vile", "scumbag"] if toxic else []), *(f"good{rng.integers(9)}" for _ in range(12 * good))]
        rows.append([i, " ".join(text)])
        if i % 2:
            labels.append((i, int(good), int(toxic)))
    for i in range(20):  # near copies, and passages of the benchmark
        copy = rows[i][1].split()
        copy[5] = "changed"
        rows += [[1000 + i, " ".join(copy)], [1100 + i, f"{rows[100 + i][1]} {items[i % 3].upper()} {' '.join(words(rng, 20))}"]]
    rows += [[3, rows[3][1]], [3, rows[3][1]], [3, rows[7][1]], [None, rows[9][1]], [None, rows[9][1]], [None, f"a b {items[1]}"], [None, None], [2000, None], [2001, ""], [2002, " \n"], [2003, "one two"], [2004, "ONE two"], [2005, " ".join(words(rng, 30_000))]]
    documents = spark.createDataFrame([(d, t, None, "x", None, 1, "r", "t", 7) for d, t in rows], SCHEMA)
    documents.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (5000, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([*enumerate(items), (None, "x"), (9, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.read.parquet(f"{corpus[0]}/documents.parquet")


def rows_of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_toxic_documents_go(spark, corpus, docs):
    kept = corpus_pipeline.drop_toxic(spark, docs, corpus[0])
    model = toxicity.fit(docs, spark.read.parquet(f"{corpus[0]}/labels.parquet"), Workspace(spark, "again"))
    z = lambda t: (toxicity.scores_of(model, [t])[0])
    assert kept.columns == docs.columns and rows_of(kept) == Counter({k: n for k, n in rows_of(docs).items() if z(k[1]) < 0.5})
    vile = [k for k in rows_of(docs) if k[1] and "scumbag" in k[1]]
    assert not set(vile) & set(rows_of(kept)) and docs.count() - kept.count() <= 1.1 * sum(rows_of(docs)[k] for k in vile)


def shingles(words, n):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def test_one_document_of_each_group_stays(spark, corpus, docs):
    kept = corpus_pipeline.one_of_each_group(spark, docs, corpus[0])
    every = sorted(rows_of(docs), key=lambda k: (k[0] is None, k[0] or 0, k[1] or ""))
    sets = [shingles((t or "").lower().split(), 5) for _, t in every]
    where, found = {}, list(range(len(every)))
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, set()).add(i)
    for i, j in {p for ids in where.values() for p in combinations(sorted(ids), 2)}:
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((found[i], found[j]))
            found = [a if f == b else f for f in found]
    groups = {}
    for k, f in zip(every, found, strict=True):
        groups.setdefault(f, []).append(k)
    got = rows_of(kept)
    assert kept.columns == docs.columns and set(got.values()) == {1}
    shared = {d for d, n in Counter(d for d, _ in rows_of(docs).elements()).items() if n > 1}
    for members in groups.values():
        stayed = [k for k in members if k in got]
        assert len(stayed) == 1
        if not any(d is None or d in shared for d, _ in members):
            assert stayed[0][0] == min(d for d, _ in members)
    assert len(groups) < len(every) - 15


def test_documents_with_benchmark_items_go(spark, corpus, docs):
    kept = corpus_pipeline.drop_leaks(spark, docs, corpus[0])
    read = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    asked = [shingles(read(x), 5) for x in corpus[1]]
    leaks = {k for k in rows_of(docs) for q in asked if len(q & shingles(read(k[1]), 5)) >= 0.8 * len(q)}
    assert kept.columns == docs.columns and rows_of(kept) == Counter({k: n for k, n in rows_of(docs).items() if k not in leaks}) and len(leaks) == 21


def test_rates_are_drawn(spark, corpus, docs):
    labels = spark.read.parquet(f"{corpus[0]}/labels.parquet")
    kept = corpus_pipeline.mix(spark, docs, corpus[0])
    fitted = mixing.fit_rates(docs, labels, Workspace(spark, "again"), {"quality=1": 0.9, "quality=0": 0.1}, "concat('quality=', quality)", 0.9, most=1.0)
    rates = fitted.rates.collect()
    assert all(0 <= r["rate"] <= 1 for r in rates) and len(rates) == docs.count()
    by_text = {t: mixing.Steps.rates(fitted.steps, mixing.posteriors_of(fitted.model, [t])[0].astype("<f4").astype(float))[0] for t in {t for _, t in rows_of(docs)}}
    had, got = rows_of(docs), rows_of(kept)
    assert kept.columns == docs.columns and not got - had
    assert all(got[k] == (n if by_text[k[1]] >= 1 else 0) for k, n in had.items() if not 0 < by_text[k[1]] < 1)
    for some in (lambda d: True, lambda d: d is not None, lambda d: d is not None and d % 2):  # as many as the rates say, but for chance
        p = np.array([by_text[t] for d, t in had.elements() if some(d)])
        assert abs(sum(n for (d, _), n in got.items() if some(d)) - p.sum()) <= 5 * np.sqrt((p * (1 - p)).sum()) + 1e-9


def test_the_whole_pipeline(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = Workspace(spark, "by-hand").stage(stage(spark, docs, corpus[0]), "stage")
    plain, at, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        ids = np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r["doc_id"], len(ids), zlib.crc32(ids.tobytes())))
    got = sorted(corpus_pipeline.run(spark, corpus[0]).collect(), key=lambda r: r["start"])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter(want) and len(got) > 300
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, corpus, docs, stage):
    assert stage(spark, docs.limit(0), corpus[0]).count() == 0


def test_row_keys(spark, docs):
    work = Workspace(spark, "keys")
    for few in (10, 0):
        rows = with_row_key(docs, work, "k", few).collect()
        by_key = {}
        for r in rows:
            by_key.setdefault(r["k"], set()).add((r["doc_id"], r["text"]))
        assert all(len(v) == 1 for v in by_key.values()) and len(by_key) == len({(r["doc_id"], r["text"]) for r in rows})
        assert all(r["k"] == r["doc_id"] for r in rows if r["doc_id"] not in (None, 3)) and all(r["k"] < 0 for r in rows if r["doc_id"] in (None, 3))
