"""Nulls in every column, empty and very long texts, ties, repeated rows, empty tables and clashing names: what the
docstrings say of them."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.llm import chat, decontaminate, fingerprint, jaccard, mixing, pii, tokens, toxicity, urls
from framewise.llm.common import Workspace, shared_dir

CLASH = ["row", "id", "th", "hash", "component", "score", "tokens", "rate", "base", "fp", "n", "key", "label", "count"]
LONG = " ".join(f"w{i * 7919 % 4999}" for i in range(200_000))
ITEM = "one two three four five six seven"
ROWS = [(1, ITEM), (1, ITEM), (1, "other text of the same id"), (2, None), (3, ""), (4, " \n\t "), (None, ITEM), (None, None), (None, ITEM), (5, LONG), (6, f"mail me: a@b.cd {ITEM}"), (7, "x" * 100_000)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    df = spark.createDataFrame([(*r, *range(len(CLASH))) for r in ROWS], f"doc_id long, text string, {', '.join(f'{c} int' for c in CLASH)}")
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def work(spark):
    return Workspace(spark, "edges")


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


EVERY = Counter(d for d, _ in ROWS)


def test_leaks(spark, odd, work):
    bench = spark.createDataFrame([(1, ITEM, 0), (1, "another version of this one item", 0), (None, ITEM, 0), (2, None, 0), (3, "", 0), (4, "too short", 0)], "item_id long, text string, hash int")
    rows = decontaminate.contained_items(odd, bench, work).collect()
    assert {(r["doc_id"], r["item_id"], r["containment"]) for r in rows} == {(1, 1, 1.0), (6, 1, 1.0)} and len(rows) == 2
    assert decontaminate.contained_items(odd.limit(0), bench, work).count() == decontaminate.contained_items(odd, bench.limit(0), work).count() == 0


def test_personal_data(spark, odd, work):
    out = pii.extract(odd, work)
    assert ids(out) == EVERY and out.select("doc_id", pii.listed(F.col("base")).alias("b")).where("b <> ''").collect() == [(6, "email:9:15")]
    assert pii.extract(odd.limit(0), work).count() == 0


def test_fingerprints(spark, odd, work):
    out = fingerprint.edited_neighbours(odd, work)
    assert ids(out) == Counter(d for d, _ in {(d, t or "") for d, t in ROWS})
    rows = {(r["doc_id"], r["n_chars"]): r for r in out.collect()}
    assert rows[5, len(LONG)]["fingerprint"] and rows[2, 0]["fingerprint"] == "" and rows[7, 100_000]["near_edited"] >= 0
    assert rows[1, len(ITEM)]["fingerprint"] == rows[None, len(ITEM)]["fingerprint"]


def test_toxicity(spark, odd, work):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (3, 0, 0), (99, 1, 0)], "doc_id long, toxic int, score int")
    model = toxicity.fit(odd, labels, work)
    scored = toxicity.score(odd, model)
    assert ids(scored) == EVERY and all(0 <= r["score"] <= 1 for r in scored.collect())
    held = odd.select("doc_id", toxicity.held_out().alias("held")).where("doc_id is null").collect()
    assert all(r["held"] for r in held) and toxicity.clean(odd, model).columns == odd.columns
    assert toxicity.score(odd, toxicity.fit(odd, labels.limit(0), work)).agg(F.max("score")).first()[0] < 0.5


def test_token_store(spark, odd, work):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = tokens.read_store(work, tokens.write_store(odd, work, path)).orderBy("start").collect()
    assert Counter(r["doc_id"] for r in rows) == EVERY and [r["doc_id"] is None for r in rows] == [True] * 3 + [False] * 9
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 4)} == {1}


def test_chat(spark, work):
    turns = spark.createDataFrame([(1, 0, "user", "a", 9, 9), (1, 0, "user", "a", 9, 9), (1, None, None, None, 9, 9), (None, 1, "assistant", LONG, 9, 9), (2, 5, "assistant", "", 9, 9)], "conv_id long, turn long, role string, text string, block int, formatted int")
    rows = {r["conv_id"]: r for r in chat.format_conversations(turns, work).select("conv_id", chat.parse(F.col("formatted")).alias("t"), chat.loss_texts(F.col("formatted"), F.col("spans")).alias("loss")).collect()}
    assert [(x["role"], x["text"]) for x in rows[1]["t"]] == [("", ""), ("user", "a"), ("user", "a")] and rows[None]["loss"] == [LONG] and rows[2]["loss"] == [""]


def test_jaccard(spark, odd, work):
    rows = {r["doc_id"]: r for r in jaccard.join_components(odd, work).collect()}
    assert set(rows) == {d for d in EVERY if d is not None} and all(rows[d]["n_shingles"] == 0 for d in (2, 3, 4)) and rows[5]["n_shingles"] > 4000
    assert all(r["component_id"] == d for d, r in rows.items())


def test_mixing(spark, odd, work):
    labels = spark.createDataFrame([(1, "a", 0), (5, "b", 0), (None, "a", 0), (6, None, 0), (99, "b", 0)], "doc_id long, kind string, rate int")
    mix = mixing.fit_rates(odd, labels, work, {"a": 0.5, "b": 0.5}, "kind", 0.5)
    rows = mix.rates.collect()
    assert Counter(r["doc_id"] for r in rows) == EVERY and all(r["rate"] >= 0 for r in rows)
    assert mixing.kept(odd, mix, work).columns == odd.columns


def test_rates_above_one_are_copies_and_missed_targets_are_told(spark, work):
    rng = np.random.default_rng(15)
    law = rng.random(500) < 0.1
    docs = spark.createDataFrame([(i, " ".join([f"w{rng.integers(300)}" for _ in range(30)] + [f"legal{rng.integers(20)}" for _ in range(20 * k)])) for i, k in enumerate(law)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "law" if k else "web") for i, k in enumerate(law)], "doc_id long, kind string")
    free = mixing.fit_rates(docs, labels, work, {"law": 0.5, "web": 0.5}, "kind", 0.8)
    rates = {r["doc_id"]: r["rate"] for r in free.rates.collect()}
    copies = Counter(r["doc_id"] for r in mixing.kept(docs, free, work).collect())
    assert not free.unmet and max(rates.values()) > 2 and all(int(rates[d]) <= copies[d] <= int(rates[d]) + 1 for d in rates)
    bound = mixing.fit_rates(docs, labels, work, {"law": 0.5, "web": 0.5}, "kind", 0.8, most=1.0)
    assert max(r["rate"] for r in bound.rates.collect()) <= 1 and bound.unmet["law"] < -0.3
    assert max(Counter(r["doc_id"] for r in mixing.kept(docs, bound, work).collect()).values()) == 1


def test_rows_without_an_id_of_their_own_are_drawn_each_for_itself(spark, work):
    """Without an id, with one that they share, and equal in id and text: each group keeps what its rates say, but for
    chance, and what was drawn meets the targets as nearly."""
    rng = np.random.default_rng(21)
    text = lambda: " ".join(f"w{rng.integers(300)}" for _ in range(20)) + (" legal" * 5 if rng.random() < 0.3 else "")
    groups = {"none": [(None, text()) for _ in range(600)], "shared": [(7, text()) for _ in range(600)], "equal": [(None, "the same words again and again")] * 600, "equal id": [(8, "those words once more")] * 600, "own": [(1000 + i, text()) for i in range(600)]}
    docs = spark.createDataFrame([(*r, g) for g, rows in groups.items() for r in rows], "doc_id long, text string, kind string").repartition(4)
    labels = spark.createDataFrame([(d, "law" if "legal" in t else "web") for d, t in groups["own"][:300]], "doc_id long, kind string")
    mix = mixing.fit_rates(docs, labels, work, {"law": 0.4, "web": 0.6}, "kind", 0.5, most=1.0)
    rate = mixing.Steps.rates(mix.steps, mixing.posteriors_of(mix.model, [t for rows in groups.values() for _, t in rows])[0].astype("<f4").astype(float))
    docs = work.stage(docs, "docs")
    for few in (2_000_000, 0):
        kept = mixing.kept(docs, mix, work, few)
        got = Counter(r["kind"] for r in kept.collect())
        for i, (g, rows) in enumerate(groups.items()):
            p = rate[i * 600 : i * 600 + len(rows)]
            assert 0.1 < p.mean() < 0.9 and abs(got[g] - p.sum()) <= 5 * np.sqrt((p * (1 - p)).sum())
        assert all(abs(x) < 0.15 for x in mixing.drawn_misses(kept, mix).values())


def test_repeated_documents_are_fingerprinted_once(spark, work):
    """Two documents, each repeated 100,000 times."""
    rows = spark.range(200_000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("Words of document number "), F.col("id") % 2, F.lit(" and so on.")).alias("text"))
    out = fingerprint.edited_neighbours(rows, work).collect()
    assert sorted(r["doc_id"] for r in out) == [0, 1]


def test_paths_and_hosts_of_any_length(spark):
    """Dot segments as a stack from the left takes them away, over a hundred thousand segments; hosts of as many labels."""
    rng = np.random.default_rng(5)
    paths = ["".join(rng.choice(["/", "/.", "/..", "/a", "/bc", "/d.", "/..e"]) for _ in range(n)) for n in rng.integers(1, 30, 300)]
    paths += ["/x" * 100_000 + "/../y", "/x" * 50_000 + "/.." * 49_999 + "/z", "/.." * 100_000]

    def plain(path):
        parts = path.split("/")
        if not any(p in (".", "..") for p in parts[1:]):
            return path
        names, done = parts[1:] + ([""] if parts[-1] in (".", "..") else []), []
        for x in names:
            if x == "..":
                done = done[:-1]
            elif x != ".":
                done.append(x)
        return "/" + "/".join(done)

    df = spark.createDataFrame([(p,) for p in paths], "path string").select("path", urls.plain_path(F.col("path")).alias("plain"))
    for r in df.collect():
        stack, parts = [], r["path"].split("/")[1:]
        if len(parts) > 1000:  # the plain loop above copies too much
            for x in parts + ([""] if parts[-1] in (".", "..") else []):
                stack.pop() if x == ".." and stack else None if x in (".", "..") else stack.append(x)
            assert r["plain"] == "/" + "/".join(stack)
        else:
            assert r["plain"] == plain(r["path"])
    rules = spark.createDataFrame(urls.RULES, "verdict string, host string, path string")
    hosts = spark.createDataFrame([("a." * 100_000 + "example.org", "/es/x"), ("a." * 100_000 + "net", "/"), ("org", "/q")], "host string, path string")
    assert {r["path"]: r["rule"] for r in urls.with_rule(hosts, rules).collect()} == {"/es/x": "example.org/es/", "/": None, "/q": "org/"}


def test_risk_and_gradient_are_those_of_the_formula():
    rng = np.random.default_rng(16)
    rows = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(40)]
    p, u = rows[:10], rows
    dense = lambda some: np.array([[float(i in r) for i in range(6)] + [1.0] for r in some])
    positives, every = toxicity.Rows(p, np.ones(10)), toxicity.Rows(u, np.ones(40))

    def losses(w):
        z = every.scores(w)
        return float(np.logaddexp(0, z).sum()), every.along(toxicity.sigmoid(z), 7)

    def plain(w, prior):
        zp, zu = dense(p) @ w, dense(u) @ w
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        return prior * np.logaddexp(0, -zp).mean(), negative

    seen = set()
    for k in range(40):
        w, prior = rng.normal(size=7) * 2, float(rng.uniform(0.05, 0.9))
        value, grad, above = toxicity.risk(w, positives, losses(w), 40, prior)
        toxic, negative = plain(w, prior)
        assert above == (negative >= 0) and value == pytest.approx(toxic + max(negative, 0.0))
        along = (lambda v: sum(plain(v, prior))) if above else (lambda v: -plain(v, prior)[1])
        slope = [(along(w + 1e-5 * e) - along(w - 1e-5 * e)) / 2e-5 for e in np.eye(7)]
        assert grad == pytest.approx(slope, abs=1e-6)
        seen.add(above)
    assert seen == {True, False}


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    class Context:
        master = "spark://there:7077"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext, conf = Context(), {}  # noqa: N815

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(Session())
