"""The ten operators against plain Python, and on nulls, empty texts, ties, repeated rows and empty tables."""

import hashlib
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.llm import chat, decontaminate, fingerprint, hashing, jaccard, lines, mixing, pii, tokens, toxicity, urls
from framewise.llm.common import Workspace
from framewise.llm.components import connected_components


@pytest.fixture
def work(spark):
    return Workspace(spark, "test")


def documents(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")


def words(rng, n, vocabulary=5000):
    return [f"w{rng.integers(vocabulary)}" for _ in range(n)]


# --- components


def test_components_of_chain_star_and_loop(spark, work):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7000, 7000), (None, 3)]
    out = dict(connected_components(spark.createDataFrame(edges, "a long, b long"), work).collect())
    assert {out[i] for i in range(41)} == {0} and {out[i] for i in range(100, 130)} == {100} and out[7000] == 7000 and len(out) == 41 + 30 + 1
    assert connected_components(spark.createDataFrame([], "a long, b long"), work).count() == 0


# --- 1


def shingles(text, n=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_contained_items_are_those_of_brute_force(spark, work):
    rng = np.random.default_rng(1)
    items = [" ".join(words(rng, int(n))) for n in (5, 6, 9, 20, 40, 60)] + ["too short", None, ""]
    texts = [" ".join(words(rng, 300)) for _ in range(20)]
    texts += [f"{' '.join(words(rng, 200))} {items[k].upper()}! {' '.join(words(rng, 100))}" for k in range(6)]
    near = items[5].split()
    near[30] = "changed"
    texts += [" ".join(near), " ".join(items[5].split()[:30]), None, "", items[3], items[3]]
    docs = documents(spark, texts)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in decontaminate.contained_items(docs, bench, work).collect()}
    want = {}
    for i, t in enumerate(texts):
        for k, x in enumerate(items):
            q = shingles(x)
            if q and len(q & shingles(t)) >= 0.8 * len(q):
                want[i, k] = len(q & shingles(t)) / len(q)
    assert got == pytest.approx(want) and len(want) >= 9
    assert decontaminate.contained_items(docs.limit(0), bench, work).count() == 0
    assert decontaminate.contained_items(docs, bench.limit(0), work).count() == 0


# --- 2


def base_spans(text):
    checks = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s, d: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s, d: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s, d: 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s, d: 9 <= len(d) <= 15),
    }
    found = []
    for rank, (kind, (pattern, ok)) in enumerate(checks.items()):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if ok(m[0], re.sub("[^0-9]", "", m[0]))]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def test_base_entities_are_those_of_plain_patterns(spark, work):
    texts = [
        "a@b.c_d@e.f and x.y@z.com", "é1.2.3.4 256.1.1.1 01.002.3.4.5 1.2.3.4.5.6.7.8", "4111 1111 1111 1111, 4111-1111-1111-1112; 12 34", "+1 (555) 123-4567 or +12", "@@ a@ @b a@b", "👍 9 +49 30 1234567 mail: é@b.cd q@r.st", "",
        None, "1" * 4000 + "." + "2" * 4000, "a" * 5000, "x@y.zz" * 30,
    ]
    rows = pii.extract(documents(spark, texts), work).select("doc_id", pii.listed(F.col("base")).alias("b")).collect()
    assert {r["doc_id"]: r["b"] for r in rows} == {i: ",".join(base_spans(t or "")) for i, t in enumerate(texts)}


def test_contexts_of_seeds_discover_identifiers(spark, work):
    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    texts = [f'some text then token = "{key(i)}" more' for i in range(20)] + ['other words and token = "AB12-99X7" end', "room 2023-11a is free"]
    rows = {r["doc_id"]: r["s"] for r in pii.extract(documents(spark, texts), work).select("doc_id", pii.listed(F.col("spans")).alias("s")).collect()}
    assert rows[0].startswith("key:") and rows[20] == "id:25:34" and rows[21] == ""
    assert pii.extract(documents(spark, texts).limit(0), work).count() == 0


def test_hostile_texts_cost_no_more_than_their_length(spark, work):
    texts = ["x@y" + ".zz" * 100_000, " ".join(f"u{i}@m.example.com" for i in range(20_000)), " ".join(map(str, range(50_000))), "a" * 10**6 + " 12345", "1.2." * 100_000, "+1" + " " * 200_000 + "2"]
    rows = {r["doc_id"]: (r["b"], r["n"]) for r in pii.extract(documents(spark, texts), work).select("doc_id", F.try_element_at("base", F.lit(-1)).alias("b"), F.size("base").alias("n")).collect()}
    assert rows[0][1] == 1 and rows[0][0]["end"] == len(texts[0]) and rows[1][1] == 20_000 and rows[1][0]["end"] == len(texts[1])
    assert rows[2][1] == rows[3][1] == rows[5][1] == 0 and rows[4][1] == 100_000 // 2


def test_discovered_identifiers_induce_patterns(spark, work):
    ids = [f"AB{i}-99X{i}" for i in range(8)]
    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    texts = [f"the secret token: {key(i)} end" for i in range(40)] + [f"the secret token: {x} end" for x in ids] + [f"badge number: {x} seen" for x in ids] + ["badge number: QQ77-1 seen", "an other 12-abcdef word"]
    rows = [r["s"] for r in pii.extract(documents(spark, texts), work, confidence=0.5).select("doc_id", pii.listed(F.col("spans")).alias("s")).orderBy("doc_id").collect()]
    assert all(s.startswith("id:18:") for s in rows[40:48]) and all(s.startswith("id:14:") for s in rows[48:57]) and rows[57] == ""


# --- 3


def test_recurring_templates_go(spark, work):
    texts = [f"own text number {i} is here\nuser {i} logged in from host {i * 7} today\n\nanother own line w{i} x{i * i}" for i in range(12)]
    texts = [t.replace("own text number", f"text{'abcdefghijkl'[i]} only") for i, t in enumerate(texts)] + [None, "", "alone"]
    rows = {r["doc_id"]: r for r in lines.drop_recurring(documents(spark, texts), work).collect()}
    assert all("logged in" not in rows[i]["text"] and f"text{'abcdefghijkl'[i]}" in rows[i]["text"] for i in range(12))
    assert rows[12]["text"] == "" and rows[13]["n_lines"] == 0 and rows[14]["text"] == "alone"
    assert lines.drop_recurring(documents(spark, texts[:5]), work).agg(F.sum("n_dropped")).first()[0] == 0


@pytest.mark.parametrize("few", [500_000, 0])
def test_passages_of_few_texts_go(spark, work, few):
    rng = np.random.default_rng(9)
    line = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(26, size=8)) for _ in range(n))
    long, changed, middle, short = line(60), None, line(20), line(12)
    changed = " ".join([*long.split()[:-2], "other", "end"])
    numbers = [" ".join(str(x) for x in rng.integers(10**6, size=60)) for _ in range(3)]
    shared = [[long], [changed, middle, short], [middle, short, numbers[0]], [middle, short, numbers[1]], [middle, numbers[2]], [middle]]
    own = [line(70) for _ in range(7)]
    texts = ["\n".join([o, *lines_, "tail"]) for o, lines_ in zip(own, [*shared, []], strict=True)]
    texts += [texts[-1]] * 4  # exact copies are one text
    rows = {r["doc_id"]: r for r in lines.drop_recurring(documents(spark, texts), work, few=few).collect()}
    gone = {long, changed, middle, "tail"}  # the tail is in ten documents and more
    for i, t in enumerate(texts):
        assert rows[i]["text"] == "\n".join(x for x in t.split("\n") if x not in gone)
    few = lines.drop_recurring(documents(spark, texts[:2]), work).collect()
    assert {r["n_dropped"] for r in few} == {1} and all("tail" in r["text"] for r in few)


def recurring(texts, least_documents=10, least_words=100):
    """What ``drop_recurring`` says, by dictionaries: ``texts`` are pairs of doc_id and text."""
    docs, where = dict.fromkeys((d, t or "") for d, t in texts), {}
    for d, t in docs:
        for i, line in enumerate(t.split("\n")):
            tokens = re.sub(r"\S*\d\S*", "<*>", line).split()
            if tokens:
                free = list(range(3, len(tokens)))
                cut = [range(0, 0), *(range(3 + -(-len(free) * j // 8), 3 + -(-len(free) * (j + 1) // 8)) for j in range(8) if free)]
                for out in cut:
                    rest = tuple(None if p in out else x for p, x in enumerate(tokens))
                    where.setdefault(rest, []).append((d, t, i))
    gone = {}
    for rest, places in where.items():
        fixed = sum(x not in (None, "<*>") for x in rest)
        if len({p[:2] for p in places}) >= least_documents or len({p[1] for p in places}) >= max(2, -(-least_words // max(fixed, 1))):
            for d, t, i in places:
                gone.setdefault((d, t), set()).add(i)
    return {(d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get((d, t), ()))): len(gone.get((d, t), ())) for d, t in docs}


def test_dropped_lines_are_those_of_brute_force(spark, work):
    rng = np.random.default_rng(12)
    some = lambda n: " ".join(["abc", "def", "gh", "i", "jkl", "7"][rng.integers(6)] for _ in range(n))
    pool = [some(int(n)) for n in rng.integers(1, 8, 40)] + [" ".join(words(rng, 60)).replace("w", "v") for _ in range(4)] + [" ".join("x" * int(c) for c in rng.integers(1, 9, 55)) for _ in range(4)]
    texts = []
    for d in range(60):
        parts = [pool[rng.integers(len(pool))] for _ in range(rng.integers(0, 6))] + [some(9) for _ in range(2)]
        if d % 3 == 0 and parts:
            part = parts[0].split(" ")
            part[rng.integers(len(part))] = "other"
            parts[0] = " ".join(part)
        texts.append((d if d % 7 else None, "\n".join(parts)))
    texts += [texts[5], texts[5], (5, texts[8][1]), (90, None), (91, ""), (92, " \n\n"), (93, ("same line again\n" * 3000)[:-1]), (94, "y " * 50_000)]
    df = spark.createDataFrame([(*t, 1, "clash", 2) for t in texts], "doc_id long, text string, i int, leaf string, id int")
    want = recurring(texts)
    rows = lines.drop_recurring(df, work).collect()
    assert {(r["doc_id"], r["text"]): r["n_dropped"] for r in rows} == want and len(rows) == len({(d, t or "") for d, t in texts}) and sum(want.values()) > 20
    assert lines.drop_recurring(df.limit(0), work).count() == 0


# --- 4


def test_order_minhash_follows_order_and_edits(spark, work):
    rng = np.random.default_rng(2)
    base = words(rng, 400)
    swapped = base[200:] + base[:200]
    changed = [*base[:390], *words(rng, 10)]
    texts = [" ".join(base), " ".join(base), " ".join(changed), " ".join(swapped), " ".join(words(rng, 400)), None, "", "one", "a " * 3000]
    fp = {r["doc_id"]: r["fp"] for r in fingerprint.fingerprints(documents(spark, texts), "text", "fp").collect()}
    alike = lambda a, b: len(set(fp[a]) & set(fp[b])) / max(len(fp[a]), 1)
    assert fp[0] == fp[1] and alike(0, 2) > 0.7 and alike(0, 4) == 0 and alike(0, 3) < alike(0, 2)
    assert fp[5] == fp[6] == [] and len(fp[7]) == 1 and len(fp[8]) > 1


def edit_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def test_likeness_falls_with_edit_distance(spark):
    rng = np.random.default_rng(13)
    base = words(rng, 150)
    texts = [base]
    for edits in (0, 1, 3, 6, 12, 25, 50, 100):
        for _ in range(4):
            copy = list(base)
            for _ in range(edits):
                at, what = rng.integers(len(copy)), rng.integers(4)
                if what == 0:
                    copy.insert(at, f"n{rng.integers(10**6)}")
                elif what == 1:
                    copy.pop(at)
                elif what == 2:
                    copy[at] = f"n{rng.integers(10**6)}"
                else:  # a block moves
                    part = copy[at : at + 5]
                    del copy[at : at + 5]
                    to = rng.integers(len(copy))
                    copy[to:to] = part
            texts.append(copy)
    far = np.array([edit_distance(base, t) / max(len(base), len(t)) for t in texts])
    df = documents(spark, [" ".join(t) for t in texts])
    fp = {r["doc_id"]: r["fp"] for r in fingerprint.fingerprints(df, "text", "fp").collect()}
    both = df.sparkSession.createDataFrame([(i, fp[0], fp[i]) for i in fp], "i long, a array<int>, b array<int>")
    near = np.array([r[0] for r in both.orderBy("i").select(fingerprint.likeness(F.col("a"), F.col("b"))).collect()])
    rank = lambda x: np.argsort(np.argsort(x))
    assert np.corrcoef(rank(far), rank(-near))[0, 1] > 0.9 and near[0] == 1 and (near[far == 0] == 1).all()
    assert near[(far > 0) & (far < 0.03)].min() > 0.5 and near[far > 0.5].max() < 0.2


def test_an_insertion_changes_what_stands_around_it(spark):
    rng = np.random.default_rng(14)
    runs = ["".join(chr(0x4E00 + c) for c in rng.integers(3000, size=2000)), "".join("ABCDEFabcdef0123456789+/"[c] for c in rng.integers(24, size=2000)), "https://a.b/" + "/".join(f"p{c}" for c in rng.integers(1000, size=400))]
    for run in runs:
        fp = {r["doc_id"]: set(r["fp"]) for r in fingerprint.fingerprints(documents(spark, [run, run[:700] + "Q" + run[700:]]), "text", "fp").collect()}
        assert len(fp[0] & fp[1]) >= 0.9 * len(fp[0])


def test_edited_texts_follow_descending_ids(spark, work):
    texts = ["abcdefghi", "xy", "", None, "0123456789" * 3]
    rows = {r["doc_id"]: r for r in fingerprint.edited_neighbours(documents(spark, texts, 10), work).collect()}
    for i, t in enumerate(texts):
        t, after = t or "", texts[i - 1] or ""
        k = len(t) // 3
        assert rows[10 + i]["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest()
        assert rows[10 + i]["n_chars"] == len(t) and 0 <= rows[10 + i]["near_next"] <= 1
    one = fingerprint.edited_neighbours(spark.createDataFrame([(None, "abc"), (None, "abc")], "doc_id long, text string"), work).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprint.edited_neighbours(documents(spark, []), work).count() == 0


# --- 5


def test_block_decisions_reach_aliases(spark, work):
    link = '<link rel="canonical" href="{}">'
    pages = [
        (1, "http://bad.example.com/de/1", ""), (2, "https://other.net/a", link.format("http://bad.example.com/de/1")), (3, "https://third.net/b", '<meta http-equiv="refresh" content="0;url=https://other.net/a">'),
        (4, "HTTPS://THIRD.net:443/x/../b#part", None), (12, "https://www.third.net/b/", ""), (5, "https://free.net/", ""), (6, None, None), (7, "no scheme", ""), (8, "http://good.ORG/x#y", link.format("/de/1")), (9, "https://mixed.net/", link.format("http://good.org/x") + link.format("http://bad.example.com/de/1")),
        (10, "http://a.example.org/es/1?q", ""), (11, "http://a.example.org/en/12", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rules = spark.createDataFrame(urls.RULES, "verdict string, host string, path string")
    rows = {r["page_id"]: r for r in urls.judge(df, rules, work).collect()}
    verdicts = {k: r["verdict"] for k, r in rows.items()}
    # 9 links a blocked and an explicitly allowed page, so the whole component is not blocked by spreading
    assert verdicts[1] == "block" and verdicts[8] == "allow" and verdicts[10] == verdicts[11] == "block"
    assert rows[6]["host"] == rows[7]["host"] == "" and rows[8]["host"] == "good.org" and rows[8]["path"] == "/x"
    assert rows[1]["rule"] == "com/de/" and rows[11]["rule"] == "example.org/en/1" and rows[8]["rule"] == "org/"
    assert verdicts[2] == verdicts[3] == verdicts[4] == verdicts[9] == "allow"
    alone = {r["page_id"]: r["verdict"] for r in urls.judge(df.where("page_id not in (8, 9)"), rules, work).collect()}
    assert alone[2] == alone[3] == alone[4] == "block" and alone[12] == alone[5] == alone[6] == alone[7] == "allow"
    hops = spark.createDataFrame([("https://free.net", "http://hop.net/1"), ("http://hop.net/1", "http://x.com/de/2")], "source string, target string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(df.where("page_id = 5"), rules, work, hops).collect()} == {5: "block"}
    assert urls.judge(df.limit(0), rules, work).count() == 0


def test_links_are_read_as_browsers_read_them(spark):
    cases = {
        '<link href="x.html" rel="alternate canonical">': "https://a.b/c/x.html", "<LINK REL=canonical HREF='../y?p=1&amp;q=2'>": "https://a.b/c/../y?p=1&q=2", '<base href="/z/"><link rel="canonical" href="w">': "https://a.b/z/w",
        '<link rel="canonical" href="?k=1">': "https://a.b/c/d?k=1", '<link rel="canonical" href="//o.p/q">': "https://o.p/q", '<link rel="canonicals" href="no">': None, '<a rel="canonical" href="no">': None,
        "<meta http-equiv=refresh content=\"5; URL='/r'\">": "https://a.b/r", '<meta name="refresh" content="0;url=no">': None, '<link rel="canonical" href="">': None, '<link rel="canonical" href=" http://t.u ">': "http://t.u",
    }
    df = spark.createDataFrame([(h,) for h in cases], "html string").select("html", urls.links_in(F.col("html"), F.lit("https://a.b/c/d?e#f")).alias("links"))
    assert {r["html"]: (r["links"] or [None])[0] for r in df.collect()} == cases
    same = {"http://A.b": "http://a.b/", "HTTP://a.B:80/#x": "http://a.b/", "https://a.b:80/": "https://a.b:80/", "http://a.b/c/../d/./e/..": "http://a.b/d/", "http://a.b/../..": "http://a.b/", "http://a.b/c..d?../x": "http://a.b/c..d?../x", "http://a.b/" + "x/" * 2000 + "..": "http://a.b/" + "x/" * 1999}
    df = spark.createDataFrame([(u,) for u in same], "u string")
    assert {r[0]: r[1] for r in df.select("u", urls.canonical_key(F.col("u"))).collect()} == same


def test_verdicts_are_those_of_union_find(spark, work):
    rng = np.random.default_rng(11)
    hosts = ["a.org", "b.example.org", "c.com", "d.net", "e.net", "f.io"]
    address = lambda: f"http://{hosts[rng.integers(6)]}/{['de', 'fr', 'es', 'x', 'y'][rng.integers(5)]}/{rng.integers(12)}"
    pages = [(i % 170 if i % 9 else None, address() if i % 31 else None, f'<link rel="canonical" href="{address()}">' * int(rng.random() < 0.35)) for i in range(240)]
    hops = [(address(), address()) for _ in range(20)] + [(None, address())]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    edges = [(u, h.split('"')[3]) for _, u, h in pages if u and h] + [(a, b) for a, b in hops if a]
    for a, b in edges:
        parent[find(a)] = find(b)

    def rule(u):
        host, _, path = u[7:].partition("/")
        fits = [(len(h + p), v == "allow", v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        return max(fits)[2] if fits else None

    met = {}
    for u in {u for _, u, _ in pages if u} | {x for e in edges for x in e}:
        met.setdefault(find(u), set()).add(rule(u))
    want = []
    for page, u, _ in pages:
        told = (rule(u) or ("block" if "block" in met[find(u)] and "allow" not in met[find(u)] else "allow")) if u else "allow"
        want.append((page if page is not None else -1, u or "", told))
    df = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, html string, host string, row int")
    rules = spark.createDataFrame(urls.RULES, "verdict string, host string, path string")
    rows = urls.judge(df, rules, work, spark.createDataFrame(hops, "source string, target string")).collect()
    got = sorted((r["page_id"] if r["page_id"] is not None else -1, r["host"] + r["path"], r["verdict"]) for r in rows)
    assert got == sorted((p, u[7:], v) for p, u, v in want) and any(r["spread"] for r in rows)


# --- 6


def test_nnpu_finds_held_out_toxic_texts(spark, work):
    rng = np.random.default_rng(3)
    toxic = rng.random(1500) < 0.15
    texts = [" ".join([*words(rng, 60, 800), *(["vile", "scumbag"] if t else [])]) for t in toxic]
    docs = documents(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic) if i % 2 or i < 900], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, work)
    rows = toxicity.score(docs, model).withColumn("held_out", toxicity.held_out()).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 1500]
    assert all(0 <= r["score"] <= 1 for r in rows) and len(rows) == 1502 and rows[-1]["score"] < 0.5
    assert np.mean([(r["score"] >= 0.5) == toxic[r["doc_id"]] for r in held]) > 0.98
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert "score" in toxicity.clean(docs, model).columns and toxicity.clean(docs, model).count() < 1502
    none = toxicity.fit(docs.limit(0), labels.limit(0), work)
    assert toxicity.score(docs, none).where("score >= 0.5").count() == 0


# --- 7


def test_store_returns_every_id(spark, work):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = np.random.default_rng(4)
    long = " ".join(words(rng, 6000))
    texts = ["Hello, World! it's naïve—ÉCOLE", None, "", " \n\t ", long, long, long + " tail", "<|endoftext|> x", "a <|endoftext|><|startoftext|>b", "日本語 ΣΑΣ İ ﬁ á", "a" * 3000, "Don't stop... 12,5%"]
    docs = documents(spark, texts)
    folder = tokens.write_store(docs, work, path)
    rows = {r["doc_id"]: r for r in tokens.read_store(work, folder).collect()}
    plain = Tokenizer.from_file(path)
    at = 0
    for i, t in enumerate(texts):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes())), texts[i][:20]
        at += len(ids)
    store = spark.read.parquet(f"{folder}/store")
    assert store.where("borrowed is not null").count() >= 2
    ids_in_order = [r["doc_id"] for r in store.select("doc_id").collect()]
    assert ids_in_order == sorted(ids_in_order)
    root = tokens.corpus_root(work, folder)
    assert tokens.read_store(work, folder, root=root).count() == len(texts)
    with pytest.raises(ValueError, match="corpus root"):
        tokens.read_store(work, folder, root="0" * 64)
    empty = Workspace(spark, "empty")
    assert tokens.read_store(empty, tokens.write_store(docs.limit(0), empty, path)).count() == 0


@pytest.mark.parametrize("change", ["swap", "drop", "chunk", "recipe", "manifest", "order"])
def test_altered_stores_are_refused(spark, work, change):
    import public_tokenizers

    path, rng = public_tokenizers.path("word_bpe_49k.json"), np.random.default_rng(10)
    shared = " ".join(words(rng, 3000))
    made = [tokens.write_store(documents(spark, [f"{shared} {x}", *(f"{x} {i}" * 5 for i in range(4)), shared]), Workspace(spark, x), path) for x in ("one", "two")]
    folder = work.path("altered")
    for name in ("store", "recipes", "manifest"):
        df = spark.read.parquet(f"{made[change == 'swap' and name == 'store']}/{name}")
        if change == "drop" and name == "store":
            df = df.where("doc_id <> 2")
        if change == "chunk" and name == "store":
            df = df.withColumn("digests", F.when(F.col("doc_id") == 1, F.reverse(F.col("digests").cast("string")).cast("binary")).otherwise(F.col("digests")))
        if change == "recipe" and name == "recipes":
            df = df.withColumn("start", F.col("start") + (F.col("doc_id") == 3).cast("long"))
        if change == "manifest" and name == "manifest":
            df = df.where("level > 1")
        if change == "order" and name == "recipes":
            df = df.withColumn("row", F.when(F.col("doc_id") == 1, F.lit(10**9)).otherwise(F.col("row")))
        df.write.parquet(f"{folder}/{name}")
    with pytest.raises(Exception, match="recipe|rebuilt"):
        tokens.read_store(work, folder).count()
    assert tokens.read_store(work, made[0]).count() == 6


# --- 8


def test_chats_come_back_whole(spark, work):
    rows = [(1, 0, "user", "### Assistant: hi </turn>"), (1, 1, "assistant", "\\### x: \\h \\e </turn>\n### "), (1, 1, "assistant", ""), (2, None, None, None), (None, 5, "a: b", "###"), (3, 0, "sys\n#", ": "), (3, 1, "assistant", "plain")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, spans int")
    out = chat.format_conversations(df, work)
    got = {r["conv_id"]: r for r in out.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("t"), chat.loss_texts(F.col("formatted"), F.col("spans")).alias("loss")).collect()}
    for c in {r[0] for r in rows}:
        want = sorted([(r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == c])
        assert [(x["role"], x["text"]) for x in got[c]["t"]] == [w[1:] for w in want]
        assert got[c]["loss"] == [w[2] for w in want if w[1] == "assistant"]
    assert got[3]["formatted"].endswith("### assistant: plain</turn>\n")
    assert chat.format_conversations(df.limit(0), work).count() == 0


# --- 9


def test_components_of_jaccard_links_are_those_of_brute_force(spark, work):
    rng = np.random.default_rng(5)
    shared = words(rng, 60)
    texts = []
    for _ in range(6):  # groups of copies with more and more changes, and a passage that all share
        base = words(rng, 150) + shared
        for j in range(8):
            copy = list(base)
            for at in rng.choice(len(copy), j // 2, replace=False):
                copy[at] = f"new{rng.integers(10**9)}"
            texts.append(" ".join(copy))
    texts += ["one two", "ONE two", "one", "", None, " \t\n", "a b c", "a b  c", "a b c d"]
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    for block in (512, 3):  # one block a group, and many
        rows = jaccard.join_components(documents(spark, texts), work, block=block).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == {i: (len(s), find(i)) for i, s in enumerate(sets)}
    assert jaccard.join_components(documents(spark, []), work).count() == 0


def linked_components(texts, k, num):
    sets = []
    for t in texts:
        w = t.encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    found = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            found = [found[i] if f == found[j] else f for f in found] if found[i] < found[j] else [found[j] if f == found[i] else f for f in found]
    return dict(enumerate(found))


@pytest.mark.parametrize(("k", "num", "sizes"), [(3, 90, (11,)), (5, 80, (8,)), (3, 90, (12, 21, 31, 60)), (5, 80, (9, 14, 23, 40))])
def test_pairs_with_heads_of_different_length_are_linked(spark, work, k, num, sizes):
    rng = np.random.default_rng(8)
    texts = []
    for i, n in enumerate(sizes * (20 // len(sizes))):  # isolated pairs: a text, and it with words added at one end
        base, more = words(rng, n, 10**9), words(rng, max(1, n // 12), 10**9)
        texts += [" ".join(base), " ".join([*base, *more] if i % 2 else [*more, *base])]
    want = linked_components(texts, k, num)
    rows = jaccard.join_components(documents(spark, texts), work, k=k, num=num).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want and len(set(want.values())) < len(texts)


def test_words_that_collide_under_polynomials_stay_apart(spark, work):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = one.translate(str.maketrans("ab", "ba"))
    rows = {r["doc_id"]: r["component_id"] for r in jaccard.join_components(documents(spark, [one, other, one.upper()]), work).collect()}
    assert rows == {0: 0, 1: 1, 2: 0}


def test_links_of_colliding_hashes_are_found_out(spark, work, monkeypatch):
    texts = ["a b c d e f", "g h i j k l", "a b c d e f "]
    docs = documents(spark, texts)
    links = spark.createDataFrame([(1, 0), (2, 0)], "a long, b long")
    assert [tuple(r) for r in jaccard.false_links(links, docs, work, 3, 90, 100, 1, 10).collect()] == [(1, 0)]
    seen, true = [], jaccard.false_links
    monkeypatch.setattr(jaccard, "false_links", lambda *a: seen.append(1) or true(*a) if seen else seen.append(1) or links)
    near = documents(spark, [" ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(59))])
    assert {r["component_id"] for r in jaccard.join_components(near, work).collect()} == {0} and len(seen) == 2


def test_rows_that_share_a_doc_id_are_one_document(spark, work):
    df = spark.createDataFrame([(5, "b b b"), (5, "a a a"), (5, "a a a"), (None, "a a a"), (7, "A a a"), (8, "b b b")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in jaccard.join_components(df, work).collect()) == [(5, 5), (7, 5), (8, 8)]


def test_prefix_tree_links_a_group_of_copies_with_few_comparisons():
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    tree = jaccard.PrefixTree(90, 100)
    for i in range(200):
        keep = np.ones(len(base), bool)
        keep[rng.choice(len(base), 5, replace=False)] = False
        tree.add(i, i, base[keep])
    assert len({tree.find(i) for i in range(200)}) == 1 and len(tree.links) == 199


def test_word_hashes_do_not_depend_on_their_place():
    a, at = hashing.words([b"Alpha beta  gamma", b"", b"beta ALPHA", "É é".encode()])
    assert at.tolist() == [0, 3, 3, 5, 7] and a[0] == a[4] and a[1] == a[3] and a[5] != a[6]


# --- 10


def test_rates_meet_the_targets(spark, work):
    rng = np.random.default_rng(7)
    kinds = rng.random(600) < 0.3
    texts = [" ".join([*words(rng, 30, 500), *(f"legal{rng.integers(20)}" for _ in range(15 * k))]) for k in kinds]
    labels = spark.createDataFrame([(i, "law" if k else "web") for i, k in enumerate(kinds) if i % 2], "doc_id long, kind string")
    docs = documents(spark, [*texts, None, ""])
    mix = mixing.fit_rates(docs, labels, work, {"law": 0.6, "web": 0.4}, "kind", 0.5)
    rows = mix.rates.collect()
    assert len(rows) == 602 and min(r["rate"] for r in rows) >= 0
    reached = sum(r["rate"] * r["tokens"] * np.array(r["posteriors"]) for r in rows)
    assert mix.domains == ("law", "web") and reached / reached.sum() == pytest.approx([0.6, 0.4], abs=0.01)
    assert reached.sum() == pytest.approx(0.5 * mix.available.sum(), rel=0.01)
    right = [(r["posteriors"][0] > 0.5) == kinds[r["doc_id"]] for r in rows if r["doc_id"] < 600 and r["doc_id"] % 2 == 0]
    assert np.mean(right) > 0.95
    assert 0 < mixing.kept(docs, mix, work).count() < 602 and mixing.kept(docs, mix, work).columns == docs.columns
    assert mixing.fit_rates(docs.limit(0), labels.limit(0), work, domain="kind").rates.count() == 0
