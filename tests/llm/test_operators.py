"""Each operator against a brute-force version or SQL, and on odd rows."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.oracle_check import TABLES, digest
from tidewater.llm import chatformat, decontam, graph, langid, licenses, linededup, mixing, simhash, textvec, tokens, topk, toxicity

SF = "/root/testdata/sf0.001"
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", [n for n in E.oracle_sql() if n.startswith("op")])
def test_matches_sql(spark, duck, name):
    df = E.queries()[name](spark, SF)
    cur = duck.execute(E.oracle_sql()[name])
    assert digest(df.columns, [tuple(r) for r in df.collect()]) == digest([d[0] for d in cur.description], cur.fetchall())


def rows(df):
    return [r.asDict() for r in df.collect()]


# ------------------------------------------------------------------ 1
def test_mix_targets_fill_by_weight(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, size long")
    t = {r["source"]: r["target"] for r in rows(mixing.targets(sizes, demand=1.5))}
    left, caps, w = 1.5 * 2010, {"a": 20, "b": 2000, "c": 2000, None: 0}, {"a": 3, "b": 1, "c": 2, None: 3}
    want, free = {}, set(caps)
    while True:  # hand out by weight, fix what is above its cap, repeat
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= caps[s]}
        if not over:
            break
        want |= {s: caps[s] for s in over}
        left -= sum(caps[s] for s in over)
        free -= over
    want |= share
    assert t == pytest.approx(want)


def test_mix_odd_rows(spark, docs):
    m = rows(mixing.mix(docs))
    assert len(m) == docs.count()
    assert all(r["taken"] <= 2 * r["size"] and sum(p["words"] for p in r["passes"]) == r["taken"] for r in m)
    by = {}
    for r in m:
        by.setdefault(r["source"], [0, r["target"]])[0] += r["taken"]
    assert all(abs(a - b) <= 1 for a, b in by.values())
    order = [r["position"] for r in rows(mixing.training_order(mixing.mix(docs)))]
    assert order == sorted(order) and 0 < order[0] and order[-1] < 1
    assert rows(mixing.by_first_position(mixing.mix(docs.limit(0)))) == []


def test_progress_inverts_the_integral(spark):
    knots = ((0.0, 0.0), (0.25, 2.0), (1.0, 1.0))
    area = lambda t: np.trapezoid(np.interp(np.linspace(0, t, 4001), *zip(*knots)), np.linspace(0, t, 4001))
    df = spark.createDataFrame([(0.1,), (0.3,), (0.77,)], "u double").select("u", mixing.progress_at(F.col("u"), F.lit(0), (knots,)).alias("t"))
    assert all(area(r["t"]) / area(1.0) == pytest.approx(r["u"], abs=1e-4) for r in df.collect())


# ------------------------------------------------------------------ 2
def test_topk_brute_force_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    v = {i: rng.integers(-3, 4, 6).tolist() for i in range(300)}
    v[7] = v[8] = v[50]
    v[100] = v[100][:3]
    data = [(i, x) for i, x in v.items()] + [(9, v[9])]
    p = spark.createDataFrame(data, "vec_id long, vec array<long>")
    q = p.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vec")
    got = {}
    for r in rows(topk.top_k(q, p, k=5, point_block=64, query_block=2)):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i in range(0, 300, 50):
        best = sorted((-dot(v[i], v[j]), j) for j in v if j != i)[:5]
        assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    odd = spark.createDataFrame([(1, None), (2, [1.0, None]), (3, [float("nan")]), (4, [1.0, float("inf")]), (5, [1.0, 2.0])], "i int, e array<double>")
    assert [r["i"] for r in rows(odd.where(topk.finite_vector(F.col("e"))))] == [5]
    assert rows(topk.top_k(q.limit(0), p)) == [] and rows(topk.top_k(q, p.limit(0))) == []


def test_nra_stops_early_and_is_exact():
    rng = np.random.default_rng(2)
    points = (rng.normal(size=(4000, 8)) * rng.exponential(size=(4000, 1)) * 50).astype(np.int64)
    lists = topk.Lists(points)
    queries = points[:40] * (np.arange(8) < 2)  # two lists matter: their tops decide
    found = topk.nra(lists, np.arange(4000), queries, list(range(40)), 5)
    for i, (ids, score) in enumerate(found):
        s = points @ queries[i]
        s[i] = -10 ** 12
        assert score.tolist() == sorted(s.tolist(), reverse=True)[:5]
    assert 0 < max(lists._read) < 4000


# ------------------------------------------------------------------ 3
def test_toxicity_separates_and_handles_odd_rows(spark, docs, prose):
    bad = ["vile", "rotten", "nasty"]
    data = [(i, prose(i, 40) + (" " + " ".join(bad[:1 + i % 3]) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    d = spark.createDataFrame(data, "doc_id long, text string, y int")
    labels = d.where("doc_id < 300").select("doc_id", F.lit(1).alias("quality"), F.col("y").alias("toxic"))
    model = toxicity.fit(d, labels.unionByName(spark.createDataFrame([(None, 1, 1), (5, 1, None)], labels.schema)))
    assert model["theta"][0] < model["theta"][1]
    got = {r["doc_id"]: r for r in rows(toxicity.score(d, model))}
    assert all(got[i]["toxic"] == bool(y) for i, _, y in data if i >= 300)
    assert got[2 * 4 + 300]["severity"] != got[301]["severity"]
    out = rows(toxicity.score(docs, model))
    assert len(out) == docs.count() and all(0 <= r["severity"] <= 2 and not r["toxic"] for r in out)
    none = toxicity.fit(d, labels.limit(0))
    assert all(r["severity"] == 0 and not r["toxic"] for r in rows(toxicity.score(docs, none)))


def test_toxicity_features_equal_plain_python():
    texts = ["Idiotic idiotically ab", None, "", "one two one", "\u00e9t\u00e9s " * 3 + "x" * 9]
    w = textvec.scan(texts, "alnum")
    words = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
    flat = [(d, x) for d, ws in enumerate(words) for x in ws]
    for k, (at, h) in zip((3, 4), textvec.beginnings(w, (3, 4))):
        long = [i for i, (_, x) in enumerate(flat) if len(x) >= k]
        assert at.tolist() == long
        assert h.tolist() == textvec.word_hashes(textvec.scan([flat[i][1][:k] for i in long], "alnum")).tolist()
    got = toxicity._distinct_features(texts)
    for ws, f in zip(words, got):
        seen = [x for x in ws] + [(x[:k],) for x in ws for k in toxicity.STEMS if len(x) >= k]
        assert len(f) == len(set(f.tolist())) == len(set(seen)) + sum(seen.count(x) > 1 for x in set(seen))
    # the score of a text is the sum over its features, whichever of them are selected
    rng = np.random.default_rng(4)
    every = np.unique(np.concatenate(got))
    for _ in range(5):
        pick = np.sort(rng.choice(every, len(every) // 2, replace=False))
        model = {"words": pick, "weights": rng.normal(size=len(pick)), "theta": np.array([0.5, 1.0]), "cut": 0.5}
        eta = [sum(model["weights"][np.isin(pick, f)]) for f in got]
        assert np.allclose(toxicity.grade_probabilities(model, texts)[0], 1 / (1 + np.exp(-(np.array(eta) - 0.5))))


def test_toxicity_catches_inflected_forms(spark, prose):
    bad = lambda i: f" grimwort{'abcdefghij'[i % 10]}{i}" * (1 + i % 2)
    data = [(i, prose(i, 40) + (bad(i) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(600)]
    d = spark.createDataFrame(data, "doc_id long, text string, y int")
    model = toxicity.fit(d, d.where("doc_id < 300").select("doc_id", F.lit(1).alias("quality"), F.col("y").alias("toxic")))
    got = {r["doc_id"]: r["toxic"] for r in rows(toxicity.score(d, model))}
    assert all(got[i] == bool(y) for i, _, y in data)


def test_ordinal_gradient():
    rng = np.random.default_rng(0)
    data = [(int(min(2, n)), [0] * (n > 0) + [1] * (n > 1)) for n in rng.integers(0, 3, 200).tolist()]
    w, theta = toxicity.train(data, np.ones(200), 2)
    p1 = 1 / (1 + np.exp(-(np.array([w[x].sum() if x else 0.0 for _, x in data]) - theta[0])))
    assert all((p > 0.5) == (g > 0) for p, (g, _) in zip(p1, data))


# ------------------------------------------------------------------ 4
def full_sw(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment_equals_full_matrix():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 20))
        s, lo, hi = decontam.align(a, b)
        assert s == full_sw(a, b) and (s == 0 or full_sw(a, b[lo:hi]) == s)


def test_decontamination_finds_copies_and_edits(spark, docs, prose):
    item = prose("item", 40)
    w = item.split()
    edited = " ".join(x for i, x in enumerate(w) if i % 9 != 4)
    data = [(1, prose(100, 300) + " " + item.upper() + " " + prose(101, 300)), (2, edited), (3, prose(102, 500)), (4, None), (5, ""), (1, prose(100, 300))]
    data += [(1000 + i, prose(2000 + i, 20) + " " + item) for i in range(60)]  # an item that leaked often keeps its seeds
    d = spark.createDataFrame(data, "doc_id long, text string").withColumn("at", F.lit(1))
    bench = spark.createDataFrame([(7, item), (8, prose("other", 30)), (9, None), (10, "too short")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in rows(decontam.contaminated(d, bench))}
    assert set(found) == {(1, 7), (2, 7)} | {(1000 + i, 7) for i in range(60)}
    assert found[1, 7]["score"] == 1.0 and (found[1, 7]["start_word"], found[1, 7]["end_word"]) == (300, 340)
    kept = decontam.drop_contaminated(d, bench)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in rows(kept)) == [1, 3, 4, 5]
    assert decontam.drop_contaminated(docs, bench).count() == docs.count()
    assert rows(decontam.contaminated(d.limit(0), bench)) == [] and rows(decontam.contaminated(d, bench.limit(0))) == []


@pytest.mark.parametrize("copies", [5, 1000])
def test_decontamination_finds_repeated_partial_copies(spark, prose, copies):
    a, b, c = (prose(k, 40).split() for k in ("edit", "cut", "mixed"))
    edited = " ".join(x for i, x in enumerate(a) if i % 9 != 4)
    mixed = " ".join(x for i, x in enumerate(c) if i % 9 != 4)
    data = [(i, prose(5000 + i, 20) + " " + edited + " " + prose(7000 + i, 20)) for i in range(copies)]
    data += [(2000 + i, prose(9000 + i, 20) + " " + " ".join(b[:24])) for i in range(copies)]
    data += [(4000 + i, mixed) for i in range(copies)] + [(6000, " ".join(c))]  # one verbatim copy beside many edited ones
    d = spark.createDataFrame(data, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in rows(decontam.contaminated(d, bench))}
    assert set(found) == {(base + i, item) for base, item in ((0, 1), (2000, 2), (4000, 3)) for i in range(copies)} | {(6000, 3)}
    assert {s for (_, item), s in found.items() if item == 2} == {0.6} and found[6000, 3] == 1.0


def test_stock_phrases_pair_nothing(spark, prose, monkeypatch):
    """A phrase that all documents and items hold is no seed; an item of nothing but stock phrases is still found whole."""
    rng = random.Random(4)
    near = lambda: f"x{rng.randrange(10 ** 9)}"
    phrase = "as a result of the"
    data = [(i, f"{prose(i, 15)} {near()} {phrase} {near()} {prose(9000 + i, 15)}") for i in range(3000)]
    common = [f"{a} {b} {c}" for a in ("on", "in", "at") for b in ("the", "this", "a") for c in ("one", "other", "same")]
    stock = " ".join(common[:7])
    words = stock.split()
    data += [(10_000 + i, " ".join(f"{near()} {' '.join(words[j:j + 3])}" for j in rng.sample(range(len(words) - 2), 12))) for i in range(1500)]
    data += [(20_000, f"{near()} {stock} {near()}"), (20_001, f"{near()} {' '.join(words[:15])} {near()}")]
    items = [(i, f"{prose(50_000 + i, 18)} q{i} {phrase} r{i} {prose(70_000 + i, 18)}") for i in range(300)] + [(999, stock)]
    pairs = []
    score = decontam._score
    monkeypatch.setattr(decontam, "_score", lambda p, m: (pairs.append(p.count()), score(p, m))[1])
    found = rows(decontam.contaminated(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert {(r["doc_id"], r["item_id"]) for r in found if r["doc_id"] >= 20_000} == {(20_000, 999), (20_001, 999)}
    assert {r["item_id"] for r in found} == {999} and pairs[0] < 0.01 * len(data) * len(items)


def all_pairs(docs_, items):
    """(doc, item) -> score of every document against every item, aligned over whole texts."""
    w = lambda t: textvec.word_hashes(textvec.scan([t], "alnum")).view(np.int64)
    words, want = {d: w(t) for d, t in docs_}, {}
    for item_id, text in items:
        item = w(text)
        for doc_id, x in words.items():
            if len(item) >= decontam.N and np.isin(item, x).mean() >= decontam.MIN_SCORE:
                score = decontam.align(item, x)[0] / (2 * len(item))
                if score >= decontam.MIN_SCORE:
                    want[doc_id, item_id] = score
    return want


def test_decontamination_matches_all_pairs(spark):
    """The query on its table, and the operator on edited copies: words dropped, replaced, put in, passages cut and joined."""
    read = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(*c).collect()]
    docs_, items = read("documents", ["doc_id", "text"]), read("benchmark", ["item_id", "text"])
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in rows(E.queries()["op4_decontamination"](spark, SF))}
    assert got == pytest.approx(all_pairs(docs_, items)) and got
    rng = random.Random(17)
    for k in range(150):
        w, rate = rng.choice(items)[1].split(), rng.choice([0.0, 0.05, 0.1, 0.2, 0.3])
        lo = rng.choice([0, 0, len(w) // 3])
        edited = [y for x in w[lo:] for y in ([x] if rng.random() >= rate else rng.choice([[], ["zz"], [x, "yy"], [x.upper()]]))]
        host = rng.choice(docs_)[1].split()[:60]
        at = rng.randrange(len(host) + 1)
        docs_.append((100_000 + k, " ".join(host[:at] + edited + host[at:])))
    found = decontam.contaminated(spark.createDataFrame(docs_, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    got, want = {(r["doc_id"], r["item_id"]): r["score"] for r in rows(found)}, all_pairs(docs_, items)
    assert got == pytest.approx(want) and len(want) > 100


# ------------------------------------------------------------------ 5
def test_token_counts_equal_the_library(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = ["", " ", "  ", "\n", "a  b", " a", "a \n b", "\n\nfoo", "▁x ▁", "</s> x<s>", "a\tb\t", "　x", "ﬁ é é", "a\x00b", "日本語 text", "x" * 5000, "😀 😀\n 😀", "end  "]
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra).unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in rows(tokens.token_counts(both, path)))
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), len(model.encode(r["text"] or ""))) for r in rows(both))
    assert got == want
    assert rows(tokens.token_counts(docs.limit(0), path)) == []


# ------------------------------------------------------------------ 6
def test_language_held_out_accuracy(spark, docs):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = rows(E.queries()["op6_language_id"](spark, "/root/testdata/sf0.01"))
    lang = {r["doc_id"]: r["lang"] for r in rows(table.select("doc_id", "lang"))}
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)
    model = langid.train([("en", "the river and the stone"), ("de", "der fluss und der stein")] * 5)
    got = {(r["doc_id"], r["_lid"]["lang"]) for r in langid.predict(docs, model).select("doc_id", "_lid").collect()}
    assert {(3, "und"), (4, "und"), (6, "und"), (10, "und")} <= got and len(langid.predict(docs, model).collect()) == docs.count()
    assert langid.fit(docs.limit(0), F.lit(True))["langs"] == []
    assert {r["_lid"]["lang"] for r in langid.predict(docs, langid.train([])).select("_lid").collect()} == {"und"}


def test_training_sample_does_not_shrink_with_copies(spark, prose):
    data = [(prose(300 + i, 30), "en") for i in range(20)] * 300 + [(prose(900 + i, 30), "de") for i in range(10)]
    table = spark.createDataFrame(data, "text string, lang string")
    got = langid.training_windows(table, F.lit(True))
    assert sorted((x, t) for x, t in got) == sorted({(x, t) for t, x in data})


def test_forward_backward_over_blocks():
    model = langid.train([("en", "the river and the stone of light"), ("de", "der fluss und der stein im licht")] * 4)
    texts = ["the fluss and " * 200, "", "stein", None, "river " * 130]
    w = textvec.scan(texts, "alpha")
    m = langid.word_marginals(model, w)
    e = langid.emissions(model, langid.features(w)).astype(float)
    for d in {0, 2, 4}:
        exact, _ = langid._padded_marginals(e[w.doc == d][None], model["trans"], model["start"])
        assert np.allclose(exact[0], m[w.doc == d])


# ------------------------------------------------------------------ 7
def test_lines_by_host(spark):
    data = [("h", f"menu \n\nown {i}\n  menu") for i in range(6)] + [("h", None), ("h", ""), (None, "menu")] + [("g", f"menu\nx{i}") for i in range(4)]
    d = spark.createDataFrame(data, "host string, text string").withColumn("pages", F.lit(1))
    out = rows(linededup.drop_boilerplate(d, host="host", text="text", n_lines="n", n_dropped="gone", min_pages=5))
    assert sorted(r["text"] for r in out if r["host"] == "h" and r["text"]) == [f"\nown {i}" for i in range(6)]
    assert all((r["n"], r["gone"]) == (3, 2) for r in out if r["host"] == "h" and r["text"])
    assert sorted(r["text"] for r in out if r["host"] == "g") == [f"x{i}" for i in range(4)]  # on all of four pages
    assert [(r["text"], r["gone"]) for r in out if r["host"] is None] == [("menu", 0)]
    assert sorted(repr(r["text"]) for r in out if r["host"] == "h" and not r["text"]) == ["''", "None"]
    assert linededup.drop_boilerplate(d.limit(0), host="host", text="text").columns == d.columns
    # the ratio decides at every size, but for what few pages share by chance
    for pages, holding, goes in ((1, 1, False), (2, 2, True), (4, 2, False), (4, 3, True), (20, 4, False), (20, 5, True), (100, 5, False), (100, 6, True)):
        t = spark.createDataFrame([("h", "line" if i < holding else f"own {i}") for i in range(pages)], "host string, text string")
        gone = sum(r["gone"] for r in rows(linededup.drop_boilerplate(t, host="host", text="text", n_dropped="gone")))
        assert gone == (holding if goes else 0), (pages, holding)


def test_lines_of_long_and_repeated_pages(spark):
    long = "\n".join(["menu", *[f"line {i}" for i in range(50_000)], "menu"])
    data = [("h", long)] * 3 + [("h", "menu\nx")] * 5
    out = [r["text"] for r in rows(linededup.drop_boilerplate(spark.createDataFrame(data, "host string, text string"), host="host", text="text"))]
    assert sorted(out, key=len) == [""] * 5 + ["\n".join(f"line {i}" for i in range(50_000))] * 3


# ------------------------------------------------------------------ 8
def test_licences_match_whole_units(spark, docs):
    texts = ["RELEASED under the  MIT-Licence", "x\nCopyright (c) 2020 A\nReleased under the MIT License", "say: Released under the MIT License. Really",
             None, "", "a b\n\nLicensed under the Apache\nLicense, v 2.0\n\nc"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = licenses.known_licenses(spark)
    got = {(r["doc_id"], r["license_id"], r["scope"]) for r in rows(licenses.scan(d, known))}
    assert got == {(0, "MIT", "document"), (1, "MIT", "line"), (1, "MIT", "paragraph"), (5, "Apache-2.0", "paragraph")}
    assert {(r["doc_id"], r["scope"]) for r in rows(licenses.scan(docs, known))} == {(11, "line")}
    assert rows(licenses.scan(d.limit(0), known)) == [] and rows(licenses.scan(d, known.limit(0))) == []


def test_whole_licence_texts_are_found(spark):
    """Long licences by their digests and short ones by their texts, whole, in other spelling and wrapping, not in part."""
    folder = "/usr/share/common-licenses"
    if not os.path.isdir(folder):
        pytest.skip("no licence texts here")
    read = lambda n: open(f"{folder}/{n}", encoding="utf-8").read()
    apache, gpl, mit = read("Apache-2.0"), read("GPL-3"), "\n\n".join(licenses.SHORT[0][2])
    texts = [apache, gpl.upper(), " ".join(apache.split("END OF TERMS")[0].split()).replace("License", "Licence"), gpl[: len(gpl) // 2], gpl + "\nmore",
             "MIT License\n\nCopyright (c) 2020 Some One\n\n" + mit, "code\n\n" + mit.replace(" ", "\n# ") + "\n\ncode", mit[: len(mit) // 3]]
    got = {(r["doc_id"], r["license_id"], r["scope"]) for r in rows(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
                                                                                licenses.known_licenses(spark)))}
    assert {g for g in got if g[2] == "document"} == {(0, "Apache-2.0", "document"), (1, "GPL-3.0-only", "document"), (2, "Apache-2.0", "document"), (5, "MIT", "document")}
    assert {g[0] for g in got if g[1] == "MIT" and g[2] == "paragraph"} == {5, 6}
    made = {(r["license_id"], r["digest"]) for r in rows(licenses.digests_of(spark.createDataFrame([("Apache-2.0", apache), ("GPL-3.0-only", gpl)], "license_id string, text string")))}
    assert made <= set(licenses.DIGESTS) and len(made) == 6


# ------------------------------------------------------------------ 9
def brute_fp(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    s = [" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        up[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_simhash_brute_force(spark, docs):
    table = docs.select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    data = [(r["doc_id"], brute_fp(r["text"])) for r in table.collect()]
    root = union(len(data), [(i, j) for i in range(len(data)) for j in range(i) if (data[i][1] ^ data[j][1]).bit_count() <= 3])
    first = {}
    for (d, _), r in zip(data, root):
        if d is not None:
            first[r] = min(d, first.get(r, d))
    want = sorted((d or -1, f, first.get(r, -1)) for (d, f), r in zip(data, root))
    got = sorted((r["doc_id"] or -1, r["fp"] % (1 << 64), r["component_id"] if r["component_id"] is not None else -1) for r in rows(simhash.near_duplicates(table)))
    assert got == want
    assert rows(simhash.near_duplicates(docs.limit(0))) == []


@pytest.mark.parametrize("max_bits,cell_rows", [(3, 4096), (3, 40), (2, 4096), (5, 4096)])
def test_links_find_every_component(spark, max_bits, cell_rows):
    rng = np.random.default_rng(max_bits)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = {0, (1 << 64) - 1}
    for c in centre.tolist():
        for _ in range(12):
            x = c
            for b in rng.integers(0, 64, rng.integers(0, 9)).tolist():
                x ^= 1 << b
            fp.add(x)
    fp = sorted(fp)
    df = spark.createDataFrame([(simhash._signed(x),) for x in fp], "fp long")
    got = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in rows(graph.components(simhash.links(df, max_bits=max_bits, cell_rows=cell_rows)))}
    root = union(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= max_bits])
    same = lambda f: {frozenset(x for x in fp if f(x) == f(y)) for y in fp}
    at = {x: r for x, r in zip(fp, root)}
    assert same(lambda x: got.get(x, x)) == same(lambda x: at[x])


@pytest.mark.parametrize("max_bits,cell_rows,thresholds", [
    (3, 4096, (1, 1)), (3, 40, (1, 1)), (3, 4096, (1, 0, 0)), (3, 4096, (2, -1, 0)), (3, 4096, (3, -1, -1, -1)), (5, 4096, (4, 0, *[-1] * 6))])
def test_links_probe_larger_thresholds(spark, monkeypatch, max_bits, cell_rows, thresholds):
    rng = np.random.default_rng(len(thresholds))
    m = len(thresholds)
    assert sum(thresholds) == max_bits - m + 1
    fp = set()
    for c in rng.integers(0, 1 << 63, 150, dtype=np.uint64).tolist():
        fp |= {c, *(c ^ sum(1 << b for b in rng.choice(64, rng.integers(1, max_bits + 1), replace=False).tolist()) for _ in range(3))}
    fp = sorted(fp)
    parts = simhash.group_bits(np.array(fp, np.uint64), m)
    forced = [(sum(1 << b for b in p), tuple(p), t) for p, t in zip(parts, thresholds) if t >= 0]
    monkeypatch.setattr(simhash, "plan", lambda *_: forced)
    df = spark.createDataFrame([(simhash._signed(x),) for x in fp], "fp long")
    keys = {(r["part"], r["key"] % (1 << 64), r["fp"] % (1 << 64)) for r in rows(simhash._keys(df, forced)) if r["probe"]}
    for part, key, x in keys:
        mask, _, t = forced[part]
        assert key & ~mask == 0 and 1 <= (key ^ (x & mask)).bit_count() <= t
    got = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in rows(graph.components(simhash.links(df, max_bits=max_bits, cell_rows=cell_rows)))}
    root = union(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= max_bits])
    same = lambda f: {frozenset(x for x in fp if f(x) == f(y)) for y in fp}
    at = dict(zip(fp, root))
    assert same(lambda x: got.get(x, x)) == same(lambda x: at[x])


def test_thresholds_keep_the_pigeonhole_sum():
    sample = np.random.default_rng(0).integers(0, 1 << 63, 300, dtype=np.uint64)
    for n in (10, 10 ** 5, 10 ** 8, 10 ** 11):
        for k in (1, 2, 3, 4):
            for m in range(1, k + 2):
                assert sorted(b for p in simhash.group_bits(sample, m) for b in p) == list(range(64))
            p = simhash.plan(sample, n, k)
            unused = sum(1 for _ in p)
            assert p and sum(t + 1 for _, _, t in p) == k + 1 and unused <= k + 1


def test_keep_one_leaves_one_of_each_group(spark, docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"]) for r in rows(kept))
    comp = {r["component_id"] for r in rows(simhash.near_duplicates(docs))}
    assert len(ids) == len(comp) and [i for n, i in ids if not n] == sorted(c for c in comp if c is not None)


def test_keep_one_is_the_same_under_any_layout(spark):
    data = [(1, "a b c d e", lang, src) for lang in ("en", "de", None) for src in ("s2", "s1")] + [(2, "other words here", "fr", "x")]
    got = {tuple(sorted(tuple(r) for r in simhash.keep_one(spark.createDataFrame(data, "doc_id long, text string, lang string, source string").repartition(n)).collect()))
           for n in (1, 4, 7)}
    assert got == {((1, "a b c d e", None, "s1"), (2, "other words here", "fr", "x"))}


def test_toxicity_labels_of_equal_texts(spark, prose):
    """Equal texts under unlike labels are one toxic example, whatever the layout: the model does not change."""
    data = [(i, prose(i % 40, 30) + (" vile" if i % 3 == 0 else "")) for i in range(160)]
    labels = [(i, int(i % 3 == 0 or i > 150)) for i in range(160)]
    models = [toxicity.fit(spark.createDataFrame(data, "doc_id long, text string").repartition(n), spark.createDataFrame(labels, "doc_id long, toxic int").repartition(n))
              for n in (1, 4, 7)]
    for m in models[1:]:
        assert (m["words"] == models[0]["words"]).all() and np.allclose(m["weights"], models[0]["weights"]) and m["cut"] == models[0]["cut"]


# ----------------------------------------------------------------- 10
def test_layouts_and_round_trip(spark):
    import json
    turns = [("user", "a</s>[INST] \\ <\\ [\\"), ("assistant", ""), ("x[/ROLE]y", "é😀\n"), ("assistant", "b\x00<s>")]
    rec = [json.dumps({"messages": [{"role": r, "content": t} for r, t in turns]}), json.dumps({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}),
           json.dumps({"output": "o", "instruction": "i"}), json.dumps({"prompt": 5, "response": "r", "system": "s"}), json.dumps({"messages": []}), "no json", None, json.dumps({"odd": 1})]
    df = spark.createDataFrame(list(enumerate(rec)), "id int, record string")
    got = {r["id"]: r for r in rows(chatformat.read_back(chatformat.formatted(chatformat.canonical_turns(df))))}
    pairs = {i: [tuple(t) for t in r["turns_read"]] for i, r in got.items()}
    assert pairs == {0: turns, 1: [("user", "q"), ("assistant", "")], 2: [("user", "i"), ("assistant", "o")],
                     3: [("system", "s"), ("user", "5"), ("assistant", "r")], 4: [], 5: [], 6: [], 7: []}
    assert got[0]["loss_text"] == "b\x00<s>" and got[2]["loss_text"] == "o" and [got[i]["layout"] for i in (4, 5, 6, 7)] == ["messages", None, None, None]
    text = got[0]["formatted"]
    assert text.count("</s>") == 4 and "[INST]" not in text
    long = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", f"t{i}😀" * (i % 50)) for i in range(700)] + [(None, None, None, None), (2, 1, "user", None)],
                                 "conv_id long, turn long, role string, text string").withColumn("record", F.lit(1))
    out = {r["conv_id"]: r for r in rows(chatformat.read_back(chatformat.formatted(chatformat.canonical_turns(chatformat.records_of(long)))))}
    assert out[1]["loss_text"] == "".join(f"t{i}😀" * (i % 50) for i in range(1, 700, 2)) and len(out[1]["turns_read"]) == 700
    assert [tuple(t) for t in out[None]["turns_read"]] == [("", "")]
    assert rows(chatformat.records_of(long.limit(0))) == []


def test_long_text_keeps_its_turns(spark, tmp_path):
    table = spark.createDataFrame([(1, 0, "user", "q", 1), (1, 1, "assistant", "x", 21_000_000), (3, 0, "assistant", "<", 3)],
                                  "conv_id long, turn long, role string, letter string, n int")
    table.select("conv_id", "turn", "role", F.expr("repeat(letter, n)").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in rows(E.queries()["op10_chat_format"](spark, str(tmp_path)))}
    assert {i: (r["n_turns"], r["loss_chars"]) for i, r in got.items()} == {-1: (2, 21), 1: (2, 21_000_000), 3: (1, 3)}
    assert got[1]["loss_sha256"] == hashlib.sha256(b"x" * 21_000_000).hexdigest()


def test_table_layouts_are_found_by_their_schema(spark):
    """Five tables of the same conversation under different fields, nested ones too; others' fields beside them; none that fits."""
    base = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", None)], "c long, t long, r string, x string")
    human = F.when(F.col("r") == "user", "human").otherwise("gpt")
    tables = {
        "turn_rows": base.toDF("conv_id", "turn", "role", "text"),
        "content_rows": base.toDF("conversation_id", "position", "role", "content").withColumn("score", F.lit(1)),
        "from_value_rows": base.select(F.col("c").alias("id"), F.col("t").alias("index"), human.alias("from"), F.col("x").alias("value")),
        "message_rows": base.select(F.col("c").alias("conv_id"), F.col("t").alias("turn"), F.struct(F.col("r").alias("role"), F.col("x").alias("content")).alias("message")),
        "author_rows": base.select(F.struct(F.col("c").alias("id")).alias("conversation"), F.col("t").alias("turn"), F.struct(F.col("r").alias("role")).alias("author"),
                                   F.struct(F.col("x").alias("text")).alias("content")).withColumn("value", F.lit("x"))}
    prints = set()
    for name, t in tables.items():
        got = rows(chatformat.canonical_turns(chatformat.records_of(t)))
        assert {r["conv_id"]: [tuple(x) for x in r["turns"]] for r in got} == {1: [("user", "q"), ("assistant", "a")], 2: [("user", "")]}, name
        assert {r["layout"] for r in got} == {name} and not any(r["unread"] for r in got)
        prints |= {r["fingerprint"] for r in got}
    assert len(prints) == 5
    with pytest.raises(ValueError, match="no layout"):
        chatformat.records_of(base)


def test_unreadable_records_are_told_apart_at_any_length(spark):
    df = spark.createDataFrame([(21_000_000,), (10,)], "id long").select("id", F.concat(F.lit('{"prompt": "'), F.expr("repeat('x', id)"), F.lit('", "response": ""}')).alias("record"))
    df = df.unionByName(spark.createDataFrame([(1,), (20_000_000,)], "id long").select("id", F.expr("repeat('n', id)").alias("record")))
    got = {r["id"]: (r["layout"], r["unread"], r["n"]) for r in rows(chatformat.canonical_turns(df).select("id", "layout", "unread", F.size("turns").alias("n")))}
    assert got == {21_000_000: (None, True, 0), 10: ("prompt_response", False, 2), 1: (None, True, 0), 20_000_000: (None, True, 0)}


def test_query_hashes_are_of_the_table(spark):
    t = sorted(((r["conv_id"], r["turn"], r["role"], r["text"] or "") for r in rows(spark.read.parquet(f"{SF}/conversations.parquet"))))
    want = {}
    for c, _, role, text in t:
        want[c] = want.get(c, "") + f"{role}\n{text}\n"
    got = {r["conv_id"]: r["turns_sha256"] for r in rows(E.queries()["op10_chat_format"](spark, SF))}
    assert {c: hashlib.sha256(x.encode()).hexdigest() for c, x in want.items()} == {c: h for c, h in got.items() if c >= 0}
