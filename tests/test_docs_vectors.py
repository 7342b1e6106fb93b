import random

import numpy as np

from tidewater import scratch_path
from tidewater.operators import ann, docs, vectors
from tidewater.sources import files


def _py_chunks(text, size, overlap):
    w = text.split()
    if not w:
        return []
    step = size - overlap
    starts = [s for s in range(0, len(w), step) if s == 0 or s + overlap < len(w)]
    return [" ".join(w[s:s + size]) for s in starts]


def test_chunk_edge_cases(spark):
    texts = ["", "   ", "one two three", " ".join(f"w{i}" for i in range(15)),
             " ".join(f"w{i}" for i in range(10)), " ".join(f"w{i}" for i in range(17)), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {}
    for r in docs.chunk_text(df, size=10, overlap=3, keep=["doc_id"]).collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.text))
    for i, t in enumerate(texts):
        exp = _py_chunks(t or "", 10, 3)
        assert [x for _, x in sorted(got.get(i, []))] == exp, (i, t)
    # a text ending inside the overlap makes no tail chunk; 10 words -> one chunk
    assert len(got[4]) == 1 and len(got[3]) == 2


def test_chunk_random_against_python(spark):
    rnd = random.Random(11)
    texts = [" ".join(rnd.choice(["a", "bb", "c\td", "e\nf"]) for _ in range(rnd.randrange(0, 60))) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in docs.chunk_text(df, size=7, overlap=2, keep=["doc_id"]).collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.text))
    for i, t in enumerate(texts):
        assert [x for _, x in sorted(got.get(i, []))] == _py_chunks(t, 7, 2)


def test_chunk_numbering_across_pages(spark):
    pages = spark.createDataFrame([("a.pdf", 2, "x " * 25), ("a.pdf", 1, "y " * 5), ("b.pdf", 1, "z " * 12),
                                   ("a.pdf", 3, "")], "source string, page_no int, text string")
    out = docs.chunk_and_number(pages, size=10, overlap=2).collect()
    a = sorted((r.page_no, r.chunk_index) for r in out if r.source == "a.pdf")
    assert a == [(1, 0), (2, 1), (2, 2), (2, 3)]
    import uuid
    assert all(r.id == str(uuid.uuid5(uuid.NAMESPACE_URL, f"{r.source}: {r.chunk_index}")) for r in out)


def test_read_pages_default_source(spark):
    path = scratch_path(spark, "pages_t")
    spark.createDataFrame([(None, 1, "text"), ("s", 2, ""), ("s", 3, "more")],
                          "source_id string, page_no int, text string").write.parquet(path)
    rows = sorted((r.source_id, r.page_no) for r in files.read_pages(spark, path, default_source="doc.pdf").collect())
    assert rows == [("doc.pdf", 1), ("s", 3)]


def test_vector_topk_brute_force_ties_and_zero(spark):
    rnd = np.random.default_rng(3)
    pts = rnd.normal(size=(300, 8))
    pts[5] = 0.0                       # zero vector: never returned
    pts[7] = pts[8]                    # exact tie: smaller id first
    queries = rnd.normal(size=(6, 8))
    queries[0] = pts[7]
    pdf = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in enumerate(pts)], "id long, vector array<double>")
    qdf = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in enumerate(queries)],
                                "query_id long, vector array<double>")
    for pb, qb in ((5, 1), (3, 4), (1, 1)):  # cells of both sides
        got = {}
        for r in vectors.vector_topk(pdf, qdf, k=4, point_blocks=pb, query_blocks=qb).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.id, r.similarity))
        norms = np.linalg.norm(pts, axis=1)
        for qi, q in enumerate(queries):
            sims = [(-(pts[i] @ q) / (norms[i] * np.linalg.norm(q)), i) for i in range(len(pts)) if norms[i] > 0]
            exp = [i for _, i in sorted((round(s, 12), i) for s, i in sims)[:4]]
            assert [i for _, i, _ in sorted(got[qi])] == exp
        assert [i for _, i, _ in sorted(got[0])][:2] == [7, 8]


def test_upsert_replaces_by_id(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, v double")
    new = spark.createDataFrame([("b", 20.0, 1), ("b", 21.0, 2), ("c", 3.0, 1)], "id string, v double, seq int")
    out = dict((r.id, r.v) for r in vectors.upsert(old, new.select("id", "v", "seq"), "id", order="seq").collect())
    assert out == {"a": 1.0, "b": 21.0, "c": 3.0}


def test_search_context(spark):
    hits = spark.createDataFrame([(1, 2, "second", "s2"), (1, 1, "first", "s1"), (1, 3, "", "s3"), (1, 4, "x", "s1")],
                                 "query_id int, rank int, text string, source string")
    r = vectors.search_context(hits).first()
    assert r.contexts == ["first", "second", "x"] and r.sources == ["s1", "s2"]


def test_embed_hashing_unit_and_deterministic(spark):
    df = spark.createDataFrame([(1, "Hello hello World"), (2, ""), (3, "Über straße, 42!")], "id int, text string")
    out = {r.id: r.vector for r in vectors.embed_hashing(df, "id", "text", dim=32, as_float=False).collect()}
    assert out[2] is None
    assert abs(sum(x * x for x in out[1]) - 1.0) < 1e-9 and len(out[3]) == 32
    again = {r.id: r.vector for r in vectors.embed_hashing(df.repartition(3), "id", "text", dim=32,
                                                           as_float=False).collect()}
    assert again == out


def test_vector_topk_approx_recall(spark):
    rnd = np.random.default_rng(9)
    centers = rnd.normal(size=(20, 16))
    pts = np.concatenate([c + 0.3 * rnd.normal(size=(100, 16)) for c in centers])
    queries = centers + 0.1 * rnd.normal(size=centers.shape)
    pdf = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in enumerate(pts)], "id long, vector array<double>")
    qdf = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in enumerate(queries)],
                                "query_id long, vector array<double>")
    exact = {(r.query_id, r.id) for r in vectors.vector_topk(pdf, qdf, k=10).collect()}
    approx = ann.vector_topk_approx(pdf, qdf, k=10, cells=20, probes=4).collect()
    got = {(r.query_id, r.id) for r in approx}
    assert len(exact & got) / len(exact) >= 0.9
    assert all(1 <= r.rank <= 10 for r in approx)


def test_approx_search_splits_hot_cells_and_is_exact_with_all_probes(spark):
    rnd = np.random.default_rng(3)
    pts = [(i, [1.0, 2.0, 3.0]) for i in range(100)] + [(100 + i, [float(x) for x in rnd.normal(size=3)]) for i in range(200)]
    pdf = spark.createDataFrame([*pts, (900, None), (901, [0.0, 0.0, 0.0])], "id long, vector array<double>")
    qdf = spark.createDataFrame([(i, v) for i, v in pts[95:130]], "query_id long, vector array<double>")
    got = ann.vector_topk_approx(pdf, qdf, k=4, cells=8, probes=8, block_rows=10)
    exact = vectors.vector_topk(pdf, qdf, k=4)
    key = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.similarity, 9)) for r in df.collect())
    assert key(got) == key(exact)
    assert ann.vector_topk_approx(pdf.limit(0), qdf).count() == 0 and ann.vector_topk_approx(pdf, qdf.limit(0)).count() == 0


def test_approx_search_measures_its_probes(spark):
    """Clustered vectors need few cells, alike ones most; recall is reached either way, and few vectors are scored exactly."""
    rnd = np.random.default_rng(5)
    near = (rnd.normal(size=(24, 24)) * 3)[rnd.integers(0, 24, 3000)] + rnd.normal(size=(3000, 24)) * 0.3
    flat = rnd.normal(size=(3000, 24))
    read = []
    for x in (near, flat):
        pdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(4)
        qdf = pdf.where("id % 100 = 7").withColumnRenamed("id", "query_id")
        stats = {}
        got = {(r.query_id, r.id) for r in ann.vector_topk_approx(pdf, qdf, k=10, cells=48, stats=stats).collect()}
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        want = {(q, int(i)) for q in range(7, 3000, 100) for i in np.argsort(-(unit @ unit[q]), kind="stable")[:10]}
        assert len(want & got) / len(want) >= 0.9 and stats["scored"] < 0.2
        read.append(stats["codes_read"])
    assert read[0] < 0.25 < read[1]


def test_stored_collection(spark, tmp_path):
    path = str(tmp_path / "points")
    make = lambda rows: spark.createDataFrame(rows, "id string, vector array<double>, source string, seq int")
    assert vectors.read_collection(spark, path) is None
    assert vectors.upsert_collection(spark, path, make([("a", [1.0], "s", 0), ("b", [2.0], "s", 0), ("c", [3.0], None, 0)])) == 3
    old = vectors.read_collection(spark, path)
    # one row per id, the later one; a run that broke off leaves a folder without the success mark
    assert vectors.upsert_collection(spark, path, make([("a", [4.0], "t", 1), ("a", [5.0], "t", 2)]), order="seq") == 1
    (tmp_path / "points" / "manifest" / "version=0000000009").mkdir()
    (tmp_path / "points" / "generation=0000000009" / "bucket=0").mkdir(parents=True)
    key = lambda df: sorted((r.id, r.vector[0], r.source) for r in df.collect())
    assert key(vectors.read_collection(spark, path)) == [("a", 5.0, "t"), ("b", 2.0, "s"), ("c", 3.0, None)]
    assert key(old) == [("a", 1.0, "s"), ("b", 2.0, "s"), ("c", 3.0, None)]
    assert vectors.upsert_collection(spark, path, make([("d", [6.0], None, 0), ("e", [7.0], "s", 0)]), replace_source="source") == 2
    assert key(vectors.read_collection(spark, path)) == [("a", 5.0, "t"), ("d", 6.0, None), ("e", 7.0, "s")]


def test_upsert_leaves_untouched_buckets_alone(spark, tmp_path):
    path = tmp_path / "points"
    make = lambda rows: spark.createDataFrame(rows, "id string, vector array<double>, source string")
    vectors.upsert_collection(spark, str(path), make([(f"p{i}", [float(i)], f"s{i % 3}") for i in range(200)]), n_buckets=16)
    files = lambda: {str(f.relative_to(path)) for f in path.glob("generation=*/bucket=*/*.parquet")}
    first = files()
    old = vectors.read_collection(spark, str(path))
    assert vectors.upsert_collection(spark, str(path), make([("p3", [-1.0], "s0")])) == 1
    second = files()
    assert first <= second and len({f.split("/")[1] for f in second - first}) == 1  # one bucket rewritten, the others' files as they were
    now = {r.id: r.vector[0] for r in vectors.read_collection(spark, str(path)).collect()}
    assert now == {f"p{i}": -1.0 if i == 3 else float(i) for i in range(200)}
    assert {r.id: r.vector[0] for r in old.collect()} == {f"p{i}": float(i) for i in range(200)}  # readers of the version before
    # a whole rewrite: after one more, the first generations are gone
    for x in (5.0, 6.0):
        vectors.upsert_collection(spark, str(path), make([(f"p{i}", [x], "s0") for i in range(200)]))
    assert {f.split("/")[0] for f in files()} == {"generation=0000000002", "generation=0000000003"}
    assert vectors.upsert_collection(spark, str(path), make([("only", [1.0], "s0")]), replace_source="source") == 1
    assert [r.id for r in vectors.read_collection(spark, str(path)).collect()] == ["only"]
    assert vectors.upsert_collection(spark, str(path), make([])) == 0 and vectors.read_collection(spark, str(path)).count() == 1


def _py_sentences(text, size, overlap):
    """Word lists of the chunks, by the rule of the docstring."""
    import re
    pieces, run = [], []
    for w in text.split():
        run.append(w)
        if re.search(r"""[.!?]["')\]]*$""", w):
            pieces.append(run)
            run = []
    pieces += [run] if run else []
    pieces = [p[i:i + size] for p in pieces for i in range(0, len(p), size)]
    out, open_ = [], []
    for p in pieces:
        if open_ and sum(map(len, open_)) + len(p) > size:
            out.append(sum(open_, []))
            tail = list(open_)
            while tail and (len(tail) == len(open_) or sum(map(len, tail)) > overlap or sum(map(len, tail)) + len(p) > size):
                tail.pop(0)
            open_ = tail
        open_.append(p)
    return out + ([sum(open_, [])] if open_ else [])


def test_chunk_sentences_against_python(spark):
    rnd = random.Random(21)
    word = lambda: rnd.choice(["a", "bb", "c.", "d!", 'e?"', "f.)", "g", "h", "3.5", "i"])
    texts = [" ".join(word() for _ in range(rnd.randrange(0, 80))) for _ in range(60)]
    texts += ["", "   ", None, " ".join(["w"] * 50), " ".join(["w."] * 50), "one.", "a b c. " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for size, overlap in ((10, 3), (7, 0), (12, 11), (1, 0)):
        got = {}
        for r in docs.chunk_sentences(df, size=size, overlap=overlap, keep=["doc_id"]).collect():
            got.setdefault(r.doc_id, []).append((r.pos, r.n_words, r.text))
        for i, t in enumerate(texts):
            want = _py_sentences(t or "", size, overlap)
            assert sorted(got.get(i, [])) == [(p, len(c), " ".join(c)) for p, c in enumerate(want)], (i, t, size, overlap)
