"""The pipeline against its stages done by hand on a small table."""

import corpus_pipeline as P
from tests.llm.test_operators import brute_fp, union

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "mixing"]
    data, at = [docs], docs
    for _, stage in P.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, SF).collect(), docs.schema)
        assert at.columns == docs.columns
        data.append(at)
    texts = [{r["doc_id"]: r["text"] for r in d.collect()} for d in data]
    # 1: only documents without letters or without a clear language go
    assert all(not any(c.isalpha() for c in texts[0][i]) for i in set(texts[0]) - set(texts[1])) and len(texts[1]) >= 0.98 * len(texts[0])
    # 2: every document stays, lines only vanish
    assert set(texts[2]) == set(texts[1])
    for i, t in texts[2].items():
        line = iter(texts[1][i].split("\n"))
        assert t == "" or all(x in line for x in t.split("\n"))
    # 3: the smallest id of each group by brute force
    ids = sorted(texts[2])
    fp = [brute_fp(texts[2][i]) for i in ids]
    root = union(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3])
    assert set(texts[3]) == {min(ids[k] for k in range(len(ids)) if root[k] == r) for r in set(root)}
    # 4: documents holding a whole item go, others stay
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = {i for i, t in texts[3].items() if any(x in " ".join(t.lower().split()) for x in items)}
    assert holds <= set(texts[3]) - set(texts[4]) and len(set(texts[3]) - set(texts[4]) - holds) <= 2
    # 5: run() mixes exactly what is left
    out = P.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(texts[4])
    assert sum(r["taken"] for r in out) <= 2 * sum(r["size"] for r in out)


def test_empty_and_null_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "abc def", None, None, 7)], docs.schema)
    for table in (odd, docs.limit(0)):
        at = table
        for name, stage in P.STAGES:
            at = stage(spark, at, SF)
            at = spark.createDataFrame(at.collect(), at.schema)
        assert at.count() <= 1
