"""Document ingest and vector search queries."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from tidewater.operators import ann, docs, sparse, vectors
from tidewater.plans import views as V
from tidewater.plans.registry import query
from tidewater.session import materialize, scratch_path

SIZE, OVERLAP = docs.CHUNK_SIZE, docs.CHUNK_OVERLAP
STEP = SIZE - OVERLAP
SENT_SIZE, SENT_OVERLAP = 120, 30
DIM = 256

WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"
STARTS = (f"list_filter(range(0, greatest(len(ws) - 1, 0) + 1, {STEP}), "
          f"lambda s: s = 0 OR s + {OVERLAP} < len(ws))")


@query("chunk_documents", f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
st AS (SELECT doc_id, ws, unnest({STARTS}) AS s FROM w WHERE len(ws) > 0)
SELECT doc_id, CAST(s // {STEP} AS INTEGER) AS pos, array_to_string(ws[s + 1 : s + {SIZE}], ' ') AS text FROM st""")
def q_chunk_documents(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", "text")
    return docs.chunk_text(d, "text", size=SIZE, overlap=OVERLAP, keep=["doc_id"])


@query("chunk_sentences", f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
k AS (SELECT doc_id, ws, generate_subscripts(ws, 1) AS j, unnest(ws) AS x FROM w WHERE len(ws) > 0),
ends AS (SELECT doc_id, j AS b, lag(j, 1, 0) OVER (PARTITION BY doc_id ORDER BY j) AS a FROM k
         WHERE regexp_matches(x, '[.!?]["'')\\]]*$') OR j = len(ws)),
cuts AS (SELECT doc_id, unnest(list_append(range(a + {SENT_SIZE}, b, {SENT_SIZE}), b)) AS c FROM ends),
n AS (SELECT doc_id, list(c ORDER BY c) AS cs FROM cuts GROUP BY doc_id),
chunks AS (
  SELECT doc_id, cs, 0 AS pos, 0::BIGINT AS s, list_max(list_filter(cs, lambda c: c <= {SENT_SIZE})) AS e FROM n
  UNION ALL
  SELECT doc_id, cs, pos + 1, s2, list_max(list_filter(cs, lambda c: c <= s2 + {SENT_SIZE})) FROM (
    SELECT doc_id, cs, pos, e, coalesce(list_min(list_filter(cs, lambda c: c > s AND c <= e AND e - c <= {SENT_OVERLAP}
                                                             AND list_min(list_filter(cs, lambda d: d > e)) - c <= {SENT_SIZE})), e) AS s2
    FROM chunks WHERE e < list_max(cs)))
SELECT doc_id, pos::INTEGER AS pos, (e - s)::INTEGER AS n_words, array_to_string(ws[s + 1 : e], ' ') AS text FROM chunks JOIN w USING (doc_id)""")
def q_chunk_sentences(spark, sf):
    """Chunks of whole sentences with carried overlap."""
    d = V.table(spark, sf, "documents").select("doc_id", "text")
    return docs.chunk_sentences(d, "text", size=SENT_SIZE, overlap=SENT_OVERLAP, keep=["doc_id"], num_partitions=V.wide(spark, sf, "documents"))


CHUNK_IDS_SQL = f"""
WITH w AS (SELECT source, doc_id AS page_no, {WORDS} AS ws FROM documents),
n AS (SELECT *, CASE WHEN len(ws) > 0 THEN len({STARTS}) ELSE 0 END AS nch FROM w),
o AS (SELECT *, coalesce(sum(nch) OVER (PARTITION BY source ORDER BY page_no
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM n),
st AS (SELECT source, page_no, ws, off, unnest({STARTS}) AS s FROM o WHERE len(ws) > 0),
c AS (SELECT source, page_no, CAST(off + s // {STEP} AS INTEGER) AS chunk_index,
             array_to_string(ws[s + 1 : s + {SIZE}], ' ') AS text FROM st),
h AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8')
                     || encode(source || ': ' || CAST(chunk_index AS VARCHAR))) AS hx FROM c)
SELECT substr(hx, 1, 8) || '-' || substr(hx, 9, 4) || '-5' || substr(hx, 14, 3) || '-'
       || lower(printf('%x', (CAST(('0x' || substr(hx, 17, 1)) AS INTEGER) & 3) | 8)) || substr(hx, 18, 3)
       || '-' || substr(hx, 21, 12) AS id,
       source, chunk_index, page_no, text
FROM h"""


def chunk_table(spark, sf):
    pages = V.table(spark, sf, "documents").select("source", F.col("doc_id").alias("page_no"), "text")
    return docs.chunk_and_number(pages, source_col="source", page_col="page_no", size=SIZE, overlap=OVERLAP,
                                 num_partitions=V.wide(spark, sf, "documents"))


@query("chunk_ids", CHUNK_IDS_SQL)
def q_chunk_ids(spark, sf):
    return chunk_table(spark, sf).select("id", "source", "chunk_index", "page_no", "text")


TOKENS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"


def sparse_embedding_sql(src: str, id_col: str) -> str:
    return f"""
SELECT {id_col}, slot, v / n AS weight
FROM (SELECT {id_col}, CAST((('0x' || substr(md5(t), 1, 8))::UBIGINT % {DIM}) AS INTEGER) AS slot,
             sum(CASE WHEN CAST(('0x' || substr(md5(t), 9, 1)) AS INTEGER) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS v
      FROM (SELECT {id_col}, unnest({TOKENS}) AS t FROM {src}) GROUP BY ALL)
JOIN (SELECT {id_col}, sqrt(sum(v * v)) AS n FROM (
        SELECT {id_col}, sum(CASE WHEN CAST(('0x' || substr(md5(t), 9, 1)) AS INTEGER) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS v
        FROM (SELECT {id_col}, unnest({TOKENS}) AS t FROM {src})
        GROUP BY {id_col}, CAST((('0x' || substr(md5(t), 1, 8))::UBIGINT % {DIM}) AS INTEGER))
      GROUP BY {id_col}) USING ({id_col})
WHERE v <> 0 AND n > 0"""


@query("embed_hashing", f"SELECT doc_id, slot, round(weight, 6) AS weight FROM ({sparse_embedding_sql('documents', 'doc_id')})")
def q_embed_hashing(spark, sf):
    d = V.table(spark, sf, "documents")
    e = vectors.embed_hashing(d, "doc_id", "text", DIM, as_float=False, num_partitions=V.wide(spark, sf, "documents"))
    return (e.select("doc_id", F.posexplode("vector").alias("slot", "weight"))
            .where(F.col("weight") != 0).withColumn("weight", F.round("weight", 6)))


def label_centroids(spark, sf):
    e = V.table(spark, sf, "embeddings")
    return (e.groupBy("label").agg(Summarizer.mean(array_to_vector("embedding")).alias("m"))
            .select(F.col("label").alias("query_id"), vector_to_array("m").alias("vector")))


CENTROIDS_SQL = """
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT label, i, avg(v[i]) AS m FROM e, unnest(range(1, len(e.v) + 1)) AS t(i) GROUP BY label, i),
q AS (SELECT label AS query_id, list(m ORDER BY i) AS qv FROM u GROUP BY label)"""


@query("vector_topk", f"""
WITH {CENTROIDS_SQL},
s AS (SELECT q.query_id, e.vec_id AS id, round(list_cosine_similarity(q.qv, e.v), 12) AS similarity FROM q, e)
SELECT query_id, rank, id, round(similarity, 6) AS similarity
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s)
WHERE rank <= 5""")
def q_vector_topk(spark, sf):
    pts = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    top = vectors.vector_topk(pts, label_centroids(spark, sf), k=5, id_col="id", qid_col="query_id")
    return top.select("query_id", F.col("rank").cast("long").alias("rank"), "id",
                      F.round("similarity", 6).alias("similarity"))


@query("vector_upsert", f"""
WITH {CENTROIDS_SQL},
ex AS (SELECT 'vec:' || CAST(vec_id AS VARCHAR) AS id, v AS vector, label FROM e),
inc AS (SELECT id, list_transform(vector, lambda x: x * 2) AS vector, label FROM ex WHERE label = 0
        UNION ALL SELECT 'centroid:' || CAST(query_id AS VARCHAR), qv, query_id FROM q),
m AS (SELECT * FROM inc UNION ALL SELECT * FROM ex WHERE id NOT IN (SELECT id FROM inc))
SELECT id, label, len(vector) AS dim, round(vector[1], 6) AS v0 FROM m""")
def q_vector_upsert(spark, sf):
    e = V.table(spark, sf, "embeddings")
    existing = e.select(F.concat(F.lit("vec:"), F.col("vec_id").cast("string")).alias("id"),
                        F.col("embedding").cast("array<double>").alias("vector"), "label")
    reingest = existing.where(F.col("label") == 0).withColumn(
        "vector", F.transform("vector", lambda x: x * 2))
    cents = label_centroids(spark, sf).select(
        F.concat(F.lit("centroid:"), F.col("query_id").cast("string")).alias("id"), "vector",
        F.col("query_id").alias("label"))
    merged = vectors.upsert(existing, reingest.unionByName(cents), "id")
    return merged.select("id", "label", F.size("vector").alias("dim"),
                         F.round(F.col("vector")[0], 6).alias("v0"))


@query("vector_collection", f"""
WITH {CENTROIDS_SQL},
ex AS (SELECT 'vec:' || CAST(vec_id AS VARCHAR) AS id, v AS vector, label FROM e),
inc AS (SELECT id, list_transform(vector, lambda x: x * 2) AS vector, label FROM ex WHERE label = 0
        UNION ALL SELECT 'centroid:' || CAST(query_id AS VARCHAR), qv, query_id FROM q),
m AS (SELECT * FROM inc UNION ALL SELECT * FROM ex WHERE id NOT IN (SELECT id FROM inc)),
r AS (SELECT id, vector, label FROM m WHERE label <> 1 UNION ALL SELECT id || ':again', vector, label FROM m WHERE id = 'centroid:1')
SELECT id, label, unnest(range(len(vector))) AS pos, round(unnest(vector), 6) AS value,
       (SELECT count(*) FROM ex) AS n_first, (SELECT count(*) FROM inc) AS n_second, (SELECT count(*) FROM m WHERE id = 'centroid:1') AS n_third FROM r""")
def q_vector_collection(spark, sf):
    """A stored collection: filled, upserted, then one label (as source)
    replaced; every component read back, with the points ingested by each step."""
    e = V.table(spark, sf, "embeddings")
    points = e.select(F.concat(F.lit("vec:"), F.col("vec_id").cast("string")).alias("id"),
                      F.col("embedding").cast("array<double>").alias("vector"), "label")
    cents = label_centroids(spark, sf).select(F.concat(F.lit("centroid:"), F.col("query_id").cast("string")).alias("id"), "vector",
                                              F.col("query_id").alias("label"))
    path = scratch_path(spark, "stored_collection")
    second = points.where(F.col("label") == 0).withColumn("vector", F.transform("vector", lambda x: x * 2)).unionByName(cents)
    again = cents.where(F.col("label") == 1).withColumn("id", F.concat("id", F.lit(":again")))
    n = [vectors.upsert_collection(spark, path, points, n_buckets=16),
         vectors.upsert_collection(spark, path, second, n_buckets=16),
         vectors.upsert_collection(spark, path, again, n_buckets=16, replace_source="label")]
    stored = vectors.read_collection(spark, path)
    return (stored.select("id", "label", F.posexplode("vector").alias("pos", "value"))
            .select("id", "label", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"),
                    *[F.lit(x).alias(c) for x, c in zip(n, ("n_first", "n_second", "n_third"))]))


@query("rag_context", f"""
WITH qe AS ({sparse_embedding_sql('benchmark', 'item_id')}),
ch AS ({CHUNK_IDS_SQL}),
ce AS ({sparse_embedding_sql('ch', 'id')}),
s AS (SELECT qe.item_id AS query_id, ce.id, round(sum(qe.weight * ce.weight), 12) AS similarity
      FROM qe JOIN ce ON qe.slot = ce.slot GROUP BY qe.item_id, ce.id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s)
        WHERE rank <= 5),
hits AS (SELECT top.query_id, top.rank, ch.text, ch.source FROM top JOIN ch ON top.id = ch.id)
SELECT query_id,
       string_agg(text, chr(10) || '---' || chr(10) ORDER BY rank) FILTER (WHERE length(text) > 0) AS contexts,
       array_to_string(list_sort(list_distinct(list(source))), ',') AS sources_set,
       count(*) AS n_hits
FROM hits GROUP BY query_id""")
def q_rag_context(spark, sf):
    # ingest: chunk and store the points with their payload, embed and store the posting lists, once each; search reads them
    points = materialize(chunk_table(spark, sf).select("id", docs.payload(F.col("source"), F.col("text")).alias("payload")), "collection")
    postings = materialize(sparse.posting_table(vectors.embed_sparse(points.select("id", "payload.text"), "id", "text", DIM)), "postings")
    qs = vectors.embed_sparse(V.table(spark, sf, "benchmark"), "item_id", "text", DIM)
    hits = sparse.sparse_topk(postings, qs, k=5, qid_col="item_id").join(points, "id")
    ctx = vectors.search_context(hits.select(F.col("item_id").alias("query_id"), "rank", "payload.text", "payload.source"))
    return ctx.select(
        "query_id", F.array_join("contexts", "\n---\n").alias("contexts"),
        F.array_join(F.array_sort("sources"), ",").alias("sources_set"), "n_hits")


VOWELS = "aeiou"


def vowel_shares(texts):
    """A stand-in for a model: the share of each vowel among the vowels of a text."""
    counts = np.array([[t.lower().count(v) for v in VOWELS] for t in texts], float)
    return counts / np.maximum(counts.sum(1, keepdims=True), 1)


@query("embed_plugin", "SELECT doc_id, " + ", ".join(
    f"round((length(t) - length(replace(t, '{v}', ''))) / greatest(length(t) - length(translate(t, '{VOWELS}', '')), 1)::FLOAT, 4) AS {v}" for v in VOWELS)
    + " FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def q_embed_plugin(spark, sf):
    """An embedder of the caller's own, run in Arrow batches on the executors."""
    e = vectors.embed_with(V.table(spark, sf, "documents"), "doc_id", vowel_shares, dim=len(VOWELS))
    return e.select("doc_id", *[F.round(F.col("vector")[i].cast("double"), 4).alias(v) for i, v in enumerate(VOWELS)])


@query("sparse_search", f"""
WITH qe AS ({sparse_embedding_sql('benchmark', 'item_id')}),
ce AS ({sparse_embedding_sql('documents', 'doc_id')}),
s AS (SELECT qe.item_id AS query_id, ce.doc_id AS id, round(sum(qe.weight * ce.weight), 12) AS similarity
      FROM qe JOIN ce ON qe.slot = ce.slot GROUP BY qe.item_id, ce.doc_id)
SELECT query_id, rank::INTEGER AS rank, id, round(similarity, 6) AS similarity, true AS blocks_skipped
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s) WHERE rank <= 5""")
def q_sparse_search(spark, sf):
    """The five documents nearest to every benchmark item over posting lists, and whether block maxima spared any block."""
    e = lambda t, i: vectors.embed_sparse(V.table(spark, sf, t), i, "text", DIM, num_partitions=V.wide(spark, sf, t))
    postings = materialize(sparse.posting_table(e("documents", "doc_id"), id_col="doc_id", block_rows=64), "doc-postings")
    stats: dict = {}
    top = sparse.sparse_topk(postings, e("benchmark", "item_id"), k=5, qid_col="item_id", stats=stats)
    return top.select(F.col("item_id").alias("query_id"), "rank", "id", F.round("similarity", 6).alias("similarity"),
                      F.lit(stats["skipped"] > 0).alias("blocks_skipped"))


@query("vector_topk_approx")
def q_vector_topk_approx(spark, sf):
    """Approximate top-5 of the label centroids over the cell index; ``vector_approx_recall`` measures it."""
    pts = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    top = ann.vector_topk_approx(pts, label_centroids(spark, sf), k=5, id_col="id", qid_col="query_id")
    return top.select("query_id", F.col("rank").cast("long").alias("rank"), "id",
                      F.round("similarity", 6).alias("similarity"))


@query("vector_approx_recall", """
SELECT label AS query_id, (SELECT least(20, count(*)) FROM embeddings) AS n_hits, true AS recall_at_least_09, true AS scored_under_a_fifth
FROM embeddings GROUP BY label""")
def q_vector_approx_recall(spark, sf):
    """Hits per query of the approximate top-20 of the label centroids, whether
    all of them together hold 0.9 of the exact top-20, and whether under a
    fifth of the pairs were scored."""
    pts = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = label_centroids(spark, sf)
    stats: dict = {}
    near = ann.vector_topk_approx(pts, q, k=20, id_col="id", qid_col="query_id", stats=stats).select("query_id", "id", F.lit(1).alias("found"))
    exact = vectors.vector_topk(pts, q, k=20, id_col="id", qid_col="query_id").select("query_id", "id", F.lit(1).alias("true_hit"))
    per = (near.join(exact, ["query_id", "id"], "full").groupBy("query_id")
           .agg(F.count("found").alias("n_hits"), F.count_if(F.col("found").isNotNull() & F.col("true_hit").isNotNull()).alias("good"),
                F.count("true_hit").alias("all")))
    per = materialize(per, "recall")  # one row per query
    total = per.agg((F.sum("good") >= 0.9 * F.sum("all")).alias("ok"))
    return per.select("query_id", "n_hits", total.scalar().alias("recall_at_least_09"), F.lit(stats["scored"] < 0.2).alias("scored_under_a_fifth"))
