"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------- 1 mixing
MIX_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key FROM {docs}),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM sizes GROUP BY source),
capped AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][rank % 3 + 1] AS w, source_size * 2.0::DOUBLE AS cap FROM src),
filled AS (
  SELECT *, cap / w AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS need,
         coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM capped),
marked AS (SELECT *, ratio <= (need - used) / w_left AS is_full FROM filled),
tgt AS (
  SELECT source, rank, source_size, CASE WHEN is_full THEN cap ELSE
    (need - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) * w / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () END AS target
  FROM marked),
placed AS (
  SELECT s.*, t.rank, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM sizes s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source),
cut AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM placed),
taking AS (SELECT *, greatest(0, least(size, budget - whole * source_size - ahead)) AS part FROM cut),
pos AS (
  SELECT *, (whole * size + part)::BIGINT AS taken,
         (ahead + (CASE WHEN whole > 0 THEN size ELSE part END) / 2::DOUBLE) / budget AS share,
         [1.5::DOUBLE, 1.0, 0.5][rank % 3 + 1] AS f, [-1.0::DOUBLE, 0.0, 1.0][rank % 3 + 1] AS s FROM taking)
SELECT doc_id, source, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round(2 * share / (f + sqrt(f * f + 2 * s * share)), 6) END AS position FROM pos
"""


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mix of ``docs`` in training order, one row per document."""
    from tidewater.llm import mixing
    return mixing.by_first_position(mixing.mix(docs)).withColumn("position", F.round("position", 6))


@query("op1_mixing", MIX_SQL.format(docs="documents"))
def op1(spark, sf_dir):
    return mixed_rows(_table(spark, sf_dir, "documents"))


# ------------------------------------------------------------ 2 top-k
TOPK_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, vec AS qv FROM v WHERE vec_id % 50 = 0),
s AS (
  SELECT query_id, vec_id, list_sum(list_transform(list_zip(qv, vec), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM q, v WHERE query_id <> vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op2_exact_topk", TOPK_SQL)
def op2(spark, sf_dir):
    from tidewater.llm import topk
    v = (_table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & topk.finite_vector(F.col("embedding")))
         .select("vec_id", topk.quantized(F.col("embedding")).alias("vec")))
    asked = v.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "vec")
    return topk.top_k(asked, v, k=5)


# --------------------------------------------------------- 3 toxicity
@query("op3_toxicity")
def op3(spark, sf_dir):
    from tidewater.llm import toxicity
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


# -------------------------------------------------- 4 decontamination
@query("op4_decontamination")
def op4(spark, sf_dir):
    from tidewater.llm import decontam
    found = decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("doc_hash")


# ----------------------------------------------------- 5 token counts
MODEL = "piece_bpe_32k.model"


@query("op5_token_counts")
def op5(spark, sf_dir):
    import public_tokenizers
    from tidewater.llm import tokens
    return tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))


# ------------------------------------------------------- 6 language id
def held_out(doc_id):
    """The fixed fold that no model learns from: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@query("op6_language_id")
def op6(spark, sf_dir):
    from tidewater.llm import langid
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~held_out("doc_id"))
    p = langid.predict(docs.select("doc_id", "text"), model)
    return p.select("doc_id", held_out("doc_id").alias("held_out"), F.col("_lid.lang").alias("lang_pred"), F.col("_lid.score").alias("score"))


# ------------------------------------------------------ 7 line dedup
LINES_SQL = r"""
WITH t AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(html, '{skipped}', ' ', 'g'), '{blocks}', chr(10), 'g'), '{tags}', '', 'g') AS t
  FROM pages),
u AS (SELECT page_id, nullif(lower(regexp_extract(url, '{host}', 1)), '') AS host, {entities} AS t FROM t),
v AS (SELECT page_id, host, regexp_replace(regexp_replace(t, '[ \t\r\n\f]*\n[ \t\r\n\f]*', chr(10), 'g'), '^\n+|\n+$', '', 'g') AS t FROM u),
p AS (SELECT page_id, host, t, row_number() OVER () AS rid FROM v),
l AS (SELECT rid, host, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM p),
k AS (SELECT *, trim(regexp_replace(line, '[ \t\r\f]+', ' ', 'g')) AS key FROM l),
n AS (SELECT host, key, count(DISTINCT rid) AS n FROM k WHERE key <> '' GROUP BY host, key),
h AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
b AS (SELECT n.host, n.key FROM n JOIN h ON n.host IS NOT DISTINCT FROM h.host 
      WHERE n >= 2 AND n > pages * 0.05::DOUBLE AND (n >= 5 OR n > pages * 0.5::DOUBLE)),
m AS (SELECT k.*, b.key IS NOT NULL AS gone FROM k LEFT JOIN b ON k.host IS NOT DISTINCT FROM b.host AND k.key = b.key),
g AS (SELECT rid, count(*) FILTER (key <> '') AS n_lines, count(*) FILTER (gone) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM m GROUP BY rid)
SELECT page_id, host, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped,
       CASE WHEN t IS NULL THEN NULL ELSE text END AS text
FROM p LEFT JOIN g USING (rid)
"""


def _lines_sql() -> str:
    from tidewater.llm import linededup as d
    chars = {"&quot;": "chr(34)", "&#39;": "chr(39)", "&copy;": "chr(169)", "&middot;": "chr(183)"}
    e = "t"
    for name, char in d.ENTITIES:
        e = f"replace({e}, '{name}', {chars.get(name) or repr(char)})"
    return LINES_SQL.format(skipped=d.SKIPPED, blocks=d.BLOCKS, tags=d.TAGS, host=d.HOST, entities=e)


@query("op7_line_dedup", _lines_sql())
def op7(spark, sf_dir):
    from tidewater.llm import linededup as d
    # the markup is parsed once; counting and rewriting both read the written lines
    pages = materialize(_table(spark, sf_dir, "pages").select(
        "page_id", d.host_of(F.col("url")).alias("host"), d.html_lines(F.col("html")).alias("text")), "page-lines")
    return d.drop_boilerplate(pages, host="host", text="text", n_lines="n_lines", n_dropped="n_dropped")


# ---------------------------------------------------- 8 licence scan
def _licenses_sql() -> str:
    from tidewater.llm import licenses as c

    def words(x):
        return f"regexp_replace(regexp_replace(lower({x}), '{c.COPYRIGHT_LINE}', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"

    def unified(x):
        t = f"concat(' ', trim(regexp_replace({x}, ' *\\n[ \\n]*', ' ', 'g')), ' ')"
        for a, b in c.EQUIVALENT:
            t = f"replace({t}, ' {a} ', ' {b} ')"
        return f"trim({t})"

    known = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in c.known_texts())
    digests = ", ".join(f"('{i}', '{d}')" for i, d in c.DIGESTS)
    return rf"""
WITH known AS (SELECT DISTINCT license_id, sha256({unified(words('t'))}) AS d FROM (VALUES {known}) v(license_id, t)
          UNION SELECT * FROM (VALUES {digests}) v(license_id, d)),
w AS (SELECT doc_id, {words('text')} AS w FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, 'document' AS scope, w AS unit FROM w
  UNION ALL SELECT doc_id, 'paragraph', unnest(regexp_split_to_array(w, '{c.PARAGRAPH_END}')) FROM w WHERE regexp_matches(w, '{c.PARAGRAPH_END}')
  UNION ALL SELECT doc_id, 'line', unnest(string_split(w, chr(10))) FROM w WHERE contains(w, chr(10))),
c AS (SELECT doc_id, scope, {unified('unit')} AS c FROM units)
SELECT doc_id, license_id, scope, count(*)::BIGINT AS n_units FROM c JOIN known ON sha256(c) = d WHERE c <> '' GROUP BY ALL
"""


@query("op8_license_scan", _licenses_sql())
def op8(spark, sf_dir):
    from tidewater.llm import licenses
    return licenses.scan(_table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


# ---------------------------------------------------------- 9 SimHash
@query("op9_simhash")
def op9(spark, sf_dir):
    from tidewater.llm import simhash
    near = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, max_bits=3)
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------- 10 chat
CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, replace(replace(replace(role, '\', '\\'), '<', '<\'), '[', '[\') AS r2,
             replace(replace(replace(text, '\', '\\'), '<', '<\'), '[', '[\') AS t2 FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<s>[ROLE]') + length(r2) + length('[/ROLE]') + length(t2) + length('</s>'))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op10_chat_format", CHAT_SQL)
def op10(spark, sf_dir):
    from tidewater.llm import chatformat as c
    own = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.to_json(F.struct(
        F.lit("</s>[INST] ok [/INST]").alias("prompt"), F.lit("</s>[INST] ok [/INST]").alias("response"))).alias("record"))
    records = c.records_of(_table(spark, sf_dir, "conversations")).unionByName(own, allowMissingColumns=True)
    out = c.read_back(c.formatted(c.canonical_turns(records)).select("conv_id", "formatted", "loss_spans"))
    nl = F.lit("\n")
    joined = F.array_join(F.transform("turns_read", lambda t: F.concat(t["role"], nl, t["text"], nl)), "")
    return out.select("conv_id", F.size("turns_read").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
                      F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                      F.char_length("formatted").cast("long").alias("formatted_chars"))


# ---------------------------------------------------------- 11 packing
PACK_MODEL = "byte_bpe_50k.json"


@query("op11_packing")
def op11(spark, sf_dir):
    import public_tokenizers
    from tidewater.llm import packing
    p = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(PACK_MODEL), max_tokens=2048, max_segments=128, max_loss=2048)
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


# ------------------------------------------- 12 conversation repair
REPAIR_SQL = r"""
WITH RECURSIVE c AS (SELECT conv_id, row_number() OVER () AS cid FROM (SELECT DISTINCT conv_id FROM conversations)),
keyed AS (
  SELECT cid, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce([4294967295::BIGINT] || list_transform(
           string_split(concat(coalesce(r.conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')), ''), lambda x: ord(x)::BIGINT),
           lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
             lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS hit
  FROM conversations r JOIN c ON r.conv_id IS NOT DISTINCT FROM c.conv_id),
damaged AS (
  SELECT cid, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
         CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed, unnest(CASE WHEN hit = 3 THEN [1, 2] ELSE [1] END) WHERE hit <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged),
judged AS (
  SELECT *, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY cid ORDER BY i) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault
  FROM placed),
counts AS (
  SELECT cid, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY cid),
go AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) t(p, r, q)),
ins AS (SELECT * FROM (VALUES (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (3, 3, ''), (3, 2, 'I')) t(p, q, audit)),
edits AS (  -- of one row, by its role, for either choice of what it may become
  SELECT p, r, q, 0 AS cost, 'K' AS audit FROM go
  UNION ALL SELECT p, role, q, 1, 'R' FROM go, unnest(['s', 'u', 'a', 'o']) u(role) WHERE go.r IN ('u', 'a') AND go.r <> role),
choices AS (
  SELECT cid, i, p, q, cost + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS cost, audit
  FROM judged j JOIN edits e ON e.r = CASE WHEN j.r IN ('s', 'u', 'a') THEN j.r ELSE 'o' END WHERE coalesce(fault, '') NOT IN ('blank', 'duplicate')
  UNION ALL SELECT cid, i, p, p, 2, 'D' FROM judged, unnest([0, 1, 2, 3]) s(p)),
v AS (
  SELECT cid, 0::BIGINT AS i, 0 AS state, {'cost': 0::BIGINT, 'audit': ''} AS best FROM counts
  UNION ALL
  SELECT v.cid, v.i + 1, x.q, min({'cost': (v.best.cost + 5 * length(ins.audit) + x.cost)::BIGINT, 'audit': v.best.audit || ins.audit || x.audit})
  FROM v JOIN ins ON ins.p = v.state JOIN choices x ON x.cid = v.cid AND x.i = v.i + 1 AND x.p = ins.q GROUP BY v.cid, v.i, x.q),
solved AS (
  SELECT v.cid, min({'cost': (best.cost + 5 * length(ins.audit))::BIGINT, 'audit': best.audit || ins.audit}) AS best
  FROM v JOIN counts n ON n.cid = v.cid AND n.n = v.i JOIN ins ON ins.p = v.state WHERE ins.q IN (0, 3) GROUP BY v.cid),
letters AS (
  SELECT cid, unnest(string_split(best.audit, '')) AS e, generate_subscripts(string_split(best.audit, ''), 1) AS k FROM solved WHERE best.audit <> ''),
taken AS (SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY cid ORDER BY k) AS i FROM letters),
kept AS (
  SELECT t.*, j.role, j.text, row_number() OVER w AS pos, first_value(e = 'K' AND r = 's') OVER w AS system
  FROM taken t LEFT JOIN judged j ON j.cid = t.cid AND j.i = t.i AND t.e <> 'I' WHERE e <> 'D' WINDOW w AS (PARTITION BY t.cid ORDER BY k)),
repaired AS (
  SELECT cid, string_agg(CASE WHEN e = 'K' THEN role WHEN (pos - system::INTEGER) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''),
                         chr(10) ORDER BY k) AS t FROM kept GROUP BY cid)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM c LEFT JOIN counts USING (cid) LEFT JOIN solved USING (cid) LEFT JOIN repaired USING (cid)
"""


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with known faults, chosen by a checksum of conversation and turn."""
    space = F.lit(" ")
    hit = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    text = F.coalesce("text", space)
    return (rows.select("conv_id", "turn", F.when(hit == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
                        F.when(hit == 1, "").when(hit == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
                        F.explode(F.array_repeat(F.lit(0), F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).cast("int"))))
            .drop("col"))


@query("op12_conversation_repair", REPAIR_SQL)
def op12(spark, sf_dir):
    from tidewater.llm import repair
    rows = _table(spark, sf_dir, "conversations")
    return repair.summaries(repair.repair(damaged(rows), rows))


# ------------------------------------------- 13 filter interaction audit
AUDIT_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, concat(
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END,
    CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
    CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 'C' ELSE '' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
    CASE WHEN d.doc_id > first THEN 'E' ELSE '' END) AS f
  FROM d JOIN firsts USING (t) LEFT JOIN known ON d.doc_id = known.doc_id),
cells AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY part, f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT x AS o FROM letters UNION ALL SELECT o || x FROM orders, letters WHERE NOT contains(o, x)),
steps AS (
  SELECT o, step, substr(o, step, 1) AS x, substr(o, 1, step - 1) AS before FROM orders, unnest([1, 2, 3, 4, 5]) u(step) WHERE length(o) = 5),
m AS (
  SELECT part, o, step, x, n, good, toxic, f = x AS alone, contains(f, x) AS hit, translate(f, before, '') <> f AS gone FROM cells, steps),
r AS (
  SELECT part, o AS filter_order, step::INTEGER AS step, x,
         coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM m GROUP BY part, o, step, x)
SELECT * EXCLUDE (x), (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM r
"""


@query("op13_filter_audit", AUDIT_SQL)
def op13(spark, sf_dir):
    from tidewater.llm import filteraudit
    return filteraudit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
