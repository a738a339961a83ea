"""The registered queries of the corpus operators: each applies one to its whole table.

Tables are read by Spark only; vocabulary files are read by path on every machine.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, filter_audit, fingerprints, jaccard, langid, mixing, packing, periodic, pii, token_counts, topk, url_filter, wrapper
from .common import table

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
VOCABULARY = "byte_bpe_50k.tiktoken"
PII_KEY = "surrogates-1"
WORD_VOCABULARY = "word_bpe_49k.json"


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_successors(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.replace_pii(table(spark, sf_dir, "documents"), PII_KEY)
    return out.select("doc_id", "text", F.aggregate(F.map_values("pii_types"), F.lit(0), lambda a, x: a + x).cast("long").alias("n_replaced"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_components(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.with_lengths(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return token_counts.histogram(lengths)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20, scale=64)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return out.select("doc_id", langid.in_test_fold().alias("held_out"), "lang_pred", "score")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, decoded="decoded")
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wrapper.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def planted_period(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text; of about one document in ten, from word a on, the first p words of that rest over and over."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"))
    h, n = F.crc32(F.col(doc_id).cast("string").cast("binary")), F.size(words)
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    changed = F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(changed, " ")).otherwise(F.col(text))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted_period().alias("text"))
    out = periodic.periodic_runs(docs)
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r.length).alias("shorter"), r.start.alias("start"), r.period.alias("period")))), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    out = out.select("doc_id", "runs", "collapsed", F.when(F.size("runs") > 0, longest).alias("top"), lines.alias("lines"))
    length = -F.col("top.shorter")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), length.alias("length"), F.col("top.period").alias("period"),
        F.floor(1000 * length / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(WORD_VOCABULARY))
    out = packing.pack(cut.select("doc_id", "piece", "start", "length", F.crc32("tokens").alias("ids_crc32")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_pii, op3_ngram_join, op4_mixing, op5_token_counts, op6_topk, op7_url_filter, op8_language_id, op9_bpe, op10_html, op11_periodic_runs, op12_packing, op13_filter_audit)}

ORACLE_SQL = {
    "op3_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]) END AS g FROM w),
n AS (SELECT r, doc_id, len(g) AS n FROM s),
e AS (SELECT r, unnest(g) AS t FROM s),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM e a JOIN e b ON a.t = b.t AND a.r <> b.r GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
c(x, y) AS (SELECT r, r FROM n UNION SELECT c.x, l.y FROM c JOIN l ON l.x = c.y),
least_id AS (SELECT c.x, min(n.doc_id) AS component_id FROM c JOIN n ON n.r = c.y GROUP BY c.x),
deg AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM n JOIN least_id ON least_id.x = n.r LEFT JOIN deg ON deg.x = n.r""",
    "op4_mixing": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
g AS (SELECT doc_id, source, size, count(*) AS rows, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS hash FROM d GROUP BY ALL),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM s0),
s2 AS (SELECT *, [1, 2, 3][1 + nth % 3]::BIGINT AS weight, 3 * source_size AS cap FROM s1),
s3 AS (SELECT *,
    sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS left_size,
    sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS left_weight
  FROM s2 WINDOW o AS (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, left_size * weight <= cap * left_weight AS free FROM s3),
lv AS (SELECT left_size AS ls, left_weight AS lw FROM s4 WHERE free ORDER BY cap / weight, nth LIMIT 1),
s5 AS (SELECT source, source_size,
    CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN free THEN (weight * ls)::DOUBLE / lw::DOUBLE ELSE cap::DOUBLE END AS target
  FROM s4 LEFT JOIN lv ON true),
s AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM s5),
q0 AS (SELECT g.*, s.source_size, s.target, s.whole, s.target - s.whole * s.source_size AS rest FROM g JOIN s ON g.source IS NOT DISTINCT FROM s.source),
q AS (SELECT *, CASE WHEN size <= rest THEN rows * size ELSE 0 END AS counted,
    sum(CASE WHEN size <= rest THEN rows * size ELSE 0 END) OVER (PARTITION BY source ORDER BY hash, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM q0),
f AS (SELECT *, CASE WHEN counted > 0 THEN greatest(0, least(rows, floor((rest - (upto - counted)) / size)))::BIGINT ELSE 0 END AS fits FROM q),
lk AS (SELECT source, any_value(rest) - sum(fits * size) AS lack FROM f GROUP BY source),
c AS (SELECT f.source, f.doc_id, f.size, row_number() OVER (PARTITION BY f.source ORDER BY abs(f.size - lack), hash, f.doc_id, f.size) AS k
  FROM f JOIN lk ON f.source IS NOT DISTINCT FROM lk.source WHERE fits < rows AND f.size > 0 AND abs(f.size - lack) < lack),
r AS (SELECT f.*, f.fits + CASE WHEN c.k IS NOT NULL THEN 1 ELSE 0 END AS more
  FROM f LEFT JOIN c ON c.k = 1 AND f.source IS NOT DISTINCT FROM c.source AND f.doc_id IS NOT DISTINCT FROM c.doc_id AND f.size = c.size),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) AS nth FROM d)
SELECT n.doc_id, n.size, r.source_size, r.target, (n.size * (r.whole + CASE WHEN n.nth <= r.more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM n JOIN r ON n.doc_id IS NOT DISTINCT FROM r.doc_id AND n.source IS NOT DISTINCT FROM r.source AND n.size = r.size""",
    "op6_topk": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         coalesce(list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op13_filter_audit": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
least_id AS (SELECT coalesce(text, '') AS text, min(doc_id) AS least FROM documents GROUP BY 1),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
f AS (
  SELECT w.part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
      + 4 * (100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 3 * length(w.text))::INT
      + 8 * regexp_matches(w.text, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > least, false)::INT AS bits,
    coalesce(good, 0) AS good, coalesce(bad, 0) AS bad
  FROM w JOIN least_id ON w.text = least_id.text LEFT JOIN marks ON marks.doc_id = w.doc_id),
g AS (SELECT part, bits, good, bad, count(*) AS n FROM f GROUP BY ALL),
o(filter_order, step, filter, before) AS (
  SELECT chr(65 + x::INT), 1, x::INT, 0 FROM range(5) t(x)
  UNION ALL
  SELECT filter_order || chr(65 + x::INT), step + 1, x::INT, before + (1 << filter) FROM o, range(5) t(x)
  WHERE step < 5 AND NOT contains(filter_order, chr(65 + x::INT))),
full_orders AS (SELECT filter_order, step, filter, before FROM o WHERE step = 5),
each AS (
  SELECT p.filter_order, o.step, o.filter, o.before FROM full_orders p JOIN o ON starts_with(p.filter_order, o.filter_order)),
c AS (
  SELECT part, before, filter,
    sum(CASE WHEN bits & (before | (1 << filter)) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN bits & (1 << filter) > 0 AND bits & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN bits & (1 << filter) > 0 AND bits & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN bits = 1 << filter THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN bits & (1 << filter) > 0 AND bits & before = 0 THEN n * good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN bits & (1 << filter) > 0 AND bits & before = 0 THEN n * bad ELSE 0 END)::BIGINT AS toxic_lost
  FROM g, (SELECT DISTINCT filter, before FROM o) GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM c JOIN each USING (filter, before)""",
}
