"""The registered query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import toxicity
from quire.llm.common import held_out
from quire.llm.embedding_dedup import dedup_embeddings
from quire.llm.jaccard_join import link_documents
from quire.llm.language_id import predict_languages
from quire.llm.mixing import mix_sources
from quire.llm.pii import find_personal_data
from quire.llm.quality import judge_documents
from quire.llm.sentencepiece_codec import load_model, recode_documents
from quire.llm.sharding import shard_documents
from quire.llm.url_filter import filter_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op1_url_filter"] = r"""
WITH rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
cut AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', ['host', 'path']) AS c FROM pages),
urls AS (SELECT page_id, translate(c.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, c.path AS path FROM cut)
SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, coalesce(r.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN LATERAL (
  SELECT * FROM rules WHERE (u.host = rules.host OR suffix(u.host, '.' || rules.host)) AND prefix(u.path, rules.path)
  ORDER BY length(rules.host || rules.path) DESC, length(rules.host) DESC LIMIT 1) r ON true
"""


@_query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"), shards=8)


def tokenizer_path() -> str:
    """The model file: ``QUIRE_PIECE_MODEL``, else that of the installed public tokenizers."""
    if path := os.environ.get("QUIRE_PIECE_MODEL"):
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@_query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text (U+2581 aside, which stands for a blank)."""
    model = load_model(tokenizer_path())
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    back = recode_documents(docs, model)
    same = F.col("decoded").eqNullSafe(F.translate("text", "\u2581", " "))
    return back.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


@_query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels)
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@_query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_table(spark, sf_dir, "documents")).drop("all_spans")


@_query
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weigh the square root of their sizes; as many documents come out as go in, on average."""
    out = mix_sources(_table(spark, sf_dir, "documents"), temperature=0.5)
    return out.select("doc_id", "source", "text", F.round("rate", 6).alias("rate"), "n_copies", "copy", "shuffle_key")


ORACLES["op7_source_mixing"] = r"""
WITH RECURSIVE s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT sum(n) AS docs, sum(sqrt(n)) AS weights FROM s),
r AS (SELECT source, sqrt(n) * docs / weights / n AS rate FROM s, t),
p(source, rate, k, lp, below) AS (
  SELECT source, rate, 0, -rate, exp(-rate) FROM r
  UNION ALL SELECT source, rate, k + 1, lp + ln(rate) - ln(k + 1), below + exp(lp + ln(rate) - ln(k + 1)) FROM p WHERE k < 200),
steps AS (SELECT source, list(least(below, 1.0)) AS steps FROM p GROUP BY source),
u AS (SELECT d.*, '0' || chr(31) || coalesce(doc_id::VARCHAR, '') AS key FROM documents d),
c AS (
  SELECT u.doc_id, u.source, u.text, u.key, r.rate, len(list_filter(steps, lambda x: x <= ('0x' || substr(md5(key), 1, 13))::BIGINT / 4503599627370496.0)) AS n
  FROM u JOIN r ON u.source IS NOT DISTINCT FROM r.source JOIN steps ON u.source IS NOT DISTINCT FROM steps.source)
SELECT doc_id, source, text, round(rate, 6) AS rate, n::INT AS n_copies, copy::INT AS copy, md5(key || chr(31) || copy || chr(31) || 'place') AS shuffle_key
FROM (SELECT *, unnest(range(n)) AS copy FROM c)
"""


@_query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


@_query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_documents(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLES["op9_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT k, i, array_to_string(ws[i : i + 7], ' ') AS s FROM (SELECT k, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS n FROM win) WHERE n > 1),
cover AS (SELECT k, count(DISTINCT i + j) AS n_repeat FROM twice, range(8) r(j) GROUP BY k),
lines AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT k, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY k),
f AS (
  SELECT d.k, d.doc_id, d.source, len(w.ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (k) LEFT JOIN cover USING (k) LEFT JOIN lines USING (k)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
r AS (SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines AS rule_failed FROM b),
h AS (SELECT source, count(*) AS n, sum(rule_failed::INT) AS bad FROM r GROUP BY source),
m AS (SELECT least(greatest(avg(bad / n), 0.001), 0.999) AS mean, var_pop(bad / n) AS var FROM h),
p AS (SELECT mean, CASE WHEN var > 0 AND mean * (1 - mean) / var - 1 > 0 THEN mean * (1 - mean) / var - 1 ELSE 20 END AS size FROM m),
v AS (SELECT source, (bad + mean * size) / (n + size) AS failure FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failure <= 0.5 AS kept
FROM r LEFT JOIN v ON r.source IS NOT DISTINCT FROM v.source
"""


@_query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(_table(spark, sf_dir, "documents"), k=4, percent=85)


ORACLES["op4_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT k, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) END) AS g FROM d),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
p AS (SELECT a.k AS x, b.k AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.k < b.k GROUP BY a.k, b.k),
l AS (SELECT x, y FROM p JOIN n i ON i.k = x JOIN n j ON j.k = y WHERE 100 * c >= 85 * (i.n + j.n - c)),
u AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(node, label) USING KEY (node) AS (SELECT k, doc_id FROM d UNION (
  SELECT u.y, min(r.label) FROM r JOIN u ON u.x = r.node JOIN recurring.r AS old ON old.node = u.y WHERE r.label < old.label GROUP BY u.y))
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.label AS component_id FROM d JOIN r ON r.node = d.k LEFT JOIN n ON n.k = d.k
"""


@_query
def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_embeddings(_table(spark, sf_dir, "embeddings"), threshold=0.93)


ORACLES["op10_embedding_dedup"] = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(node, label) USING KEY (node) AS (SELECT vec_id, vec_id FROM embeddings UNION (
  SELECT u.y, min(r.label) FROM r JOIN u ON u.x = r.node JOIN recurring.r AS old ON old.node = u.y WHERE r.label < old.label GROUP BY u.y))
SELECT e.vec_id, (SELECT count(*) FROM u WHERE u.x = e.vec_id)::BIGINT AS n_links, r.label AS component_id, r.label = e.vec_id AS kept FROM embeddings e JOIN r ON r.node = e.vec_id
"""
