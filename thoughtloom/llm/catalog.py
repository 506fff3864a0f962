"""Registered queries of the operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thoughtloom.llm import byte_bpe, collocations, host_rules, kneser_ney, line_dedup, packing, secret_scan, simhash, substring_dedup, syncmers, top_k, url_filter, whitening
from thoughtloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(run):
    QUERIES[run.__name__] = run
    return run


@_query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = byte_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return byte_bpe.decode(tokens, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@_query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@_query
def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", *host_rules.FEATURES, "base_failed", "kept"
    )


#: Fixed values of the query: action, host, start of the path.
LISTED = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@_query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    labelled = pages.select("page_id", "url").join(labels, F.col("page_id") == F.col("doc_id"))
    blocked = (F.col("quality") == 0) | (F.col("toxic") == 1)
    rules = url_filter.mine(labelled.select("url", blocked.alias("blocked")))
    return url_filter.judge(pages, LISTED, rules).drop("confidence")


@_query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = kneser_ney.held_out(F.col("doc_id"))
    model = kneser_ney.train(docs.where(~out))
    return kneser_ney.score(docs, model).select(
        "doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@_query
def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


# Row by row against all others: the plain form of the same question.
ORACLES["op10_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id
),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@_query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.forest_for(docs))
    return found.select("doc_id", "start", "length", F.sha2("text", 256).alias("text_sha256"), "score", "secret")


@_query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "lines.n_lines", "lines.n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op7_host_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
),
pos AS (SELECT k, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w),
times AS (SELECT k, i, count(*) OVER (PARTITION BY k, words[i], words[i + 1], words[i + 2]) AS n FROM pos),
covered AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM times WHERE n > 1) GROUP BY k),
f AS (
  SELECT doc_id, host, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (k)
),
j AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_words AS own_failed
  FROM f
),
h AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE base_failed OR own_failed) AS f FROM j WHERE host IS NOT NULL GROUP BY host),
p AS (SELECT avg(f / n) AS m, var_pop(f / n) - avg(f / n) * (1 - avg(f / n)) * avg(1 / n) AS v, avg(n) AS size FROM h),
q AS (SELECT m, CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 0) ELSE size END AS weight FROM p),
bad AS (SELECT host FROM h, q WHERE (f + weight * m) / (n + weight) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR own_failed OR (host IS NOT NULL AND host IN (SELECT host FROM bad))) AS kept
FROM j
"""


@_query
def op11_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare(table(spark, sf_dir, "documents"))


@_query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@_query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op13_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS piece
  FROM documents
),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
grams AS (
  SELECT lang, size, array_to_string(words[i : i + size - 1], ' ') AS phrase
  FROM (SELECT lang, size, words, unnest(range(1, len(words) - size + 2)) AS i FROM w, (VALUES (1), (2), (3)) s(size) WHERE len(words) >= size)
),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS p, f AS a FROM f WHERE size > 1),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(p[1 : k], ' ') AS head, array_to_string(p[k + 1 :], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c)
),
s AS (
  SELECT cuts.lang, cuts.phrase, a, k, h.f AS l, t.f AS r, ((1000000::HUGEINT * a * a) // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = cuts.head JOIN f t ON t.lang = cuts.lang AND t.phrase = cuts.tail
),
lowest AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, p[1] || ' ' || p[2] AS phrase, a FROM c WHERE size = 3
  UNION ALL SELECT lang, p[2] || ' ' || p[3], a FROM c WHERE size = 3
),
longest AS (SELECT lang, phrase, max(a) AS b FROM inside GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n, score
FROM lowest LEFT JOIN longest USING (lang, phrase) JOIN totals USING (lang)
WHERE coalesce(100 * b < 50 * a, true)
QUALIFY rank <= 2000
"""
