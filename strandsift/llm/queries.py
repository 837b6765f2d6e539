"""The registered queries of the operators in this subpackage: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audit import filter_audit
from .decontaminate import contamination
from .html import extract_main_text
from .langid import predict_languages
from .lm import language_model_scores
from .minhash import near_duplicates
from .mixing import mix_sources
from .quality_lines import quality_scores
from .quality_trees import quality_rules
from .sampling import crc_mod
from .substring import repeated_windows
from .tokens import token_counts
from .warc import round_trip
from .whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at a Jaccard similarity of 0.85 over five-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents replicated so that every source has the same expected number of rows, in shuffled order."""
    return mix_sources(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract_main_text(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from four fifths of them."""
    docs = table(spark, sf_dir, "documents")
    found = predict_languages(docs, crc_mod("doc_id", 5) != 0)
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents, learned from the labels of three quarters of the ids."""
    found = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a passage of a benchmark item with a fifth of its tokens changed at most."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document statistics, the base rule, and the verdict of trees fitted on labels.quality."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in 50-word windows that a document with a smaller doc_id has, removed."""
    return repeated_windows(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents under a public vocabulary of 32,000 pieces."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of all documents, learned from six sevenths of them."""
    scores = language_model_scores(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2)
    return scores.select("doc_id", F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from all documents in each of their 120 orders, by source."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as a WARC archive and read back; equal payloads of any size are revisits."""
    return round_trip(table(spark, sf_dir, "pages"), least_bytes=0)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings projected on the first four whitened components."""
    return whiten(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", 4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_source_mixing": op2_source_mixing,
    "op3_html_extraction": op3_html_extraction,
    "op4_language_id": op4_language_id,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_quality_rules": op7_quality_rules,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_language_model": op10_language_model,
    "op11_filter_audit": op11_filter_audit,
    "op12_warc": op12_warc,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), pos AS (
  SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0
), sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM pos
), size AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), both_ AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
), link AS MATERIALIZED (
  SELECT a, b FROM both_ JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)
), edge AS MATERIALIZED (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), walk AS (
  SELECT doc_id AS start, doc_id AS node FROM documents
  UNION
  SELECT walk.start, edge.b FROM walk JOIN edge ON edge.a = walk.node
), least_ AS (
  SELECT start, min(node) AS component FROM walk GROUP BY start
)
SELECT d.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, least_.component AS component_id, d.doc_id = least_.component AS kept
FROM documents d LEFT JOIN size ON size.doc_id = d.doc_id LEFT JOIN least_ ON least_.start = d.doc_id
""",
    "op8_substring_dedup": r"""
WITH w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS MATERIALIZED (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
), first_ AS (
  SELECT h, min(doc_id) AS lo FROM win GROUP BY h
), gone AS (
  SELECT DISTINCT win.doc_id, i + k AS p FROM win JOIN first_ ON win.h = first_.h AND first_.lo < win.doc_id, range(0, 50) AS r(k)
), word AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS x FROM w
), kept AS (
  SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS t, count(*) AS n FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p
  WHERE gone.p IS NULL GROUP BY word.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
""",
    "op2_source_mixing": r"""
WITH RECURSIVE rates AS (
  SELECT source, (sum(count(*)) OVER ()) * 1.0::DOUBLE / ((count(*) OVER ()) * count(*)) AS rate FROM documents GROUP BY source
), cut AS (
  SELECT source, greatest(1.0, ceil(rate / 16.0))::INTEGER AS parts, rate / greatest(1.0, ceil(rate / 16.0))::INTEGER AS each FROM rates
), steps AS (
  SELECT source, parts, each, 0 AS k, exp(-each) AS p, exp(-each) AS c FROM cut
  UNION ALL
  SELECT source, parts, each, k + 1, p * each / (k + 1), c + p * each / (k + 1) FROM steps WHERE k < 79
), draws AS (
  SELECT d.doc_id, d.source, i, CAST('0x' || substr(md5('17:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null:' || md5(coalesce(d.text, ''))) || ':' || i), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM (SELECT DISTINCT doc_id, source, text FROM documents) d JOIN cut ON cut.source IS NOT DISTINCT FROM d.source, LATERAL (SELECT unnest(range(1, cut.parts + 1)) AS i)
), times AS (
  SELECT draws.doc_id, CAST(count(*) AS INTEGER) AS n FROM draws JOIN steps ON steps.source IS NOT DISTINCT FROM draws.source AND steps.c <= draws.u GROUP BY draws.doc_id
)
SELECT d.*, CAST(r.copy AS INTEGER) AS copy, md5('17:order:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null:' || md5(coalesce(d.text, ''))) || ':' || r.copy) AS shuffle_key
FROM documents d JOIN times ON times.doc_id IS NOT DISTINCT FROM d.doc_id, LATERAL (SELECT unnest(range(1, times.n + 1)) AS copy) r
""",
    "op11_filter_audit": r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), least_ AS (
  SELECT t, min(doc_id) AS lo FROM w GROUP BY t
), lab AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), fl AS MATERIALIZED (
  SELECT w.part, coalesce(lab.good, false) AS good, coalesce(lab.toxic, false) AS toxic,
    {'A': len(ws) < 50, 'B': 100 * len(list_distinct(ws)) < 65 * len(ws), 'C': 100 * length(regexp_replace(w.t, '[^A-Z]+', '', 'g')) > 5 * length(w.t),
     'D': regexp_matches(w.t, '[#$%&*|]'), 'E': coalesce(least_.lo < w.doc_id, false)} AS f
  FROM w JOIN least_ ON least_.t = w.t LEFT JOIN lab ON lab.doc_id = w.doc_id
), one AS MATERIALIZED (
  SELECT part, good, toxic, MAP {'A': f.A, 'B': f.B, 'C': f.C, 'D': f.D, 'E': f.E} AS f, f.A::INT + f.B::INT + f.C::INT + f.D::INT + f.E::INT AS fails, count(*) AS n FROM fl GROUP BY ALL
), x(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS o FROM x a, x b, x c, x d, x e
  WHERE a.l NOT IN (b.l, c.l, d.l, e.l) AND b.l NOT IN (c.l, d.l, e.l) AND c.l NOT IN (d.l, e.l) AND d.l <> e.l
), first_ AS (
  SELECT one.*, o, CASE WHEN f[o[1]] THEN 1 WHEN f[o[2]] THEN 2 WHEN f[o[3]] THEN 3 WHEN f[o[4]] THEN 4 WHEN f[o[5]] THEN 5 ELSE 6 END AS at_ FROM one, orders
), s AS (
  SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, o[step] AS l,
    coalesce(sum(n) FILTER (WHERE at_ > step), 0) AS kept, coalesce(sum(n) FILTER (WHERE at_ = step), 0) AS removed, coalesce(sum(n) FILTER (WHERE f[o[step]] AND at_ < step), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE f[o[step]] AND fails = 1), 0) AS unique_fails, coalesce(sum(n) FILTER (WHERE at_ = step AND good), 0) AS good_lost, coalesce(sum(n) FILTER (WHERE at_ = step AND toxic), 0) AS toxic_lost
  FROM first_, range(1, 6) AS r(step) GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley
FROM s
""",
    "op12_warc": r"""
WITH p AS MATERIALIZED (
  SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS hex FROM pages
), b32 AS MATERIALIZED (
  SELECT hex, array_to_string(list_transform(range(0, 4), lambda g: array_to_string(list_transform(range(0, 8), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(10 * g AS INTEGER) + 1, 10) AS BIGINT) >> CAST(35 - 5 * j AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '')), '') AS digest FROM (SELECT DISTINCT hex FROM p)
), f AS (
  SELECT hex, min(page_id) AS lo FROM p GROUP BY hex
)
SELECT p.page_id, p.n AS payload_bytes, b32.digest AS payload_digest, CASE WHEN f.lo < p.page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN f.lo < p.page_id THEN f.lo END AS refers_to, p.url
FROM p JOIN b32 ON b32.hex = p.hex JOIN f ON f.hex = p.hex
""",
}
