"""The queries opN_<name>, one for each operator of this subpackage, with DuckDB SQL where SQL can express the result."""

from __future__ import annotations

import public_tokenizers

from docspark.llm import decontam, licenses, merkle, near_dedup, piece, quality, records, token_counts, toxicity, url_filter
from docspark.llm.common import table
from docspark.operators.lineage import spread


def texts(spark, sf_dir):
    """The documents for operators in Python: dealt over the cores where their files give fewer partitions than these."""
    return spread(table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(texts(spark, sf_dir))


def op1_toxicity(spark, sf_dir):
    docs = texts(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit_on(docs, table(spark, sf_dir, "labels")))


def op3_benchmark_decontamination(spark, sf_dir):
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_license_scans(spark, sf_dir):
    return licenses.scan(texts(spark, sf_dir))


def op5_token_counts(spark, sf_dir):
    return token_counts.counts(texts(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_token_records(spark, sf_dir):
    return records.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_document_fingerprints(spark, sf_dir):
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark, sf_dir):
    return piece.digests(texts(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op9_url_filters(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_quality_classifier(spark, sf_dir):
    docs = texts(spark, sf_dir)
    return quality.score(docs, quality.fit_on(docs, table(spark, sf_dir, "labels")))


def queries():
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    found["pipeline"] = pipeline
    return found


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w),
x AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS u, doc_id AS v FROM s UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, m.c AS component_id, m.c = s.doc_id AS kept
FROM s JOIN (SELECT u, min(v) AS c FROM reach GROUP BY u) m ON m.u = s.doc_id
"""


OP9_SQL = r"""
WITH r(rule, rhost, rpath, verdict) AS (VALUES
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p)
SELECT page_id, host, path, max_by(rule, length(rule)) AS rule, coalesce(max_by(verdict, length(rule)), 'allow') AS verdict
FROM h LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
GROUP BY page_id, host, path
"""


#: Documents and items that share a shingle, and then each window of the item's size: only these can match.
OP3_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
i AS (SELECT item_id, k, list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' ')) AS item
  FROM (SELECT *, least(5, len(w)) AS k FROM iw WHERE len(w) > 0)),
d AS (SELECT doc_id, k, list_transform(range(1, greatest(len(w) - k, 0) + 2), lambda p: array_to_string(w[p:p + k - 1], ' ')) AS own
  FROM dw, (SELECT DISTINCT k FROM i) WHERE len(w) > 0),
x AS (SELECT doc_id, k, unnest(own) AS h FROM d), y AS (SELECT item_id, k, unnest(item) AS h FROM i),
pairs AS (SELECT DISTINCT doc_id, item_id, k FROM x JOIN y USING (k, h)),
places AS (SELECT p.doc_id, p.item_id, own, item, unnest(range(0, greatest(len(own) - len(item), 0) + 1)) AS start
  FROM pairs p JOIN d ON d.doc_id = p.doc_id AND d.k = p.k JOIN i ON i.item_id = p.item_id),
windows AS (SELECT doc_id, item_id, start, item, own[start + 1:start + len(item)] AS win FROM places),
near AS (SELECT * FROM windows WHERE list_has_any(win, item)),
told AS (SELECT doc_id, item_id, start, len(win) + len(item) AS total,
  CAST(list_sum(list_transform(list_intersect(win, item), lambda h: least(len(list_filter(win, lambda v: v = h)), len(list_filter(item, lambda v: v = h))))) AS INT) AS shared FROM near),
good AS (SELECT doc_id, item_id, CAST(start AS INT) AS start, shared, shared / (total - shared) AS similarity FROM told WHERE 100 * shared >= 75 * (total - shared))
SELECT doc_id, item_id, start, shared, similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, shared DESC, start) AS best FROM good) WHERE best = 1
"""


def oracle_sql():
    return {"op2_minhash_near_dedup": OP2_SQL, "op3_benchmark_decontamination": OP3_SQL, "op9_url_filters": OP9_SQL}
