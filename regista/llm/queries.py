"""The registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regista.llm import bpe, collocations, line_dedup, mil_classifier, ngram_join, packing, pii, quality_rules, resampling, sharding, suffix_dedup, topk, warc
from regista.llm.common import read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


#: Secret of the surrogates; a deployment sets its own.
PII_KEY = b"regista surrogates"


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return pii.pseudonymise(docs, PII_KEY).select("doc_id", "text", "n_found")


def op3_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.usable(read(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("id % 50 = 0"), 5)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(read(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_decode(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"))
    return sharding.place(docs, "doc_id", [f"shard-{k:04d}" for k in range(256)])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return line_dedup.strip_runs(docs, min_words=50)


_WORDS = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[^\x20\x09-\x0D\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]+"
OP7_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS pos, len(regexp_extract_all(line, '$WORDS')) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT doc_id, pos, line AS a, lead(line) OVER o AS b, lead(line, 2) OVER o AS c, n, n + lead(n) OVER o AS n2 FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
f AS (
  SELECT doc_id, pos, 3 AS size, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS copy FROM w WHERE c IS NOT NULL
  UNION ALL SELECT doc_id, pos, 2, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, pos) FROM w WHERE n2 >= 50
  UNION ALL SELECT doc_id, pos, 1, row_number() OVER (PARTITION BY a ORDER BY doc_id, pos) FROM w WHERE n >= 50),
g AS (SELECT DISTINCT doc_id, pos + unnest(range(size)) AS pos FROM f WHERE copy > 1),
x AS (SELECT s.doc_id, s.pos, s.line_no, s.pos - row_number() OVER (PARTITION BY s.doc_id ORDER BY s.pos) AS run FROM s JOIN g ON s.doc_id = g.doc_id AND s.pos = g.pos),
n AS (SELECT doc_id, count(*) AS n_removed, count(DISTINCT run) AS n_runs FROM x GROUP BY doc_id),
t AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.line_no) AS text FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.line_no = x.line_no WHERE x.doc_id IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text,
  CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
""".replace("$WORDS", _WORDS)


def op8_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil_classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "quality"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
f AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE m > 1 AND f >= 100),
i AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(w[s:s + k - 1], ' ') AS phrase
    FROM (SELECT lang, a, w, k, unnest(range(1, m - k + 2)) AS s FROM (SELECT lang, a, w, m, unnest(range(2, m)) AS k FROM c))) GROUP BY ALL),
k AS (SELECT c.*, unnest(range(1, m)) AS k FROM c LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
s AS (
  SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, n.n,
    (CAST(1000 AS HUGEINT) * k.a * n.n) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1:k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k + 1:], ' ') JOIN n ON n.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 2000
"""


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, read(spark, sf_dir, "pages")).drop("url")


OP13_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.h AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON f.h = p.h AND n >= 100
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_quality_rules, op2_pii_surrogates, op3_maxscore_topk, op4_suffix_dedup, op5_byte_bpe, op6_sharding, op7_line_dedup, op8_pattern_packing, op9_mil_quality, op10_ngram_join)
    return {f.__name__: f for f in (*found, op11_resampling, op12_collocations, op13_warc)}


def oracle_sql() -> dict[str, str]:
    return {"op3_maxscore_topk": OP3_SQL, "op7_line_dedup": OP7_SQL, "op12_collocations": OP12_SQL, "op13_warc": OP13_SQL}
