"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flowlake.llm.centroids import CLUSTERS, DIMS, ROUNDS, SCALE, clusters
from flowlake.llm.common import documents
from flowlake.llm.decontamination import passages
from flowlake.llm.jaccard import similar
from flowlake.llm.language import languages
from flowlake.llm.minmax import near_copies
from flowlake.llm.mixing import mix
from flowlake.llm.phrases import repeated_passages
from flowlake.llm.pii import personal_data
from flowlake.llm.quality import quality
from flowlake.llm.ranked import search
from flowlake.llm.secrets import secrets
from flowlake.llm.token_counts import token_counts
from flowlake.llm.token_ids import token_files

TOKENIZER = "byte_bpe_50k.json"


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(documents(spark, sf_dir))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(documents(spark, sf_dir))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_source_mixing, op2_ngram_jaccard, op3_decontamination, op4_token_files, op5_secret_scan, op6_quality_rules, op7_substring_dedup,
        op8_token_counts, op9_language, op10_personal_data, op11_minhash_near_dedup, op12_ranked_search, op13_centroid_clustering)}
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _links_sql(k: int) -> str:
    """Sets of k-word shingles, links of 80 per cent, and what they join."""
    return f"""
WITH RECURSIVE cut AS (SELECT doc_id, coalesce({_WORDS.format(_LOWER)}, []) AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {k} THEN [array_to_string(w[i:i + {k - 1}], ' ') for i in range(1, len(w) - {k - 2})]
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM cut),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT h.a, h.b, h.n = x.n AND h.n = y.n AS equal FROM shared h JOIN sizes x ON x.doc_id = h.a JOIN sizes y ON y.doc_id = h.b
  WHERE 100 * h.n >= 80 * (x.n + y.n - h.n)),
two_way AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT d, b FROM reach JOIN two_way ON a = r),
classes AS (SELECT b AS doc_id, min(a) AS c FROM links WHERE equal GROUP BY b),
parts AS (SELECT d, min(r) AS c FROM reach GROUP BY d)"""


def _clusters_sql(k: int, rounds: int) -> str:
    """Centroids round by round, each a table of its own."""
    away = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(p.v, c.v)])::BIGINT"
    near = f"SELECT id, vec_id, arg_min(c.k, ({away}, c.k)) AS k, min({away}) AS d FROM points p, c{{i}} c GROUP BY id, vec_id"
    steps = [f"""a{i} AS MATERIALIZED ({near.format(i=i)}),
x{i} AS MATERIALIZED (SELECT a{i}.k, unnest(v) AS x, unnest(range({DIMS})) AS pos FROM a{i} JOIN points USING (id)),
m{i} AS MATERIALIZED (SELECT k, list(x ORDER BY pos) AS v FROM (SELECT k, pos, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM x{i} GROUP BY k, pos) GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (k))""" for i in range(rounds)]
    return f"""
WITH points AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = {DIMS}),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INTEGER AS k, v
                    FROM (SELECT v, sha256('3:' || vec_id) AS h FROM points ORDER BY h LIMIT {k})),
{", ".join(steps)},
final AS MATERIALIZED ({near.format(i=rounds)})
SELECT vec_id, k AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM final JOIN c{rounds} USING (k)"""


ORACLES: dict[str, str] = {
    "op12_ranked_search": rf"""
WITH cut AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS t FROM documents),
sizes AS (SELECT doc_id, len(t) AS n FROM cut WHERE len(t) > 0),
whole AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS t FROM cut) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY t),
m AS (SELECT doc_id, 50 + (50 * n * n_docs) // n_terms AS m FROM sizes, whole),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS t FROM benchmark),
scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
           FROM asked JOIN tf USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50""",
    "op13_centroid_clustering": _clusters_sql(CLUSTERS, ROUNDS),
    "op2_ngram_jaccard": f"""{_links_sql(5)}
SELECT t.doc_id, coalesce(s.n, 0) AS n_shingles, p.c AS component_id, coalesce(k.c, t.doc_id) AS class_id
FROM documents t LEFT JOIN sizes s USING (doc_id) LEFT JOIN classes k USING (doc_id) JOIN parts p ON p.d = t.doc_id""",
    "op11_minhash_near_dedup": f"""{_links_sql(2)}
SELECT t.doc_id, coalesce(s.n, 0) AS n_shingles, p.c AS component_id, t.doc_id = p.c AS kept, coalesce(k.c, t.doc_id) AS class_id
FROM documents t LEFT JOIN sizes s USING (doc_id) LEFT JOIN classes k USING (doc_id) JOIN parts p ON p.d = t.doc_id""",
    "op7_substring_dedup": f"""
WITH cut AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
runs AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM cut)),
firsts AS (SELECT h, min(doc_id) AS f FROM runs GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + j AS place FROM runs JOIN firsts USING (h), range(50) r(j) WHERE f < doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM cut),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS k FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM cut LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
