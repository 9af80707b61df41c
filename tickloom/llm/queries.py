"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive_ann, centroids, chat_format, embedding_dedup, lang_id, license_scan, ngram_join, packing, quality, secrets, sentencepiece_codec, spelling, url_filter
from .common import table

try:
    import public_tokenizers

    PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
except ImportError:  # callers name their own files
    PIECES = BYTES = None


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.decode(sentencepiece_codec.encode(table(spark, sf_dir, "documents"), PIECES), PIECES)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.xxhash64("begins", "ends").alias("spans_hash"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels"))).select("doc_id", *quality.COUNTS, "base_failed", "kept", "content_words")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op7_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_ann.search(table(spark, sf_dir, "embeddings"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.find(docs, secrets.train(docs)))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTES)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "documents"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_url_filters, op2_ngram_join, op3_sentencepiece, op4_chat_format, op5_quality_rules, op6_license_scan, op7_additive_ann, op8_secret_scan, op9_best_fit_packing, op10_language_id, op11_embedding_dedup, op12_centroids, op13_spelling, pipeline)
    return {f.__name__: f for f in own}


#: op2 by joining all pairs of sets that share a shingle, and walking the links from every set: for test sizes.
_CLASSES = """WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END)) AS s FROM docs),
own AS (SELECT s, row_number() OVER () AS k, len(s) AS n, min(doc_id) AS first FROM sets WHERE len(s) > 0 GROUP BY s), parts AS (SELECT k, n, unnest(s) AS g FROM own),
met AS (SELECT a.k AS a, b.k AS b, a.n + b.n AS n, count(*) AS c FROM parts a JOIN parts b ON a.g = b.g AND a.k <> b.k AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL), links AS (SELECT a, b FROM met WHERE 100 * c >= 80 * (n - c)),
reach AS (SELECT k AS a, k AS b FROM own UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b), least AS (SELECT r.a AS k, min(o.first) AS c FROM reach r JOIN own o ON o.k = r.b GROUP BY r.a)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(least.c, sets.doc_id) AS component_id FROM sets LEFT JOIN own ON own.s = sets.s LEFT JOIN least ON least.k = own.k"""


_GOOD = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

#: op11 by the cosines of all pairs of a label, and walking the links from every vector: for test sizes.
_NEAR = f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings WHERE label IS NOT NULL AND {_GOOD} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT *, sqrt(list_sum(list_transform(x, lambda c: c * c))) AS n FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_inner_product(a.x, b.x) / (a.n * b.n) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(counts.n, 0) AS n_links, least.c AS component_id, e.vec_id = least.c AS kept FROM embeddings e JOIN least ON least.a = e.vec_id LEFT JOIN counts ON counts.a = e.vec_id"""


def _lloyd(k: int = 8, rounds: int = 10) -> str:
    """op12, each round two expressions: the least of distance * k + cluster per vector, and floors of means."""
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = 64 AND {_GOOD}),
p AS MATERIALIZED (SELECT vec_id, unnest(x) AS x, unnest(range(64)) AS i FROM v),
s AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, x FROM v), c0 AS MATERIALIZED (SELECT k, unnest(x) AS x, unnest(range(64)) AS i FROM s WHERE k < {k})"""]
    for r in range(rounds + 1):
        steps.append(f"d{r} AS (SELECT vec_id, k, CAST(sum((p.x - c.x) * (p.x - c.x)) AS BIGINT) AS d FROM p JOIN c{r} c ON c.i = p.i GROUP BY vec_id, k), a{r} AS MATERIALIZED (SELECT vec_id, min(d * {k} + k) % {k} AS k, min(d * {k} + k) // {k} AS d FROM d{r} GROUP BY vec_id)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT a.k, p.i, CAST(sum(p.x) AS BIGINT) AS s, count(*) AS n FROM a{r} a JOIN p ON p.vec_id = a.vec_id GROUP BY a.k, p.i), c{r + 1} AS MATERIALIZED (SELECT c.k, c.i, CASE WHEN m.n IS NULL THEN c.x ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS x FROM c{r} c LEFT JOIN m{r} m ON m.k = c.k AND m.i = c.i)")
    return f"""WITH {", ".join(steps)}, h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY k), t AS (SELECT k, sum(d) AS t FROM a{rounds} GROUP BY k), z AS (SELECT sum(d) AS z FROM a{rounds})
SELECT a.vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance, CAST(t.t AS BIGINT) AS cluster_inertia, CAST(z.z AS BIGINT) AS inertia, h.h AS centroid_sha256 FROM a{rounds} a JOIN t ON t.k = a.k JOIN h ON h.k = a.k, z"""


def oracle_sql() -> dict[str, str]:
    """SQL for op2, op11 and op12. The others' learned verdicts and predictions, tokens, spans, searches and linked calls are no SQL here; the tests hold brute-force versions."""
    return {"op2_ngram_join": _CLASSES, "op11_embedding_dedup": _NEAR, "op12_centroids": _lloyd()}
