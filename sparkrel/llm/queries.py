"""The queries opN_<name> over the fixture tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embedding_dedup, jaccard_join, packing, secret_scan, sharding, suffix_dedup, token_counts, toxicity, url_filter
from .shared import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table; long texts are spread over all cores even if they are one file's only row group."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name == "documents" else found


def vocabulary(name: str) -> str:
    """A public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Shards of op5: small enough that every fixture splits.
SHARD_BYTES = 1 << 20


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark, table(spark, sf_dir, "pages"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(spark, table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), limit=SHARD_BYTES)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(spark, table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_url_filter, op3_jaccard_join, op4_embedding_dedup, op5_sharding, op6_secret_scan, op7_decontamination, op8_suffix_dedup, op9_packing, op10_token_counts)
}

#: The smallest id that links lead to, for every id of ``ids`` under the links ``e`` (both ways).
REACHED = """r(id, low) AS (SELECT {id}, {id} FROM {ids} UNION SELECT e.y, r.low FROM r JOIN e ON e.x = r.id WHERE r.low < e.y),
  c AS (SELECT id, min(low) AS component_id FROM r GROUP BY id)"""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
  e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
  {REACHED.format(id="doc_id", ids="documents")}
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents JOIN c ON id = doc_id LEFT JOIN n USING (doc_id)"""

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
  b AS (SELECT item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
  m AS (SELECT DISTINCT item_id, least(13, len(ws)) AS m, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS win FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
  l AS (SELECT DISTINCT m FROM m),
  x AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS win FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d CROSS JOIN l WHERE len(ws) >= m)),
  h AS (SELECT doc_id, item_id, x.m, i FROM x JOIN m ON x.m = m.m AND x.win = m.win),
  k AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id),
  t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
  e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
  {REACHED.format(id="vec_id", ids="embeddings")}
SELECT vec_id, (SELECT count(*) FROM e WHERE x = vec_id) AS n_links, component_id, component_id = vec_id AS kept FROM embeddings JOIN c ON id = vec_id"""

REPEATS = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS x FROM documents),
  w AS (SELECT doc_id, i, md5(b[i:i + 99]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 98)) AS i FROM d WHERE octet_length(b) >= 100)),
  f AS (SELECT h, min({'d': doc_id, 'i': i}) AS f FROM w GROUP BY h HAVING count(*) > 1),
  g AS (SELECT doc_id, i FROM w JOIN f USING (h) WHERE doc_id <> f.d OR i <> f.i),
  n AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM g),
  r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n),
  s AS (SELECT doc_id, min(i) - 1 AS lo, max(i) + 99 AS hi FROM r GROUP BY doc_id, run),
  p AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since FROM s),
  k AS (SELECT doc_id, string_agg(substr(x, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) || substr(any_value(x), 2 * max(hi) + 1) AS kept, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""

ORACLE: dict[str, str] = {"op2_url_filter": url_filter.sql(), "op3_jaccard_join": JACCARD, "op4_embedding_dedup": EMBEDDINGS, "op5_sharding": sharding.sql(SHARD_BYTES), "op6_secret_scan": secret_scan.sql(), "op7_decontamination": DECONTAMINATION, "op8_suffix_dedup": REPEATS}
