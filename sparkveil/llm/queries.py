"""The thin queries over the driver's tables, one for each operator, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import embeddings, html, langid, linededup, mixing, packing, sharding, simhash, sketch, substring


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), words=4, radius=4)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), temperature=0.5, total=1.0, seed="mix")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(table(spark, sf_dir, "documents"), radius=linededup.WIDE, few=linededup.SPARE).select("doc_id", "n_removed", "text")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.substring_dedup(table(spark, sf_dir, "documents"), window=13)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.fold())
    filters = langid.fit(docs.where("not held_out"))
    done = langid.identify(docs.select("doc_id", "text", "held_out"), filters)
    return done.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sharding.reshard(table(spark, sf_dir, "documents"), shards=24, old_shards=16)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), length=4096)


def op9_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited_fingerprints(table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = html.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return done.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def queries():
    return {f.__name__: f for f in (op1_simhash, op2_mixing, op3_line_dedup, op4_substring, op5_embeddings, op6_language, op7_sharding, op8_packing, op9_sketch, op10_html)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.mix_sql(), "op4_substring": SUBSTRING_SQL, "op5_embeddings": EMBEDDINGS_SQL}


SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS g FROM w, unnest(range(1, greatest(1, len(ws) - 11))) r(i)),
low AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT win.doc_id, win.i FROM win JOIN low ON win.g = low.g WHERE low.m < win.doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM hit, range(0, 13) r(k)),
word AS (SELECT doc_id, p, ws[p] AS x FROM w, unnest(range(1, len(ws) + 1)) r(p)),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS t, count(*) AS n FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

EMBEDDINGS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
near AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a),
low AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM near GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, low.c AS component_id, low.c = e.vec_id AS kept
FROM embeddings e JOIN low ON low.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
