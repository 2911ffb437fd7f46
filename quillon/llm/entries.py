"""The queries of this subpackage, with production parameters, over whole tables, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe_count, embed_dedup, fingerprint, hash_ring, order_minhash, packing, piece_codec, quality_crf, toxicity, url_tree

WORDS = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link_vectors(_table(spark, sf_dir, "embeddings"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_minhash.classes(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "kept", "n_words")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))


def _judged(scored: DataFrame, remainder: tuple[int, int]) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % remainder[0] == remainder[1]
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return _judged(toxicity.score(docs, model, "score"), toxicity.HELD_OUT)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_crf.fit(docs, _table(spark, sf_dir, "labels"))
    return _judged(quality_crf.score(docs, model, "score"), quality_crf.HELD_OUT)


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op8_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_tree.judge(_table(spark, sf_dir, "pages"), RULES)


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encoding_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op10_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hash_ring.assign(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda kf: int(kf[0][2:].split("_")[0])))


#: Links between rows of equal label with a cosine of 0.98 or more, and their components by reachability.
OP1_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT vec_id, label, e, len(e) AS d, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(e, e) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.d = b.d AND a.vec_id < b.vec_id WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON r.vec_id = l.a),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_links": OP1_SQL}
