"""The registered queries of this subpackage: thin digests over its operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.llm import archive, bpe, covertree, fim, jaccard, lm, media, merkle, mixing, nndescent, pii, quality, toxicity
from wharfline.llm.common import bucket_of, table, word_count, written

Query = Callable[[SparkSession, str], DataFrame]


def op1_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return covertree.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5, scale=256.0)


def op2_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm.score(docs, bucket_of(F.col("doc_id"), 5) != 1)
    return scored.withColumn("held_out", F.coalesce(bucket_of(F.col("doc_id"), 5) == 1, F.lit(False)))


def op3_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_text(table(spark, sf_dir, "documents"), keep=["doc_id"])
    feature = F.concat(F.size("fingerprint").cast("string"), F.lit(":"), F.sha2(F.array_join(F.col("fingerprint"), ","), 256))
    return media.analyse(stored).withColumn("feature", feature)


def op4_nb_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text"), bucket_of(F.col("doc_id"), 3) == 1
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held)
    scored = toxicity.score(docs, model).drop("text")
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_prefix_tree_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op5_prefix_tree_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_counts(table(spark, sf_dir, "documents"))


def op6_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text"), bucket_of(F.col("doc_id"), 5) == 0
    weights = quality.train(docs, table(spark, sf_dir, "labels"), ~held)
    scored = quality.score(docs, weights).drop("text")
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = written(archive.pages_to_warc(table(spark, sf_dir, "pages"), least=0), "warc")
    return archive.referred(archive.read_warc(archives, payloads=False)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # Words are counted once; no text goes further.
    sizes = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")), "sizes")
    return mixing.mix_sources(sizes, words="words").select("doc_id", "size", "source_size", "target", "taken")


def op10_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *pii.span_digest(found))


def op11_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nndescent.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.fim(table(spark, sf_dir, "documents"), keep=["doc_id"])
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return cut.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), *digests)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.coalesce(bucket_of(F.col("doc_id"), 5) == 0, F.lit(False))
    lowered = F.when(tampered, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    found, _ = merkle.manifest(table(spark, sf_dir, "documents"), key="doc_id", group="source", fields=fields, altered={"text": lowered})
    return merkle.checked(found).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def queries() -> dict[str, Query]:
    return {
        "op1_cover_tree_topk": op1_cover_tree_topk,
        "op2_bloom_lm": op2_bloom_lm,
        "op3_media_fingerprints": op3_media_fingerprints,
        "op4_nb_toxicity": op4_nb_toxicity,
        "op5_prefix_tree_jaccard": op5_prefix_tree_jaccard,
        "op5_prefix_tree_jaccard_links": op5_prefix_tree_jaccard_links,
        "op6_ftrl_quality": op6_ftrl_quality,
        "op7_arc_to_warc": op7_arc_to_warc,
        "op8_prefix_bpe": op8_prefix_bpe,
        "op9_source_mix": op9_source_mix,
        "op10_bootstrapped_pii": op10_bootstrapped_pii,
        "op11_nn_descent": op11_nn_descent,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


WORD_COUNT = "CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END"

OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS q, v AS d WHERE q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id AND len(q.e) = len(d.e)
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP9_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST({WORD_COUNT} AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, row_number() OVER (ORDER BY source COLLATE C NULLS LAST) AS place, 3.0::DOUBLE * source_size AS cap FROM s
), f AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), t AS (
  SELECT *, CASE WHEN cap <= level * w THEN cap ELSE w * (SELECT first(g.level ORDER BY g.cap / g.w, g.place) FROM f AS g WHERE g.cap > g.level * g.w) END AS target FROM f
), m AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST(concat('0x', substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM m
"""


OP12_SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (
  SELECT *, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM h
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""

#: Levels by recursion, for the trees of the sources (up) and for that of their roots (top); crc32 by its table.
OP13_SQL = """
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
c AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, x: xor(c >> 8, t[CAST((xor(c, x) & 255) + 1 AS INTEGER)])), 4294967295) AS crc FROM documents, t
), f AS (
  SELECT doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    text, CASE WHEN doc_id IS NOT NULL AND crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM c
), l AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS changed FROM f
), p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
up(level, source, i, h) AS (
  SELECT 0, source, i, leaf FROM p
  UNION ALL SELECT level + 1, source, i // 16, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM up) WHERE n > 1 GROUP BY level, source, i // 16
), s AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source COLLATE C NULLS FIRST) - 1 AS i FROM (SELECT source, arg_max(h, level) AS h FROM up GROUP BY source)
), top(level, i, h) AS (
  SELECT 0, i, subroot FROM s
  UNION ALL SELECT level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM top) WHERE n > 1 GROUP BY level, i // 16
), own AS (
  SELECT a.level, a.source, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM up AS a JOIN up AS b ON a.level = b.level AND a.source IS NOT DISTINCT FROM b.source AND a.i // 16 = b.i // 16 GROUP BY ALL
), depth AS (SELECT source, max(level) AS d FROM up GROUP BY source),
upper AS (
  SELECT a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM top AS a JOIN top AS b ON a.level = b.level AND a.i // 16 = b.i // 16 GROUP BY ALL
), low AS (
  SELECT p.source, p.i, list(o.l || '|' || o.r ORDER BY o.level) FILTER (o.l IS NOT NULL) AS path FROM p JOIN depth AS d ON d.source IS NOT DISTINCT FROM p.source
  LEFT JOIN own AS o ON o.source IS NOT DISTINCT FROM p.source AND o.level < d.d AND o.i = p.i // CAST(pow(16, o.level) AS BIGINT) GROUP BY p.source, p.i
), high AS (
  SELECT s.source, s.subroot, list(o.l || '|' || o.r ORDER BY o.level) FILTER (o.l IS NOT NULL) AS path FROM s LEFT JOIN upper AS o ON o.level < (SELECT max(level) FROM top) AND o.i = s.i // CAST(pow(16, o.level) AS BIGINT) GROUP BY s.source, s.subroot
), w AS (
  SELECT p.doc_id, p.leaf, p.changed, high.subroot, (SELECT arg_max(h, level) FROM top) AS root, coalesce(low.path, []) || coalesce(high.path, []) AS path
  FROM p JOIN low ON low.source IS NOT DISTINCT FROM p.source AND low.i = p.i JOIN high ON high.source IS NOT DISTINCT FROM p.source
), z AS (
  SELECT *, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, list_reduce(list_prepend(changed, path), lambda a, e: sha256(split_part(e, '|', 1) || a || split_part(e, '|', 2))) AS folded_root FROM w
) SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM z
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_cover_tree_topk": OP1_SQL, "op9_source_mix": OP9_SQL, "op12_fill_in_middle": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
