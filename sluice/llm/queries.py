"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import ball_tree, html_region, image_descriptors, log_templates, minhash, mixing, packing, pii, suffix_tree, toxicity
from sluice.llm.common import stage, table


#: The models of the shipped labelled tables, which do not depend on the data, fitted once for a driver.
shipped_field, shipped_weights = functools.cache(pii.train), functools.cache(html_region.weigh)


def op1_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), shipped_field())
    own = F.filter("spans", lambda x: x["base"])

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    added = F.size("spans") - F.size(own)
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), added.cast("long").alias("n_added"))


def op2_log_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = log_templates.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "_lines.n_lines", "_lines.n_dropped", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "text")


#: The chain's links: of the labels, low quality is predicted first and toxic last, which decides.
CATEGORIES = ("junk", "toxic")


def toxicity_chain(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Chain:
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")
    return toxicity.train(docs, labels, CATEGORIES)


def op3_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.scored(docs, toxicity_chain(spark, docs, sf_dir))
    return out.select("doc_id", *[F.col("_p")[i].alias(f"p_{c}") for i, c in enumerate(CATEGORIES)], F.col("_toxic").alias("rejected"))


def op4_html_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_region.extract(table(spark, sf_dir, "pages"), shipped_weights())


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    docs = stage(docs, "sizes")
    out = mixing.with_copies(docs, mixing.targets(docs))
    return out.select("doc_id", "size", "_mix.source_size", "_mix.target", (F.col("size") * F.col("_mix.copies")).alias("taken"), F.col("_mix.copies").alias("copies"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight FROM s),
f AS (SELECT *, (3 * source_size)::DOUBLE / weight AS full_at FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER p, 0))::DOUBLE
             / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0))::DOUBLE AS level
      FROM f WINDOW p AS (ORDER BY full_at, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT level AS height FROM l WHERE level <= full_at ORDER BY full_at, i LIMIT 1),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, weight * height) AS target FROM l, h),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             CAST('0x' || substr(md5('17:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0 AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM r)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM c
"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # here, as all other queries do without

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), n=2, percent=80)


def op8_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.search(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 5
"""


def op9_image_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There is no table of images: one is drawn for every vector, and an edited copy for every tenth."""
    return image_descriptors.copies(image_descriptors.gallery(table(spark, sf_dir, "embeddings")))


def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.scored(table(spark, sf_dir, "documents"))


QUERIES = {"op1_crf": op1_crf, "op2_log_templates": op2_log_templates, "op3_classifier_chain": op3_classifier_chain, "op4_html_region": op4_html_region, "op5_mixing": op5_mixing, "op6_packing": op6_packing, "op7_minhash": op7_minhash, "op8_ball_tree": op8_ball_tree, "op9_image_descriptors": op9_image_descriptors, "op10_suffix_tree": op10_suffix_tree}
ORACLES = {"op5_mixing": OP5_SQL, "op8_ball_tree": OP8_SQL}
