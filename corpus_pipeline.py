"""The corpus pipeline: five stages over the documents, each on all that the one before it kept.

toxicity (3): documents that the classifier chain rejects go. line dedup (2): recurring templates go from all documents but
the first; a document that consisted of nothing else goes. near duplicates (7): five-word shingles at 0.8, of each group the
document with the least id stays. mixing (5): documents come as often as the target weights of their sources ask.
packing (6): the mixed documents in sequences of 4096 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import log_templates, minhash, mixing, packing, queries, toxicity
from sluice.llm.common import drop_stage, drop_stages, fresh, stage, staged_so_far, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.scored(docs, queries.toxicity_chain(spark, docs, sf_dir), keep="clean")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars is that of the remaining text."""
    name = fresh("_lines", docs.columns)
    out = log_templates.clean(docs, name=name).where(rf"{name}.n_dropped = 0 OR text RLIKE '[^\\x20\\x09-\\x0D]'")
    n_chars = F.when(F.col(name)["n_dropped"] > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.select(*[n_chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = minhash.near_duplicates(docs).where("NOT kept").select("doc_id").distinct().alias("g")
    return docs.alias("d").join(gone, F.col("d.doc_id") == F.col("g.doc_id"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers  # here, as the stages before it do without

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("near duplicates", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack)]

#: SQL can't train the chain, tokenise or pack; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder before the next begins, and what it left there goes."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        since = staged_so_far()
        before, docs = docs, stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_stages(spark, since, docs)
        drop_stage(before)
    return STAGES[-1][1](spark, docs, sf_dir)
