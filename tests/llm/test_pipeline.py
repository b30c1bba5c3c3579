import os

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
def test_stages(spark):
    """Each stage on what the one before it kept; what each decides is checked against its own rule."""
    from sluice.llm.common import stage

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near duplicates", "mixing", "packing"]
    kept = docs
    for name, apply in corpus_pipeline.STAGES[:-1]:
        out = stage(apply(spark, kept, DIR), "test")
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        ids, before = {r.doc_id for r in out.select("doc_id").collect()}, {r.doc_id for r in kept.select("doc_id").collect()}
        assert ids <= before and len(ids) > 0.6 * len(before)
        if name == "toxicity":
            insulting = F.lower("text").rlike(r"\b(trash|idiot|clown|scum|worthless|moron|pathetic|loser|disgusting|stupid)\b")
            assert out.where(insulting).count() <= 0.5 * kept.where(insulting).count()
        if name == "line dedup":
            lines = out.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.size(F.split(F.trim("line"), r"\s+")) >= 4)
            assert lines.groupBy("line").agg(F.count_distinct("doc_id").alias("c")).where("c > 1").count() == 0
        if name == "near duplicates":
            from sluice.llm.minhash import near_duplicates

            assert near_duplicates(out).where("NOT kept").count() == 0
        if name == "mixing":
            assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
        kept = out
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, DIR).collect()
    assert len({r.doc_id for r in packed}) == kept.select("doc_id").distinct().count()
    total = sum(r.length for r in packed)
    assert len({r.sequence_id for r in packed}) <= -(-total // 4096) + 1


def test_lines_alone_leave_no_empty_document(spark, docs):
    table = docs(["a line that all of them share", "a line that all of them share", None, ""]).select("doc_id", "text", "lang", "source", "n_chars")
    out = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, table, "").collect()}
    assert out == {0: "a line that all of them share", 2: None, 3: ""}


def test_blank_rest_goes(spark, docs):
    """What is left of a document is white space alone."""
    rows = ["a line that all of them share", "\n\na line that all of them share\n \n", "\n\n"]
    out = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs(rows).select("doc_id", "text", "lang", "source", "n_chars"), "").collect()}
    assert out == {0: rows[0], 2: "\n\n"}


def test_clashing_columns(spark, docs):
    """Columns that are named like the stages' own come through as they are."""
    names = ["drop", "_id", "_th", "_th2", "_mix", "_copy", "_p", "_toxic", "_lines", "th", "x0", "g", "d", "s.t", "size", "copies", "rank", "digest", "component_id"]
    table = docs([f"a line that all of them share\nown line of number {i}" for i in range(40)]).select("doc_id", "text", "lang", "source", "n_chars").selectExpr("*", *[f"{i} AS `{n}`" for i, n in enumerate(names)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    from sluice.llm import queries

    kept = table
    for apply in (lambda d: corpus_pipeline.toxicity.scored(d, corpus_pipeline.toxicity.train(d, labels, ("quality", "toxic")), keep="clean"), *(lambda d, f=f: f(spark, d, "") for _, f in corpus_pipeline.STAGES[1:4])):
        kept = apply(kept)
        assert kept.columns == table.columns
        assert {tuple(r[n] for n in names) for r in kept.collect()} <= {tuple(range(len(names)))}
    assert corpus_pipeline.pack(spark, kept, "").count() == kept.count() > 0
    assert queries.CATEGORIES == ("junk", "toxic")
