"""The pipeline's stages on small documents, and every corpus query on the smallest tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loadstone.llm import queries
from tests.llm.helpers import documents


def test_stages_in_order(spark, sf, tmp_path):
    text = " ".join(f"alpha{i % 13} beta{i * i % 29} gamma{i}" for i in range(60))
    passage = " ".join(f"shared{i}" for i in range(40))
    rows = [(1, text), (2, text + " end"), (3, None), (4, ""), (5, "few words"), (6, passage + " " + " ".join(f"one{i}" for i in range(80))),
            (7, passage + " " + " ".join(f"two{i}" for i in range(90))), (8, "##%% " * 80)]
    base = spark.read.parquet(f"{sf}/documents.parquet")
    docs = documents(spark, rows).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars")
    assert docs.columns == base.columns
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append((name, sorted({r.doc_id for r in docs.collect()})))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == base.columns
    assert [n for n, _ in seen] == ["toxicity", "quality_rules", "ngram_jaccard_join", "suffix_array_dedup", "packing"]
    assert [s for _, s in seen] == [[1, 2, 3, 4, 5, 6, 7, 8], [1, 2, 6, 7], [1, 6, 7], [1, 6, 7], [1, 6, 7]]


def test_stages_of_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_covers_its_table(spark, sf, name):
    """As many rows as the table has, where a query gives one a row."""
    if name in ("op11_collocations", "op13_tree_search"):  # ranked lists: their rows are compared with SQL in test_oracle
        column, most = ("lang", 2000) if name == "op11_collocations" else ("item_id", 10)
        ranked = queries.QUERIES[name](spark, sf).groupBy(column).agg(F.count("*").alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.countDistinct("rank").alias("d")).collect()
        assert all(r.lo == 1 and r.hi == r.n == r.d <= most for r in ranked)
        return
    n = queries.QUERIES[name](spark, sf).count()
    table = {"op4_chat_formatting": "conversations", "op5_permutation_neighbours": "embeddings"}.get(name, "documents")
    given = spark.read.parquet(f"{sf}/{table}.parquet")
    if name == "op4_chat_formatting":
        assert n == given.select("conv_id").distinct().count() + 1
    elif name == "op5_permutation_neighbours":
        assert n == 20 * given.filter("vec_id % 20 = 0").count()
    elif name == "op8_harmonic_packing":
        assert n >= given.count()
    else:
        assert n == given.count()
