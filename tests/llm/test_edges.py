"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import decontamination, imatch, langid, licenses, linededup, mixing, ngramjoin, pii, suffixdedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, node string, id string, score string"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))


def odd_rows():
    texts = [(1, "one two three four five six\nseven"), (2, None), (3, ""), (4, " \t\n "), (5, LONG), (5, LONG), (None, "lost words here today"), (7, "Ünïcode ça va\nbien"), (7, "other text"), (8, "a")]
    return [(i, t, "en" if i != 2 else None, None if i == 3 else "s", None, 0, "x", "y", "z") for i, t in texts]


@pytest.fixture(params=["odd", "empty"])
def docs(spark, request):
    return spark.createDataFrame(odd_rows() if request.param == "odd" else [], SCHEMA)


OPERATORS = {
    "mixing": lambda s, d: mixing.mix(d),
    "pii": lambda s, d: pii.find(d),
    "imatch": lambda s, d: imatch.followed(imatch.fingerprint(d), ["text", "marks"]),
    "ngramjoin": lambda s, d: ngramjoin.join(d),
    "suffixdedup": lambda s, d: suffixdedup.remove_repeats(d),
    "linededup": lambda s, d: linededup.dedup(d),
    "toxicity": lambda s, d: toxicity.score(d, s.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_a_document(spark, docs, name):
    assert OPERATORS[name](spark, docs).count() == docs.count()


def test_searches_run(spark, docs):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five six seven")], "item_id long, text string")
    found = {tuple(r)[:2] for r in decontamination.find(docs, items).collect()}
    assert found == ({(1, 3)} if docs.count() else set())
    assert licenses.scan(docs).count() == 0
    rows = docs.select(F.col("doc_id").alias("row"), "text", F.col("source").alias("host"), F.lit(None).cast("string").alias("declared"))
    assert langid.identify(rows, langid.train(docs)).count() == docs.count()


def test_components_of_odd_rows(spark):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.join(spark.createDataFrame(odd_rows(), SCHEMA)).collect()}
    assert (2, 0, 2) in got and (3, 0, 3) in got and (8, 1, 8) in got and (None, 1, None) in got


def test_only_leaked_rows_leave_the_pipeline(spark, tmp_path):
    item = "one two three four five six seven eight nine ten"
    spark.createDataFrame([(3, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"so {item} then"), (None, "clean words without an id"), (None, None), (4, item), (4, "another text of the same id"), (5, "clean"), (5, "")]
    kept = corpus_pipeline.decontamination_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [rows[k] for k in (1, 2, 4, 5, 6)]))
    odd = spark.createDataFrame(odd_rows(), SCHEMA)
    assert corpus_pipeline.decontamination_stage(spark, odd, str(tmp_path)).columns == odd.columns
    assert corpus_pipeline.decontamination_stage(spark, odd, str(tmp_path)).count() == odd.count()
