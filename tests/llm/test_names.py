"""Every operator and pipeline stage with columns whose names hold blanks, dashes, dots and quotes."""

import pytest
from llm_rows import BODY, PASSAGE
from pyspark.sql import functions as F

import corpus_pipeline
from lakekit.llm import bytebpe, decontaminate, filteraudit, jaccard, language, licenses, packing, quality, scoring, substrings, toxicity, urlfilter

ODD = ["my col", "a-b", "a.b", "q`t", "row"]
ROWS = [(1, BODY), (2, BODY), (3, PASSAGE + " " + BODY), (4, None), (5, "Licensed under the MIT License. " + BODY[40:300])]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string")
    return rows.select("*", *(F.lit(i).alias(name) for i, name in enumerate(ODD)), F.lit("en").alias("lang"))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(7, PASSAGE)], "item_id long, text string")


def test_operators_hand_odd_columns_through(spark, docs, bench):
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    pages = docs.withColumn("url", F.lit("https://a.com/x"))
    found = [
        decontaminate.find(docs, bench),
        decontaminate.find(docs, bench, broadcast_bytes=0),
        quality.measure(docs),
        toxicity.score(docs, toxicity.fit(docs, labels)),
        licenses.scan(docs),
        scoring.score(docs),
        substrings.repeated(docs),
        language.predict(docs, language.fit(docs)),
        urlfilter.judge(pages, urlfilter.rule_table(spark)),
        jaccard.join_similar(docs),
    ]
    for df in found:
        rows = df.select("row").collect()
        assert len(rows) == len(ROWS) and all([r.row[name] for name in ODD] == list(range(len(ODD))) for r in rows)
    assert packing.pack(docs).count() == bytebpe.encode(docs).count() == filteraudit.failed_filters(docs).count() == len(ROWS)


def test_stages_keep_odd_columns(docs, bench):
    left = quality.keep(docs, min_words=0, max_covered=1000, max_longest=10**6)
    assert left.columns == docs.columns and left.count() == len(ROWS)
    assert decontaminate.remove(docs, bench).columns == docs.columns
    cut = decontaminate.remove(docs, bench, action="spans")
    assert cut.columns == docs.columns and cut.count() == len(ROWS)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and [r["a.b"] for r in kept.collect()] == [2] * kept.count()
    assert substrings.remove_repeats(docs).columns == docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality rules"


def test_text_columns_of_odd_names(spark, bench):
    rows = spark.createDataFrame(ROWS, "`my id` long, `a.b` string")
    names = {"doc_id": "my id", "text": "a.b"}
    assert jaccard.join_similar(rows, **names).count() == packing.pack(rows, **names).count() == scoring.score(rows, **names).count() == len(ROWS)
    assert substrings.repeated(rows, **names).count() == quality.measure(rows, "a.b").count() == len(ROWS)
    assert decontaminate.find(rows, bench, text="a.b").where("n_hit > 0").count() == 1
