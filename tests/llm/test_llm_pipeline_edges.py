"""All stages on odd rows: nulls, empty and long texts, repeated rows, clashing columns, an empty table."""

from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark):
    long = "a long line of words that goes on and on " * 5000
    rows = [(1, None), (2, ""), (None, "no id but a text of some words here"), (None, None), (4, "one two three four five six seven"), (4, "one two three four five six seven"), (4, "another text with the same id as one before"), (5, "One two three four five six seven"), (6, long), (7, "\n\n"), (8, "the same line in two\nfirst"), (9, "the same line in two\nsecond")]
    df = spark.createDataFrame([(d, t, None, "s", None) for d, t in rows], SCHEMA)
    return df.withColumns({"_text": F.lit(1), "_of": F.lit("x"), "kept": F.lit(True), "node": F.lit(0), "a.b": F.lit("dot"), "spans": F.lit(2)})


def test_stages_on_odd_rows(spark, small):
    docs = odd(spark)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == names, name
    left = {(r.doc_id, r.text) for r in docs.collect()}
    ids = [d for d, _ in left]
    assert {1, 2, 6, 7} <= set(ids) and (1, None) in left and (2, "") in left and (None, None) in left and (None, "no id but a text of some words here") in left
    assert ids.count(4) == 1 and {t for d, t in left if d == 9} == {"second"} and {t for d, t in left if d == 8} == {"the same line in two\nfirst"}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == docs.count()


def test_stages_on_an_empty_table(spark, small):
    docs = odd(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0, name
