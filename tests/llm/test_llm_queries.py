"""The queries over whole small tables, and the pipeline's stages against plain versions."""

import brute
import pytest
from oracle import duck, sparks

import corpus_pipeline
from graphloom.llm import pieces, toxicity
from graphloom.llm.queries import ORACLE, QUERIES, model_path


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, small, name):
    assert sparks(QUERIES[name](spark, small)) == duck(small, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_a_row_for_each_document(spark, small, name):
    if name == "op11_embedding_whitening":
        want = 32 * spark.read.parquet(f"{small}/embeddings.parquet").count()
    else:
        want = spark.read.parquet(f"{small}/documents.parquet").count()
    assert QUERIES[name](spark, small).count() == want


def test_jaccard_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: [(r.n_shingles, r.component_id)] for r in QUERIES["op1_ngram_jaccard"](spark, small).collect()}
    assert got == brute.jaccard_components(rows)


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = docs.columns
    at = {name: stage for name, stage in corpus_pipeline.STAGES}
    kept = at["toxicity"](spark, docs, small)
    model = toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    clean = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in clean)
    assert kept.columns == names and sorted((r.doc_id, r.text) for r in kept.collect()) == rows

    kept = at["line_dedup"](spark, kept, small)
    rows = sorted((d, t) for d, t, _ in brute.keep_lines(rows))
    assert kept.columns == names and sorted((r.doc_id, r.text) for r in kept.collect()) == rows
    assert kept.where("n_chars <> length(text)").count() == 0

    kept = at["ngram_jaccard_join"](spark, kept, small)
    groups = brute.jaccard_components(rows)
    rows = [(d, t) for d, t in rows if groups[d][0][1] == d]
    assert kept.columns == names and sorted((r.doc_id, r.text) for r in kept.collect()) == rows

    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    found = {d: (n, hit) for d, n, hit, _ in brute.hits(rows, items)}
    kept = at["benchmark_decontamination"](spark, kept, small)
    after = {r.doc_id: r.text for r in kept.collect()}
    assert kept.columns == names
    for d, t in rows:
        n, hit = found[d]
        if hit * 2 > n:
            assert d not in after
        elif hit:
            assert len(brute.words(after[d])) == n - hit
        else:
            assert after[d] == t

    codec = pieces.Codec(pieces.read_model(model_path()))
    codec_of = {d: len(codec.encode(t)) for d, t in after.items()}
    assert {r.doc_id: r.n_tokens for r in at["sentencepiece"](spark, kept, small).collect()} == codec_of
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, small).collect()} == codec_of
