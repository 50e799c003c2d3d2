import hashlib
import random

import corpus_pipeline
from tallyweir.llm import decontaminate, ngram_join, pieces, pii
from tallyweir.llm.queries import piece_model
from tests.llm.conftest import SCHEMA, SF, documents, passage
from tests.llm.test_exact import components


def test_stages_take_effect_and_keep_the_rest(spark):
    docs = documents(spark)
    one = corpus_pipeline.drop_toxic(spark, docs, SF).cache()
    assert one.columns == docs.columns and one.subtract(docs).count() == 0
    two = corpus_pipeline.drop_near_duplicates(spark, one, SF).cache()
    groups = components([(r.doc_id, r.text) for r in one.collect()])
    assert sorted(r.doc_id for r in two.collect()) == sorted(d for d, (_, c) in groups.items() if d == c)
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    three = corpus_pipeline.drop_benchmark_leaks(spark, two, SF).cache()
    bad = {r.doc_id for r in decontaminate.leaks(two, benchmark).collect()}
    assert sorted(r.doc_id for r in three.collect()) == sorted({r.doc_id for r in two.collect()} - bad)
    four = corpus_pipeline.mask_personal_data(spark, three, SF).cache()
    assert four.columns == docs.columns and four.count() == three.count()
    assert all(not pii.base_spans(r.text) for r in four.collect())
    five = corpus_pipeline.encode_pieces(spark, four, SF)
    texts = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in four.collect()}
    assert {r.doc_id: r.decoded_sha256 for r in five.collect()} == texts
    table = pieces.ChunkTable(piece_model())
    assert {r.doc_id: r.ids for r in five.collect()} == {r.doc_id: table.sp.encode(r.text) for r in four.collect()}


def test_run_equals_its_stages(spark):
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens").collect())) == sorted(map(tuple, docs.select("doc_id", "n_tokens").collect()))


def test_stages_on_edges(spark, edge, empty, clashing):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
        assert stage(spark, edge, SF).count() <= edge.count()
        assert set(clashing.columns) - {"text", "ids", "decoded"} <= set(stage(spark, clashing, SF).columns)
        kept = [r.doc_id for r in stage(spark, edge, SF).select("doc_id").collect()]
        assert {0, 1, 2} <= set(kept) and None in kept  # null, empty and blank texts, and a null id without a text
    kept = corpus_pipeline.drop_near_duplicates(spark, edge, SF).collect()
    # doc 13 is there twice and a copy of 3; rows without an id stay
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [0, 1, 2, 3, 6, 8, 9, 10, 11, 12, 14, 15]
    assert sum(r.doc_id is None for r in kept) == 2
    assert ngram_join.near_duplicates(edge).count() == edge.count()


def test_rows_of_one_id_with_different_texts(spark):
    rng = random.Random(15)
    a, b, c, d = (passage(rng, 60) for _ in range(4))
    rows = [(0, b), (1, a), (1, b), (2, a), (5, c), (5, c), (5, d), (6, ""), (6, None), (None, a), (None, d)]
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], SCHEMA)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    want = [(0, b), (1, a), (5, c), (5, d), (6, ""), (6, None), (None, a), (None, d)]
    assert sorted(map(str, kept)) == sorted(map(str, want))


def test_many_near_duplicates_go_as_few_do(spark, edge, monkeypatch):
    docs = documents(spark).unionByName(edge)
    few = sorted(map(str, corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()))
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_BYTES", -1)
    assert sorted(map(str, corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())) == few
