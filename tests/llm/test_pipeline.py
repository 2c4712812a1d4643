import hashlib

import pytest
from pyspark.sql import functions as F
from test_exact_dedup import lower
from test_simhash import brute
from tokenizers import Tokenizer

import corpus_pipeline
from martwright.llm import queries, toxicity
from martwright.llm.mixing import mix_sources

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    """Each stage against plain Python on what its predecessor kept, and run() against the chain."""
    docs = queries.table(spark, SF, "documents")
    cols = docs.columns
    model = queries.toxicity_model(docs, queries.table(spark, SF, "labels"))
    rejected = {r.doc_id for r in toxicity.score(docs, model).filter("predicted = 1").collect()}
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "exact_dedup", "simhash_near_dedup", "mix_sources", "bpe_encode_decode"]

    def rows(df):
        assert df.columns == cols
        return sorted(map(tuple, df.collect()))
    now = spark.createDataFrame(
        steps["toxicity"](spark, docs, SF).collect(), docs.schema)
    assert rejected and rows(now) == rows(docs.filter(~F.col("doc_id").isin(list(rejected))))

    keep = {}
    for r in now.collect():
        keep[lower(r.text)] = max(keep.get(lower(r.text), -1), r.doc_id)
    after = spark.createDataFrame(steps["exact_dedup"](spark, now, SF).collect(), docs.schema)
    assert sorted(r.doc_id for r in after.collect()) == sorted(keep.values()) and after.count() < now.count()

    want = {int(c) for _, _, c in brute([(r.doc_id, r.text) for r in after.collect()])}
    near = spark.createDataFrame(steps["simhash_near_dedup"](spark, after, SF).collect(), docs.schema)
    assert {r.doc_id for r in near.collect()} == want and near.count() == len(want)

    mixed = spark.createDataFrame(steps["mix_sources"](spark, near, SF).collect(), docs.schema)
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {r.doc_id: r["count"] for r in mix_sources(near).groupBy("doc_id").count().collect()}

    tok = Tokenizer.from_file(queries.tokenizer())
    texts = {r.doc_id: r.text for r in mixed.collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in mixed.collect())
    for r in out:
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_stages_on_odd_and_empty_tables(spark, which, request):
    docs = request.getfixturevalue(which)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert which == "odd" or not rows
        if name != "bpe_encode_decode":
            assert out.columns == docs.columns


def test_superseded_pins_are_deleted(spark):
    import os
    from martwright.session import checkpoint_dir
    folder = checkpoint_dir(spark).removeprefix("file:")
    pins = lambda: {x for x in os.listdir(folder) if x.startswith("pin-")}
    before = pins()
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert len(pins() - before) == 1 and out.count() > 0      # the last stage's input
