"""The pipeline's stages on a small table: what each keeps, and that decisions take effect."""

import pytest

pytest.importorskip("edgeloom.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

import numpy as np

from edgeloom.llm import quality, simhash, toxicity
from edgeloom.llm.common import materialize


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = materialize(stage(spark, docs, sf), name)
        seen[name] = docs
        if name != "packing":
            assert docs.schema == first.schema
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "toxicity":
            model = toxicity.fit_tables(first, labels)
            scorer = toxicity.Scorer(model)
            assert ids == {i for i, t in before.items() if scorer.scores([t])[0] < 0.5}
        if name == "quality":
            model = quality.fit_tables(first, labels)
            assert ids == {i for i, t in before.items() if quality.document_scores(model[:2], [t], model[2])[0] >= 0.7}
        if name == "line_dedup":
            from test_operators import brute_lines

            assert {r["doc_id"]: r["text"] for r in docs.collect()} == brute_lines(list(before.items()))
        if name == "simhash_dedup":
            keys = sorted(before)
            prints = simhash.fingerprints_of([before[i] for i in keys], 5, 2)
            near = np.bitwise_count(prints[:, None] ^ prints[None]).sum(2)
            # exact copies leave one; a document that goes has a smaller one within reach
            for n, i in enumerate(keys):
                if i not in ids:
                    assert any(near[n, m] <= simhash.radius_for(0.8, 128) for m in range(len(keys)) if m != n)
            kept = [n for n, i in enumerate(keys) if i in ids]
            assert all(near[a, b] > 0 for a in kept for b in kept if a < b)
        if name == "packing":
            assert ids == set(before)
    got = corpus_pipeline.run(spark, sf)
    assert got.count() == seen["packing"].count()


def test_registered(spark, duck, sf, same_rows):
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in e.queries()
    for n in names:
        if n in e.oracle_sql():
            same_rows(e.queries()[n](spark, sf).toPandas(), duck.execute(e.oracle_sql()[n]).df())
