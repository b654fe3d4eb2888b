"""The pipeline's stages against plain versions, each on what its predecessor kept."""

from collections import Counter

import corpus_pipeline
from corpusmill.llm import bpe, mixing, toxicity

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r.doc_id: r for r in docs.collect()})
        if k < 4:
            assert docs.columns == columns
    first = spark.read.parquet(f"{SF}/documents.parquet")
    bad = {r.doc_id for r in toxicity.grade(first, toxicity.train(first, spark.read.parquet(f"{SF}/labels.parquet"))).collect() if r.toxic}
    texts = {r.doc_id: r.text for r in first.collect()}
    assert set(kept[0]) == set(texts) - bad
    want = {d: x[2] for d, x in brute.line_dedup({d: texts[d] for d in kept[0]}).items()}
    assert {d: r.text for d, r in kept[1].items()} == want
    groups = brute.components(want, 5, 80)
    assert set(kept[2]) == {d for d, (_, c) in groups.items() if c == d}
    before = spark.read.parquet(f"{tmp_path}/2")
    copies = Counter({r.doc_id: r.copies for r in mixing.decide(before).collect() if r.copies})
    assert Counter(r.doc_id for r in spark.read.parquet(f"{tmp_path}/3").collect()) == copies
    codec = bpe.codec(bpe.default_path())
    for d, r in kept[4].items():
        assert r.decoded_sha256 == brute.sha(want[d]) and r.n_tokens == len(codec.encode_batch([want[d]])[0])
    assert corpus_pipeline.run(spark, SF).count() == sum(copies.values())
