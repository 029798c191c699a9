"""The corpus pipeline, stage by stage, against brute force on its own input."""

from conftest import SF
from test_llm import components, shingle_set

import corpus_pipeline


def test_stages_keep_their_contracts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.settled(stage(spark, docs, SF), f"test-{k}")
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        seen.append((docs, out))
        docs = out
    texts = {r.doc_id: r.text for r in seen[0][0].collect()}
    kept = {r.doc_id for r in seen[0][1].collect()}
    assert all(i in kept or not any(c.isalpha() for c in t or "") for i, t in texts.items())
    sets = {i: shingle_set(texts[i]) for i in kept}
    links = [(a, b) for a in kept for b in kept if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = components(kept, links)
    assert {r.doc_id for r in seen[1][1].collect()} == set(root.values())
    assert seen[2][1].count() == seen[2][0].count()
    mixed = {r.doc_id for r in seen[3][1].collect()}
    assert mixed <= set(root.values()) and len(mixed) > len(root) * 0.2
    assert {r.doc_id for r in seen[4][1].collect()} == mixed


def test_language_stage_without_labels_keeps_documents(spark):
    docs = spark.createDataFrame([(1, "some words in a row", None, "s", 19), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars int")
    assert sorted(map(str, corpus_pipeline.language(spark, docs, SF).collect())) == sorted(map(str, docs.collect()))
    assert corpus_pipeline.language(spark, docs.limit(0), SF).count() == 0
