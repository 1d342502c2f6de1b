"""The pipeline's stages, each judged on its own input by brute force."""

import collections

import corpus_pipeline
from tests.llm.test_operators import SF, brute_classes, brute_leaks, frame, rebuilt_without_repeats, token_digests
from txnflow.llm import quality_rules


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    inputs, step = [docs], docs
    for name, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, SF)
        inputs.append(step.cache())
        if name != "tokens":
            assert step.columns == docs.columns
    raw, clean, lines, near, bench, tokens = (x.collect() for x in inputs)
    ids = lambda rows: {r.doc_id for r in rows}
    judged = {r.doc_id: quality_rules.judge(r.text) for r in raw}
    assert ids(clean) == {d for d, q in judged.items() if q[6]} and all(r.text == judged[r.doc_id][9] and r.n_chars == len(r.text) for r in clean)
    left = rebuilt_without_repeats(clean)
    gone = {r.doc_id for r in clean if left[r.doc_id] != r.text and not left[r.doc_id].strip()}
    assert {r.doc_id: r.text for r in lines} == {d: t for d, t in left.items() if d not in gone}
    assert all(r.n_chars == len(r.text) for r in lines)
    classes = brute_classes(lines)
    assert ids(near) == {d for d, (c, _) in classes.items() if d == c}
    text = {r.doc_id: r.text for r in lines}
    assert all(r.text == text[r.doc_id] for r in near) and all(r.text == text[r.doc_id] for r in bench)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert ids(bench) == ids(near) - {d for d, _ in brute_leaks(near, items)}
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in tokens} == {(r.doc_id, *token_digests(r.text)) for r in bench}
    assert collections.Counter(ids(tokens)) == collections.Counter({r.doc_id: 1 for r in corpus_pipeline.run(spark, SF).collect()})


def test_stages_on_odd_documents(spark):
    docs = frame(spark, None, "", "few words", (None, "an odd row without an id that has enough words to stay in."), "a b c d e f g h i j k l m.")
    step = docs
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, SF)
    assert {r.doc_id for r in step.collect()} == {None, 5}
    step = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, SF)
    assert step.count() == 0
