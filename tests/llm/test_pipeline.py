from __future__ import annotations

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_equal_their_operators(spark, small_dir):
    from framewright.llm import toxicity
    from framewright.llm._common import table
    from tests_llm_brute import brute_contaminated, brute_kept

    docs = table(spark, small_dir, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(docs, table(spark, small_dir, "labels")).collect()}
    left = {i: t for i, t in texts.items() if not scores[i]}
    left = brute_kept(left)
    left = brute_contaminated(left, {r.item_id: r.text for r in table(spark, small_dir, "benchmark").collect()})
    got = pipeline.run(spark, small_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(left)
    # The last two stages by plain versions: slots by the schedule of each source's blocks, shards by a plain descent.
    from framewright.llm import mixing, sharding
    from test_sharding_mixing import plain_place

    kept = docs.where(docs.doc_id.isin(list(left)))
    place = {r.doc_id: r.position for r in mixing.mixture(kept).collect()}
    by_shard = {}
    for i in sorted(left, key=place.get):
        by_shard.setdefault(plain_place(i, sharding.tree(16)), []).append(i)
    assert {r.doc_id: (r.shard, r.slot) for r in got} == {i: (s, k) for s, own in by_shard.items() for k, i in enumerate(own)}


def test_every_stage_but_the_last_returns_documents(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "sharding"]
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, small_dir).schema == docs.schema


def test_near_copies_by_five_words_and_four_fifths(spark, small_dir):
    from test_ngram_join import brute, groups

    # A block of words added: 4- and 5-word Jaccard are both about 0.82.
    base = [f"a{k}" for k in range(200)]
    docs = [*groups(), (9_000, " ".join(base)), (9_001, " ".join(base[:100] + [f"n{k}" for k in range(38)] + base[100:]))]
    kept = {i for i, (_, root) in brute(docs, 5, 80).items() if root == i}
    assert 9_001 not in kept and 9_001 in {i for i, (_, root) in brute(docs).items() if root == i}
    got = pipeline.drop_near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string"), small_dir).collect()
    assert {r.doc_id for r in got} == kept
