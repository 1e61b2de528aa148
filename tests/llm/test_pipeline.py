"""The pipeline against stages worked out in plain Python."""

import corpus_pipeline
from voxelsheet.llm import decontamination, language, mixing

from .test_learned import exact_classes

SF_DIR = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    reached = [docs]
    for _, stage in corpus_pipeline.STAGES:
        reached.append(stage(spark, reached[-1], SF_DIR).cache())
    assert all(d.columns == columns for d in reached[:-1]) and reached[-1].columns == [*columns, "copy"]
    rows = [{r.doc_id: r for r in d.collect()} for d in reached[:-1]]
    texts = [{k: r.text for k, r in step.items()} for step in rows]
    known = {r.doc_id for r in language.identify(docs).filter("lang_pred <> 'und'").collect()}
    assert set(texts[1]) == known
    last = {}
    for k in sorted(texts[1]):
        last[texts[1][k]] = k
    assert set(texts[2]) == set(last.values())
    classes = exact_classes(texts[2])
    assert set(texts[3]) == {min(k for k, c in classes.items() if c == name) for name in set(classes.values())}
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    bad = {r.doc_id for r in decontamination.contamination(reached[3], bench).filter("contaminated").collect()}
    assert bad and set(texts[4]) == set(texts[3]) - bad
    taken = {r.doc_id: r.taken // r.size for r in mixing.mixture(reached[4]).collect() if r.size}
    copies = {}
    for r in reached[-1].collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == {k: n for k, n in taken.items() if n}
    for d in reached[1:]:
        d.unpersist()


def test_run_matches_the_stages(spark):
    once, again = (sorted((r.doc_id, r.copy) for r in corpus_pipeline.run(spark, SF_DIR).collect()) for _ in range(2))
    assert once == again and once


def test_stages_on_edges(spark, edges, nothing):
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, edges, SF_DIR)
        assert out.columns[:len(edges.columns)] == edges.columns and out.count() > 0
        assert stage(spark, nothing, SF_DIR).count() == 0
