"""Columns named like those that operators use, weights from a column, and joins without broadcasts."""

import pytest
from pyspark.sql import functions as F

from voxelsheet.llm import decontamination, exact_dedup, language, mixing, near_dedup

from .conftest import prose

NAMES = ("copy", "_id", "_key", "_t", "_i", "_own", "_sha", "_last", "_epochs", "_g", "_runs", "_hit", "_rows", "COPY_", "text_key", "node", "part", "grp", "bucket", "near", "low", "at")


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(k, prose(k // 3, 40) if k % 4 else "the same text in many documents of this table", "en", f"s{k % 3}", k) for k in range(60)] + [(None, None, None, None, 0)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return frame.select("*", *[F.concat(F.lit(c), "n_chars").alias(c) for c in NAMES]).repartition(3)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, prose(2, 30)), (2, None)], "item_id bigint, text string")


def test_columns_stay_whatever_their_names(clashing, bench):
    whole = {r.n_chars: r for r in clashing.filter("doc_id is not null").collect()}
    steps = [exact_dedup.keep_one, near_dedup.keep_one, language.known_language, lambda d: decontamination.remove_documents(d, bench), mixing.mix]
    for step in steps:
        out = step(clashing)
        assert out.columns[:len(clashing.columns)] == clashing.columns
        rows = out.filter("doc_id is not null").collect()
        assert rows and all(tuple(r)[:len(clashing.columns)] == tuple(whole[r.n_chars]) for r in rows)
    assert mixing.mix(clashing).columns[-1] == "copy__"
    cut = decontamination.remove_spans(clashing, bench)
    assert cut.columns == clashing.columns and cut.count() == clashing.count()


def test_mix_follows_a_stored_score(spark):
    docs = spark.createDataFrame([(k, "five words are in here", "a" if k < 400 else "b", 1.0 if k % 2 else 0.01) for k in range(800)], "doc_id bigint, text string, source string, score double")
    taken = {r.doc_id: r.taken for r in mixing.mixture(docs, weights=(1, 3), total=0.6, weight=F.col("score")).collect()}
    # source a has room for 120 documents, and 200 with a high score
    good, bad = (sum(v > 0 for k, v in taken.items() if k < 400 and k % 2 == odd) for odd in (1, 0))
    assert good + bad in (119, 120, 121) and good > 20 * bad
    copies = mixing.mix(docs, weights=(1, 3), total=0.6, weight=F.col("score"))
    assert sorted(r.doc_id for r in copies.collect()) == sorted(k for k, v in taken.items() for _ in range(v // 5))


def shuffled_bytes(spark, frame):
    """Bytes that the plan's exchanges wrote, from a run of it."""
    frame.write.format("noop").mode("overwrite").save()
    gateway = spark.sparkContext._gateway
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_windows_without_broadcasts(spark, bench, monkeypatch):
    """With no broadcast at all the result is the same, and what is shuffled grows with the words, not with their square."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = lambda n: spark.createDataFrame([(n, " ".join(f"w{k * 7919 % 100_003}" for k in range(n)) + " " + prose(2, 30))], "doc_id bigint, text string")
        rows = lambda n, limit: [tuple(r) for r in decontamination.contamination(made(n), bench, max_broadcast=limit).collect()]
        assert rows(3000, 0) == rows(3000, 10_000) and rows(3000, 0)[0][2] == 30
        monkeypatch.setattr(decontamination, "MOST_BYTES", 0)
        assert rows(3000, 0) == rows(3000, 10_000)
        windows = decontamination.benchmark_windows(bench)
        size = {}
        for n in (4000, 16_000):
            before = shuffled_bytes(spark, spark.range(1))
            size[n] = shuffled_bytes(spark, decontamination.hits(made(n), windows, max_broadcast=0)) - before
        assert size[16_000] < 6 * size[4000], size
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
