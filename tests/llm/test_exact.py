"""Exact dedup, decontamination and mixing: edge rows, and the registered queries by their SQL twins (tests/test_queries.py)."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from voxelsheet.llm import bloom, decontamination, exact_dedup, mixing


def test_bloom_misses_no_repeat(spark):
    values = [k // 2 for k in range(4000)] + list(range(10_000, 14_000))
    frame = spark.createDataFrame([(v * 7919,) for v in values], "h bigint").repartition(5)
    check = bloom.maybe_repeated(frame)
    got = {r.h for r in frame.filter(check(F.col("h"))).collect()}
    assert {v * 7919 for v in range(2000)} <= got and len(got) < 2200


def test_bloom_too_small_lets_all_through(spark):
    frame = spark.range(300_000).select(F.xxhash64("id").alias("h"))
    check = bloom.maybe_repeated(frame, max_bits=bloom.STRETCH_BITS)
    assert frame.filter(check(F.col("h"))).count() > 290_000


def test_exact_edges(edges):
    rows = exact_dedup.duplicates(edges).collect()
    texts = defaultdict(list)
    for r in edges.collect():
        texts[r.text or ""].append(r.doc_id)
    assert len(rows) == sum(map(len, texts.values()))
    kept = Counter(r.text_sha256 for r in rows if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(texts)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in texts.items()}
    for r in rows:
        ids = by_hash[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)


def test_exact_keep_one(edges, nothing):
    left = exact_dedup.keep_one(edges)
    assert left.columns == edges.columns
    rows = left.collect()
    assert len(rows) == len({r.text or "" for r in edges.collect()}) == len({r.text or "" for r in rows})
    assert max(r.doc_id for r in rows if r.text and r.text.startswith("one text")) == 31
    assert exact_dedup.keep_one(nothing).count() == exact_dedup.duplicates(nothing).count() == 0


@pytest.fixture(scope="module")
def bench(spark):
    long = " ".join(f"w{k}" for k in range(20))
    return spark.createDataFrame([(1, long), (2, "Short item"), (3, None), (4, "..."), (10, long), (None, "only here")], "item_id bigint, text string")


def test_decontamination_by_hand(spark, bench):
    words = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([
        (1, "x " * 10 + words), (2, " ".join(f"w{k}" for k in range(12))), (3, "say SHORT, item!"), (4, None), (5, "w1 " + "y " * 400 + "short item"),
        (6, " ".join(f"w{k}" for k in range(3, 16)) + " " + " ".join(f"w{k}" for k in range(20))), (7, "É é")], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontamination.contamination(docs, bench).collect()}
    assert got == {1: (30, 20, 2, True), 2: (12, 0, 0, False), 3: (3, 2, 1, True), 4: (0, 0, 0, False), 5: (403, 2, 1, False),
                   6: (33, 33, 2, True), 7: (2, 0, 0, False)}
    sha = {r.doc_id: r.items_sha256 for r in decontamination.contamination(docs, bench).collect()}
    assert sha[1] == hashlib.sha256(b"1,10").hexdigest() and sha[2] == hashlib.sha256(b"").hexdigest()
    assert {r.doc_id for r in decontamination.remove_documents(docs, bench).collect()} == {2, 4, 5, 7}
    cut = {r.doc_id: r.text for r in decontamination.remove_spans(docs, bench).collect()}
    assert cut[1].split() == ["x"] * 10 and cut[3] == "say " and cut[4] is None and cut[2] == " ".join(f"w{k}" for k in range(12))


def test_decontamination_without_broadcast_is_the_same(spark, bench, edges, nothing):
    docs = edges.select("doc_id", "text")
    rows = lambda limit: sorted(map(str, decontamination.contamination(docs, bench, max_broadcast=limit).collect()))
    assert rows(0) == rows(1000) and len(rows(0)) == edges.count()
    assert decontamination.contamination(nothing, bench).count() == 0
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.contamination(docs, empty).filter("contaminated or n_hit > 0").count() == 0
    assert decontamination.remove_documents(edges, empty).columns == edges.columns
    assert decontamination.remove_documents(edges, empty).count() == edges.count()


def test_mixture_edges(edges, nothing):
    rows = mixing.mixture(edges).collect()
    assert len(rows) == edges.count() and mixing.mixture(nothing).count() == 0
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    mixed = mixing.mix(edges)
    assert mixed.columns == [*edges.columns, "copy"]
    taken = sum(r.taken for r in rows)
    assert sum(len((r.text or "").split()) for r in mixed.select("text").collect()) == pytest.approx(taken, abs=20)


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 1000), (None, 500), ("d", 0)], "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    total = 1.5 * 2510
    # a 5, b 2, c 1, d 5, null 2; b, d and a are full, c and null share what is left
    assert got["b"] == 20 and got["d"] == 0 and got["a"] == 2000
    assert sum(got.values()) == pytest.approx(total, abs=1e-3)
    assert got["c"] == pytest.approx((total - 2020 - 1000), abs=1e-3) and got[None] == 1000


def test_one_source_gets_its_limit(spark):
    docs = spark.createDataFrame([(k, "w " * (k % 7), "s") for k in range(300)], "doc_id bigint, text string, source string")
    rows = mixing.mixture(docs).collect()
    total = sum(r.size for r in rows)
    assert all(r.target == 1.5 * total for r in rows)
    assert abs(sum(r.taken for r in rows) - 1.5 * total) <= 7
