"""The field's own spans: personal data written in other ways than the patterns know."""

import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelsheet.llm import pii

from .conftest import prose


def number(draw, n, right):
    while True:
        digits = "".join(draw.choice("0123456789") for _ in range(n))
        if digits[0] != "0" and pii.luhn(digits) == right:
            return digits


def cut(digits, sizes, sign):
    return pii._regrouped(digits, sizes, sign)


def person(draw):
    return "".join(draw.choice("abcdefghilmnoprstu") for _ in range(draw.randrange(3, 9)))


def corpus(n):
    """Texts with personal data as the patterns know it, and with other numbers."""
    draw = random.Random(1)
    rows = []
    for k in range(n):
        data = [f"{person(draw)}.{draw.randrange(99)}@mail{draw.randrange(9)}.{person(draw)}.com", ".".join(str(draw.randrange(256)) for _ in range(4)),
                cut(number(draw, 16, True), (4, 4, 4, 4), draw.choice([" ", "-", ""])), f"+1 ({draw.randrange(100, 999)}) {draw.randrange(100, 999)}-{draw.randrange(1000, 9999)}",
                str(draw.randrange(10**6)), f"{draw.randrange(1900, 2030)}-0{draw.randrange(1, 9)}-12", f"page {draw.randrange(400)}", f"{draw.randrange(99)}.{draw.randrange(99)}",
                cut(number(draw, 16, False), (4, 4, 4, 4), "-"), f"v{draw.randrange(9)}.{draw.randrange(9)}.{draw.randrange(20)}"]
        parts = prose(k, 30, "so the old house near a river is known to people here").split()
        parts.insert(draw.randrange(5, 25), data[k % len(data)])
        rows.append((k, " ".join(parts)))
    return rows


@pytest.fixture(scope="module")
def weights(spark):
    return pii.fit(spark.createDataFrame(corpus(2500), "doc_id bigint, text string").repartition(3))


def planted(seed, n):
    """Held-out texts: what stands in them, and its kind (none for what must be left alone)."""
    draw = random.Random(seed)
    for k in range(n):
        name, host = person(draw), person(draw)
        right, wrong = number(draw, 16, True), number(draw, 16, False)
        area, rest = draw.randrange(200, 999), (draw.randrange(100, 999), draw.randrange(1000, 9999))
        yield from [
            (0, f"{name} [at] {host} [dot] com"), (0, f"{name}(at){host}.com"), (0, f"{name}.{draw.randrange(99)} (at) mail.{host}.com"), (1, "[.]".join(str(draw.randrange(256)) for _ in range(4))),
            (2, cut(right, (4, 4, 4, 4), ".")), (2, cut(right, (4, 4, 4, 4), "/")), (3, f"({area}) {rest[0]}-{rest[1]}"), (3, f"{area}-{rest[0]}-{rest[1]}"), (3, f"{area}.{rest[0]}.{rest[1]}"),
            (None, cut(wrong, (4, 4, 4, 4), ".")), (None, "[.]".join(str(draw.randrange(300, 999)) for _ in range(4))), (None, f"{draw.randrange(1900, 2030)}-03-1{k % 10}"),
            (None, str(draw.randrange(10**6))), (None, f"({draw.randrange(99)})"), (None, f"{draw.randrange(24)}:{draw.randrange(10, 60)}"), (None, f"v{k % 7}.{k % 11}.{k % 13}")]


def test_spans_beyond_the_patterns(weights):
    """Recall and precision of what the field adds, on texts it has not seen, each kind by itself."""
    asked, found, wrong = Counter(), Counter(), 0
    for k, (kind, span) in enumerate(planted(7, 60)):
        text = f"{prose(k + 9000, 12, 'so the old house near a river is known')} {span} and so it goes on near the river"
        at = text.index(span)
        more = pii.added_spans(text, pii.base_spans(text), weights, 0.6)
        if kind is not None:
            asked[kind] += 1
            found[kind] += (kind, at, at + len(span)) in more
        wrong += sum(m != (kind, at, at + len(span)) for m in more)
    assert all(found[kind] >= 0.7 * asked[kind] for kind in asked), (found, asked)
    assert wrong <= 0.05 * sum(found.values()), (wrong, found)


def test_query_adds_them(spark):
    """Planted in documents that the field does not learn from."""
    phones = [span for kind, span in planted(3, 12) if kind == 3]
    held_out = [k for k in range(10_000, 11_000) if zlib.crc32(str(k).encode()) % 3 == 1][:len(phones)]
    rows = corpus(2000) + [(k, f"reach the house by {span} at any hour") for k, span in zip(held_out, phones)]
    got = pii.find(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).filter("doc_id >= 10000").collect()
    assert sum(r.n_added == 1 and r.spans.startswith("phone:19:") for r in got) >= 0.7 * len(got) and len(got) == 36


def test_chains_hold_whole_words_and_signs():
    show = lambda text: [[text[a:b] for a, b, _ in chain] for chain in pii.zones(text)]
    assert show("write joe [at] example [dot] com, now") == [["joe", "[at]", "example", "[dot]", "com"]]
    assert show("call (555) 123-4567, or  +1\t23") == [["(555)", "123-4567"], ["+1", "23"]]
    assert show("a" * 5000 + "@" + "b" * 5000 + ".com") == [["a" * 5000 + "@" + "b" * 5000 + ".com"]]
    assert show("[at] 5") == [["[at]", "5"]] and show("nothing here") == [] and show("1") == [["1"]]
    assert show("x　1　y 2") == [["1"], ["2"]] or show("x　1　y 2") == [["1"]] + [["2"]]


def test_windows_cover_a_chain_once_and_overlap():
    chain = [(3 * k, 3 * k + 2, True) for k in range(1000)]
    own = [w for words, low, high in pii.windows(chain) for w in words[low:high]]
    assert own == chain
    assert all(len(words) <= 192 + 2 * pii.LONGEST for words, _, _ in pii.windows(chain))


def test_time_is_linear_in_the_numbers(weights):
    """No comparison of each added span with every base span."""
    def took(n):
        text = " ".join(f"+1 (212) 555-{k % 9000 + 1000} 212-555-{k % 9000 + 1000}" for k in range(n))
        began = time.perf_counter()
        base = pii.base_spans(text)
        pii.added_spans(text, base, weights, 0.6)
        return time.perf_counter() - began

    took(200)
    assert took(3200) < 8 * took(800) + 0.5


def test_added_spans_touch_no_base_span_and_no_other(weights):
    for k, text in corpus(300):
        text = f"{text} {text} joe [at] example [dot] com"
        base = pii.base_spans(text)
        more = pii.added_spans(text, base, weights, 0.3)
        assert all(e <= s or b <= a for _, a, e in more for _, s, b in base)
        order = sorted((a, e) for _, a, e in more)
        assert all(x[1] <= y[0] for x, y in zip(order, order[1:]))


def test_rewritten_spans_keep_or_lose_their_kind():
    for pick in range(60):
        text, right = pii.rewritten(2, "4111 1111 1111 1111", pick)
        assert pii.luhn(pii._digits(text)) == right
        text, right = pii.rewritten(1, "1.22.33.44", pick)
        assert all(int(p) <= 255 for p in __import__("re").findall("[0-9]+", text)) == right
        assert "@" not in pii.rewritten(0, "joe.1@mail2.example.com", pick)[0]
        assert pii._digits(pii.rewritten(3, "+1 (212) 555-0123", pick)[0]).endswith("2125550123")


def test_redaction_in_one_pass(spark, edges, nothing):
    docs = spark.createDataFrame([(1, "mail joe@example.com"), (1, "mail joe@example.com"), (2, None), (None, "call +1 212 555 0123 now"), (3, "")], "doc_id bigint, text string")
    got = pii.redacted(docs)
    assert Counter(map(tuple, got.collect())) == Counter([(1, "mail [email]"), (1, "mail [email]"), (2, None), (None, "call [phone] now"), (3, "")])
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert pii.redacted(edges).count() == edges.count() and pii.redacted(nothing).count() == 0
    assert pii.redacted(edges).filter(F.col("text").isNull()).count() == edges.filter(F.col("text").isNull()).count()


def test_weights_of_nothing(spark, nothing):
    assert np.array_equal(pii.fit(nothing), pii.fit(spark.createDataFrame([(1, "no numbers at all")], "doc_id bigint, text string")))
