"""Word hashing, sums, calibration, the chain field and automata against plain Python."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from voxelsheet.llm import words
from voxelsheet.llm.automata import infer
from voxelsheet.llm.chain import Sequences, expected, marginals
from voxelsheet.llm.isotonic import pool
from voxelsheet.llm.sums import vector_sum

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAzZ09 .\néß日\x7f", max_size=30)), max_size=8))
def test_words_hash_by_content(texts):
    hashes, first = words.word_hashes(pa.array(texts, pa.string()))
    flat = [w for t in texts for w in plain_words(t)]
    assert np.diff(first).tolist() == [len(plain_words(t)) for t in texts]
    by_word = {}
    for word, h in zip(flat, hashes.tolist()):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_long_texts_hash_like_short_ones():
    text = " ".join(f"w{k % 50}" for k in range(5000)) + " " + "y" * 3000
    whole, _ = words.word_hashes(pa.array([text, "w1"]))
    pieces = list(words.runs(pa.array([text, "w1"]), 700))
    assert len(pieces) > 5 and "".join(p for part, owner in pieces for p, o in zip(part.to_pylist(), owner) if o == 0) == text
    cut = np.concatenate([words.word_hashes(part)[0] for part, _ in pieces])
    assert (cut[:5000] == whole[:5000]).all()


def test_span_longer_than_a_stretch():
    data = np.frombuffer(b"q" * 100, np.uint8)
    short = words.span_hashes(data, np.array([0]), np.array([100]))
    value = words._tables()[1]
    assert words._long_hash(data, value) == int(short[0])


def test_shingles_match_plain_ones():
    texts = ["a b c d e f", "a b", "", "b c d e f", None, "x a b c d e"]
    hashes, first = words.word_hashes(pa.array(texts, pa.string()))
    run, text = words.shingles(hashes, first, 5)
    want = []
    for k, t in enumerate(texts):
        w = plain_words(t)
        want += [(k, tuple(w[i:i + 5])) for i in range(len(w) - 4)] if len(w) >= 5 else [(k, tuple(w))] if w else []
    assert text.tolist() == [k for k, _ in want]
    names = {}
    for (_, shingle), h in zip(want, run.tolist()):
        assert names.setdefault(shingle, h) == h
    assert len(set(names.values())) == len(names)


def test_vector_sum_over_many_tasks(spark):
    def make(batches):
        total = np.zeros(40_000)
        for batch in batches:
            for v in batch.column(0).to_pylist():
                total[v % 40_000] += v
        return total

    got = vector_sum(spark.range(0, 5000, 1, 37), make, 40_000)
    assert got[:5000].tolist() == list(range(5000)) and not got[5000:].any()
    assert not vector_sum(spark.range(0), make, 40_000).any()


def test_isotonic_pools_violators():
    assert pool(np.array([1.0, 3.0, 2.0, 4.0]), np.ones(4)).tolist() == [1.0, 2.5, 2.5, 4.0]
    assert pool(np.array([3.0, 1.0]), np.array([1.0, 3.0])).tolist() == [1.5, 1.5]


def test_chain_matches_enumeration():
    draw = np.random.default_rng(3)
    lengths = [1, 4, 2, 0, 5]
    first = np.r_[0, np.cumsum(lengths)]
    psi = np.exp(draw.normal(size=first[-1]))
    start, t = 0.4, np.exp(draw.normal(size=(2, 2)))
    seq = Sequences(first)
    p, pairs = expected(seq, psi, start, t)
    want, want_pairs = np.zeros(first[-1]), np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:]):
        total = 0.0
        mine, mine_pairs = np.zeros(b - a), np.zeros((2, 2))
        for states in itertools.product((0, 1), repeat=b - a):
            weight = math.prod(psi[a + k] if s else 1.0 for k, s in enumerate(states)) * (start if states and states[0] else 1.0)
            weight *= math.prod(t[x, y] for x, y in itertools.pairwise(states))
            total += weight
            mine += weight * np.array(states)
            for x, y in itertools.pairwise(states):
                mine_pairs[x, y] += weight
        want[a:b] = mine / total
        want_pairs += mine_pairs / total
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs)
    assert np.allclose(marginals(seq, psi, start, t), want)


def test_automaton_tells_formats_apart():
    draw = random.Random(1)
    keys = ["KEY-" + "".join(draw.choice("0a") for _ in range(20)) for _ in range(300)]
    automaton = infer(keys)
    own = automaton.log_chance("KEY-" + "0a" * 10)
    assert own > automaton.log_chance("0a" * 12) and own > automaton.log_chance("KEY-" + "g" * 20)
    kept, todo = {0}, [0]
    while todo:
        for state, _ in automaton.steps[todo.pop()].values():
            if state not in kept:
                kept.add(state)
                todo.append(state)
    assert len(kept) < 150 and automaton.visits[0] == 300  # the tree has thousands of states
