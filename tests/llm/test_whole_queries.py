"""Queries without SQL, recomputed in plain Python over the whole smallest tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from voxelsheet.llm import isotonic, language, quality, queries, toxicity
from voxelsheet.llm.words import mix

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def fold(doc, n):
    return zlib.crc32(str(doc).encode()) % n


# language: rank-order profiles


def gram_hash(*symbols):
    code = 0
    for s in symbols:
        code = code << 21 | s
    return int(mix(np.array([code], np.uint64))[0]) >> 24


def grams(text):
    """Counts of the 1- to 3-grams of every run of letters, with a blank at both ends."""
    out, word = Counter(), []
    for c in [*(text or "").lower(), " "]:
        if c.isalpha():
            word.append(ord(c))
        elif word:
            padded = [1, *word, 1]
            for a, b, c in zip(padded, padded[1:], padded[2:]):
                out[b,] += 1
                out[a, b] += 1
                out[a, b, c] += 1
                if c == 1:
                    out[b, c] += 1
            word = []
    return Counter({gram_hash(*g): n for g, n in out.items()})


def ranked(counts):
    return {g: k for k, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:language.PROFILE])}


def test_languages_by_rank_order(spark, tables):
    docs = [(r.doc_id, r.text, r.lang) for r in tables["documents"].collect()]
    counts = defaultdict(Counter)
    own = {doc: grams(text) for doc, text, _ in docs}
    for doc, _, lang in docs:
        if lang is not None and fold(doc, 3) != 1:
            counts[lang].update(own[doc])
    profiles = {lang: ranked(c) for lang, c in counts.items()}
    want = {}
    for doc, _, _ in docs:
        mine = ranked(own[doc])
        far = {lang: sum(abs(p[g] - k) if g in p else language.PROFILE for g, k in mine.items()) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        want[doc] = (best, max(0.0, 1 - far[best] / (len(mine) * language.PROFILE))) if mine else ("und", 0.0)
    got = {r.doc_id: r for r in queries.op10_language(spark, FOLDER).collect()}
    assert got.keys() == want.keys()
    for doc, (lang, score) in want.items():
        assert got[doc].lang_pred == lang and got[doc].score == pytest.approx(score, abs=1e-9) and got[doc].held_out == (fold(doc, 3) == 1)


# quality: statistics, ridge on random features, isotonic shares


def plain_statistics(text):
    data = (text or "").encode()
    size, whole = len(data), max(len(data), 1)
    count = lambda chars: sum(data.count(c) for c in chars.encode())
    lower, upper = count("abcdefghijklmnopqrstuvwxyz"), count("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    digits, space, newline, stops, bar = count("0123456789"), count(" \t\r\v\f"), count("\n"), count(".,;:'\"-?()"), count("|")
    other = sum(b >= 128 for b in data)
    symbols = size - lower - upper - digits - space - newline - stops - bar - other
    letters = lower + upper + other
    words = [w.encode().lower() for w in WORD.findall(text or "")]
    runs = [tuple(words[k:k + 3]) for k in range(len(words) - 2)] or ([tuple(words)] if words else [])
    lines = [x for k, x in enumerate(data.lower().split(b"\n")) if len(x) + (k < newline) > 1]
    share = lambda kinds, n: 1 - (kinds + (n == 0)) / max(n, 1)
    mean = sum(map(len, words)) / max(len(words), 1)
    spread = math.sqrt(max(sum(len(w) ** 2 for w in words) / max(len(words), 1) - mean**2, 0))
    return [math.log1p(size), max(letters, 1) / whole * (size > 0), upper / max(letters, 1), digits / whole, space / whole, newline / whole, stops / whole, symbols / whole,
            other / whole, data.count(b"!") / whole, bar / whole, mean, spread, math.log1p(len(words)), len(set(words)) / max(len(words), 1), share(len(set(runs)), len(runs)),
            share(len(set(lines)), len(lines)), math.log1p(size / max(len(lines), 1))]


def test_quality_by_one_system_of_equations(spark, tables):
    docs = {r.doc_id: r.text for r in tables["documents"].collect()}
    stats = {doc: plain_statistics(text) for doc, text in docs.items()}
    assert np.allclose([stats[d] for d in docs], quality.statistics(pa.array(list(docs.values()), pa.string())))
    labels = [(r.doc_id, r.quality) for r in tables["labels"].collect() if r.quality is not None and fold(r.doc_id, 3) != 1 and r.doc_id in docs]
    x, y = np.array([stats[d] for d, _ in labels]), np.array([v for _, v in labels], float)
    scale = x.std(axis=0)
    model = quality.Model(x.mean(axis=0), np.where(scale > 1e-9, scale, 1.0))
    z = model.features(x)
    model.weights = np.linalg.solve(z.T @ z + 1e-4 * len(y) * np.eye(z.shape[1]), z.T @ y)
    raw = model.raw(x)
    bins = np.floor((np.clip(raw, -0.5, 1.5) + 0.5) / 2 * 1999)
    kinds = np.unique(bins)
    at, n, ones = (np.array([f(bins == b) for b in kinds]) for f in (lambda m: raw[m].mean(), lambda m: m.sum(), lambda m: y[m].sum()))
    calibrator = isotonic.Calibrator(at, isotonic.pool(ones / n, n.astype(float)))
    want = dict(zip(docs, calibrator(model.raw(np.array([stats[d] for d in docs])))))
    got = {r.doc_id: r for r in queries.op1_quality(spark, FOLDER).collect()}
    assert got.keys() == want.keys()
    apart = [abs(got[d].score - want[d]) for d in want]
    assert np.quantile(apart, 0.98) < 1e-3 and np.mean(apart) < 2e-3  # a row at the edge of a bin may fall to the other side
    assert all(got[d].predicted == (got[d].score >= 0.5) and got[d].held_out == (fold(d, 3) == 1) for d in got)


# toxicity: chains by hand


def plain_marginals(psi, start, between):
    """Probability of state 1 at every word of one sentence."""
    ahead = []
    for k, value in enumerate(psi):
        into = [1.0, start] if k == 0 else [sum(ahead[-1][a] * between[a][b] for a in (0, 1)) for b in (0, 1)]
        ahead.append([into[0], into[1] * value])
        total = sum(ahead[-1])
        ahead[-1] = [v / total for v in ahead[-1]]
    back, out = [1.0, 1.0], []
    for k in range(len(psi) - 1, -1, -1):
        both = [ahead[k][s] * back[s] for s in (0, 1)]
        out.append(both[1] / sum(both))
        back = [sum(between[s][b] * (psi[k] if b else 1.0) * back[b] for b in (0, 1)) for s in (0, 1)]
        back = [v / sum(back) for v in back]
    return out[::-1]


def test_toxic_scores_and_spans_by_hand(spark, tables):
    docs = [(r.doc_id, r.text) for r in tables["documents"].orderBy("doc_id").limit(60).collect()]
    marks = tables["labels"].filter("toxic is not null").selectExpr("doc_id", "cast(toxic as int) as label")
    model = toxicity.fit(tables["documents"].join(marks, "doc_id").select("text", "label"))
    start, between = model.field()
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in docs], pa.string())], names=["text"])
    raw, spans = (c.to_pylist() for c in toxicity._scores(model, 0.5)(batch))
    for (_, text), got, found in zip(docs, raw, spans):
        tokens = toxicity.Tokens(pa.array([text], pa.string()), np.zeros(1, np.int64))
        psi = [math.exp(min(max(sum(model.weights[b] for b in column), -30), 30)) for column in tokens.features.T.tolist()]
        lowered = (text or "").lower()
        words = [(m.start(), m.end()) for m in WORD.finditer(lowered)]
        assert len(words) == len(psi)
        sentence, chances = [], []
        for k, (a, _) in enumerate(words):
            if k and re.search(r"[.!?\n|;]", lowered[words[k - 1][1]:a]):
                chances += plain_marginals(sentence, start, between)
                sentence = []
            sentence.append(psi[k])
        chances += plain_marginals(sentence, start, between) if sentence else []
        assert got == pytest.approx(min(sum(-math.log1p(-min(p, 1 - 1e-9)) for p in chances if p >= 0.02), 20.0), rel=1e-6, abs=1e-9)
        assert found == ",".join(f"{a}:{b}" for (a, b), p in zip(words, chances) if p >= 0.5)
