"""Secrets: fixed patterns, and strings a learned credential grammar finds likely.

The patterns decide the base spans, which are the labelled credentials. For
each kind a probabilistic automaton is inferred from a bounded set of different
credentials by merging compatible states of their prefix tree. Every other run
of 12 or more credential characters is a candidate; it is added where its best
automaton finds it likelier, by symbol, than the pairs of symbols in all
documents do, and as likely as known credentials of that kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow import add_columns, fold
from .automata import Automaton, infer
from .sums import vector_sum
from .words import slices, text_bytes

KINDS = ("assign", "access", "hex")

# The base patterns.
_ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = 12
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST)

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """Matches of the patterns, by start and kind; failing matches are dropped and not tried again."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def credentials(text: str) -> Iterator[tuple[int, str]]:
    """The secret part of each base span, with its kind."""
    for start, kind, end in base_spans(text):
        whole = text[start:end]
        yield kind, _ASSIGN.match(whole)[1] if kind == 0 else whole


def _symbol_table() -> np.ndarray:
    table = np.full(256, ord("~"), np.uint8)
    for low, high, symbol in (("a", "f", "a"), ("g", "z", "g"), ("A", "F", "A"), ("G", "Z", "G"), ("0", "9", "0")):
        table[ord(low):ord(high) + 1] = ord(symbol)
    for c in "+/_.=-":
        table[ord(c)] = ord(c)
    return table


_SYMBOL = _symbol_table()


def symbols(value: str) -> str:
    """Letters and digits by class (hexadecimal letters apart), other characters as they are."""
    return _SYMBOL[np.frombuffer(value.encode("utf-8", "replace"), np.uint8)].tobytes().decode()


def _pairs(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    total = np.zeros(1 << 14)
    for batch in batches:
        for part in slices(batch, "text"):
            data, _ = text_bytes(part.column("text"))
            kind = _SYMBOL[data].astype(np.int32)
            total += np.bincount(kind[:-1] << 7 | kind[1:], minlength=1 << 14)
    return total


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column("text").to_pylist():
            found = list(credentials(text)) if text else []
            if found:
                yield pa.record_batch([pa.array([k for k, _ in found], pa.int32()), pa.array([v for _, v in found], pa.string())], names=["kind", "value"])


class Grammar:
    """An automaton per kind, the limit its own examples set, and the background of symbol pairs."""

    def __init__(self, examples: dict[int, list[str]], pairs: np.ndarray, limit: float = 0.05):
        table = pairs.reshape(128, 128) + 0.5
        self.pairs = np.log(table / table.sum(axis=1, keepdims=True))
        self.automata: dict[int, tuple[Automaton, float]] = {}
        self.judged: dict[str, tuple[int, float] | None] = {}
        for kind, values in sorted(examples.items()):
            learn, check = values[::2], values[1::2] or values
            automaton = infer([symbols(v) for v in learn])
            scores = sorted(self._score(automaton, symbols(v)) for v in check)
            self.automata[kind] = automaton, max(0.0, scores[int(limit * len(scores))])

    def background(self, string: str) -> float:
        at = np.frombuffer(string.encode(), np.uint8)
        return float(self.pairs[at[:-1], at[1:]].sum() + self.pairs[ord("~"), at[0]])

    def _score(self, automaton: Automaton, string: str) -> float:
        """Log likelihood ratio per symbol."""
        return (automaton.log_chance(string) - self.background(string)) / (len(string) + 1)

    def judge(self, value: str) -> tuple[int, float] | None:
        """Best kind and its score, if it reaches that kind's limit."""
        string = symbols(value)
        if string in self.judged:
            return self.judged[string]
        if len(self.judged) >= 1 << 16:
            self.judged.clear()
        best = None
        for kind, (automaton, limit) in self.automata.items():
            score = self._score(automaton, string)
            if score >= limit and score > 0 and (best is None or score > best[1]):
                best = kind, score
        self.judged[string] = best
        return best

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Likely runs outside the base spans; of a dotted run that is not likely as a whole, its likely parts."""
        out, low = [], 0
        for start, end in [*sorted((s, e) for s, _, e in base), (len(text), len(text))]:
            for m in _CANDIDATE.finditer(text, low, max(low, start)):
                runs = [(m.start() + r.start(), m.start() + r.end()) for r in re.finditer(r"[^.](?:.*[^.])?", m[0])]
                parts = [(m.start() + r.start(), m.start() + r.end()) for r in re.finditer(r"[^.]+", m[0])]
                for tried in (runs, parts):
                    verdicts = [(a, self.judge(text[a:b]), b) for a, b in tried if b - a >= LEAST]
                    found = [(a, verdict[0], b) for a, verdict, b in verdicts if verdict]
                    if found:
                        out += found
                        break
            low = max(low, end)
        return out


def learn(docs: DataFrame, most: int = 400) -> Grammar:
    """A grammar from ``docs``: at most ``most`` different credentials of each kind (by hash), symbol pairs of all texts.

    Credentials of more than 512 characters are not learned from; prefix trees would grow with their length.
    """
    found = docs.select("text").mapInArrow(_examples, "kind int, value string").filter(F.length("value") <= 512)
    examples: dict[int, list[str]] = {}
    for kind in range(len(KINDS)):
        values = found.filter(F.col("kind") == kind).select("value").distinct().orderBy(F.xxhash64("value"), "value").limit(most)
        if rows := values.collect():
            examples[kind] = [r.value for r in rows]
    return Grammar(examples, vector_sum(docs.select("text"), _pairs, 1 << 14))


def _named(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in sorted(spans))


def _scan(grammar):
    def make():
        def compute(part):
            rows = []
            for text in part.column("text").to_pylist():
                base = base_spans(text) if text else []
                more = grammar.value.added(text, base) if text else []
                counts = [sum(kind == k for _, kind, _ in base) for k in range(len(KINDS))]
                rows.append((*counts, sha256(_named(base).encode()).hexdigest(), _named(base + more), len(more)))
            kinds = [pa.int64()] * len(KINDS) + [pa.string(), pa.string(), pa.int64()]
            return [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]

        return compute

    return make


def scan(docs: DataFrame, held_out: int = 1, most: int = 400) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added.

    The counts and the digest are of the pattern's spans; ``spans`` has these and
    ``n_added`` more. The grammar learns from documents whose crc32(doc_id) mod 3 is
    not ``held_out``. Null counts as empty: no spans, digest of the empty string.
    Without any credential nothing is added. Repeated rows agree.
    """
    grammar = docs.sparkSession.sparkContext.broadcast(learn(docs.filter(fold(3) != held_out), most))
    fields = ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, n_added bigint"
    return add_columns(docs.select("doc_id", "text"), _scan(grammar), fields).drop("text")
