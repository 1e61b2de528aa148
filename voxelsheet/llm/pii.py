"""Personal data: fixed patterns, and spans of a semi-Markov conditional random field.

The patterns decide the base spans. They also label the segments the field is
trained on: words with digits, at-signs or signs for them form chains; a segmentation
of a chain gives every run of up to ``LONGEST`` words a kind or leaves single
words alone. A segment is scored by features of its whole span and of the words beside
it, and dynamic programming over the chain finds boundaries and kinds together.
Besides the chains themselves, the field learns from copies in which a base span is
written in another way: separators and prefixes swapped or dropped. Spans the
field is sure of and that touch no base span are added. A chain of over 192
words is worked in windows that overlap by ``LONGEST`` words, so no span is cut.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow import add_columns, fold
from .sums import vector_sum
from .words import slices

KINDS = ("email", "ip", "card", "phone")
LONGEST = 6
BUCKETS = 1 << 13

# The base patterns. A look-behind keeps a run from being tried anew at each of its characters.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at-sign has one run of local characters before it; a later start in the run can match only what the first one can."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        low = found.end() if found else at + 1
        at = text.find("@", low)


def base_spans(text: str) -> list[Span]:
    """Matches of the patterns, by kind and start; failing matches are dropped and not tried again."""
    out = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


_AT_DOT = re.compile(r"[\[({<](?:at|dot|\.|@)[\])}>]", re.IGNORECASE)
_HIT = re.compile(r"[0-9@]|[\[({<](?:at|dot|\.)[\])}>]", re.IGNORECASE)
_SPACE = re.compile(r"\s")
_WORD = re.compile(r"\S+")
_TRIM = ".,;:!?\"'<>[]{}|*#$%&"
GAP = 3

Word = tuple[int, int, bool]  # start, end, may a span begin or end here


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A word without outer punctuation; a sign for at or dot in brackets keeps these."""
    if _AT_DOT.fullmatch(text, a, min(b, a + 8)) and b - a <= 8:
        return a, b
    while a < b and text[a] in _TRIM:
        a += 1
    while b > a and text[b - 1] in _TRIM:
        b -= 1
    return a, b


def _hit_words(text: str) -> Iterator[tuple[int, int]]:
    """Whole words that hold a digit, an at-sign or a sign for one."""
    edge = 0
    while hit := _HIT.search(text, edge):
        start = max(edge, *(text.rfind(c, edge, hit.start()) + 1 for c in " \n\t\r"))
        for other in _SPACE.finditer(text, start, hit.start()):
            start = other.end()
        edge = _WORD.match(text, start).end()
        yield start, edge


def _neighbours(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """The words right before and after, if only a little white space is between."""
    before = len(text[max(0, a - GAP):a]) - len(text[max(0, a - GAP):a].rstrip())
    if before and a - before:
        end = start = a - before
        while start and not text[start - 1].isspace() and end - start < 64:
            start -= 1
        yield start, end
    after = len(text[b:b + GAP]) - len(text[b:b + GAP].lstrip())
    if after and (word := _WORD.match(text, b + after)):
        yield word.start(), word.end()


def zones(text: str) -> Iterator[list[Word]]:
    """Chains of words in which spans may lie, as (start, end, edge) without outer punctuation.

    Words with a digit or an at-sign belong to a chain, and the words beside a bracketed at or dot.
    Chains go on over at most ``GAP`` characters of white space. A chain has any length.
    """
    found: dict[tuple[int, int], bool] = {}
    for a, b in _hit_words(text):
        found[_trimmed(text, a, b)] = True
        if b - a <= 8 and _AT_DOT.fullmatch(text, a, b):
            for near in _neighbours(text, a, b):
                found.setdefault(_trimmed(text, *near), True)
    chain: list[Word] = []
    for (a, b), edge in sorted(found.items()):
        if a >= b or (chain and a < chain[-1][1]):
            continue
        if chain and (a - chain[-1][1] > GAP or not text[chain[-1][1]:a].isspace()):
            yield chain
            chain = []
        chain.append((a, b, edge))
    if chain:
        yield chain


def windows(chain: list[Word], size: int = 192) -> Iterator[tuple[list[Word], int, int]]:
    """A long chain in windows that overlap by ``LONGEST`` words on both sides: words, and which of them are the window's own."""
    for low in range(0, len(chain), size):
        first = max(0, low - LONGEST)
        yield chain[first:low + size + LONGEST], low - first, min(low + size, len(chain)) - first


def _shape(text: str) -> str:
    out = []
    for c in text:
        s = "9" if "0" <= c <= "9" else "a" if c.isalpha() else " " if c.isspace() else c
        if not out or out[-1][0] != s:
            out.append([s, 0])
        out[-1][1] += 1
    return "".join(s + (str(min(n, 5)) if s == "9" else "") for s, n in out)[:80]


def _beside(text: str, start: int, end: int) -> tuple[str, str]:
    """The words before and after, shortened."""
    before, after = text[max(0, start - 24):start].split(), text[end:end + 24].split()
    return (before[-1][-12:].lower() if before else ""), (after[0][:12].lower() if after else "")


def features(text: str, start: int, end: int, words: int) -> list[int]:
    """Buckets of the features of a candidate segment: of the whole span, and of the words beside it."""
    span = text[start:end]
    digits = _digits(span)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    letters = sum(c.isalpha() for c in span)
    parts = re.split(r"[^0-9]+", span.strip("()+ "))
    signs = sorted({c for c in span if not c.isalnum() and not c.isspace()})[:6]
    octets = len(parts) == 4 and all(p and len(p) <= 3 and int(p) <= 255 for p in parts)
    before, after = _beside(text, start, end)
    kinds = "".join("9" if "0" <= c <= "9" else "a" if c.isalpha() else "" for c in span[:1] + span[-1:])
    names = [
        "bias", f"words {words}", f"shape {_shape(span)}", f"digits {min(len(digits), 24)}", f"groups {min(len(groups), 8)}",
        f"longest {min(max(groups, default=0), 20)}", f"letters {min(letters, 4)}", f"at {span.count('@')}",
        f"dots {min(span.count('.'), 4)}", f"dashes {min(span.count('-'), 4)}", f"first {span[:1] if not span[:1].isalnum() else ''}",
        f"sum {len(digits) >= 12 and luhn(digits)} {16 <= len(digits) <= 19} {letters == 0}", f"octets {octets} {len(groups)} {letters == 0}", f"octets {octets} {''.join(signs)}", f"sum {luhn(digits)} {len(digits)} {''.join(signs)}",
        f"domain {'.' in span.partition('@')[2]} {'@' in span}", f"brackets {'(' in span and ')' in span}",
        f"spelled {len(_AT_DOT.findall(span))} {letters > 4} {kinds}", f"grouped {groups[:6]} {letters == 0}", f"signs {''.join(signs)} {len(digits) >= 8}",
        f"before {before}", f"after {after}",
    ]
    return [zlib.crc32(n.encode()) % BUCKETS for n in names]


# --- what else a span may look like ----------------------------------------------------


def _regrouped(digits: str, sizes: tuple[int, ...], sign: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(digits[at:at + n])
        at += n
    return sign.join([*out[:-1], out[-1] + digits[at:]])


def rewritten(kind: int, span: str, pick: int) -> tuple[str, bool]:
    """Another way to write a span of the patterns, and whether it still is one of its kind.

    Separators and prefixes are swapped or dropped; some card numbers and addresses get a digit that makes them wrong.
    """
    digits = _digits(span)
    if kind == 0:
        name, _, domain = span.partition("@")
        if pick % 3:  # names and hosts without numbers, and shorter hosts
            name, domain = re.sub("[0-9]+", "", name).strip("._-") or name, re.sub("[0-9]+", "", domain) if "-" not in domain else domain
        if pick % 5 > 2 and domain.count(".") > 1:
            domain = domain.partition(".")[2]
        at, dot = [("(at)", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", "."), (" (at) ", " (dot) "), ("[at]", "."), ("(at)", "(dot)"), (" [at] ", ".")][pick % 8]
        return name + at + domain.replace(".", dot), True
    if kind == 1:
        sign = ["[.]", "(.)", "[dot]", " [.] ", "(dot)"][pick % 5]
        parts = span.split(".")
        right = pick % 4 != 0
        if not right:
            parts[pick // 4 % 4] = str(300 + pick % 600)
        return sign.join(parts), right
    if kind == 2:
        right = pick % 3 != 0
        if not right:
            digits = digits[:5] + str((int(digits[5]) + 1) % 10) + digits[6:]
        return _regrouped(digits, (4, 4, 4, 4), [".", "/", "_", "\n", "\t", "  ", "--"][pick % 7]), right
    own = digits[-10:] if len(digits) >= 10 else digits
    return [
        f"({own[:3]}) {own[3:6]}-{own[6:]}", _regrouped(own, (3, 3, 4), "-"), _regrouped(own, (3, 3, 4), "."), f"({own[:3]}) {own[3:6]} {own[6:]}",
        span.replace(" ", "\n", 1), f"({own[:3]}){own[3:6]}-{own[6:]}", span.lstrip("+"), "00" + span.lstrip("+"), _regrouped(own, (3, 3, 4), " "), span.replace("-", ".").replace(" ", "."),
    ][pick % 10], True


AROUND, COPIES = 48, 4


def examples(text: str, chain: list[Word], gold: dict[tuple[int, int], int], seed: int = 0) -> Iterator[tuple[str, list[Word], dict[tuple[int, int], int]]]:
    """Training chains of a chain: itself, and copies in which one base span is written in another way."""
    low, high = chain[0][0], chain[-1][1]
    own = {(a, b): kind for (a, b), kind in gold.items() if a < high and b > low}
    edges = {a for a, _, _ in chain}, {b for _, b, _ in chain}
    if all(a in edges[0] and b in edges[1] for a, b in own):  # else its words do not end where the pattern does
        yield text, chain, own
    start = max(0, low - AROUND)
    before, after = text[start:low], text[high:high + AROUND]
    for (a, b), kind in own.items():
        if a < low or b > high:
            continue
        pick = zlib.crc32(f"{seed}:{text[a:b]}".encode())
        for k in range(COPIES):
            written, right = rewritten(kind, text[a:b], pick // (k + 1) + k * 7)
            copy = before + text[low:a] + written + text[b:high] + after
            shift = len(written) - (b - a)
            moved = {(x - start + shift * (x >= b), y - start + shift * (x >= b)): kind for (x, y), kind in own.items() if y <= a or x >= b}
            place = (a - start, a - start + len(written))
            for other in zones(copy):
                if other[0][0] < place[1] and other[-1][1] > place[0]:
                    inside = {s: kind for s, kind in moved.items() if s[0] < other[-1][1] and s[1] > other[0][0]} | ({place: kind} if right else {})
                    edges = {x for x, _, _ in other}, {y for _, y, _ in other}
                    if all(x in edges[0] and y in edges[1] for x, y in inside):
                        yield copy, other, inside


class Lattice:
    """Candidate segments of up to ``LONGEST`` words of a chain, with their feature buckets."""

    def __init__(self, text: str, chain: list[Word]):
        self.size = len(chain)
        self.cells = [(i, j, chain[i][0], chain[j - 1][1]) for j in range(1, self.size + 1) for i in range(max(0, j - LONGEST), j)]
        self.features = np.array([features(text, a, b, j - i) for i, j, a, b in self.cells])

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Segments by kinds; a word on its own without a kind scores 0."""
        return weights[:, self.features].sum(axis=2).T

    def forward(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log sums of all segmentations up to and from each word, and each segment's probability by kind."""
        n = self.size
        ahead, back = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
        ahead[0] = back[n] = 0.0
        total = np.logaddexp.reduce(scores, axis=1).tolist()
        for k, (i, j, _, _) in enumerate(self.cells):
            if i == j - 1:
                ahead[j] = _added(ahead[j], ahead[j - 1])
            ahead[j] = _added(ahead[j], ahead[i] + total[k])
        for k in range(len(self.cells) - 1, -1, -1):
            i, j, _, _ = self.cells[k]
            back[i] = _added(back[i], back[j] + total[k])
            if i == j - 1:
                back[i] = _added(back[i], back[j])
        edge = np.array([ahead[i] + back[j] for i, j, _, _ in self.cells])
        return np.array(ahead), np.array(back), np.exp(np.minimum(edge[:, None] + scores - ahead[n], 0.0))

    def best(self, scores: np.ndarray) -> list[tuple[int, int]]:
        """(segment, kind) of the highest scoring segmentation."""
        top = [0.0] + [-math.inf] * self.size
        choice: list[tuple[int, int] | None] = [None] * (self.size + 1)
        kinds, values = scores.argmax(axis=1).tolist(), scores.max(axis=1).tolist()
        for k, (i, j, _, _) in enumerate(self.cells):
            if i == j - 1 and top[i] >= top[j]:
                top[j], choice[j] = top[i], None
            if top[i] + values[k] > top[j]:
                top[j], choice[j] = top[i] + values[k], (k, kinds[k])
        out, j = [], self.size
        while j:
            if choice[j] is None:
                j -= 1
            else:
                out.append(choice[j])
                j = self.cells[choice[j][0]][0]
        return out[::-1]


def _added(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _train(weights: np.ndarray, inner: int, rate: float, ridge: float):
    def work(batches):
        own, grown = weights.copy(), np.zeros(weights.shape)
        for batch in batches:
            for part in slices(batch, "text"):
                for text in part.column("text").to_pylist():
                    if not text or not _HIT.search(text):
                        continue
                    gold = {(a, b): kind for kind, a, b in reversed(base_spans(text))}
                    order = sorted(gold)
                    for chain in zones(text):
                        for words, _, _ in windows(chain):
                            low, high = words[0][0], words[-1][1]
                            near = {}
                            for at in range(max(0, bisect.bisect_left(order, (low, 0)) - 4), len(order)):
                                if order[at][0] >= high:
                                    break
                                near[order[at]] = gold[order[at]]
                            for copy, other, inside in examples(text, words, near):
                                _step(Lattice(copy, other), inside, own, grown, inner, rate, ridge)
        visited = grown > 0
        return np.r_[(own * visited).ravel(), visited.ravel()]

    return work


def _step(lattice: Lattice, gold: dict, own: np.ndarray, grown: np.ndarray, inner: int, rate: float, ridge: float) -> None:
    """A few gradient steps on one chain; only the weights of its own features move."""
    target = np.zeros((len(lattice.cells), len(KINDS)))
    for k, (_, _, a, b) in enumerate(lattice.cells):
        if (a, b) in gold:
            target[k, gold[a, b]] = 1.0
    buckets, back = np.unique(lattice.features, return_inverse=True)
    back = back.reshape(lattice.features.shape)
    for _ in range(inner):
        miss = target - lattice.forward(lattice.scores(own))[2]
        slope = np.stack([np.bincount(back.ravel(), np.repeat(miss[:, kind], back.shape[1]), len(buckets)) for kind in range(len(KINDS))])
        slope -= ridge * own[:, buckets]
        grown[:, buckets] += slope * slope
        own[:, buckets] += rate * slope / np.sqrt(grown[:, buckets] + 1e-2)


def fit(docs: DataFrame, rounds: int = 3, inner: int = 3, rate: float = 0.5, ridge: float = 1e-3) -> np.ndarray:
    """Weights (kind by bucket), trained on the chains of ``docs``; after each round a weight is the mean over the tasks that met its feature."""
    weights = np.zeros((len(KINDS), BUCKETS))
    weights[:, zlib.crc32(b"bias") % BUCKETS] = -3.0
    for _ in range(rounds):
        total, visits = vector_sum(docs.select("text"), _train(weights, inner, rate, ridge), 2 * weights.size).reshape(2, *weights.shape)
        if not visits.any():
            break
        weights = np.where(visits > 0, total / np.maximum(visits, 1), weights)
    return weights


def added_spans(text: str, base: list[Span], weights: np.ndarray, sure: float) -> list[Span]:
    """Spans the field is sure of that touch no base span, in order; one pass over both lists."""
    taken: list[list[int]] = []
    for _, s, e in sorted(base, key=lambda x: x[1:]):
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    out, at, end = [], 0, 0
    for chain in zones(text):
        for words, low, high in windows(chain):
            lattice = Lattice(text, words)
            scores = lattice.scores(weights)
            chosen = [(k, kind) for k, kind in lattice.best(scores) if low <= lattice.cells[k][0] < high]
            if not chosen:
                continue
            chance = lattice.forward(scores)[2]
            for k, kind in chosen:
                _, _, a, b = lattice.cells[k]
                while at < len(taken) and taken[at][1] <= a:
                    at += 1
                if chance[k, kind] >= sure and a >= end and (at == len(taken) or b <= taken[at][0]):
                    out.append((kind, a, b))
                    end = b
    return out


def _named(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for kind, a, b in sorted(spans))


def _find(weights, sure: float):
    def make():
        def compute(part):
            rows = []
            for text in part.column("text").to_pylist():
                base = more = []
                if text and _HIT.search(text):
                    base = base_spans(text)
                    more = added_spans(text, base, weights.value, sure)
                counts = [sum(kind == k for kind, _, _ in base) for k in range(len(KINDS))]
                rows.append((*counts, sha256(_named(base).encode()).hexdigest(), _named(base + more), len(more)))
            kinds = [pa.int64()] * len(KINDS) + [pa.string(), pa.string(), pa.int64()]
            return [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]

        return compute

    return make


def find(docs: DataFrame, held_out: int = 1, sure: float = 0.6) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and the digest are of the pattern's spans; ``spans`` has these and
    ``n_added`` more. The field learns from documents whose crc32(doc_id) mod 3 is
    not ``held_out``. Null counts as empty: no spans, digest of the empty string.
    Where nothing is found in any document nothing is added. Repeated rows agree.
    """
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs.filter(fold(3) != held_out)))
    fields = ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, n_added bigint"
    return add_columns(docs.select("doc_id", "text"), _find(weights, sure), fields).drop("text")


def redact(text: str, spans: str) -> str:
    """The text with each span (of :func:`find`) replaced by its kind in brackets; of overlapping spans the first counts."""
    cuts = sorted((int(a), int(b), kind) for kind, a, b in (s.split(":") for s in spans.split(",") if s))
    out, at = [], 0
    for a, b, kind in cuts:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = b
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, held_out: int = 1, sure: float = 0.6) -> DataFrame:
    """doc_id, text with personal data replaced; null texts stay null, repeated rows stay repeated, an empty table stays empty."""
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs.filter(fold(3) != held_out)))

    def make():
        def compute(part):
            out = []
            for text in part.column("text").to_pylist():
                base = base_spans(text) if text and _HIT.search(text) else []
                more = added_spans(text, base, weights.value, sure) if text and _HIT.search(text) else []
                out.append(text if text is None else redact(text, _named(base + more)))
            return [pa.array(out, pa.string())]

        return compute

    return add_columns(docs.select("doc_id", "text"), make, "clean string").select("doc_id", F.col("clean").alias("text"))
