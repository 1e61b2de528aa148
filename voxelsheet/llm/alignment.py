"""Tokens of two tokenizers aligned by merge-path partitioning.

Both tokenizers cut the same bytes, so a document has two rising lists of token
ends. Merging the lists visits one pair of overlapping tokens a step: the token that
ends first is left behind, and where both end at once a group is complete. The
merge is cut into independent pieces of equal work: a binary search on each
diagonal of the merge finds how many tokens of either list lie before it. A piece
carries its tokens, the two that reach beyond it, and the bytes before it; it
gives its links by itself, and its first and last group are stitched to those of
its neighbours.

Documents are tokenized once and written as pieces. Links are counted per
document; the counts of the most frequent pairs are broadcast, the links of the
others meet their counts by a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, scratch_path
from .words import slices, text_bytes

BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
# Fixed value: the split pattern that goes with the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE = 1 << 14
FREQUENT = 1 << 19
KNOWN_SEGMENTS, KNOWN_TOKENS = 1 << 18, 1 << 23
#: A space at which a token of either kind begins, whatever surrounds it: alone between characters that are no blanks.
SEGMENT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def byte_tokens(vocabulary: bytes) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level vocabulary file; its special tokens are left out."""
    held = json.loads(vocabulary)
    special = {t["content"] for t in held.get("added_tokens", [])}
    symbols = byte_symbols()
    return {bytes(symbols[c] for c in token): number for token, number in held["model"]["vocab"].items() if token not in special}


def piece_bytes(piece: str) -> bytes:
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Tokenizers:
    """Both tokenizers, and the ids of the segments met before.

    Texts are cut where a token of either kind begins whatever surrounds it, so a
    segment has the same ids everywhere. New segments are encoded together, as one text.
    """

    def __init__(self, byte_vocabulary: bytes, piece_vocabulary: bytes):
        import sentencepiece
        import tiktoken

        ranks = byte_tokens(byte_vocabulary)
        self.a = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_vocabulary)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [piece_bytes(p) for p in pieces]
        # pieces that hold a blank behind other characters could cross the place where segments are cut
        self.cuttable = not any("▁" in p.lstrip("▁") for p in pieces)
        a_length = np.zeros(max(ranks.values()) + 1, np.int64)
        a_length[list(ranks.values())] = [len(t) for t in ranks]
        self.lengths = (a_length, np.array([len(b) for b in self.b_bytes], np.int64))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = [np.zeros(0, np.uint32)] * 2
        self.first = [np.zeros(1, np.int64)] * 2
        self.same = np.zeros(0, bool)

    def _alone(self, segment: str) -> tuple[list[int], list[int], bool]:
        whole = f" {segment}".encode()
        b = self.b.encode(segment)
        return self.a.encode_ordinary(f" {segment}"), b, b"".join([self.b_bytes[k] for k in b]) == whole

    def _together(self, segments: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]] | None:
        """Ids of all segments and how many each has, by one call; none if that is not certain to be right."""
        text = " ".join(segments)
        ends = np.cumsum([len(s.encode()) + 1 for s in segments])
        b = self.b.encode(text)
        if b"".join([self.b_bytes[k] for k in b]) != f" {text}".encode():
            return None
        ids, counts = [], []
        for found, length in zip((self.a.encode_ordinary(f" {text}"), b), self.lengths):
            ids.append(np.array(found, np.uint32))
            token_ends = np.cumsum(length[ids[-1]])
            last = np.searchsorted(token_ends, ends)
            if (token_ends[last] != ends).any():
                return None
            counts.append(np.diff(last, prepend=-1))
        return ids, counts

    def _learn(self, segments: list[str], odd: set[str]) -> None:
        """Add new segments to the known ones; those with blanks at their borders or the sign for a blank are encoded one by one."""
        plain, odd = [s for s in segments if s not in odd], [s for s in segments if s in odd]
        made = self._together(plain) if plain else ([np.zeros(0, np.uint32)] * 2, [np.zeros(0, np.int64)] * 2)
        if made is None:
            odd, plain, made = plain + odd, [], ([np.zeros(0, np.uint32)] * 2, [np.zeros(0, np.int64)] * 2)
        alone = [self._alone(s) for s in odd]
        for k in range(2):
            ids = np.concatenate([made[0][k], *[np.array(x[k], np.uint32) for x in alone]])
            counts = np.r_[made[1][k], np.array([len(x[k]) for x in alone], np.int64)]
            self.first[k] = np.r_[self.first[k], self.first[k][-1] + np.cumsum(counts)]
            self.ids[k] = np.r_[self.ids[k], ids]
        self.same = np.r_[self.same, np.ones(len(plain), bool), np.array([x[2] for x in alone], bool)]
        for s in plain + odd:
            self.known[s] = len(self.known)

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of all texts, A's and B's, and for each side where each text begins; no tokens if a text is empty or its bytes differ."""
        if len(self.known) > KNOWN_SEGMENTS or self.first[0][-1] + self.first[1][-1] > KNOWN_TOKENS:
            self._forget()
        parts = [SEGMENT.split(t) if self.cuttable else [t] for t in texts if t]
        if not parts:
            return [np.zeros(0, np.uint32)] * 2, [np.zeros(len(texts) + 1, np.int64)] * 2
        flat = [s for part in parts for s in part]
        # only the first and the last segment of a text can have blanks at their borders
        odd = {s for part in parts for s in (part[0], part[-1]) if s[0].isspace() or s[-1].isspace()}
        odd |= {s for part, text in zip(parts, filter(None, texts)) if "▁" in text for s in part if "▁" in s}
        self._learn([s for s in dict.fromkeys(flat) if s not in self.known], odd)
        number = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        held = np.zeros(len(texts), np.int64)
        held[[k for k, t in enumerate(texts) if t]] = [len(part) for part in parts]
        owner = np.repeat(np.arange(len(texts)), held)
        good = np.ones(len(texts), bool)
        good[owner[~self.same[number]]] = False
        number, owner = number[good[owner]], owner[good[owner]]
        ids, first = [], []
        for k in range(2):
            start, count = self.first[k][number], np.diff(self.first[k])[number]
            end = np.cumsum(count)
            ids.append(self.ids[k][np.repeat(start - end + count, count) + np.arange(end[-1] if len(end) else 0)])
            first.append(np.r_[0, np.cumsum(np.bincount(owner, count, len(texts)).astype(np.int64))])
        return ids, first


def id_kind(lengths: tuple[np.ndarray, np.ndarray]) -> str:
    """How ids are stored: two bytes, where no vocabulary needs more."""
    return "<u2" if max(map(len, lengths)) <= 1 << 16 else "<u4"


def split_points(ends_a: np.ndarray, ends_b: np.ndarray, diagonals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each diagonal, the numbers of A and B ends before it in their merge (A first where equal).

    All diagonals are searched at once by halving. Equal ends are not parted: a
    diagonal between them takes one B end more.
    """
    low, high = np.maximum(diagonals - len(ends_b), 0), np.minimum(diagonals, len(ends_a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        i, j = middle[open_], (diagonals - middle - 1)[open_]
        take = ends_a[i] <= ends_b[j]
        low[open_] = np.where(take, i + 1, low[open_])
        high[open_] = np.where(take, high[open_], i)
    i, j = low, diagonals - low
    inside = (i > 0) & (j < len(ends_b))
    equal = np.zeros(len(i), bool)
    equal[inside] = ends_a[i[inside] - 1] == ends_b[j[inside]]
    return i, j + equal


def _encoded(shared, piece: int):
    """Rows of pieces: the tokens of each and the two that reach beyond it, and the bytes before its first tokens."""

    def work(batches):
        coders = Tokenizers(*shared.value)
        kind = id_kind(coders.lengths)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, first = coders.encode(part.column("text").to_pylist())
                flat = [x.astype(kind) for x in ids]
                out = []
                for at in range(part.num_rows):
                    (a0, a1), (b0, b1) = ((f[at], f[at + 1]) for f in first)
                    n_a, n_b = a1 - a0, b1 - b0
                    if n_a + n_b <= piece:
                        out.append((at, 0, 1, flat[0][a0:a1].tobytes(), flat[1][b0:b1].tobytes(), n_a, n_b, 0, 0))
                        continue
                    ends_a, ends_b = (np.cumsum(length[x[u:v]]) for length, x, u, v in zip(coders.lengths, ids, (a0, b0), (a1, b1)))
                    count = -(-(n_a + n_b) // piece)
                    i, j = split_points(ends_a, ends_b, np.arange(1, count) * (n_a + n_b) // count)
                    i, j = np.r_[0, i, n_a], np.r_[0, j, n_b]
                    for k in range(count):
                        beyond = k < count - 1
                        out.append((at, k, count, flat[0][a0 + i[k]:a0 + i[k + 1] + beyond].tobytes(), flat[1][b0 + j[k]:b0 + j[k + 1] + beyond].tobytes(), i[k + 1] - i[k],
                                    j[k + 1] - j[k], ends_a[i[k] - 1] if i[k] else 0, ends_b[j[k] - 1] if j[k] else 0))
                take, *columns = zip(*out)
                take = pa.array(take, pa.int64())
                kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row").take(take), part.column("doc_id").take(take), *[pa.array(v, k) for v, k in zip(columns, kinds)]],
                    names=["row", "doc_id", "piece", "pieces", "a", "b", "n_a", "n_b", "start_a", "start_b"])

    return work


class Merged:
    """The merges of a run of pieces, worked at once: their ends are set one behind the other."""

    def __init__(self, part: pa.RecordBatch, lengths: tuple[np.ndarray, np.ndarray]):
        self.rows = part.num_rows
        self.piece, self.pieces = part.column("piece").to_numpy(), part.column("pieces").to_numpy()
        sides, kind = [], np.dtype(id_kind(lengths))
        for name, length in zip("ab", lengths):
            data, offsets = text_bytes(part.column(name))
            ids, held = data.view(kind), np.diff(offsets) // kind.itemsize
            row = np.repeat(np.arange(self.rows), held)
            first = np.cumsum(held) - held
            total = np.r_[0, np.cumsum(length[ids])]
            ends = total[1:] - total[first][row] + part.column(f"start_{name}").to_numpy()[row]
            own = np.arange(len(ids)) - first[row] < part.column(f"n_{name}").to_numpy()[row]
            sides.append((ids.astype(np.int64), row, ends, own))
        (self.a, self.row_a, ends_a, self.own_a), (self.b, self.row_b, ends_b, self.own_b) = sides
        base = np.zeros(self.rows + 1, np.int64)
        for row, ends in ((self.row_a, ends_a), (self.row_b, ends_b)):
            np.maximum.at(base, row + 1, ends + 1)
        base = np.cumsum(base)[:-1]
        ends_a, ends_b = ends_a + base[self.row_a], ends_b + base[self.row_b]
        to_b, to_a = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)
        self.tie_a = self._equal(ends_a, ends_b, to_b) & self.own_a
        self.tie_b = self._equal(ends_b, ends_a, to_a) & self.own_b
        i, j = np.flatnonzero(self.own_a), np.flatnonzero(self.own_b & ~self.tie_b)
        #: Link by link: the piece, the A id and the B id.
        self.link = (np.r_[self.row_a[i], self.row_b[j]], np.r_[self.a[i], self.a[to_a[j]]], np.r_[self.b[to_b[i]], self.b[j]])

    @staticmethod
    def _equal(ends: np.ndarray, others: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = at < len(others)
        out[out] = others[at[out]] == ends[out]
        return out

    def count(self, mask: np.ndarray, row: np.ndarray) -> np.ndarray:
        return np.bincount(row[mask], minlength=self.rows)

    def distinct_links(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece, pair (A id x ``width`` + B id) and number of links of each pair in each piece."""
        row, a, b = self.link
        pair = a * width + b
        order = np.lexsort((pair, row))
        row, pair = row[order], pair[order]
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])]) if len(row) else np.zeros(0, int)
        return row[first], pair[first], np.diff(np.r_[first, len(row)])

    def groups(self) -> list[tuple[str, str, str, str, str]]:
        """Of each piece: ids of A and B up to its first tie, the whole groups between, ids of A and B behind its last tie."""
        out = []
        edge_a, edge_b = np.searchsorted(self.row_a, np.arange(self.rows + 1)), np.searchsorted(self.row_b, np.arange(self.rows + 1))
        for r in range(self.rows):
            sa, sb = slice(edge_a[r], edge_a[r + 1]), slice(edge_b[r], edge_b[r + 1])
            a, b = self.a[sa][self.own_a[sa]], self.b[sb][self.own_b[sb]]
            tie_a, tie_b = (np.flatnonzero(t[s][o[s]]) for t, s, o in ((self.tie_a, sa, self.own_a), (self.tie_b, sb, self.own_b)))
            if not len(tie_a):
                out.append((_listed(a), _listed(b), "", "", ""))
                continue
            head = (tie_a[0] + 1, tie_b[0] + 1) if self.piece[r] else (0, 0)
            tail = (tie_a[-1] + 1, tie_b[-1] + 1)
            middle = _grouped(a[head[0]:tail[0]], b[head[1]:tail[1]], tie_a[tie_a >= head[0]] - head[0], tie_b[tie_b >= head[1]] - head[1])
            out.append((_listed(a[:head[0]]), _listed(b[:head[1]]), middle, _listed(a[tail[0]:]), _listed(b[tail[1]:])))
        return out


def _listed(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


_ENDINGS: list[str] = []


def _grouped(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
    """Whole groups as text, given the place of the last token of each group."""
    if not len(a):
        return ""
    if not _ENDINGS or 3 * max(a.max(), b.max()) + 2 >= len(_ENDINGS):
        top = int(max(a.max(), b.max(), 1 << 16)) + 1
        _ENDINGS[:] = [f"{k}{mark}" for k in range(top) for mark in ",|;"]
    mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    mark_a[last_a], mark_b[last_b] = 1, 2
    group_a, group_b = np.cumsum(mark_a > 0) - (mark_a > 0), np.cumsum(mark_b > 0) - (mark_b > 0)
    before_a, before_b = np.r_[0, last_b + 1], last_a + 1  # B tokens of earlier groups, A tokens of earlier groups and this one
    codes = np.zeros(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + before_a[group_a]] = 3 * a + mark_a
    codes[np.arange(len(b)) + before_b[group_b]] = 3 * b + mark_b
    return "".join(map(_ENDINGS.__getitem__, codes.tolist()))[:-1]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _counted(shared, width: int, long: bool):
    """Pairs and the number of documents with them; of long documents, a row for each piece that has the pair."""

    def work(batches):
        lengths = shared.value
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "a", 1 << 17):
                row, pair, _ = Merged(part, lengths).distinct_links(width)
                if long:
                    yield pa.record_batch([part.column("row").take(pa.array(row)), pa.array(pair)], names=["row", "pair"])
                    continue
                held.append(np.column_stack(np.unique(pair, return_counts=True)))
                size += len(held[-1])
                if size > 1 << 20:
                    held = [_added(np.concatenate(held))]
                    if (size := len(held[0])) > 1 << 19:
                        yield pa.record_batch([pa.array(held[0][:, k].copy()) for k in (0, 1)], names=["pair", "docs"])
                        held, size = [], 0
        if held:
            whole = _added(np.concatenate(held))
            yield pa.record_batch([pa.array(whole[:, k].copy()) for k in (0, 1)], names=["pair", "docs"])

    return work


def _added(rows: np.ndarray) -> np.ndarray:
    pair, back = np.unique(rows[:, 0], return_inverse=True)
    return np.column_stack([pair, np.bincount(back, rows[:, 1], len(pair)).astype(np.int64)])


def pair_counts(tokens: DataFrame, lengths, width: int) -> DataFrame:
    """pair, docs (documents that hold it linked), best (no other pair of the A id has more), written once."""
    short = tokens.filter("not long").mapInArrow(_counted(lengths, width, False), "pair bigint, docs bigint")
    long = tokens.filter("long").mapInArrow(_counted(lengths, width, True), "row bigint, pair bigint")
    long = long.distinct().groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    whole = materialize(short.union(long).groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("id", F.floor(F.col("pair") / width)), "pairs")
    most = whole.groupBy("id").agg(F.max("docs").alias("most"))
    return materialize(whole.join(most, "id").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "counts")


def _frequent(counts: DataFrame, most: int) -> int:
    """The least power of two such that ``most`` pairs at most are in as many documents or more."""
    sizes = {r.level: r.n for r in counts.groupBy(F.floor(F.log2("docs")).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = 0
    for level in sorted(sizes, reverse=True):
        total += sizes[level]
        if total > most:
            return 1 << (level + 1)
    return 1


def _judged(shared, width: int):
    """One row a piece with what it knows, and a row for each of its pairs whose count is not at hand."""
    fields = ("n_groups", "n_links", "n_best", "count_sum")
    texts = ("head_a", "head_b", "middle", "tail_a", "tail_b")

    def work(batches):
        lengths, (pairs, docs, best) = shared.value
        for batch in batches:
            for part in slices(batch, "a", 1 << 17):
                merged = Merged(part, lengths)
                row, pair, n = merged.distinct_links(width)
                at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
                known = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
                n_best, count_sum = np.zeros(merged.rows, np.int64), np.zeros(merged.rows, np.int64)
                np.add.at(count_sum, row[known], n[known] * docs[at[known]])
                np.add.at(n_best, row[known], n[known] * best[at[known]])
                numbers = (merged.count(merged.tie_a, merged.row_a), np.bincount(merged.link[0], minlength=merged.rows), n_best, count_sum)
                groups = merged.groups()
                single = merged.pieces == 1
                sha = [_sha(g[2]) if s and n_a else "" if s else None for g, s, n_a in zip(groups, single, part.column("n_a").to_pylist())]
                none = pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in ("row", "doc_id", "piece", "n_a", "n_b")], *[pa.array(x, pa.int64()) for x in numbers], pa.array(sha, pa.string()),
                     *[pa.array([None if s else g[k] for g, s in zip(groups, single)], pa.string()) for k in range(5)], none, none],
                    names=["row", "doc_id", "piece", "n_a", "n_b", *fields, "sha", *texts, "pair", "n"])
                if not known.all():
                    rest = ~known
                    size = int(rest.sum())
                    yield pa.RecordBatch.from_arrays(
                        [part.column("row").take(pa.array(row[rest])), pa.nulls(size, part.column("doc_id").type), pa.nulls(size, pa.int32()),
                         *[pa.nulls(size, pa.int64())] * 6, *[pa.nulls(size, pa.string())] * 6, pa.array(pair[rest]), pa.array(n[rest])],
                        names=["row", "doc_id", "piece", "n_a", "n_b", *fields, "sha", *texts, "pair", "n"])

    return work


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each document's groups from its pieces, which arrive in order."""
    row, digest, open_a, open_b, begun = None, None, [], [], False

    def close(middle: str) -> None:
        nonlocal begun
        if middle:
            digest.update(((";" if begun else "") + middle).encode())
            begun = True

    def done():
        return pa.record_batch([pa.array([row], pa.int64()), pa.array([digest.hexdigest()])], names=["row", "whole"])

    for batch in batches:
        for piece in batch.to_pylist():
            if piece["row"] != row:
                if row is not None:
                    yield done()
                row, digest, open_a, open_b, begun = piece["row"], hashlib.sha256(), [], [], False
            open_a += [piece["head_a"]] if piece["head_a"] else []
            open_b += [piece["head_b"]] if piece["head_b"] else []
            if piece["n_groups"]:
                if open_a or open_b:
                    close(",".join(open_a) + "|" + ",".join(open_b))
                close(piece["middle"])
                open_a, open_b = ([piece[c]] if piece[c] else [] for c in ("tail_a", "tail_b"))
    if row is not None:
        yield done()


def align(docs: DataFrame, byte_vocabulary: str = BYTE_VOCABULARY, piece_vocabulary: str = PIECE_VOCABULARY, piece: int = PIECE,
          frequent: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level vocabulary file, read on space + text; B a piece model that
    puts the space itself. Offsets where tokens of both end cut them into groups. A link is a pair of
    token occurrences whose bytes overlap; the count of its ids is the number of
    documents that link them anywhere, a repeated row counting as a document of its own.
    Null and empty texts, and those that B's bytes do not give back, have no
    tokens: zeros and an empty hash. An empty table gives no rows.

    Vocabularies are read on the driver and sent to the tasks (some 2 MB); so are the
    counts of at most ``frequent`` pairs, the most frequent ones. The links of a
    document with other pairs are counted by a shuffle, in which no pair can be hot.
    """
    context = docs.sparkSession.sparkContext
    files = []
    for path in (byte_vocabulary, piece_vocabulary):
        with open(path, "rb") as f:
            files.append(f.read())
    coders = Tokenizers(*files)
    lengths, width = coders.lengths, len(coders.lengths[1])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "row bigint, doc_id bigint, piece int, pieces int, a binary, b binary, n_a bigint, n_b bigint, start_a bigint, start_b bigint"
    pieces = rows.mapInArrow(_encoded(context.broadcast(files), piece), schema).withColumn("long", F.col("pieces") > 1)
    path = scratch_path(docs.sparkSession, "tokens")
    pieces.write.partitionBy("long").option("compression", "zstd").parquet(path)
    tokens = docs.sparkSession.read.schema(pieces.schema).parquet(path)
    counts = pair_counts(tokens, context.broadcast(lengths), width)
    top = counts.filter(F.col("docs") >= _frequent(counts, frequent)).toArrow().sort_by("pair")
    known = (top.column("pair").to_numpy(), top.column("docs").to_numpy(), top.column("best").to_numpy().astype(np.int64))
    fields = ("row bigint, doc_id bigint, piece int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, sha string, "
              "head_a string, head_b string, middle string, tail_a string, tail_b string, pair bigint, n bigint")
    judged = tokens.drop("long").mapInArrow(_judged(context.broadcast((lengths, known)), width), fields)
    judged = materialize(judged, "judged")
    rare = judged.filter("pair is not null").select("row", "pair", "n").join(counts, "pair")
    rare = rare.select("row", (F.col("n") * F.col("best").cast("bigint")).alias("n_best"), (F.col("n") * F.col("docs")).alias("count_sum"))
    own = judged.filter("pair is null")
    stitched = own.filter("sha is null").select("row", "piece", "n_groups", "head_a", "head_b", "middle", "tail_a", "tail_b")
    stitched = stitched.repartition("row").sortWithinPartitions("row", "piece").mapInArrow(_stitched, "row bigint, whole string")
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    nothing = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    parts = own.select("row", "doc_id", *numbers, "sha").unionByName(
        rare.select("row", *nothing("bigint", "doc_id", *numbers[:4]), "n_best", "count_sum", *nothing("string", "sha"))).unionByName(
        stitched.select("row", *nothing("bigint", "doc_id", *numbers), F.col("whole").alias("sha")))
    whole = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in numbers], F.max("sha").alias("groups_sha256"))
    return whole.drop("row")
