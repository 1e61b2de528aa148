"""SimHash classes, token alignment and ranked search against plain Python."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from voxelsheet.llm import alignment, cuts, ranked_search, simhash

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("pattern", [cuts.WORD_END, cuts.BLANK, alignment.SEGMENT])
def test_stretches_lose_nothing(pattern):
    draw = random.Random(4)
    for _ in range(200):
        text = "".join(draw.choice("ab  \n日é,▁") for _ in range(draw.randrange(60)))
        parts = list(cuts.stretches(text, draw.randrange(1, 9), pattern))
        assert "".join(parts) == text
        assert all(pattern.match(text, sum(map(len, parts[:k]))) for k in range(1, len(parts)))


# SimHash


def plain_print(text):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids):
    top = list(range(len(prints)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                top[find(i)] = find(j)
    least = {}
    for k, doc in enumerate(ids):
        if doc is not None:
            least[find(k)] = min(doc, least.get(find(k), doc))
    return [least.get(find(k)) for k in range(len(prints))]


def against_plain(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_print(r.text) for r in rows]
    want = Counter(zip([r.doc_id for r in rows], [f"{p:016x}" for p in prints], plain_components(prints, [r.doc_id for r in rows])))
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.classes(docs).collect())
    assert got == want


def test_simhash_of_tables_and_edges(tables, edges, nothing):
    against_plain(tables["documents"])
    against_plain(edges)
    assert simhash.classes(edges).columns == ["doc_id", "fingerprint", "component_id", "component_size"]
    assert simhash.classes(nothing).count() == 0


def test_simhash_words_cross_the_stretches_of_a_long_text(monkeypatch):
    text = prose(7, 3000) + "\t\n x" + "y" * 500
    want = sorted(simhash.shingle_hashes(text))
    monkeypatch.setattr(simhash, "LONG", 300)
    assert sorted(simhash.shingle_hashes(text)) == want
    assert f"{simhash.majority(simhash.shingle_hashes(text), np.array([len(want)]))[0]:016x}" == f"{plain_print(text):016x}"


def test_simhash_majority_in_groups():
    draw = np.random.default_rng(1)
    counts = np.array([0, 1, 254, 255, 256, 0, 1000, 3, 0])
    hashes = draw.integers(0, 1 << 64, counts.sum(), dtype=np.uint64)
    first = np.r_[0, np.cumsum(counts)]
    for k, got in enumerate(simhash.majority(hashes, counts)):
        own = [int(h) for h in hashes[first[k]:first[k + 1]]]
        assert int(got) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))


def test_simhash_close_prints_share_a_key():
    draw = random.Random(9)
    for _ in range(300):
        x = draw.getrandbits(64)
        y = x
        for bit in draw.sample(range(64), draw.randrange(3)):
            y ^= 1 << bit
        table = simhash.distance_table(np.array([x, y], np.uint64))
        one, two = simhash.keys(table)
        assert (one == two).any() and np.abs(table[0].astype(int) - table[1]).max() <= 2


def neighbourhood(seed, n, center):
    draw, out = random.Random(seed), {center}
    while len(out) < n:
        x = draw.choice(sorted(out)) if draw.random() < 0.1 else center
        for bit in draw.sample(range(64), draw.randrange(1, 5)):
            x ^= 1 << bit
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("heavy", [4096, 10])
def test_simhash_links_of_a_crowd(spark, monkeypatch, heavy):
    """Many fingerprints around few centres: keys above CROWD, dealt or taken out before, give the same components."""
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    monkeypatch.setattr(simhash, "CROWD", 40)
    draw = random.Random(5)
    prints = sorted({x for k in range(4) for x in neighbourhood(k, 500, draw.getrandbits(64))} | {draw.getrandbits(64) for _ in range(400)})
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp bigint").repartition(5)
    found = simhash.links(nodes).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in found)
    want = plain_components(prints, list(range(len(prints))))
    place = {x: k for k, x in enumerate(signed)}
    top = list(range(len(prints)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for r in found:
        a, b = find(place[r.a]), find(place[r.b])
        top[max(a, b)] = min(a, b)
    assert [find(k) for k in range(len(prints))] == want


# Alignment


@pytest.fixture(scope="module")
def coders():
    tokenizers, sentencepiece = pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    a = tokenizers.Tokenizer.from_file(alignment.BYTE_VOCABULARY)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_VOCABULARY)


def plain_tokens(coders, text):
    """(id, start, end) of both by whole texts, with the libraries' own encoders."""
    a, b = coders
    if not text:
        return [], []
    symbols = {chr(c): c for c in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    symbols |= {chr(256 + k): c for k, c in enumerate(c for c in range(256) if chr(c) not in symbols)}
    sides = []
    for ids, to_bytes in ((a.encode(f" {text}", add_special_tokens=False).ids, lambda k: bytes(symbols[c] for c in a.id_to_token(k))),
                          (b.encode(text), lambda k: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p := b.id_to_piece(k)) else p.replace("▁", " ").encode())):
        at, tokens, whole = 0, [], b""
        for k in ids:
            tokens.append((k, at, at + len(to_bytes(k))))
            at = tokens[-1][2]
            whole += to_bytes(k)
        sides.append((tokens, whole))
    return tuple(t for t, _ in sides) if all(w == f" {text}".encode() for _, w in sides) else ([], [])


def plain_alignment(coders, rows):
    links, held = [], defaultdict(set)
    for k, (_, text) in enumerate(rows):
        a, b = plain_tokens(coders, text)
        own, j = [], 0
        for x, start, end in a:
            while j and b[j - 1][2] > start:
                j -= 1
            while j < len(b) and b[j][2] <= start:
                j += 1
            while j < len(b) and b[j][1] < end:
                own.append((x, b[j][0]))
                j += 1
        for pair in own:
            held[pair].add(k)
        links.append((a, b, own))
    best = defaultdict(int)
    for (x, _), found in held.items():
        best[x] = max(best[x], len(found))
    out = []
    for (doc, _), (a, b, own) in zip(rows, links):
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, start = [], 0
        for end in ends:
            groups.append(",".join(str(x) for x, s, e in a if start <= s and e <= end) + "|" + ",".join(str(x) for x, s, e in b if start <= s and e <= end))
            start = end
        counts = [len(held[p]) for p in own]
        out.append((doc, len(a), len(b), len(groups), len(own), sum(c == best[x] for c, (x, _) in zip(counts, own)), sum(counts),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    return Counter(out)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["plain words here", " leading and trailing ", "two  blanks   three", "tab\there\nlines\r\n", "▁literal ▁ sign▁ x", "<s> </s> <unk> <|endoftext|> <0x0A>",
       "日本語 の テキスト", "é 　 nbsp x ﬁ", "it's we'll 'x 12345 1a2b", "\x00 \x7f", "𝒳𝒴 🙂🙂", "   ", "\n", "x" * 400, "a," * 200, "word " * 300]


@pytest.mark.parametrize(("piece", "frequent"), [(1 << 14, 1 << 19), (40, 30), (7, 0)])
def test_alignment_is_that_of_whole_texts(spark, coders, piece, frequent):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100 + k, prose(k, 30 + 40 * k)) for k in range(8)] + [(None, "no id"), (200, None), (201, "")] + [(202, "twice the same")] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = alignment.align(docs, piece=piece, frequent=frequent)
    assert sorted(got.columns) == sorted(COLUMNS)
    assert Counter(tuple(r) for r in got.select(COLUMNS).collect()) == plain_alignment(coders, rows)


def test_alignment_of_tables_and_edges(tables, edges, nothing, coders):
    docs = tables["documents"].filter("doc_id < 40")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in alignment.align(docs).select(COLUMNS).collect()) == plain_alignment(coders, rows)
    found = alignment.align(edges).collect()
    assert len(found) == edges.count()
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups for r in found)
    assert {(r.n_a, r.n_b, r.groups_sha256) for r in found if r.doc_id in (1, 2)} == {(0, 0, "")}
    assert alignment.align(nothing).count() == 0


def test_alignment_split_points_keep_equal_ends_together():
    draw = random.Random(2)
    for _ in range(300):
        top = draw.randrange(2, 60)
        a, b = (np.array(sorted(draw.sample(range(1, top), draw.randrange(0, top - 1))) + [top]) for _ in "ab")
        i, j = alignment.split_points(a, b, np.arange(len(a) + len(b) + 1))
        for d, (x, y) in enumerate(zip(i, j)):
            assert d <= x + y <= d + 1
            before = max([*a[:x], *b[:y]], default=0)
            assert all(e > before for e in [*a[x:], *b[y:]])


# Ranked search


def plain_ranks(docs, items, top=20):
    terms = [(doc, Counter(TERM.findall((text or "").translate(LOWER)))) for doc, text in docs]
    terms = [(doc, tf, sum(tf.values())) for doc, tf in terms if tf]
    n_docs, n_terms = len(terms), sum(n for _, _, n in terms)
    df = Counter(t for _, tf, _ in terms for t in tf)
    out = []
    for item, text in items:
        wanted = TERM.findall((text or "").translate(LOWER))
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in wanted}
        scores = []
        for doc, tf, n in terms:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(weights[t] * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in wanted if t in tf)
            if score:
                scores.append((-score, doc is None, doc))
        out += [(item, k + 1, doc, -s) for k, (s, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return Counter(out)


ITEMS = [(1, "the river runs past old stone houses"), (2, None), (3, "..."), (4, "Zwölf ÄPFEL und Öl"), (1, "the river runs past old stone houses"), (None, "one text that a dozen rows share"),
         (5, "nowhere tobefound"), (6, "the the the river river x"), (7, "日本語のテキスト")]


def ranked(docs, items, **options):
    return Counter(tuple(r) for r in ranked_search.rank(docs, items, **options).select("item_id", "rank", "doc_id", "score").collect())


def test_ranks_of_edges(spark, edges, nothing):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    rows = [tuple(r) for r in edges.select("doc_id", "text").collect()]
    want = plain_ranks(rows, ITEMS)
    assert ranked(edges, items) == want
    assert ranked(edges, items, item_bytes=40) == want, "items in several blocks"
    assert ranked(edges, items, top=3) == plain_ranks(rows, ITEMS, 3)
    assert ranked_search.rank(nothing, items).count() == 0
    assert ranked_search.rank(edges, items.filter("item_id = 99")).count() == 0
    assert ranked_search.rank(edges, items.filter("item_id in (2, 3)")).columns == ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("rows", [2048, 8])
def test_ranks_are_whole_with_buckets_of_any_size(spark, tables, monkeypatch, rows):
    monkeypatch.setattr(ranked_search, "BUCKET_ROWS", rows)
    docs = tables["documents"].repartition(4)
    want = plain_ranks([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in tables["benchmark"].select("item_id", "text").collect()], 5)
    assert ranked(docs, tables["benchmark"], top=5) == want


def test_bucket_search_prunes_and_keeps_the_best():
    """In one task: the lists of long walks equal those of full scoring, though most buckets are left early."""
    draw = np.random.default_rng(6)
    terms, rows = 300, 3000
    places = [np.sort(draw.choice(terms, draw.integers(1, 20), replace=False)).astype(np.uint32) for _ in range(rows)]
    tf = [draw.integers(1, 4, len(p)).astype(np.uint32) for p in places]
    n = np.array([int(t.sum()) for t in tf])
    weights = np.sort(draw.integers(1, 9000, terms))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(rows)), pa.array(n), pa.array([p.tobytes() for p in places]), pa.array([t.tobytes() for t in tf])],
                                       names=["doc_id", "n", "places", "tf"])
    normed = next(iter(ranked_search._norms(rows, int(n.sum()))([batch])))
    normed = normed.take(pa.array(np.argsort(-normed.column("norm").to_numpy(), kind="stable")))
    full = np.zeros((rows, terms), np.int64)
    for r in range(rows):
        full[r, places[r]] = ranked_search.impacts(tf[r].astype(np.int64), n[r], rows, int(n.sum()))
    for _ in range(20):
        wanted, counts = np.unique(draw.integers(0, terms, 15), return_counts=True)
        item = ranked_search.Item(wanted, counts, weights)
        for bucket in ranked_search._buckets([normed], rows, int(n.sum())):
            bucket.search(item, 10)
        score = full[:, wanted] @ (counts * weights[wanted])
        best = np.lexsort((np.arange(rows), -score))[:10]
        assert item.doc.tolist() == best.tolist() and item.score.tolist() == score[best].tolist()
