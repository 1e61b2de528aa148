"""Near-duplicates by weighted MinHash over TF-IDF shingles.

Improved consistent weighted sampling draws, for each document, shingles such
that two documents agree on a draw with the probability of their weighted
Jaccard similarity. Draws are banded; documents that share a band are compared
on all draws, and what looks close is verified by the exact weighted Jaccard
similarity of the two shingle sets. Classes are the components of the links.

Document frequencies come from a count-mean-min sketch of fixed size over all
documents: the mean of the cells, which is what other shingles add, is taken off.
At n shingles that leaves an error of about the root of n / 2^18 documents, whatever a
shingle's own frequency. The inverse document frequency is scaled to 1 ... 1 + ``IDF``: a
wider scale would make large groups of near copies dissimilar just because
they are many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .arrow import add_columns, unused
from .components import components
from .joins import heavy_keys, spread_join
from .sums import vector_sum
from .words import mix, shingles, slices, word_hashes

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 12, 4
DRAWS = BANDS * ROWS
IDF = 0.2
SKETCH_ROWS, SKETCH_BITS = 2, 18
TABLE = 1 << 16
KEY_BITS = 52
BLOCK = 4096
_U = np.uint64


def _odd(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(seed, seed + n, dtype=_U)) | _U(1)


def weighted_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text (``KEY_BITS`` bits, in order), counts, first of each text; word hashes and first words."""
    hashes, first_word = word_hashes(texts)
    run, text = shingles(hashes, first_word, SHINGLE)
    keys = run >> _U(64 - KEY_BITS)
    low = 0
    parts = []
    while low < len(texts):  # the text's number takes the bits above the key
        high = min(len(texts), low + (1 << (64 - KEY_BITS)))
        inside = slice(*np.searchsorted(text, [low, high]))
        both, counts = np.unique(((text[inside] - low).astype(_U) << _U(KEY_BITS)) | keys[inside], return_counts=True)
        parts.append((both & _U((1 << KEY_BITS) - 1), counts, (both >> _U(KEY_BITS)).astype(np.int64) + low))
        low = high
    key, counts, owner = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, _U), np.zeros(0, int), np.zeros(0, int))
    return key, counts, np.searchsorted(owner, np.arange(len(texts) + 1)), hashes, first_word


def _cells(keys: np.ndarray) -> list[np.ndarray]:
    return [((keys * m) >> _U(64 - SKETCH_BITS)).astype(np.int64) + (k << SKETCH_BITS) for k, m in enumerate(_odd(11, SKETCH_ROWS))]


def _count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    total = np.zeros((SKETCH_ROWS << SKETCH_BITS) + 1)
    for batch in batches:
        for part in slices(batch, "text"):
            keys = weighted_keys(part.column("text"))[0]
            for cells in _cells(keys):
                total[:-1] += np.bincount(cells, minlength=len(total) - 1)
            total[-1] += part.num_rows
    return total


class Weights:
    """TF-IDF weights of shingles, 1 or more."""

    def __init__(self, counts: np.ndarray):
        documents = max(counts[-1], 2.0)
        cells = counts[:-1].reshape(SKETCH_ROWS, -1)
        # what other shingles have put into a cell is, on average, the mean of all cells
        own = np.maximum(cells - (cells.sum(axis=1, keepdims=True) - cells) / (cells.shape[1] - 1), 1).ravel()
        self.idf = (1 + IDF * np.clip(np.log(documents / own) / np.log(documents), 0, 1)).astype(np.float32)

    def __call__(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        idf = np.maximum.reduce([self.idf[c] for c in _cells(keys)]) if len(keys) else np.zeros(0, np.float32)
        return ((1 + np.log(counts)) * idf).astype(np.float32)


class Sampler:
    """Consistent draws; the random numbers of a shingle come from a fixed table."""

    def __init__(self, seed: int = 5):
        draw = np.random.default_rng(seed)
        r, c, beta = draw.gamma(2, 1, TABLE), draw.gamma(2, 1, TABLE), draw.uniform(size=TABLE)
        self.table = np.column_stack([1 / r, beta, r, np.log(c) + r * (beta - 1)]).astype(np.float32)
        self.turn = (_odd(101, DRAWS) & _U(0xFFFFFFFF)).astype(np.uint32)

    def __call__(self, short: np.ndarray, weights: np.ndarray, first: np.ndarray) -> np.ndarray:
        """``DRAWS`` 16-bit draws of each text that has shingles (of all texts, 0 for the others)."""
        out = np.zeros((len(first) - 1, DRAWS), np.uint16)
        some = np.flatnonzero(np.diff(first))
        if not len(some):
            return out
        log, place, begin = np.log(weights), np.arange(len(short), dtype=np.int64), first[:-1][some]
        for k in range(DRAWS):
            row = np.take(self.table, (short * self.turn[k]) >> np.uint32(16), axis=0)
            step = np.floor(log * row[:, 0] + row[:, 1])
            bits = (row[:, 3] - row[:, 2] * step).view(np.int32)
            ordered = (bits ^ ((bits >> 31) & 0x7FFFFFFF)).astype(np.int64)
            at = np.minimum.reduceat((ordered << 32) | place, begin) & 0xFFFFFFFF
            drawn = short[at].astype(_U) * _U(0x9E3779B97F4A7C15) + step[at].astype(np.int64).view(_U) * _U(0xC2B2AE3D27D4EB4F) + _U(k)
            out[some, k] = (mix(drawn) >> _U(48)).astype(np.uint16)
        return out


def _identity(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each text's word sequence."""
    counts = np.diff(first)
    place = (np.arange(len(hashes)) - np.repeat(first[:-1], counts)).astype(_U)
    out = []
    for m in _odd(501, 2):
        total = np.zeros(len(counts), _U)
        some = np.flatnonzero(counts)
        if len(some):
            total[some] = np.add.reduceat(mix(hashes * m + mix(place * m)), first[:-1][some])
        out.append(pa.array(total.view(np.int64)))
    return out


def _sketch(counts):
    def make():
        weigh, sample = Weights(counts.value), Sampler()

        def compute(part):
            keys, tf, first, hashes, first_word = weighted_keys(part.column("text"))
            weights = weigh(keys, tf)
            short = (keys >> _U(KEY_BITS - 32)).astype(np.uint32)
            draws = sample(short, weights, first)
            packed = np.minimum(np.round(weights * 2048), 65535).astype(np.uint16)
            sets = [pack(short[a:b], packed[a:b]) for a, b in zip(first[:-1], first[1:])]
            return [*_identity(hashes, first_word), pa.array(np.diff(first_word)), pa.array([d.tobytes() for d in draws], pa.binary()),
                    pa.array(sets, pa.binary())]

        return compute

    return make


def _bands(draws: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of each row of draws."""
    packed = np.ascontiguousarray(draws).view(_U).reshape(len(draws), BANDS)
    return mix(packed + _odd(301, BANDS)).view(np.int64)


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        draws = np.frombuffer(b"".join(batch.column("draws").to_pylist()), np.uint16).reshape(-1, DRAWS)
        keys = _bands(draws)
        again = pa.array(np.repeat(np.arange(len(keys)), BANDS))
        # a byte of each draw is enough to compare by
        short = pa.array([row.tobytes() for row in draws.astype(np.uint8)], pa.binary())
        yield pa.record_batch([batch.column("node").take(again), pa.array(keys.ravel()), short.take(again)], names=["node", "band", "draws"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows of each (band, block), which arrive sorted."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        band, block = batch.column("band").to_numpy(), batch.column("block").to_numpy()
        edge = np.flatnonzero((band[1:] != band[:-1]) | (block[1:] != block[:-1])) + 1
        for a, b in zip(np.r_[0, edge], np.r_[edge, len(band)]):
            key = (band[a], block[a])
            if held and key != last:
                yield int(last[0]), pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield int(last[0]), pa.Table.from_batches(held)


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal draws of every row of ``a`` with every row of ``b``."""
    total = np.zeros((len(a), len(b)), np.uint8)
    for k in range(DRAWS):
        total += a[:, k, None] == b[None, :, k]
    return total


def _draws(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("draws").to_pylist()), np.uint8).reshape(-1, DRAWS)


def least_agreement(similar: float) -> int:
    """Draws that two texts at the limit share but for four standard deviations: of such pairs some 5 in 100,000 share fewer."""
    return int(np.floor(DRAWS * similar - 4 * np.sqrt(DRAWS * similar * (1 - similar))))


def strongest(draws: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """A spanning forest of strongest agreements of ``least`` or more, as pairs of rows; were other pairs left out?

    Rows join in turn, each by its best partner so far, so a block of n rows
    gives n - 1 pairs at most however alike its rows are.
    """
    n = len(draws)
    if n == 2:
        good = int((draws[0] == draws[1]).sum()) >= least
        return np.zeros(int(good), int), np.ones(int(good), int), False
    whole = _agreement(draws, draws) if n <= 64 else None
    best, partner, out = np.zeros(n, np.int16), np.zeros(n, int), np.ones(n, bool)
    a, b, close, at = [], [], 0, 0
    for _ in range(n):
        out[at] = False
        row = whole[at] if whole is not None else _agreement(draws[at:at + 1], draws)[0]
        close += int((row[out] >= least).sum())
        better = row > best
        best[better], partner[better] = row[better], at
        left = np.where(out, best, -1)
        following = int(left.argmax())
        if left[following] >= least:
            a.append(partner[following])
            b.append(following)
        at = following
    return np.array(a, int), np.array(b, int), close > len(a)


def _closest(least: int):
    """The pairs to verify of each block, and the bands in which others are left."""

    def work(batches):
        for bands in _batched(_groups(batches)):
            a, b, more = [], [], []
            for band, table in bands:
                if table.num_rows < 2:
                    continue
                node = table.column("node").to_numpy()
                i, j, left = strongest(_draws(table), least)
                a.append(np.minimum(node[i], node[j]))
                b.append(np.maximum(node[i], node[j]))
                if left:
                    more.append(band)
            a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
            differ = a != b
            for part in ([pa.array(a[differ]), pa.array(b[differ]), pa.nulls(int(differ.sum()), pa.int64())],
                         [pa.nulls(len(more), pa.int64()), pa.nulls(len(more), pa.int64()), pa.array(more, pa.int64())]):
                yield pa.RecordBatch.from_arrays(part, names=["a", "b", "open"])

    return work


def _batched(groups: Iterator, size: int = 2000) -> Iterator[list]:
    held: list = []
    for group in groups:
        held.append(group)
        if len(held) >= size or group[1].num_rows > 256:
            yield held
            held = []
    yield held


_CODEC = pa.Codec("zstd", compression_level=1)


def pack(short: np.ndarray, weights: np.ndarray) -> bytes:
    """A shingle set: sorted 32-bit keys as differences and 16-bit weights, byte by byte of their place, compressed."""
    gaps = np.diff(short, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T
    parts = weights.astype("<u2").view(np.uint8).reshape(-1, 2).T
    planes = np.concatenate([np.ascontiguousarray(gaps).ravel(), np.ascontiguousarray(parts).ravel()])
    return len(short).to_bytes(4, "little") + _CODEC.compress(planes.tobytes(), asbytes=True)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(_CODEC.decompress(data[4:], 6 * n, asbytes=True), np.uint8)
    gaps = np.ascontiguousarray(planes[:4 * n].reshape(4, n).T).view("<u4").ravel()
    weights = np.ascontiguousarray(planes[4 * n:].reshape(2, n).T).view("<u2").ravel()
    return np.cumsum(gaps, dtype=np.uint32), weights.astype(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    (ka, wa), (kb, wb) = a, b
    if len(ka) > len(kb):
        (ka, wa), (kb, wb) = b, a
    if not len(ka):
        return 0.0
    at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    same = kb[at] == ka
    shared = int(np.minimum(wa[same], wb[at[same]]).sum())
    return shared / (int(wa.sum()) + int(wb.sum()) - shared)


def _verify(similar: float):
    def work(batches):
        for batch in batches:
            good = [weighted_jaccard(unpack(x.as_py()), unpack(y.as_py())) >= similar for x, y in zip(batch.column("set_a"), batch.column("set_b"))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return work


def _join_up(similar: float, least: int):
    """Links between different components inside each block; of a block with two sides, between these."""

    def work(batches):
        for _, table in _groups(batches):
            node, part, draws = table.column("node").to_numpy(), table.column("part").to_numpy().copy(), _draws(table)
            if len(np.unique(part)) < 2:
                continue
            side = table.column("side").to_numpy()
            facing = side[:, None] != np.unique(side) if side.min() != side.max() else np.ones((len(side), 2), bool)
            sets = [unpack(s) for s in table.column("set").to_pylist()]
            a, b = [], []
            for i in range(1, len(node)):
                while len(others := np.flatnonzero((part[:i] != part[i]) & facing[:i, side[i]])):
                    agree = _agreement(draws[i:i + 1], draws[others])[0]
                    near = others[agree >= least][np.argsort(-agree[agree >= least].astype(int), kind="stable")]
                    match = next((j for j in near if weighted_jaccard(sets[i], sets[j]) >= similar), None)
                    if match is None:
                        break
                    a.append(node[i])
                    b.append(node[match])
                    part[part == part[match]] = part[i]
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return work


def _large(bands: DataFrame) -> DataFrame:
    """Bands of more than ``BLOCK`` rows, with their number of blocks and one member."""
    large = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("node", F.lit(1)), "node")).alias("m"))
    return materialize(large.filter(F.col("n") > BLOCK).select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"),
                                                                F.col("m.node").alias("leader")), "large")


def _blocks(rows: DataFrame, large: DataFrame, max_broadcast: int) -> DataFrame:
    """Large bands in blocks; one member of such a band is put into all its blocks."""
    hot = large.count()
    if not hot:
        return rows.withColumn("block", F.lit(0))
    marked = rows.join(F.broadcast(large) if hot <= max_broadcast else large, "band", "left")
    own = F.pmod(F.xxhash64("node", "band", F.lit(1)), F.coalesce("blocks", F.lit(1))).cast("int")
    every = F.when(F.col("node") == F.col("leader"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    return marked.withColumn("block", F.explode(every)).drop("blocks", "leader")


def _block_pairs(rows: DataFrame, max_broadcast: int) -> DataFrame:
    """Adds block and side: any two rows of a band that differ in ``part`` meet in a block, on different sides if it has two.

    A band of more than ``BLOCK`` rows is cut into pieces of about half as many.
    Large parts have pieces of their own, which need not meet each other; small
    parts share pieces. Each two pieces with different parts are one block.
    """
    piece = max(BLOCK // 2, 1)
    parts = rows.groupBy("band", "part").agg(F.count(F.lit(1)).alias("n"))
    own = F.col("n") > max(piece // 4, 1)
    pieces = lambda n: F.ceil(n / piece).cast("int")
    mixed = F.coalesce(F.sum(F.when(~own, F.col("n"))), F.lit(0))
    numbered = lambda part, count: F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda k: F.struct(part.alias("part"), k.alias("k"))))
    hot = parts.groupBy("band").agg(
        F.sum("n").alias("rows"), pieces(mixed).alias("mixed"),
        F.collect_list(F.when(own, F.struct("part", pieces(F.col("n")).alias("count")))).alias("own")).filter(F.col("rows") > BLOCK)
    alone = F.flatten(F.transform("own", lambda p: numbered(p["part"], p["count"])))
    hot = materialize(hot.select("band", "mixed", "own", F.concat(
        F.coalesce(numbered(F.lit(-1).cast("bigint"), F.col("mixed")), F.array().cast("array<struct<part: bigint, k: int>>")), alone).alias("pieces")), "hot")
    many = hot.count()
    if not many:
        return rows.withColumns({"block": F.lit(0).cast("bigint"), "side": F.lit(0)})
    small = lambda df: F.broadcast(df) if many <= max_broadcast else df
    large = hot.select("band", F.explode("own").alias("p")).select("band", "p.*")
    marked = rows.join(small(hot.drop("own")), "band", "left").join(small(large), ["band", "part"], "left")
    drawn = lambda key, count: F.pmod(F.xxhash64(key, "band", F.lit(2)), count).cast("int") + 1
    at = F.when(F.col("count").isNull(), F.struct(F.lit(-1).cast("bigint").alias("part"), drawn("part", F.col("mixed")).alias("k"))).otherwise(
        F.struct(F.col("part"), drawn("node", F.col("count")).alias("k")))
    marked = marked.withColumn("at", F.array_position("pieces", at) - 1)
    met = F.transform("pieces", lambda p, j: F.when(F.col("count").isNull() | (p["part"] != F.col("part")), j.cast("bigint")))
    spread = marked.withColumn("other", F.explode(F.coalesce(F.array_compact(met), F.array(F.lit(0).cast("bigint")))))
    at, other = F.coalesce("at", F.lit(0)), F.col("other")
    block = F.least(at, other) * F.coalesce(F.size("pieces"), F.lit(1)) + F.greatest(at, other)
    return spread.withColumns({"block": block, "side": (at > other).cast("int")}).drop("mixed", "pieces", "count", "at", "other")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("band", "block").sortWithinPartitions("band", "block", "node")


def classes(docs: DataFrame, similar: float = SIMILAR, max_broadcast: int = 2_000_000) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept, text_key.

    Two texts are linked if the weighted Jaccard similarity of their five-word
    shingles is ``similar`` or more, and a class is what links join; class_id is
    its smallest doc_id, and the row with it is the one kept (one row where ids
    repeat; null ids come last). Texts of the same words are always one class. Texts
    of fewer than five words, but not none, have one shingle of all words. Texts
    without words, null ones as empty, are one class only if identical.
    ``text_key`` is the hash of the text. Broadcasts are used up to a counted
    ``max_broadcast`` short rows, joins by shuffle beyond.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vector_sum(rows.select("text"), _count, (SKETCH_ROWS << SKETCH_BITS) + 1))
    fields = "k1 bigint, k2 bigint, words bigint, draws binary, set binary"
    sketched = add_columns(rows, _sketch(shared), fields)
    none = F.col("words") == 0
    text_key = F.xxhash64("text")
    sketched = materialize(sketched.select(
        "doc_id", text_key.alias("text_key"), F.when(none, text_key).otherwise(F.col("k1")).alias("k1"), F.when(none, -1).otherwise(F.col("k2")).alias("k2"),
        "words", "draws", "set", F.monotonically_increasing_id().alias("row")), "sketches")
    groups = sketched.groupBy("k1", "k2").agg(F.min("row").alias("node"))
    members = materialize(sketched.select("doc_id", "text_key", "row", "k1", "k2").join(groups, ["k1", "k2"]).drop("k1", "k2"), "members")
    # one row stands for all texts of the same words: the one whose number is its node
    first = members.filter("row = node").select("node")
    nodes = sketched.filter("words > 0").join(first, sketched["row"] == first["node"], "left_semi").withColumnRenamed("row", "node")
    bands = materialize(nodes.select("node", "draws").mapInArrow(_band_rows, "node bigint, band bigint, draws binary"), "bands")
    least = least_agreement(similar)
    large = _large(bands)
    found = materialize(_dealt(_blocks(bands, large, max_broadcast)).mapInArrow(_closest(least), "a bigint, b bigint, open bigint"), "pairs")
    pairs = found.filter("a is not null").select("a", "b").distinct()
    sets = _sets(sketched, pairs.select("a").union(pairs.select("b")).distinct(), max_broadcast)
    whole = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    links = materialize(whole.mapInArrow(_verify(similar), "a bigint, b bigint"), "verified")
    labels = components(links)
    # pairs across the blocks of a large band have not met yet
    open_bands = found.filter("open is not null").select(F.col("open").alias("band")).union(large.select("band")).distinct()
    if not open_bands.isEmpty():
        rest = _open_rows(bands, open_bands, labels, sketched, max_broadcast)
        more = materialize(_dealt(_block_pairs(rest, max_broadcast)).mapInArrow(_join_up(similar, least), "a bigint, b bigint"), "verified")
        labels = components(links.union(more)) if not more.isEmpty() else labels
    return _labelled(members, labels)


def _sets(sketched: DataFrame, wanted: DataFrame, max_broadcast: int) -> DataFrame:
    wanted = materialize(wanted.toDF("node"), "wanted")
    if wanted.count() <= max_broadcast:
        wanted = F.broadcast(wanted)
    return materialize(sketched.select(F.col("row").alias("node"), "set").join(wanted, "node", "left_semi"), "sets")


def _open_rows(bands: DataFrame, open_bands: DataFrame, labels: DataFrame, sketched: DataFrame, max_broadcast: int) -> DataFrame:
    """Rows of the bands where pairs were left out and that still join different components."""
    rows = bands.join(open_bands, "band", "left_semi").join(labels, "node", "left").select(
        "node", "band", "draws", F.coalesce("label", "node").alias("part"))
    rows = materialize(rows, "open")
    mixed = rows.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low != high").select("band")
    rows = rows.join(mixed, "band", "left_semi")
    sets = _sets(sketched, rows.select("node").distinct(), max_broadcast)
    return rows.join(sets, "node")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    classed = materialize(members.join(labels, "node", "left").withColumn("part", F.coalesce("label", "node")).drop("label"), "classed")
    head = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row")
    heads = classed.groupBy("part").agg(F.min(head).alias("head"), F.count(F.lit(1)).alias("class_size"))
    return spread_join(classed, materialize(heads, "heads"), "part", heavy_keys(classed, "part")).select(
        "doc_id", F.col("head.id").alias("class_id"), "class_size", (F.col("row") == F.col("head.row")).alias("kept"), "text_key")


def keep_one(docs: DataFrame, similar: float = SIMILAR, max_broadcast: int = 2_000_000) -> DataFrame:
    """The documents less all but one of each class, all columns as they were.

    Rows equal in id and text stay or go together; remove exact copies first. Null texts are
    empty ones, null ids come last in a class, an empty table stays empty.
    """
    found = materialize(classes(docs, similar, max_broadcast), "classes")
    own_id, own_text = unused(docs, "_i"), unused(docs, "_t")
    key = ["doc_id", "text_key"]
    stay = found.filter("kept").select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_text))
    gone = found.filter("not kept").select(*key)
    gone = gone.join(stay, gone["doc_id"].eqNullSafe(stay[own_id]) & (gone["text_key"] == stay[own_text]), "left_anti")
    gone = materialize(gone.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_text)).distinct(), "gone")
    side = F.broadcast(gone) if gone.count() <= max_broadcast else gone
    return docs.join(side, docs["doc_id"].eqNullSafe(side[own_id]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == side[own_text]), "left_anti")
