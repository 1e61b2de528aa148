"""SimHash near-duplicates by pivot distance tables.

Every fingerprint gets a row of Hamming distances to ``PIVOTS`` reference
fingerprints. By the triangle inequality two fingerprints within ``RADIUS`` bits
differ by at most that much in every coordinate, so a pair with a larger
difference anywhere is discarded; the rest is verified bit by bit.

Which pairs are looked at follows from the table too. The first references are
zero and ``MASKS`` masks of two neighbouring bits. Distance to a mask less distance to
zero tells how many of the two bits are set, and a change of ``RADIUS`` bits touches at
most ``RADIUS`` masks. So of ``PARTS`` parts of the masks, all coordinates of at least
``PARTS - RADIUS`` agree: one key for each choice of parts, 27 bits or more of it, and
only fingerprints with the same key meet. The other references are drawn at random.

Equal fingerprints are one node from the start. A key that more than ``CROWD``
different fingerprints share is not compared pair by pair: its fingerprints are
joined through references next to them. Two fingerprints are within two bits
exactly if some reference is within one bit of both, so each is sent to the 65
references within one bit of it, and whoever meets at one is linked; no more
than 65 can meet there. Both ways give every link or an equally connected part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .arrow import add_columns
from .components import components
from .cuts import BLANK, stretches
from .joins import HEAVY, heavy_keys, spread_join

SHINGLE = 3
SEED = 42
RADIUS = 2
MASKS = 32
PIVOTS = 64
PARTS = 5
CROWD = 256
LONG = 1 << 20
_U = np.uint64


def references() -> np.ndarray:
    """Zero, the masks of two bits, and references drawn at random."""
    masks = _U(3) << (np.arange(MASKS, dtype=_U) * _U(2))
    drawn = np.random.default_rng(3).integers(0, 1 << 64, PIVOTS - MASKS - 1, dtype=_U)
    return np.r_[np.zeros(1, _U), masks, drawn]


def distance_table(prints: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to all references."""
    return np.bitwise_count(prints[:, None] ^ references()[None, :]).astype(np.int8)


def keys(table: np.ndarray) -> np.ndarray:
    """One key per choice of parts, made of the coordinates of their masks."""
    parts = np.array_split(np.arange(MASKS), PARTS)
    digits = ((2 - (table[:, 1:MASKS + 1] - table[:, :1])) // 2).astype(np.int64)
    out = []
    for number, chosen in enumerate(combinations(range(PARTS), PARTS - RADIUS)):
        masks = np.concatenate([parts[p] for p in chosen])
        out.append(digits[:, masks] @ (3 ** np.arange(len(masks), dtype=np.int64)) + (number << 40))
    return np.column_stack(out)


def _words(text: str) -> Iterator[list[bytes]]:
    """Lowered words, a long text's in several lists; each but the first begins with the last two words before it."""
    before: list[bytes] = []
    for part in stretches(text, LONG, BLANK):
        words = before + part.encode().lower().split()
        yield words
        before = words[1 - SHINGLE:]


def shingle_hashes(text: str) -> np.ndarray:
    """XXH64 of every run of three words; of all words, if they are fewer."""
    found, last = [], []
    for last in _words(text):
        whole, start = b" ".join(last), 0
        starts = [0]
        for word in last:
            start += len(word) + 1
            starts.append(start)
        stops = starts[SHINGLE:]
        digest = xxhash.xxh64_intdigest
        found.append(np.fromiter((digest(whole[a:b - 1], SEED) for a, b in zip(starts, stops)), _U, len(stops)))
    hashes = np.concatenate(found)
    if not len(hashes) and last:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(last), SEED)], _U)
    return hashes


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For runs of ``counts`` hashes each, the bits set in over half of a run.

    Eight bits are counted at once, one per byte, in groups of at most 255.
    """
    first = np.r_[0, np.cumsum(counts)]
    groups = -(-counts // 255)
    owner = np.repeat(np.arange(len(counts)), groups)
    start = first[owner] + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(groups) - groups, groups))
    out = np.zeros(len(counts), _U)
    if not len(start):
        return out
    some = np.flatnonzero(counts)
    begin = np.searchsorted(owner, some)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> _U(bit)) & _U(0x0101010101010101), start)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), begin, axis=0)
        for byte in range(8):
            most = 2 * ones[:, byte] > counts[some]
            out[some] |= most.astype(_U) << _U(8 * byte + bit)
    return out


def _prints():
    def compute(part):
        hashes = [shingle_hashes(text or "") for text in part.column("text").to_pylist()]
        counts = np.array([len(h) for h in hashes], np.int64)
        return [pa.array(majority(np.concatenate([np.zeros(0, _U), *hashes]), counts).view(np.int64))]

    return compute


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""
    return add_columns(docs.select("doc_id", "text"), _prints, "fp bigint").drop("text")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            prints = batch.column("fp").to_numpy()
            own = keys(distance_table(prints.view(_U)))
            yield pa.record_batch([pa.array(own.ravel()), pa.array(np.repeat(prints, own.shape[1]))], names=["key", "fp"])


def _close(prints: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with the same key (sorted, no run above ``CROWD``) and fingerprints within ``RADIUS`` bits."""
    table = distance_table(prints)
    a, b = [], []
    at = np.arange(len(key))
    for step in range(1, CROWD):
        at = at[at < len(key) - step]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        near = at[np.abs(table[at] - table[at + step]).max(axis=1) <= RADIUS]
        near = near[np.bitwise_count(prints[near] ^ prints[near + step]) <= RADIUS]
        a.append(near)
        b.append(near + step)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links a, b of keys that few fingerprints share; of the others, all fingerprints with b null. Rows come sorted by key."""
    held_key, held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    crowded = None

    def out(key, prints):
        nonlocal crowded
        edge = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)] if len(key) else np.zeros(1, int)
        length = np.diff(edge)
        many = np.repeat(length > CROWD, length) | (key == crowded if crowded is not None else np.zeros(len(key), bool))
        if len(key):
            crowded = key[-1] if many[-1] else None
        few, i, j = prints[~many], *_close(prints[~many].view(_U), key[~many])
        a, b = np.r_[few[i], prints[many]], np.r_[few[j], np.zeros(many.sum(), np.int64)]
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64(), mask=np.arange(len(a)) >= len(i))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, prints = np.r_[held_key, batch.column("key").to_numpy()], np.r_[held, batch.column("fp").to_numpy()]
        # the last key may go on in the next batch; of a crowded one, enough is known already
        last = int(np.searchsorted(key, key[-1]))
        last = len(key) if len(key) - last > CROWD or key[-1] == crowded else last
        yield out(key[:last], prints[:last])
        held_key, held = key[last:], prints[last:]
    if len(held):
        yield out(held_key, held)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.r_[np.zeros(1, _U), _U(1) << np.arange(64, dtype=_U)]
    for batch in batches:
        prints = batch.column("fp").to_numpy()
        near = (prints.view(_U)[:, None] ^ flips[None, :]).view(np.int64)
        yield pa.record_batch([pa.array(near.ravel()), pa.array(np.repeat(prints, 65))], names=["reference", "fp"])


def links(nodes: DataFrame) -> DataFrame:
    """Links a, b of different fingerprints within ``RADIUS`` bits: all of them, or as many as connect the same.

    ``nodes`` has each fingerprint once (fp). Keys that hold more than one row in
    ``HEAVY`` (and more than ``CROWD``) are taken out before the others are dealt to
    tasks; there can be ``HEAVY`` x 10 of them, which bounds their broadcast.
    """
    keyed = nodes.select("fp").mapInArrow(_keyed, "key bigint, fp bigint")
    limit = max(CROWD, nodes.count() // HEAVY)
    heavy = F.broadcast(materialize(keyed.groupBy("key").count().filter(F.col("count") > limit).select("key"), "heavy"))
    dealt = keyed.join(heavy, "key", "left_anti").repartition("key").sortWithinPartitions("key", "fp")
    met = materialize(dealt.mapInArrow(_meet, "a bigint, b bigint"), "met")
    crowd = met.filter("b is null").select(F.col("a").alias("fp")).union(keyed.join(heavy, "key", "left_semi").select("fp")).distinct()
    around = crowd.mapInArrow(_neighbours, "reference bigint, fp bigint").groupBy("reference").agg(F.collect_list("fp").alias("all"))
    joined = around.filter(F.size("all") > 1).select(F.array_min("all").alias("a"), F.explode("all").alias("b"))
    return met.filter("b is not null").union(joined.filter("a != b")).distinct()


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, component_size.

    Words are runs without ASCII white space of the whole text, A-Z lowered; a
    bit is set if it is in over half the XXH64 values of the three-word runs,
    repeats included (of all words, if fewer than three). Null and empty texts, and those without words, have
    fingerprint zero. Documents within two bits are linked; component_id is the smallest
    doc_id that links reach, null only if all ids there are null. Repeated rows
    are documents of their own. An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "nodes")
    labels = components(links(nodes))
    labelled = nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "first", "n", F.coalesce("label", "fp").alias("part"))
    labelled = materialize(labelled, "labelled")
    parts = labelled.groupBy("part").agg(F.min("first").alias("component_id"), F.sum("n").alias("component_size"))
    known = materialize(spread_join(labelled, parts, "part", heavy_keys(labelled, "part")), "known")
    out = spread_join(prints, known.select("fp", "component_id", "component_size"), "fp", heavy_keys(prints, "fp"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component_size")
