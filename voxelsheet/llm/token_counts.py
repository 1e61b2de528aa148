"""Token counts of the documents in flat token files that have no index.

A file is a row of token ids in which an end-of-document id closes each
document. Blocks of files are searched for that id with vector operations;
a prefix scan over the blocks then tells each block how many documents ended
before it and where the last one did, so documents that cross blocks get whole
counts. Blocks may be cut anywhere between tokens.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.ordering import running
from ..session import mounted_path, scratch_path
from .cuts import stretches
from .words import slices

# Fixed value: the split pattern that goes with the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK_TOKENS = 1 << 15
_encoders: dict[int, object] = {}


def _encoder(vocabulary: bytes):
    import tiktoken

    key = hash(vocabulary)
    if key not in _encoders:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


#: Behind a letter or a number that none follows, a token ends whatever comes next.
TOKEN_END = regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})")
LONG = 50_000


def end_id(vocabulary: bytes) -> int:
    """The id after the last rank of the vocabulary; no token has it."""
    return max(int(line.split()[1]) for line in vocabulary.splitlines() if line) + 1


def encode(vocabulary: bytes, text: str) -> np.ndarray:
    """Ids of a whole text; a long one is encoded in stretches cut where a token ends in any case."""
    coder = _encoder(vocabulary)
    parts = [np.asarray(coder.encode_ordinary(p), np.uint32) for p in stretches(text, LONG, TOKEN_END)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _read(vocabulary: str) -> bytes:
    with open(vocabulary, "rb") as f:  # some 1 MB
        return f.read()


def id_width(end: int) -> int:
    """Bytes of an id in the token files."""
    return 2 if end < 1 << 16 else 4


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Token files of ``docs`` as blocks, one file per task, written to the shared folder.

    Rows with ``data`` are blocks: file, block, data (ids of ``id_width`` bytes). The others say
    which documents a file holds, in order: file, first (place of the first), ids.
    A document with a null or empty text is its end id alone.
    """
    content = _read(vocabulary)
    shared, end = docs.sparkSession.sparkContext.broadcast(content), end_id(content)
    number = f"<u{id_width(end)}"
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        file, block, place, held, size = TaskContext.get().partitionId(), 0, 0, [], 0
        arrow_id = None

        def row(data, at, first, ids):
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int32()), pa.array([at], pa.int64()), pa.array([data], pa.binary()), pa.array([first], pa.int64()),
                 pa.array([ids], pa.list_(arrow_id))], names=["file", "block", "data", "first", "ids"])

        for batch in batches:
            arrow_id = batch.schema.field("doc_id").type
            for part in slices(batch, "text"):
                for text in part.column("text").to_pylist():
                    held += [encode(shared.value, text or "").astype(number), np.array([end], number)]
                    size += len(held[-2]) + 1
                if size >= block_tokens:
                    flat = np.concatenate(held)
                    for at in range(0, size - size % block_tokens, block_tokens):
                        yield row(flat[at:at + block_tokens].tobytes(), block, None, None)
                        block += 1
                    held, size = [flat[size - size % block_tokens:]], size % block_tokens
                yield row(None, None, place, part.column("doc_id").to_pylist())
                place += part.num_rows
        if size:
            yield row(np.concatenate(held).tobytes(), block, None, None)

    packed = docs.select("doc_id", "text").mapInArrow(work, f"file int, block bigint, data binary, first bigint, ids array<{kind}>")
    path = scratch_path(docs.sparkSession, "tokens")
    packed.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(packed.schema).parquet(path)


@dataclass
class _Range(InputPartition):
    """Blocks ``first .. stop-1`` of a token file."""

    file: str
    first: int
    stop: int


class TokenFileReader(DataSourceReader):
    """Byte ranges of token files: a task seeks to its blocks and reads no more, so a file may have any size."""

    def __init__(self, options):
        self.step = int(options["block_tokens"]) * int(options["width"])
        self.blocks = int(options.get("blocks_per_task", "512"))
        path = mounted_path(options["path"])
        self.files = [path] if os.path.isfile(path) else sorted(
            os.path.join(folder, n) for folder, _, names in os.walk(path) for n in names if not n.startswith((".", "_")))

    def partitions(self):
        counts = [(file, -(-os.path.getsize(file) // self.step)) for file in self.files]
        return [_Range(file, first, min(first + self.blocks, n)) for file, n in counts for first in range(0, n, self.blocks)]

    def read(self, part: _Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # Spark asks once where there is no file
            return
        with open(part.file, "rb") as f:
            f.seek(part.first * self.step)
            for block in range(part.first, part.stop):
                yield pa.record_batch([pa.array([part.file]), pa.array([block], pa.int64()), pa.array([f.read(self.step)], pa.binary())], names=["file", "block", "data"])


class TokenFiles(DataSource):
    """``spark.read.format("token_files")``; options: path, width, block_tokens, blocks_per_task."""

    @classmethod
    def name(cls):
        return "token_files"

    def schema(self):
        return "file string, block bigint, data binary"

    def reader(self, schema):
        return TokenFileReader(self.options)


def read_token_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS, blocks_per_task: int = 512) -> DataFrame:
    """Blocks (file, block, data) of the flat binary token files at ``path``, a file or a folder that all executors mount. An empty file has no block."""
    spark.dataSource.register(TokenFiles)
    options = {"width": width, "block_tokens": block_tokens, "blocks_per_task": blocks_per_task}
    return spark.read.format("token_files").options(**options).load(path)


def _scan(end: int, width: int):
    kind = np.dtype({2: "<u2", 4: "<u4"}[width])

    def work(batches):
        for batch in batches:
            found = [np.frombuffer(b.as_buffer(), kind) if b.is_valid else np.zeros(0, kind) for b in batch.column("data")]
            ends = [np.flatnonzero(tokens == end).astype(np.int64) for tokens in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array([len(t) for t in found], pa.int64()), pa.array([len(e) for e in ends], pa.int64()),
                 pa.array([int(e[-1]) if len(e) else None for e in ends], pa.int64()), pa.array([e.tobytes() for e in ends], pa.binary())],
                names=["file", "block", "tokens", "closed", "last", "ends"])

    return work


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            file, start, place, before, ends = (batch.column(c)[k].as_py() for c in ("file", "start", "place", "before", "ends"))
            at = np.frombuffer(ends, np.int64) + start
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(at), batch.schema.field("file").type), pa.array(place + np.arange(len(at))),
                     pa.array(np.diff(at, prepend=before) - 1), pa.array(np.ones(len(at), bool))], names=["file", "place", "n_tokens", "closed"])


def document_lengths(blocks: DataFrame, end: int, width: int = 2, span: int = 4096) -> DataFrame:
    """file, place, n_tokens, closed: one row per document of each file, by place from 0.

    The end id is not counted; two in a row close an empty document. Tokens
    after the last one are a document that is not closed. ``span`` blocks of a file
    form a range of the scan, so no file is scanned by one task.
    """
    kind = blocks.schema["file"].dataType.simpleString()
    schema = f"file {kind}, block bigint, tokens bigint, closed bigint, last bigint, ends binary"
    path = scratch_path(blocks.sparkSession, "ends")
    blocks.select("file", "block", "data").mapInArrow(_scan(end, width), schema).write.parquet(path)
    found = blocks.sparkSession.read.schema(schema).parquet(path)
    ranges = F.floor(F.col("block") / span)
    placed = running(found, ranges, ["block"], {"start": ("sum", F.col("tokens")), "place": ("sum", F.col("closed"))}, by=["file"], inclusive=False)
    placed = placed.withColumn("stop", F.col("start") + F.col("last"))
    ready = running(placed, ranges, ["block"], {"before": ("max", F.col("stop"))}, by=["file"], inclusive=False)
    ready = ready.withColumn("before", F.coalesce("before", F.lit(-1).cast("bigint")))
    closed = ready.select("file", "start", "place", "before", "ends").mapInArrow(_lengths, f"file {kind}, place bigint, n_tokens bigint, closed boolean")
    open_end = placed.groupBy("file").agg(F.sum("closed").alias("place"), F.sum("tokens").alias("all"), F.coalesce(F.max("stop"), F.lit(-1)).alias("stop"))
    open_end = open_end.filter("all - 1 > stop").select("file", "place", (F.col("all") - 1 - F.col("stop")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(open_end)


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, file, place, n_tokens: packs ``docs`` into token files and counts by scanning them.

    Null and empty texts have 0 tokens; repeated rows have a count each; an empty
    table gives no rows.
    """
    packed = pack(docs, vocabulary, block_tokens)
    end = end_id(_read(vocabulary))
    counts = document_lengths(packed.filter("data is not null"), end, id_width(end))
    order = packed.filter("ids is not null").select("file", "first", F.posexplode("ids").alias("k", "doc_id"))
    order = order.select("file", (F.col("first") + F.col("k")).alias("place"), "doc_id")
    return order.join(counts, ["file", "place"]).select("doc_id", "file", "place", "n_tokens")
