"""Token ids as wavelet matrices: one compressed file per shard with access, counting and occurrence lookup.

File: magic, header length, JSON header, sections. A section is a zstd frame; the header has its place. Plane k holds bit
(planes - 1 - k) of every id, after a stable sort by the bits above; ids with a zero bit go first. `rank` holds, for
each plane, the ones before every 512th bit, which makes rank and select a directory step and one 64-byte look.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hardwood.llm.text import slices
from hardwood.llm.tokens import encoder
from hardwood.session import materialize

MAGIC, BLOCK, END_ID = b"HWWM0001", 512, 1
#: Tokens of one file, about.
SHARD_TOKENS = 1_000_000
#: Bytes of text encoded at once, and pieces that a worker remembers.
SLICE, PIECES = 1_000_000, 800_000


def build(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file of one shard. doc_ids: int64 with their presence in `lengths` order."""
    pack = zstandard.ZstdCompressor(level=1).compress
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    x = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    sections: list[bytes] = [pack(np.diff(doc_ids, prepend=0).astype("<i8").tobytes()), pack(lengths.astype("<i8").tobytes())]
    zeros: list[int] = []
    for k in range(planes - 1, -1, -1):
        bit = (x & x.dtype.type(1 << k)) != 0
        ones, others = np.flatnonzero(bit), np.flatnonzero(~bit)  # taking by place is far cheaper than by mask
        bits = np.packbits(bit, bitorder="little")
        per = np.add.reduceat(bit, np.arange(0, len(bit), BLOCK), dtype=np.uint32) if len(bit) else np.zeros(0, np.uint32)
        sections += [pack(bits.tobytes()), pack((np.cumsum(per) - per).astype("<u4").tobytes())]
        x = np.concatenate([x.take(others), x.take(ones)])
        zeros.append(len(others))
    ends = np.cumsum([len(s) for s in sections]).tolist()
    header = json.dumps({"tokens": len(ids), "docs": len(lengths), "planes": planes, "zeros": zeros, "ends": ends}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *sections])


class WaveletFile:
    """Reads one file; planes are unpacked when first needed."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet token file")
        (size,) = struct.unpack_from("<I", data, 8)
        self.head = json.loads(data[12 : 12 + size])
        self.body = memoryview(data)[12 + size :]
        self.n, self.planes, self.zeros = self.head["tokens"], self.head["planes"], self.head["zeros"]
        self._kept: dict[int, np.ndarray] = {}

    def _section(self, i: int, kind: str) -> np.ndarray:
        if i not in self._kept:
            ends = [0, *self.head["ends"]]
            self._kept[i] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.body[ends[i] : ends[i + 1]]), kind)
        return self._kept[i]

    def doc_ids(self) -> np.ndarray:
        return np.cumsum(self._section(0, "<i8"))

    def lengths(self) -> np.ndarray:
        return self._section(1, "<i8")

    def _bits(self, k: int) -> np.ndarray:
        return self._section(2 + 2 * k, "u1")

    def _rank1(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        if i <= 0:
            return 0
        block = min(i, self.n - 1) // BLOCK
        inside = np.unpackbits(self._bits(k)[block * 64 : block * 64 + 64], bitorder="little")[: i - block * BLOCK]
        return int(self._section(3 + 2 * k, "<u4")[block]) + int(inside.sum())

    def _select(self, k: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) such bit of plane k."""
        ones = self._section(3 + 2 * k, "<u4").astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(before, j, "right")) - 1
        inside = np.unpackbits(self._bits(k)[block * 64 : block * 64 + 64], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(inside == bit)[j - int(before[block])])

    def access(self, i: int) -> int:
        value = 0
        for k in range(self.planes):
            ones = self._rank1(k, i)
            bit = self._rank1(k, i + 1) - ones
            value = value << 1 | bit
            i = self.zeros[k] + ones if bit else i - ones
        return value

    def _span(self, token: int, low: int, high: int) -> tuple[int, int]:
        if token >> self.planes:
            return 0, 0
        for k in range(self.planes):
            a, b = self._rank1(k, low), self._rank1(k, high)
            low, high = (self.zeros[k] + a, self.zeros[k] + b) if token >> (self.planes - 1 - k) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences among the ids low .. high - 1."""
        low, high = self._span(token, low, self.n if high is None else high)
        return high - low

    def occurrences(self, token: int, low: int = 0, high: int | None = None) -> list[int]:
        """Their places, ascending."""
        out = []
        for p in range(*self._span(token, low, self.n if high is None else high)):
            for k in range(self.planes - 1, -1, -1):
                bit = token >> (self.planes - 1 - k) & 1
                p = self._select(k, bit, p - self.zeros[k] if bit else p)
            out.append(p)
        return out

    def ids(self) -> np.ndarray:
        """All ids (uint32), from the lowest plane up."""
        value = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for k in range(self.planes - 1, -1, -1):
            bit = np.unpackbits(self._bits(k), count=self.n, bitorder="little").view(bool)
            z, out = self.zeros[k], np.empty_like(value)
            out[np.flatnonzero(~bit)] = value[:z]
            out[np.flatnonzero(bit)] = value[z:] | value.dtype.type(1 << (self.planes - 1 - k))
            value = out
        return value.astype("<u4")


def _open(base: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that all executors share (file, hdfs, s3 and others that Arrow opens)."""
    if ":" not in base:
        return fs.LocalFileSystem(), base
    scheme, rest = base.split(":", 1)
    return fs.FileSystem.from_uri(f"{scheme}://{rest}" if not rest.startswith("//") else base)


def _store(base: str, name: str, data: bytes) -> None:
    """Write under a hidden name, then rename: a half-written file is never read, and a repeated task puts the same bytes."""
    files, path = _open(base)
    files.create_dir(path, recursive=True)
    part = f"{path}/_{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        out.write(data)
    files.move(part, f"{path}/{name}")


def _writer(tokenizer_path: str, base: str, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_encoder = encoder(tokenizer_path, False, PIECES)
        task = TaskContext.get().partitionId()
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        number = waiting = 0

        def flush() -> pa.RecordBatch:
            nonlocal number
            names = np.array([x for h in held for x in h[0]], np.int64)
            ids = np.concatenate([h[1] for h in held])
            lengths = np.concatenate([h[2] for h in held])
            held.clear()
            shard = task << 24 | number
            _store(base, f"shard-{shard}.wm", build(ids, names, lengths))
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([task], pa.int64()), pa.array([len(names)], pa.int64()), pa.array([len(ids)], pa.int64())],
                names=["shard", "block", "docs", "tokens"],
            )

        for batch in batches:
            names = batch.column(0).to_pylist()
            for low, high, texts in slices(batch.column(1), min(SLICE, shard_tokens)):
                ids, lengths = held_encoder.encode(texts, END_ID)
                held.append((names[low:high], ids, lengths))
                waiting += len(ids)
                if waiting >= shard_tokens:
                    yield flush()
                    waiting = 0
        if held:
            yield flush()

    return run


def write_shards(docs: DataFrame, tokenizer_path: str, base: str, doc_id: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode all texts into files under `base`, in ascending doc_id order; returns the stored list of the files.

    Null text is the empty text (its end id alone). Rows without a doc_id are left out, as the order of the files is
    that of the ids. Rows of one doc_id follow each other. No rows give no files. One range shuffle of the texts.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(_writer(tokenizer_path, base, shard_tokens), "shard long, block long, docs long, tokens long"))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held = WaveletFile(content)
            ids, lengths = held.ids(), held.lengths()
            ends = np.cumsum(lengths)
            crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            shard = int(path.rsplit("shard-", 1)[1].split(".")[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(held.doc_ids()), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64()), pa.array([shard] * len(lengths), pa.int64())],
                names=["doc_id", "inside", "n_tokens", "ids_crc32", "shard"],
            )


def read_documents(spark, base: str, shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard of every document in the files; `shards` is the list `write_shards` gave.

    The place of a file is the sum of its block's earlier files and of the earlier blocks (a block is one task of the writer).
    """
    blocks = shards.groupBy("block").agg(F.sum("tokens").alias("all"))
    blocks = blocks.select("block", (F.sum("all").over(Window.orderBy("block")) - F.col("all")).alias("base"))
    order = Window.partitionBy("block").orderBy("shard")
    places = shards.withColumn("earlier", F.sum("tokens").over(order) - F.col("tokens")).join(blocks, "block")
    places = materialize(places.select("shard", (F.col("base") + F.col("earlier")).alias("base")))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.wm").load(base).select("path", "content")
    docs = files.mapInArrow(_documents, "doc_id long, inside long, n_tokens long, ids_crc32 long, shard long")
    return docs.join(places, "shard").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "shard")
