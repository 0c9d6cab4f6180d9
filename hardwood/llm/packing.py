"""Cost-balanced packing of documents into fixed-size training sequences.

A piece of n tokens costs LINEAR * n + QUADRATIC * n * n (matrix products, and attention inside the piece).
Pieces are taken in descending cost, and each goes to the sequence with the lowest cost so far that has room
for it; a piece for which no sequence has room is cut along the room that is left, lowest cost first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hardwood.llm.text import slices
from hardwood.llm.tokens import encoder

CAPACITY, END_ID = 2048, 1
#: Cost of a token by itself, and of a token seen by a token of its piece.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Tokens that are packed together; bounds the memory of a task.
GROUP_TOKENS = 2_000_000
#: Bytes of text encoded at once, and pieces that a worker remembers.
SLICE, PIECES = 1_000_000, 600_000

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
)


def cost(length: np.ndarray | int) -> np.ndarray | float:
    return LINEAR * length + QUADRATIC * length * length


def room_of(total: int, capacity: int) -> np.ndarray:
    """Room of each sequence: full ones, then the binary digits of the rest, as lengths of a power of two need no padding."""
    rest = total % capacity
    return np.array([capacity] * (total // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], np.int64)


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; the sequences have no gap and no padding."""
    room = room_of(int(lengths.sum()), capacity)
    size, spent = room.copy(), np.zeros(len(room))
    out: list[tuple[int, int, int, int, int]] = []
    following = 0
    tails: list[tuple[int, int, int]] = []
    for d, n in enumerate(lengths.tolist()):
        for k in range(n // capacity):  # such a piece is a whole sequence
            out.append((d, k * capacity, capacity, following, 0))
            room[following], spent[following] = 0, cost(capacity)
            following += 1
        if n % capacity:
            tails.append((n % capacity, d, n - n % capacity))
    tails.sort(key=lambda x: (-x[0], x[1]))

    def put(d: int, start: int, n: int, s: int) -> None:
        out.append((d, start, n, s, int(size[s] - room[s])))
        room[s] -= n
        spent[s] += cost(n)

    for n, d, start in tails:
        while n:
            fits = room >= n
            if not fits.any():
                fits = room > 0
            s = int(np.where(fits, spent, np.inf).argmin())
            part = min(n, int(room[s]))
            put(d, start, part, s)
            start, n = start + part, n - part
    return out


def _packer(path: str, capacity: int, group_tokens: int, pieces: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_encoder = encoder(path, True, pieces)
        task = TaskContext.get()
        following = (task.partitionId() if task else 0) << 33
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal following
            names = [x for h in held for x in h[0]]
            ids = np.concatenate([h[1] for h in held])
            lengths = np.concatenate([h[2] for h in held])
            first = np.cumsum(lengths) - lengths
            rows = pack(lengths, capacity)
            held.clear()
            crc = [zlib.crc32(ids[first[d] + s : first[d] + s + n].astype("<u4", copy=False)) for d, s, n, _, _ in rows]
            d, s, n, q, o = (np.array(c, np.int64) for c in zip(*rows, strict=True))
            made = pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in d], pa.int64()), pa.array(s), pa.array(n), pa.array(crc, pa.int64()),
                 pa.array(lengths[d]), pa.array(q + following), pa.array(o), pa.array(cost(n).astype(np.float64))],
                names=[c.split()[0] for c in SCHEMA.split(", ")],
            )
            following += int(q.max()) + 1
            return made

        waiting = 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            for low, high, texts in slices(batch.column(1), SLICE):
                ids, lengths = held_encoder.encode(texts, END_ID)
                held.append((names[low:high], ids, lengths))
                waiting += len(ids)
                if waiting >= group_tokens:
                    yield flush()
                    waiting = 0
        if held:
            yield flush()

    return run


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text",
    group_tokens: int = GROUP_TOKENS, pieces: int = PIECES,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost.

    Null text is the empty text, which is its end id alone; rows that repeat are documents of their own; no rows give
    no rows. Documents of a task are packed in groups of about `group_tokens`, so nothing shuffles and memory is bounded (`pieces` bounds what a worker remembers);
    sequence ids hold the partition's number above bit 33.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_packer(tokenizer_path, capacity, group_tokens, pieces), SCHEMA)
