"""Repeated byte strings, removed everywhere but in the document of the smallest doc_id, by blocks of sorted suffixes.

A difference cover is a set of residues such that two suffixes at any places meet it after the same few bytes. So the suffixes
at covered places (a fifth of all) are ranked first: those whose leading bytes other documents don't have are settled, and
with them every suffix that leads to settled ones alone, however long its text goes on. What is left are the ties. They are
dealt into buckets that hold all suffixes with equal leading bytes, and a task sorts one bucket at a time and compares
neighbours byte by byte, so its memory is bounded by a bucket and not by the text.

Documents travel in compressed packs. A pack says once which strings it has (distinct within a window of its text), as
sorted and packed fingerprints for the cover sample and as runs of neighbouring suffixes for the ties, so that a popular
passage costs a bucket one run a window and not one row an occurrence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hardwood.llm.text import mix
from hardwood.session import materialize

#: Bytes of a repeated string; period and residues of the difference cover (a perfect difference set); bytes ranked at a covered place.
LENGTH, PERIOD, COVER = 50, 31, (1, 5, 11, 24, 25, 27)
SAMPLE = LENGTH - PERIOD + 1
#: Bytes of a pack (one document at least), of a window of it, and covered places of a bucket, about.
PACK, WINDOW, BUCKET = 2_000_000, 2_500_000, 1_000_000

_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_C = mix(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)
_LAST = np.iinfo(np.int64).max


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=6).compress
    task, number = TaskContext.get().partitionId(), 0
    ids: list[int | None] = []
    parts: list[bytes] = []
    held = 0

    def out() -> pa.RecordBatch:
        nonlocal number, held
        row = pa.RecordBatch.from_pydict({
            "pack": pa.array([task << 32 | number], pa.int64()), "n_bytes": pa.array([held], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())),
            "sizes": pa.array([[len(p) for p in parts]], pa.list_(pa.int64())), "body": pa.array([squeeze(b"".join(parts))], pa.binary()),
        })
        number, held = number + 1, 0
        ids.clear()
        parts.clear()
        return row

    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        for k in range(batch.num_rows):
            body = texts[k].as_py() or b""
            ids.append(batch.column(0)[k].as_py())
            parts.append(body)
            held += len(body)
            if held >= PACK:
                yield out()
    if ids:
        yield out()


class Pack:
    """The documents of a pack in columns."""

    def __init__(self, row: dict):
        self.ids = row["ids"]
        self.sizes = np.array(row["sizes"], np.int64)
        # eight bytes more, so that a word can be read at every place
        raw = zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=max(1, row["n_bytes"])) if row["n_bytes"] else b""
        self.bytes = np.frombuffer(raw + bytes(8), np.uint8)
        self.n = len(raw)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        # a null doc_id comes after all others
        self.keys = np.array([_LAST if i is None else i for i in self.ids], np.int64)
        self.rank = np.unique(self.keys, return_inverse=True)[1].astype(np.int32)

    def windows(self) -> Iterator[tuple[int, int]]:
        for low in range(0, self.n, WINDOW):
            yield low, min(low + WINDOW, self.n)

    def within(self, low: int, high: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places low .. high - 1, counted from low, whose next `size` bytes lie in their document, and the document of each."""
        first, last = np.searchsorted(self.ends, [low, high - 1], "right")
        doc = np.arange(first, last + 1)
        begin = np.maximum(self.starts[doc], low)
        n = np.maximum(np.minimum(self.ends[doc] - size + 1, high) - begin, 0)
        at = np.arange(int(n.sum()), dtype=np.int32) + np.repeat((begin - low - np.cumsum(n) + n).astype(np.int32), n)
        return at, np.repeat(doc.astype(np.int32), n)


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, without a copy."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,))


def prints(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit fingerprint of the `size` bytes (8 at least) from each place on."""
    places = [*range(0, size - 8, 8), size - 8]
    h = words[at] * _C[0]
    for k, j in enumerate(places[1:]):
        h ^= h >> np.uint64(32)
        h = (h ^ words[at + j]) * _C[(k + 1) % len(_C)]
    return mix(h)


def covered(pack: Pack, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Covered places of the window whose sample lies inside the document, and their documents; those too short for a match have none."""
    at, doc = pack.within(low, high, SAMPLE)
    residue = (at + ((low - pack.starts) % PERIOD).astype(np.int32)[doc]) % PERIOD
    take = np.flatnonzero(_IN_COVER[residue] & (pack.sizes >= LENGTH)[doc])
    return at[take].astype(np.int64) + low, doc[take]


def _dealt(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket (upper half) and remaining fingerprint of 32 bits."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)


def sample_keys(pack: Pack, low: int, high: int, words: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Covered places in the order of their keys, the distinct keys, where each one's run begins, and whether two documents of the window have it."""
    at, doc = covered(pack, low, high)
    key = _dealt(prints(words, at, SAMPLE), buckets)
    order = np.argsort(key)
    at, key, rank = at[order], key[order], pack.rank[doc[order]]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    both = np.minimum.reduceat(rank, first) != np.maximum.reduceat(rank, first) if len(key) else np.empty(0, bool)
    return at, key[first], first, both


def _planes(x: np.ndarray) -> bytes:
    """First bytes of all numbers, then second ones, and so on: near numbers compress well that way."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def _numbers(raw: bytes, kind: str, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, n).T).view(kind).ravel()


def _bounds(bucket: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal numbers in a sorted array."""
    if not len(bucket):
        return []
    cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _packs(batches: Iterator[pa.RecordBatch], with_replies: bool = False) -> Iterator[tuple[int, Pack, list]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            yield row["pack"], Pack(row), (row["replies"] or []) if with_replies else []


def _sample(buckets: int):
    """The distinct sample keys of each window, a row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for name, pack, _ in _packs(batches):
            words = words_at(pack.bytes)
            for w, (low, high) in enumerate(pack.windows()):
                _, key, _, _ = sample_keys(pack, low, high, words, buckets)
                rows = []
                bucket, rest = (key >> np.uint64(32)).astype(np.int64), key.astype(np.uint32)
                for a, b in _bounds(bucket):
                    rows.append((int(bucket[a]), name, w, b - a, squeeze(_planes(np.diff(rest[a:b], prepend=np.uint32(0))))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()], strict=True)],
                    names=["bucket", "pack", "win", "n", "keys"],
                )

    return run


def _buckets(batches: Iterator[pa.RecordBatch], done) -> Iterator[pa.RecordBatch]:
    """Calls `done` with the rows of one bucket at a time; rows come sorted by bucket (column 0)."""
    now, held = None, []
    for batch in batches:
        key = batch.column(0).to_numpy()
        for a, b in _bounds(key):
            if now is not None and now != key[a]:
                yield done(held)
                held = []
            now = key[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield done(held)


def _rank_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row of a bucket, which of its keys another row has too, as bits."""
    expand = zstandard.ZstdDecompressor().decompress

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = [(bucket, name, w, np.cumsum(_numbers(expand(raw), "<u4", n), dtype=np.uint32))
                for part in held for bucket, name, w, n, raw in zip(*[c.to_pylist() for c in part.columns], strict=True)]
        every = np.sort(np.concatenate([r[3] for r in rows]))
        again = every[1:][every[1:] == every[:-1]]
        bits = []
        for _, _, _, keys in rows:
            if len(again):
                bits.append(np.packbits(again[np.minimum(np.searchsorted(again, keys), len(again) - 1)] == keys).tobytes())
            else:
                bits.append(bytes((len(keys) + 7) // 8))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array(bits, pa.binary())],
            names=["pack", "win", "bucket", "bits"],
        )

    yield from _buckets(batches, done)


def ties(pack: Pack, replies: list[dict], words: np.ndarray, buckets: int) -> np.ndarray:
    """Places of the pack at which a string of LENGTH bytes may start that another document has too."""
    step = np.zeros(pack.n + 1, np.int32)
    said: dict[int, list[dict]] = {}
    for r in replies:
        said.setdefault(r["win"], []).append(r)
    for w, (low, high) in enumerate(pack.windows()):
        at, key, first, again = sample_keys(pack, low, high, words, buckets)
        bucket = (key >> np.uint64(32)).astype(np.int64)
        for r in said.get(w, []):
            a, b = np.searchsorted(bucket, [r["bucket"], r["bucket"] + 1])
            again[a:b] |= np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=b - a).astype(bool)
        hit = at[np.repeat(again, np.diff(first, append=len(at)))]
        np.add.at(step, np.maximum(hit - (PERIOD - 1), pack.starts[np.searchsorted(pack.ends, hit, "right")]), 1)
        np.add.at(step, hit + 1, -1)
    may = np.cumsum(step[:-1], dtype=np.int32) > 0
    out = []
    for low, high in pack.windows():
        at = pack.within(low, high, LENGTH)[0]
        out.append(at[may[low + at]].astype(np.int64) + low)
    return np.concatenate([np.empty(0, np.int64), *out])


def same_string(words: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether the LENGTH bytes at the places are equal."""
    out = np.ones(len(one), bool)
    for j in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        out &= words[one + j] == words[other + j]
    return out


def groups_of(words: np.ndarray, at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the smallest key of all places with the same fingerprint, by sorting; and of those that share one, whether their strings are equal."""
    h = prints(words, at, LENGTH)
    order = np.argsort(h)
    sorted_h = h[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]]))
    size = np.diff(first, append=len(at))
    least = np.empty(len(at), key.dtype)
    least[order] = np.repeat(np.minimum.reduceat(key[order], first), size)
    shared = np.repeat(size > 1, size)
    mine, lead = at[order[shared]], at[np.repeat(order[first], size)[shared]]
    return least, same_string(words, mine, lead)


def smallest(words: np.ndarray, at: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each place the smallest key of all places with the same string; by the bytes themselves where fingerprints of different strings meet."""
    least, right = groups_of(words, at, key)
    if right.all():
        return least
    rows = np.stack([words[at + j] for j in (*range(0, LENGTH - 8, 8), LENGTH - 8)], axis=1)
    _, group = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1] * 8}").ravel(), return_inverse=True)
    best = np.full(group.max() + 1, np.iinfo(key.dtype).max, key.dtype)
    np.minimum.at(best, group, key)
    return best[group]


def _runs_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of neighbouring places."""
    new = np.concatenate([[True], at[1:] != at[:-1] + 1]) if len(at) else np.empty(0, bool)
    first = np.flatnonzero(new)
    return at[first], np.diff(first, append=len(at))


def _list_of_runs(at: np.ndarray) -> bytes:
    start, size = _runs_of(at)
    raw = np.concatenate([np.diff(start, prepend=0), size]).astype("<i8")
    return zstandard.ZstdCompressor(level=1).compress(_planes(raw))


_TIED = "bucket long, pack long, n int, place binary, strings binary"


def _tied(buckets: int):
    """Runs of tied suffixes of each window, a row for each bucket; places settled within the window go along, with n = 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for name, pack, replies in _packs(batches, True):
            words = words_at(pack.bytes)
            every = ties(pack, replies, words, buckets)
            for low, high in pack.windows():
                rows: list[tuple] = []
                at = every[slice(*np.searchsorted(every, [low, high]))]
                if not len(at):
                    continue
                # the least fingerprint of the samples inside its string says a suffix's bucket; neighbours mostly share it
                span = np.zeros(high - low + LENGTH + 1, np.int32)
                start, size = _runs_of(at - low)
                np.add.at(span, start, 1)
                np.add.at(span, start + size + PERIOD - 1, -1)
                need = np.flatnonzero(np.cumsum(span) > 0)
                least = np.full(high - low + LENGTH + 1, np.iinfo(np.uint64).max, np.uint64)
                least[need] = prints(words, need + low, SAMPLE)
                for k in (1, 2, 4, 8, PERIOD - 16):
                    least = np.minimum(least[:-k], least[k:])
                rank = pack.rank[np.searchsorted(pack.ends, at, "right")]
                settled = smallest(words, at, rank) < rank
                if settled.any():
                    rows.append((name % buckets, name, 0, _list_of_runs(at[settled]), b""))
                    at = at[~settled]
                if len(at):
                    low_print = least[at - low]
                    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (low_print[1:] != low_print[:-1])]))
                    size = np.diff(new, append=len(at))
                    start, dealt = at[new], _dealt(mix(low_print[new]), buckets) >> np.uint64(32)  # least ones are small: mixed, they spread
                    order = np.argsort(dealt, kind="stable")
                    start, size, dealt = start[order], size[order], dealt[order].astype(np.int64)
                    key = pack.keys[np.searchsorted(pack.ends, start, "right")]
                    for a, b in _bounds(dealt):
                        long = size[a:b] + LENGTH - 1
                        text = pack.bytes[np.repeat(start[a:b] - np.cumsum(long) + long, long) + np.arange(int(long.sum()))]
                        place = np.concatenate([np.diff(start[a:b], prepend=0), size[a:b], np.diff(key[a:b], prepend=0)]).astype("<i8")
                        rows.append((int(dealt[a]), name, b - a, squeeze(_planes(place)), squeeze(text.tobytes())))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()], strict=True)],
                        names=["bucket", "pack", "n", "place", "strings"],
                    )

    return run


def _sort_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pack, the places whose string starts in a document of a smaller doc_id."""
    expand = zstandard.ZstdDecompressor().decompress

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        names, out, texts, starts, sizes, keys, owner = [], [], [], [], [], [], []
        for part in held:
            for _, name, n, place, strings in zip(*[c.to_pylist() for c in part.columns], strict=True):
                if not n:
                    names.append(name)
                    out.append(place)
                    continue
                x = _numbers(expand(place), "<i8", 3 * n).reshape(3, n)
                texts.append(expand(strings))
                starts.append(np.cumsum(x[0]))
                sizes.append(x[1])
                keys.append(np.cumsum(x[2]))
                owner.append(np.full(n, name, np.int64))
        if texts:
            data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
            texts.clear()
            start, size, key, name = map(np.concatenate, (starts, sizes, keys, owner))
            long = size + LENGTH - 1
            inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            at = np.repeat(np.cumsum(long) - long, size) + inside
            mine = np.repeat(key, size)
            gone = smallest(words_at(data), at, mine) < mine
            place, who = (np.repeat(start, size) + inside)[gone], np.repeat(name, size)[gone]
            order = np.lexsort((place, who))
            place, who = place[order], who[order]
            for a, b in _bounds(who):
                names.append(int(who[a]))
                out.append(_list_of_runs(place[a:b]))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.binary())], names=["pack", "runs"])

    yield from _buckets(batches, done)


def _removed(digests: bool):
    """One row a document: what the runs of its pack leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for _, pack, replies in _packs(batches, True):
            step = np.zeros(pack.n + 1, np.int32)
            for raw in replies:
                body = expand(raw)
                start, size = _numbers(body, "<i8", len(body) // 8).reshape(2, -1)
                start = np.cumsum(start)
                np.add.at(step, start, 1)
                np.add.at(step, start + size + LENGTH - 1, -1)
            gone = np.cumsum(step[:-1], dtype=np.int32) > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            begin = gone.copy()
            begin[1:] &= ~gone[:-1]
            firsts = pack.starts[pack.sizes > 0]
            begin[firsts] = gone[firsts]
            spans = np.concatenate([[0], np.cumsum(begin)])
            kept = []
            for a, b in zip(pack.starts.tolist(), pack.ends.tolist(), strict=True):
                text = pack.bytes[a:b] if total[a] == total[b] else pack.bytes[a:b][~gone[a:b]]
                kept.append(hashlib.sha256(text).hexdigest() if digests else text.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(pack.ids, pa.int64()), pa.array(pack.sizes), pa.array(total[pack.ends] - total[pack.starts]), pa.array(spans[pack.ends] - spans[pack.starts]),
                 pa.array(kept, pa.string() if digests else pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digests else "kept"],
            )

    return run


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def _with(packs: DataFrame, replies: DataFrame, what) -> DataFrame:
    """Packs with the list of their replies."""
    said = replies.groupBy(F.col("pack").alias("to")).agg(F.collect_list(what).alias("replies"))
    return packs.join(said, F.col("pack") == F.col("to"), "left").drop("to")


def _apply(docs: DataFrame, doc_id: str, text: str, digests: bool) -> DataFrame:
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    packs = materialize(rows.mapInArrow(_pack_rows, "pack long, n_bytes long, ids array<long>, sizes array<long>, body binary"))
    n = packs.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first().n
    buckets = max(1, -(-n * len(COVER) // (PERIOD * BUCKET)))
    sample = _in_order(packs.mapInArrow(_sample(buckets), "bucket long, pack long, win int, n int, keys binary"))
    ranked = sample.mapInArrow(_rank_sample, "pack long, win int, bucket long, bits binary")
    tied = _with(packs, ranked, F.struct("win", "bucket", "bits")).mapInArrow(_tied(buckets), _TIED)
    found = materialize(_in_order(tied).mapInArrow(_sort_bucket, "pack long, runs binary"))
    last = "kept_sha256 string" if digests else "kept binary"
    return _with(packs, found, F.col("runs")).mapInArrow(_removed(digests), f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay; they need not be whole characters).

    Removed is each byte that a string of LENGTH bytes covers which also starts in a document of a smaller doc_id; strings
    are those of the input. A null text counts as empty; a null doc_id comes after all others; rows of one doc_id don't
    remove each other's bytes. No rows give no rows; other columns aren't read. A task holds a pack (one document at
    least, with about 15 bytes a byte) or one bucket.
    """
    return _apply(docs, doc_id, text, False)


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As `remove_repeats`, with kept_sha256 in place of the bytes."""
    return _apply(docs, doc_id, text, True)
