"""SentencePiece ids by a streaming Viterbi search, and text from ids.

Every position of the text keeps one survivor: the last piece of the best path that ends there, with a pointer to where that
piece starts. For a BPE vocabulary the best path is the one its merge order gives, and a piece may follow another only if
the merges of both together leave the two apart; this decides among the candidates, which are at most the longest
piece's length back. As soon as the pointers of all positions that a later piece can start from meet in one boundary,
the ids before it are final and are handed out; only the rest stays in memory.

No piece reaches over a space mark, so all paths meet in front of each one: what lies between two such places is a part that
the window commits by itself, and a worker remembers the parts' ids, commits and windows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hardwood.llm.text import slices
from hardwood.llm.tokens import CachedEncoder

SPACE = "▁"
#: Positions between two tries to commit, and pairs remembered.
STEP, PAIRS = 64, 500_000
_PARTS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


class Vocabulary:
    """Pieces of a model file with their merge order."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(len(model))]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(len(model)) if model.is_byte(i)}
        plain = [i for i in range(len(model)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        order = sorted(plain, key=lambda i: -model.get_score(i))
        self.ids = {self.pieces[i]: i for i in plain}
        self.rank = {self.pieces[i]: k for k, i in enumerate(order)}
        self.longest = max(map(len, self.ids))
        self.unknown = model.unk_id()
        #: Pieces that merging gives back, and the lengths they have with each three last characters, longest first.
        self.whole = {p: i for p, i in self.ids.items() if self.merged(p) == [p]}
        ends: dict[str, set[int]] = {}
        for p in self.whole:
            if len(p) > 2:
                ends.setdefault(p[-3:], {2, 1}).add(len(p))
        self.lengths = {e: tuple(sorted(n, reverse=True)) for e, n in ends.items()}
        self._apart: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging neighbours in the order of the vocabulary."""
        parts = list(text)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.rank.get(parts[i] + parts[i + 1], 1 << 30), i))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def apart(self, one: int, other: int) -> bool:
        """Whether the two pieces side by side stay as they are."""
        key = one << 32 | other
        if (known := self._apart.get(key)) is None:
            if len(self._apart) >= PAIRS:
                self._apart.clear()
            pair = [self.pieces[one], self.pieces[other]]
            known = self._apart[key] = self.merged("".join(pair)) == pair
        return known


class StreamingViterbi:
    """Takes text in parts of any size and hands out final ids; `held` positions are in memory."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text, self.back, self.last = "", [0], [None]
        #: Times that ids were handed out before the end, and the most positions held.
        self.commits = self.peak = 0

    def feed(self, part: str) -> list[int]:
        whole, lengths, apart = self.v.whole.get, self.v.lengths.get, self.v.apart
        out: list[int] = []
        for low in range(0, len(part), STEP):
            self.text += part[low : low + STEP]
            text, back, last = self.text, self.back, self.last
            for end in range(len(last), len(text) + 1):
                for size in lengths(text[max(0, end - 3) : end], (2, 1)):
                    start = end - size
                    piece = whole(text[start:end]) if start >= 0 else None
                    if piece is not None and ((one := last[start]) is None or apart(one, piece)):
                        back.append(start)
                        last.append(piece)
                        break
                else:  # a character outside the vocabulary: no merge reaches over it
                    back.append(end - 1)
                    last.append(None)
            self.peak = max(self.peak, len(text))
            if len(text) >= 2 * STEP:
                out += self._commit()
        return out

    @property
    def held(self) -> int:
        return len(self.text)

    def _commit(self) -> list[int]:
        """Hand out what all survivors of the window share."""
        end = len(self.text)
        at = set(range(max(0, end - self.v.longest + 1), end + 1))
        while len(at) > 1:  # move the furthest pointer back until all meet
            far = max(at)
            at.remove(far)
            at.add(self.back[far])
        (meet,) = at
        if not meet:
            return []
        self.commits += 1
        ids = self._path(meet)
        self.text = self.text[meet:]
        self.back = [0, *(b - meet for b in self.back[meet + 1 :])]
        self.last = self.last[meet:]
        return ids

    def _path(self, end: int) -> list[int]:
        out: list[int] = []
        while end:
            start, piece = self.back[end], self.last[end]
            if piece is not None:
                out.append(piece)
            elif self.v.bytes:
                out += [self.v.bytes[b] for b in reversed(self.text[start:end].encode("utf-8", "surrogatepass"))]
            else:
                out.append(self.v.unknown)
            end = start
        return out[::-1]

    def close(self) -> list[int]:
        out = self._path(len(self.text))
        self.text, self.back, self.last = "", [0], [None]
        return out


class PieceEncoder(CachedEncoder):
    """Whole texts; parts between safe cuts (before a space mark, around a line end) are remembered."""

    def __init__(self, path: str, limit: int = 1_000_000, longest: int = 64):
        self._begin(limit, longest)
        self.v = Vocabulary(path)
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.v.ids):
            raise ValueError("a piece of this vocabulary reaches over a cut")
        self.viterbi = StreamingViterbi(self.v)
        self.commits = self.peaks = np.zeros(1 << 12, np.int64)
        self.table = np.array([p.replace(SPACE, " ") for p in self.v.pieces], object)
        self.byte_of = {i: b for b, i in self.v.bytes.items()}
        self.is_byte = np.zeros(len(self.v.pieces), bool)
        self.is_byte[list(self.byte_of)] = True

    def cut(self, text: str) -> list[str]:
        held = SPACE + text.replace(" ", SPACE)
        if SPACE * 2 in held or "\x01" in held:
            return _PARTS.findall(held)
        return [p for p in held.replace(SPACE, "\x01" + SPACE).replace("\n", "\x01\n\x01").split("\x01") if p]

    def _add(self, pieces: list[str]) -> dict[str, int]:
        found, ids, seen = {}, [], []
        for p in pieces:
            found[p] = self.count + len(ids)
            self.viterbi.commits = self.viterbi.peak = 0
            ids.append(self.viterbi.feed(p) + self.viterbi.close())
            seen.append((self.viterbi.commits + 1, self.viterbi.peak))
        while self.count + len(seen) > len(self.peaks):
            self.commits, self.peaks = (np.concatenate([x, np.zeros_like(x)]) for x in (self.commits, self.peaks))
        if seen:
            self.commits[self.count : self.count + len(seen)], self.peaks[self.count : self.count + len(seen)] = np.array(seen).T
        self._store(np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64))
        return found

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Commits and largest window of each text encoded last."""
        ends = np.concatenate([[0], np.cumsum(self.commits[self.places])])[self.cuts]
        peak = np.zeros(len(self.cuts) - 1, np.int64)
        some = np.flatnonzero(np.diff(self.cuts))
        if len(some):
            peak[some] = np.maximum.reduceat(self.peaks[self.places], self.cuts[some])
        return np.diff(ends), peak

    def texts(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """The texts of all ids in a row."""
        ends = np.cumsum(lengths)
        odd = np.diff(np.concatenate([[0], np.cumsum(self.is_byte[ids])])[np.concatenate([[0], ends])]) > 0
        strings = self.table[ids].tolist()
        out = []
        for a, b, has_bytes in zip((ends - lengths).tolist(), ends.tolist(), odd.tolist(), strict=True):
            if has_bytes:
                out.append(self.decode(ids[a:b].tolist()))
            else:
                text = "".join(strings[a:b])
                out.append(text[1:] if text[:1] == " " else text)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: byte pieces as UTF-8, space marks as spaces, the first space taken off."""
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.table[i])
        text = "".join([*out, raw.decode("utf-8", "replace")])
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=1)
def encoder(path: str) -> PieceEncoder:
    """The encoder of this Python worker, which later tasks of the worker go on with."""
    return PieceEncoder(path)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = encoder(path)
        for batch in batches:
            for low, high, texts in slices(batch.column(1), 1_000_000):
                ids, lengths = held.encode(texts)
                ends = np.cumsum(lengths)
                parts = [ids[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                same = [x == (t or "") for x, t in zip(held.texts(ids, lengths), texts, strict=True)]
                commits, peak = held.windows()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(p.astype("<u4", copy=False)) for p in parts], pa.int64()),
                     pa.array(same), pa.array(commits), pa.array(peak)],
                    names=["doc_id", "n_ids", "ids_crc32", "round_trip", "n_commits", "max_window"],
                )

    return run


def _encode_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = encoder(path)
        for batch in batches:
            for low, high, texts in slices(batch.column(1), 1_000_000):
                ids, lengths = held.encode(texts)
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return run


def _decode_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else held.decode(x) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return run


def encode(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids of every row; a null or empty text has no ids. Nothing shuffles."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_encode_rows(model_path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of every row of `encode`; null ids give a null text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode_rows(model_path), "doc_id long, text string")


def digest(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_ids, ids_crc32 (of the ids as little-endian 32-bit integers), round_trip, n_commits
    and max_window (times that the search handed out ids, and the most positions it held).

    round_trip: whether decoding the ids gives the text again; it does unless the text has the space mark itself. Null and
    empty texts have no ids; repeated rows give equal rows; no rows give no rows; a null doc_id stays null.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_encode(model_path), "doc_id long, n_ids long, ids_crc32 long, round_trip boolean, n_commits long, max_window long")
