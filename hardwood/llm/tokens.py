"""Token ids of whole texts by the tokenizers library, with a memory of the pieces between safe cuts.

A cut is safe where no token of the library can cross it, so the ids of the pieces one after another
are the ids of the whole text. Words repeat, so most pieces come from the memory.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import repeat

import numpy as np
from tokenizers import Tokenizer

_SPACES = re.compile(r"[ \t\n\r]+")
_ODD_SPACES = re.compile("[\x1c-\x1f]")
_RUN = re.compile(r"\s[ \n]")
_CUT = re.compile(r"\S(?=[ \n\t\r])")


def cut_dropping_spaces(text: str) -> list[str]:
    """Pieces for a tokenizer that drops white space: what stands between white space.

    Python also splits at U+001C to U+001F, which the library counts as symbols.
    """
    return _SPACES.split(text) if _ODD_SPACES.search(text) else text.split()


def cut_keeping_spaces(text: str) -> list[str]:
    """Pieces for a byte-level tokenizer: a cut stands after a character that is no white space and before
    white space, as none of its patterns has white space after anything else. Joined, they are the text."""
    if "\x01" not in text and not _RUN.search(text):
        return text.replace(" ", "\x01 ").replace("\n", "\x01\n").split("\x01")
    out, low = [], 0
    for m in _CUT.finditer(text):
        out.append(text[low : m.end()])
        low = m.end()
    out.append(text[low:])
    return out


#: Between pieces that are encoded in one call. A character of no merge, so its id stands where one piece ends.
MARK = "\0"
#: Pieces whose ids don't depend on a mark before or after them.
_PLAIN_KEEPING = re.compile(r"(?:[ \n](?=\S)|(?=[^\W\d_]))[^\0]*[^\0\s]")
_PLAIN_DROPPING = re.compile(r"[^\0]+")
#: A word whose pieces are its letters and perhaps one mark after them, and which NFC leaves as it is.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")


def byte_characters() -> dict[int, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(others)}


#: Pieces joined to one text for the library, which takes many such texts in one call without their offsets.
TOGETHER = 100


class CachedEncoder:
    """ids of many texts; remembers the ids of at most `limit` pieces of at most `longest` characters.

    After `encode`, `places` are the entries of all pieces of the texts, and `cuts` where each text's pieces begin.
    """

    def __init__(self, path: str, cut, limit: int = 250_000, longest: int = 64):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cut = cut
        keeping = cut is cut_keeping_spaces
        self.plain, self.join = (_PLAIN_KEEPING, MARK) if keeping else (_PLAIN_DROPPING, f" {MARK} ")
        self.mark = self._ids(MARK)
        self.model, self.characters, self.ends = self.tokenizer.model, byte_characters(), {"": []}
        self.by_model = not keeping and self._splits_words()
        self._begin(limit, longest)

    def _begin(self, limit: int, longest: int) -> None:
        self.limit, self.longest = limit, longest
        self.known: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 12, np.int64)
        self.sizes = np.zeros(1 << 12, np.int64)
        self.used = self.count = 0

    def _splits_words(self) -> bool:
        """Whether the library lower-cases (after NFC), parts letters from the rest and goes on with bytes: then the letters of a
        word can go to the library's model without the steps before it, which cost more than the model."""
        steps = json.loads(self.tokenizer.to_str())
        normal, pre = steps["normalizer"] or {}, steps["pre_tokenizer"] or {}
        first = (pre.get("pretokenizers") or [{}])[0]
        return (
            [n["type"] for n in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [n["type"] for n in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]
            and "|[\\p{L}]+|" in first["pattern"].get("Regex", "") and first["behavior"] == "Removed" and first["invert"]
        )

    def _of_word(self, letters: str, end: str) -> list[int]:
        """Ids of a `_WORD`."""
        if end not in self.ends:
            self.ends[end] = self._ids(end).tolist()
        spelled = letters.lower().encode().decode("latin-1").translate(self.characters)
        return [t.id for t in self.model.tokenize(spelled)] + self.ends[end]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _store(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Put the ids of one piece after another into the pool."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.count + len(sizes) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[self.count : self.count + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.count : self.count + len(sizes)] = sizes
        self.used += len(ids)
        self.count += len(sizes)

    def _add(self, pieces: list[str]) -> dict[str, int]:
        """Encode the pieces, most of them many in one call, and say where each one's ids are."""
        found: dict[str, int] = {}
        if self.by_model:
            spelled = [(p, m) for p in pieces if len(p) <= self.longest and (m := _WORD.fullmatch(p))]
            ids = [self._of_word(m[1], m[2]) for _, m in spelled]
            found |= zip((p for p, _ in spelled), range(self.count, self.count + len(ids)))
            self._store(np.array([i for x in ids for i in x], np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))
            pieces = [p for p in pieces if p not in found]
        plain = [p for p in pieces if len(p) <= self.longest and self.plain.fullmatch(p)] if len(self.mark) == 1 else []
        parts = [plain[low : low + TOGETHER] for low in range(0, len(plain), TOGETHER)]
        coded = self.tokenizer.encode_batch_fast([self.join.join(p) for p in parts], add_special_tokens=False) if parts else []
        for part, code in zip(parts, coded, strict=True):
            ids = np.array(code.ids, np.uint32)
            at = np.flatnonzero(ids == self.mark[0])
            if len(at) != len(part) - 1:
                continue
            sizes = np.diff(at, prepend=-1, append=len(ids)) - 1
            found |= zip(part, range(self.count, self.count + len(part)))
            self._store(np.delete(ids, at), sizes)
        for piece in pieces:
            if piece not in found:
                found[piece] = self.count
                ids = self._ids(piece)
                self._store(ids, np.array([len(ids)], np.int64))
        return found

    def encode(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids one text after another (uint32), and the number of ids of each text; `end` closes each text."""
        words: list[str] = []
        cuts = np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts):
            if t:
                words += self.cut(t)
            cuts[i + 1] = len(words)
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        keep_used, keep_count = self.used, self.count
        if len(new):
            missing = [words[i] for i in new.tolist()]
            fresh = list(dict.fromkeys(missing))
            found: dict[str, int] = {}
            if (free := self.limit - len(self.known)) > 0:
                found = self._add([w for w in fresh if len(w) <= self.longest][:free])
                self.known |= found
                keep_used, keep_count = self.used, self.count
            found = found | self._add([w for w in fresh if w not in found])
            at[new] = np.fromiter(map(found.__getitem__, missing), np.int64, len(missing))
        self.places, self.cuts = at, cuts
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        flat = np.repeat(self.starts[at] - ends + sizes, sizes)
        flat += np.arange(total)
        ids = self.pool[flat]
        self.used, self.count = keep_used, keep_count
        bounds = np.concatenate([[0], ends])[cuts]
        lengths = np.diff(bounds)
        if end is not None:
            closed = np.empty(total + len(texts), np.uint32)
            last = bounds[1:] + np.arange(len(texts))
            inner = np.ones(len(closed), bool)
            inner[last] = False
            closed[last], closed[inner] = end, ids
            ids, lengths = closed, lengths + 1
        return ids, lengths


@lru_cache(maxsize=2)
def encoder(path: str, keeping: bool, limit: int) -> CachedEncoder:
    """The encoder of this Python worker, which later tasks of the worker go on with. A piece takes about 300 bytes."""
    return CachedEncoder(path, cut_keeping_spaces if keeping else cut_dropping_spaces, limit)
