"""Spelling variants: words one edit apart, found in tries of letter-group counts.

A word's letters fall into groups; the counts of its groups, one after another, are a path of a trie. One inserted letter adds
one to a count, one deleted letter takes one away, and a replaced one does both or changes nothing, so a depth-first
search with a surplus and a deficit of one each reaches every word that can be near; the words at its leaves are verified.
The upper levels of the trie are the key by which Spark deals words and searches out, the levels below are built in
the task from sorted paths, and a search goes down them with all searches of a slice at once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hardwood.llm.text import slices
from hardwood.session import materialize

#: Characters of a word at least, occurrences at least, one in how many words loses a letter, and how much larger a form's n is.
LEAST, TWICE, ONE_IN, TIMES = 7, 2, 31, 10
#: Letter groups (a letter's group is its code point modulo this), levels of the trie in Spark's key, words of a key in one task.
GROUPS, LEVELS, PART_WORDS = 12, 4, 20_000
#: Words of the running count of a task, searches of a slice, columns in which letters are compared at once.
HELD, SEARCHES, WIDE = 200_000, 2_000, 48
#: Letters at an end of which an edit elsewhere takes nothing: LEAST letters have two such ends beside the place of the edit.
END = (LEAST - 1) // 2
_RUN = re.compile(rf"[a-zÀ-ÿ]{{{LEAST},}}")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        held.clear()
        return batch

    for batch in batches:
        names = batch.column(0).to_pylist()
        for low, _, texts in slices(batch.column(1)):
            for i, t in enumerate(texts):
                if not t:
                    continue
                name = names[low + i]
                begin = zlib.crc32(f"{'' if name is None else name}:".encode())
                # bytes.lower() changes A-Z alone; shorter runs can't give a word
                for run, n in Counter(_RUN.findall(t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
                    h = zlib.crc32(run.encode(), begin)
                    if h % ONE_IN == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < LEAST:
                            continue
                    held[run] += n
                if len(held) >= HELD:
                    yield out()
    if held:
        yield out()


def words_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n of all whole texts; tasks count before anything moves."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= TWICE)


def vectors(words: list[bytes]) -> np.ndarray:
    """Letter-group counts of words in Latin-1, one row a word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer(b"".join(words), np.uint8)
    at = np.repeat(np.arange(len(words)), sizes) * GROUPS + letters % GROUPS
    return np.bincount(at, minlength=len(words) * GROUPS).reshape(-1, GROUPS).astype(np.int64)


def moves() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Changes of the upper counts that a search may make, with the surplus and the deficit each one spends."""
    unit = np.eye(LEVELS, dtype=np.int64)
    rows = [(np.zeros(LEVELS, np.int64), 0, 0)]
    rows += [(u, 1, 0) for u in unit] + [(-u, 0, 1) for u in unit]
    rows += [(unit[i] - unit[j], 1, 1) for i in range(LEVELS) for j in range(LEVELS) if i != j]
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


def _key(counts: np.ndarray) -> np.ndarray:
    """One number of the upper counts (16 bits each; of two long words with the same number both are verified anyway)."""
    return (counts.astype(np.int64) & 0xFFFF) @ (np.int64(1) << (16 * np.arange(LEVELS, dtype=np.int64)))


def _keyed(searches: bool):
    """Rows (key, word, n, spent): each word under its own key, or under every key that its search visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change, surplus, deficit = moves() if searches else (np.zeros((1, LEVELS), np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64))
        for batch in batches:
            for low in range(0, batch.num_rows, 5_000):
                part = batch.slice(low, 5_000)
                top = vectors([w.encode("latin-1") for w in part.column(0).to_pylist()])[:, :LEVELS]
                made = top[:, None, :] + change[None, :, :]
                at, move = np.nonzero((made >= 0).all(2))
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_key(made[at, move])), part.column(0).take(take), part.column(1).take(take), pa.array((surplus[move] + 2 * deficit[move]).astype(np.int32))],
                    names=["key", "word", "n", "spent"],
                )

    return run


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether exactly one inserted, deleted or replaced character tells the two apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


class Words:
    """Words of one task in columns: padded letters from the left and from the right, and the END letters at each end as a number."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        width = int(min(WIDE, self.size.max()))
        self.head = np.array([w[:END] for w in words], "S4").view(np.uint32)
        self.tail = np.array([w[-END:] for w in words], "S4").view(np.uint32)
        short = [w if len(w) <= width else b"" for w in words]
        self.long = self.size > width
        self.left = np.array([w.ljust(width, b"\0") for w in short], f"S{width}").view(np.uint8).reshape(-1, width)
        self.right = np.array([w.rjust(width, b"\0") for w in short], f"S{width}").view(np.uint8).reshape(-1, width)


def near(one: Words, i: np.ndarray, other: Words, j: np.ndarray) -> np.ndarray:
    """Which pairs are one edit apart. One edit leaves the first or the last END letters as they are."""
    width = min(one.left.shape[1], other.left.shape[1])
    out = np.zeros(len(i), bool)
    may = np.flatnonzero((one.head[i] == other.head[j]) | (one.tail[i] == other.tail[j]))
    if len(may) < len(i):
        out[may] = near(one, i[may], other, j[may])
        return out
    gap = one.size[i] - other.size[j]
    long = one.long[i] | other.long[j] | (one.size[i] > width) | (other.size[j] > width)
    for k in np.flatnonzero(long & (np.abs(gap) <= 1)).tolist():
        out[k] = one_edit(one.words[i[k]], other.words[j[k]])
    at = np.flatnonzero(~long & (np.abs(gap) <= 1))
    for low in range(0, len(at), 50_000):
        part = at[low : low + 50_000]
        a, b = i[part], j[part]
        differ = one.left[a, :width] != other.left[b, :width]
        from_left = np.where(differ.any(1), differ.argmax(1), width)
        back = one.right[a, -width:] != other.right[b, -width:]
        from_right = np.where(back.any(1), back[:, ::-1].argmax(1), width)
        same = gap[part] == 0
        out[part] = np.where(same, differ.sum(1) == 1, from_left + from_right >= np.minimum(one.size[a], other.size[b]))
    return out


class Trie:
    """The levels below Spark's key, from the sorted paths of the words."""

    def __init__(self, words: list[bytes], n: np.ndarray):
        paths = vectors(words)[:, LEVELS:]
        order = np.lexsort(paths.T[::-1])
        self.words, self.n = Words([words[k] for k in order.tolist()]), n[order]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # count of each node, and where each parent's children begin
        paths = paths[order]
        new = np.zeros(len(paths), bool)
        new[0] = True
        parents = np.array([0, len(paths)])
        for g in range(paths.shape[1]):
            new[1:] |= paths[1:, g] != paths[:-1, g]
            starts = np.flatnonzero(new)
            self.levels.append((paths[starts, g], np.searchsorted(starts, parents)))
            parents = np.append(starts, len(paths))
        self.leaves = parents

    def search(self, counts: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(search, word) of all words whose path is within the budget, in slices of the searches' frontiers."""
        at, node = np.arange(len(counts)), np.zeros(len(counts), np.int64)
        up, down = surplus.astype(bool), deficit.astype(bool)
        for g, (value, first) in enumerate(self.levels):
            width = first[node + 1] - first[node]
            pick = np.repeat(np.arange(len(node)), width)
            child = np.arange(len(pick)) - np.repeat(np.cumsum(width) - width, width) + first[node][pick]
            gap = value[child] - counts[at[pick], g]
            ok = (gap == 0) | ((gap == 1) & ~up[pick]) | ((gap == -1) & ~down[pick])
            pick, child, gap = pick[ok], child[ok], gap[ok]
            at, node, up, down = at[pick], child, up[pick] | (gap == 1), down[pick] | (gap == -1)
        low = 0
        size = self.leaves[node + 1] - self.leaves[node]
        ends = np.cumsum(size)
        while low < len(node):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + 500_000, "right")))
            s = size[low:high]
            word = np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s) + np.repeat(self.leaves[node[low:high]], s)
            yield np.repeat(at[low:high], s), word
            low = high


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each search: how many near words this part of the trie has, and the best of them. Rows come by (key, part), words before searches."""
    now: tuple[int, int] | None = None
    words: list[bytes] = []
    sizes: list[int] = []
    trie: Trie | None = None
    for batch in batches:
        key, part, role = (batch.column(k).to_numpy() for k in range(3))
        edge = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (role[1:] != role[:-1])) + 1
        for low, high in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows], strict=True):
            if now != (key[low], part[low]):
                now, words, sizes, trie = (key[low], part[low]), [], [], None
            texts, n = batch.column(3).slice(low, high - low), batch.column(4).slice(low, high - low).to_numpy()
            if role[low] == 0:
                words += [w.encode("latin-1") for w in texts.to_pylist()]
                sizes += n.tolist()
                continue
            if trie is None:
                trie = Trie(words, np.array(sizes, np.int64))
            spent = batch.column(5).slice(low, high - low).to_numpy()
            for s in range(0, high - low, SEARCHES):
                asked = [w.encode("latin-1") for w in texts.slice(s, SEARCHES).to_pylist()]
                mine = Words(asked)
                found = [np.empty((2, 0), np.int64)]
                for i, j in trie.search(vectors(asked)[:, LEVELS:], spent[s : s + SEARCHES] & 1, spent[s : s + SEARCHES] >> 1):
                    ok = near(mine, i, trie.words, j)
                    found.append(np.stack([i[ok], j[ok]]))
                i, j = np.concatenate(found, axis=1)
                if not len(i):
                    continue
                size = trie.n[j]
                top = np.zeros(len(asked), np.int64)
                np.maximum.at(top, i, size)
                best: dict[int, bytes] = {}
                for a, b in zip(i[tie := size == top[i]].tolist(), j[tie].tolist(), strict=True):
                    if a not in best or trie.words.words[b] < best[a]:
                        best[a] = trie.words.words[b]
                count = np.bincount(i, minlength=len(asked))
                who = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays(
                    [texts.slice(s, SEARCHES).take(pa.array(who)), pa.array(count[who]), pa.array(-top[who]),
                     pa.array([best[k].decode("latin-1") for k in who.tolist()], pa.string())],
                    names=["word", "n_near", "less", "best"],
                )


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best of every word of the stored table (word, n) that has a near word."""
    shape = "key long, word string, n long, spent int"
    stored, asked = words.mapInArrow(_keyed(False), shape), words.mapInArrow(_keyed(True), shape)
    parts = stored.groupBy("key").agg(F.count(F.lit(1)).alias("held")).select("key", F.ceil(F.col("held") / PART_WORDS).cast("int").alias("parts"))
    parts = materialize(parts)
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    stored = stored.join(parts, "key").select("key", own.alias("part"), F.lit(0).alias("role"), "word", "n", "spent")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    asked = asked.join(parts, "key").select("key", every.alias("part"), F.lit(1).alias("role"), "word", "n", "spent")
    rows = stored.unionByName(asked).repartition("key", "part").sortWithinPartitions("key", "part", "role")
    found = rows.mapInArrow(_search, "word string, n_near long, less long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "best")).alias("first")).select(
        "word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.best").alias("best")
    )


def group_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are the runs of letters of all whole texts, A-Z lower-cased, a stated share of them with one letter deleted, of at
    least LEAST characters and TWICE occurrences. A null text has none; rows that repeat a doc_id count each; a null
    doc_id hashes as nothing. `form` is the near word (one edit) of largest n, of ties the first in code-point order, if
    its n is at least TIMES the word's; `root` is where following forms ends. No words give no rows; other columns aren't read.
    """
    words = materialize(words_of(docs, doc_id, text))
    best = near_words(words)
    enough = F.col("best_n") >= TIMES * F.col("n")
    linked = materialize(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n")
    ))
    # n grows TIMES-fold along a chain, so pointers double until all stand at a root after a few rounds
    roots = linked.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        far = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = materialize(roots.join(far, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = new.select("word", "root")
        if new.filter("moved").isEmpty():
            break
    return linked.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
