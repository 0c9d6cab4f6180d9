"""Near duplicates: MinHash bands find candidates, odd sketches discard the unlike ones, full sets decide.

A document's MinHash samples (place, minimum) are folded into a parity bitmap, an odd sketch. The XOR of two bitmaps is
the sketch of the samples that differ, so its population count estimates a high similarity precisely; only pairs that it
doesn't rule out (by six standard deviations) have their shingle sets compared.

Groups of any size stay cheap, and no step gives a row for each pair of a group. Texts with equal sets are one
representative. In each bucket of a band the members are compared with the smallest one. Where a bucket still has several
components, a spanning forest of its near sketches is taken, which gathers everything that could be linked; such a
gathering is then compared in pairs of bounded blocks, each of which gives back a spanning forest of its links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hardwood.llm.exact import in_table, slot_table, table_bits, without_ids
from hardwood.llm.text import WordHashes, mix, slices, split_words, windows
from hardwood.session import materialize

SHINGLE, BANDS, ROWS, SKETCH_BITS = 5, 32, 5, 512
SAMPLES = BANDS * ROWS
#: Members of a block, and shingles of a block, about; two blocks meet in a task at once.
BLOCK, BLOCK_SHINGLES = 512, 500_000

_SEEDS = mix(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64))
_MUL, _ADD = (_SEEDS[:SAMPLES] | np.uint64(1)).astype(np.uint32), _SEEDS[SAMPLES:].astype(np.uint32)
_WORDS = SKETCH_BITS // 64
SIGNATURE = "doc_id long, h long, n_shingles long, d1 long, d2 long, sketch array<long>, bands array<long>"


def missed(similarity: float) -> float:
    """Probability that no band of a pair of that similarity agrees."""
    return (1 - similarity**ROWS) ** BANDS


def most_apart(percent: int) -> int:
    """Largest XOR count kept: the mean at the threshold and six standard deviations (samples that differ, and bits that meet)."""
    differ = SAMPLES * (1 - percent / 100)
    keep = (1 - 2 / SKETCH_BITS) ** (2 * differ)
    mean = SKETCH_BITS * (1 - keep) / 2
    deviation = math.hypot(2 * keep * math.sqrt(differ * percent / 100), (2 * differ) / math.sqrt(2 * SKETCH_BITS))
    return math.ceil(mean + 6 * deviation)


def shingle_sets(texts: list[str | None], hashes: WordHashes) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: five words, or all words of a shorter text as one; none without words."""
    words = [split_words(t, lower=True) for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    flat = hashes.of([x for w in words for x in w])
    found, first = windows(flat, counts, SHINGLE)
    starts = np.cumsum(counts) - counts
    cut = np.searchsorted(first, np.append(starts, len(flat)))
    out = []
    for i, n in enumerate(counts.tolist()):
        if n >= SHINGLE:
            out.append(np.unique(found[cut[i] : cut[i + 1]]))
        elif n:
            h = np.array([n], np.uint64)
            for j in range(n):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + flat[starts[i] + j])
            out.append(h)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Odd sketch (uint64 words) and band keys of each non-empty set."""
    sizes = np.array([len(s) for s in sets])
    low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    least = np.empty((SAMPLES, len(sets)), np.uint32)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sets):  # as many sets at once as stay in the processor's cache
        start = int(ends[at] - sizes[at])
        to = max(at + 1, int(np.searchsorted(ends, start + 32_768, "right")))
        part, cuts = low[start : ends[to - 1]], ends[at:to] - sizes[at:to] - start
        for j in range(SAMPLES):
            least[j, at:to] = np.minimum.reduceat(part * _MUL[j] + _ADD[j], cuts)
        at = to
    tagged = mix(least.astype(np.uint64) | np.arange(SAMPLES, dtype=np.uint64)[:, None] << np.uint64(32))
    place = (tagged >> np.uint64(40)).astype(np.int64) % SKETCH_BITS + np.arange(len(sets)) * SKETCH_BITS
    parity = (np.bincount(place.ravel(), minlength=len(sets) * SKETCH_BITS) & 1).astype(np.uint8)
    sketch = np.packbits(parity.reshape(len(sets), SKETCH_BITS), axis=1, bitorder="little").view(np.uint64)
    bands = np.zeros((BANDS, len(sets)), np.uint64)
    for r in range(ROWS):
        bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + tagged[r * BANDS : (r + 1) * BANDS])
    return sketch, bands.T.copy()


def _lists(x: np.ndarray, has: np.ndarray) -> pa.Array:
    """A list of int64 for each row of `has`; empty where it is false."""
    width = x.shape[1] if x.ndim == 2 else 0
    ends = np.concatenate([[0], np.cumsum(np.where(has, width, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(x).view(np.int64).ravel()))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        names = batch.column(0)
        for low, high, texts in slices(batch.column(2)):
            sets = shingle_sets(texts, hashes)
            has = np.array([len(s) > 0 for s in sets])
            full = [s for s in sets if len(s)]
            sketch, bands = signatures_of(full) if full else (np.zeros((0, _WORDS), np.uint64), np.zeros((0, BANDS), np.uint64))
            digest = np.array([[mix(s).sum(), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()] for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [names.slice(low, high - low), batch.column(1).slice(low, high - low), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]),
                 _lists(sketch, has), _lists(bands, has)],
                names=["doc_id", "h", "n_shingles", "d1", "d2", "sketch", "bands"],
            )


def _set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle set of each text."""
    hashes = WordHashes()
    for batch in batches:
        for low, high, texts in slices(batch.column(1)):
            sets = shingle_sets(texts, hashes)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, high - low), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))], names=["rep", "shingles"]
            )


def _alike(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    if len(one) > len(other):
        one, other = other, one
    if 100 * len(one) < percent * len(other):
        return False
    both = int((other[np.minimum(np.searchsorted(other, one), len(other) - 1)] == one).sum())
    return 100 * both >= percent * (len(one) + len(other) - both)


def _lists_of(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    ends = np.cumsum(np.asarray(pc.list_value_length(column)))
    return np.split(flat, ends[:-1])


def _verifier(percent: int):
    """Those of the pairs (a, b, sa, sb) whose sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                ok = [_alike(np.sort(x), np.sort(y), percent) for x, y in zip(_lists_of(part.column(2)), _lists_of(part.column(3)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _near(sketch: np.ndarray, most: int) -> np.ndarray:
    """Which pairs of sketches are within `most` bits."""
    out = np.empty((len(sketch), len(sketch)), bool)
    for low in range(0, len(sketch), 64):
        out[low : low + 64] = np.bitwise_count(sketch[low : low + 64, None, :] ^ sketch[None, :, :]).sum(2, dtype=np.int32) <= most
    return out


def _near_forest(rep: np.ndarray, comp: np.ndarray, own: np.ndarray, sketch: np.ndarray, sets: list | None, most: int) -> list[tuple[int, int]]:
    """Pairs of near sketches that, with the components, connect all that near pairs connect."""
    near = _near(sketch, most)
    near |= comp[:, None] == comp[None, :]
    left, out = np.ones(len(rep), bool), []
    for first in range(len(rep)):
        if not left[first]:
            continue
        left[first] = False
        front = np.array([first])
        while len(front):
            reach = near[front] & left
            found = np.flatnonzero(reach.any(0))
            parent = front[reach[:, found].argmax(0)]
            out += [(int(rep[i]), int(rep[j])) for i, j in zip(parent, found, strict=True) if comp[i] != comp[j]]
            left[found] = False
            front = found
    return out


def _links(rep: np.ndarray, comp: np.ndarray, own: np.ndarray, sketch: np.ndarray, sets: list | None, most: int, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links that the components don't have yet. Pairs of one block count where the block is alone."""
    near = _near(sketch, most) & (comp[:, None] != comp[None, :])
    if (own != own[0]).any():
        near &= own[:, None] != own[None, :]
    i, j = np.nonzero(np.triu(near, 1))
    up = {int(c): int(c) for c in comp}

    def top(c: int) -> int:
        while up[c] != c:
            up[c] = c = up[up[c]]
        return c

    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = top(int(comp[x])), top(int(comp[y]))
        if a != b and _alike(sets[x], sets[y], percent):
            up[max(a, b)] = min(a, b)
            out.append((int(rep[x]), int(rep[y])))
    return out


def _by_group(work, with_sets: bool):
    """Runs `work` on each run of rows with equal (key, lo, hi); a run has at most two blocks. Columns: key, lo, hi, own, rep, comp, sketch[, shingles]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sketch, sets = np.empty((0, 6), np.int64), np.empty((0, _WORDS), np.uint64), []

        def done(cut: int) -> pa.RecordBatch:
            new = np.concatenate([[True], (rows[1:cut, :3] != rows[: cut - 1, :3]).any(1)])
            cuts = np.append(np.flatnonzero(new), cut)
            pairs = []
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                held = [np.sort(x) for x in sets[s:e]] if with_sets else None
                pairs += work(rows[s:e, 4], rows[s:e, 5], rows[s:e, 3], sketch[s:e], held)
            return pa.RecordBatch.from_arrays([pa.array([min(p) for p in pairs], pa.int64()), pa.array([max(p) for p in pairs], pa.int64())], names=["a", "b"])

        for batch in batches:
            for low in range(0, batch.num_rows, 2 * BLOCK):
                part = batch.slice(low, 2 * BLOCK)
                rows = np.concatenate([rows, np.column_stack([part.column(i).to_numpy(zero_copy_only=False) for i in range(6)]).astype(np.int64)])
                sketch = np.concatenate([sketch, part.column(6).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, _WORDS)])
                if with_sets:
                    sets += _lists_of(part.column(7))
                same = (rows[:, :3] == rows[-1, :3]).all(1)
                cut = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
                if cut:
                    yield done(cut)
                    rows, sketch, sets = rows[cut:].copy(), sketch[cut:].copy(), sets[cut:]
        if len(rows):
            yield done(len(rows))

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) of every node of the stored edges (a, b). Rounds of neighbour minima and pointer jumps, each stored.

    Labels are stored before each join, so both sides of it are plain shuffles and Spark can split the rows of a hub.
    """
    both = edges.select("a", "b").union(edges.select("b", "a"))
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("least"))
        hooked = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "least").alias("up"))
        parent = hooked.select(F.col("node").alias("up"), F.col("up").alias("comp"))
        new = materialize(hooked.join(parent, "up").select("node", "comp", (F.col("old") != F.col("comp")).alias("moved")))
        labels = new.select("node", "comp")
        if new.filter("moved").isEmpty():
            return labels


def forest_roots(edges: DataFrame) -> DataFrame:
    """node, comp of the stored edges (a, b) where a < b and no b has two: pointers to the parents double until they stand at roots."""
    labels = edges.select(F.col("b").alias("node"), F.col("a").alias("comp"))
    while True:
        far = labels.select(F.col("node").alias("parent"), F.col("comp").alias("next"))
        step = labels.join(far, F.col("comp") == F.col("parent"), "left")
        new = materialize(step.select("node", F.coalesce("next", "comp").alias("comp"), F.col("next").isNotNull().alias("moved")))
        labels = new.select("node", "comp")
        if new.filter("moved").isEmpty():
            return labels.union(labels.select(F.col("comp").alias("node"), "comp").distinct())


def merged(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """The components `comps` (node, comp) with those that the new edges connect; only edges between components are worked on."""
    of = lambda x: comps.select(F.col("node").alias(x), F.col("comp").alias(f"{x}_comp"))
    apart = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("x"), F.coalesce("b_comp", "b").alias("y"))
    apart = materialize(apart.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if apart.isEmpty():
        return comps
    top = components(apart).select(F.col("node").alias("old"), F.col("comp").alias("new"))
    known = comps.join(top, F.col("comp") == F.col("old"), "left").select("node", F.coalesce("new", "comp").alias("comp"))
    fresh = top.join(comps.select(F.col("node").alias("old")), "old", "left_anti").select(F.col("old").alias("node"), F.col("new").alias("comp"))
    return materialize(known.union(fresh))


def _apart(a: str, b: str):
    """XOR population count of two sketches, in generated code."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(_WORDS)])


def near_duplicates(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * intersection >= percent * union of their shingle sets (words
    `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased). A text without words (null too) has no shingles and no link. component_id is
    the smallest doc_id reachable; kept says that it is the row's own. A row without a doc_id has no link either, a null
    component_id, and is kept. Rows that repeat a doc_id share its component. No rows give no rows. A link at the
    threshold is missed with probability `missed(percent / 100)`, under 1e-8 at 85 and 4e-6 at 80.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    signed = materialize(rows.mapInArrow(_sign, SIGNATURE))
    able = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # a node is a set of shingles; its first row, by doc_id and text, is where the set is taken from again
    nodes = able.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "h")).alias("first"), *[F.first(c).alias(c) for c in ("n_shingles", "sketch", "bands")])
    nodes = materialize(nodes.select("d1", "d2", "first.doc_id", "first.h", "n_shingles", "sketch", "bands", F.monotonically_increasing_id().alias("rep")))
    reps = nodes.select("rep", "n_shingles", "sketch")

    spread = nodes.select("rep", F.explode("bands").alias("key"))
    leaders = materialize(spread.groupBy("key").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = materialize(spread.join(leaders.select("key", "leader"), "key"))
    ids = materialize(nodes.select("rep", F.col("doc_id").alias("id"), F.col("h").alias("id_h")).join(members.select("rep").distinct(), "rep", "left_semi"))
    bits = table_bits(ids.count())
    table = materialize(slot_table(ids, "id", bits, meet=1))
    held = rows.filter(F.col("doc_id").isNotNull() & in_table(table, F.col("doc_id"), bits))
    held = held.join(ids, (F.col("doc_id") == F.col("id")) & (F.col("h") == F.col("id_h"))).dropDuplicates(["doc_id", "h"]).select("rep", "text")
    sets = materialize(held.mapInArrow(_set, "rep long, shingles array<long>"))
    sketches, most = reps.select("rep", "sketch"), most_apart(percent)

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose sets are alike."""
        near = pairs.join(sketches.toDF("a", "ka"), "a").join(sketches.toDF("b", "kb"), "b").filter(_apart("ka", "kb") <= most)
        near = near.select("a", "b").join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
        return near.mapInArrow(_verifier(percent), "a long, b long")

    # a member meets one leader a round: the one it shares most bands with that its component doesn't have yet
    votes = materialize(members.filter("rep <> leader").groupBy("rep", "leader").agg(F.count(F.lit(1)).alias("votes")))
    best = F.max_by("leader", F.struct("votes", -F.col("leader"))).alias("a")
    asked = materialize(votes.groupBy(F.col("rep").alias("b")).agg(best).select("a", "b"))
    comps = materialize(forest_roots(materialize(linked(asked))))
    whole = lambda node: comps.select(F.col("node").alias(node), F.col("comp").alias(f"{node}_comp"))
    left = votes.join(asked.toDF("gone", "rep"), "rep").filter("leader <> gone").join(whole("rep"), "rep", "left").join(whole("leader"), "leader", "left")
    left = left.filter("coalesce(rep_comp, rep) <> coalesce(leader_comp, leader)")
    comps = merged(comps, materialize(linked(left.groupBy(F.col("rep").alias("b")).agg(best).select("a", "b"))))

    def blocks(grouped: DataFrame, sizes: DataFrame) -> DataFrame:
        """(key, rep, ...) with the blocks of its key; a row for each pair of blocks that its block is in."""
        held = grouped.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return held.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))

    now = members.select("key", "rep").join(comps, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"))
    open_ = now.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("last"), F.count(F.lit(1)).alias("n"))
    open_ = materialize(open_.filter("least < last").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    met = blocks(now, open_).join(sketches, "rep").select("key", "lo", "hi", "own", "rep", "comp", "sketch")
    met = met.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    work = partial(_near_forest, most=most)
    forest = materialize(met.mapInArrow(_by_group(work, False), "a long, b long").distinct())
    if not forest.isEmpty():
        gathered = merged(comps, forest).toDF("rep", "key")
        asked = gathered.join(forest.select(F.explode(F.array("a", "b")).alias("x")).distinct().join(gathered.toDF("x", "k"), "x").select(F.col("k").alias("key")).distinct(), "key", "left_semi")
        asked = asked.join(comps, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"))
        asked = materialize(asked.join(reps.select("rep", "sketch", "n_shingles"), "rep"))
        sizes = asked.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("all"))
        sizes = sizes.select("key", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("all") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
        met = blocks(asked, sizes).join(sets, "rep").select("key", "lo", "hi", "own", "rep", "comp", "sketch", "shingles")
        met = met.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
        work = partial(_links, most=most, percent=percent)
        links = materialize(met.mapInArrow(_by_group(work, True), "a long, b long"))
        comps = merged(comps, links)
    twice = able.groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("low"), F.max(F.struct("d1", "d2")).alias("high")).filter("low <> high")
    twice = materialize(twice.select(F.col("doc_id").alias("id"), "low"))
    if not twice.isEmpty():  # texts of one doc_id share its component
        at = nodes.select("d1", "d2", "rep")
        pairs = able.join(twice, F.col("doc_id") == F.col("id")).select("d1", "d2", F.col("low.d1").alias("l1"), F.col("low.d2").alias("l2")).distinct()
        pairs = pairs.join(at.withColumnRenamed("rep", "a"), ["d1", "d2"]).join(at.toDF("l1", "l2", "b"), ["l1", "l2"]).filter("a <> b")
        comps = merged(comps, materialize(pairs.select("a", "b").distinct()))
    placed = nodes.select("d1", "d2", "rep", "doc_id").join(comps, F.col("rep") == F.col("node"), "left")
    placed = materialize(placed.select("d1", "d2", "doc_id", F.coalesce("comp", "rep").alias("comp")))
    least = placed.groupBy("comp").agg(F.min("doc_id").alias("component"))
    labels = materialize(placed.join(least, "comp").select("d1", "d2", "component"))
    named = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("d1")).alias("d1"), "d2").join(labels, ["d1", "d2"], "left")
    return named.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one document of each component, that of the smallest doc_id; all columns as they were."""
    gone = near_duplicates(docs, percent, doc_id, text).filter("NOT kept").select("doc_id")
    return without_ids(docs, materialize(gone), doc_id)
