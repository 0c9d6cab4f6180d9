"""Repeated strings against a dictionary of all of them."""

import hashlib
import random

import numpy as np

from hardwood.llm import suffixes
from hardwood.llm.catalog import query_table

SF = "/root/testdata/sf0.001"
L = suffixes.LENGTH


def want(rows):
    """Rows of the operator, with the digest of what stays."""
    key = lambda d: (d is None, d or 0)
    texts = [(d, (t or "").encode()) for d, t in rows]
    first: dict[bytes, tuple] = {}
    for d, t in texts:
        for i in range(len(t) - L + 1):
            s = t[i : i + L]
            if s not in first or key(d) < first[s]:
                first[s] = key(d)
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - L + 1):
            if first[t[i : i + L]] < key(d):
                gone[i : i + L] = b"\1" * L
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_cover_has_every_difference():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))
    assert suffixes.SAMPLE + suffixes.PERIOD - 1 == L


def test_query_matches_brute_force(spark, texts):
    assert got(query_table()["op13_suffix_blocks"](spark, SF)) == want(list(texts.items()))


def odd_rows():
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, edge, short = word(300), word(L), word(L - 1)
    rows = [(3, passage), (1, "x" + passage[:200] + "y"), (2, word(40) + passage[100:] + word(31)), (9, edge), (8, word(7) + edge + word(9)), (12, short), (11, short + "q"),
            (None, passage), (None, passage), (4, None), (5, ""), (6, "é日" * 60), (7, "z" + "é日" * 60), (3, passage + "!"), (20, "-" * 500), (21, "-" * 70 + word(20) + "-" * 49)]
    rows += [(100 + i, word(i % 13) + passage[i : i + 60 + i] + word(i % 7)) for i in range(60)]
    rows += [(-i, word(100) + passage + word(100)) for i in range(1, 4)]
    return rows


def test_odd_texts(make):
    rows = odd_rows()
    docs = make(rows, "doc_id long, text string, pack long, bucket int, ids string, runs string")
    assert got(suffixes.digest(docs)) == want(rows)
    kept = sorted(((r[0], *r[1:4], hashlib.sha256(r.kept).hexdigest()) for r in suffixes.remove_repeats(docs).collect()), key=str)
    assert kept == want(rows)
    assert suffixes.digest(make([])).count() == 0


def test_many_windows_and_buckets(monkeypatch):
    """The tasks' functions one after another, with small packs, windows and buckets."""
    import pyarrow as pa

    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():  # noqa: N802
            return 0

    monkeypatch.setattr(suffixes, "TaskContext", Task)
    for name, v in (("PACK", 600), ("WINDOW", 250)):
        monkeypatch.setattr(suffixes, name, v)
    rows, buckets = odd_rows(), 17
    docs = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], names=["doc_id", "text"])

    def ordered(batches, names):
        t = pa.Table.from_batches([b for b in batches if b.num_rows])
        return t.sort_by("bucket").select(names).to_batches(max_chunksize=7)

    def replied(packs, replies, pick):
        said = {}
        for r in replies:
            said.setdefault(r["pack"], []).append(pick(r))
        out = packs.to_pylist()
        return [pa.RecordBatch.from_pylist([p | {"replies": said.get(p["pack"], [])}]) for p in out]

    packs = pa.Table.from_batches(list(suffixes._pack_rows([docs])))
    sample = ordered(suffixes._sample(buckets)(packs.to_batches()), ["bucket", "pack", "win", "n", "keys"])
    ranked = pa.Table.from_batches(list(suffixes._rank_sample(sample))).to_pylist()
    asked = replied(packs, ranked, lambda r: {k: r[k] for k in ("win", "bucket", "bits")})
    tied = ordered(suffixes._tied(buckets)(asked), ["bucket", "pack", "n", "place", "strings"])
    found = pa.Table.from_batches(list(suffixes._sort_bucket(tied))).to_pylist()
    result = pa.Table.from_batches(list(suffixes._removed(True)(replied(packs, found, lambda r: r["runs"])))).to_pylist()
    assert packs.num_rows > 10 and sorted((tuple(r.values()) for r in result), key=str) == want(rows)


def test_equal_fingerprints_of_different_strings(monkeypatch):
    data = np.frombuffer(b"a" * 60 + b"b" * 60 + bytes(8), np.uint8)
    words, at, key = suffixes.words_at(data), np.array([0, 5, 60, 65]), np.array([4, 3, 2, 1])
    assert suffixes.smallest(words, at, key).tolist() == [3, 3, 1, 1]
    monkeypatch.setattr(suffixes, "prints", lambda words, at, size: np.zeros(len(at), np.uint64))
    assert suffixes.smallest(words, at, key).tolist() == [3, 3, 1, 1]
