"""Cached encoding, wavelet files and packing against the library and brute force."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hardwood.llm import packing, wavelet
from hardwood.llm.catalog import query_table
from hardwood.llm.tokens import CachedEncoder, cut_dropping_spaces, cut_keeping_spaces
from hardwood.session import scratch_folder

SF = "/root/testdata/sf0.001"
PATHS = {"word_bpe_49k.json": cut_dropping_spaces, "byte_bpe_50k.json": cut_keeping_spaces}
ODD = ["", " ", "a  b", " \n\n x \t y ", "don't  stop  now", "a\x1c b\x01 c", "<|endoftext|> x<|startoftext|>", "é é   ü",
       "12 345  6", "\r\n a\n b", "x" * 5000, "日本語 テキスト。 ok", "a\0b \0 c 's", "'s 't", "a\u0085 b", "Ünï ŞİK ΣΑΣ"]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def plain():
    out = {}
    for name in PATHS:
        out[name] = Tokenizer.from_file(public_tokenizers.path(name))
        out[name].encode_special_tokens = True
    return out


@pytest.mark.parametrize("name", PATHS)
def test_cached_ids_are_the_librarys(plain, texts, name):
    encoder = CachedEncoder(public_tokenizers.path(name), PATHS[name], limit=2000, longest=12)
    some = [*texts.values(), *ODD, None]
    for _ in range(2):
        ids, lengths = encoder.encode(some, 1)
        want = [[*plain[name].encode(t or "", add_special_tokens=False).ids, 1] for t in some]
        assert lengths.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("name", PATHS)
def test_cached_ids_of_any_text(plain, name):
    encoder = CachedEncoder(public_tokenizers.path(name), PATHS[name])

    @settings(max_examples=150, deadline=None)
    @given(st.text(st.sampled_from("ab'sS1 \n\t\r\x1c\x1f  é́!<|日"), max_size=30) | st.text(st.sampled_from("a \n's!\0"), max_size=9))
    def check(t):
        assert encoder.encode([t])[0].tolist() == plain[name].encode(t, add_special_tokens=False).ids

    check()


@pytest.mark.parametrize("n,top", [(0, 2), (1, 1), (700, 2), (5000, 49_408), (1500, 70_000)])
def test_wavelet_file(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n).astype(np.uint32) // np.uint32(1 + top // 50)
    held = wavelet.WaveletFile(wavelet.build(ids, np.array([3, 9], np.int64), np.array([n // 2, n - n // 2], np.int64)))
    assert held.ids().tolist() == ids.tolist() and held.doc_ids().tolist() == [3, 9] and held.lengths().sum() == n
    for i in rng.integers(0, max(n, 1), 40 if n else 0).tolist():
        assert held.access(i) == ids[i]
    for token in np.unique(ids)[:8].tolist() + [top + 5]:
        low, high = n // 5, n - n // 7
        assert held.count(token, low, high) == int((ids[low:high] == token).sum())
        assert held.occurrences(token, low, high) == (np.flatnonzero(ids[low:high] == token) + low).tolist()


def test_wavelet_query(spark, plain, texts):
    rows = query_table()["op3_wavelet_tokens"](spark, SF).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == sorted(texts)
    start = 0
    for r in rows:
        ids = [*plain["word_bpe_49k.json"].encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_wavelet_small_tables(spark, make):
    path = public_tokenizers.path("word_bpe_49k.json")
    for rows in ([], [(7, None), (2, ""), (2, "same"), (2, "same"), (None, "no id"), (1, "b " * 30_000)]):
        base = scratch_folder(spark, "tokens")
        docs = make(rows, "doc_id long, text string, start string, shard string")
        if not rows:
            assert wavelet.write_shards(docs, path, base).count() == 0
            continue
        got = wavelet.read_documents(spark, base, wavelet.write_shards(docs, path, base, shard_tokens=1000)).orderBy("start").collect()
        assert [r.doc_id for r in got] == [1, 2, 2, 2, 7] and [r.n_tokens for r in got] == [30_001, 1, 2, 2, 1]


def whole(pieces, lengths, capacity):
    """Each id in one piece, sequences gapless from 0, full or of a power of two."""
    by_doc, by_seq = {}, {}
    for d, s, n, q, o in pieces:
        by_doc.setdefault(d, []).append((s, n))
        by_seq.setdefault(q, []).append((o, n))
    assert sorted(by_doc) == [d for d, n in enumerate(lengths) if n]
    for found, total in [(v, lengths[d]) for d, v in by_doc.items()] + [(v, None) for v in by_seq.values()]:
        at = 0
        for s, n in sorted(found):
            assert s == at and n > 0
            at += n
        assert at == total if total is not None else at <= capacity and at & (at - 1) == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 900), min_size=1, max_size=60))
def test_packing_is_whole(lengths):
    whole(packing.pack(np.array(lengths), 256), lengths, 256)


def test_packing_takes_the_cheapest_sequence_with_room():
    pieces = packing.pack(np.array([60, 50, 40, 30, 20, 56]), 128)
    # two sequences of 128: 60 and 56 open them, 50 joins the cheaper one, and so on
    assert [(n, q) for _, _, n, q, _ in pieces[:3]] == [(60, 0), (56, 1), (50, 1)]


def test_packing_query(spark, plain, texts):
    rows = query_table()["op5_cost_packing"](spark, SF).collect()
    ids = {d: [*plain["byte_bpe_50k.json"].encode(t or "", add_special_tokens=False).ids, 1] for d, t in texts.items()}
    assert all(r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id]) for r in rows)
    names = sorted(ids)
    whole([(names.index(r.doc_id), r.start, r.length, r.sequence_id, r.offset) for r in rows], [len(ids[d]) for d in names], 2048)


def test_packing_small_tables(make):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.pack_documents(make([]), path).count() == 0
    got = packing.pack_documents(make([(1, None), (1, None), (2, "x y " * 9000), (None, "z")], "doc_id long, text string, length string"), path)
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in got.filter("start = 0").collect()) == [(0, 2), (1, 1), (1, 1), (2, 18_002)]
