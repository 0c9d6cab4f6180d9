"""Streaming ids against the library, and text from ids."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from hardwood.llm import pieces
from hardwood.llm.catalog import query_table

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  a  b\n\nc \xa0 x", " lead", "trail ", "x\x01y z", "日本語 ok 😀", "a" * 3000, "\t\t", "   " * 30, "ab" * 2000 + "ß😀" * 50]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    return pieces.PieceEncoder(PATH, limit=3000, longest=10)


def test_ids_are_the_librarys(encoder, model, texts):
    some = [*texts.values(), *ODD]
    ids, lengths = encoder.encode(some)
    want = [model.encode(t or "") for t in some]
    assert lengths.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    assert [encoder.decode(w) for w in want] == [t or "" for t in some]


def test_ids_of_any_text(encoder, model):
    @settings(max_examples=200, deadline=None)
    @given(st.text(st.sampled_from("aeinrst hTo\n\té😀▁\x01.,0"), max_size=40))
    def check(t):
        assert encoder.encode([t])[0].tolist() == model.encode(t)
        if "▁" not in t:
            assert encoder.decode(model.encode(t)) == t

    check()


@pytest.mark.parametrize("part", [1, 7, 64, 1000])
def test_stream_commits_in_a_bounded_window(encoder, model, part):
    rng = np.random.default_rng(part)
    text = "▁" + "".join(rng.choice(list("abcdefinorst"), 20_000))
    stream, got, most = pieces.StreamingViterbi(encoder.v), [], 0
    for low in range(0, len(text), part):
        got += stream.feed(text[low : low + part])
        most = max(most, stream.held)
    early = len(got)
    assert got + stream.close() == model.encode(text[1:])
    assert early > 5000 and most < 8 * pieces.STEP


def test_query(spark, model, texts):
    rows = {r.doc_id: r for r in query_table()["op8_streaming_pieces"](spark, SF).collect()}
    assert set(rows) == set(texts)
    for d, t in texts.items():
        ids = model.encode(t or "")
        assert (rows[d].n_ids, rows[d].ids_crc32, rows[d].round_trip) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
        assert rows[d].n_commits <= rows[d].n_ids and rows[d].max_window < 8 * pieces.STEP and (rows[d].n_commits > 0) == bool(t)


def test_windows_of_texts(encoder):
    long = "".join(np.random.default_rng(1).choice(list("abcdefinorst"), 20_000))
    texts = ["", "two words", long, None, "three\nmore  words", long + " end"]
    ids, lengths = encoder.encode(texts)
    commits, peak = encoder.windows()
    assert commits[[0, 1, 3]].tolist() == [0, 2, 0] and peak[[0, 1, 3]].tolist() == [0, 6, 0]
    assert commits[2] > 50 and commits[5] == commits[2] + 1 and 128 <= peak[2] == peak[5] < 8 * pieces.STEP
    assert encoder.texts(ids, lengths) == [t or "" for t in texts]


def test_small_tables_round_trip(make):
    docs = make([*enumerate(ODD), (3, ODD[3]), (None, "no id")], "doc_id long, text string, ids string, n_ids int")
    back = pieces.decode(pieces.encode(docs, PATH), PATH)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)
    assert pieces.digest(docs, PATH).filter("NOT round_trip").count() == 0
    assert pieces.encode(make([]), PATH).count() == 0 and pieces.digest(make([]), PATH).count() == 0
