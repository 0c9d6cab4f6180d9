"""The pipeline against its stages done by brute force."""

import zlib

import numpy as np
import public_tokenizers
from test_exact import want as copies
from test_importance import brute as good
from test_oddsketch import brute as near
from test_secrets import want as secret
from test_tokens import whole
from tokenizers import Tokenizer

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def masked(text):
    out, at = "", 0
    for s, e in sorted((s, e) for s, _, e in secret(text)[1]):
        if s >= at:
            out += text[at:s] + "[secret]"
        at = max(at, e)
    return out + text[at:] if at else text


def test_run_matches_brute_force(spark, texts):
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    left = good(spark, list(texts.items()), labels)
    left = sorted(r[0] for r in copies([(d, texts[d]) for d in left]) if r[3])
    left = sorted(d for d, _, c in near([(d, texts[d]) for d in left], 80) if d == c)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*tokenizer.encode(masked(texts[d]), add_special_tokens=False).ids, 1] for d in left}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(left)
    assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) for r in rows)
    whole([(left.index(r.doc_id), r.start, r.length, r.sequence_id, r.offset) for r in rows], [len(ids[d]) for d in left], 2048)


def test_stages_keep_the_columns_and_take_empty_tables(spark, make):
    docs = make([])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.schema == docs.schema
