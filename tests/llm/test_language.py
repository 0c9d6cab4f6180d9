"""String kernels against sets of character n-grams, and held-out accuracy."""

import zlib

import numpy as np

from hardwood.llm import language
from hardwood.llm.catalog import query_table


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = query_table()["op2_kernel_language"](spark, sf)
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and {r.lang_pred for r in rows} <= {r.lang for r in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    test = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in test) >= 0.99 * len(test) and len(test) > 100


def grams(text):
    t = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    return {t[i : i + n] for n in range(1, language.LONGEST + 1) for i in range(len(t) - n + 1)}


def test_presence_counts_distinct_grams():
    texts = ["Hello, world", "hello hello 123", "", None, "12 34", "ñandú İ ß", "a"]
    bits, letter = language.presence(texts)
    sizes = [len(grams(t)) if t else 0 for t in texts]
    assert bits.sum(1).tolist() == sizes  # no two of these few grams meet in a bucket
    shared = len(grams(texts[0]) & grams(texts[1]))
    assert int((bits[0] & bits[1]).sum()) == shared
    assert letter.tolist() == [True, True, False, False, False, True, True]


def test_folded_weights_are_the_kernel_expansion():
    """Scores of the folded weights equal kernel values with the landmarks times the dual weights."""
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcde " if i % 2 else "vwxyz "), 60)) for i in range(60)]
    langs = ["odd" if i % 2 else "even" for i in range(60)]
    bits, _ = language.presence(texts)
    classes, weights = language.fit(np.packbits(bits, axis=1), langs, landmarks=10)
    assert classes == ["even", "odd"]
    x = bits / np.sqrt(bits.sum(1, keepdims=True))
    order = [*range(0, 20, 2), *range(1, 20, 2)]
    kernel = np.array([[len(grams(a) & grams(texts[m])) / np.sqrt(len(grams(a)) * len(grams(texts[m]))) for m in order] for a in texts])
    assert np.allclose(kernel, x @ x[order].T, atol=0.02)
    k, k_mm, y = kernel, kernel[order], np.where(np.array(langs)[:, None] == np.array(classes), 1.0, -1.0)
    a = np.linalg.solve(k.T @ k / 30 + language.RIDGE * k_mm / 2 + 1e-6 * np.eye(20), k.T @ y / 30)
    assert np.allclose(x @ weights, k @ a, atol=0.1)
    assert ((x @ weights).argmax(1) == [i % 2 for i in range(60)]).all()


def test_odd_tables(make):
    assert language.identify(make([])).count() == 0
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !?", None), (None, "the river", "en"), (4, "the river", None), (4, "the river", "en"),
            (5, "der Fluss", "de"), (6, "über " * 30_000, "de")]
    docs = make(rows, "doc_id long, text string, lang string, score string, held_out int, grams int")
    got = language.identify(docs).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got if r.doc_id in (1, 2, 3)) == [(1, "und"), (2, "und"), (3, "und")]
    assert len(got) == 8 and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 4}) == 1
    assert {r.lang_pred for r in language.identify(make([(1, "abc"), (2, "d")])).collect()} == {"und"}
