"""Language identification by string kernels: blended-spectrum presence kernels, Nystrom landmarks, ridge regression.

k(x, y) = |grams(x) and grams(y)| / sqrt(|grams(x)| |grams(y)|) over all character n-grams of 1 to LONGEST characters. Landmarks
stand for the whole training set: with K_mm between landmarks and K_nm to the training texts, the ridge weights of one
class against the rest solve (K_nm' K_nm + ridge K_mm) a = K_nm' y. A kernel value with a landmark is a product of presence vectors, so
a batch is scored by one matrix product with the landmarks' presence matrix times a, both folded once after the fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hardwood.llm.text import slices

LONGEST, GRAM_BITS = 4, 17
GRAMS = 1 << GRAM_BITS
#: Most training texts of a language, landmarks of a language, and ridge.
TRAIN, LANDMARKS, RIDGE = 400, 60, 1e-2
#: Texts scored by one product, and bytes of them.
ROWS, BYTES = 32, 300_000

_SIGNS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Code point -> itself for a letter, else a space."""
    global _SIGNS
    if _SIGNS is None:
        points = np.arange(0x110000, dtype=np.uint32)
        _SIGNS = np.where(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000), points, 32).astype(np.uint32)
    return _SIGNS


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Which hashed grams each text has (bool matrix), and which texts have a letter. Lower case; other signs are spaces."""
    held = [(" " + t.lower() + " ") if t else "" for t in texts]
    sizes = np.array([len(t) for t in held], np.int64)
    out = np.zeros((len(texts), GRAMS), bool)
    points = _letters()[np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)]
    row = np.repeat(np.arange(len(texts)), sizes)
    letter = np.bincount(row[points != 32], minlength=len(texts)) > 0
    flat, h = out.reshape(-1), np.zeros(len(points), np.uint32)
    base = row * GRAMS
    with np.errstate(over="ignore"):
        for n in range(LONGEST):
            size = len(points) - n
            if size <= 0:
                break
            h = h[:size] * np.uint32(0x01000193) + points[n:] * np.uint32(0x9E3779B1) + np.uint32(n + 1)
            at = (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - GRAM_BITS)
            keep = row[:size] == row[n:]
            flat[(base[:size] + at)[keep]] = True
    return out, letter


def _indices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The grams of each training text, as bits."""
    for batch in batches:
        for low, high, texts in slices(batch.column(1), BYTES):
            for s in range(0, len(texts), ROWS):
                bits, _ = presence(texts[s : s + ROWS])
                packed = [x.tobytes() for x in np.packbits(bits, axis=1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low + s, len(packed)), pa.array(packed, pa.binary())], names=["lang", "grams"])


#: Bytes of packed grams of a text that are unpacked at once during the fit.
_PART = 512


def fit(packed: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """Classes, and the folded weights: a row per gram, a column per class. `packed` has the grams of each text as bits."""
    classes = sorted(set(langs))
    own = np.array([classes.index(x) for x in langs])
    order = np.concatenate([np.flatnonzero(own == c)[:landmarks] for c in range(len(classes))])
    sizes, shared = np.zeros(len(own)), np.zeros((len(own), len(order)))
    for low in range(0, packed.shape[1], _PART):
        x = np.unpackbits(packed[:, low : low + _PART], axis=1).astype(np.float32)
        sizes += x.sum(1)
        shared += x @ x[order].T
    norm = np.sqrt(np.maximum(sizes, 1))
    k_nm = shared / norm[:, None] / norm[order]
    k_mm = k_nm[order]
    y = np.where(own[:, None] == np.arange(len(classes)), 1.0, -1.0)
    weight = 1.0 / np.bincount(own, minlength=len(classes))[own]  # each class counts the same
    left = (k_nm * weight[:, None]).T @ k_nm + ridge * k_mm / len(classes)
    right = (k_nm * weight[:, None]).T @ y
    a = np.linalg.solve(left + 1e-6 * np.eye(len(left)), right) / norm[order][:, None]
    parts = [np.unpackbits(packed[order, low : low + _PART], axis=1).T.astype(np.float32) @ a for low in range(0, packed.shape[1], _PART)]
    return classes, np.concatenate(parts).astype(np.float32)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = TRAIN) -> tuple[list[str], np.ndarray]:
    """Fit on at most `per_language` texts of each language (about; smallest hashes) among the rows that aren't held out."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id)))
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.col(doc_id).alias("doc_id"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return [], np.zeros((GRAMS, 0), np.float32)
    place = F.xxhash64("doc_id", F.lit("language"))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, per_language / n))) for k, n in sizes.items()])
    some = rows.filter((F.pmod(place, F.lit(1 << 30)) / float(1 << 30)) < share)
    some = some.orderBy(place, "doc_id").limit(per_language * 2 * len(sizes))
    found = some.select("lang", "text").mapInArrow(_indices, "lang string, grams binary").collect()
    if not found:
        return [], np.zeros((GRAMS, 0), np.float32)
    return fit(np.stack([np.frombuffer(r.grams, np.uint8) for r in found]), [r.lang for r in found])


def held_out(doc_id):
    """crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def _scorer(classes: list[str], weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*classes, "und"], object)
        for batch in batches:
            for low, high, texts in slices(batch.column(2), BYTES):
                for s in range(0, len(texts), ROWS):
                    bits, letter = presence(texts[s : s + ROWS])
                    at = np.flatnonzero(bits.reshape(-1))
                    row, gram = at >> GRAM_BITS, at & (GRAMS - 1)
                    n = np.bincount(row, minlength=len(bits))
                    if len(classes):
                        ends = np.cumsum(n)
                        summed = np.concatenate([np.zeros((1, len(classes))), np.cumsum(weights[gram], axis=0, dtype=np.float64)])
                        score = (summed[ends] - summed[ends - n]) / np.sqrt(np.maximum(n, 1))[:, None]
                        best = np.where(letter, score.argmax(1), len(classes))
                        sure = np.where(letter, np.clip((score.max(1) + 1) / 2, 0, 1), 0.0)
                    else:
                        best, sure = np.zeros(len(bits), int), np.zeros(len(bits))
                    cut = slice(low + s, low + s + len(bits))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0)[cut], batch.column(1)[cut], pa.array(names[best].tolist(), pa.string()), pa.array(sure, pa.float64())],
                        names=["doc_id", "held_out", "lang_pred", "score"],
                    )

    return run


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, lang_pred, score.

    `und` with score 0 for a text that is null or has no letter, and for all texts if there is nothing to learn from. The
    prediction reads the text only, so repeated texts get the same. A null doc_id isn't held out. No rows give no rows.
    """
    classes, weights = train(docs, doc_id, text, lang)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(_scorer(classes, weights), "doc_id long, held_out boolean, lang_pred string, score double")
