"""Fill-in-the-middle texts by a pipeline of pyarrow.compute calls, a batch at a time.

Units (lines) are list arrays; flattened with their parents' indices they get ordinals, which say each unit's role; the units
of a role are filtered, made lists again and joined. A document's cuts, form and order come from a hash of its doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the parts, the seed before the doc_id, and percentages of transformed texts and of `spm` among them.
MARKS, SEED, RATE, SPM = ("<P>", "<S>", "<M>"), "7:", 100, 50
#: Bytes of text in one run of the pipeline; one longer text is a run of its own.
RUN_BYTES = 4_000_000


def hashes(doc_id: Column) -> list[Column]:
    """Four numbers from the first 8-digit groups of the SHA-256 of seed and decimal doc_id (nothing after the seed for null)."""
    sha = F.sha2(F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(sha, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def _joined(*parts: pa.Array | str) -> pa.Array:
    return pc.binary_join_element_wise(*[pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in (*parts, "")])


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Lines `[^\\n]*\\n|[^\\n]+` of all texts in a row, their parents, their ordinals and the number of each text."""
    lists = pc.split_pattern(texts, "\n")
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    n = pc.list_value_length(lists).to_numpy().astype(np.int64)
    ordinal = np.arange(len(flat)) - (np.cumsum(n) - n)[parent]
    last = ordinal == n[parent] - 1
    ended = pc.if_else(pa.array(last), flat, _joined(flat, "\n"))
    empty = last & pc.equal(flat, "").to_numpy(zero_copy_only=False)
    keep = ~empty
    return ended.filter(pa.array(keep)), parent[keep], ordinal[keep], n - np.bincount(parent[empty], minlength=len(texts))


def _role(flat: pa.Array, parent: np.ndarray, mask: np.ndarray, rows: int) -> pa.Array:
    """The units of the mask, joined again by parent."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(parent[mask], minlength=rows))]).astype(np.int64)
    lists = pa.LargeListArray.from_arrays(pa.array(ends), flat.filter(pa.array(mask)))
    return pc.binary_join(lists, pa.scalar("", pa.large_string()))


def transform_batch(texts: pa.Array, h: list[np.ndarray], rate: int = RATE, spm: int = SPM) -> dict[str, pa.Array]:
    """n, form, prefix_chars, middle_chars and output of each text."""
    p, s, m = MARKS
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    flat, parent, ordinal, n = units(texts)
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    low, high = np.minimum(one, two)[parent], np.maximum(one, two)[parent]
    prefix, middle, suffix = (_role(flat, parent, x, len(texts)) for x in (ordinal < low, (ordinal >= low) & (ordinal < high), ordinal >= high))
    plain = pc.equal(texts, "").to_numpy(zero_copy_only=False) | (h[2] % 100 >= rate)
    for mark in MARKS:
        plain |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    is_plain, is_spm = pa.array(plain), pa.array(h[3] % 100 < spm)
    form = pc.if_else(is_plain, "plain", pc.if_else(is_spm, "spm", "psm"))
    made = pc.if_else(is_spm, _joined(s, suffix, p, prefix, m, middle), _joined(p, prefix, s, suffix, m, middle))
    none = pa.scalar(None, pa.int64())
    chars = [pc.if_else(is_plain, none, pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
    return {"n": pa.array(n), "form": form, "prefix_chars": chars[0], "middle_chars": chars[1], "output": pc.if_else(is_plain, texts, made)}


def restore_batch(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts: parts have no mark in them and a mark begins with a character that none has later, so the first mark is the right one."""
    p, s, m = MARKS
    output = output.cast(pa.large_string())
    is_plain, is_spm = pc.equal(form, "plain"), pc.equal(form, "spm")
    body = pc.utf8_slice_codeunits(pc.if_else(is_plain, pa.scalar(p + s + m, pa.large_string()), output), len(p))

    dummy = lambda *marks: pa.scalar("".join(marks), pa.large_string())

    def two(x: pa.Array, mark: str) -> tuple[pa.Array, pa.Array]:
        parts = pc.split_pattern(x, mark, max_splits=1)
        return pc.list_element(parts, 0), pc.list_element(parts, 1)

    # the mark between the first two parts is <S> or <P>, after which <M> stands before the middle
    text = None
    for chosen, mark, sample in ((is_spm, p, dummy(p, m)), (pc.invert(is_spm), s, dummy(s, m))):
        first, rest = two(pc.if_else(pc.or_(is_plain, pc.invert(chosen)), sample, body), mark)
        second, middle = two(rest, m)
        whole = _joined(second, middle, first) if mark == p else _joined(first, middle, second)
        text = whole if text is None else pc.if_else(chosen, whole, text)
    return pc.if_else(is_plain, output, text)


def _runs(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of at most RUN_BYTES of text together, one row at least."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + RUN_BYTES, "right")))
        yield batch.slice(low, high - low)
        low = high


def _numbers(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(2 + i).to_numpy() for i in range(4)]


def _sha256(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(x).hexdigest() for x in texts.cast(pa.large_binary()).to_pylist()], pa.string())


def _transform(rate: int, spm: int, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _runs(batch, 1):
                out = transform_batch(part.column(1), _numbers(part), rate, spm)
                if digests:
                    output = out.pop("output")
                    out |= {"output_sha256": _sha256(output), "restored_sha256": _sha256(restore_batch(output, out["form"]))}
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0)} | {k: v.cast(pa.string()) if pa.types.is_large_string(v.type) else v for k, v in out.items()})

    return run


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _runs(batch, 2):
            yield pa.RecordBatch.from_arrays([part.column(0), restore_batch(part.column(2), part.column(1)).cast(pa.string())], names=["doc_id", "text"])


def _asked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    ident = F.col(f"`{doc_id}`").cast("long")
    return docs.select(ident.alias("doc_id"), F.col(f"`{text}`").alias("text"), *hashes(ident))


_COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long"


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: int = RATE, spm: int = SPM) -> DataFrame:
    """One row per row of `docs`: doc_id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars, output.

    A null text counts as empty; empty texts and texts with a mark in them stay plain, and their two lengths are null. Rows
    that repeat a doc_id are cut by the same numbers; a null doc_id by those of the seed alone. Other columns aren't
    read; no rows give no rows. Nothing shuffles, and a task holds RUN_BYTES of text or one document.
    """
    return _asked(docs, doc_id, text).mapInArrow(_transform(rate, spm, False), f"{_COLUMNS}, output string")


def restore(made: DataFrame) -> DataFrame:
    """doc_id and text of the rows of `transform`, from their output and form alone."""
    return made.select("doc_id", "form", "output").mapInArrow(_restore, "doc_id long, text string")


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: int = RATE, spm: int = SPM) -> DataFrame:
    """As `transform`, with output_sha256 and the restored_sha256 of the text rebuilt from the output in place of the output."""
    return _asked(docs, doc_id, text).mapInArrow(_transform(rate, spm, True), f"{_COLUMNS}, output_sha256 string, restored_sha256 string")
