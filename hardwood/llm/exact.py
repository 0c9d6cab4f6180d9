"""Exact duplicates by two-pass Bloom filtering, with DataFrame functions only.

The first pass marks, for each fingerprint, a few slots of a bit table; a slot stays set when two or more
rows meet there. The second pass tests every row against that table: where one of its slots isn't set, no
other row has the same text, and the row passes straight through. Only the others shuffle, by their SHA-256.
A false positive of the table costs a shuffled row and never changes a result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hardwood.session import materialize

#: Slots per fingerprint, bits of one stored piece, bits a row, and the most bits (32 MB), which bounds what goes to the tasks.
SLOTS, PIECE, BITS_PER_ROW, MOST_BITS = 3, 32_768, 16, 1 << 28


def normal_text(text: Column) -> Column:
    """White space runs as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_sha256(text: Column) -> Column:
    return F.sha2(F.encode(normal_text(text), "UTF-8"), 256)


def _slots(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(j)), F.lit(bits)) for j in range(SLOTS)]


def table_bits(rows: int) -> int:
    """A power of two of at least BITS_PER_ROW bits a row, up to MOST_BITS; beyond that the table lets more rows through."""
    return min(MOST_BITS, max(PIECE, 1 << max(0, rows * BITS_PER_ROW - 1).bit_length()))


def slot_table(keys: DataFrame, key: str, bits: int, meet: int = 2) -> DataFrame:
    """One row `bits`: array of 4 KB bitmaps (null: no bit set) of the slots in which `meet` rows or more meet."""
    hits = (
        keys.select(F.explode(F.array(*_slots(F.col(key), bits))).alias("slot"))
        .groupBy("slot").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= meet)
    )
    pieces = hits.groupBy(F.expr(f"slot div {PIECE}").alias("piece")).agg(
        F.bitmap_construct_agg(F.expr(f"slot % {PIECE}")).alias("bitmap")
    )
    every = keys.sparkSession.range(bits // PIECE).withColumnRenamed("id", "piece")
    filled = every.join(pieces, "piece", "left")
    return filled.agg(F.array_sort(F.collect_list(F.struct("piece", "bitmap"))).alias("p")).select(F.col("p.bitmap").alias("bits"))


def in_table(table: DataFrame, key: Column, bits: int) -> Column:
    """Whether all slots of the key are set: true for every key that put `meet` rows into the table, false for nearly all others."""
    held = table.scalar()

    def bit(slot: Column) -> Column:
        bitmap = F.get(held, (slot / PIECE).cast("int"))
        place = F.pmod(slot, F.lit(PIECE)).cast("int")
        byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
        return F.coalesce(F.getbit(byte, F.pmod(place, F.lit(8))) == 1, F.lit(False))

    return reduce(lambda a, b: a & b, [bit(s) for s in _slots(key, bits)])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row_no, doc_id, sha of every row, stored once: the only pass over the texts."""
    return materialize(docs.select(
        F.monotonically_increasing_id().alias("row_no"), F.col(doc_id).cast("long").alias("doc_id"),
        text_sha256(F.col(text)).alias("sha"),
    ))


def label_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the smallest doc_id stays; a null doc_id comes after all others, and of rows that repeat
    that doc_id one stays. Null text counts as empty. No rows give no rows; other columns aren't read.
    """
    prints = fingerprints(docs, doc_id, text)
    bits = table_bits(prints.count())
    table = materialize(slot_table(prints, "sha", bits))
    marked = prints.withColumn("again", in_table(table, F.col("sha"), bits))
    single = marked.filter(~F.col("again")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    again = materialize(marked.filter("again").drop("again"))
    groups = materialize(again.groupBy("sha").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_no")).alias("first"),
        F.count(F.lit(1)).alias("group_size"),
    ).select(F.col("sha").alias("g_sha"), F.col("first.doc_id").alias("keep_id"), F.col("first.row_no").alias("keep_no"), "group_size"))
    shared = again.join(groups, F.col("sha") == F.col("g_sha")).select(
        "doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_no")).alias("kept"), F.col("sha").alias("text_sha256")
    )
    return single.unionByName(shared)


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of each group of equal texts (see `label_copies`), all columns as they were.

    Rows that no other row can equal pass straight through; of the rest, whole rows meet in a combinable
    aggregate, so a group of any size is reduced before it moves.
    """
    prints = fingerprints(docs, doc_id, text)
    bits = table_bits(prints.count())
    table = materialize(slot_table(prints, "sha", bits))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    marked = docs.select(
        own.alias("row"), text_sha256(F.col(text)).alias("sha"), F.col(doc_id).cast("long").alias("id"), F.monotonically_increasing_id().alias("row_no")
    )
    # row_no keeps the test above this projection, where the fingerprint is there already, and not computed for each slot
    again, here = in_table(table, F.col("sha"), bits), F.col("row_no") >= 0
    single = marked.filter(~again & here).select("row.*")
    first = F.min_by("row", F.struct(F.col("id").isNull(), "id", "row_no"))
    shared = marked.filter(again & here).groupBy("sha").agg(first.alias("row")).select("row.*")
    return single.unionByName(shared)


def without_ids(docs: DataFrame, gone: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """`docs` without the rows whose id is in the stored one-column table `gone`.

    Rows that the bit table of the ids rules out pass straight through; only the others meet the ids. Rows without an id stay.
    """
    name = "gone"
    while name in docs.columns:
        name += "_"
    gone = gone.toDF(name).filter(F.col(name).isNotNull()).distinct()
    bits = table_bits(gone.count())
    table = materialize(slot_table(gone, name, bits, meet=1))
    key = F.col(f"`{doc_id}`").cast("long")
    maybe = key.isNotNull() & in_table(table, key, bits)
    return docs.filter(~maybe).unionByName(docs.filter(maybe).join(gone, key == F.col(name), "left_anti"))
