"""Exact duplicates by an extendible-hash index on shared files.

Texts are equal when their bytes are, after A-Z are lower-cased; null counts as empty. The hash key is the
SHA-256 of those bytes. The directory starts with one bucket and doubles while a bucket holds more distinct
keys than its capacity, which splits that bucket on one more leading bit. Rows are dealt to owner tasks by
bucket, a range of keys. An owner walks its range in key order, chains the entries whose keys share their
first 64 bits, compares the bytes of the texts in a chain, and writes one index entry for each different text.

Most texts occur once. A fixed-size bit table of the keys that occur more often tells which texts have to
travel for the comparison; a false hit costs a text's transport, nothing else. Equal texts within one batch
are merged before the shuffle, so a text that a third of all rows share reaches its owner once a batch.
Groups of more than a HOT-th of all rows, of which there are fewer than HOT, are broadcast to their rows; the
rows of other groups meet them by key.

Defined results: the row with the largest doc_id stays (ids that are null come last); of repeated rows with
that id exactly one stays; empty and null texts are one group; an empty table gives an empty index.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.shared import byte_texts, fold_ascii, lean, sized_batches, small_batches, written

#: Distinct keys of a bucket, at least; it grows so that the directory keeps at most 2^DEPTH slots.
CAPACITY, DEPTH = 1024, 16
#: The table of repeated keys has 2^FILTER_BITS bits (4 MB).
FILTER_BITS = 25
#: A group of more than one in HOT rows is hot; there are fewer than HOT such groups.
HOT = 4096
PAGE = 32768  # bits in a value of Spark's bitmap_construct_agg


def digests(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """doc_id and key (SHA-256 of the folded text) of each row."""

    def digest(batches):
        for batch in small_batches(batches):
            keys = [hashlib.sha256(t.lower()).digest() for t in byte_texts(batch.column(1))]  # bytes.lower() folds A-Z only
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], names=["doc_id", "key"])

    plain = docs.select(F.col(ident).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(lean(digest), f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, key binary")


def directory(prefix_counts: np.ndarray, capacity: int) -> np.ndarray:
    """Bucket of each prefix. prefix_counts: distinct keys by their first DEPTH bits.

    A bucket is a depth and that many leading bits. Doubling the directory is implied: all slots that share
    the leading bits of a bucket point to it.
    """
    slots = np.zeros(len(prefix_counts), np.int64)
    open_buckets, done, bits = [(0, len(prefix_counts))], 0, len(prefix_counts)
    total = np.concatenate([[0], prefix_counts.cumsum()])
    while open_buckets:
        start, width = open_buckets.pop()
        if total[start + width] - total[start] > capacity and width > 1:
            open_buckets += [(start + width // 2, width // 2), (start, width // 2)]
        else:
            slots[start : start + width] = done
            done += 1
    assert bits == len(slots)
    return slots


def spot_of(key: Column | str) -> Column:
    """The place of a key in the bit table."""
    return F.conv(F.substring(F.hex(key), 17, 12), 16, 10).cast("bigint") % F.lit(2**FILTER_BITS)


def repeated_pages(keys: DataFrame) -> DataFrame:
    """page, bits: the bit table of keys with more than one row, at most 2^FILTER_BITS / PAGE pages of 4 KB."""
    spots = keys.where("n > 1").select(spot_of("key").alias("spot"))
    return spots.groupBy(F.bitmap_bucket_number("spot").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))


def repeated_bits(keys: DataFrame) -> np.ndarray:
    """The bit table as one array, 2^FILTER_BITS bits whatever the input."""
    table = np.zeros(2**FILTER_BITS // PAGE + 2, dtype=("u1", PAGE // 8))
    for page, bits in repeated_pages(keys).collect():
        table[page] = np.frombuffer(bits, np.uint8)
    return table


def in_table(table: np.ndarray, digest: bytes) -> bool:
    spot = int.from_bytes(digest[8:14], "big") % 2**FILTER_BITS
    page, bit = bucket_and_bit(spot)
    return bool(table[page, bit >> 3] >> (bit & 7) & 1)


def bucket_and_bit(spot: int) -> tuple[int, int]:
    """As bitmap_bucket_number and bitmap_bit_position count: bucket 1 holds 1 to 32768, bucket 0 holds 0 and less."""
    return (1 + (spot - 1) // PAGE, (spot - 1) % PAGE) if spot > 0 else (-spot // PAGE, -spot % PAGE)


class Merged:
    """Entries of a batch or of a chain: texts that are equal byte for byte become one."""

    def __init__(self):
        self.chains: dict[bytes, list[list]] = {}

    def add(self, key: bytes, text: bytes | None, n: int, largest) -> None:
        chain = self.chains.setdefault(key[:8], [])
        for entry in chain:
            if entry[0] == key:
                if text is not None and entry[1] is not None and text != entry[1]:
                    raise ValueError("two texts with one SHA-256")
                entry[2] += n
                entry[3] = largest if entry[3] is None or largest is not None and largest > entry[3] else entry[3]
                return
        chain.append([key, text, n, largest])

    def entries(self):
        for chain in self.chains.values():
            yield from chain


def entry_batch(entries: list, slots: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    key, text, n, largest = zip(*entries, strict=True)
    bucket = [int(slots[int.from_bytes(k[:2], "big")]) for k in key]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((bucket, key, text, n, largest), schema, strict=True)], schema=schema)


def build_index(docs: DataFrame, ident="doc_id", text="text", capacity=CAPACITY) -> tuple[DataFrame, DataFrame]:
    """The written digests (doc_id, key) and the written index (bucket, key, place, n, keep_id): place counts along a chain."""
    spark = docs.sparkSession
    rows = written(digests(docs, ident, text), "digests")
    keys = written(rows.groupBy("key").agg(F.count("*").alias("n")), "keys")
    prefix = F.conv(F.substring(F.hex("key"), 1, DEPTH // 4), 16, 10).cast("int")
    counts = np.zeros(2**DEPTH, np.int64)
    for p, n in keys.groupBy(prefix.alias("p")).count().collect():  # at most 2^DEPTH rows
        counts[p] = n
    capacity = max(capacity, -(-int(counts.sum()) * 4 // 2**DEPTH))
    known = spark.sparkContext.broadcast((directory(counts, capacity), repeated_bits(keys)))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def merge(batches):
        slots, table = known.value
        for batch in sized_batches(batches, 1, 8 << 20, 4096):
            schema = pa.schema([("bucket", pa.int64()), ("key", pa.binary()), ("text", pa.binary()), ("n", pa.int64()), ("largest", batch.schema.field(0).type)])
            merged = Merged()
            for doc_id, t in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
                key = hashlib.sha256(t := t.lower()).digest()
                merged.add(key, t if in_table(table, key) else None, 1, doc_id)
            if entries := list(merged.entries()):
                yield entry_batch(entries, slots, schema)

    def own(batches):
        """Rows come in key order: a chain ends where the first 64 bits change."""
        held, chain, out = Merged(), None, []

        def closed():
            for place, (key, _, n, largest) in enumerate(held.entries()):
                out.append((bucket, key, place, n, largest))

        def batch_of(rows, kind):
            types = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), kind)
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names=["bucket", "key", "place", "n", "keep_id"])

        for batch in small_batches(batches):
            kind = batch.schema.field(4).type
            for b, key, t, n, largest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key[:8] != chain:
                    if chain is not None:
                        closed()
                    held, chain = Merged(), key[:8]
                bucket = b
                held.add(key, t, n, largest)
            if len(out) >= 4096:
                yield batch_of(out, kind)
                out.clear()
        if chain is not None:
            closed()
            yield batch_of(out, kind)

    plain = docs.select(F.col(ident).alias("doc_id"), F.col(text).cast("string").alias("text"))
    entries = plain.mapInArrow(lean(merge), f"bucket long, key binary, text binary, n long, largest {id_type}")
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries.repartition(owners, "bucket").sortWithinPartitions("bucket", "key")
    return rows, written(dealt.mapInArrow(lean(own), f"bucket long, key binary, place int, n long, keep_id {id_type}"), "index")


def with_groups(rows: DataFrame, index: DataFrame, how: str) -> DataFrame:
    """rows with n and keep_id of their group, where it has more than one row; how is inner or left for the others."""
    groups = index.where("n > 1").select("key", "n", "keep_id")
    total = index.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(groups.where(F.col("n") * HOT > total))
    rest = rows.join(hot.select("key"), "key", "left_anti").join(groups.where(F.col("n") * HOT <= total), "key", how)
    return rows.join(hot, "key").unionByName(rest)


def exact_groups(docs: DataFrame, ident="doc_id", text="text", capacity=CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs."""
    rows, index = build_index(docs, ident, text, capacity)
    same = rows.groupBy("key", "doc_id").agg(F.count("*").alias("times"))  # repeated rows
    found = with_groups(same, index, "left").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))))
    keep_id = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("bigint")).alias("group_size"),
        (keep_id.eqNullSafe(F.col("doc_id")) & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("key")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, ident="doc_id", text="text", capacity=CAPACITY) -> DataFrame:
    """docs without the copies, with the columns of docs. A row stays where it is read unless the bit table marks its key."""
    rows, index = build_index(docs, ident, text, capacity)
    copied = with_groups(rows, index, "inner")
    dropped = written(copied.where(~F.col("keep_id").eqNullSafe(F.col("doc_id"))).select(F.col("key").alias("_key"), F.col("doc_id").alias("_id")).distinct(), "dropped")
    twice = written(copied.where(F.col("keep_id").eqNullSafe(F.col("doc_id"))).groupBy("key", "doc_id").count().where("count > 1").select(F.col("key").alias("_key"), F.col("doc_id").alias("_id")), "twice")
    own = F.unhex(F.sha2(fold_ascii(F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("binary"), 256))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(ident).alias("_own_id"), own.alias("_own_key"))
    placed, pages = keyed.withColumn("_spot", spot_of("_own_key")), F.broadcast(repeated_pages(index))
    bit = F.bitmap_bit_position("_spot")
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(F.getbit(byte, (bit % 8).cast("int")), F.lit(0)) == 1
    checked = placed.join(pages, F.bitmap_bucket_number("_spot") == F.col("page"), "left").withColumn("_marked", marked)
    alone, asked = checked.where("NOT _marked").select("row"), checked.where("_marked").select(*keyed.columns)
    match = lambda other: asked["_own_key"].eqNullSafe(other["_key"]) & asked["_own_id"].eqNullSafe(other["_id"])
    kept = asked.join(dropped, match(dropped), "left_anti")
    if twice.isEmpty():
        return alone.unionByName(kept.select("row")).select("row.*")
    once = kept.join(twice, match(twice), "left_anti").select("row")
    repeated = kept.join(twice, match(twice), "left_semi").dropDuplicates(["_own_key", "_own_id"]).select("row")
    return alone.unionByName(once).unionByName(repeated).select("row.*")


ORACLE_SQL = r"""
WITH folded AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
grouped AS (
  SELECT doc_id, text_sha256, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
         row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) AS place
  FROM folded WINDOW g AS (PARTITION BY text_sha256))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM grouped
"""
