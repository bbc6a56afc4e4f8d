"""Media columns: texts as 8-bit mono WAV files, kept as content-defined chunks and put together again.

A payload is the text in UTF-8, filled with spaces to a positive multiple of FRAME bytes; its media form is a WAV
file with the payload as 8-bit samples. A gear hash rolls over the file's bytes, and a chunk ends where
its low bits are zero, so that equal stretches give equal chunks wherever they stand. Chunks are stored once:

- `recipes`: for each file the ordered chunk digests (SHA-256) and lengths.
- a fixed-size bit table of the digests that occur more than once, found by counting digests in Spark. A false hit
  only sends a chunk through the shared store.
- `own`: chunks that no other place has, in one row for each file, written where the file is read; no bytes are shuffled.
- `shared`: chunks with more than one place, one row for each digest.

Reading joins the shared chunks to the files that list them (a chunk that very many files list is left to adaptive
skew-join splitting, which repeats a digest's one row, not its files), puts each file's chunks in order, checks
every digest, and verifies the file. Files without shared chunks need no join.

Defined results: null and empty texts are FRAME spaces; equal texts give equal values; repeated rows
give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.exact import FILTER_BITS, in_table, repeated_bits
from codeloom.llm.shared import byte_texts, small_batches, written

FRAME, RATE = 192, 8000
LEAST, MOST, AVERAGE_BITS, SEED = 512, 8192, 11, 7
GEAR = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2**32, 256, dtype=np.uint32)


def payload_of(text: bytes) -> bytes:
    return text + b" " * (-len(text) % FRAME if text else FRAME)


def wav(payload: bytes) -> bytes:
    """A WAV file: 8-bit unsigned PCM, one channel. Lengths that don't fit in its 32-bit fields are refused."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + payload


def samples(media: bytes) -> bytes:
    """The samples of a file that `wav` made."""
    n = struct.unpack_from("<I", media, 40)[0]
    if media[:4] != b"RIFF" or media[36:40] != b"data" or len(media) != 44 + n:
        raise ValueError("not a file of this operator")
    return media[44:]


def candidates(data: np.ndarray) -> np.ndarray:
    """Positions after which a chunk may end: the gear hash of the last 32 bytes has AVERAGE_BITS low zero bits.

    hash(i) is the sum of GEAR[byte(i - k)] << k, built for 1, 2, 4 up to 32 bytes.
    """
    h = GEAR[data]
    for span in (1, 2, 4, 8, 16):
        h[span:] += h[:-span] << np.uint32(span)
    mask = np.uint32((2**AVERAGE_BITS - 1) << 20)  # bits that bytes as far as 20 back reach
    return np.flatnonzero(h & mask == 0) + 1


def cuts(media: bytes, block: int = 1 << 22) -> list[int]:
    """Ends of the chunks: a candidate at least LEAST after the last cut, or MOST bytes. Long files go block by block."""
    data, found, last = np.frombuffer(media, np.uint8), [], 0
    for a in range(0, len(data), block):
        back = min(a, 31)
        for c in (candidates(data[a - back : a + block]) + (a - back)).tolist():
            if c <= a and a:
                continue
            while c - last > MOST:
                last += MOST
                found.append(last)
            if c - last >= LEAST:
                last = c
                found.append(c)
    while len(data) - last > MOST:
        last += MOST
        found.append(last)
    if last < len(data):
        found.append(len(data))
    return found


def chunks_of(media: bytes) -> list[tuple[bytes, bytes]]:
    found, last = [], 0
    for end in cuts(media):
        piece = media[last:end]
        found.append((hashlib.sha256(piece).digest(), piece))
        last = end
    return found


def feature_of(payload: bytes) -> str:
    """Mean and deviation of the samples, share of sign changes around the mean, and energy in 4 quarters, rounded."""
    x = np.frombuffer(payload, np.uint8).astype(np.float32)
    mean = float(x.mean(dtype=np.float64))
    above = x > mean
    quarters = [float(q.std(dtype=np.float64)) for q in x.reshape(4, -1)]
    turns = int(np.count_nonzero(above[1:] != above[:-1]))
    return f"mean={mean:.3f};dev={x.std(dtype=np.float64):.3f};turns={turns / len(x):.4f};quarters=" + "/".join(f"{q:.2f}" for q in quarters)


def store(docs: DataFrame, ident="doc_id", text="text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The written tables recipes (row, doc_id, digests), own (row, doc_id, n_bytes, digests, pieces), shared (key, piece)."""
    spark = docs.sparkSession
    id_type = docs.schema[ident].dataType.simpleString()
    plain = docs.select(F.col(ident).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def recipe(batches):
        for batch in small_batches(batches):
            lists = [[d for d, _ in chunks_of(wav(payload_of(t)))] for t in byte_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.binary()))], names=["doc_id", "digests"])

    recipes = written(plain.mapInArrow(recipe, f"doc_id {id_type}, digests array<binary>"), "recipes")
    counted = recipes.select(F.explode("digests").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    table = spark.sparkContext.broadcast(repeated_bits(counted))

    def keep(batches):
        kinds = (pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary()))
        for batch in small_batches(batches, 256):
            rows = []
            for t in byte_texts(batch.column(2)):
                parts = chunks_of(wav(payload_of(t)))
                rows.append((len(t), [d for d, _ in parts], [None if in_table(table.value, d) else p for d, p in parts]))
            columns = [pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["row", "doc_id", "n_bytes", "digests", "pieces"])

    numbered = plain.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    own = written(numbered.mapInArrow(keep, f"row long, doc_id {id_type}, n_bytes long, digests array<binary>, pieces array<binary>"), "own")

    def spread(batches):
        for batch in small_batches(batches, 256):
            found = {}
            for t in byte_texts(batch.column(1)):
                found |= {d: p for d, p in chunks_of(wav(payload_of(t))) if in_table(table.value, d)}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["key", "piece"])

    spare = plain.mapInArrow(spread, "key binary, piece binary")
    shared = written(spare.groupBy("key").agg(F.max("piece").alias("piece")), "shared")
    return recipes, own, shared


def verified(own: DataFrame, shared: DataFrame) -> DataFrame:
    """doc_id and the values of every file, read from the stored chunks."""
    id_type = own.schema["doc_id"].dataType.simpleString()
    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"
    names = ["doc_id", *(f.split()[0] for f in fields.split(", "))]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def values(n_bytes, digests, pieces):
        for d, p in zip(digests, pieces, strict=True):
            if hashlib.sha256(p).digest() != d:
                raise ValueError("a stored chunk doesn't have its digest")
        media = b"".join(pieces)
        payload = samples(media)
        return n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload), len(digests)

    def out(ids, rows):
        return pa.RecordBatch.from_arrays([ids, *(pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    def alone(batches):
        for batch in small_batches(batches, 256):
            yield out(batch.column(0), [values(*r) for r in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)])

    def together(batches):
        for batch in small_batches(batches, 64):
            rows = []
            for n_bytes, digests, pieces, places, found in zip(*(batch.column(k).to_pylist() for k in range(1, 6)), strict=True):
                for at, piece in zip(places, found, strict=True):
                    pieces[at] = piece
                rows.append(values(n_bytes, digests, pieces))
            yield out(batch.column(0), rows)

    lacks = F.exists("pieces", lambda p: p.isNull())
    schema = f"doc_id {id_type}, {fields}"
    first = own.where(~lacks).select("doc_id", "n_bytes", "digests", "pieces").mapInArrow(alone, schema)
    lacking = own.where(lacks)
    wanted = lacking.select("row", F.posexplode(F.arrays_zip("digests", "pieces")).alias("at", "chunk")).where("chunk.pieces IS NULL").select("row", "at", F.col("chunk.digests").alias("key"))
    got = wanted.join(shared, "key").groupBy("row").agg(F.collect_list(F.struct("at", "piece")).alias("got"))
    joined = lacking.join(got, "row").select("doc_id", "n_bytes", "digests", "pieces", F.col("got.at").alias("places"), F.col("got.piece").alias("found"))
    return first.unionByName(joined.mapInArrow(together, schema))


def media_report(docs: DataFrame, ident="doc_id", text="text") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_chunks of every row."""
    _, own, shared = store(docs, ident, text)
    return verified(own, shared)
