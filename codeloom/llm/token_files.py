"""Token-id files: texts are encoded, packed into compressed blocks in the order of their ids, and read back.

Texts are dealt to ranges of (doc_id, hash of the text) and sorted; a part's ids, an end id after each text, go to blocks of BLOCK
ids. A text isn't spread over blocks unless it is longer than one. The file is a parquet table with a row for each block: part,
block, the texts in it (place in the part, doc_id, piece, ids in this block, where they begin, whether whole) and the block's bytes with a
checksum, so parts commit like any Spark output and a block can be read alone. `TokenBlocks.java` codes and decodes a block:
adaptive mixing of order-0 to order-2 predictions and a range coder. It is sequential work of some 16 dependent decisions an id, which numpy
takes several times as long for, so it runs as a Java function inside Spark's own stages.

The tokenizer drops white space and looks at no neighbour across it, so texts are cut at ASCII white space and each different word
of a batch is encoded once. Words go to the library in runs, divided by a word of one known id. Defined results: null and
empty texts have the end id only; null doc_ids come first; rows that share an id follow one another by the hash of their text, then the text,
so reruns agree; repeated rows follow one another; an empty table gives an empty file; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codeloom.llm.jvm import register_functions
from codeloom.llm.shared import sized_batches, small_batches, written

END, BLOCK = 2, 16384
#: The piece that stands between others, how many pieces are handed to the library at once, how many a worker remembers, and bytes of text at once.
BETWEEN, RUN, REMEMBERED, BYTES = "\x01", 400, 600_000, 8 << 20
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: A word's end of punctuation without apostrophes, after a letter of long standing, is a piece of its own: the tokenizer cuts there.
TAILED = r"^(?P<stem>.*[a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}\x{3B1}-\x{3C9}\x{410}-\x{44F}\x{4E00}-\x{9FA5}])(?P<tail>[!-&(-/:-@\[-`{-~]+)$"


class Words:
    """Texts to their ids as little-endian 16-bit numbers."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 65536:
            raise ValueError("the file format holds ids under 65,536")
        self.between = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        if len(self.between) != 1:
            raise ValueError("the piece between pieces has to be one id")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.store, self.starts, self.sizes = np.zeros(0, "<u2"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, pieces: list[str]) -> np.ndarray:
        """Where the pieces stand among the known ones. New ones are encoded; where they are too many, all others are forgotten."""
        found = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        if len(self.known) + (found < 0).sum() > max(REMEMBERED, len(pieces)):
            self.forget()
            found[:] = -1
        places = np.flatnonzero(found < 0)
        if len(places):
            new, first = [pieces[k] for k in places.tolist()], len(self.known)
            store, starts, sizes = self.of_pieces(new)
            self.starts, self.sizes = np.append(self.starts, starts + len(self.store)), np.append(self.sizes, sizes)
            self.store = np.append(self.store, store)
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
            found[places] = first + np.arange(len(new))
        return found

    def of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each piece where its ids begin and how many they are. A piece that holds BETWEEN is encoded by itself."""
        alone = np.array([BETWEEN in x for x in pieces], bool)
        plain = [x for x in pieces if BETWEEN not in x]
        runs = [f" {BETWEEN} ".join(plain[k : k + RUN]) + f" {BETWEEN}" for k in range(0, len(plain), RUN)]
        coded = [np.array(e.ids, np.uint32).astype("<u2") for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]
        store = np.concatenate([*coded, np.zeros(0, "<u2")])
        cuts = np.flatnonzero(store == self.between[0])
        if len(cuts) != len(plain):
            raise ValueError("the pieces of a run can't be told apart")
        starts, ends = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        starts[~alone], ends[~alone] = np.concatenate([[0], cuts[:-1] + 1])[: len(cuts)], cuts
        more = [np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, "<u2") for x in pieces if BETWEEN in x]
        if more:
            sizes = np.array(list(map(len, more)))
            ends[alone] = len(store) + np.cumsum(sizes)
            starts[alone] = ends[alone] - sizes
            store = np.concatenate([store, *more])
        return store, starts, ends - starts

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, the end id after each, and n + 1 offsets of them."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        coded = pc.list_flatten(split).dictionary_encode()
        words = coded.dictionary
        # A name of a special token is read in its own case; all else is lower-cased by the tokenizer anyhow.
        special = pc.match_substring(words, "<|")
        plain = pc.if_else(special, words, pc.ascii_lower(words))
        trimmed = pc.binary_length(pc.utf8_rtrim(plain, PUNCTUATION)).to_numpy() < pc.binary_length(plain).to_numpy()
        some = np.flatnonzero(trimmed & ~special.to_numpy(zero_copy_only=False))
        parts = pc.extract_regex(plain.take(pa.array(some)), TAILED)
        some, parts = some[parts.is_valid().to_numpy(zero_copy_only=False)], parts.drop_null()
        stems = pc.replace_with_mask(plain, pa.array(np.isin(np.arange(len(words)), some)), pc.struct_field(parts, 0))
        pieces = pa.concat_arrays([stems, pc.struct_field(parts, 1), pa.array([""], pa.large_string())]).dictionary_encode()
        known = self.learn(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())[pieces.indices.to_numpy()]
        piece = np.full((len(words), 2), known[-1])
        piece[:, 0], piece[some, 1] = known[: len(words)], known[len(words) : -1]
        # A text is its words' stems and tails (white space alone splits to empty ones, of no ids) and the end, which is one more piece.
        word = coded.indices.to_numpy()
        both = piece[word].reshape(-1)
        ends = 2 * (split.offsets.to_numpy()[1:] - split.offsets.to_numpy()[0])
        both = np.insert(both, ends, len(self.sizes))
        starts, sizes = np.append(self.starts, len(self.store))[both], np.append(self.sizes, 1)[both]
        total = np.cumsum(sizes)
        ids = np.append(self.store, END).astype("<u2")[np.repeat(starts - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)]
        return ids, np.concatenate([[0], total[ends + np.arange(len(ends))]]) if len(ends) else np.zeros(1, np.int64)


@cache
def words_of(path: str) -> Words:
    """Read once in a process; every executor has the file."""
    return Words(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def crc_joined(first: int, second: int, size: int) -> int:
    """CRC-32 of two stretches of bytes from the CRC-32 of each and the size of the second.

    Appending a zero byte is a linear map of the 32 bits; its powers by squaring carry `first` over `size` bytes.
    """

    def applied(columns, x):
        out = 0
        for k, c in enumerate(columns):
            if x >> k & 1:
                out ^= c
        return out

    step = [(1 << k) >> 1 if k else 0xEDB88320 for k in range(32)]  # a zero bit
    for _ in range(3):
        step = [applied(step, c) for c in step]
    while size:
        if size & 1:
            first = applied(step, first)
        step = [applied(step, c) for c in step]
        size >>= 1
    return first ^ second


def write_ids(docs: DataFrame, ident="doc_id", text="text", path: str | None = None, parts: int | None = None) -> DataFrame:
    """The written file."""
    path = path or default_vocabulary()
    plain = docs.select(F.col(ident).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_type = plain.schema["doc_id"].dataType.simpleString()
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    register_functions(docs.sparkSession)

    def blocks_of(batches):
        words, part, made, place = words_of(path), TaskContext.get().partitionId(), 0, 0
        fill: list = []  # (place, doc_id, piece, ids, begin, whole) of the open block
        held: list = []
        for batch in sized_batches(batches, 1, BYTES, 8192):
            ids, ends = words.encoded(batch.column(1))
            kinds = (pa.int64(), batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            done = []
            for doc_id, a, z in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                whole = z - a <= BLOCK
                for piece, x in enumerate(range(a, z, BLOCK)):
                    n = min(z - x, BLOCK)
                    begin = fill[-1][3] + fill[-1][4] if fill else 0
                    if begin + n > BLOCK:
                        done.append((fill, held))
                        fill, held, begin = [], [], 0
                    fill.append((place, doc_id, piece, n, begin, whole))
                    held.append(ids[x : x + n])
                place += 1
            if done:
                yield block_batch(part, made, done, kinds)
                made += len(done)
        if fill:
            yield block_batch(part, made, [(fill, held)], kinds)

    schema = f"part int, block long, {', '.join(f'{c} array<{t}>' for c, t in zip(COLUMNS, ('long', id_type, 'int', 'int', 'int', 'boolean'), strict=True))}, ids binary"
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("text").asc_nulls_first()]
    ordered = plain.withColumn("hash", F.xxhash64("text")).repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)
    made = ordered.select("doc_id", "text").mapInArrow(blocks_of, schema)
    return written(made.withColumn("bytes", F.expr("codeloom_pack_ids(ids)")).drop("ids"), "token_ids")


COLUMNS = ("places", "doc_ids", "pieces", "counts", "begins", "whole")


def block_batch(part: int, made: int, blocks: list, kinds) -> pa.RecordBatch:
    columns = [pa.array([part] * len(blocks), pa.int32()), pa.array(range(made, made + len(blocks)), pa.int64())]
    for k, t in enumerate(kinds):
        columns.append(pa.array([[e[k] for e in fill] for fill, _ in blocks], pa.list_(t)))
    columns.append(pa.array([b"".join(x.tobytes() for x in held) for _, held in blocks], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, names=["part", "block", *COLUMNS, "ids"])


def read_ids(file: DataFrame) -> DataFrame:
    """part, place, doc_id, piece, whole, n, crc: the ids of each text in each block, decoded and summed up."""
    register_functions(file.sparkSession)
    entry = F.transform(
        F.arrays_zip(*COLUMNS),
        lambda e: F.struct(
            e["places"].alias("place"), e["doc_ids"].alias("doc_id"), e["pieces"].alias("piece"), e["whole"].alias("whole"), e["counts"].cast("long").alias("n"),
            F.crc32(F.substring(F.col("ids"), e["begins"] * 4 + 1, e["counts"] * 4)).alias("crc"),
        ),
    )
    decoded = file.select("part", *COLUMNS, F.expr("codeloom_unpack_ids(bytes)").alias("ids"))
    return decoded.select("part", F.explode(entry).alias("e")).select("part", "e.*")


def token_file_report(docs: DataFrame, ident="doc_id", text="text", path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of docs, from the file."""
    read = written(read_ids(write_ids(docs, ident, text, path)), "read_ids")
    id_type = read.schema["doc_id"].dataType.simpleString()

    def joined(batches):
        for batch in small_batches(batches):
            rows = []
            for pieces in batch.column(3).to_pylist():
                n = crc = 0
                for p in pieces:
                    crc = crc_joined(crc, p["crc"], 4 * p["n"]) if n else p["crc"]
                    n += p["n"]
                rows.append((n, crc))
            n, crc = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["part", "place", "doc_id", "n", "crc"])

    cut = read.where("NOT whole").groupBy("part", "place").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("piece", "n", "crc"))).alias("pieces"))
    long = cut.select("part", "place", "doc_id", "pieces").mapInArrow(joined, f"part int, place long, doc_id {id_type}, n long, crc long")
    texts = read.where("whole").select("part", "place", "doc_id", "n", "crc").unionByName(long)
    totals = read.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each part of the file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = texts.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return placed.join(F.broadcast(base), placed["part"] == base["of"]).select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32")
    )
