"""Near duplicates by SimHash fingerprints and a byte-position inverted index with count filtering.

A fingerprint has 8 bytes, and fingerprints that differ in at most 4 bits share at least 4 of the 8 positional
bytes. The index lists fingerprints under positional bytes. Lists of one byte would hold a 256th of all
fingerprints and their pairs would grow with the square of the corpus, so an entry joins the bytes of
3 positions: 20 triples are chosen so that any 4 of the 8 positions hold one of them. Each pair that meets in
a list is tallied: pairs with fewer than 4 equal positional bytes are dropped, and those that are left are
verified by their differing bits.

Equal fingerprints are one node, whatever number of rows they stand for. A list that is longer than BLOCK is
dealt once more by the next shared byte, so that a pair in it shares 4 named positional bytes; lists
are worked through in blocks and send on only links that join two parts of a list, at most one fewer
than it has members. Components are found by pointer jumping over those links, each round written to the shared folder.

Words are what lies between ASCII white space after A-Z are lower-cased; shingles of SHINGLE words, repeats
included; fewer words make one shingle. A bit of the fingerprint is 1 if more than half of the shingles' hashes
(XXH64, seed 42) have it. Defined results: texts without words, null ones too, have fingerprint 0 and are
linked like any other; rows with a null id get a null component unless they are linked to a row with an id;
repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.exact import repeated_pages, spot_of
from codeloom.llm.shared import byte_texts, lean, small_batches, written

SHINGLE, BITS, SEED = 4, 4, 42
GUARANTEED = 8 - BITS  # equal positional bytes of a pair
BLOCK = 2048


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # bytes.split cuts at ASCII white space, bytes.lower folds A-Z only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    after = (np.fromiter(map(len, words), np.int64, len(words)) + 1).cumsum()
    starts = np.concatenate([[0], after[:-shingle]]).tolist()
    total, n = np.zeros(64, np.int64), len(starts)
    ends = (after[shingle - 1 :] - 1).tolist()
    for k in range(0, n, 65536):
        hashes = np.array([digest(joined[a:z], SEED) for a, z in zip(starts[k : k + 65536], ends[k : k + 65536], strict=True)], dtype=">u8")
        total += ones(hashes)
    return print_of(total, n)


def ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the big-endian hashes have each bit."""
    return np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)


def print_of(total: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, ident="doc_id", text="text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (as a signed long)."""

    def mark(batches):
        for batch in small_batches(batches):
            found = np.array([fingerprint(t, shingle) for t in byte_texts(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fingerprint"])

    plain = docs.select(F.col(ident).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(lean(mark), f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, fingerprint long")


def triples() -> list[tuple[int, ...]]:
    """20 triples of the 8 positions such that any 4 positions hold one: Turan's construction on groups of 3, 3 and 2.

    A triple is taken if it lies in one group, or has two positions of a group and one of the next group.
    """
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    def taken(t):
        g = [group[p] for p in t]
        return len(set(g)) == 1 or any(g.count(x) == 2 and g.count((x + 1) % 3) == 1 for x in range(3))
    return [t for t in combinations(range(8), 3) if taken(t)]


def positional(prints: np.ndarray) -> np.ndarray:
    """A row of 8 bytes for each fingerprint."""
    return prints.astype(">u8" if prints.dtype == np.uint64 else ">i8").view(np.uint8).reshape(-1, 8)


def postings(nodes: DataFrame) -> DataFrame:
    """key (triple and its bytes), fingerprint."""
    chosen = triples()

    def post(batches):
        for batch in small_batches(batches, 8192):
            prints = batch.column(0).to_numpy(zero_copy_only=False)
            b = positional(prints).astype(np.int64)
            keys = np.concatenate([k << 24 | b[:, x] << 16 | b[:, y] << 8 | b[:, z] for k, (x, y, z) in enumerate(chosen)])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.tile(prints, len(chosen)))], names=["key", "fingerprint"])

    return nodes.select("fingerprint").mapInArrow(lean(post), "key long, fingerprint long")


def links(prints: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Links of a list that make its parts: at most one fewer than it has members. Pairs are compared in blocks."""
    prints = np.unique(prints.view(np.uint64))
    shown, part, found = positional(prints), np.arange(len(prints)), []
    for a in range(0, len(prints), 512):
        for z in range(a, len(prints), 512):
            tally = (shown[a : a + 512, None, :] == shown[None, z : z + 512, :]).sum(2)
            near = (tally >= 8 - bits) & (np.bitwise_count(prints[a : a + 512, None] ^ prints[None, z : z + 512]) <= bits)
            for i in np.flatnonzero(near.any(1)):
                for j in np.flatnonzero(near[i] & (part[z : z + 512] != part[a + i])):
                    if part[z + j] != part[a + i]:
                        found.append((a + i, z + j))
                        part[part == part[z + j]] = part[a + i]
    signed = prints.view(np.int64).tolist()
    return [(signed[i], signed[j]) for i, j in found]


def linked(listed: DataFrame, bits: int) -> DataFrame:
    """a, b: links of the lists of (key, fingerprint). A task streams its lists in key order."""

    def meet(batches):
        keys = prints = np.zeros(0, np.int64)
        for batch in chain(small_batches(batches, 65536), [None]):
            if batch is not None:
                more = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                keys, prints = np.concatenate([keys, more[0]]), np.concatenate([prints, more[1]])
            if not len(keys):
                continue
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            ends = np.append(starts[1:], len(keys))
            if batch is not None:  # the last list may go on
                starts, ends, rest = starts[:-1], ends[:-1], starts[-1]
            else:
                rest = len(keys)
            two = starts[ends - starts == 2]
            a, b = prints[two], prints[two + 1]
            near = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= bits
            near &= (positional(a) == positional(b)).sum(1) >= 8 - bits
            out = list(zip(a[near].tolist(), b[near].tolist(), strict=True))
            for x, y in zip(*(e[ends - starts > 2].tolist() for e in (starts, ends)), strict=True):
                out += links(prints[x:y], bits)
            if out:
                yield pair_batch(out)
            keys, prints = keys[rest:], prints[rest:]

    return listed.sortWithinPartitions("key").mapInArrow(lean(meet), "a long, b long")


def pair_batch(pairs: list) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """a, b: links that make the components of the fingerprints in nodes, each fingerprint once."""
    if not 0 <= bits <= 4:
        raise ValueError("the index guarantees 4 equal positional bytes only for up to 4 bits")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posted = written(postings(nodes), "postings")
    long_lists = written(posted.groupBy("key").count().where(F.col("count") > BLOCK).select("key"), "long")
    if long_lists.isEmpty():
        return linked(posted.repartition(n, "key"), bits)
    short = posted.join(long_lists, "key", "left_anti")
    # A pair in a long list shares a fourth positional byte: deal the list by each position and byte outside its triple.
    byte_at = lambda p: F.shiftrightunsigned("fingerprint", 56 - 8 * p).bitwiseAND(F.lit(255))
    fourth = F.array(*(F.struct(F.lit(p).alias("p"), byte_at(p).alias("byte")) for p in range(8)))
    triple_of = F.array(*(F.array(*map(F.lit, t)) for t in triples()))
    dealt = (
        posted.join(long_lists, "key", "left_semi")
        .withColumn("at", F.explode(fourth))
        .where(~F.array_contains(F.element_at(triple_of, (F.shiftright("key", 24) + 1).cast("int")), F.col("at.p")))
        .select((F.shiftleft("key", 11) + F.col("at.p") * 256 + F.col("at.byte")).alias("key"), "fingerprint")
    )
    return linked(short.select("key", "fingerprint").repartition(n, "key"), bits).unionByName(linked(dealt.repartition(n, "key"), bits))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root for the nodes that have links; nodes: (fingerprint, first); root: the smallest `first` reachable.

    Each round a node takes the smallest label among its neighbours and itself, and then the label of the node
    that owns that label, which halves the way that is left. Only nodes with links take part.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "edges")
    label = written(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while True:
        seen = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = label.join(seen, label["node"] == seen["a"]).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        lower = written(lower, "lower")
        above = lower.select(F.col("node").alias("owner"), F.col("label").alias("above"))
        jumped = written(lower.join(above, lower["label"] == above["owner"], "left").select("node", "was", F.least("label", F.coalesce("above", "label")).alias("label")), "labels")
        label = jumped.select("node", "label")
        if jumped.where("was <> label").isEmpty():
            break
    own = nodes.join(label, nodes["fingerprint"] == label["node"]).select("node", "label", "first")
    roots = own.groupBy("label").agg(F.min("first").alias("root"))
    return own.select("node", "label").join(roots, "label").select("node", "root")


def near_components(docs: DataFrame, ident="doc_id", text="text", shingle=SHINGLE, bits=BITS) -> DataFrame:
    """doc_id, fingerprint (long), component_id of every row."""
    marked = written(fingerprints(docs, ident, text, shingle), "fingerprints")
    nodes = written(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "nodes")
    edges = written(near_links(nodes, bits), "links")
    roots = components(nodes, edges)
    named = written(nodes.join(roots, nodes["fingerprint"] == roots["node"], "left").select(F.col("fingerprint").alias("print"), F.coalesce("root", "first").alias("component_id")), "components")
    return marked.join(named, marked["fingerprint"] == named["print"]).select("doc_id", "fingerprint", "component_id")


def near_report(docs: DataFrame, ident="doc_id", text="text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return near_components(docs, ident, text).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def text_key(text: Column | str) -> Column:
    """SHA-256 of a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256))


def marked_rows(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """rows with _marked: whether the bit table of keys has their key. False hits occur; no row leaves its place."""
    placed, pages = rows.withColumn("_spot", spot_of(key)), F.broadcast(repeated_pages(keys.select("key", F.lit(2).alias("n"))))
    bit = F.bitmap_bit_position("_spot")
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(F.getbit(byte, (bit % 8).cast("int")), F.lit(0)) == 1
    return placed.join(pages, F.bitmap_bucket_number("_spot") == F.col("page"), "left").select(*(F.col(f"`{c}`") for c in rows.columns), marked.alias("_marked"))


def one_of_each(docs: DataFrame, ident: str, text: str, group) -> DataFrame:
    """docs with one row of each component that group finds, that of the smallest id; null ids come last.

    A row is named by its id and the SHA-256 of its text, so rows that share an id, or have none, are decided each for itself;
    of different texts with the smallest id, that of the smaller SHA-256 stays.
    """
    own = F.struct(F.col(ident).isNull().alias("no_id"), F.col(ident).alias("id"), text_key(text).alias("key"))
    found = group(docs.select(own.alias("doc_id"), F.col(text).alias("text")))
    dropped = written(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct(), "dropped")
    twice = written(found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id")), "twice")
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), own.alias("_own"))
    checked = marked_rows(row, F.col("_own.key"), dropped.unionByName(twice).select("_id.key"))
    alone, asked = checked.where("NOT _marked").select("row"), checked.where("_marked").select("row", "_own")
    kept = asked.join(dropped, asked["_own"].eqNullSafe(dropped["_id"]), "left_anti")
    if twice.isEmpty():
        return alone.unionByName(kept.select("row")).select("row.*")
    match = kept["_own"].eqNullSafe(twice["_id"])
    repeated = kept.join(twice, match, "left_semi").dropDuplicates(["_own"]).select("row")
    return alone.unionByName(kept.join(twice, match, "left_anti").select("row")).unionByName(repeated).select("row.*")


def drop_near(docs: DataFrame, ident="doc_id", text="text", shingle=SHINGLE, bits=BITS) -> DataFrame:
    """docs with one row of each component, that of the smallest id, and the columns of docs."""
    return one_of_each(docs, ident, text, lambda named: near_components(named, "doc_id", "text", shingle, bits))
