"""Near copies by SimHash fingerprints, then an exact check by the Jaccard similarity of five-word shingle sets, 4/5 or more, with no pair missed.

Fingerprints are those of `simhash` over a set's shingles, and its byte-position index with count filtering finds those within
4 bits. Texts of similarity 4/5 differ in some 10 bits, more than that index reaches: a second, exact index finds the rest. Candidates of both
go through the same check, and only what passes it is linked; the result is that of all pairs.

Words and shingles are those of `simhash`, with five words; a shingle stands as its XXH64, and a set counts each once.
Equal sets are one node. Two sets of similarity 4/5 share a shingle among the first n - ceil(4n/5) + 1 of each, in
any order that is one for all sets. The index lists nodes under those shingles, with the shingles that a sample of texts
finds common last; the order decides the cost, not the result. Pairs of a list pass three filters, none of which
loses a pair: their sizes, the parity sketches of their sets, whose differing bits are at most the differing shingles (a large
set has a wide sketch besides), and the sets themselves. Sets are made once more from the texts, where a text meets those that it is
compared with: first each node with its neighbours by fingerprint and its smallest one by the second index, then the pairs of which the components so far don't hold both.

Lists of up to LONG nodes send on their pairs. In a longer one nodes carry their sketches: the list is dealt to stars, each of a
central node and those that its sketch can't tell from like it. Stars are decided, then one pair of each two components that have one,
then all pairs that pass the sketches and whose nodes are still in different components. So a large group of near copies sends on a few pairs a node, whatever its size; unlike nodes of
a long list are compared where the list is and cost no rows. Defined results: texts without words, null ones too, are
one node; an empty table gives an empty result; extra columns, whatever their names, stay with their row.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.shared import byte_texts, lean, sized_batches, small_batches, written
from codeloom.llm.simhash import SEED, components, marked_rows, near_links, one_of_each, ones, pair_batch, print_of

SHINGLE = 5
#: Bits of a parity sketch, and of the second one that a large set has in a list; lists beyond LONG go by stars first; texts of the sample and common shingles taken from it.
SKETCH, BROAD, LONG, SAMPLE, COMMON = 1024, 4096, 3, 16384, 65536
#: Texts that are compared with one centre in one place.
STAR = 256
#: Stars: candidates for a centre, nodes that they are tried on, and how many poor stars in a row end the search.
CENTRES, TRIED, POOR = 32, 256, 16


def shingles(text: bytes) -> np.ndarray:
    """The different shingles' hashes in ascending order."""
    words = text.lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(joined, SEED)] if words else [], np.uint64)
    after = (np.fromiter(map(len, words), np.int64, len(words)) + 1).cumsum()
    starts = [0, *after[:-SHINGLE].tolist()]
    return np.unique(np.array([digest(joined[a:z], SEED) for a, z in zip(starts, (after[SHINGLE - 1 :] - 1).tolist(), strict=True)], np.uint64))


def node_of(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64))


def set_print(found: np.ndarray) -> int:
    """The SimHash fingerprint of a set of shingles, each counted once, as a signed long."""
    total = sum((ones(found[k : k + 65536].astype(">u8")) for k in range(0, len(found), 65536)), np.zeros(64, np.int64))
    return int(np.uint64(print_of(total, len(found))).astype(np.int64))


def sketch_of(found: np.ndarray, bits: int) -> bytes:
    """The parity of the shingles at each of so many places, a power of 2."""
    return np.packbits(np.bincount((found >> np.uint64(32)).astype(np.int64) & (bits - 1), minlength=bits) & 1).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Differing bits of two sketches; the larger is folded to the size of the other."""
    x, y = (np.frombuffer(v, np.uint64) for v in (x, y))
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, n), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles of a sample, ascending, with their counts: at most COMMON."""

    def each(batches):
        for batch in small_batches(batches):
            found = [shingles(t) for t in byte_texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["h"])

    every = max(1, docs.count() // SAMPLE)
    some = docs.select(F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    top = some.mapInArrow(lean(each), "h long").groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).collect()
    top = sorted((r.h % 2**64, r["count"]) for r in top)
    return np.array([h for h, _ in top], np.uint64), np.array([n for _, n in top], np.int64)


def marked_texts(docs: DataFrame) -> DataFrame:
    """doc_id, node, n (size of the set), prefix (its indexed shingles), sketch, wide and broad (those of a large set), print. A task that has seen the node leaves its prefix empty."""
    order = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))

    def mark(batches):
        common, counts = order.value
        seen: set = set()
        for batch in small_batches(batches):
            nodes, sizes, prefixes, sketches, wide, broad, prints = [], [], [], [], [], [], []
            for t in byte_texts(batch.column(1)):
                h = shingles(t)
                weight = np.zeros(len(h), np.int64)
                if len(common) and len(h):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    weight = np.where(common[at] == h, counts[at], 0)
                nodes.append(node := node_of(h))
                sizes.append(len(h))
                prefixes.append(h[np.lexsort((h, weight))[: 0 if node in seen else len(h) - -(-4 * len(h) // 5) + 1]].view(np.int64))
                if len(seen) >= 300_000:
                    seen.clear()
                seen.add(node)
                sketches.append(sketch_of(h, SKETCH))
                prints.append(set_print(h))
                wide.append(sketch_of(h, 1 << (len(h) - 1).bit_length()) if len(h) > SKETCH else None)
                broad.append(sketch_of(h, BROAD) if len(h) > SKETCH else None)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefixes)]), pa.int32()), pa.array(np.concatenate(prefixes) if prefixes else []))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), lists, pa.array(sketches, pa.binary()), pa.array(wide, pa.binary()), pa.array(broad, pa.binary()), pa.array(prints, pa.int64())], names=["doc_id", "node", "n", "prefix", "sketch", "wide", "broad", "print"])

    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(lean(mark), f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, node long, n int, prefix array<long>, sketch binary, wide binary, broad binary, print long")


def three(rows: list) -> pa.RecordBatch:
    a, b, n = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int32())], names=["a", "b", "n"])


def whole_lists(batches, read):
    """The columns of each whole list of rows that are sorted by their first column; read turns a batch to arrays."""
    held = None
    for batch in chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            more = read(batch)
            held = more if held is None else [np.concatenate([x, y]) for x, y in zip(held, more, strict=True)]
        if held is None:
            return
        keys = held[0]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        ends = np.append(starts[1:], len(keys))
        if batch is not None:  # the last list may go on
            starts, ends, rest = starts[:-1], ends[:-1], starts[-1]
        else:
            rest = len(keys)
        for x, z in zip(*(e[ends - starts > 1].tolist() for e in (starts, ends)), strict=True):
            yield [c[x:z] for c in held]
        held = [c[rest:] for c in held]


def by_key(listed: DataFrame) -> DataFrame:
    n = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(n, "h").sortWithinPartitions("h")


def met(listed: DataFrame) -> DataFrame:
    """a, b, n of the lists of (h, node, n): pairs of like sizes with n = -1 from a list of up to LONG nodes, else its rows as (h, node, n)."""

    def meet(batches):
        said, out = set(), []
        numbers = lambda batch: [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        for keys, nodes, sizes in whole_lists(small_batches(batches, 65536), numbers):
            node, first = np.unique(nodes, return_index=True)
            size = sizes[first]
            if len(node) > LONG:
                out += [(keys[0], *row) for row in zip(node.tolist(), size.tolist(), strict=True)]
            else:
                for i in range(len(node) - 1):
                    like = 5 * np.minimum(size[i], size[i + 1 :]) >= 4 * np.maximum(size[i], size[i + 1 :])
                    for b in node[i + 1 :][like].tolist():
                        if (pair := (int(node[i]), b)) not in said:
                            if len(said) >= 300_000:
                                said.clear()
                            said.add(pair)
                            out.append((*pair, -1))
            if len(out) > 65536:
                yield three(out)
                out = []
        if out:
            yield three(out)

    return by_key(listed.select("h", "node", F.col("n").cast("long"))).mapInArrow(lean(meet), "a long, b long, n int")


def alike(sizes: np.ndarray, sketches: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Which of the others the sketch of i doesn't tell from sets of similarity 4/5."""
    n, m = sizes[i], sizes[others]
    near = 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)
    own = SKETCH // 64
    near[near] = 9 * np.bitwise_count(sketches[others[near], :own] ^ sketches[i, :own]).sum(1, dtype=np.int64) <= n + m[near]
    if n > SKETCH:
        large = np.flatnonzero(near & (m > SKETCH))
        near[large] = 9 * np.bitwise_count(sketches[others[large], own:] ^ sketches[i, own:]).sum(1, dtype=np.int64) <= n + m[large]
    return near


def spread(of: np.ndarray, n: int) -> np.ndarray:
    return of[np.linspace(0, len(of) - 1, min(n, len(of))).astype(np.int64)]


def stars(labels: np.ndarray, sizes: np.ndarray, sketches: np.ndarray):
    """centre, others: the likes of central nodes, each node in one star at most. The centre has the most likes among a few tried."""
    free, poor = np.arange(len(sizes)), 0
    while len(free) > 1 and poor < POOR:
        tried = spread(free, TRIED)
        centre = max(spread(free, CENTRES).tolist(), key=lambda i: int(alike(sizes, sketches, i, tried).sum()))
        near = alike(sizes, sketches, centre, free)
        poor = poor + 1 if near.sum() < 3 else 0
        yield centre, free[near & (free != centre)]
        free = free[~near & (free != centre)]


def across(labels: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, every: bool = True):
    """centre, others: all likes of different labels, each pair once. Nodes of the commonest label are not looked at from their side.

    Without `every`, a node has one like of each label, and two labels have one pair.
    """
    names, label, count = np.unique(labels, return_inverse=True, return_counts=True)
    order, met_ = np.argsort(label == count.argmax(), kind="stable"), set()
    for k, i in enumerate(order[: len(order) - count.max()].tolist()):
        others = order[k + 1 :][label[order[k + 1 :]] != label[i]]
        near = others[alike(sizes, sketches, i, others)]
        if not every and len(near):
            near = near[np.unique(label[near], return_index=True)[1]]
            near = near[[(min(label[i], x), max(label[i], x)) not in met_ for x in label[near].tolist()]]
            met_.update((min(label[i], x), max(label[i], x)) for x in label[near].tolist())
        yield i, near


def across_once(labels: np.ndarray, sizes: np.ndarray, sketches: np.ndarray):
    return across(labels, sizes, sketches, False)


def compared(rows: DataFrame, nodes: DataFrame, rule) -> DataFrame:
    """a, b: what rule finds in each list of (h, node, n, label)."""

    def read(batch):
        numbers = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:4]]
        none = bytes(BROAD // 8)
        both = b"".join(x + (y or none) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True))
        return [*numbers, np.frombuffer(both, np.uint64).reshape(-1, (SKETCH + BROAD) // 64)]

    def compare(batches):
        for _, node, size, label, sketch in whole_lists(small_batches(batches, 8192), read):
            for i, others in rule(label, size, sketch):
                if len(others):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(others), node[i])), pa.array(node[others])], names=["a", "b"])

    told = rows.join(nodes.select("node", "sketch", "broad"), "node").select("h", "node", F.col("n").cast("long"), "label", "sketch", "broad")
    pairs = by_key(told).mapInArrow(lean(compare), "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def of_both(pairs: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
    """pairs with the columns of both nodes, as a_ and b_."""
    for side in "ab":
        other = of.select(F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns))
        pairs = pairs.join(other, side)
    return pairs.select("a", "b", *(f"{side}_{c}" for c in columns for side in "ab"))


def sketched(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: the pairs that their sketches don't tell apart, each once, written."""

    def near(batches):
        for batch in small_batches(batches, 4096):
            if not batch.num_rows:
                continue
            na, nb = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            sa, sb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, SKETCH // 64) for k in (4, 5))
            keep = 9 * np.bitwise_count(sa ^ sb).sum(1, dtype=np.int64) <= na + nb
            for k in np.flatnonzero(keep & (np.minimum(na, nb) > SKETCH)).tolist():
                keep[k] = 9 * apart(batch.column(6)[k].as_py(), batch.column(7)[k].as_py()) <= na[k] + nb[k]
            yield batch.select([0, 1]).filter(pa.array(keep))

    return written(of_both(pairs.distinct(), nodes, "n", "sketch", "wide").mapInArrow(lean(near), "a long, b long"), "near")


def decided(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b: the pairs of similarity 4/5 or more, written. pairs: each once, a is the centre of its star.

    The texts of a star meet in one place; a star of more than STAR is dealt to several, each with its centre.
    """

    def compare(batches):
        centre = held = last = None
        for batch in sized_batches(batches, 4, 8 << 20, 256):
            found = []
            texts = byte_texts(batch.column(4))
            for k, (c, part, member, node) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True)):
                if centre != (c, part):
                    centre, held, last = (c, part), None, None
                if not member:
                    held = shingles(texts[k]) if held is None else held
                elif node != last:  # rows may be repeated
                    own, last = shingles(texts[k]), node
                    if 9 * len(np.intersect1d(held, own, assume_unique=True)) >= 4 * (len(held) + len(own)):
                        found.append((c, node))
            if found:
                yield pair_batch(found)

    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("parts"))
    members = pairs.join(size, "a").select(F.col("b").alias("node"), F.col("a").alias("centre"), F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.lit(True).alias("member"))
    centres = size.select(F.col("a").alias("node"), F.col("a").alias("centre"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member"))
    roles = written(members.unionByName(centres).join(nodes.select("node", F.col("first").alias("_first")), "node"), "roles")
    own = docs.select(F.col("doc_id").alias("own"), F.col("text").cast("string").alias("text"))
    texts = marked_rows(own, F.col("own.key"), roles.select("_first.key")).where("_marked").join(roles, F.col("own").eqNullSafe(F.col("_first")))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met_ = texts.select("centre", "part", "member", "node", "text").repartition(n, "centre", "part").sortWithinPartitions("centre", "part", "member", "node")
    return written(met_.mapInArrow(lean(compare), "a long, b long"), "similar")


def near_prints(nodes: DataFrame) -> DataFrame:
    """a, b: nodes whose fingerprints are equal or within 4 bits, a below b: as few as make their components. nodes: (node, print)."""
    heads = written(nodes.groupBy(F.col("print").alias("fingerprint")).agg(F.min("node").alias("head")), "prints")
    head = lambda side: heads.select(F.col("fingerprint").alias(side), F.col("head").alias(f"{side}_head"))
    linked = near_links(heads.select("fingerprint")).distinct().join(head("a"), "a").join(head("b"), "b").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    equal = nodes.join(heads, F.col("print") == F.col("fingerprint")).where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    return linked.unionByName(equal).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def similar_components(docs: DataFrame) -> DataFrame:
    """doc_id, component_id of every row of (doc_id, text); doc_id as `simhash.one_of_each` makes it."""
    marked = written(marked_texts(docs), "marked")
    nodes = written(marked.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide"), F.first("broad").alias("broad"), F.first("print").alias("print")), "nodes")
    found = written(met(marked.select(F.explode("prefix").alias("h"), "node", "n")), "met")
    pairs = found.where("n < 0").select("a", "b")
    long = found.where("n >= 0").select(F.col("a").alias("h"), F.col("b").alias("node"), "n")
    some = not long.isEmpty()
    near = sketched(pairs.unionByName(compared(long.withColumn("label", F.col("node")), nodes, stars)) if some else pairs, nodes)
    alike_prints = sketched(near_prints(nodes), nodes)
    links = decided(alike_prints.unionByName(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")).distinct(), nodes, docs)
    named = nodes.select(F.col("node").alias("fingerprint"), F.col("node").alias("first"))

    def unlinked(pairs: DataFrame, parts: DataFrame) -> DataFrame:
        """The pairs of two components that aren't known as unlike."""
        of = lambda side: parts.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
        both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
        return both.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")

    parts = components(named, links)
    links = links.unionByName(decided(written(unlinked(near, parts), "apart"), nodes, docs))
    # In long lists: one pair of each two components, then, of what is still apart, all.
    for rule in (across_once, across) if some else ():
        parts = components(named, links)
        labelled = long.join(parts, "node", "left").select("h", "node", "n", F.coalesce("root", "node").alias("label"))
        more = sketched(written(compared(labelled, nodes, rule), "across"), nodes)
        known_pairs = near if rule is across_once else near.unionByName(seen)
        seen = more
        links = links.unionByName(decided(written(more.join(known_pairs, ["a", "b"], "left_anti"), "apart"), nodes, docs))
    roots = components(nodes.select(F.col("node").alias("fingerprint"), "first"), links)
    named = written(nodes.select("node", "first").join(roots, "node", "left").select("node", F.coalesce("root", "first").alias("component_id")), "components")
    return marked.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")


def drop_similar(docs: DataFrame, ident="doc_id", text="text") -> DataFrame:
    """docs with one row of each component, that of the smallest id, and the columns of docs."""
    return one_of_each(docs, ident, text, similar_components)
