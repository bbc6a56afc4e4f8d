"""Quality by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE bytes. Each passage is encoded by what it is made of: byte kinds, kinds of
neighbouring bytes, word lengths, words that repeat. A hidden layer represents it, gated attention
(tanh times sigmoid) gives it a weight in its text, and the weighted representation is scored. Attention, encoding layer and
score are learnt together from the labels of whole texts, by Adam in numpy on the driver, on at most PER_CLASS
labelled texts of each class, with at most BAG passages of each, spread over the text. Scoring uses every passage.

Learning uses only rows whose crc32(id) modulo FOLDS isn't HELD_OUT; ids with contradicting labels are left
out; of different texts with one id that of the smallest hash is learnt from. Texts are worked through in runs of BLOCK bytes, so a very long one
costs no more memory than others; it is cut between passages. Defined results: null and empty texts have one empty passage and the score that it gets; without both classes
to learn from, every score is the share of label 1 (0.5 without labels); rows with a null id are scored;
repeated rows give repeated results; an empty table gives an empty result; other columns, whatever their names, are ignored (`keep_good` keeps them).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.shared import byte_buffer, crc_mod, lean, sized_batches, unit_hash

FOLDS, HELD_OUT = 3, 1
PASSAGE, PER_CLASS, BAG, BLOCK = 512, 1500, 16, 512 * 1024
HIDDEN, GATE, EPOCHS, BATCH, RATE, SEED, DECAY = 16, 8, 24, 128, 0.01, 5, 1e-4
KINDS = 24


def byte_kinds() -> np.ndarray:
    """Byte to kind: lower, upper, digit, blank, line end, 16 kinds of ASCII punctuation, controls, lead and following bytes of UTF-8."""
    kind = np.full(256, 21, np.uint8)
    kind[ord("a") : ord("z") + 1], kind[ord("A") : ord("Z") + 1], kind[ord("0") : ord("9") + 1] = 0, 1, 2
    kind[ord(" ")] = kind[ord("\t")] = 3
    kind[ord("\n")] = kind[ord("\r")] = 4
    marks = [b".", b",", b"!?", b";:", b"'\"`", b"-", b"_", b"()", b"[]{}", b"<>", b"/\\", b"|", b"#", b"$%&", b"*^~", b"@+="]
    for k, some in enumerate(marks):
        kind[list(some)] = 5 + k
    kind[0x80:0xC0], kind[0xC0:] = 23, 22
    return kind


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features (passages, FEATURES) and the text of each passage. The last passage of a text takes a rest of under half a passage."""
    n, size = len(offsets) - 1, np.diff(offsets)
    per = np.maximum(1, (size + PASSAGE // 2) // PASSAGE)
    first = per.cumsum() - per
    owner = np.repeat(np.arange(n), per)
    count = int(per.sum())
    text_of = np.repeat(np.arange(n), size)
    spot = np.minimum((np.arange(len(data)) - offsets[text_of]) // PASSAGE, per[text_of] - 1) + first[text_of]
    kind = byte_kinds()[data].astype(np.int64)
    hist = np.bincount(spot * KINDS + kind, minlength=count * KINDS).reshape(count, KINDS).astype(np.float32)
    length = np.maximum(1, hist.sum(1))

    same_text = text_of[1:] == text_of[:-1]
    coarse = np.array([0, 0, 1, 2, 2] + [3] * 16 + [4, 0, 0])[kind]
    pairs = np.bincount((spot[1:] * 25 + coarse[:-1] * 5 + coarse[1:])[same_text], minlength=count * 25).reshape(count, 25)

    # Words: what lies between blanks. A word's hash is a sum of its bytes by their places in the word.
    blank = (kind == 3) | (kind == 4)
    begins = ~blank
    begins[1:] &= blank[:-1] | ~same_text
    starts = np.flatnonzero(begins)
    extra = np.zeros((count, 6), np.float32)
    if len(starts):
        at = np.arange(len(data), dtype=np.int64)
        inside = (at - starts[np.maximum(begins.cumsum() - 1, 0)]).astype(np.uint64)  # of blanks it isn't used
        mixed = (data.astype(np.uint64) + np.uint64(1)) * ((inside + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        mixed ^= mixed >> np.uint64(29)
        mixed[blank] = 0
        word = np.add.reduceat(mixed, starts)
        of = spot[starts]
        words = np.bincount(of, minlength=count)
        letters = np.add.reduceat((~blank).astype(np.int64), starts)
        again = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
        again2 = (word[2:] == word[:-2]) & (of[2:] == of[:-2])
        ordered = np.sort((of.astype(np.uint64) << np.uint64(40)) | (word >> np.uint64(24)))
        different = np.bincount((ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] >> np.uint64(40)).astype(np.int64), minlength=count)
        some = np.maximum(words, 1)
        extra[:, 0] = words * 8 / length
        extra[:, 1] = np.bincount(of, letters, minlength=count) / some / 8
        extra[:, 2] = np.bincount(of[1:][again], minlength=count) / some
        extra[:, 3] = np.bincount(of[2:][again2], minlength=count) / some
        extra[:, 4] = different / some
        extra[:, 5] = np.sqrt(np.bincount(of, letters.astype(float) ** 2, minlength=count) / some) / 8
    log_size = np.log1p(length)[:, None] / 8
    return np.concatenate([np.sqrt(hist / length[:, None]), np.sqrt(pairs / length[:, None]), extra, log_size], axis=1).astype(np.float32), owner


FEATURES = KINDS + 25 + 6 + 1


def all_passages(data: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """passages() of texts of any length, in runs of about `block` bytes: a longer text is cut between passages."""
    size = np.diff(offsets)
    per = np.maximum(1, -(-size // block))
    text = np.repeat(np.arange(len(size)), per)
    begin = offsets[text] + (np.arange(len(text)) - np.repeat(per.cumsum() - per, per)) * block
    ends, found, k = np.append(begin[1:], offsets[-1]), [], 0
    while k < len(text):
        z = max(k + 1, int(np.searchsorted(ends, begin[k] + block, "right")))
        x, own = passages(data[begin[k] : ends[z - 1]], np.append(begin[k:z], ends[z - 1]) - begin[k])
        found.append((x, text[k:z][own]))
        k = z
    if not found:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([own for _, own in found])


@dataclass
class Attention:
    """A text's score: sigmoid(top . sum of weight * h), h = tanh(x W + b), weight = softmax of pick . (tanh(h V) * sigmoid(h U))."""

    mean: np.ndarray
    scale: np.ndarray
    w: list

    @classmethod
    def fresh(cls, x: np.ndarray) -> Attention:
        r = np.random.Generator(np.random.PCG64(SEED))
        shapes = [(FEATURES, HIDDEN), (HIDDEN,), (HIDDEN, GATE), (HIDDEN, GATE), (GATE,), (HIDDEN,), (1,)]
        return cls(x.mean(0), x.std(0) + 1e-2, [r.standard_normal(s) * (0.0 if len(s) == 1 and s[0] != GATE and s[0] != HIDDEN else 1 / np.sqrt(s[0])) for s in shapes])

    def forward(self, x: np.ndarray, owner: np.ndarray, n: int) -> tuple:
        w, b, v, u, pick, top, bias = self.w
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ w + b)
        tv, su = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        a = (tv * su) @ pick
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        a = np.exp(a - np.maximum.reduceat(a, first)[owner])
        a /= np.add.reduceat(a, first)[owner]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return x, h, tv, su, a, z, 1 / (1 + np.exp(-(z @ top + bias[0]))), first

    def gradients(self, x, owner, y, weight) -> list:
        w, b, v, u, pick, top, bias = self.w
        x, h, tv, su, a, z, p, first = self.forward(x, owner, len(y))
        e = (p - y) * weight / weight.sum()
        gz = e[:, None] * top
        ga = (gz[owner] * h).sum(1)
        ga = a * (ga - np.add.reduceat(a * ga, first)[owner])
        gt, gs = ga[:, None] * pick * su * (1 - tv**2), ga[:, None] * pick * tv * su * (1 - su)
        gh = a[:, None] * gz[owner] + gt @ v.T + gs @ u.T
        gx = gh * (1 - h**2)
        return [x.T @ gx, gx.sum(0), h.T @ gt, h.T @ gs, (tv * su).T @ ga, z.T @ e, np.array([e.sum()])]

    def fit(self, x, owner, y, weight) -> Attention:
        """x: passages of the bags in order. The same result on each run."""
        r, n, step = np.random.Generator(np.random.PCG64(SEED)), len(y), 0
        starts = np.searchsorted(owner, np.arange(n + 1))
        first, second = ([np.zeros_like(a) for a in self.w] for _ in range(2))
        for epoch in range(EPOCHS):
            order = r.permutation(n)
            for k in range(0, n, BATCH):
                bags, step = order[k : k + BATCH], step + 1
                rows = np.concatenate([np.arange(starts[b], starts[b + 1]) for b in bags])
                own = np.repeat(np.arange(len(bags)), starts[bags + 1] - starts[bags])
                for a, g, m, s in zip(self.w, self.gradients(x[rows], own, y[bags], weight[bags]), first, second, strict=True):
                    g = g + DECAY * a
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    a -= RATE * (1 - epoch / EPOCHS) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        return self


def labelled_bags(docs: DataFrame, labels: DataFrame) -> tuple:
    """Passages, their bags, labels and weights of a bounded sample, and the share of label 1 among the usable labels."""
    clear = labels.where((crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most")
    counts = {r["quality"]: r["count"] for r in clear.groupBy("quality").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(counts) < 2:
        return None, None, None, None, share if counts else 0.5
    drawn = unit_hash(F.col("doc_id"), "quality")
    parts = [clear.where(F.col("quality") == q).orderBy(drawn, "doc_id").limit(PER_CLASS) for q in (0, 1)]
    sample = parts[0].unionByName(parts[1]).select("doc_id", "quality")  # at most 2 * PER_CLASS ids: a bounded broadcast
    ids = docs.sparkSession.createDataFrame(sample.collect(), sample.schema) if counts else sample

    def encode(batches):
        for batch in sized_batches(batches, 2, 4 << 20, 64):
            x, owner = all_passages(*byte_buffer(batch.column(2)))
            rows = []
            for k in range(batch.num_rows):
                own = np.flatnonzero(owner == k)
                own = own[np.unique(np.linspace(0, len(own) - 1, BAG).round().astype(int))]
                rows.append(x[own].ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(rows, pa.list_(pa.float32())), batch.column(3)], names=["doc_id", "quality", "x", "hash"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = docs.join(F.broadcast(ids), "doc_id").select("doc_id", "quality", "text", F.xxhash64("text").alias("hash")).mapInArrow(lean(encode), f"doc_id {id_type}, quality int, x array<float>, hash long")
    found = found.groupBy("doc_id").agg(F.min(F.struct("hash", "quality", "x")).alias("one")).select("doc_id", "one.quality", "one.x").toPandas().sort_values("doc_id")
    y = found["quality"].to_numpy(dtype=float)
    if len(set(y)) < 2:
        return None, None, None, None, share
    bags = [np.asarray(x, np.float32).reshape(-1, FEATURES) for x in found["x"]]
    # Weights undo the sample's shares of the classes, so that a score of 0.5 means what the labels say.
    weight = np.where(y == 1, share / (y == 1).mean(), (1 - share) / (y == 0).mean())
    return np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), y, weight, share


def quality_report(docs: DataFrame, labels: DataFrame, ident="doc_id", text="text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    plain = docs.select(F.col(ident).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rated = scored(plain, labels)
    held = F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return rated.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def scored(plain: DataFrame, labels: DataFrame) -> DataFrame:
    """The id of each row and its score; plain: doc_id, text."""
    x, owner, y, weight, share = labelled_bags(plain, labels.select("doc_id", "quality"))
    known = plain.sparkSession.sparkContext.broadcast((None if x is None else Attention.fresh(x).fit(x, owner, y, weight), share))

    def score(batches):
        model, common = known.value
        for batch in sized_batches(batches, 1, 4 << 20, 512):
            if model is None:
                p = np.full(batch.num_rows, common)
            else:
                features, own = all_passages(*byte_buffer(batch.column(1)))
                p = model.forward(features, own, batch.num_rows)[6]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return plain.mapInArrow(lean(score), f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, labels: DataFrame, ident="doc_id", text="text") -> DataFrame:
    """docs without the rows that score below 0.5, with the columns of docs; the model runs over each row in place."""
    plain = docs.select(F.col(ident).alias("doc_id"), F.col(text).cast("string").alias("text"))
    x, owner, y, weight, share = labelled_bags(plain, labels.select("doc_id", "quality"))
    known = docs.sparkSession.sparkContext.broadcast((None if x is None else Attention.fresh(x).fit(x, owner, y, weight), share))
    at = docs.columns.index(text)

    def keep(batches):
        model, common = known.value
        for batch in sized_batches(batches, at, 4 << 20, 512):
            if model is None:
                yield batch if common >= 0.5 else batch.slice(0, 0)
            else:
                features, own = all_passages(*byte_buffer(batch.column(at)))
                yield batch.filter(pa.array(model.forward(features, own, batch.num_rows)[6] >= 0.5))

    return docs.mapInArrow(lean(keep), docs.schema)
