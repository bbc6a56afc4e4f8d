"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of SPAN bytes in both directions, gives every byte position a distribution over the
languages, and a text's distribution is the mean over all its positions. Gates use the piecewise linear
sigmoid and states x / (1 + |x|), which numpy computes fast. It is trained on the driver with
backpropagation through time and Adam on at most PER_LANGUAGE texts of each of the MOST_LANGUAGES commonest languages,
PIECES windows of each; scoring reads every byte of every text, many windows in step.

Learning uses only the text and the non-null language of rows whose crc32(id) modulo FOLDS isn't HELD_OUT.
Defined results: a null text, or one without a letter, is `und` with score 0; without any row to learn from all
are `und`; ties go to the language that sorts first; rows with a null id are scored but never learnt from;
repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.shared import byte_buffer, crc_mod, sized_batches, unit_hash

FOLDS, HELD_OUT = 4, 2
TEXTS, PER_LANGUAGE, PIECES = 25600, 400, 3
SPAN, LANES, HIDDEN = 128, 2048, 8
STEPS, TRAIN_LANES, TRAIN_SPAN, RATE, SEED = 260, 192, 64, 0.02, 11


def gate(x):
    return np.clip(0.25 * x + 0.5, 0, 1)


@dataclass
class Network:
    """For each direction: embed (256, 3H) holds each byte's input to reset, update and candidate; gates (H, 2H); state (H, H)."""

    embed: list
    gates: list
    state: list
    out: np.ndarray
    bias: np.ndarray
    labels: list

    @classmethod
    def fresh(cls, labels: list, hidden: int = HIDDEN) -> Network:
        r = np.random.Generator(np.random.PCG64(SEED))
        draw = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        return cls([draw(256, 3 * hidden, scale=0.3) for _ in range(2)], [draw(hidden, 2 * hidden, scale=0.3) for _ in range(2)], [draw(hidden, hidden, scale=0.3) for _ in range(2)], draw(2 * hidden, len(labels), scale=0.3), np.zeros(len(labels), np.float32), labels)

    def arrays(self) -> list:
        return [*self.embed, *self.gates, *self.state, self.out, self.bias]

    def states(self, x: np.ndarray, d: int, trace: list | None = None) -> np.ndarray:
        """States of one direction at each position; x: (positions, lanes) bytes."""
        hidden = self.state[d].shape[0]
        h, kept = np.zeros((x.shape[1], hidden), np.float32), np.empty((*x.shape, hidden), np.float32)
        for t in range(len(x))[:: 1 if d == 0 else -1]:
            e = self.embed[d].take(x[t], axis=0)
            rz = h @ self.gates[d]
            rz += e[:, : 2 * hidden]
            rz *= 0.25
            rz += 0.5
            np.minimum(rz, 1, out=rz)
            np.maximum(rz, 0, out=rz)
            a = (h * rz[:, :hidden]) @ self.state[d]
            a += e[:, 2 * hidden :]
            c = a / (np.abs(a) + 1)
            if trace is not None:
                trace.append((t, h, rz, c))
            h = h + rz[:, hidden:] * (c - h)
            kept[t] = h
        return kept

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (positions, lanes, labels)."""
        y = np.concatenate([self.states(x, 0), self.states(x, 1)], axis=2) @ self.out
        y += self.bias
        y -= y.max(2, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(2, keepdims=True)
        return y

    def gradients(self, x: np.ndarray, label: np.ndarray, valid: np.ndarray) -> list:
        """Of the mean cross-entropy over the valid positions, in the order of arrays()."""
        traces: list[list] = [[], []]
        both = np.concatenate([self.states(x, d, traces[d]) for d in (0, 1)], axis=2)
        y = both @ self.out + self.bias
        p = np.exp(y - y.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        p[:, np.arange(len(label)), label] -= 1
        p *= (valid / max(1, valid.sum()))[:, :, None]
        g_out = np.einsum("tnh,tnl->hl", both, p, optimize=True)
        back, hidden = p @ self.out.T, self.state[0].shape[0]
        g_embed, g_gates, g_state = ([np.zeros_like(w) for w in ws] for ws in (self.embed, self.gates, self.state))
        for d in (0, 1):
            carried = np.zeros((x.shape[1], hidden), np.float32)
            for t, h, rz, c in reversed(traces[d]):
                gh = carried + back[t, :, d * hidden : (d + 1) * hidden]
                r, z = rz[:, :hidden], rz[:, hidden:]
                ga = gh * z * (1 - np.abs(c)) ** 2
                grh = ga @ self.state[d].T
                open_gate = (rz > 0) & (rz < 1)
                grz = np.concatenate([grh * h, gh * (c - h)], axis=1) * 0.25 * open_gate
                g_state[d] += (h * r).T @ ga
                g_gates[d] += h.T @ grz
                np.add.at(g_embed[d], x[t], np.concatenate([grz, ga], axis=1))
                carried = gh * (1 - z) + grh * r + grz @ self.gates[d].T
        return [*g_embed, *g_gates, *g_state, g_out, p.sum((0, 1))]

    def fit(self, windows: list[bytes], labels: np.ndarray) -> Network:
        """Adam over batches with as many windows of each label; the same result on each run."""
        r = np.random.Generator(np.random.PCG64(SEED))
        by_label = [np.flatnonzero(labels == k) for k in range(len(self.labels))]
        first, second = ([np.zeros_like(w) for w in self.arrays()] for _ in range(2))
        for step in range(1, STEPS + 1):
            label = (np.arange(TRAIN_LANES) + (step - 1) * TRAIN_LANES) % len(self.labels)
            x, valid = np.zeros((TRAIN_SPAN, TRAIN_LANES), np.uint8), np.zeros((TRAIN_SPAN, TRAIN_LANES), np.float32)
            for lane, k in enumerate(label):
                text = windows[r.choice(by_label[k])]
                a = int(r.integers(0, max(1, len(text) - TRAIN_SPAN + 1)))
                cut = np.frombuffer(text[a : a + TRAIN_SPAN], np.uint8)
                x[: len(cut), lane], valid[: len(cut), lane] = cut, 1
            rate = RATE * (1 - step / (STEPS + 1))
            for w, g, m, v in zip(self.arrays(), self.gradients(x, label, valid), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean distribution over all positions of each text; windows of all texts go in step, LANES at a time."""
        n = len(offsets) - 1
        size = np.diff(offsets)
        per = -(-size // SPAN)
        owner = np.repeat(np.arange(n), per)
        start = offsets[owner] + (np.arange(len(owner)) - np.repeat(per.cumsum() - per, per)) * SPAN
        length = np.minimum(SPAN, offsets[owner + 1] - start)
        order = np.argsort(-length, kind="stable")
        total, padded = np.zeros((n, len(self.labels))), np.concatenate([data, np.zeros(SPAN, np.uint8)])
        for k in range(0, len(order), LANES):
            lanes = order[k : k + LANES]
            most = int(length[lanes[0]])
            inside = np.arange(most)[:, None] < length[lanes][None, :]
            x = np.where(inside, padded[start[lanes][None, :] + np.arange(most)[:, None]], 0).astype(np.uint8)
            p = self.positions(x)
            if not inside.all():
                p *= inside[:, :, None]
            np.add.at(total, owner[lanes], p.sum(0, dtype=np.float64))
        return total / np.maximum(size, 1)[:, None]


def training_texts(docs: DataFrame) -> tuple[list, list[bytes], np.ndarray]:
    """The labels, windows and their label numbers: a hash of the id picks at most PER_LANGUAGE texts of a language."""
    usable = docs.where((crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & (F.length("text") > 0))
    common = usable.groupBy("lang").count().orderBy("lang").collect()  # a row for each language: the network has an output for each
    if not common:
        return [], [], np.zeros(0, np.int64)
    most = max(4, min(PER_LANGUAGE, TEXTS // len(common)))
    drawn = unit_hash(F.col("doc_id"), "lang")
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, 0.9 * most / n) if n > most else 1.0) for lang, n in common], "lang string, share double")
    wide = 4 * TRAIN_SPAN
    spots = [F.substring("text", F.lit(1) + (F.greatest(F.char_length("text") - wide, F.lit(0)) * (k / max(1, PIECES - 1))).cast("int"), F.lit(wide)) for k in range(PIECES)]
    picked = usable.join(F.broadcast(shares), "lang").where((drawn < F.col("share")) | (F.col("share") >= 1))
    # A language whose draw is empty, as it can be for a few hundred texts and a small share, is taken by its smallest hash.
    rows = picked.select("lang", drawn.alias("drawn"), F.array(*spots).alias("cuts")).orderBy("drawn", "lang", "cuts").limit(PER_LANGUAGE * max(TEXTS // PER_LANGUAGE, len(common))).collect()
    missing = sorted({r["lang"] for r in common} - {r["lang"] for r in rows})
    if missing:
        first = usable.join(F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in missing], "lang string")), "lang").groupBy("lang").agg(F.min(F.struct(drawn.alias("drawn"), F.array(*spots).alias("cuts"))).alias("one"))
        rows += first.select("lang", "one.*").collect()
    names = sorted({r["lang"] for r in rows})
    windows = [(cut.encode(), names.index(r["lang"])) for r in rows for cut in dict.fromkeys(r["cuts"])]
    return names, [w for w, _ in windows], np.array([k for _, k in windows], np.int64)


def language_report(docs: DataFrame, ident="doc_id", text="text", lang="lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs."""
    plain = docs.select(F.col(ident).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).alias("lang"))
    names, windows, labels = training_texts(plain)
    known = docs.sparkSession.sparkContext.broadcast(Network.fresh(names).fit(windows, labels) if names else None)
    id_type = plain.schema["doc_id"].dataType.simpleString()

    def label(batches):
        network = known.value
        for batch in sized_batches(batches, 2, 4 << 20):
            if network is None:
                pred, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                p = network.pooled(*byte_buffer(batch.column(2)))
                lettered = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
                pred = [network.labels[k] if yes else "und" for k, yes in zip(p.argmax(1), lettered, strict=True)]
                score = np.where(lettered, np.minimum(p.max(1), 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return plain.select("doc_id", held.alias("held_out"), "text", lettered.alias("lettered")).mapInArrow(label, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")
