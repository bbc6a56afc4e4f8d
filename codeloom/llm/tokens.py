"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks that reach OVERLAP characters into the next one; chunks are CHUNK characters long, and are worked
through where the text lies, unless the text is longer than DEALT. Then chunks are DEALT characters long and are dealt to
tasks in parallel. Chunks are pre-tokenised each from its own start; what lies
at the edge of a chunk's view is left out. The true boundaries of a text are those of its first chunk, and from
there those of the next chunk after the first boundary that both have: from equal boundaries the pattern goes on alike.
Where the views share none, as in one very long word, the matcher steps on from the last true boundary until it meets
one of the next chunk. The pieces are then encoded by the ranks; decoding joins the bytes of the ids.

Defined results: null and empty texts have no ids; lone surrogates can't occur in Spark strings; repeated
rows give repeated results; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass, field
from functools import cache
from itertools import islice

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from codeloom.llm.shared import KEPT, lean, small_batches

CHUNK, DEALT, OVERLAP, EDGE = 4096, 65536, 512, 4
#: Pieces that a Python worker remembers.
REMEMBERED = 200_000


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


class Pieces(dict):
    """Piece to (number of ids, ids as text, bytes that the ids decode to). Forgets all when it's full."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.encoding = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {v: k for k, v in ranks.items()}

    def __missing__(self, piece: str):
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self.encoding._encode_single_piece(piece)
        self[piece] = found = (len(ids), ",".join(map(str, ids)), b"".join(map(self.bytes_of.__getitem__, ids)))
        return found


@cache
def vocabulary(path: str, pattern: str) -> tuple[Pieces, regex.Pattern]:
    """Read once in a process; every executor has the file."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return Pieces(ranks, pattern), regex.compile(pattern)


KEPT["tokens"] = vocabulary.cache_clear


@dataclass
class Running:
    """The ids of one text, as they come."""

    n: int = 0
    ids: object = field(default_factory=hashlib.sha256)
    decoded: object = field(default_factory=hashlib.sha256)

    def add(self, pieces: list[str], known: Pieces) -> None:
        if pieces:
            found = [known[p] for p in pieces]
            self.ids.update(("," * (self.n > 0) + ",".join([f[1] for f in found])).encode())
            self.decoded.update(b"".join([f[2] for f in found]))
            self.n += sum([f[0] for f in found])

    def row(self) -> tuple:
        return self.n, self.ids.hexdigest(), self.decoded.hexdigest()


def boundaries(view: str, whole: bool, matcher: regex.Pattern) -> list[int]:
    """Ends of the pieces of a view; without those that what follows the view could change."""
    ends = [m.end() for m in matcher.finditer(view)]
    if not whole:
        while ends and ends[-1] > len(view) - EDGE:
            ends.pop()
        while ends and view[ends[-1] :].isspace():  # white space up to the edge may split otherwise
            ends.pop()
    return ends


def stitched(chunks, matcher: regex.Pattern):
    """Pieces of a text, in lists. chunks: (start, view, boundaries, whole) in order; the view's own part and its overlap."""
    at, last, tail = 0, -1, ""  # the text from `at`, the last true boundary, on that has been seen
    for start, view, ends, whole in chunks:
        tail += view[len(tail) - (start - at) :] if start else view
        if start == 0:
            true = ends
        else:
            true, own = [], {start + e for e in ends}
            while at not in own and at < start + len(view):
                m = matcher.match(tail, at - (start + len(view) - len(tail)))
                end = m.end() + start + len(view) - len(tail)
                if not whole and end > start + len(view) - EDGE - 1:
                    break
                true.append(end - start)
                at = end
            if at in own:
                true += [e for e in ends if start + e > at]
        base = start + len(view) - len(tail)
        pieces, frm = [], last if last >= 0 else 0
        for e in true:
            pieces.append(tail[frm - base : start + e - base])
            frm = start + e
        last = at = frm
        tail = tail[frm - base :]
        yield pieces


def views(text: str, chunk: int, overlap: int):
    """start, view, whole of each chunk; whole: the view reaches the end of the text."""
    for start in range(0, max(1, len(text)), chunk):
        yield start, text[start : start + chunk + overlap], start + chunk + overlap >= len(text)
        if start + chunk + overlap >= len(text):
            return


def encode_in_place(docs: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    def encode(batches):
        known, matcher = vocabulary(path, pattern)
        for batch in small_batches(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                run = Running()
                for pieces in stitched(((start, view, boundaries(view, whole, matcher), whole) for start, view, whole in views(text or "", chunk, overlap)), matcher):
                    run.add(pieces, known)
                rows.append(run.row())
            yield result_batch(batch.column(0), rows)

    return docs.mapInArrow(lean(encode, "tokens"), result_schema(docs))


def result_schema(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"


def result_batch(ids, rows: list) -> pa.RecordBatch:
    n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_long(docs: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Texts of more than a chunk: cut, pre-tokenised where the chunks land, stitched in order of the chunks."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    arrow_type = to_arrow_type(docs.schema["doc_id"].dataType)
    names = ["row", "start", "doc_id", "view", "whole"]

    def cut(batches):
        for batch in small_batches(batches, 16):
            for row, doc_id, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                of = views(text.as_py(), chunk, overlap)
                while part := list(islice(of, 64)):
                    starts, seen, whole = zip(*part, strict=True)
                    columns = [pa.array([row.as_py()] * len(part), pa.int64()), pa.array(starts, pa.int64()), pa.array([doc_id.as_py()] * len(part), doc_id.type), pa.array(seen, pa.string()), pa.array(whole)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    def split(batches):
        _, matcher = vocabulary(path, pattern)
        for batch in small_batches(batches, 64):
            ends = [boundaries(v, w, matcher) for v, w in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.list_(pa.int32()))], names=[*names, "ends"])

    def rows_of(batches):
        for batch in small_batches(batches, 64):
            yield from zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True)

    def stitch(batches):
        known, matcher = vocabulary(path, pattern)
        stream = rows_of(batches)
        head = next(stream, None)
        while head is not None:
            row, doc_id, run, following = head[0], head[2], Running(), [None]

            def chunks(first=head, row=row, following=following):
                while first is not None and first[0] == row:
                    yield first[1], first[3], first[5], first[4]
                    first = next(stream, None)
                following[0] = first

            for pieces in stitched(chunks(), matcher):
                run.add(pieces, known)
            yield result_batch(pa.array([doc_id], arrow_type), [run.row()])
            head = following[0]

    base = f"row long, start long, doc_id {id_type}, view string, whole boolean"
    dealt = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(lean(cut, "tokens"), base)
    parted = dealt.repartition(n, "row", "start").mapInArrow(lean(split, "tokens"), base + ", ends array<int>")
    return parted.repartition(n, "row").sortWithinPartitions("row", "start").mapInArrow(lean(stitch, "tokens"), result_schema(docs))


def token_report(docs: DataFrame, ident="doc_id", text="text", path: str | None = None, pattern: str | None = None, chunk: int = CHUNK, dealt: int = DEALT, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids in decimal, joined by commas), decoded_sha256 of every row of docs."""
    if path is None or pattern is None:
        path, pattern = default_vocabulary()
    plain = docs.select(F.col(ident).alias("doc_id"), F.col(text).cast("string").alias("text"))
    is_long = F.coalesce(F.char_length("text") > dealt, F.lit(False))
    return encode_in_place(plain.where(~is_long), path, pattern, chunk, overlap).unionByName(encode_long(plain.where(is_long), path, pattern, dealt, overlap))
