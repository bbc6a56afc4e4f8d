"""Each operator against a brute-force version on small fixtures with nulls, empty and long texts, ties, repeated rows,
empty tables and columns with clashing names; the queries with SQL against DuckDB."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

import corpus_pipeline
from codeloom.llm import exact, langid, media, mixing, quality, queries, secrets, simhash, token_files, tokens, urls

SF = "/root/testdata/sf0.001"
LONG = "word and another " * 4000
TEXTS = [None, "", "  ", "a b c", "A b C", "a b c", LONG, LONG + "!", "é ñ token = 'abcdef123456' x", "one two three four five six seven eight nine ten"]
CLASHES = ("size", "row", "key", "text2", "score", "label", "n", "_id", "_copies", "at")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en" if k % 2 else None, None if k % 4 == 0 else f"s{k % 3}", *(["x"] * len(CLASHES))) for k, t in enumerate(TEXTS)]
    rows += [rows[3], (None, "a b c", "en", "s1", *(["x"] * len(CLASHES)))]  # a repeated row, a null id
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHES))


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def key(x):
    return (x[0] is None, x)


def listed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: str(r))


def test_mixing(docs, texts):
    found = listed(mixing.mixing_plan(docs), "doc_id", "size", "source_size", "target", "taken")
    assert sorted(str((d, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))) for d, t in texts) == sorted(str(r[:2]) for r in found)
    total = sum(r[1] for r in found)
    per = {(r[2], r[3]) for r in found}
    assert all(t <= 2 * s + 1e-9 for s, t in per) and all(r[4] <= 2 * r[1] for r in found)
    by_source = {r.source: r for r in mixing.source_targets(mixing.sizes(docs, "doc_id", "text", "source")).collect()}
    names = sorted((s for s in by_source if s is not None)) + [None]
    weights, left, open_ = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5 * total, set(names)
    targets = dict.fromkeys(names, 0.0)
    while True:  # shares by weight; what is above a cap goes to the others
        share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * by_source[s].source_size}
        if not over:
            targets |= share
            break
        for s in over:
            targets[s] = 2.0 * by_source[s].source_size
            left -= targets[s]
        open_ -= over
    assert all(abs(targets[s] - by_source[s].target) < 1e-6 for s in names)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    taken = {r[0]: r[4] // r[1] for r in found if r[1]}
    counts = pd.Series([r.doc_id for r in mixed.collect()]).value_counts(dropna=False)
    assert all(counts.get(d, 0) == n * (2 if d == 3 else 1) for d, n in taken.items() if d is not None)
    assert listed(mixing.mixing_plan(docs), "doc_id", "taken") == listed(mixing.mixing_plan(docs), "doc_id", "taken")
    assert mixing.mixing_plan(docs.limit(0)).count() == 0


def test_urls(spark):
    shapes = ["https://A.Example.NET/en/1", "http://x.org/fr/2?q", "http://a.net", None, "no scheme", "ftp://example.com/de/#f", "http://b.org/x://y", "", "http://casino.example.org/en/1"]
    pages = spark.createDataFrame([(k, u, "h", "s") for k, u in enumerate(shapes * 30)], "page_id long, url string, host string, score string")
    found = {r.page_id: r for r in urls.judge_urls(pages).collect()}
    assert len(found) == len(shapes) * 30
    for k, u in enumerate(shapes):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(str.maketrans(urls.UPPER, urls.LOWER)), m[2]) if m else ("", "")
        fits = [r for r in urls.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        assert (found[k].host, found[k].path, found[k].rule) == (host, path, best and best[1] + best[2])
        assert found[k].verdict == best[0] if best else found[k].verdict in ("allow", "block")
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_language(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.language_report(table).join(table.select("doc_id", "lang"), "doc_id").toPandas()
    assert (found["lang"] == found["lang_pred"])[found["held_out"]].mean() > 0.9 and found["score"].between(0, 1).all()
    odd = {r.doc_id: r for r in langid.language_report(docs).collect()}
    assert odd[0].lang_pred == odd[2].lang_pred == "und" and len(odd) == len(TEXTS) + 1
    assert langid.language_report(docs.limit(0)).count() == 0


def test_gradients():
    net, r = langid.Network.fresh(["a", "b"], 3), np.random.default_rng(0)
    for k, w in enumerate(net.arrays()):
        w += 0  # float32 arrays in place
    x, label, valid = r.integers(97, 103, (5, 4)).astype(np.uint8), np.array([0, 1, 1, 0]), np.ones((5, 4), np.float32)
    loss = lambda: -np.log(net.positions(x)[:, np.arange(4), label]).mean()
    for w, g in zip(net.arrays(), net.gradients(x, label, valid), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        w[at] += 1e-2
        up = loss()
        w[at] -= 2e-2
        down = loss()
        w[at] += 1e-2
        assert abs((up - down) / 2e-2 - g[at]) < 0.05 * abs(g[at]) + 1e-3


def test_token_files(docs, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_files.default_vocabulary())
    start = 0
    found = sorted((tuple(r) for r in token_files.token_file_report(docs).collect()), key=lambda r: r[1])
    for (doc_id, at, n, crc), (d, t) in zip(found, sorted(texts, key=lambda x: (x[0] is not None, x[0])), strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (doc_id, at, n, crc) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n
    assert token_files.token_file_report(docs.limit(0)).count() == 0


def test_token_files_of_hostile_texts(spark):
    """Separators of the run, special names, marks that combine, other white space, a text of many blocks, one id for many texts."""
    from tokenizers import Tokenizer

    library, r = Tokenizer.from_file(token_files.default_vocabulary()), random.Random(3)
    alphabet = ["\x01", " \x01 ", " ", "\t\n", "\u0301", "e\u0301", "\u00a0", "\u2028", "\x1c", "\x85", "İ", "Σ", "ς", "don't", "I'LL", "<|endoftext|>", "<|startoftext|>", "9", "!?", "漢", "😀", "word", "A", "\0", "</w>", "Word,", "naïve...", "x<|", "|>", "end'.", "漢。", "ß)", "е́;", "<|ENDOFTEXT|>", "<", "\u0338"]
    texts = ["".join(r.choices(alphabet, k=r.randrange(12))) for _ in range(900)] + ["many words in a row " * 20000]
    rows = [(k // 3 if k < 300 else 7 if k < 500 else None, t) for k, t in enumerate(texts)]
    report = token_files.token_file_report(spark.createDataFrame(rows, "doc_id int, text string"))
    found, again = ([tuple(x) for x in report.orderBy("start").collect()] for _ in range(2))
    assert found == again and report.schema["doc_id"].dataType.simpleString() == "int"
    expected = {}
    for d, t in rows:
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        expected.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got, start = {}, 0
    for d, at, n, crc in found:
        assert at == start
        start += n
        got.setdefault(d, []).append((n, crc))
    assert {d: sorted(x) for d, x in expected.items()} == {d: sorted(x) for d, x in got.items()}
    assert [d for d, *_ in found] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))


def test_token_files_take_special_names_as_the_library_does(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_files.default_vocabulary())
    texts = ["end <|endoftext|> of", "<|startoftext|>start", "a<|endoftext|>b<|startoftext|> <|endoftext|>", "plain"]
    rows = token_files.token_file_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    start = 0
    for x, t in zip(sorted(rows), texts, strict=True):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_blocks(spark):
    from codeloom.llm.jvm import register_functions

    register_functions(spark)
    r = np.random.default_rng(1)
    blocks = [r.integers(0, 65536, n) for n in (0, 1, 5, 16384)] + [np.full(9000, 7), r.zipf(1.3, 1500) % 49408, np.tile(r.integers(0, 49408, 40), 30)]
    rows = [(k, bytearray(b.astype("<u2").tobytes())) for k, b in enumerate(blocks)] * 40  # a model is used for many blocks
    made = spark.createDataFrame(rows, "k int, ids binary").selectExpr("k", "codeloom_pack_ids(ids) AS bytes").cache()
    per = {x.k: bytes(x.bytes) for x in made.collect()}
    assert all(per[x.k] == bytes(x.bytes) for x in made.collect())  # a block's bytes don't depend on the blocks before it
    for x in made.selectExpr("k", "codeloom_unpack_ids(bytes) AS ids").collect():
        assert bytes(x.ids) == blocks[x.k].astype("<u4").tobytes()
    assert len(per[4]) < 120 and len(per[6]) < 500 and len(per[3]) < 2.3 * len(blocks[3])
    for bad in (b"", per[5][:8], b"x" + per[5][1:], per[5][:40] + bytes([per[5][40] ^ 1]) + per[5][41:], per[5][:-40]):
        with pytest.raises(Exception, match="block of token ids"):
            spark.createDataFrame([(bytearray(bad),)], "b binary").selectExpr("codeloom_unpack_ids(b) AS ids").collect()
    assert token_files.crc_joined(zlib.crc32(b"abc"), zlib.crc32(b"defgh"), 5) == zlib.crc32(b"abcdefgh")


@pytest.mark.parametrize("hot", [1, exact.HOT])  # no group is hot, all groups are
def test_exact(docs, texts, monkeypatch, hot):
    monkeypatch.setattr(exact, "HOT", hot)
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    found = exact.exact_groups(docs).collect()
    groups: dict = {}
    for d, t in texts:
        groups.setdefault(fold(t), []).append(d)
    assert len(found) == len(texts) and sum(r.kept for r in found) == len(groups)
    for r in found:
        ids = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(ids) and r.keep_id == max(i for i in ids if i is not None)
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(fold(r.text) for r in kept.collect()) == sorted(groups)
    assert exact.exact_groups(docs.limit(0)).count() == 0


def test_exact_index(spark):
    counts = np.random.default_rng(3).integers(0, 50, 2**exact.DEPTH)
    slots = exact.directory(counts, 1000)
    assert (np.diff(slots) >= 0).all() and np.bincount(slots, counts).max() <= 1000
    keys = [(hashlib.sha256(bytes([k])).digest(), 1 + k % 2) for k in range(200)]
    table = exact.repeated_bits(spark.createDataFrame(keys, "key binary, n long"))
    assert all(exact.in_table(table, k) for k, n in keys if n > 1) and sum(exact.in_table(table, k) for k, n in keys if n == 1) < 5


def test_quality(spark, docs):
    table, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = quality.quality_report(table, labels).join(labels, "doc_id").toPandas()
    held = found[found["held_out"]]
    good, bad = held[held["quality"] == 1]["score"].to_numpy(), held[held["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.9
    few = spark.createDataFrame([(3, 1), (4, 0), (6, 1), (6, 0), (None, 1)], "doc_id long, quality int")
    odd = quality.quality_report(docs, few)
    assert odd.count() == len(TEXTS) + 2 and odd.where("score NOT BETWEEN 0 AND 1").count() == 0
    assert quality.keep_good(docs, few.limit(0)).columns == docs.columns
    assert quality.quality_report(docs.limit(0), few).count() == 0


def test_secrets(docs, texts):
    scan, r = secrets.scanner(), random.Random(1)
    parts = [b"token", b"PassWord", b"secret", b"api_key", b'"', b" ", b"=", b":", b"abc", b"0123456789abcdef", b"AKIA", b"ABCDEFGH12", b"\n", "é".encode(), b"ghp_"]
    a = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")

    def brute(t):
        spans = [(m.start(), 0, m.end()) for m in a.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(rb"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer(rb"[0-9a-f]+", t) if len(m[0]) >= 24])

    for _ in range(3000):
        t = b"".join(r.choice(parts) for _ in range(r.randint(0, 16)))
        assert [s for s in scan.spans(t) if s[1] < 3] == brute(t)
    found = {x.doc_id: x for x in secrets.secret_report(docs).collect()}
    assert found[8].spans == "assign:4:25" and found[0].spans == "" and len(found) == len(TEXTS) + 1
    assert secrets.secret_report(docs.limit(0)).count() == 0


def near_brute(texts, bits=4):
    def mark(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [mark(t) for _, t in texts]
    part = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    first = {p: min(d for (d, _), q in zip(texts, part, strict=True) if q == p and d is not None) for p in set(part)}
    return sorted(str((d, f"{f:016x}", first[p])) for (d, _), f, p in zip(texts, prints, part, strict=True))


def test_simhash(docs, texts, spark, monkeypatch):
    assert sorted(str(tuple(r)) for r in simhash.near_report(docs).collect()) == near_brute(texts)
    kept = simhash.drop_near(docs)
    assert kept.columns == docs.columns
    assert simhash.near_report(docs.limit(0)).count() == 0
    # Chains of fingerprints, also with lists that are dealt once more.
    r = random.Random(5)
    prints = set()
    for _ in range(20):
        f = r.getrandbits(64)
        for _ in range(12):
            prints.add(f)
            for _ in range(r.randint(1, 5)):
                f ^= 1 << r.randrange(64)
    prints = sorted(prints)
    nodes = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, k) for k, f in enumerate(prints)], "fingerprint long, first long")
    part = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4:
                part = [part[j] if p == part[i] else p for p in part]
    for block in (2048, 3):
        monkeypatch.setattr(simhash, "BLOCK", block)
        roots = {x.node % 2**64: x.root for x in simhash.components(nodes, simhash.near_links(nodes)).collect()}
        assert all(roots.get(f, k) == part.index(part[k]) for k, f in enumerate(prints))


def test_drop_near_decides_each_row_for_its_own_text(spark):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(None, "a lone text"), (None, "another lone text"), (None, long), (1, long.upper()), (2, "two of one id"), (2, "not like it at all"), (3, "twice"), (3, "twice")]
    kept = sorted(map(str, map(tuple, simhash.drop_near(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert kept == sorted(map(str, rows[:2] + rows[3:7]))


def similar_brute(rows):
    """The ids of the rows that stay: of texts whose sets of five-word shingles reach 4/5, by links of links, that of the smallest id."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    part = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if part[i] != part[j] and (a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) > 0):
                part = [part[j] if p == part[i] else p for p in part]
    return [min((d is None, d) for (d, _), q in zip(rows, part, strict=True) if q == p)[1] for p in sorted(set(part))]


@pytest.mark.parametrize("long", [64, 2])  # no list is long, most are
def test_near_stage_keeps_one_of_similar_texts(spark, monkeypatch, long):
    from codeloom.llm import similar

    monkeypatch.setattr(similar, "LONG", long)
    r = random.Random(9)
    rows = [(None, None), (7, " "), (8, "one two"), (9, "One  two"), (None, "alone")]
    for k in range(12):  # copies with ever more words changed: similarity from 1 to about 1/2
        words = [f"w{r.randrange(300)}" for _ in range(120)]
        for n in range(6):
            rows.append((100 + 10 * k + n, " ".join(words)))
            words[r.randrange(120)] = f"v{r.random()}"
    expected = similar_brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(map(str, expected))
    assert corpus_pipeline.drop_near(spark, docs.limit(0), SF).count() == 0


def test_media(docs, texts):
    found = {x.doc_id: x for x in media.media_report(docs).collect()}
    for d, t in texts:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        x = found[d]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert x.media_sha256 == hashlib.sha256(media.wav(payload)).hexdigest()
    data = np.random.default_rng(2).integers(0, 256, 100_000, dtype=np.uint8).tobytes()
    assert media.cuts(data) == media.cuts(data, block=3000)
    assert b"".join(p for _, p in media.chunks_of(data)) == data
    shifted = {d for d, _ in media.chunks_of(b"x" * 37 + data)}
    assert sum(d in shifted for d, _ in media.chunks_of(data)) > 0.8 * len(media.chunks_of(data))
    assert media.media_report(docs.limit(0)).count() == 0


@pytest.mark.parametrize("chunk, dealt", [(4096, 65536), (50, 65536), (50, 200)])  # in place whole or in chunks, some dealt
def test_tokens(spark, docs, texts, chunk, dealt):
    path, pattern = tokens.default_vocabulary()
    library = tokens.vocabulary(path, pattern)[0].encoding
    hard = ["a" * 5000, " " * 3000, "it's " * 900 + " " * 500 + "x", "don" + "'re'll" * 700, "é1٣ \n\n " * 500]
    more = spark.createDataFrame([(100 + k, t) for k, t in enumerate(hard)], "doc_id long, text string")
    for df, of in ((docs, texts), (more, [(100 + k, t) for k, t in enumerate(hard)])):
        expected = []
        for d, t in of:
            ids = library.encode_ordinary(t or "")
            expected.append(str((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())))
        assert sorted(str(tuple(r)) for r in tokens.token_report(df, chunk=chunk, dealt=dealt, overlap=20).collect()) == sorted(expected)
    assert tokens.token_report(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, expected = queries.QUERIES[name](spark, SF).toPandas(), db.sql(queries.ORACLES[name]).df()
    pd.testing.assert_frame_equal(got[sorted(got)].sort_values("doc_id", ignore_index=True), expected[sorted(expected)].sort_values("doc_id", ignore_index=True), check_dtype=False)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF)
        assert after.columns == docs.columns
        after = spark.createDataFrame(after.toPandas(), docs.schema)
        before, now = ([r.doc_id for r in x.select("doc_id").collect()] for x in (kept, after))
        assert set(now) <= set(before)
        if name == "exact_dedup":
            assert len(now) == len({r.text.lower() for r in kept.collect()})
        if name == "near_dedup":
            assert sorted(now) == sorted(similar_brute([(r.doc_id, r.text) for r in kept.collect()]))
        kept = after
    assert corpus_pipeline.run(spark, SF).count() == kept.count()


def test_very_long_texts_are_scored_in_runs():
    text = random.Random(4).choices(["some", "words ", "\n", "é", "12", ". "], k=9000)
    data = np.frombuffer("".join(text).encode(), np.uint8)
    offsets = np.array([0, 0, 700, 700 + 8192, len(data)])
    x, own = quality.all_passages(data, offsets, 4096)
    assert own.max() == 3 and (np.diff(own) >= 0).all() and x.shape[0] >= len(data) // quality.PASSAGE
    for k in range(2):  # texts below a run are as they are alone
        alone, _ = quality.passages(data[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]))
        assert np.allclose(x[own == k], alone)


def test_every_language_is_learnt(spark):
    rows = [(k, f"l{k % 70:02d} " * 30, f"l{k % 70:02d}") for k in range(700)]
    names, windows, labels = langid.training_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(names) == 70 and set(labels) == set(range(70)) and len(windows) == len(labels)


def test_ids_of_other_types(spark):
    rows = [(1, "word " * 40), (2, None)]
    for kind in ("int", "string"):
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "text")
        assert tokens.token_report(df, dealt=50).schema["doc_id"].dataType.simpleString() == kind
        assert tokens.token_report(df, dealt=50).count() == 2


def test_pipeline_edges(spark):
    """Null and shared ids, null, empty and repeated texts, clashing columns, an empty table."""
    good = "The quick brown fox jumps over the lazy dog while seven wizards watch the quiet river in the early morning light. "
    rows = [(None, good + "null one"), (None, good * 2 + "and something else entirely here"), (1, good + "x"), (1, "an entirely different text with the same id and no copy at all"), (2, None), (3, ""), (4, good + "x"), (4, good + "x"), (5, "  ")]
    frame = spark.createDataFrame([(*r, "en", "s", len(r[1] or ""), *(["x"] * len(CLASHES))) for r in rows], "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in CLASHES))
    docs = frame
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        if name == "byte_bpe":
            assert after.count() == docs.count()
            break
        assert after.columns == frame.columns
        before, docs = [(r.doc_id, r.text) for r in docs.collect()], spark.createDataFrame(after.collect(), frame.schema)
        now = [(r.doc_id, r.text) for r in docs.collect()]
        assert set(now) <= set(before)
        if name == "exact_dedup":
            best = {}
            for d, t in before:
                k = (t or "").lower()
                best[k] = max(best.get(k, (False, 0)), (d is not None, d or 0))
            assert sorted((d is not None, d or 0) for d, _ in now) == sorted(best.values())
        if name == "near_dedup":
            assert sorted(map(str, (d for d, _ in now))) == sorted(map(str, similar_brute(before)))
        if name in ("exact_dedup", "near_dedup"):
            assert len(set(now)) == len(now)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame.limit(0), SF).count() == 0


def test_wide_sketches_and_stars():
    from codeloom.llm import similar

    r = np.random.default_rng(4)
    for n, m in ((3000, 3000), (5000, 4200), (1500, 1300), (40, 44)):
        x = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: int(0.93 * min(n, m))], r.integers(0, 2**64, max(0, m - int(0.93 * min(n, m))), dtype=np.uint64)]))
        z = np.unique(r.integers(0, 2**64, m, dtype=np.uint64))
        bits = lambda v: max(similar.SKETCH, 1 << (len(v) - 1).bit_length())
        sx, sy, sz = (similar.sketch_of(v, bits(v)) for v in (x, y, z))
        assert similar.apart(sx, sy) <= len(np.setxor1d(x, y)) and similar.apart(sx, sx) == 0
        assert 9 * similar.apart(sx, sz) > len(x) + len(z) or min(n, m) < 1000
    sizes, labels = np.full(40, 50), np.arange(40)
    sketches = np.zeros((40, similar.SKETCH // 64), np.uint64)
    sketches[20:] = r.integers(0, 2**64, (20, similar.SKETCH // 64), dtype=np.uint64)
    found = list(similar.stars(labels, sizes, sketches))
    assert sorted([found[0][0], *found[0][1].tolist()]) == list(range(20))
    pairs = {(int(min(i, j)), int(max(i, j))) for i, js in similar.across(labels, sizes, sketches) for j in js}
    assert pairs == {(i, j) for i in range(20) for j in range(i + 1, 20)}
    assert not [1 for _, js in similar.across(np.zeros(40, int), sizes, sketches) for _ in js]


def test_near_dedup_takes_simhash(spark, monkeypatch):
    """With the second index silent, texts within 4 bits still meet by their fingerprints; the exact check still decides."""
    from codeloom.llm import similar

    r = random.Random(8)
    base = [" ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(400)) for _ in range(3)]
    rows = [(k, t) for k, t in enumerate(base)] + [(10 + k, t + " end") for k, t in enumerate(base)]
    prints = {d: np.uint64(similar.set_print(similar.shingles(t.encode())) % 2**64) for d, t in rows}
    assert all(int(np.bitwise_count(prints[k] ^ prints[10 + k])) <= 4 for k in range(3))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(similar, "met", lambda listed: spark.createDataFrame([], "a long, b long, n int"))
    assert sorted(x.doc_id for x in similar.drop_similar(docs).collect()) == [0, 1, 2]
    nodes = spark.createDataFrame([(5, 77), (1, 77), (3, 77 ^ 15), (9, 77 ^ 31), (7, ~77)], "node long, print long")  # equal, 4, 5 and 64 bits apart
    assert {(x.a, x.b) for x in similar.near_prints(nodes).collect()} == {(1, 5), (1, 3), (3, 9)}


def test_workers_give_back_what_other_kinds_keep(spark):
    """Tables of the encoder stay for its own tasks and go before another kind of task runs."""
    from codeloom.llm import shared

    path, pattern = tokens.default_vocabulary()
    tokens.vocabulary(path, pattern)
    assert list(shared.lean(iter, "tokens")([1, 2])) == [1, 2] and tokens.vocabulary.cache_info().currsize == 1
    assert list(shared.lean(iter)([1, 2])) == [1, 2] and tokens.vocabulary.cache_info().currsize == 0
