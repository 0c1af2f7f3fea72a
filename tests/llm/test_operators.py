"""Operators of the subpackage against brute force, round trips and edge cases, on small fixtures."""

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from sievework.llm import byte_bpe, chat, decontaminate, hashing, license_rules, licenses, line_chunks, near_dup, pairwise_quality, quality_rules, warc, wavelet
from sievework.llm.components import components

EDGE = [(0, "a b  c"), (1, None), (2, ""), (3, " \n\t"), (4, "x " * 3000), (5, "é ñ 日本 😀 !"), (6, "a b  c"), (6, "a b  c"), (None, "no id here")]
DOCS = "doc_id long, text string"


def docs(spark, rows, extra=False):
    d = spark.createDataFrame(rows, DOCS).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    clash = ("score", "n_lines", "kept", "decoded", "ids", "word", "refs", "key", "id", "label", "start", "_sw_id") if extra else ()
    return d.withColumns({c: F.lit(1) for c in clash})


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w]


def test_hashes_tell_words_apart():
    texts = ["a b  A", "", None, " x\n", "é A b", "q" * 1_200_000 + " z", "w " * 600_000]
    seen = {}
    for t, got in zip(texts, hashing.word_hashes(pa.array(texts)), strict=True):
        want = words(t)
        assert len(got) == len(want)
        for w, h in zip(want, got, strict=True):
            assert seen.setdefault(w, int(h)) == int(h)
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("n", [hashing.BLOCK - 5, hashing.BLOCK - 4, hashing.BLOCK - 3, hashing.BLOCK - 2, hashing.BLOCK - 1, hashing.BLOCK])
def test_hashes_at_the_end_of_a_block(n):
    got = list(hashing.word_hashes(pa.array(["a b", "x" * (n - 4) + " y", "c"])))
    assert [len(x) for x in got] == [2, 2, 1]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(40, 41), (41, 41), (None, 3)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 21)}, 40: 40, 41: 40}
    assert components(links.where("a > 99")).count() == 0


# 1
@pytest.mark.parametrize("n", [0, 1, 8, 511, 512, 513, 3000])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    a = rng.integers(0, 40 if n % 2 else 49408, n).astype(np.uint16)
    m, ids, lengths = wavelet.unpack(wavelet.pack(a, [5, None], [n, 0]))
    assert (m.ids() == a).all() and ids == [5, None] and lengths.tolist() == [n, 0]
    for i in range(0, n, max(1, n // 40)):
        t = int(a[i])
        assert m.access(i) == t and m.rank(t, i) == (a[:i] == t).sum() and m.select(t, m.rank(t, i)) == i
    if n:
        assert m.occurrences(int(a[0])) == np.flatnonzero(a == a[0]).tolist()


def test_encoder_equals_whole_texts():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    whole, e = Tokenizer.from_file(path), wavelet.Encoder(path)
    texts = ["The the THE. end, x., (a.) b.c 'S I'll", "ΑΣ ΒΣ. Σ é. ñ,", "á ́b é", "<|endoftext|> x<|STARTOFTEXT|>y<|startoftext|>", "z \x1c\x1d \x85q　", "İ ǅ ﬁ ½ 가 ᄀ ᅡ", "", "a" * 5000]
    for _ in range(2):  # the second time from memory
        for t, got in zip(texts, e.encode([t.encode() for t in texts]), strict=True):
            assert np.frombuffer(got, "<u2").tolist() == [*whole.encode(t, add_special_tokens=False).ids, 2]


def test_lookups_inflate_what_they_touch():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 49408, 400_000).astype(np.uint16)
    m, _, _ = wavelet.unpack(wavelet.pack(a, [1], [len(a)]))
    i = 123_456
    assert m.access(i) == a[i] and sum(len(p.inflated) for p in m.planes) <= 16 * 2
    pieces = sum(len(p.frames) for p in m.planes)
    t = int(a[7])
    assert m.select(t, 0) == np.flatnonzero(a == t)[0] and m.rank(t) == (a == t).sum() and sum(len(p.inflated) for p in m.planes) < pieces
    assert (m.ids() == a).all()


def test_encoder_tells_chunks_of_one_hash_apart(monkeypatch):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    monkeypatch.setattr(wavelet, "located", lambda raw: (lambda h, a, b: (h % np.uint64(7), a, b))(*hashing.located(raw)))
    texts = ["one two three four five six seven eight", "nine ten eleven twelve", "Two THREE"]
    for t, got in zip(texts, wavelet.Encoder(path).encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == [*whole.encode(t, add_special_tokens=False).ids, 2]


def test_encoder_long_texts_and_forgetting(monkeypatch):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    whole, e = Tokenizer.from_file(path), wavelet.Encoder(path)
    monkeypatch.setattr(wavelet, "CACHE", 5)
    texts = ["a long one " * 110_000, *(f"some words {i} here" for i in range(50)), "a long one again"]
    for t, got in zip(texts, [x for k in range(0, len(texts), 9) for x in e.encode([t.encode() for t in texts[k : k + 9]])], strict=True):
        assert np.frombuffer(got, "<u2").tolist() == [*whole.encode(t, add_special_tokens=False).ids, 2]
    assert len(e.keys) < 60
    with pytest.raises(ValueError, match="lower-cases"):
        wavelet.Encoder(P.path("byte_bpe_50k.json"))


def test_shards_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path, out = P.path("word_bpe_49k.json"), str(tmp_path / "s")
    wavelet.write_shards(docs(spark, EDGE, extra=True), path, out, shard_tokens=50)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in wavelet.read_shards(spark, out).collect()), key=lambda r: r[1])
    whole, at, left = Tokenizer.from_file(path), 0, list(EDGE)
    for doc_id, start, n, crc in got:
        row = next(x for x in left if x[0] == doc_id)
        left.remove(row)
        ids = [*whole.encode(row[1] or "", add_special_tokens=False).ids, 2]
        assert (start, n, crc) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += n
    assert not left and [r[0] for r in got] == sorted((r[0] for r in got), key=lambda x: (x is not None, x))
    wavelet.write_shards(docs(spark, []), path, str(tmp_path / "e"))
    assert wavelet.read_shards(spark, str(tmp_path / "e")).count() == 0


# 2
def test_line_chunks(spark):
    long = " ".join(f"w{i}" for i in range(60))
    block = "\n".join(f"line number {i} of the block" for i in range(40))
    rows = [*EDGE, (10, f"one\n{long}\ntwo"), (11, f"three\n{long}"), (12, f"start\n{block}\nend"), (13, f"other\nlines\n{block}\nhere"), (14, "short\nunique")]
    got = {r.doc_id: r for r in line_chunks.dedup_lines(docs(spark, rows, extra=True)).collect()}
    assert got[10].text == rows[9][1] and got[12].text == rows[11][1] and got[14].text == "short\nunique"
    assert got[11].text == "three" and got[11].n_removed_lines == 1
    assert got[13].n_removed_lines > 20 and got[13].text.startswith("other")
    assert got[1].text == "" and got[6].text == "a b  c"
    assert line_chunks.dedup_lines(docs(spark, [])).count() == 0


def brute_line_dedup(rows):
    """Texts left, by the rule in plain loops: (doc_id, text) with different ids."""
    words_in = lambda x: len(re.findall("[^\x20\x09-\x0d]+", x))
    seen, out = {}, {}
    for i, text in sorted(rows):
        lines = (text or "").split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        n = [words_in(x) for x in lines]
        gone, start = set(), 0
        for k in range(len(lines)):
            cut = ((h[k - 1] if k else 0) * 31 + h[k]) % 4 == 0 or n[k] >= 50 or (k + 1 < len(lines) and n[k + 1] >= 50)
            if cut or k + 1 == len(lines):
                if sum(x > 0 for x in n[start : k + 1]) >= 2 or sum(n[start : k + 1]) >= 50:
                    if seen.setdefault(("c", "\n".join(lines[start : k + 1])), (i, start)) != (i, start):
                        gone |= set(range(start, k + 1))
                start = k + 1
        filled, run = [k for k in range(len(lines)) if n[k]], []
        for a, b in [*zip(filled, filled[1:]), (len(lines), len(lines))]:
            if a < len(lines) and seen.setdefault(("p", lines[a], lines[b]), (i, a)) != (i, a):
                run += [a, b]
            else:
                if run and sum(n[run[0] : run[-1] + 1]) >= 50:
                    gone |= set(range(run[0], run[-1] + 1))
                run = []
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_repeated_runs_of_lines_go_whole(spark):
    rng = np.random.default_rng(12)
    line = lambda n: " ".join(f"v{k}" for k in rng.integers(0, 9999, n))
    notice, header = [line(18), "", line(17), line(20)], [line(26), line(27)]
    rows = [(i, "\n".join([line(5), *notice, line(6), line(4), *header, line(7)])) for i in range(30)]
    rows += [(50, "\n".join([notice[0], notice[2]])), (51, "\n".join([*header, *header, *header])), (52, None), (53, "")]
    rows += [(60 + i, "\n".join(["short line", "another one", line(3)])) for i in range(5)] + [(70, line(60) + "\nq"), (71, "z\n" + rows[0][1])]
    got = {r.doc_id: r for r in line_chunks.dedup_lines(docs(spark, rows, extra=True)).collect()}
    want = brute_line_dedup(rows)
    assert {i: r.text or "" for i, r in got.items()} == want
    assert got[0].n_removed_lines == 0 and all(not set(notice[:1] + notice[2:] + header) & set(want[i].split("\n")) for i in range(1, 30))
    every = {x for _, t in rows for x in (t or "").split("\n")}
    assert every == {x for t in want.values() for x in t.split("\n")} | {""}


def test_hot_passage_and_repeated_ids(spark, monkeypatch):
    block = "\n".join(f"hot line {k} " + "w " * 9 for k in range(8))
    rows = [(i, f"own {i}\n{block}\nend {i}") for i in range(400)] + [(7, f"other {block}"), (7, f"again\n{block}"), (None, block)]
    for limit in (100_000, 0):
        monkeypatch.setattr(line_chunks, "BROADCAST_PASSAGES", limit)
        got = line_chunks.dedup_lines(docs(spark, rows)).collect()
        assert sum(r.text.count("hot line 3") for r in got if r.doc_id != 7) == 1 and len(got) == len(rows)
        assert [r.text for r in got if r.doc_id == 9] == ["own 9\nend 9"] and [r.text for r in got if r.doc_id is None] == [""]


# 3
def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b = rng.integers(0, 5, rng.integers(1, 25)), rng.integers(0, 5, rng.integers(1, 12))
        h = np.zeros((len(b) + 1, len(a) + 1), int)
        for i in range(1, len(b) + 1):
            for j in range(1, len(a) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[j - 1] == b[i - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.align(a, b)[0] == h.max()


def test_decontamination_finds_copies_and_edits(spark):
    rng = np.random.default_rng(4)
    text = lambda n: " ".join(f"t{i}" for i in rng.integers(0, 4000, n))
    items = [(i, text(40)) for i in range(6)] + [(7, None), (8, "")]
    edited = items[2][1].split()
    edited[5], edited[17], edited[30] = "x", "y", "z"
    del edited[10]
    rows = [*EDGE, (100, text(300) + " " + items[0][1].upper() + " " + text(50)), (101, text(20) + " " + " ".join(edited)), (102, text(500)), *[(200 + i, text(30) + " " + items[4][1]) for i in range(40)]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs(spark, rows, extra=True), bench).collect()}
    assert got[100, 0] == 1.0 and 0.6 < got[101, 2] < 1 and all(got[200 + i, 4] == 1.0 for i in range(40)) and len(got) == 42
    assert decontaminate.contaminated(docs(spark, rows), bench.where("item_id > 6")).count() == 0
    assert decontaminate.contaminated(docs(spark, []), bench).count() == 0


@pytest.mark.parametrize("copies", [11, 1000])
def test_decontamination_finds_edits_however_many_hold_them(spark, copies):
    item = [f"t{i}" for i in range(40)]
    edited = " ".join("x" if i % 5 == 4 else w for i, w in enumerate(item))
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    got = decontaminate.contaminated(docs(spark, [(i, f"a{i} {edited} b{i}") for i in range(copies)]), bench).collect()
    assert sorted(r.doc_id for r in got) == list(range(copies)) and len({r.score for r in got}) == 1


def full_alignment(doc, item):
    ids = {}
    a, b = (np.array([ids.setdefault(w, len(ids)) for w in words(x)], int) for x in (doc, item))
    return decontaminate.align(a, b)[0] / (2 * len(b)) if len(a) and len(b) else 0.0


def test_decontamination_against_whole_alignments(spark):
    """Every pair of documents and items of a table, aligned whole: what scores enough and shares a seed is found, no more."""
    sf = "/root/testdata/sf0.001"
    d, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    texts, items = ({r[0]: r.text or "" for r in x.select(k, "text").collect()} for x, k in ((d, "doc_id"), (bench, "item_id")))
    grams = lambda w: {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    want = {}
    for i, x in items.items():
        g = grams(words(x))
        for k, t in texts.items():
            if g & grams(words(t)) and (s := full_alignment(t, x)) >= 0.5:
                want[k, i] = s
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(d, bench).collect()}
    assert got == pytest.approx(want) and want


def test_decontamination_short_and_long_items_and_repeated_ids(spark):
    rng = np.random.default_rng(8)
    text = lambda n: " ".join(f"u{i}" for i in rng.integers(0, 9000, n))
    long = text(150)
    bench = spark.createDataFrame([(1, "Yes"), (2, "no way"), (3, long), (4, "a b c d e f"), (4, "p q r s t u"), (4, "p q r s t u")], "item_id long, text string").withColumn("score", F.lit(1))
    rows = [(10, "yes"), (11, "No  WAY"), (12, "yes no way " + text(20)), (13, text(900) + " " + " ".join(long.split()[40:100]) + " " + text(300)), (14, " ".join(long.split()[:20])), (15, "x a b c d e f y"), (15, "x p q r s t u y"), (16, "w " * 200_000 + "a b c d e f")]
    got = {(r.doc_id, r.item_id): round(r.score, 2) for r in decontaminate.contaminated(docs(spark, rows, extra=True), bench).collect()}
    assert got == {(10, 1): 1.0, (11, 2): 1.0, (13, 3): 0.4, (15, 4): 1.0, (16, 4): 1.0}


def test_recall_of_edited_copies(spark):
    """Copies with a share of words replaced at random; what still scores 0.5 when aligned whole must be found."""
    rng = np.random.default_rng(6)
    items = [[f"i{k}x{j}" for j in range(40)] for k in range(20)]
    rows, expected = [], set()
    for share in (0.0, 0.1, 0.2, 0.3):
        for k, w in enumerate(items):
            e = [f"new{j}" if rng.random() < share else x for j, x in enumerate(w)]
            i = int(share * 1000) * 1000 + k
            rows.append((i, "before it " + " ".join(e) + " after it"))
            if full_alignment(rows[-1][1], " ".join(w)) >= 0.5:
                expected.add((i, k))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert got <= expected and len(got) >= 0.95 * len(expected)
    assert {(i * 1, k) for i, k in expected if i < 200_000} <= got  # up to a tenth of the words: all


def test_most_matches_bounds_alignment():
    rng = np.random.default_rng(7)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 30)), rng.integers(0, 6, rng.integers(1, 12))
        assert decontaminate.align(a, b)[0] <= decontaminate.MATCH * decontaminate.most_matches(a, b)


# 4
def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = pairwise_quality.op4_pairwise_quality(spark, sf)
    both = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert both.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95
    bad = got.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % 4 == 2))
    assert bad.isEmpty()


def test_quality_edges(spark):
    d = docs(spark, EDGE, extra=True)
    model = pairwise_quality.train(d, labels(spark))
    got = pairwise_quality.score(d, model, tuple(d.columns)).collect()
    assert len(got) == len(EDGE) and {r.score for r in got} == {0.5} and model.quantile_cut(0.01) == 0.0
    assert pairwise_quality.score(docs(spark, []), model).count() == 0


@pytest.mark.parametrize("broadcast", [1_000_000, 10])
def test_model_and_cut_come_from_all_labelled_rows(spark, monkeypatch, broadcast):
    monkeypatch.setattr(pairwise_quality, "BROADCAST_KEYS", broadcast, raising=False)
    n = 28_000
    shapes = ["plain words in a line", "plain words, in a line.", "Some words Some words", "#a b c", "a 1 22 b c", "one two three four five six seven"]
    texts = [f"{shapes[i * i % 6]} {'x' * (i % 23)} {'y' * (i % 11)}." for i in range(n)]
    good = [int(i % 23 > 3 if i % 7 else i % 5 < 2) for i in range(n)]
    train = [i for i in range(n) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sum(good[i] for i in train) > 10_000
    m = pairwise_quality.train(docs(spark, list(enumerate(texts))), labels(spark, [(i, q, 0) for i, q in enumerate(good)] + [(n + 5, 1, 0), (n + 6, 0, 0)]))
    x, y = np.array([pairwise_quality.features(texts[i].encode()) for i in train]), np.array([good[i] for i in train])
    scores = m.scores(x)
    for share in (0.0, 0.002, 0.37, 1.0):
        assert abs(m.quantile_cut(share, 1.0) - np.quantile(scores[y == 1], share)) < 1e-12
    assert np.allclose(m.mean, x.mean(axis=0), atol=1e-9) and np.allclose(m.scale, np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1), atol=1e-9)
    assert abs(scores.mean() - y.mean()) < 1e-6  # calibrated to all rows
    # At the weights, the gradient of the loss over all pairs vanishes; equal rows count by their number.
    z = (x - m.mean) / m.scale
    (g, ng), (b, nb) = (np.unique(z[y == q], axis=0, return_counts=True) for q in (1, 0))
    lost = 1 / (1 + np.exp((g @ m.weights)[:, None] - (b @ m.weights)[None])) * ng[:, None] * nb
    grad = (lost.sum(axis=0) @ b - lost.sum(axis=1) @ g) / (ng.sum() * nb.sum()) + pairwise_quality.L2 * m.weights
    assert np.abs(grad).max() < 1e-7


def test_loss_on_nodes_is_that_of_all_pairs():
    rng = np.random.default_rng(12)
    x, y, w = rng.normal(size=(500, 3)) * [1, 5, 20], rng.integers(0, 2, 500), np.array([0.7, -1.0, 0.4])
    model = pairwise_quality.Model(np.zeros(3), np.ones(3), w, 1.0, 0.0)
    diff = (x[y == 0][:, None] - x[y == 1][None]).reshape(-1, 3)
    p = 1 / (1 + np.exp(-diff @ w))
    loss, grad, hess = pairwise_quality._pair_loss(pairwise_quality._on_nodes(model)(x, y), w)
    ridge = pairwise_quality.L2
    assert abs(loss - np.logaddexp(0, diff @ w).mean() - ridge / 2 * w @ w) < 1e-7
    assert np.abs(grad - (p[:, None] * diff).mean(axis=0) - ridge * w).max() < 1e-6
    assert np.abs(hess - (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) - ridge * np.eye(3)).max() < 1e-4


# 5
def test_warc_file_round_trip(spark):
    big = "<p>" + "y" * 300_000
    rows = [(1, "http://a/\r\nx", big), (2, "u", big), (3, None, None), (4, "u", "small"), (5, "u", "small"), (6, "u", "\r\n\r\n" * 30), (6, "u", "\r\n\r\n")]
    records = warc.classify(spark.createDataFrame(rows, "page_id long, url string, html string"))
    chunks = warc.to_chunks(records).collect()
    assert max(len(r.data) for r in chunks) <= warc.CHUNK_BYTES
    out = io.BytesIO()
    warc.export_file((bytes(r.data) for r in chunks), out)
    again = list(warc.import_file(io.BytesIO(out.getvalue())))
    assert [(r.record_id, r.chunk_no, bytes(r.data)) for r in chunks] == again
    kinds = {(r.page_id, r.payload_bytes): (r.record_type, r.refers_to) for r in records.collect()}
    assert kinds[2, len(big)] == ("revisit", 1) and kinds[5, 5] == ("response", None) and kinds[3, 0] == ("response", None)


def test_warc_table_round_trip(spark, tmp_path):
    rows = [(1, "u", "a" * 150_000), (2, "u", "a" * 150_000), (3, "u", ""), (4, None, None), (None, "u", "q" * 200), (7, "u", "é" * 90)]
    records = warc.classify(spark.createDataFrame(rows, "page_id long, url string, html string"))
    warc.write_archive(records, str(tmp_path / "w"))
    got = warc.read_archive(spark, str(tmp_path / "w")).collect()
    assert len(got) == 6 and all(r.intact for r in got)
    assert {r.payload_digest for r in got} == {hashlib.sha256((h or "").encode()).hexdigest() for _, _, h in rows}
    broken = spark.read.parquet(str(tmp_path / "w")).withColumn("data", F.when((F.col("chunk_no") == 1) & F.col("record_id").startswith("7/"), F.lit(b"x")).otherwise(F.col("data")))
    broken.write.parquet(str(tmp_path / "b"))
    assert [r.record_id.split("/")[0] for r in warc.read_archive(spark, str(tmp_path / "b")).where("not intact").collect()] == ["7"]


def test_warc_ties_extra_columns_and_nothing(spark, tmp_path):
    page = "é" * 200
    rows = [(9, "b", page), (9, "a", page), (9, "a", page), (None, "c", page), (12, None, page), (1, "u", "s" * 99), (2, "u", "s" * 99)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("payload", "first", "record_id", "key", "n", "data", "payload_digest")})
    warc.write_archive(warc.classify(d), str(tmp_path / "t"))
    got = warc.read_archive(spark, str(tmp_path / "t")).collect()
    kinds = sorted((r.record_id.split("/")[0], r.url, r.warc_type) for r in got)
    assert kinds == sorted([("9", "a", "response"), ("9", "a", "response"), ("9", "b", "revisit"), ("null", "c", "revisit"), ("12", "", "revisit"), ("1", "u", "response"), ("2", "u", "response")])
    assert {r.refers_to for r in got if r.warc_type == "revisit"} == {"9"} and all(r.intact for r in got)
    warc.write_archive(warc.classify(d.limit(0)), str(tmp_path / "n"))
    assert warc.read_archive(spark, str(tmp_path / "n")).count() == 0


def test_warc_oversized_payload(spark, tmp_path):
    d = spark.range(2).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.concat(F.lit("日本"), F.col("id").cast("string")), 6_000_000).alias("html"))
    warc.write_archive(warc.classify(d), str(tmp_path / "o"))
    got = {r.record_id.split("/")[0]: r for r in warc.read_archive(spark, str(tmp_path / "o")).collect()}
    for i in "01":
        assert got[i].intact and got[i].payload_bytes == 42_000_000 and got[i].payload_digest == hashlib.sha256(("日本" + i).encode() * 6_000_000).hexdigest()


# 6
def test_text_stats(spark):
    rows = [*EDGE, (20, "a b c d e f a b c d e g\nsame line\nsame line\n\n#x $"), (21, "z " * 12)]
    got = {r.doc_id: r for r in quality_rules.text_stats(docs(spark, rows, extra=True)).collect()}
    for i, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
        wins = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        hit = {k + j for k, x in enumerate(wins) if wins.count(x) > 1 for j in range(5)} if len(w) < 200 else set(range(len(w)))
        lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))


def test_binomial_bound(spark):
    from math import comb

    rows = [(0, 50), (1, 400), (3, 900), (9, 1000), (30, 1000)]
    d = spark.createDataFrame(rows, "k long, n long")
    for r in d.select("k", "n", quality_rules.binomial_cdf(F.col("k"), F.col("n"), 0.01).alias("p")).collect():
        want = sum(comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1)) if r.k < r.n * 0.01 else 1.0
        assert r.p == pytest.approx(want, rel=1e-9)


def test_rules_edges(spark):
    got = quality_rules.apply_rules(docs(spark, EDGE), labels(spark)).collect()
    assert len(got) == len(EDGE) and all(r.kept == (not r.base_failed) for r in got)
    assert quality_rules.apply_rules(docs(spark, []), labels(spark)).count() == 0


def test_all_rules_together_stay_within_alpha(spark):
    rows = [(i, "plain words stand here in a row of ten words " + ("# $ % & | < > " * 3 if i % 100 == 0 else "") + ("longestwordofall" * 9 if i % 100 == 1 else "") + f" n{i}") for i in range(4000)]
    d = docs(spark, rows)
    good = labels(spark, [(i, 1, 0) for i in range(0, 4000)])
    got = quality_rules.apply_rules(d, good, alpha=0.01).collect()
    lost = sum(not r.kept and not r.base_failed for r in got)
    assert lost <= 0.01 * len(got)  # each of two rules alone would lose 1 %
    loose = quality_rules.apply_rules(d, good, alpha=0.2).collect()
    assert 0 < sum(not r.kept and not r.base_failed for r in loose) <= 0.2 * len(loose)


# 7
@pytest.mark.parametrize("small", [1, 8])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(near_dup, "SMALL", small)
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    rng = np.random.default_rng(7)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(40):  # copies with ever more edits: some link only through others
        w = list(base)
        for k in rng.choice(120, i // 4, replace=False):
            w[k] = f"e{i}x{k}"
        rows.append((100 + i, " ".join(w)))
    rows += [(200, "one two"), (201, "One  TWO"), (202, "one two three"), *EDGE]
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    top = {i: i for i in sets if i is not None}
    changed = True
    while changed:
        changed = False
        for a in top:
            for b in top:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and top[b] < top[a]:
                    top[a], changed = top[b], True
    got = near_dup.near_duplicates(docs(spark, rows, extra=True), 3, 85, 100).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        assert (r.component_id, r.kept) == ((None, True) if r.doc_id is None else (top[r.doc_id], top[r.doc_id] == r.doc_id))
    assert near_dup.near_duplicates(docs(spark, []), 3, 85, 100).count() == 0


def test_repeated_ids_are_one_node(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (9, b), (11, c), (12, c), (12, "z1 z2 z3"), (2, "z1 z2 z3"), (20, "alone here now"), (20, "")]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in near_dup.near_duplicates(docs(spark, rows), 3, 85, 100).collect()}
    assert got == {(3, 28): 3, (5, 28): 3, (9, 28): 3, (11, 28): 2, (12, 28): 2, (12, 1): 2, (2, 1): 2, (20, 1): 20, (20, 0): 20}


@pytest.mark.parametrize("n, num", [(5, 80), (3, 85)])
def test_near_duplicates_of_all_documents(spark, n, num):
    from collections import Counter, defaultdict

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets, where = {}, defaultdict(list)
    for r in d.collect():
        w = words(r.text)
        sets[r.doc_id] = {" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
        for g in sets[r.doc_id]:
            where[g].append(r.doc_id)
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in sets.items():
        for j, both in Counter(j for g in s for j in where[g] if j > i).items():
            if 100 * both >= num * (len(s) + len(sets[j]) - both):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(d, n, num, 100).collect()}
    assert got == {i: root(i) for i in sets} and len(set(got.values())) < len(got)


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    x, y = near_dup.registers(near_dup.minima(a[:2800])), near_dup.registers(near_dup.minima(a[200:]))
    assert abs((x == y).mean() - 2600 / 3000) < 0.1
    z = near_dup.registers(near_dup.minima(rng.integers(0, 2**63, 3000, dtype=np.uint64)))
    assert (x == z).mean() < 0.03


# 8
def test_licenses(spark):
    long = "word " * 300_000 + "Permission is hereby\n * granted, free of charge, to any person obtaining a copy"
    rows = [*EDGE, (30, "The MIT License. mit LICENSE"), (31, "Licensed under the Apache License, Version 2.0."), (32, "GNU Lesser General Public License v2.1"), (33, "SPDX-License-Identifier: BSD-3-Clause"), (34, "permit license smitten"), (35, long), (35, "GNU General\nPublic License version 2")]
    got = {(r.doc_id, r.n_words): r for r in licenses.scan(docs(spark, rows, extra=True)).collect()}
    one = {i: r for (i, _), r in got.items()}
    assert (one[30].n_base, one[30].first_word, one[30].last_word, one[30].labels) == (2, 1, 3, "mit")
    assert one[31].labels == "apache,apache-2.0" and one[32].labels == "gpl,lgpl-2.1" and one[33].labels == "bsd-3-clause"
    assert (one[34].n_base, one[34].labels, one[34].score) == (0, "", 0.0) and one[1].n_words == 0
    assert got[35, 300_013].labels == "mit" and got[35, 6].labels == "gpl,gpl-2.0"
    assert licenses.scan(docs(spark, [])).count() == 0
    assert len(license_rules.SIGNATURES.strip().splitlines()) > 200


def samples(nodes):
    """Strings that a parsed pattern matches; every alternative is in one of them."""
    sre, out = license_rules.sre, []
    for op, arg in nodes:
        if op is sre.LITERAL:
            out.append([chr(arg)])
        elif op is sre.ANY:
            out.append(["z"])
        elif op is sre.IN:
            kind, value = arg[0]
            out.append([chr(value) if kind is sre.LITERAL else chr(value[0]) if kind is sre.RANGE else {sre.CATEGORY_SPACE: " ", sre.CATEGORY_DIGIT: "1"}.get(value, "w")])
        elif op is sre.SUBPATTERN:
            out.append(samples(arg[-1]))
        elif op is sre.BRANCH:
            out.append([s for side in arg[1] for s in samples(side)])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            once = samples(arg[2])
            out.append([s * max(arg[0], 1) for s in once] + ([""] if arg[0] == 0 else []))
        else:
            assert op in (sre.AT, sre.ASSERT_NOT)
    return ["".join(v[k % len(v)] for v in out) for k in range(max(map(len, out), default=1))] if out else [""]


def test_every_licence_rule_passes_the_prefilter_wrapped_or_not():
    scanner, seen = licenses.Scanner(), 0
    for i, r in enumerate(scanner.rules):
        for s in samples(license_rules.sre.parse(r.pattern)):
            for text in (s, re.sub(r"\s+", "\n", s), re.sub(r"\s+", "  ", s)):
                if scanner.compiled[i].search(text):
                    seen += 1
                    assert i in scanner.candidates(text), (r, text)
                else:
                    assert text != s or "(?!" in r.pattern, (r, text)
        assert scanner.compiled[i].search(re.sub(r"\s+", "\n", samples(license_rules.sre.parse(r.pattern))[0])), r
    assert seen > 3 * len(scanner.rules)


def test_license_scan_against_all_rules_and_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in licenses.op8_license_scan(spark, sf).collect()}
    scanner = licenses.Scanner()
    every = list(range(len(scanner.rules)))
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        low = (r.text or "").encode().translate(licenses._UPPER).decode()
        want = scanner.detections(low, every)
        assert [(d.start, d.end, d.rule) for d in got[r.doc_id].detections] == [(a, b, x.name) for a, b, x in want]
    sql = f"""
    WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM '{sf}/documents.parquet'),
    p AS (SELECT doc_id, unnest(range(0, len(ws))) AS i, ws FROM w),
    h AS (SELECT doc_id, i, CASE WHEN ws[i + 1] = 'mit' AND ws[i + 2] = 'license' THEN 'mit' WHEN ws[i + 1] = 'apache' AND ws[i + 2] = 'license' THEN 'apache'
        WHEN ws[i + 1] = 'general' AND ws[i + 2] = 'public' AND ws[i + 3] = 'license' THEN 'gpl' END AS label FROM p)
    SELECT w.doc_id, len(ws), count(label), min(i) FILTER (label IS NOT NULL), max(i) FILTER (label IS NOT NULL), coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '')
    FROM w LEFT JOIN h USING (doc_id) GROUP BY w.doc_id, ws"""
    rows = duckdb.sql(sql).fetchall()
    assert len(rows) == len(got) and any(n for _, _, n, *_ in rows)
    for i, *rest in rows:
        r = got[i]
        assert [r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels] == rest
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_containment():
    rules = tuple(license_rules.Rule(n, n, f, p, 1.0, n) for n, f, p in (("a", "x", 9), ("b", "x", 5), ("c", "y", 10)))
    assert licenses.suppress([(0, 10, 0), (2, 5, 1), (3, 6, 2), (0, 10, 1), (9, 12, 1)], rules) == [(0, 10, 0), (3, 6, 2), (9, 12, 1)]


# 9
@pytest.mark.parametrize("known", [3, 3 << 16])
def test_byte_bpe_equals_tiktoken(spark, known):
    import tiktoken

    ranks = byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [t for _, t in EDGE] + ["! a! !", "  \n\n\t x　y\x85z \x1c", "I'll don't 'S", "नमस्ते 👍🏽", "a" * 200, "a" * 2000, "\\d \0 ￿ q", "<|endoftext|>\r\n \r\n", "thequickbrownfox" * 40 + " end", "ab cd " * 50_000, "-" * 300 + "é" * 300]
    d = docs(spark, list(enumerate(texts)) + [(None, "no id"), (0, "another text")], extra=True)
    codec = byte_bpe.public_codec(spark)
    got = codec.encode(d, known).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [0, *range(len(texts))]
    for r in got:
        t = bytes(r.decoded).decode()
        assert t in ("no id", "another text") or t == (texts[r.doc_id] or "")
        ids = enc.encode_ordinary(t)
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids)
    assert byte_bpe.digests(docs(spark, []), codec).count() == 0


def test_byte_bpe_of_all_documents(spark):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in byte_bpe.op9_byte_bpe(spark, sf).collect():
        ids = enc.encode_ordinary(texts.pop(r.doc_id))
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(enc.decode(ids).encode()).hexdigest()
    assert not texts


def test_words_are_the_matches_of_the_pattern():
    import regex

    cut = regex.compile(P.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
    assert byte_bpe.PATTERN == P.PATTERN
    rng = np.random.default_rng(5)
    parts = ["'", "''", "s", "'s", "'re", "'ll", "'LL", "t", "ve", " ", "  ", "\n", "\t ", " \n", "　", "\x1c", "a", "É", "日", "1", "½", ".", "_", "😀", "\u0301", "\xa0", "don't", "\r\n"]
    for _ in range(4000):
        text = "".join(rng.choice(parts, rng.integers(1, 12)))
        assert byte_bpe.words(text) == cut(text), repr(text)


def test_long_words_merge_in_rank_order():
    import tiktoken

    ranks = byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(9)
    for n in (1, 2, 3, 50, 400, 3000):
        w = "".join(rng.choice(list("aeinrst éü"), n))
        assert byte_bpe.merged(w.encode(), ranks) == enc.encode_ordinary(w)


# 10
def test_chat_fold(spark):
    e = [(1, 1, 0, "message", "user", "hi"), (1, 2, 1, "message", "assistant", "He"), (1, 3, 1, "delta", None, "llo"), (1, 4, 2, "message", "user", "more"), (1, 5, 1, "edit", None, "Hello!"), (1, 6, 3, "message", "assistant", "old"), (1, 7, 1, "regenerate", "assistant", "New"), (1, 8, 1, "delta", None, " one"), (1, 9, 2, "message", "user", "then"), (None, None, None, None, None, None), (2, 1, 0, "delta", "user", "lone")]
    d = spark.createDataFrame(e, "conv_id long, seq long, turn long, kind string, role string, text string").withColumn("extra", F.lit(1))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.parse(chat.render(chat.reconstruct(d))).collect()}
    assert got == {1: [("user", "hi"), ("assistant", "New one"), ("user", "then")], None: [("", "")], 2: [("user", "lone")]}
    assert chat.render(chat.reconstruct(d.where("conv_id > 5"))).count() == 0


def test_chat_escapes_and_mask(spark):
    texts = [r"\### Assistant: </turn> ok", "\\b\\e\\h", "####</turn></turn", "</turn>\n", "", "x" * 20_000, "a\\", "﻿😀 é", "日" * 9]
    rows = [(i, 0, 0, "message", "assistant", t) for i, t in enumerate(texts)] + [(i, 1, 1, "message", "us:er###", t) for i, t in enumerate(texts)] + [(i, 2, 2, "message", "assistant", f"{t}!") for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "conv_id long, seq long, turn long, kind string, role string, text string")
    rendered = chat.render(chat.reconstruct(d))
    for r in chat.parse(rendered).collect():
        t = texts[r.conv_id]
        assert [(x.role, x.text) for x in r.turns] == [("assistant", t), ("us:er###", t), ("assistant", f"{t}!")]
        assert r.loss == [t, f"{t}!"] and len(r.loss_spans) == 2
        for s, want in zip(r.loss_spans, r.loss, strict=True):
            body = r.formatted[s.start : s.start + s.len]
            for code, plain in (("\\h", "###"), ("\\e", "</turn>"), ("\\b", "\\")):
                body = body.replace(code, plain)
            assert body == want
    # The loss is what lies under the mask, not what the turns say.
    moved = rendered.withColumn("loss_spans", F.transform("loss_spans", lambda s: F.struct((s.start + 1).alias("start"), s.len.alias("len"))))
    assert [r.loss[0] for r in chat.parse(moved).where("conv_id = 5").collect()] == ["x" * 19_999 + "<"]
    assert chat.parse(rendered.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "encode"]
    got = cp.run(spark, sf).collect()
    assert 0 < len(got) <= d.count() and all(r.n_tokens >= 0 for r in got)
    kept = cp.near_dedup(spark, d, sf)
    assert kept.columns == d.columns
    sets = {r.doc_id: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for r in kept.collect() if (w := words(r.text))}
    ids = sorted(sets)
    assert not [(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]


def test_pipeline_on_nulls_copies_and_clashing_names(spark, tmp_path):
    import corpus_pipeline as cp

    rng = np.random.default_rng(20)
    text = lambda n: " ".join(f"k{i}" for i in rng.integers(0, 9999, n))
    a, item = text(200), text(40)
    near = a.split()
    near[100] = "other"
    rows = [(1, a), (2, a), (3, " ".join(near)), (4, f"{text(30)} {item} {text(30)}"), (5, None), (6, ""), (None, text(60)), (7, text(80)), (8, f"{text(9)}\n{text(20)}")]
    d = docs(spark, rows).withColumns({c: F.lit(c) for c in ("score", "n_lines", "n_removed_chunks", "kept", "_sw_score0", "label", "item_id")})
    d.write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in cp.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == d.columns and now.dtypes == d.dtypes, name
        seen.append(sorted(r.doc_id for r in now.collect() if r.doc_id is not None))
        assert all(r.n_lines == "n_lines" and r.score == "score" for r in now.select("n_lines", "score").collect())
    assert seen == [[1, 2, 3, 4, 5, 6, 7, 8], [1, 3, 4, 5, 6, 7, 8], [1, 4, 5, 6, 7, 8], [1, 5, 6, 7, 8]]
    got = cp.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [1, 5, 6, 7, 8] and len(got) == 6
    assert {r.decoded_sha256 for r in got if r.doc_id in (5, 6)} == {hashlib.sha256(b"").hexdigest()}
    d.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_pairs_are_fitted_by_logistic_loss():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [2.0, -1.0, 0.0])))).astype(int)
    m = pairwise_quality.fit(x, y, {0: int((y == 0).sum()), 1: int(y.sum())})
    z = (x - m.mean) / m.scale
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    diff = (z[good][:, None] - z[bad][None]).reshape(-1, 3)  # all pairs; the fit drew some of them
    loss = lambda w: np.logaddexp(0, -diff @ w).mean() + 0.5 * pairwise_quality.L2 * (w * w).sum()
    assert loss(m.weights) <= min(loss(m.weights * s) for s in (0.7, 0.85, 1.15, 1.3)) + 1e-4
    assert m.weights[0] > 0 > m.weights[1] and abs(m.weights[2]) < 0.3
    s = m.scores(x)
    assert abs(s.mean() - y.mean()) < 0.02 and (s[y == 1].mean() > s[y == 0].mean() + 0.2)


def test_quality_of_long_and_equal_texts(spark):
    rows = [(1, "word " * 400_000), (2, "same text here"), (3, "same text here"), (3, "another one"), (4, "#" * 300_000)]
    lab = labels(spark, [(i, i % 2, 0) for i in range(200)] + [(7, None, None), (None, 1, 0)])
    d = docs(spark, [*rows, *((i, ("a good plain text, it says things. " if i % 2 else "@@ ## buy BUY BUY ") * 5) for i in range(10, 200))], extra=True)
    m = pairwise_quality.train(d, lab)
    got = {}
    for r in pairwise_quality.score(d, m).collect():
        got.setdefault(r.doc_id, set()).add(r.score)
    assert got[2] == got[3] & got[2] and len(got[3]) == 2 and all(0 <= s <= 1 for x in got.values() for s in x)
    assert min(got[11]) > 0.5 > max(got[10])


def test_rules_on_long_texts_ties_and_clashing_names(spark):
    rows = [(1, "alpha beta gamma delta epsilon " * 60_000), (2, "q " * 9), (2, "ten plain words stand in this short text right here"), (3, None), (None, "x" * 500_000)]
    got = quality_rules.apply_rules(docs(spark, rows, extra=True).withColumn("stratum", F.lit("z")).withColumn("symbol_ratio", F.lit(9)), labels(spark, [(1, 1, 0), (1, 0, 0), (2, 1, 1)])).collect()
    by = {(r.doc_id, r.n_words): r for r in got}
    assert len(got) == 5 and by[1, 300_000].n_repeat_words == 300_000 and by[1, 300_000].base_failed
    assert not by[2, 10].base_failed and by[2, 10].kept and by[2, 9].base_failed and by[3, 0].base_failed and by[None, 1].word_chars == 500_000


def test_near_duplicates_of_long_texts_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL", 2)
    monkeypatch.setattr(near_dup, "BLOCK", 2)
    base = [f"b{i}" for i in range(30_000)]
    rows = []
    for i in range(8):
        w = list(base)
        for k in range(i * 900, i * 900 + 450):
            w[k] = f"c{i}x{k}"
        rows.append((i + 1, " ".join(w)))
    rows += [(50, " ".join(f"z{i}" for i in range(30_000)))]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs(spark, rows), 3, 85, 100).collect()}
    assert got == {**{i: 1 for i in range(1, 9)}, 50: 50}


def test_line_dedup_of_long_texts_and_ties(spark):
    block = "\n".join(f"line {i} of a long text that is here " + "v " * (i % 5) for i in range(30_000))
    rows = [(1, f"start\n{block}\nend"), (2, block), (2, block), (3, "tie one\ntie two\ntie one\ntie two")]
    got = line_chunks.dedup_lines(docs(spark, rows)).collect()
    assert sorted((r.doc_id, len(r.text.split("\n"))) for r in got if r.doc_id != 3)[0] == (1, 30_002)
    assert all(r.text == "" or r.doc_id != 2 for r in got) and [r.text for r in got if r.doc_id == 3] == [brute_line_dedup([(3, rows[3][1])])[3]]
