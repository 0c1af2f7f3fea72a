"""Gates, functions, sources and operators on small fixtures."""

import json
import math
import re
import struct
import zipfile

import pytest
import xxhash
from pyspark.sql import functions as F

from sievework import gates
from sievework.functions import perturb, stats
from sievework.functions import text as tx
from sievework.operators import costs, dedup, metrics, ranking, splits
from sievework.sources import ingest


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_gates_fire(spark):
    a = frame(spark, [(1, "x"), (2, "y")], "id long, y string")
    b = frame(spark, [(1, "x"), (2, "z")], "id long, y string")
    gates.unique_key(a, "id")
    gates.same_ids(a, b, "id")
    with pytest.raises(gates.GateError, match="different y: 2"):
        gates.equal_values(a, b, "id", "y")
    with pytest.raises(gates.GateError, match="repeated id: 1"):
        gates.unique_key(a.union(a.where("id = 1")), "id")
    with pytest.raises(gates.GateError, match="missing id: 2"):
        gates.covers(a, b.where("id = 1"), "id")
    assert gates.content_hash(a) == gates.content_hash(a.repartition(3))


def test_normalized_and_shingles(spark):
    rows = [("XXXX paid  $5!",), ("",), (None,), ("a b",)]
    d = frame(spark, rows, "t string").select(tx.tokens(F.col("t")).alias("t"))
    got = [(r.t, r.s) for r in d.select("t", tx.shingles(F.col("t")).alias("s")).collect()]
    assert got == [(["x", "paid", "5"], ["x paid 5"]), ([], [tx.EMPTY]), ([], [tx.EMPTY]), (["a", "b"], ["a b"])]


def test_char_wb(spark):
    got = frame(spark, [("abc d",)], "t string").select(tx.char_wb_ngrams(F.col("t"), 3, 4)).first()[0]
    assert sorted(got) == sorted([" ab", "abc", "bc ", " abc", "abc ", " d "])


def test_hamilton():
    assert stats.hamilton({"a": 7, "b": 3}, 5) == {"a": 4, "b": 1}
    assert sum(stats.hamilton({"a": 1, "b": 1, "c": 1000}, 500).values()) == 500
    assert stats.hamilton({"a": 2}, 9) == {"a": 2}


def test_quotas_match_hamilton(spark):
    counts = {"a": 7, "b": 3, "c": 11}
    d = frame(spark, list(counts.items()), "s string, n long")
    for target in (0, 1, 5, 13, 21, 40):
        assert {r.s: r.quota for r in ranking.quotas(d, "s", "n", target).collect()} == stats.hamilton(counts, target)


def test_mcnemar():
    assert stats.mcnemar_p(0, 0) == 1.0
    assert stats.mcnemar_p(1, 5) == pytest.approx(0.21875)
    assert 0 < stats.mcnemar_p(900, 1100) < 1e-4


def test_rank_matches_sort(spark):
    d = frame(spark, [(i, (i * 7 % 5) / 10) for i in range(50)], "id long, p double")
    got = {r.id: r["rank"] for r in ranking.ranked(d, F.col("p").desc(), F.col("id").asc()).collect()}
    want = sorted(range(50), key=lambda i: (-(i * 7 % 5), i))
    assert [got[i] for i in want] == list(range(1, 51))


def brute_curve(rows):
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    errors, out = 0, []
    for k, (_, _, c) in enumerate(order, 1):
        errors += 1 - c
        out.append(errors / k)
    return out


def test_aurc(spark):
    rows = [(i, round(((i * 13) % 7) / 7, 3), int(i % 3 > 0)) for i in range(60)]
    d = frame(spark, rows, "id long, p_max double, correct int")
    want = brute_curve(rows)
    assert metrics.aurc(metrics.risk_coverage(d, "id")).first()[0] == pytest.approx(sum(want) / len(want))
    acc = {r.coverage: r.accuracy for r in metrics.accuracy_at_coverage(d, "id", (0.01, 0.5, 1.0)).collect()}
    for c, a in acc.items():
        assert a == pytest.approx(1 - want[max(1, math.ceil(c * 60)) - 1])


def test_threshold_sweep_by_hand(spark):
    d = frame(spark, [(0.9, 1), (0.7, 1), (0.5, 0), (0.3, 0)], "p_max double, correct int")
    arm = {"correct": F.lit(1), "to_human": F.lit(1), "api": F.lit(0.0)}
    s = {r.tau: r.cost_per_1k for r in costs.sweep(costs.grid(d, arm), 10.0, 1.0).collect()}
    assert s == {math.inf: 1000.0, 0.9: 750.0, 0.7: 500.0, 0.5: 2750.0, 0.3: 5000.0}
    assert costs.cheapest(costs.sweep(costs.grid(d, arm), 10.0, 1.0)).first().tau == 0.7


def test_clusters_keep_earliest_then_smallest(spark):
    t = "one two three four five six seven"
    rows = [(10, t, 5), (11, t.upper() + "!", 3), (12, t, 3), (20, "other words entirely in this text here", 1), (30, "", 2), (31, None, 1)]
    got = {r.id: (r.cluster_id, r.kept) for r in dedup.clusters(frame(spark, rows, "id long, t string, day int"), "id", "t", "day").collect()}
    assert got == {10: (11, False), 11: (11, True), 12: (11, False), 20: (20, True), 30: (31, False), 31: (31, True)}


def test_unrelated_texts_stay_apart(spark):
    """Texts that share a third of their shingles are no near-copies; one changed word in 400 makes one."""
    w = lambda i, n: [f"w{i}x{k}" for k in range(n)]
    rows = [(i, " ".join(w("common", 80) + w(i, 80))) for i in range(30)]
    long = w("long", 400)
    rows += [(100, " ".join(long)), (101, " ".join([*long[:200], "other", *long[201:]]))]
    d = frame(spark, rows, "id long, t string").withColumn("day", F.lit(0))
    got = {r.id: r.cluster_id for r in dedup.clusters(d, "id", "t", "day").collect()}
    assert got == {i: i for i in range(30)} | {100: 100, 101: 100}
    b = dedup.bands(d, "id", "t")
    assert b.count() == 32 * 8 and {len(r.key) for r in b.collect()} == {64}


def test_leaks_between_splits(spark):
    w = lambda i, n: [f"w{i}x{k}" for k in range(n)]
    long, half = w("a", 200), w("b", 40)
    near = [*long[:100], "other", *long[101:]]
    rows = [(1, " ".join(long)), (2, " ".join(near)), (4, " ".join(near)), (3, " ".join(half)), (6, " ".join(half[:20] + w("c", 20))), (5, "two words"), (8, "Two words!"), (7, ""), (10, None), (12, " ".join(long))]
    d = frame(spark, rows, "id long, t string")
    got = {(r.first_id, r.second_id): (r.shared, r.n_union, r.n_first, r.n_second) for r in dedup.split_leaks(d, "id", "t", F.col("id") % 2 == 1).collect()}
    assert got == {(1, 12): (196, 196, 1, 1), (1, 2): (191, 201, 1, 2), (5, 8): (1, 1, 1, 1)}
    assert dedup.split_leaks(d.limit(0), "id", "t", F.col("id") % 2 == 1).count() == 0


def test_overlaps(spark):
    d = frame(spark, [(1, "2020-01-31"), (2, "2020-02-01"), (3, "2019-01-01")], "id long, d string")
    got = splits.assigned(d, "d", (("a", "2020-01-01", "2020-02-01"), ("b", "2020-02-01", None)))
    assert sorted((r.id, r.split) for r in got.collect()) == [(1, "a"), (2, "a"), (2, "b")]
    assert [tuple(r) for r in splits.overlaps(got, "id").collect()] == [("a", "b", 1)]


def brute_perturbed(text, family, rate, seed, key):
    """The rule in plain loops, over the same draws."""
    bits = lambda data, s: xxhash.xxh64(data, seed=s).intdigest()
    told = f"{seed}:{family}:{float(rate)!r}:" + ("\x00" if key is None else str(key))
    k = bits(told.encode(), 42)
    draw = lambda i, part: (bits(struct.pack("<i", i), bits(struct.pack("<Q", k), 42)) >> (20 * part) & 0xFFFFF) / 2**20
    text, out = text or "", []
    other = {a: b for pair in perturb.CONFUSED for a, b in (pair, pair[::-1])}
    if family == "ocr":
        units = re.findall("(?s)cl|rn|.", text)
        return "".join(other.get(c, c) if draw(i, 0) < rate else c for i, c in enumerate(units))
    if family == "case":
        swap = lambda c: c.upper() if c == c.lower() else c.lower()
        return "".join(swap(c) if draw(i, 0) < rate and len(swap(c)) == 1 else c for i, c in enumerate(text))

    def near(i):
        keys = perturb.NEIGHBOURS.get(text[i].lower())
        if not keys:
            return text[i]
        c = keys[int(draw(i, 2) * len(keys))]
        return c if text[i] == text[i].lower() else c.upper()

    hit = [draw(i, 0) < rate and not c.isspace() for i, c in enumerate(text)]
    asks = [h and 0.6 <= draw(i, 1) < 0.8 for i, h in enumerate(hit)]
    moves = [a and not (i and asks[i - 1]) and i + 1 < len(text) for i, a in enumerate(asks)]
    for i, c in enumerate(text):
        u = draw(i, 1)
        if moves[i]:
            out.append(text[i + 1])
        elif i and moves[i - 1]:
            out.append(text[i - 1])
        elif not hit[i] or 0.6 <= u < 0.8:
            out.append(c)
        else:
            out.append(near(i) if u < 0.4 else "" if u < 0.6 else c + near(i))
    return "".join(out)


@pytest.mark.parametrize("family", perturb.FAMILIES)
def test_perturbations(spark, family):
    texts = ["The quick brown fox jumps over the lazy dog " * 5, "clear corn B0lS1 mm\n\trn é ß İ 😀 Ab", "", None, "x", "  \n"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0])]
    d = frame(spark, rows, "id long, text string")
    for rate in (0.0, 0.3, 1.0):
        got = {r.id: r.t for r in d.repartition(5).select("id", perturb.perturbed("text", "id", family, rate, 7).alias("t")).collect()}
        assert got == {i: brute_perturbed(t, family, rate, 7, i) if rate else t or "" for i, t in rows}
    assert {r.id: r.text for r in perturb.apply(d, "text", "id", None).collect()} == dict(rows)
    changed = perturb.apply(d, "text", "id", perturb.Perturbation(family, 0.3, 8)).where("id = 0").first().text
    assert changed not in (texts[0], got[0])


def test_perturbation_config():
    block = {"family": "typo", "rate": 0.1, "seed": 3}
    assert perturb.Perturbation.of_config({"perturbation": block}) == perturb.Perturbation("typo", 0.1, 3)
    assert perturb.Perturbation.of_config({}) is None
    for bad in ({**block, "extra": 1}, {**block, "rate": 1.5}, {**block, "rate": True}, {**block, "seed": 0.5}, {**block, "family": "none"}, {"family": "typo"}, "typo"):
        with pytest.raises(ValueError):
            perturb.Perturbation.of_config({"perturbation": bad})


def test_csv_ingest(spark, tmp_path):
    head = ",".join(ingest.RAW)
    row = lambda i, day, text: ",".join([day, "P", "", "", "", f'"{text}"', "", "C", "NY", "", "", "", "", "", "", str(i)])
    f = tmp_path / "x.csv"
    f.write_text("\n".join([head, row(30, "2020-01-02", 'line one\nsaid ""hi""'), row(10, "2020-01-01", "text"), row(20, "not a date", "text"), row(40, "2020-01-01", "   ")]) + "\n")
    raw = ingest.read_raw(spark, str(f))
    got = {r.complaint_id: r.narrative for r in ingest.narratives(raw).collect()}
    assert got == {30: 'line one\nsaid "hi"', 10: "text"}
    assert ingest.ingest_counts(raw) == {"total": 4, "corrupt": 0, "bad_key": 1, "kept": 2}


def test_snapshot(tmp_path):
    f, m = tmp_path / "a.zip", tmp_path / "m.yaml"
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("x.csv", "a,b\n")
    ingest.freeze(f, m, "https://example.org/a.zip", "2020-01-01")
    assert ingest.verify(f, m)["filename"] == "a.zip"
    with pytest.raises(FileExistsError):
        ingest.freeze(f, m, "", "")
    assert ingest.extracted(f, tmp_path / "x.csv").read_text() == "a,b\n"
    f.write_bytes(f.read_bytes()[:-1] + b"!")
    with pytest.raises(gates.GateError, match="sha256"):
        ingest.verify(f, m)


def test_receipts(spark, tmp_path):
    good = {"complaint_id": 1, "slug": "m", "prompt_tokens": 10, "completion_tokens": 1, "total_tokens": 11, "computed_cost_usd": 12.0}
    f = tmp_path / "r.jsonl"
    f.write_text(json.dumps(good) + "\n")
    assert ingest.read_receipts(spark, str(f), "m", 1.0, 2.0).count() == 1
    f.write_text(json.dumps(good) + "\n" + json.dumps(good | {"complaint_id": 2, "total_tokens": 5}) + "\n")
    with pytest.raises(gates.GateError, match="token total"):
        ingest.read_receipts(spark, str(f), "m", 1.0, 2.0)


def test_predictions_round_trip(spark, tmp_path):
    d = frame(spark, [(1, "a", "b", [0.2, 0.8])], "complaint_id long, y_true string, y_pred string, probs array<double>")
    ingest.write_predictions(d, str(tmp_path / "p"), ["a", "b"], {"run_id": "r"})
    got, labels, prov = ingest.read_predictions(spark, str(tmp_path / "p"))
    assert labels == ["a", "b"] and prov == {"run_id": "r"} and got.first().p_max == 0.8 and got.first().probs == [0.2, 0.8]


def test_records():
    r = lambda i, t, **x: {"run_id": i, "timestamp_utc": t, "config_path": "c", "dataset": {"split": "s"}} | x
    assert ingest.resolve_records([r("a", "1"), r("b", "2", supersedes="a")])["c", "s"]["run_id"] == "b"
    with pytest.raises(gates.GateError):
        ingest.resolve_records([r("a", "1"), r("b", "1")])


def test_stream_windows(spark, tmp_path, sf):
    from sievework.streaming.windows import as_of, hourly_stream

    spark.read.parquet(f"{sf}/events.parquet").limit(200).write.parquet(str(tmp_path / "in"))
    q = hourly_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from w").first()[0] == 200
    a = frame(spark, [("k", 5), ("k", 1)], "k string, t int")
    b = frame(spark, [("k", 2, "x"), ("k", 5, "y")], "k string, t int, v string")
    assert sorted((r.t, r.v) for r in as_of(a, b, "k", "t", "v").collect()) == [(1, None), (5, "y")]


def test_entry_smoke(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
