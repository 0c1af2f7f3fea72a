"""License scan: ordered signature rules behind a keyword prefilter.

Rules are regular expressions over lower-cased (A-Z) text, in order of priority (``license_rules``). An Aho-Corasick
automaton finds the rules' keywords in one pass; a rule is run where each group of strings that its matches must hold
has one in the text, so the prefilter saves work and loses nothing. Detections overlap:
one lying inside another (interval containment) is suppressed where the outer one has at least its
priority or its family; of equal intervals the rule of the higher priority stays. What stays gives the
labels, and the best rule's weight gives the score.

Defined cases: null text is empty: no words, no labels, score 0; ties in position and priority go to the
rule listed first; repeated rows get a row each; null doc_id passes through; extra columns are ignored.
Very long texts are scanned whole; white space between words may be of any length, other gaps of a rule are bounded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.license_rules import Rule, build_rules
from sievework.session import bound_batches, table

#: Base phrases and their labels.
PHRASES: tuple[tuple[tuple[str, ...], str], ...] = (
    (("mit", "license"), "mit"),
    (("apache", "license"), "apache"),
    (("general", "public", "license"), "gpl"),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] | None = None) -> None:
        import ahocorasick

        self.rules = build_rules() if rules is None else rules
        self.compiled = [re.compile(r.pattern) for r in self.rules]
        self.needs = [[frozenset(g) for g in r.needs] for r in self.rules]
        self.machine = ahocorasick.Automaton()
        #: Rules by the strings of their first group; rules that need nothing are always run.
        self.by_word: dict[str, list[int]] = {}
        self.always = [i for i, r in enumerate(self.rules) if not r.needs]
        for i, r in enumerate(self.rules):
            for k in r.needs[0] if r.needs else ():
                self.by_word.setdefault(k, []).append(i)
        for k in sorted({k for r in self.rules for g in r.needs for k in g}):
            self.machine.add_word(k, k)
        self.machine.make_automaton()

    def candidates(self, low: str) -> list[int]:
        """Rules that can match, by their keywords."""
        there = {k for _, k in self.machine.iter(low)}
        first = {i for k in there for i in self.by_word.get(k, ())}
        return sorted([*self.always, *(i for i in first if not any(there.isdisjoint(g) for g in self.needs[i]))])

    def detections(self, low: str, run: list[int] | None = None) -> list[tuple[int, int, Rule]]:
        """(start, end, rule) that stay after suppression, by start; ``run``: the rules to run, for the keywords' ones."""
        found = [(m.start(), m.end(), i) for i in (self.candidates(low) if run is None else run) for m in self.compiled[i].finditer(low)]
        return [(a, b, self.rules[i]) for a, b, i in suppress(found, self.rules)]


def suppress(found: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """Drops detections inside another one of at least their priority or of their own family.

    Sorted by start and falling end, every container comes before what it contains; a stack of the open
    containers is all that is compared.
    """
    kept: list[tuple[int, int, int]] = []
    open_: list[tuple[int, int, int]] = []
    for a, b, i in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        open_ = [x for x in open_ if x[1] > a]
        inside = (x for x in open_ if x[1] >= b and (rules[x[2]].priority >= rules[i].priority or rules[x[2]].family == rules[i].family))
        if next(inside, None) is None:
            kept.append((a, b, i))
            open_.append((a, b, i))
    return kept


_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bytes of words stay (0-9, a-z and all above 0x7F), every other byte becomes a space.
_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(start, label) of every place where a phrase's words stand one after another."""
    out = []
    i = -1
    while True:
        try:
            i = words.index(b"license", i + 1)
        except ValueError:
            return sorted(out)
        for phrase, label in PHRASES:
            k = len(phrase)
            if i + 1 >= k and [w.decode("utf-8") for w in words[i + 1 - k : i + 1]] == list(phrase):
                out.append((i + 1 - k, label))


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("rule", pa.string()), ("label", pa.string())])))])


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for b in batches:
        rows = []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            low = (text.as_buffer().to_pybytes() if text.is_valid else b"").translate(_UPPER)
            words = low.translate(_WORDS).split()
            places = base_places(words)
            hits = scanner.detections(low.decode("utf-8"))
            base = {label for _, label in places}
            labels = base | {r.label for _, _, r in hits}
            score = max([0.9 if places else 0.0, *(r.weight for _, _, r in hits)])
            rows.append({"doc_id": doc_id, "n_words": len(words), "n_base": len(places), "first_word": places[0][0] if places else None, "last_word": places[-1][0] if places else None, "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score, "detections": [{"start": a, "end": e, "rule": r.name, "label": r.label} for a, e, r in hits]})
        yield pa.RecordBatch.from_pylist(rows, OUT)


def scan(docs: DataFrame) -> DataFrame:
    """Base places, labels, score and detections (code points of the lower-cased text) of each document."""
    kinds = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:long,end:long,rule:string,label:string>>"
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text")).mapInArrow(scan_batches, kinds)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op8_license_scan": op8_license_scan}
ORACLE_SQL: dict[str, str] = {}
