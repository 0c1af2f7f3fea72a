"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Stage functions take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents.

1. quality: documents whose score lies below the cut go. The cut is the 0.2 % score quantile of all labelled good
   documents of the training side, at most 0.5, from the pairwise ranking model.
2. line_dedup: repeated multi-line passages are removed from texts; n_chars follows. Documents that had words and
   have none left go: all they held is in an earlier document.
3. near_dedup: of each group of near-duplicates (word shingles of five, similarity 0.8 or more) the document of the
   smallest id stays. Documents without an id or without words are no near-duplicates and stay.
4. decontaminate: documents that hold a passage of a benchmark item go.
5. encode: byte-level BPE ids of every text, as counts and digests, with the digest of what they decode to.

Null ids and other columns pass through, whatever their names (the counts of line_dedup are only replaced inside of
it); a null text is empty, and the empty string from line_dedup on; repeated rows are kept or dropped together; empty
tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import byte_bpe, decontaminate, line_chunks, near_dup, pairwise_quality
from sievework.session import new_path, table

LOST_GOOD_SHARE = 0.002
SHINGLE, NUM, DEN = 5, 80, 100
_WORD = r"[^\x20\x09-\x0D]"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = pairwise_quality.train(docs, table(spark, sf_dir, "labels"))
    cut = model.quantile_cut(LOST_GOOD_SHARE)
    name = next(n for n in (f"_sw_score{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    scored = pairwise_quality.score(docs, model, tuple(docs.columns), name)
    return scored.where(F.col(name) >= cut).drop(name)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = ("n_lines", "n_removed_lines", "n_removed_chunks")
    kept = docs.withColumnsRenamed({c: f"_sw_own_{c}" for c in own if c in docs.columns})
    got = line_chunks.dedup_lines(kept)
    emptied = (F.col("n_removed_chunks") > 0) & ~F.col("text").rlike(_WORD)
    changed = F.when(F.col("n_removed_chunks") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    out = got.where(~emptied).withColumn("n_chars", changed).drop(*own)
    return out.withColumnsRenamed({f"_sw_own_{c}": c for c in own}).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(docs.select("doc_id", "text"), SHINGLE, NUM, DEN)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(docs, byte_bpe.public_codec(spark))


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("encode", encode),
]
#: Scores, alignment and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = new_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
