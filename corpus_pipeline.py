"""From raw documents to token ids, in five stages that each apply one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet into the
shared folder and gives what is read back to the next one. All stages but the last return the
columns of `documents`.

* quality: documents that the base rules or the learned decision list reject go.
* lines: recurring lines are taken out of the texts (n_chars follows); a document of which nothing
  but recurring lines was left goes.
* near_duplicates: of each group of near copies (five-word shingles, similarity 0.8 or more) the
  document with the smallest id stays; of rows that repeat an id the one whose text has the least
  hash, of equal rows one. Rows without an id have no place in a group and stay.
* decontaminate: documents that hold a passage of a benchmark item go.
* tokens: each text as the ids of SentencePiece, with digests of the ids and of the decoded text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, line_templates, ngram_join, quality_rules, sentence_pieces
from lodestone.llm.tables import drop, read, settle, small_batches


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_templates.without_recurring_lines(docs)
    changed = F.col("n_dropped_lines") > 0
    left = left.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    groups = ngram_join.link_components(docs, width=5, num=80, den=100)
    first = groups.where("doc_id = component_id").select("doc_id")
    kept = docs.join(first, "doc_id", "left_semi").select(docs.columns)
    rest = F.struct(*(F.col(c) for c in docs.columns))
    one = kept.groupBy("doc_id").agg(F.min_by(rest, F.struct(F.xxhash64("text"), F.xxhash64(*docs.columns))).alias("__row")).select("__row.*")
    return one.unionByName(docs.where("doc_id is null"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return sentence_pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_ids=True)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminated), ("tokens", tokens)]

#: The learned list, the template tree and the encoder have no SQL; tests hold each stage against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        made = settle(stage(spark, docs, sf_dir), name)
        drop(docs)
        docs = made
    return settle(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
