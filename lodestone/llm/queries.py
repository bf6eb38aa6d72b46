"""The registered queries of the ten training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bilinear, decontaminate, filter_audit, line_templates, ngram_join, quality_rules, reply_trees, sentence_pieces, source_mix, suffix_dedup, training_order, turn_repair, url_trust
from lodestone.llm.sql import OP11_SQL, OP12_SQL
from lodestone.llm.tables import read, shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def op1_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT * FROM VALUES (-1, 0, 'user', '{said}'), (-1, 1, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    rows = rows.unionByName(more.select(*(F.col(f.name).cast(f.dataType) for f in rows.schema.fields)))
    made = reply_trees.conversations(reply_trees.linear(rows, "conv_id", "turn"))
    turns = F.array_join(F.transform(reply_trees.parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = reply_trees.under_loss(F.col("formatted"), F.col("loss"))
    made = made.select(F.col("tree").alias("conv_id"), "n_turns", "formatted", turns.alias("turns"), learned.alias("learned"))
    return made.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


#: Escaping breaks each control string up by a backslash; the template adds 18 characters a turn.
def _escaped_sql(column: str) -> str:
    out = f"replace(coalesce({column}, ''), '\\', '\\\\')"
    for c in reply_trees.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP1_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         length({_escaped_sql("role")}) + length({_escaped_sql("text")}) + 18 AS chars
  FROM (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(read(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.clean(read(spark, sf_dir, "documents"))


def op4_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_templates.without_recurring_lines(read(spark, sf_dir, "documents"))
    return left.select("doc_id", F.col("n_dropped_lines").cast("long"), F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards into a new folder below the shared one; the rows are read back from there."""
    folder, key = f"{shared_dir(spark)}/training-{uuid.uuid4().hex}", 20240229
    if "://" not in folder:
        folder = f"file://{folder.removeprefix('file:')}"
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    made = training_order.materialise(read(spark, sf_dir, "documents"), folder, path, public_tokenizers.PATTERN, end=50256, key=key)
    return training_order.read_shards(made, folder, key).withColumn("payload_sha256", F.sha2("payload", 256)).drop("payload")


URL_RULES = [url_trust.UrlRule(v, h, p) for v, h, p in (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))]


def op9_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op10_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bilinear.score(read(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    return turn_repair.repair(turn_repair.damaged(rows), rows)


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_reply_trees, op2_ngram_join, op3_suffix_dedup, op4_sentence_pieces, op5_quality_rules, op6_decontaminate, op7_line_templates, op8_training_order, op9_url_trust, op10_bilinear, op11_filter_audit, op12_turn_repair, op13_source_mix)}


def oracle_sql() -> dict[str, str]:
    return {"op1_reply_trees": OP1_SQL, "op11_filter_audit": OP11_SQL, "op12_turn_repair": OP12_SQL}
