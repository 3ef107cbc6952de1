"""The operators applied to whole tables, one query each, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansight.llm import bpe, chat, hilbert, langid, line_crf, line_dedup, mixing, near_dedup, quality, toxicity
from plansight.llm.common import fold, read


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    codec = bpe.ByteBpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = codec.encode_and_decode(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read(spark, sf_dir, "documents"), fold("doc_id", 3) == 1
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), learn=~held_out)
    judged = docs.select("doc_id", toxicity.judged(model, "text").alias("j"))
    return judged.select("doc_id", held_out.alias("held_out"), F.col("j.score").alias("score"), (F.col("j.score") >= 0.7).cast("int").alias("predicted"), F.col("j.offending").alias("offending"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    judged = docs.select("doc_id", line_crf.verdict(line_crf.train(docs), "text").alias("v"))
    return judged.select("doc_id", *[f"v.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read(spark, sf_dir, "documents"), fold("doc_id", 4) == 2
    model = langid.train(docs, learn=~held_out)
    found = docs.select("doc_id", langid.language(model, "text").alias("p"))
    return found.select("doc_id", held_out.alias("held_out"), "p.lang_pred", "p.score")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), "text")
    done = line_dedup.deduplicate(docs, gone="removed_lines", least_words=1)
    return done.select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines", "text")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = r"\### Assistant: </turn> ok"
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    turns = turns.unionByName(spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], turns.schema))
    examples = chat.format_examples(turns)
    loss = F.struct("example", chat.read_loss(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("said"))
    per_conv = examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("whole"),
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(loss)), lambda x: x["said"])).alias("loss"),
        F.sum(F.length("text")).alias("formatted_chars"),
    )
    per_conv = per_conv.withColumn("turns", chat.read_turns(F.col("whole")))
    told = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    return per_conv.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH turns AS (
    SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), sized AS (
    SELECT *, 6 + length(role) + len(regexp_extract_all(role, '[\\<>\n]')) + 1
              + length(text) + len(regexp_extract_all(text, '[\\<]')) + 8 AS chars,
           row_number() OVER w AS place, lead(1) OVER w IS NULL AS is_last
    FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), prefixed AS (
    SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM sized
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(upto) FILTER (role = 'assistant' OR is_last))::BIGINT AS formatted_chars
FROM prefixed GROUP BY conv_id
"""


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    taken = F.col("__mix_copies") * F.col("__mix_size")
    return mixed.select("doc_id", F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), taken.alias("taken"))


OP7_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), ranked AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source
), weighed AS (
    SELECT source, source_size, place, [5, 2, 1][(place % 3 + 1)::INT]::BIGINT AS weight, source_size * 2 AS cap FROM ranked
), levels AS (
    SELECT *, (((SELECT sum(source_size) FROM ranked) * 150)::DOUBLE / 100.0::DOUBLE - (sum(cap) OVER fill - cap)::DOUBLE)
              / (sum(weight) OVER () - sum(weight) OVER fill + weight)::DOUBLE AS level
    FROM weighed WINDOW fill AS (ORDER BY cap::DOUBLE / weight::DOUBLE, place ROWS UNBOUNDED PRECEDING)
), settled AS (
    SELECT arg_min(level, cap::DOUBLE / weight::DOUBLE) AS level FROM levels WHERE level * weight <= cap
), targets AS (
    SELECT l.source, l.source_size, least(l.cap::DOUBLE, coalesce(s.level * l.weight, l.cap::DOUBLE)) AS target FROM levels l, settled s
), rated AS (
    SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate,
           ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || '|mix-1'), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS coin
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, ((floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT * size)::BIGINT AS taken FROM rated
"""


def op8_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read(spark, sf_dir, "documents"), fold("doc_id", 5) == 0
    model = quality.train(docs, read(spark, sf_dir, "labels"), learn=~held_out)
    scored = docs.select("doc_id", quality.quality(model, "text").alias("score"))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.AT_THRESHOLD).cast("int").alias("predicted"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return hilbert.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_quality_rules": op3_quality_rules,
    "op4_language_id": op4_language_id,
    "op5_line_dedup": op5_line_dedup,
    "op6_chat_format": op6_chat_format,
    "op7_mix_sources": op7_mix_sources,
    "op8_quality_ranking": op8_quality_ranking,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_near_dedup": op10_near_dedup,
}
ORACLE_SQL: dict[str, str] = {"op6_chat_format": OP6_SQL, "op7_mix_sources": OP7_SQL}
