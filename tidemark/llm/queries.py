"""The queries op1 to op10, each over the whole of its table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, decontaminate, html_extract, lm_score, minhash, quality_model, quality_rules, suffix_dedup, token_counts
from tidemark.llm.runtime import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    back = chat.read_back(chat.format_chats(rows))
    all_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape(s["text"])), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_text, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP1_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
  SELECT *, 4 + CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 ELSE 6 + length(role) END + 2
    + length(text) + length(text) - length(replace(text, '\', ''))
    + length(text) - length(replace(text, '#', '')) - length(regexp_extract_all(text, '#+'))
    + (length(text) - length(replace(text, '</turn>', ''))) // 7 + 7 AS chars,
    CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS initial
  FROM rows_
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(initial, '' ORDER BY turn, role, text), 's?(ua)+') AS valid
FROM t GROUP BY conv_id
"""


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs, span=50, text=False, digest=True)


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text")
    return token_counts.limits(token_counts.histogram(token_counts.lengths(docs, *vocabulary())))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, *vocabulary(), ids=False, keep=["doc_id"])


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the doc_id as text is a multiple of 5; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


#: A text is taken to be good from this score on.
GOOD = 0.3


def quality_scores(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """Trained on the rows of docs and labels that aren't held out; adds score."""
    known = labels.filter(~held_out()).select("doc_id", F.col("quality").alias("label"))
    return quality_model.score(docs, quality_model.train(docs, known), keep)


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.drop("text")


def _op9_sql() -> str:
    stop = ", ".join(f"'{x}'" for x in sorted({x for ws in quality_rules.STOP_WORDS.values() for w in ws.split() for x in (w, w.capitalize())}))
    rules = []
    for r in quality_rules.RULES:
        value = f"{r.measure} / greatest({r.per}, 1)" if r.per else r.measure
        wrong = " OR ".join(x for x in (f"{value} < {r.least}" if r.least is not None else "", f"{value} > {r.most}" if r.most is not None else "") if x)
        rules.append(f"WHEN {wrong} THEN '{r.name}'")
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), e AS (
  SELECT *, CASE WHEN len(words) >= 8 THEN list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i+7], ' ')) ELSE [] END AS windows FROM d
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM (SELECT doc_id, unnest(windows) AS w, generate_subscripts(windows, 1) AS i FROM e)
), c AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS covered FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM g WHERE n > 1) GROUP BY doc_id
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(regexp_extract_all(t, '!!+')) AS BIGINT) AS n_exclamations,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(words, lambda w: list_contains([{stop}], w))) AS BIGINT) AS n_stop_words,
    CAST(len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS BIGINT) AS n_same_as_before
  FROM e LEFT JOIN c USING (doc_id)
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CASE {" ".join(rules)} END AS failed_rule FROM m
)
SELECT *, NOT base_failed AND failed_rule IS NULL AS kept FROM f
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_format, op2_minhash_dedup, op3_suffix_dedup, op4_token_counts, op5_byte_bpe, op6_quality_model, op7_lm_score, op8_html_extract, op9_quality_rules, op10_decontaminate)
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op9_quality_rules": _op9_sql()}
