"""Token counts: an exact histogram of encoded lengths, and what its suffix sums answer for every context limit.

Defined cases: null and empty texts have length 0; repeated rows count each; an empty table gives an empty histogram; extra columns
are not read. The histogram has a row for each length that occurs, however many documents there are; the sums over it run in blocks
of lengths, so no task holds them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import encode
from tidemark.llm.runtime import cut

#: Lengths of one block of suffix sums.
BLOCK = 4096


def lengths(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """n_tokens of each row."""
    return encode(df, path, pattern, text, ids=False, keep=[])


def histogram(df: DataFrame, length: str = "n_tokens") -> DataFrame:
    """n_tokens and n_docs; counted in each task before the shuffle, so a common length is no hot key."""
    return df.groupBy(F.col(length).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def limits(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each length L that occurs, taken as a context limit: documents of L tokens or more and their tokens, all tokens that stay
    when texts are cut at L, documents cut, and the share of documents of at most L tokens (L is every quantile up to that share and
    above the one before).
    """
    hist = cut(hist, "histogram").withColumn("block", F.floor(F.col("n_tokens") / block))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each `block` lengths
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        F.col("block"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("docs", "tokens")],
        *[F.sum(c).over(every).alias(f"{c}_all") for c in ("docs", "tokens")],
    )
    inside = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    out = hist.join(blocks, "block").withColumns(
        {
            "docs_up_to": F.col("docs_before") + F.sum("n_docs").over(inside),
            "tokens_up_to": F.col("tokens_before") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside),
        }
    )
    return out.select(
        "n_tokens",
        "n_docs",
        (F.col("docs_all") - F.col("docs_up_to") + F.col("n_docs")).alias("docs_at_least"),
        (F.col("tokens_all") - F.col("tokens_up_to") + F.col("n_docs") * F.col("n_tokens")).alias("tokens_at_least"),
        (F.col("tokens_up_to") + F.col("n_tokens") * (F.col("docs_all") - F.col("docs_up_to"))).alias("tokens_when_cut"),
        (F.col("docs_all") - F.col("docs_up_to")).alias("docs_cut"),
        (F.col("docs_up_to") / F.col("docs_all")).alias("share_up_to"),
        F.col("tokens_all").alias("tokens_in_all"),
    )


def quantile(table: DataFrame, q: float) -> DataFrame:
    """The smallest length that a share q of documents doesn't exceed."""
    return table.filter(F.col("share_up_to") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def cut_at(hist: DataFrame, limit: int) -> DataFrame:
    """Tokens that stay when texts are cut at any limit, one that occurs as a length or not."""
    return hist.agg(F.sum(F.col("n_docs") * F.least(F.col("n_tokens"), F.lit(limit))).alias("tokens"))
