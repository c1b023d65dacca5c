r"""Quality rules: a threshold table compiled into one projection of built-in functions.

A word is a run of characters other than white space (space and \x09-\x0D). Defined cases: a null text has no words and fails the
base rule, as an empty one does; repeated rows are judged one by one; other columns are passed through, and those of the same
name as a new one are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_GAP = "[\\x20\\x09-\\x0D]+"
IN_WORD = "[^\\x20\\x09-\\x0D]"
#: Frequent function words of the languages that are expected; a text in none of them is judged by the other rules.
STOP_WORDS = {
    "en": "the of and to in is that for it on with as are was be by this or at from an not have",
    "fr": "le la les de des du et un une que qui en dans pour sur est au par pas avec elle il",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch",
    "es": "el la los las de del y que en un una por con no para su se es lo al como más",
}


@dataclass(frozen=True)
class Rule:
    """A document fails if its measure is below `least` or above `most`; measures are per `per`, or as they are."""

    name: str
    measure: str
    per: str | None
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("mean word length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols a word", "n_symbols", "n_words", None, 0.25),
    Rule("exclamations a word", "n_exclamations", "n_words", None, 0.25),
    Rule("stop-word share", "n_stop_words", "n_words", 0.02, None),
    Rule("lines that repeat", "n_dup_lines", "n_lines", None, 0.3),
    Rule("commonest neighbours", "n_same_as_before", "n_words", None, 0.2),
)


def measure(df: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what else the rules read."""
    stop = sorted({x for ws in STOP_WORDS.values() for w in ws.split() for x in (w, w.capitalize())})
    df = df.withColumn("text_", F.coalesce(F.col("text"), F.lit("")))
    df = df.withColumns({"words_": F.array_remove(F.split("text_", WORD_GAP), ""), "lines_": F.filter(F.split("text_", "\n"), lambda x: x.rlike(IN_WORD))})
    df = df.withColumn("hashes_", F.transform("words_", lambda w: F.xxhash64(w)))
    # A hash for each run of eight words: of two words, of two twos, of two fours.
    joined = lambda c, k: F.zip_with(c, F.slice(c, k + 1, F.greatest(F.size(c) - k, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("twos_", joined("hashes_", 1))
    df = df.withColumn("fours_", joined("twos_", 2))
    df = df.withColumn("eights_", joined("fours_", 4))
    df = df.withColumn("windows_", F.slice("eights_", 1, F.greatest(F.size("eights_") - 7, F.lit(0))))
    again = F.size("windows_") > F.size(F.array_distinct("windows_"))
    df = df.withColumn("sorted_", F.when(again, F.sort_array(F.transform("windows_", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = lambda x, j: (F.get("sorted_", j - 1)["h"] == x["h"]) | (F.get("sorted_", j + 1)["h"] == x["h"])
    df = df.withColumn("at_", F.array_sort(F.transform(F.filter("sorted_", lambda x, j: F.coalesce(twice(x, j), F.lit(False))), lambda x: x["i"])))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-8).alias("last"))
    step = lambda s, i: F.struct((s["sum"] + F.least(F.lit(8), i - s["last"])).cast("long").alias("sum"), i.alias("last"))
    covered = F.aggregate("at_", start, step, lambda s: s["sum"])
    same = F.filter(F.zip_with("hashes_", F.slice("hashes_", 2, F.size("hashes_")), lambda a, b: a == b), lambda x: x)
    return df.withColumns(
        {
            "n_words": F.size("words_").cast("long"),
            "word_chars": F.length(F.array_join("words_", "")).cast("long"),
            "n_symbols": F.regexp_count("text_", F.lit("[#*$%&|<>]")).cast("long"),
            "n_exclamations": F.when(F.contains("text_", F.lit("!!")), F.regexp_count("text_", F.lit("!!+"))).otherwise(0).cast("long"),
            "n_lines": F.size("lines_").cast("long"),
            "n_dup_lines": (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "n_stop_words": F.size(F.filter("words_", lambda w: w.isin(*stop))).cast("long"),
            "n_same_as_before": F.size(same).cast("long"),
        }
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """Null if every rule holds, else the name of the first that doesn't."""
    out = []
    for r in rules:
        value = F.col(r.measure) if r.per is None else F.col(r.measure) / F.greatest(F.col(r.per), F.lit(1))
        wrong = F.lit(False)
        wrong = wrong | (value < r.least) if r.least is not None else wrong
        wrong = wrong | (value > r.most) if r.most is not None else wrong
        out.append(F.when(wrong, F.lit(r.name)))
    return F.coalesce(*out)


def quality_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds the measures, base_failed, failed_rule (null if none) and kept to df, which has a column text."""
    new = ["n_words", "word_chars", "n_symbols", "n_exclamations", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_same_as_before"]
    own = [c for c in df.columns if c not in {*new, "base_failed", "failed_rule", "kept"}]
    out = measure(df.select(*own))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = out.select(*own, *new, base.alias("base_failed"), verdict(rules).alias("failed_rule"))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())
