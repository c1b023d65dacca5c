"""String, hash and number expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The token pattern, and what is stripped from a token's ends.
TOKEN = r"[A-Za-z][A-Za-z0-9_.$'-]*|\d+(?:\.\d+)?"
TOKEN_EDGE = ".$'"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: Column | str) -> Column:
    """Lower-case tokens of a text, with the edges stripped and empty ones dropped; null gives none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(F.transform(found, lambda t: F.btrim(t, F.lit(TOKEN_EDGE))), lambda t: t != "")


def squeeze(text: Column | str) -> Column:
    """White space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"\s+", " "))


def excerpt(text: Column | str, most: int) -> Column:
    """The squeezed text, cut with an ellipsis to `most` characters."""
    flat = squeeze(text)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, max(0, most - 3))), F.lit("...")))


def document_hash(*fields: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def content_hash(title: Column | str, body: Column | str) -> Column:
    """Hash of lower-case title and squeezed lower-case body: equal for copies, whatever their source and dates."""
    return F.sha2(F.concat(F.lower(F.trim(F.coalesce(_col(title), F.lit("")))), F.lit("\n"), F.lower(squeeze(body))), 256)


def short_hash(*parts: Column) -> Column:
    """The first 16 digits of a SHA-1."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def safe_double(value: Column | str, default: float = 0.0) -> Column:
    """A finite number or the default: for null, empty, non-numeric, NaN and infinite values."""
    v = _col(value).cast("string").try_cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.when(ok, v).otherwise(F.lit(float(default)))


def count_terms(lowered: Column, terms: tuple[str, ...]) -> Column:
    """How often terms occur: phrases as they are, words as beginnings of words."""
    out = F.lit(0)
    for t in terms:
        if " " in t:
            out = out + ((F.length(lowered) - F.length(F.replace(lowered, F.lit(t), F.lit("")))) / len(t)).cast("int")
    words = [t for t in terms if " " not in t]
    # One pass for all words, unless one begins another: then a word of the text counts for both.
    if not any(a != b and b.startswith(a) for a in words for b in words):
        words = ["(?:" + "|".join(words) + ")"] if words else []
    for t in words:
        out = out + F.regexp_count(lowered, F.lit(rf"(?U)\b{t}\w*\b"))
    return out


def list_of(value: Column | str, pattern: str = r"[|;]") -> Column:
    """The trimmed, non-empty parts of a separated list."""
    return F.filter(F.transform(F.split(F.coalesce(_col(value), F.lit("")), pattern), lambda x: F.trim(x)), lambda x: x != "")


def number_of(value: Column | str) -> Column:
    """A number as reports write it: $, % and commas dropped, brackets negative; null where there is none."""
    raw = F.trim(_col(value).cast("string"))
    bare = F.regexp_replace(raw, r"[$,%()\s]", "").try_cast("double")
    return F.when(raw.rlike(r"^\(.*\)$"), -bare).otherwise(bare)


def fixed(value: Column, places: int, plus: bool = False) -> Column:
    """A number with so many decimals, as printf writes it: what the double holds is rounded, ties to even; null stays null.

    format_string rounds the shortest decimal that reads back as the double, halves up: 142.35 holds less than that, and is 142.3.
    It is worked out for every row, also under a condition that leaves it out.
    """
    form = f"{'+' if plus else ''}.{places}f"

    @F.arrow_udf("string")
    def printed(numbers: pa.Array) -> pa.Array:
        return pa.array([None if x is None else format(x, form) for x in numbers.to_pylist()], pa.string())

    return printed(value.cast("double"))


def slug(prefix: str, value: Column) -> Column:
    """prefix_value with lower-case words joined by underscores."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(F.lower(value), r"[/\s-]+", " ")), " ", "_")
    return F.when(clean == "", F.lit(prefix)).otherwise(F.concat(F.lit(f"{prefix}_"), clean))


def word_count(text: Column | str) -> Column:
    return F.regexp_count(F.coalesce(_col(text), F.lit("")), F.lit(r"\S+"))


def whole_phrase(text: Column, phrase: Column) -> Column:
    """Whether a phrase stands in a text with no letter or digit beside it, in any case."""
    pattern = F.concat(F.lit("(^|[^a-z0-9])"), F.regexp_replace(F.lower(phrase), r"([\\.^$|?*+()\[\]{}])", r"\\$1"), F.lit("([^a-z0-9]|$)"))
    return F.lower(text).rlike(pattern) if isinstance(pattern, str) else F.regexp_like(F.lower(text), pattern)


def delta_percent(now: Column, before: Column) -> Column:
    """Change against the size of the prior value, in percent; null without one."""
    return F.when(before.isNotNull() & (before != 0), F.round((now - before) / F.abs(before) * 100, 2))
