r"""Chat formatting: a finite-state machine over roles, and a declarative template with loss flags.

A conversation is the rows of one conv_id by (turn, role, text), nulls first; it is one unit of output, as a document is.
Defined cases: a null text counts as empty; a null role is the role "" ; rows of a null conv_id form one conversation;
repeated rows are turns of their own; an empty table gives no rows; columns beside conv_id, turn, role and text are ignored.
A conversation whose turn order the machine rejects is formatted all the same and marked valid = false.

Escaping: a backslash becomes two, the `#` after a `#` gets a backslash before it, and `</turn>` becomes `<\/turn>`. Neither `##` nor
`</turn>` can then stand in a text, and dropping the backslash before any character reads the text back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Role names as they are written, which roles count for the loss, and the machine's transitions and final states."""

    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
            ("user", "assistant"): "assistant", ("assistant", "user"): "user",
        }
    )
    final: tuple[str, ...] = ("assistant",)
    opening: str = "### "
    other: str = "Other "
    closing: str = "</turn>"


TEMPLATE = Template()


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.regexp_replace(text, "(?<=#)#", r"\\#")
    return F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(rows: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, valid, segments (array of text and loss flag) and formatted, for rows of conv_id, turn, role and text."""
    turns = F.sort_array(F.collect_list(F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    df = rows.groupBy("conv_id").agg(turns.alias("turns"))

    names = F.create_map(*[F.lit(x) for pair in template.names.items() for x in pair])
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)])

    def header(role: Column) -> Column:
        other = F.concat(F.lit(template.other), F.replace(escape(role), F.lit(":"), F.lit("\\:")))
        return F.concat(F.lit(template.opening), F.coalesce(F.try_element_at(names, role), other), F.lit(": "))

    def segments(x: Column) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(part(header(x["role"]), F.lit(False)), part(escape(x["text"]), x["role"].isin(*template.loss)), part(F.lit(template.closing), F.lit(False)))

    state = F.aggregate("turns", F.lit("start"), lambda s, x: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit("\n"), x["role"])), F.lit("rejected")))
    out = df.select("conv_id", F.size("turns").cast("long").alias("n_turns"), state.isin(*template.final).alias("valid"), F.flatten(F.transform("turns", segments)).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Adds turns (array of role, text and loss) as read from the column formatted alone."""
    pieces = F.split(F.col("formatted"), re.escape(template.closing))
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    known = "|".join(map(re.escape, template.names.values()))
    pattern = rf"(?s)^{re.escape(template.opening)}(?:({known})|{re.escape(template.other)}([^\\:]*+(?:\\.[^\\:]*+)*+)): (.*)$"
    roles = F.create_map(*[F.lit(x) for role, name in template.names.items() for x in (name, role)])

    def turn(piece: Column) -> Column:
        name = F.regexp_extract(piece, pattern, 1)
        role = F.when(name != "", F.element_at(roles, name)).otherwise(unescape(F.regexp_extract(piece, pattern, 2)))
        return F.struct(role.alias("role"), unescape(F.regexp_extract(piece, pattern, 3)).alias("text"))

    out = formatted.withColumn("turns", F.transform(pieces, turn))
    return out.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["role"].isin(*template.loss).alias("loss"))))
