"""Conversations as training text with a loss flag per segment.

A declarative template gives the control strings, the roles under the loss and the
machine that turn order must follow. Control strings inside texts are escaped, so
that the formatted text can be split into its turns again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from driftwalk.llm.base import column, read, register, sha256, text_or_empty

# Each becomes a backslash and a letter, so no control string is left in a text and
# every backslash in escaped text starts a pair. The backslash comes first here and
# last when reading back.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))


@dataclass(frozen=True)
class ChatTemplate:
    """Control strings, roles under the loss, and the order of roles.

    ``order`` maps (state, role) to the next state; the first state is ``start`` and
    a conversation is valid if it ends in one of ``final``. Control strings must each
    hold one of the escaped characters.
    """

    turn_start: str = "### "
    role_end: str = ": "
    turn_end: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    order: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        for control in (self.turn_start, self.role_end, self.turn_end):
            if not any(plain in control for plain, _ in ESCAPES):
                raise ValueError(f"a text could hold the control string {control!r}")


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _valid(turns: Column, template: ChatTemplate) -> Column:
    """Whether the machine reaches a final state over the roles of ``turns``."""
    moves = F.create_map(
        *(
            F.lit(part)
            for (state, role), after in template.order.items()
            for part in (f"{state}\n{role}", after)
        )
    )
    last = F.aggregate(
        turns,
        F.lit("start"),
        lambda state, turn: F.coalesce(
            F.try_element_at(moves, F.concat(state, F.lit("\n"), turn["role"])), F.lit("invalid")
        ),
    )
    return last.isin(*template.final)


def format_chats(
    turns: DataFrame,
    template: ChatTemplate | None = None,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Per conversation: ``formatted``, ``segments`` (text, loss) and ``valid``.

    The segments' texts joined are the formatted text. Null roles and texts are
    empty; a null turn comes first; turns of equal number are ordered by role, then
    text, and equal rows are turns of their own. Rows without a conversation id form
    one conversation with a null id. Conversations out of order are formatted too and
    marked invalid. An empty table gives an empty table. A conversation's turns meet
    in one row, which is what a training example is.
    """
    template = template or ChatTemplate()
    grouped = turns.groupBy(column(conversation).alias(conversation)).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    column(turn).alias("turn"),
                    text_or_empty(role).alias("role"),
                    text_or_empty(text).alias("text"),
                )
            )
        ).alias("turns")
    )

    def segment(value: Column, loss: Column) -> Column:
        return F.struct(value.alias("text"), loss.alias("loss"))

    def segments(one: Column) -> Column:
        head = F.concat(F.lit(template.turn_start), escaped(one["role"]), F.lit(template.role_end))
        return F.array(
            segment(head, F.lit(False)),
            segment(escaped(one["text"]), one["role"].isin(*template.loss_roles)),
            segment(F.lit(template.turn_end), F.lit(False)),
        )

    made = grouped.select(
        column(conversation),
        F.flatten(F.transform("turns", segments)).alias("segments"),
        _valid(F.col("turns"), template).alias("valid"),
    )
    return made.withColumn(
        "formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")
    )


def read_turns(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The turns (role, text) that a formatted text holds."""
    template = template or ChatTemplate()
    pieces = F.split(formatted, r"\Q" + template.turn_end + r"\E")
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    opening, role_end = F.length(F.lit(template.turn_start)), F.lit(template.role_end)

    def turn(piece: Column) -> Column:
        body = F.substring(piece, opening + 1, F.length(piece))
        at = F.instr(body, role_end)
        return F.struct(
            unescaped(F.substring(body, F.lit(1), at - 1)).alias("role"),
            unescaped(F.substring(body, at + F.length(role_end), F.length(body))).alias("text"),
        )

    return F.transform(pieces, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss, unescaped and joined."""
    under = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(under, lambda s: unescaped(s["text"])), "")


PROBE = r"\### Assistant: </turn> ok"


def _with_probe(turns: DataFrame) -> DataFrame:
    """``turns`` and conversation -7, whose texts hold the control strings."""
    probe = turns.sparkSession.sql(
        "SELECT * FROM VALUES (-7L, 0L, 'user', :text), (-7L, 1L, 'assistant', :text)"
        " AS probe(conv_id, turn, role, text)",
        args={"text": PROBE},
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


def _escaped_length_sql(column_name: str) -> str:
    """Code points of the escaped text: one more for each escaped character."""
    removed = f"regexp_replace({column_name}, '[\\\\<#:]', '', 'g')"
    return f"(2 * length({column_name}) - length({removed}))"


@register(
    "op3_chat_format",
    rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}'
  UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
         AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT)
         AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
                       FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(14 + {_escaped_length_sql("role")} + {_escaped_length_sql("text")}) AS BIGINT)
         AS formatted_chars,
       regexp_full_match(string_agg(role || ' ', '' ORDER BY turn, role, text),
                         '(system )?(user assistant )+') AS valid
FROM turns GROUP BY conv_id
""",
)
def op3_chat_format(spark, sf_dir):
    chats = format_chats(_with_probe(read(spark, sf_dir, "conversations")))
    back = chats.select(
        "conv_id",
        "valid",
        read_turns(F.col("formatted")).alias("turns"),
        loss_text(F.col("segments")).alias("loss"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    written = F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha256(F.array_join(written, "")).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        sha256("loss").alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )
