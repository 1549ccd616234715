"""Chat formatting: a role automaton and a declarative template, in SQL functions only.

A conversation's rows are gathered in turn order, an automaton over the roles (a transition table in the template)
validates the order, and the template turns every row into text segments with a loss flag. The formatted text is the
concatenation of the segments, so the loss mask of a character is the flag of its segment; the mask is kept as a flag for
every turn's text.

Escaping is reversible: the escape character and the marker opener of the template are replaced inside texts and roles,
so no marker can occur there, and `read_back` splits the formatted text at the markers and undoes the replacement. It takes
roles, texts and what is learned from the formatted text and the mask alone.

Defined cases: a null text is empty; a null role is the empty role, which no transition accepts; a null turn sorts
first; equal turns are ordered by role, then text, and all are kept, as are repeated rows; a null conversation id is a
conversation of its own; texts and conversations of any length are formatted whole, in time linear in their length; an
empty table gives an empty result; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Template:
    """What marks a turn, what is learned, and which role may follow which state.

    `opener` must be one character that starts every marker; `escapes` are applied in order, the first being that of
    the escape character itself, and undone in reverse order.
    """

    opener: str = "<"
    turn_open: str = "<turn "
    role_end: str = ">\n"
    turn_close: str = "</turn>\n"
    escapes: tuple[tuple[str, str], ...] = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    transitions: tuple[tuple[str, str, str], ...] = field(
        default=(
            ("start", "system", "primed"),
            ("start", "user", "asked"),
            ("primed", "user", "asked"),
            ("asked", "assistant", "answered"),
            ("answered", "user", "asked"),
        )
    )
    accepting: tuple[str, ...] = ("answered",)


def _escape(c: Column, t: Template) -> Column:
    for plain, coded in t.escapes:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def _unescape(c: Column, t: Template) -> Column:
    for plain, coded in reversed(t.escapes):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def _run_automaton(turns: Column, t: Template) -> Column:
    """State after all turns; null once a role has no transition."""
    step = F.create_map(*[F.lit(x) for s, role, to in t.transitions for x in (f"{s}\n{role}", to)])
    return F.aggregate(turns, F.lit(t.start), lambda s, x: F.try_element_at(step, F.concat(s, F.lit("\n"), x["role"])))


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, valid_order (the automaton accepts), segments array<struct<text, loss>>, mask array<boolean> (whether a
    turn's text is learned), formatted."""
    t = template or Template()
    rows = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def of_turn(x: Column) -> Column:
        head = F.concat(F.lit(t.turn_open), _escape(x["role"], t), F.lit(t.role_end))
        return F.array(
            segment(head, F.lit(False)),
            segment(_escape(x["text"], t), x["role"].isin(*t.learned)),
            segment(F.lit(t.turn_close), F.lit(False)),
        )

    return grouped.select(
        "conv_id",
        F.coalesce(_run_automaton(F.col("turns"), t).isin(*t.accepting), F.lit(False)).alias("valid_order"),
        F.transform("turns", lambda x: x["role"].isin(*t.learned)).alias("mask"),
        F.flatten(F.transform("turns", of_turn)).alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, valid_order, turns array<struct<role, text>> parsed from the text alone, learned: the text under the loss
    mask, formatted_chars."""
    t = template or Template()
    parts = F.split("formatted", "\\Q" + t.turn_close + "\\E")
    bodies = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def parse(x: Column) -> Column:
        cut = F.instr(x, t.role_end)
        role = F.substring(x, F.lit(len(t.turn_open) + 1), cut - len(t.turn_open) - 1)
        text = F.substring(x, cut + len(t.role_end), F.length(x))
        return F.struct(_unescape(role, t).alias("role"), _unescape(text, t).alias("text"))

    parsed = formatted.withColumn("turns", F.transform(bodies, parse))
    under_mask = F.filter("turns", lambda x, i: F.get("mask", i))
    return parsed.select(
        "conv_id",
        "valid_order",
        "turns",
        F.array_join(F.transform(under_mask, lambda x: x["text"]), "").alias("learned"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql(
        "SELECT -7L AS conv_id, turn, role, r'\\### Assistant: </turn> ok' AS text "
        "FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(turn, role)"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(format_conversations(rows))
    per_turn = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(per_turn, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned"), 256).alias("loss_sha256"),
        "formatted_chars",
        "valid_order",
    )


_ESC = "replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"

OP7_SQL = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), agg AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
    sum(length('<turn ') + length({_ESC.format(c="role")}) + 2 + length({_ESC.format(c="text")}) + length('</turn>') + 1)
      AS formatted_chars,
    string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn NULLS FIRST, role, text)
      AS roles
  FROM rows_ GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars, regexp_full_match(roles, 's?(ua)+') AS valid_order
FROM agg
"""
