"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a template.

The state of the machine is the role of the last turn (``start`` before the first); a template lists which role
may follow which, and what is written before and after a turn of each role.  Control strings inside texts are
escaped by stuffing one mark after their first character, which is undone exactly by taking one out again, so
texts without control strings are left as they are.

Defined cases: a null text is empty; a null role is the empty role, written by the template's generic form, as
are roles that the template doesn't know; turns are ordered by (turn, role, text), nulls first, so ties and
repeated rows give the same output whatever the order of the input, and every row counts; rows with a null
conv_id form one conversation; ids keep their type, numbers or texts; a turn that isn't a number counts as null; an empty table gives an empty result; other columns are ignored.  A conversation
is one output value, so its turns meet in one task; conversations are dealt over all tasks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The stuffing mark: U+2060, WORD JOINER.
MARK = "⁠"


@dataclass(frozen=True)
class RoleForm:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """What is written around turns; every ``before`` begins with a control string that no other form begins with."""

    roles: dict[str, RoleForm] = field(
        default_factory=lambda: {
            "system": RoleForm("[SYS] ", " [/SYS]\n"),
            "user": RoleForm("[INST] ", " [/INST]"),
            "assistant": RoleForm("<s>", "</s>\n", loss=True),
        }
    )
    #: Any other role: before + role + between + text + after.
    other: RoleForm = RoleForm("[ROLE] ", " [/ROLE]\n")
    between: str = " [TEXT] "
    #: Strings that may not stand in an escaped text.
    controls: tuple[str, ...] = ("[INST]", "[/INST]", "<s>", "</s>", "[SYS]", "[/SYS]", "[ROLE]", "[TEXT]", "[/ROLE]")
    #: The machine: state to the roles that may come next.
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    #: States in which a conversation may end.
    final: tuple[str, ...] = ("user", "assistant")


def _stuffed(template: Template, least: str) -> str:
    """Pattern of a control string with ``least`` and any more marks after its first character."""
    heads: dict[str, list[str]] = {}
    for c in template.controls:
        heads.setdefault(c[0], []).append(re.escape(c[1:]))
    return "|".join(f"(?<={re.escape(h)}){least}(?={MARK}*(?:{'|'.join(t)}))" for h, t in heads.items())


def escape(text: Column, template: Template) -> Column:
    """Put one mark after the first character of every control string, stuffed or not."""
    return F.regexp_replace(text, _stuffed(template, ""), MARK)


def unescape(text: Column, template: Template) -> Column:
    """Take out the mark that :func:`escape` put in."""
    return F.regexp_replace(text, _stuffed(template, MARK), "")


def segments(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row for each turn: conv_id, turn, role, text, ``before``, ``body``, ``after``, ``loss``, ``ok``, ``last``.

    ``body`` is the escaped text and alone carries the loss flag; ``ok`` says whether the machine allowed the turn.
    """
    t = template or Template()
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    state = F.coalesce(F.lag("role").over(w), F.lit("start"))
    rows = rows.withColumns({"state": state, "last": F.lead("role").over(w).isNull()})
    ok = F.lit(False)
    for s, nexts in t.follows.items():
        ok = ok | ((F.col("state") == s) & F.col("role").isin(*nexts))

    def form(pick, other) -> Column:
        out = other
        for name, f in t.roles.items():
            out = F.when(F.col("role") == name, F.lit(pick(f))).otherwise(out)
        return out

    generic = F.concat(F.lit(t.other.before), escape(F.col("role"), t), F.lit(t.between))
    return rows.select(
        "conv_id", "turn", "role", "text", form(lambda f: f.before, generic).alias("before"), escape(F.col("text"), t).alias("body"),
        form(lambda f: f.after, F.lit(t.other.after)).alias("after"), form(lambda f: f.loss, F.lit(t.other.loss)).alias("loss"),
        (ok & (~F.col("last") | F.col("role").isin(*t.final))).alias("ok"), "last",
    )


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row for each conversation: conv_id, ``valid``, and ``segments``, an array of (text, loss) in order."""
    rows = segments(turns, template)
    parts = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "before", "body", "after", "loss")))
    out = rows.groupBy("conv_id").agg(F.every("ok").alias("valid"), parts.alias("t"))
    three = F.flatten(
        F.transform(
            "t",
            lambda x: F.array(
                F.struct(x["before"].alias("text"), F.lit(False).alias("loss")),
                F.struct(x["body"].alias("text"), x["loss"].alias("loss")),
                F.struct(x["after"].alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    return out.select("conv_id", "valid", three.alias("segments"))


def formatted(segs: str = "segments") -> Column:
    """The whole text of a conversation."""
    return F.array_join(F.transform(segs, lambda x: x["text"]), "")


def parse(text: Column, template: Template | None = None) -> Column:
    """Turns (role, text) read back from a formatted text."""
    t = template or Template()
    forms = [*t.roles.items(), (None, t.other)]
    starts = "|".join(re.escape(f.before) for _, f in forms)
    pieces = F.filter(F.split(text, f"(?={starts})"), lambda p: p != "")

    def turn(p: Column) -> Column:
        cut = lambda f, s: s.substr(F.lit(len(f.before) + 1), F.length(s) - len(f.before) - len(f.after))
        body = cut(t.other, p)
        at = F.instr(body, t.between)
        role, content = body.substr(F.lit(1), at - 1), body.substr(at + len(t.between), F.length(body))
        for name, f in t.roles.items():
            mine = p.startswith(f.before)
            role, content = F.when(mine, F.lit(name)).otherwise(role), F.when(mine, cut(f, p)).otherwise(content)
        return F.struct(unescape(role, t).alias("role"), unescape(content, t).alias("text"))

    return F.transform(pieces, turn)


#: The conversation that the contract adds: a user and an assistant that both say control strings.
EXTRA = "SELECT CAST(-1 AS {}) AS conv_id, CAST(t AS BIGINT) AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, r)"


def conversation_digests(spark: SparkSession, conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """The digests of the contract, all read back from the formatted output."""
    t = template or Template()
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select("conv_id", F.col("turn").try_cast("long").alias("turn"), F.col("role").cast("string"), F.col("text").cast("string"))
    out = format_conversations(rows.unionByName(spark.sql(EXTRA.format(kind))), t).select("conv_id", "valid", formatted().alias("f"), F.array_join(F.transform(F.filter("segments", lambda x: x["loss"]), lambda x: unescape(x["text"], t)), "").alias("loss_text"))
    out = out.withColumn("turns", parse(F.col("f"), t))
    joined = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("f").cast("long").alias("formatted_chars"), "valid",
    )


def digests_sql(template: Template | None = None) -> str:
    """DuckDB SQL for :func:`conversation_digests` over the view ``conversations``."""
    t = template or Template()
    around = {name: len(f.before) + len(f.after) for name, f in t.roles.items()}
    generic = len(t.other.before) + len(t.other.after) + len(t.between)
    # every control string grows by one mark, stuffed ones too
    grown = lambda c: " + ".join(f"len(regexp_extract_all({c}, '{re.escape(x[0])}{MARK}*{re.escape(x[1:])}'))" for x in t.controls)
    known = " ".join(f"WHEN role = '{n}' THEN {k}" for n, k in around.items())
    loss = ", ".join(f"'{n}'" for n, f in t.roles.items() if f.loss)
    follows = " OR ".join(f"(state = '{s}' AND role IN ({', '.join(repr(x) for x in n)}))" for s, n in t.follows.items())
    final = ", ".join(repr(x) for x in t.final)
    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), states AS (
  SELECT *, coalesce(lag(role) OVER w, 'start') AS state, lead(role) OVER w IS NULL AS last FROM rows
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role IN ({loss}) THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role IN ({loss}) THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(length(text) + {grown('text')} + CASE {known} ELSE {generic} + length(role) + {grown('role')} END) AS BIGINT) AS formatted_chars,
  bool_and(({follows}) AND (NOT last OR role IN ({final}))) AS valid
FROM states GROUP BY conv_id"""
