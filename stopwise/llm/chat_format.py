"""Operator 2: conversations as training text, with a flag for what carries loss.

Only DataFrame functions. Turn order is checked by a finite-state machine: its transitions
are a map, folded over the roles of a conversation. The template says how a turn is marked
and which roles carry loss; a conversation becomes a list of segments (text, loss) whose
texts, one after another, are the formatted conversation.

Control strings inside a text are escaped: a backslash is doubled, and one is put behind
the first character of every control string. So none of them survives in a formatted
text but the template's own, and `read_back` recovers every turn.

Defined cases: null text is empty; a null role is the role ''; turns stand in the order
of (turn, role, text), nulls first; repeated rows are repeated turns; an ill-ordered
conversation is formatted too, with valid false and the number of its first wrong turn.
A conversation is one row, so its size is bounded by what a row can hold. Null conv_id is
a conversation of its own. Columns other than conv_id, turn, role and text are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template. {role} is the turn's role; the text stands between head and tail.
TEMPLATE = {"head": "<|start|>{role}<|text|>", "tail": "<|end|>", "loss": ["assistant"]}
# Strings that some format takes as control; a text may not contain them unescaped.
CONTROL = r"<\|[A-Za-z_]+\|>|\[/?INST\]|</?s>|<</?SYS>>"
# State and role of the next turn, and the state that follows. A conversation ends well after an assistant's turn.
TRANSITIONS = {
    "start>system": "system", "start>user": "user", "system>user": "user", "user>assistant": "assistant", "assistant>user": "user",
}
FINAL = ["assistant"]


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), f"(?={CONTROL})(.)", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def formatted(conversations: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """conv_id, valid, wrong_turn, segments, formatted and the role and escaped text of each turn."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    moves = F.create_map(*[F.lit(x) for move in TRANSITIONS.items() for x in move])
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("wrong"))

    def step(at: Column, x: Column) -> Column:
        state = F.coalesce(F.try_element_at(moves, F.concat(at["state"], F.lit(">"), x["role"])), F.lit("wrong"))
        return F.struct(state.alias("state"), (at["n"] + 1).alias("n"), F.coalesce(at["wrong"], F.when(state == "wrong", at["n"])).alias("wrong"))

    before, after = template["head"].split("{role}")

    def segments(x: Column) -> Column:
        mark = lambda text: F.struct(text.alias("text"), F.lit(False).alias("loss"))
        return F.array(mark(F.concat(F.lit(before), escape(x["role"]), F.lit(after))), F.struct(escape(x["text"]).alias("text"), x["role"].isin(template["loss"]).alias("loss")), mark(F.lit(template["tail"])))

    rows = rows.select("conv_id", F.aggregate("_turns", start, step).alias("_end"), F.flatten(F.transform("_turns", segments)).alias("segments"))
    return rows.select("conv_id", (F.col("_end.wrong").isNull() & F.col("_end.state").isin(FINAL)).alias("valid"), F.col("_end.wrong").alias("wrong_turn"), "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_back(rows: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """The turns, unescaped, as they stand in the formatted text, and all text under the loss flags."""
    before, after = template["head"].split("{role}")
    quote = lambda s: "\\Q" + s + "\\E"
    parts = F.split(F.col("formatted"), quote(template["tail"]))
    turns = F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.split(F.substr(p, F.lit(len(before) + 1)), quote(after), 2))
    read = F.transform(turns, lambda t: F.struct(unescape(F.get(t, F.lit(0))).alias("role"), unescape(F.get(t, F.lit(1))).alias("text")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return rows.withColumns({"turns": read, "loss_text": loss})


def digests(conversations: DataFrame) -> DataFrame:
    rows = read_back(formatted(conversations))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid", F.col("wrong_turn").cast("long").alias("wrong_turn"),
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations, and number -1, whose texts consist of control strings."""
    said = F.lit("</s>[INST] ok [/INST]")
    spark = conversations.sparkSession
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


# Escaping with RE2, which has no look-behind: first characters of control strings by what follows them.
SQL = r"""
WITH all_turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS n,
    length(regexp_replace(replace(text, '\', '\\'), '<(\|[A-Za-z_]+\|>)|\[(/?INST\])|<(/?s>)|<(</?SYS>>)', 'xx\1\2\3\4', 'g'))
    + length(regexp_replace(replace(role, '\', '\\'), '<(\|[A-Za-z_]+\|>)|\[(/?INST\])|<(/?s>)|<(</?SYS>>)', 'xx\1\2\3\4', 'g')) AS chars
  FROM all_turns
), judged AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY n), 'start') || '>' || role
    IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AS fits FROM escaped
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars + length('<|start|><|text|><|end|>'))::BIGINT AS formatted_chars,
  bool_and(fits) AND arg_max(role, n) = 'assistant' AS valid, (min(n) FILTER (NOT fits))::BIGINT AS wrong_turn
FROM judged GROUP BY conv_id
"""
