"""Preference formatting of chosen and rejected conversations.

The longest common turn prefix of the two is rendered once, as the prompt; what
follows it on either side is that side's completion, and the two stand side by
side, turn for turn. Each rendered turn of a completion carries the characters on
which loss is taken: what an assistant says and the mark that ends it, not the
header with the role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.components import salted_join

OPEN, END = "<|im_start|>", "<|im_end|>"
#: How both marks begin, and what stands for it inside of texts and roles, which can't open or end a turn so.
MARK, QUOTED = "<|im_", "< |im_"


def one_row_a_turn(turns: DataFrame, *keys: str) -> DataFrame:
    """A row for each key and turn; of several the least (role, text); rows without a key or turn go."""
    return (
        turns.dropna(subset=[*keys, "turn"])
        .groupBy(*keys, "turn")
        .agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("m"))
        .select(*keys, "turn", "m.role", "m.text")
    )


def rendered(turn: str) -> Column:
    """``struct<text, loss_from, loss_to>`` of a struct of role and text; null for null."""
    quoted = lambda c: F.replace(F.col(f"{turn}.{c}"), F.lit(MARK), F.lit(QUOTED))
    header = F.concat(F.lit(OPEN), quoted("role"), F.lit("\n"))
    said = F.concat(quoted("text"), F.lit(END))
    ours = F.col(f"{turn}.role") == "assistant"
    start = F.when(ours, F.length(header)).otherwise(0)
    end = F.when(ours, F.length(header) + F.length(said)).otherwise(0)
    return F.when(F.col(turn).isNotNull(), F.struct(F.concat(header, said, F.lit("\n")).alias("text"), start.alias("loss_from"), end.alias("loss_to")))


def format_preferences(sides: DataFrame) -> DataFrame:
    """Preference pairs, turn for turn.

    ``sides``: pair_id, side (``chosen`` or ``rejected``), turn, role, text.
    Returns pair_id, turn, prompt, chosen, chosen_from, chosen_to, rejected,
    rejected_from, rejected_to: either the turn is in the prompt, or it is in the
    completions of the sides that have it, with the characters (from, to) of it on
    which loss is taken, 0 and 0 for none. Reading a column by turn gives its text.

    Turns are compared by number, role and text; the prefix ends before the first
    turn that the sides don't share. Equal sides are all prompt, a pair with one
    side only has an empty prompt. Null role or text is empty; a null pair, side
    or turn goes; of repeated rows of a turn the least (role, text) stays. Marks
    inside a text are quoted. Both sides of a turn meet by (pair, turn), the only
    shuffle of texts; where they part is found on numbers, dealt by pair and turn,
    so a conversation of any length is spread over tasks and is never collected.
    """
    turn = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    met = (
        sides.where(F.col("side").isin("chosen", "rejected")).dropna(subset=["pair_id", "turn"]).groupBy("pair_id", "turn")
        .agg(*[F.min(F.when(F.col("side") == s, turn)).alias(s) for s in ("chosen", "rejected")])
    )
    first = met.where(~F.col("chosen").eqNullSafe(F.col("rejected"))).groupBy("pair_id").agg(F.min("turn").alias("first_apart"))
    ends = salted_join(met.select("pair_id", "turn"), first, "pair_id", "turn").where("turn >= first_apart").select("pair_id", "turn", F.lit(True).alias("apart"))
    both = met.join(ends, ["pair_id", "turn"], "left").select("pair_id", "turn", "apart", *[rendered(s).alias(s) for s in ("chosen", "rejected")])
    part = lambda s, field: F.when(F.col("apart"), F.col(f"{s}.{field}"))
    columns = [part(s, field).alias(s + end) for s in ("chosen", "rejected") for field, end in (("text", ""), ("loss_from", "_from"), ("loss_to", "_to"))]
    return both.select("pair_id", "turn", F.when(F.col("apart").isNull(), F.col("chosen.text")).alias("prompt"), *columns)


def assembled(formatted: DataFrame) -> DataFrame:
    """One row a pair: prompt, chosen, rejected as whole strings, and for either side ``chosen_loss`` and ``rejected_loss``,
    the spans of its characters on which loss is taken.

    For conversations that fit a row, as training examples do.
    """
    turns = formatted.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("turn", "prompt", "chosen", "chosen_from", "chosen_to", "rejected", "rejected_from", "rejected_to"))).alias("t"))
    text = lambda part: F.array_join(F.transform("t", lambda x: x[part]), "").alias(part)

    def loss(part: str) -> Column:
        nothing = F.expr("named_struct('at', 0, 'spans', CAST(array() AS array<struct<start: int, end: int>>))")

        def step(a: Column, x: Column) -> Column:
            span = F.struct((a["at"] + x[f"{part}_from"]).alias("start"), (a["at"] + x[f"{part}_to"]).alias("end"))
            return F.struct((a["at"] + F.coalesce(F.length(x[part]), F.lit(0))).alias("at"), F.when(x[f"{part}_to"] > 0, F.array_append(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

        return F.aggregate("t", nothing, step, lambda a: a["spans"]).alias(f"{part}_loss")

    return turns.select("pair_id", *[text(p) for p in ("prompt", "chosen", "rejected")], loss("chosen"), loss("rejected"))


def swapped_endings(turns: DataFrame) -> DataFrame:
    """Pairs out of plain conversations, for :func:`format_preferences`.

    A conversation is chosen as it is. Rejected is the same with its last turn's
    text replaced by that of its neighbour (conv_id with the lowest bit turned), or
    left out where there is no neighbour or it has no turns. Texts are dealt by
    (conversation, turn), and only last turns go by conversation.
    """
    rows = one_row_a_turn(turns.select("conv_id", "turn", "role", "text"), "conv_id")
    last = turns.dropna(subset=["conv_id", "turn"]).groupBy("conv_id").agg(F.max("turn").alias("turn"))
    said = rows.join(last, ["conv_id", "turn"]).select(F.expr("conv_id ^ 1").alias("conv_id"), F.col("text").alias("other"))
    endings = last.join(said, "conv_id", "left").withColumn("ends", F.lit(True))
    both = rows.join(endings, ["conv_id", "turn"], "left")
    chosen = F.struct(F.lit("chosen").alias("side"), "text")
    swapped = F.when(F.col("ends"), F.col("other")).otherwise(F.col("text"))
    rejected = F.when(swapped.isNotNull(), F.struct(F.lit("rejected").alias("side"), swapped.alias("text")))
    return both.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.explode(F.array(chosen, rejected)).alias("s")).where("s IS NOT NULL").select("pair_id", "s.side", "turn", "role", "s.text")


def _shown(text: str) -> str:
    return f"'{OPEN}' || replace(role, '{MARK}', '{QUOTED}') || chr(10) || replace({text}, '{MARK}', '{QUOTED}') || '{END}' || chr(10)"


def _loss(side: str, text: str) -> str:
    header = f"length('{OPEN}' || replace(role, '{MARK}', '{QUOTED}') || chr(10))"
    start = f"CASE WHEN role = 'assistant' THEN {header} ELSE 0 END"
    end = f"CASE WHEN role = 'assistant' THEN length({_shown(text)}) - 1 ELSE 0 END"
    return ", ".join(f"CAST(CASE WHEN apart AND {text} IS NOT NULL THEN {x} END AS INTEGER) AS {side}_{name}" for name, x in (("from", start), ("to", end)))


ORACLE_SQL = f"""
    WITH t AS (SELECT conv_id, turn, m.role AS role, m.text AS text FROM (
             SELECT conv_id, turn, min({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}) AS m
             FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn) x),
    l AS (SELECT conv_id, max(turn) AS last_turn, arg_max(text, turn) AS text FROM t GROUP BY conv_id),
    s AS (SELECT t.conv_id AS pair_id, t.turn, t.role, t.text AS c,
             CASE WHEN t.turn = l.last_turn THEN o.text ELSE t.text END AS r
          FROM t JOIN l USING (conv_id) LEFT JOIN l o ON o.conv_id = xor(t.conv_id, 1)),
    f AS (SELECT pair_id, min(turn) FILTER (WHERE c IS DISTINCT FROM r) AS cut FROM s GROUP BY pair_id),
    p AS (SELECT s.*, cut IS NOT NULL AND turn >= cut AS apart FROM s JOIN f USING (pair_id))
    SELECT pair_id, turn, CASE WHEN NOT apart THEN {_shown("c")} END AS prompt,
           CASE WHEN apart THEN {_shown("c")} END AS chosen, {_loss("chosen", "c")},
           CASE WHEN apart THEN {_shown("r")} END AS rejected, {_loss("rejected", "r")} FROM p
"""
