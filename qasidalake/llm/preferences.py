"""Chat formatting for preference training.

Given the turns of a chosen and a rejected conversation, the longest common
prefix of turns is rendered once as the prompt; what follows it in either is
rendered as a completion with a mask.  A mask lists the half-open spans of code
points of its completion that take part in the loss: the texts and end marks of
assistant turns, not the headings and not other roles.

Turns are equal where role and text are; a null role or text is rendered as an
empty one and equals only null.  If one conversation is a prefix of the other its
completion is empty; equal conversations leave two empty completions.  Null turn
lists count as empty, an empty table gives an empty one.  Repeated rows are all kept.
Turns of one number follow each other by role and text.  A conversation is one row of
the result, so its whole text has to fit in a task; only that bounds its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import let

END = "<|end|>\n"


def _heading(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_heading(t), _body(t))), "")


def mask(turns: Column) -> Column:
    """``start:end`` of each trained span in the rendered turns, comma-joined."""

    def step(state: Column, turn: Column) -> Column:
        start = state["at"] + F.length(_heading(turn))
        end = start + F.length(_body(turn))
        span = F.array(F.concat_ws(":", start.cast("string"), end.cast("string")))
        spans = F.when(turn["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.array_join(F.aggregate(turns, start, step, lambda s: s["spans"]), ",")


def common_turns(chosen: Column, rejected: Column) -> Column:
    """How many turns at the start are the same in both."""
    same = F.zip_with(chosen, rejected, lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]) & a.isNotNull() & b.isNotNull())
    return let(same, lambda s: F.when(F.array_contains(s, False), F.array_position(s, False) - 1).otherwise(F.size(s)).cast("int"))


def format_preferences(df: DataFrame, chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """``df`` with prompt, completions and masks in place of its two columns of ``array<struct<role, text>>``.

    The new columns take the place of any that ``df`` has by their names.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    chosen, rejected = F.coalesce(F.col(chosen_col), none), F.coalesce(F.col(rejected_col), none)

    def split(n: Column) -> Column:
        rest = lambda turns: F.slice(turns, n + 1, F.greatest(F.size(turns) - n, F.lit(0)))
        return F.struct(n.alias("n"), F.slice(chosen, F.lit(1), n).alias("prompt"), rest(chosen).alias("chosen"), rest(rejected).alias("rejected"))

    new = ("n_prompt_turns", "prompt", "chosen_completion", "chosen_mask", "rejected_completion", "rejected_mask")
    kept = [c for c in df.columns if c not in (chosen_col, rejected_col) and c.lower() not in new]
    parts = F.struct(*(F.col(c) for c in kept)).alias("kept") if kept else F.lit(None).alias("kept")
    s = F.col("s")
    return df.select(parts, let(common_turns(chosen, rejected), split).alias("s")).select(
        *(F.col("kept")[c].alias(c) for c in kept),
        s["n"].alias(new[0]),
        render(s["prompt"]).alias(new[1]),
        render(s["chosen"]).alias(new[2]),
        mask(s["chosen"]).alias(new[3]),
        render(s["rejected"]).alias(new[4]),
        mask(s["rejected"]).alias(new[5]),
    )


def gathered(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) of a table (conv_id, turn, role, text): a conversation is one row, its turns in order.

    Turns of one number follow each other by role and text.  A row without a conv_id
    is a conversation of its own; such rows are not shuffled.
    """
    plain = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    rows = turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    alone = turns.where("conv_id IS NULL").select("conv_id", F.array(F.struct("role", "text")).alias("turns"))
    return rows.select("conv_id", F.transform("turns", plain).alias("turns")).unionByName(alone)


def answers_swapped(turns: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Preference pairs out of plain conversations: (conv_id, chosen, rejected).

    Chosen is the conversation.  Rejected are its turns before its last assistant
    turn, then the last assistant turn of the conversation that ``pairs`` (conv_id,
    other_id; each conv_id once) names, none where there is no such conversation or
    turn.  Without ``pairs`` that is the conversation numbered one higher, and none
    where ids are no whole numbers.
    """
    whole = gathered(turns)
    places = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.get(F.col("turns"), i - 1)["role"] == "assistant")
    marked = whole.withColumn("place", F.array_max(places))
    last = F.get(F.col("turns"), F.col("place") - 1).alias("answer")
    kind = turns.schema["conv_id"].dataType
    answers = marked.where("place IS NOT NULL").select(F.col("conv_id").alias("other_id"), last)
    if pairs is not None:
        answers = answers.join(pairs.select("conv_id", "other_id"), "other_id").select(F.col("conv_id").alias("asked"), "answer")
    elif isinstance(kind, T.IntegralType):
        answers = answers.select(F.try_subtract("other_id", F.lit(1).cast(kind)).alias("asked"), "answer")
    else:
        answers = answers.select(F.col("other_id").alias("asked"), "answer").limit(0)
    answers = answers.where("asked IS NOT NULL")
    paired = marked.join(answers, F.col("conv_id") == F.col("asked"), "left")
    head = F.slice("turns", F.lit(1), F.coalesce(F.col("place") - 1, F.size("turns")))
    rejected = F.when(F.col("answer").isNotNull(), F.concat(head, F.array("answer"))).otherwise(head)
    return paired.select("conv_id", F.col("turns").alias("chosen"), rejected.alias("rejected"))
