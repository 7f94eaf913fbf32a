"""Preference formatting of conversation pairs.

The longest common prefix of turns of the chosen and the rejected conversation is rendered once, as the
prompt; what follows is rendered as two completions with masks of what an assistant says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound, running_sums, written


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns as an array of (role, text) in the order of turn; a conversation fits a row.

    Null roles and texts are empty strings. Repeated rows of a turn count once; different rows of one turn
    come in the order of role and text. Rows with a null conv_id or turn belong to no conversation.
    """
    rows = turns.where("conv_id is not null and turn is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    whole = rows.groupBy("conv_id").agg(F.array_distinct(F.sort_array(F.collect_list(F.struct("turn", "role", "text")))).alias("turns"))
    return whole.withColumn("turns", F.expr("transform(turns, t -> named_struct('role', t.role, 'text', t.text))"))


def pairs_by_opening(convs: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, c, r): conversations that open alike, each against the first of them.

    The one with the smallest conv_id is taken as chosen and every other as rejected, so the number of pairs
    grows with the conversations, however many share an opening. Equal conversations make no pair.
    """
    opened = convs.select("conv_id", F.sha2(F.to_json(F.get("turns", F.lit(0))), 256).alias("opening"), F.sha2(F.to_json("turns"), 256).alias("whole"))
    # Written, so the join reads both sides from shuffles and the tasks of a common opening can be split.
    firsts = written(opened.groupBy("opening").agg(F.min(F.struct("conv_id", "whole")).alias("first")), "openings")
    both = opened.join(firsts, "opening").where("conv_id != first.conv_id and whole != first.whole").select(F.col("first.conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"))
    left = both.join(convs.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("c")), "chosen_id")
    return left.join(convs.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("r")), "rejected_id").select("chosen_id", "rejected_id", "c", "r")


def pairs_by_reply(convs: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, c, r): conversations against themselves with another one's last reply.

    A conversation that ends with an assistant's turn is chosen; rejected is the same one with that turn's
    text taken from the conversation with the next number, if that ends so too and the texts differ.
    """
    ends = convs.where("element_at(turns, -1).role = 'assistant'")
    donor = ends.select((F.col("conv_id") - 1).alias("conv_id"), F.expr("element_at(turns, -1)").alias("reply"))
    both = ends.join(donor, "conv_id").where("element_at(turns, -1).text != reply.text")
    return both.selectExpr("conv_id as chosen_id", "conv_id + 1 as rejected_id", "turns as c", "concat(slice(turns, 1, size(turns) - 1), array(reply)) as r")


def rendered(turns: str) -> str:
    """SQL: turns as text, each under a role header and closed by an end marker."""
    return f"array_join(transform({turns}, t -> concat('<|', t.role, '|>\\n', t.text, '<|end|>\\n')), '')"


def mask(turns: str) -> str:
    """SQL: (start, end) code points, within the rendered turns, of what assistants say and its end marker."""
    sizes = f"transform({turns}, t -> cast(char_length(t.role) + char_length(t.text) + 13 as bigint))"
    spans = f"transform({turns}, (t, i) -> named_struct('role', t.role, 'start', get(e, i) - char_length(t.text) - 8, 'end', get(e, i) - 1))"
    kept = f"transform(filter({spans}, s -> s.role = 'assistant'), s -> named_struct('start', s.start, 'end', s.end))"
    return bound(running_sums(sizes), "e", kept)


def preference_pairs(pairs: DataFrame) -> DataFrame:
    """Formats pairs (chosen_id, rejected_id, c, r), c and r being arrays of (role, text); row for row.

    Adds n_common (turns of the longest common prefix), prompt, chosen, rejected (rendered texts) and
    chosen_mask, rejected_mask (arrays of code point spans that count for the loss). If one conversation is
    the other's prefix its completion is empty, with an empty mask; pairs without any common turn have an
    empty prompt. Null turns stand for none; repeated pairs come out once each; no pairs give no rows.
    """
    same = "zip_with(slice(c, 1, least(size(c), size(r))), slice(r, 1, least(size(c), size(r))), (x, y) -> x = y)"
    differ = f"cast(array_position({same}, false) as int)"
    none = "cast(array() as array<struct<role:string,text:string>>)"
    both = pairs.selectExpr("chosen_id", "rejected_id", f"coalesce(c, {none}) as c", f"coalesce(r, {none}) as r")
    both = both.withColumn("n", F.expr(f"if({differ} = 0, least(size(c), size(r)), {differ} - 1)"))
    both = both.selectExpr("chosen_id", "rejected_id", "n", "slice(c, 1, n) as p", "slice(c, n + 1, size(c)) as c", "slice(r, n + 1, size(r)) as r")
    return both.selectExpr(
        "chosen_id", "rejected_id", "cast(n as bigint) as n_common", f"{rendered('p')} as prompt",
        f"{rendered('c')} as chosen", f"{mask('c')} as chosen_mask", f"{rendered('r')} as rejected", f"{mask('r')} as rejected_mask",
    )
