"""Preference formatting of conversations, as DataFrame operations only.

A pair is two lists of turns, chosen and rejected. Their longest common prefix
of turns is rendered once as the prompt; what is left of each is its completion.
A completion's mask lists the code-point spans that count for the loss: the
texts of assistant turns with the end mark, and nothing else.

Defined results: a null text is empty, a null role is `user`; turns are ordered
by turn number, then role and text, so that repeated rows stay side by side;
turns without number come first; two equal conversations have all turns in the
prompt and empty completions; a turn without conv_id is a conversation of its own,
so that such rows spread over all tasks; no rows give none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def conversations(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turns): the turns (role, text) of each conversation in order."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    g = rows.select(id_col, turn.alias("t"), alone.alias("__sc_alone")).groupBy(id_col, "__sc_alone").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return g.select(id_col, F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def stale_reply_pairs(convs: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, chosen, rejected): rejected gives, in place of the last assistant
    turn, the assistant turn before it, or none if there is no other; what
    follows that turn is left out of it. A conversation without assistant turns
    is rejected without its last turn."""
    at = "filter(sequence(0, size(turns) - 1), i -> get(turns, i).role = 'assistant')"
    c = convs.filter(F.size("turns") > 0).withColumn("__sc_at", F.expr(at))
    last = F.coalesce(F.get("__sc_at", F.size("__sc_at") - 1), F.size("turns") - 1)
    c = c.withColumns({"__sc_last": last, "__sc_other": F.get("__sc_at", F.size("__sc_at") - 2)})
    head = F.slice("turns", F.lit(1), F.col("__sc_last"))
    stale = F.when(F.col("__sc_other").isNotNull(), F.concat(head, F.array(F.get("turns", "__sc_other")))).otherwise(head)
    return c.select(id_col, F.col("turns").alias("chosen"), stale.alias("rejected"))


def rendered(turns: str) -> Column:
    """Column: the turns of an array expression, rendered one after the other."""
    return F.expr(f"array_join(transform({turns}, t -> concat('{OPEN}', t.role, '\\n', t.text, '{CLOSE}\\n')), '')")


def mask(turns: str, trained: str = "assistant") -> Column:
    """Column: start:end of what counts for the loss in the rendered turns, comma-joined."""
    fixed = len(OPEN) + 1  # before the text, besides the role
    step = (
        f"named_struct('at', a.at + {fixed} + length(t.role) + length(t.text) + {len(CLOSE) + 1}, "
        f"'spans', IF(t.role = '{trained}', concat(a.spans, array(concat(a.at + {fixed} + length(t.role), ':', a.at + {fixed} + length(t.role) + length(t.text) + {len(CLOSE)}))), a.spans))"
    )
    return F.expr(f"array_join(aggregate({turns}, named_struct('at', 0, 'spans', CAST(array() AS ARRAY<STRING>)), (a, t) -> {step}, a -> a.spans), ',')")


def preferences(pairs: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, n_shared, prompt, chosen, rejected, chosen_mask, rejected_mask): one row per pair."""
    shared = F.expr(
        "coalesce(get(filter(sequence(0, least(size(chosen), size(rejected))), "
        "i -> i = least(size(chosen), size(rejected)) OR NOT (get(chosen, i) <=> get(rejected, i))), 0), 0)"
    )
    p = pairs.withColumn("__sc_n", shared)
    rest = {s: F.slice(F.col(s), F.col("__sc_n") + 1, F.greatest(F.size(s), F.lit(0))) for s in ("chosen", "rejected")}
    p = p.select(id_col, F.col("__sc_n").alias("n_shared"), F.slice("chosen", F.lit(1), F.col("__sc_n")).alias("__sc_p"), rest["chosen"].alias("__sc_c"), rest["rejected"].alias("__sc_r"))
    return p.select(
        id_col, F.col("n_shared").cast("long").alias("n_shared"), rendered("__sc_p").alias("prompt"),
        rendered("__sc_c").alias("chosen"), rendered("__sc_r").alias("rejected"),
        mask("__sc_c").alias("chosen_mask"), mask("__sc_r").alias("rejected_mask"),
    )
