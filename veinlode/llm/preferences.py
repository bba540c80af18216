"""Preference formatting: a shared prompt, and two masked completions.

The longest common prefix of turns of the chosen and the rejected conversation is rendered once, as
the prompt; what follows in each is rendered as its completion, with the spans of the text that a
loss counts (the assistant's words and the end mark after them).

Conversations that begin with the same turn compete: the longest (turns, then characters, then the smallest
id) is chosen, and each other one gives a pair with it, so that a group of n gives n - 1 pairs. The
chosen conversation has a row of its own without a rejected completion: the turns before its last
assistant turn are its prompt.

Only DataFrame functions are used. The best of a group is found by partial aggregation. A first
turn that opens over 1 / ``HOT`` of all conversations is split: its members are dealt by hash to parts
of about that size, and its best conversation is copied to each. At most ``HOT`` first turns can be so
common, which bounds the table of them that is broadcast.

Defined cases: null role or text is an empty string; rows with equal conv_id and turn are ordered
by role and text; equal rows are kept, each a turn; a row without a conv_id is a conversation of its
own; equal conversations share all turns, and have empty completions; new columns whose name is taken
get an underscore.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_split, materialise, need

Column = F.Column


#: First turns that open over one in so many conversations are split.
HOT = 1000


def conversations(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, row_no, turns: array<struct<role, text>>) in the order of turns; ``row_no`` is null where there is a conv_id."""
    need(rows, conv_id, turn, role, text)
    key = F.col(f"`{conv_id}`")
    parts = [F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")]
    told = rows.select(key.alias("conv_id"), F.when(key.isNull(), F.monotonically_increasing_id()).alias("row_no"), F.struct(*parts).alias("t"))
    gathered = told.groupBy("conv_id", "row_no").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return gathered.select("conv_id", "row_no", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def opened(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


END = "<|end|>\n"


def rendered(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(opened(t["role"]), t["text"], F.lit(END))))


def masked(turns: Column) -> Column:
    """Spans (start, end), in characters of the rendered turns, that the loss counts."""

    def step(state: Column, t: Column) -> Column:
        head = state["at"] + F.length(opened(t["role"]))
        tail = head + F.length(t["text"]) + F.lit(len(END))
        span = F.when(t["role"] == "assistant", F.array(F.struct(head.alias("start"), tail.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct(tail.alias("at"), F.concat(state["spans"], span).alias("spans"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(turns, empty, step, lambda s: s["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    least = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(0), least), lambda i: (i == least) | (F.get(a, i) != F.get(b, i)))
    return differ[0]


def before_last_answer(turns: Column) -> Column:
    """Number of turns before the last one by the assistant; of all but the last turn if there is none."""
    found = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: F.get(turns, i)["role"] == "assistant")
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.size(turns) - 1)


def from_turn(turns: Column, n: Column) -> Column:
    return F.slice(turns, n + 1, F.greatest(F.size(turns) - n, F.lit(0)))


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` with two arrays of turns (rejected may be null) becomes prompt, completions and masks."""
    need(pairs, chosen, rejected)
    others = [c for c in pairs.columns if c not in (chosen, rejected)]
    new = {n: fresh(n, others) for n in ("prompt_turns", "prompt", "chosen_text", "chosen_mask", "rejected_text", "rejected_mask")}
    kept = [pairs[f"`{c}`"].alias(f"_keep{i}") for i, c in enumerate(others)]
    told = pairs.select(*kept, pairs[f"`{chosen}`"].alias("a"), pairs[f"`{rejected}`"].alias("b"))
    n = F.when(F.col("b").isNull(), before_last_answer(F.col("a"))).otherwise(common_turns(F.col("a"), F.col("b")))
    cut = told.withColumn("n", n)
    cut = cut.select("*", F.slice("a", 1, F.col("n")).alias("p"), from_turn(F.col("a"), F.col("n")).alias("x"), from_turn(F.col("b"), F.col("n")).alias("y"))
    p, x, y = F.col("p"), F.col("x"), F.col("y")
    made = [F.col("n"), rendered(p), rendered(x), masked(x), F.when(y.isNotNull(), rendered(y)), F.when(y.isNotNull(), masked(y))]
    return cut.select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(others)], *[e.alias(c) for e, c in zip(made, new.values())])


def pair_up(convs: DataFrame) -> DataFrame:
    """(conv_id, chosen_id, chosen, rejected): one row per conversation, as the module says."""
    chars = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + F.length(t["text"]))
    own = F.struct("conv_id", "row_no")
    keyed = convs.select(
        own.alias("own"), "turns", F.sha2(F.concat_ws("\n", F.col("turns")[0]["role"], F.col("turns")[0]["text"]), 256).alias("first"),
        F.struct((-F.size("turns")).alias("t"), (-chars).alias("c"), F.col("conv_id").isNull().alias("n"), own.alias("i")).alias("rank"),
    )
    keyed = materialise(keyed)
    best = materialise(keyed.groupBy("first").agg(F.min_by(F.struct("own", "turns"), "rank").alias("best")))
    both = join_split(keyed.select("first", "own", "turns"), best, "first", F.col("own"), HOT)
    rejected = F.when(~F.col("own").eqNullSafe(F.col("best.own")), F.col("turns"))
    return both.select(
        F.col("own.conv_id").alias("conv_id"), F.col("best.own.conv_id").alias("chosen_id"), F.col("best.turns").alias("chosen"), rejected.alias("rejected")
    )


def digest(rows: DataFrame) -> DataFrame:
    made = format_pairs(pair_up(conversations(rows)))

    def spans(mask: str) -> Column:
        return F.concat_ws(",", F.transform(mask, lambda s: F.concat_ws(":", s["start"], s["end"])))

    return made.select(
        "conv_id", "chosen_id", "prompt_turns", "prompt", "chosen_text", spans("chosen_mask").alias("chosen_spans"), "rejected_text",
        F.when(F.col("rejected_text").isNotNull(), spans("rejected_mask")).alias("rejected_spans"),
    )
