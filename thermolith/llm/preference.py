"""Preference pairs: the longest common prefix of turns, once, and two masked completions.

Both conversations of a pair meet in one shuffle, as sorted sets of turns; the common
prefix, the rendering and the spans are array functions over these two. A task holds
pairs, each of which has to be held whole to be a training example at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns whose lengths are added up at a time.
STRIDE = 256


def escaped(text: Column) -> Column:
    """A mark inside of a text gets one more backslash, so no text can pass for a mark; taking one away gives the text back."""
    plain = F.coalesce(text, F.lit(""))
    return F.when(plain.contains("<"), F.regexp_replace(plain, r"<(\\*)\|", r"<$1\\|")).otherwise(plain)


def render(role: Column, text: Column) -> Column:
    """One turn in the chat template: ``<|role|>``, the text, ``<|end|>``, each on its line."""
    return F.concat(F.lit("<|"), escaped(role), F.lit("|>\n"), escaped(text), F.lit("\n<|end|>\n"))


def running(lengths: Column, start: Column) -> Column:
    """``start``, and it with the first one, two ... of ``lengths`` added. An array that grows is
    copied with each step, so sums go by strides: inside each, and over their totals."""
    add = lambda first, xs: F.aggregate(xs, F.array(first), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
    n = F.size(lengths)
    strides = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / STRIDE).cast("int")), lambda k: F.slice(lengths, k * STRIDE + 1, STRIDE))
    firsts = add(start, F.transform(strides, lambda s: F.aggregate(s, F.lit(0), lambda a, b: a + b)))
    inside = F.zip_with(strides, F.slice(firsts, 1, F.size(strides)), lambda s, first: add(first, s))
    return F.concat(F.array(start), F.flatten(F.transform(inside, lambda xs: F.slice(xs, 2, F.size(xs)))))


def format_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """One row for each key of ``chosen`` or ``rejected``, both (key, turn, role, text).

    ``prompt``: the common prefix of turns, rendered once. ``chosen`` and ``rejected``: what
    follows, rendered. ``prompt_turns``, ``chosen_turns``, ``rejected_turns``: their
    numbers of turns. ``chosen_mask`` and ``rejected_mask``: for the rendered
    conversation, [first, end) character spans that are trained on: the assistant's
    turns of the completion, their text and end mark, without the header.

    Turns go by their number, null first; those of one number by role and text. Repeated
    rows of a turn are one turn. Turns are equal if role and text are, null equal to null, whatever their
    numbers. A null text is empty. Equal conversations have empty completions. A conversation on one
    side only has no common prefix and the other side is empty. Null keys are dropped; an
    empty table gives no rows; other columns aren't read. Texts and conversations have no bound but a row's.
    """
    sides = [df.where(F.col(key).isNotNull()).select(key, F.lit(i).alias("side"), F.struct("turn", "role", "text").alias("t")) for i, df in enumerate((chosen, rejected))]
    turns_of = lambda i: F.array_sort(F.collect_set(F.when(F.col("side") == i, F.col("t"))))
    d = sides[0].unionByName(sides[1]).groupBy(key).agg(turns_of(0).alias("c"), turns_of(1).alias("r"))

    n = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", F.lit(1), n), F.slice("r", F.lit(1), n), lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    first = F.array_position(same, False).cast("int")  # 0: none differs
    d = d.withColumn("shared", F.when(first == 0, n).otherwise(first - 1))
    # Each turn is rendered once; what follows takes its pieces and their lengths.
    pieces = lambda turns: F.transform(turns, lambda t: F.struct(render(t["role"], t["text"]).alias("piece"), (F.length(escaped(t["role"])) + 5).alias("head"), F.coalesce(t["role"] == "assistant", F.lit(False)).alias("own")))
    d = d.select(key, "shared", pieces("c").alias("c"), pieces("r").alias("r"))
    whole = lambda turns: F.array_join(F.transform(turns, lambda t: t["piece"]), "")
    rest = lambda c: F.slice(c, F.col("shared") + 1, F.greatest(F.size(c) - F.col("shared"), F.lit(0)))

    def spans(c: str) -> Column:
        """Spans of assistant turns after the prefix, counted from the conversation's first character."""
        turns = rest(c)
        ends = running(F.transform(turns, lambda t: F.length(t["piece"])), F.length("prompt"))
        each = F.zip_with(turns, F.slice(ends, F.lit(2), F.size(turns)), lambda t, end: F.struct((end - F.length(t["piece"]) + t["head"]).alias("first"), end.alias("end"), t["own"].alias("own")))
        return F.transform(F.filter(each, lambda s: s["own"]), lambda s: F.struct(s["first"].alias("first"), s["end"].alias("end")))

    d = d.withColumn("prompt", whole(F.slice("c", F.lit(1), F.col("shared"))))
    return d.select(
        key, "prompt", whole(rest("c")).alias("chosen"), whole(rest("r")).alias("rejected"), F.col("shared").alias("prompt_turns"),
        (F.size("c") - F.col("shared")).alias("chosen_turns"), (F.size("r") - F.col("shared")).alias("rejected_turns"), spans("c").alias("chosen_mask"), spans("r").alias("rejected_mask"),
    )


def partner_pairs(turns: DataFrame, conv_col: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """A stated way to get pairs from plain conversations. Chosen: each conversation as
    it is. Rejected: the same, with its last assistant turn's text replaced by that of
    the last assistant turn of its partner, the conversation whose id differs in the
    lowest bit. Without such a turn, or a partner that has one, that turn is left out.

    The last assistant turn is that of the largest number; turns without one are never it. If
    several assistant turns have that number, each is replaced; the partner's is then that of
    the largest text. Conversations without an id have no partner.
    """
    key = F.col(conv_col).alias("pair_id")
    last = turns.where(F.col("role") == "assistant").groupBy(key).agg(F.max("turn").alias("last_turn"), F.max_by("text", F.struct("turn", "text")).alias("last_text"))
    reply = last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("last_text").alias("other"), F.lit(True).alias("has_other"))
    chosen = turns.select(key, "turn", "role", "text")
    joined = chosen.join(last.select("pair_id", "last_turn"), "pair_id", "left").join(reply, "pair_id", "left")
    is_last = F.coalesce((F.col("turn") == F.col("last_turn")) & (F.col("role") == "assistant"), F.lit(False))
    rejected = joined.where(~is_last | F.col("has_other")).select("pair_id", "turn", "role", F.when(is_last, F.col("other")).otherwise(F.col("text")).alias("text"))
    return chosen, rejected
