r"""Chat formatting by a grammar round trip.

A conversation is rendered by a fixed template and read back by a deterministic parser:

    conversation = { "<|im_start|>" role "\n" text "<|im_end|>\n" }

Every text is first put in as it is. The rendered conversation is parsed again and the recovered
turns are compared with the source; the content of conversations that do not come back the same is
escaped, and the round is repeated until they do. The parser undoes escapes in both cases, so a
text that merely looks escaped also fails the comparison and is escaped in its turn.

Escape: one backslash is put between ``<`` and ``|`` (before backslashes already there), so that no
control string is left in a text and every text has one rendering: ``<|im_end|>`` -> ``<\|im_end|>``,
``<\|`` -> ``<\\|``. A role is escaped the same way, with backslash and line feed as ``\\`` and
``\n`` besides. One round of escaping always ends the loop; ``render`` raises if it ever does not.

DataFrame functions only. Edge cases: a null text or role is empty; turns are ordered by turn (null
first), then role, then text, and repeated rows stay; rows with a null conv_id form one
conversation; an empty table gives no rows; further columns are ignored. All turns of one
conversation meet in one row, as its rendering is one string (2 GB at most); conversations are
spread by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # Undo the control escape, then read backslash pairs left to right through a marker character.
    plain = unescape(role)
    halves = F.split(plain, r"\\\\", -1)
    return F.array_join(F.transform(halves, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def _rendered(turns: Column, escaped: bool) -> Column:
    def one(t: Column) -> Column:
        role, text = (escape_role(t["role"]), escape(t["text"])) if escaped else (t["role"], t["text"])
        return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(f"{END}\n"))

    return F.array_join(F.transform(turns, one), "")


def parse(rendered: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation.

    A turn starts at each start marker, its role ends at the first line feed, its text at the first
    end marker. A text that holds a marker therefore does not come back whole, unless escaped.
    """
    pieces = F.split(rendered, r"<\|im_start\|>", -1)

    def turn(p: Column) -> Column:
        cut = F.instr(p, "\n")
        body = F.substring_index(F.substring(p, cut + 1, F.length(p)), END, 1)
        return F.struct(
            unescape_role(F.substring(p, F.lit(1), cut - 1)).alias("role"), unescape(body).alias("text")
        )

    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)


#: Turns whose lengths are added up at a time.
STRIDE = 64


def starts(lengths: Column) -> Column:
    """What lies before each of some lengths: sums by strides, then inside them, so that work grows with their number."""

    def before(values: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            return F.struct((acc["at"] + x).cast("long").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

        return F.aggregate(values, zero, step, lambda acc: acc["out"])

    strides = F.sequence(F.lit(0), F.ceil(F.size(lengths) / F.lit(STRIDE)).cast("int") - 1)
    parts = F.transform(strides, lambda k: F.slice(lengths, k * STRIDE + 1, STRIDE))
    totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda acc, x: (acc + x).cast("long")))
    inside = F.zip_with(parts, before(totals), lambda p, base: F.transform(before(p), lambda x: (x + base).cast("long")))
    return F.when(F.size(lengths) > 0, F.flatten(inside)).otherwise(F.array().cast("array<bigint>"))


def _with_starts(df: DataFrame, name: str, lengths: Column) -> DataFrame:
    """Add ``name``: the starts of parts of these lengths; lengths and starts are each computed once a row."""
    held = df.withColumn("_lengths", F.explode(F.array(lengths)))
    return held.withColumn(name, F.explode(F.array(starts(F.col("_lengths"))))).drop("_lengths")


def _shown(t: Column, escaped: Column) -> tuple[Column, Column]:
    """Role and text of a turn as they stand in the rendering."""
    role = F.when(escaped, escape_role(t["role"])).otherwise(t["role"])
    return role, F.when(escaped, escape(t["text"])).otherwise(t["text"])


def _spans(turns: Column, at: Column, escaped: Column) -> Column:
    """array<struct<turn, start, length>>: the code points of each trained text in the rendering."""

    def span(t: Column, i: Column) -> Column:
        role, text = _shown(t, escaped)
        start = F.element_at(at, i + 1) + F.lit(len(START) + 1) + F.length(role)
        here = F.struct(i.alias("turn"), start.cast("long").alias("start"), F.length(text).cast("long").alias("length"))
        return F.when(t["role"] == TRAINED_ROLE, here)

    return F.filter(F.transform(turns, span), lambda s: s.isNotNull())


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, nulls as empty strings."""
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return (
        conversations.select("conv_id", turn.alias("_turn"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("_turn")).alias("turns"))
    )


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, formatted, loss (array of spans: turn, start and length in code points).

    Rounds of render, parse and compare: raw first, escaped where the raw one fails.
    """
    turns = turns_of(conversations)

    def same(rendered: Column) -> Column:
        got = F.transform(parse(rendered), lambda t: F.struct(t["role"], t["text"]))
        return got == F.transform(F.col("turns"), lambda t: F.struct(t["role"], t["text"]))

    raw = turns.withColumn("formatted", _rendered(F.col("turns"), False))
    checked = raw.withColumn("_escaped", ~same(F.col("formatted")))
    again = checked.withColumn(
        "formatted", F.when(F.col("_escaped"), _rendered(F.col("turns"), True)).otherwise(F.col("formatted"))
    )
    failed = F.raise_error(F.concat(F.lit("conversation does not round-trip: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    frame_size = len(START) + len(END) + 2

    def length(t: Column) -> Column:
        role, text = _shown(t, F.col("_escaped"))
        return (F.length(role) + F.length(text) + F.lit(frame_size)).cast("long")

    accepted = F.when(~F.col("_escaped") | same(F.col("formatted")), F.col("formatted")).otherwise(failed.cast("string"))
    placed = _with_starts(again, "_at", F.transform("turns", length))
    spans = _spans(F.col("turns"), F.col("_at"), F.col("_escaped"))
    return placed.select("conv_id", accepted.alias("formatted"), spans.alias("loss"))


def digest(rendered: DataFrame) -> DataFrame:
    """Read rendered conversations back: counts and digests of the turns and of the trained text."""
    turns = F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    # A span lies in the piece of its turn: it is cut from there, not from the start of the whole rendering.
    pieces = rendered.withColumn("_pieces", F.explode(F.array(F.split("formatted", r"<\|im_start\|>", -1))))
    placed = _with_starts(pieces, "_at", F.transform("_pieces", lambda p: (F.length(p) + F.lit(len(START))).cast("long")))

    def trained(s: Column) -> Column:
        start = s["start"] - F.element_at(F.col("_at"), s["turn"] + 2) + 1
        return unescape(F.substring(F.element_at(F.col("_pieces"), s["turn"] + 2), start.cast("int"), s["length"].cast("int")))

    return (
        placed.withColumn("turns", parse(F.col("formatted")))
        .withColumn("_loss", F.array_join(F.transform("loss", trained), ""))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
            F.length("_loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )
