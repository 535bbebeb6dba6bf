"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations. Events are dealt by conversation, sorted by sequence and folded
into the final messages: a `message` opens a message, `delta` adds streamed text to it, `edit`
replaces its text, `regenerate` empties it for new deltas, `delete` removes it. The messages are
rendered with marked turns; control strings inside texts are escaped so that the original text can
be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
EVENTS = ("message", "delta", "edit", "regenerate", "delete")


def fold_events(events: DataFrame) -> DataFrame:
    """conv_id and `messages`, an array of (role, text) in the order in which they were opened.

    Columns read: conv_id, seq, message (which message of the conversation), kind, role, text. Null
    roles and texts are empty; a null or unknown kind does nothing. Events that tie in seq are
    sorted by kind (message before delta before edit before regenerate before delete), role and
    text, so the result does not depend on the order of the input; repeated `message` events open a
    message each. Events before the first `message` of their message are left out. A conversation
    of which every message was deleted has an empty array. A null conv_id is a conversation too.
    One conversation is one output row, so its events meet in one task; everything happens in that
    one exchange.
    """
    rank = F.array_position(F.array(*[F.lit(kind) for kind in EVENTS]), F.col("kind"))
    order = ["seq", "rank", "role", "text"]
    log = events.select(
        "conv_id",
        "seq",
        "message",
        "kind",
        rank.alias("rank"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).repartition("conv_id")
    opened = Window.partitionBy("conv_id", "message").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    numbered = log.withColumn(
        "copy", F.sum(F.when(F.col("kind") == "message", 1).otherwise(0)).over(opened)
    )
    whole = numbered.groupBy("conv_id", "message", "copy").agg(
        F.array_sort(F.collect_list(F.struct(*order, "kind"))).alias("steps")
    )
    # only what follows the last step that sets or empties the text counts
    last_reset = F.array_max(
        F.transform(
            "steps",
            lambda step, i: F.when(step["kind"].isin("message", "edit", "regenerate"), i).otherwise(-1),
        )
    )
    texts = F.transform(
        F.filter(
            F.slice("steps", F.greatest(F.col("reset"), F.lit(0)) + 1, F.size("steps")),
            lambda step: step["kind"].isin("message", "delta", "edit"),
        ),
        lambda step: step["text"],
    )
    folded = (
        whole.withColumn("reset", last_reset)
        .withColumn("gone", F.exists("steps", lambda step: step["kind"] == "delete"))
        .select(
            "conv_id",
            ((F.col("copy") > 0) & ~F.col("gone")).alias("stays"),
            F.struct(
                F.col("steps")[0]["seq"].alias("seq"),
                "message",
                "copy",
                F.col("steps")[0]["role"].alias("role"),
                F.array_join(texts, "").alias("text"),
            ).alias("entry"),
        )
    )
    return folded.groupBy("conv_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("stays"), F.col("entry")))),
            lambda entry: F.struct(entry["role"].alias("role"), entry["text"].alias("text")),
        ).alias("messages")
    )


def escape(text: Column) -> Column:
    r"""Doubles every backslash and writes `<|` as `<\|`, so `<|` is found in marks only."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    r"""An escaped text has an even run of backslashes between `<` and `|`, or our single one."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def render(messages: Column) -> Column:
    r"""`<|im_start|>role\ntext<|im_end|>\n` for every message."""
    return F.array_join(
        F.transform(
            messages,
            lambda m: F.concat(
                F.lit(START), _escape_role(m["role"]), F.lit("\n"), escape(m["text"]), F.lit(END + "\n")
            ),
        ),
        "",
    )


def read_back(formatted: Column) -> Column:
    """The messages of a rendered conversation, an array of (role, text)."""
    turns = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda turn: turn != "")
    heads = F.transform(turns, lambda turn: F.substring(turn, len(START) + 1, F.length(turn)))
    return F.transform(
        heads,
        lambda turn: F.struct(
            _unescape_role(F.substring_index(turn, "\n", 1)).alias("role"),
            unescape(F.substring(turn, F.locate("\n", turn) + 1, F.length(turn))).alias("text"),
        ),
    )


LEARNT_ROLE = "assistant"


def render_masked(folded: DataFrame) -> DataFrame:
    """conv_id, `formatted` and `loss_spans` of folded conversations (conv_id, messages).

    `formatted` is as `render` gives it. The loss mask is an array with an entry per message: (start,
    end) for an assistant's, whose escaped text is what lies from code point start on and before end
    of `formatted`, NULL for others. A conversation without messages is an empty text without spans.
    A conversation's messages lie in one task already; nothing is shuffled again.
    """
    pieces = (
        folded.select("conv_id", F.posexplode_outer("messages").alias("place", "message"))
        .select("conv_id", "place", "message.role", escape(F.col("message.text")).alias("written"))
        .withColumn("head", F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n")))
        .withColumn("piece", F.concat("head", "written", F.lit(END + "\n")))
    )
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head")
    span = F.struct(start.alias("start"), (start + F.length("written")).alias("end"))
    placed = pieces.withColumn("span", F.when(F.col("role") == LEARNT_ROLE, span))
    whole = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "piece", "span")))).alias("turns")
    )
    return whole.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform("turns", lambda t: t["span"]).alias("loss_spans"),
    )


def under_mask(masked: DataFrame) -> DataFrame:
    """conv_id and `loss_texts`: what lies under the spans of `loss_spans` in `formatted`, unescaped,
    in order.

    A span is cut out of the turn of its place, by its distance from where that turn begins in
    `formatted`, so a long conversation is not walked from its beginning for every span.
    """
    turns = F.arrays_zip(F.split("formatted", r"(?<=<\|im_end\|>\n)").alias("turn"), F.col("loss_spans").alias("span"))
    parts = masked.select("conv_id", F.posexplode(turns).alias("place", "part")).select(
        "conv_id", "place", F.coalesce("part.turn", F.lit("")).alias("turn"), "part.span"
    )
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0))
    first, length = F.col("span.start") - F.col("begin") + 1, F.col("span.end") - F.col("span.start")
    cut = unescape(F.substring("turn", first.cast("int"), length.cast("int")))
    found = parts.withColumn("begin", begin).withColumn("cut", F.when(F.col("span").isNotNull(), cut))
    return found.groupBy("conv_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("cut").isNotNull(), F.struct("place", "cut")))),
            lambda c: c["cut"],
        ).alias("loss_texts")
    )
