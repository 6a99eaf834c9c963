"""Chat transcripts as training windows under a token budget.

A conversation is cut at turns into spans by prefix sums of turn tokens. Every window repeats the leading system turn and as
much of the turns before its span as the history budget holds; the loss mask covers the assistant texts of the span alone, so
each is trained once. Control strings cannot arise inside a text: an escape character is put into whatever could begin one,
and taken out again when a window is read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fogline.llm._scratch import BROADCAST_KEYS, Scratch

#: Tokens of a window, and of the turns repeated before its span.
BUDGET, HISTORY = 1024, 256
#: Characters of a token, on average.
CHARS_PER_TOKEN = 4
#: Turns of a block whose prefix sums are taken together.
BLOCK_TURNS = 256
OPEN, CLOSE = "<|turn|>", "<|end|>"


def escape(text: Column) -> Column:
    r"""Put ``\`` after every ``<`` and ``[`` and double every ``\``: no ``<|``, ``</`` or ``[INST`` is left."""
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def render_role(role: Column) -> Column:
    r"""A role is escaped like a text, and its line feeds become ``[n``, which no escaped text holds."""
    return F.replace(escape(role), F.lit("\n"), F.lit("[n"))


def read_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("[n"), F.lit("\n")))


def _turns(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rendered turns with place and tokens before them in their block of turns. Only role and text are shuffled: a turn is
    rendered after that, and the windows find their blocks together."""
    rows = conversations.select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    block = F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(2**62))).cast("long")
    rows = rows.withColumn("block", block).repartition("conv_id", "block")
    head = F.concat(F.lit(OPEN), render_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    whole = F.concat(head, body, F.lit(CLOSE + "\n"))
    rows = rows.withColumn("whole", whole).withColumn("body_at", F.length(head)).withColumn("body_chars", F.length("whole") - F.col("body_at") - len(CLOSE) - 1)
    rows = rows.withColumn("tokens", F.ceil(F.length("whole") / CHARS_PER_TOKEN).cast("long"))
    within = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    ahead = F.coalesce(F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("conv_id", "block", "role", "whole", "body_at", "body_chars", "tokens", ahead.alias("ahead"), (F.row_number().over(within) - 1).cast("long").alias("nth"))


def format_conversations(
    conversations: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = BUDGET,
    history: int = HISTORY,
) -> DataFrame:
    """One row per window: conv_id, window (from 0), n_context (leading turns that are repeated), n_turns, formatted, tokens,
    loss (array of start and length, in code points of ``formatted``).

    Turns are ordered by turn, null first, then role and text; null roles and texts are empty. The system turn is the first
    turn if its role is ``system``. A window keeps to the budget unless a single turn is longer than half of the room left
    beside system turn and history: turns are never cut. A long system turn leaves less room for history, so that no turn is
    repeated more than three times; one that fills the budget alone is followed by spans of half a budget. Rows that repeat a turn are turns of their own; a null conv_id is a
    conversation of its own. A conversation or turn of any length is kept whole, and long ones are placed in blocks of turns. Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(conversations.sparkSession, "chat")
    rows = scratch.write(_turns(conversations, id_col, turn_col, role_col, text_col), "turns")
    is_system = (F.col("nth") == 0) & (F.col("role") == "system")
    sums = rows.groupBy("conv_id", "block").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("turns"), F.max(F.when(is_system, F.col("tokens"))).alias("opening"))
    blocks = Window.partitionBy("conv_id").orderBy("block")
    earlier, whole = blocks.rowsBetween(Window.unboundedPreceding, -1), blocks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"base_{c}") for c in ("tokens", "turns")]
    bases = sums.select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), *base, F.coalesce(F.first("opening").over(whole), F.lit(0)).alias("system_tokens"))
    bases = scratch.sized(scratch.write(bases, "bases"), BROADCAST_KEYS // 2)

    placed = rows.join(bases, rows["conv_id"].eqNullSafe(bases["_conv"]) & (rows["block"] == bases["_block"]))
    placed = placed.withColumn("nth", F.col("base_turns") + F.col("nth")).withColumn("is_system", is_system)
    # the system turn opens the first span; what follows is dealt by the tokens after it
    after = F.greatest(F.col("base_tokens") + F.col("ahead") - F.col("system_tokens"), F.lit(0))
    room = F.lit(budget) - F.col("system_tokens")
    most = F.greatest(F.least(F.lit(history), F.floor(room / 2)), F.lit(0)).cast("long")
    step = F.when(room >= 4, F.greatest(F.floor((room - F.col("history")) / 2), F.lit(1))).otherwise(max(1, budget // 2)).cast("long")
    spans = placed.withColumn("after", after).withColumn("history", most).withColumn("step", step).withColumn("own_span", F.floor(F.col("after") / F.col("step")))

    part = ["conv_id", "span", "nth", "role", "whole", "body_at", "body_chars", "tokens", "after", "history", "is_system"]
    last = F.when(F.col("is_system"), F.col("own_span")).otherwise(F.floor((F.col("after") + F.col("history")) / F.col("step")))
    parts = spans.withColumn("span", F.explode(F.sequence("own_span", F.greatest(last, "own_span")))).select(*part, (F.col("span") > F.col("own_span")).alias("context"))
    later = spans.where("own_span > 0").select(F.col("conv_id").alias("_conv"), F.col("own_span").alias("span")).distinct()
    later = scratch.write(later, "later")  # a table of its own, so that the join can split a long conversation
    led = later.join(spans.where("is_system").drop("_conv"), later["_conv"].eqNullSafe(F.col("conv_id"))).select(*part, F.lit(True).alias("context"))

    # one shuffle by window: a turn is repeated if the span that it would lead begins soon after it
    window = Window.partitionBy("conv_id", "span")
    start = F.min(F.when(~F.col("context"), F.col("after"))).over(window)
    laid = parts.unionByName(led).repartition("conv_id", "span").withColumn("start", start)
    laid = laid.where(~F.col("context") | (F.col("start").isNotNull() & (F.col("is_system") | (F.col("start") - F.col("after") <= F.col("history")))))
    upto = window.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    laid = laid.withColumn("at", F.coalesce(F.sum(F.length("whole")).over(upto), F.lit(0)))
    trained = (F.col("role") == "assistant") & ~F.col("context")
    mask = F.when(trained, F.struct((F.col("at") + F.col("body_at")).alias("start"), F.col("body_chars").cast("long").alias("length")))
    gathered = laid.groupBy("conv_id", "span").agg(
        F.sort_array(F.collect_list(F.struct("nth", "whole"))).alias("parts"),  # bounded by the budget
        F.sort_array(F.collect_list(mask)).alias("loss"),
        F.count_if("context").alias("n_context"),
        F.count(F.lit(1)).alias("n_turns"),
        F.sum("tokens").alias("tokens"),
    )
    return gathered.select("conv_id", F.col("span").alias("window"), "n_context", "n_turns", F.array_join("parts.whole", "").alias("formatted"), "tokens", "loss")


def read_windows(windows: DataFrame) -> DataFrame:
    """What a trainer would read back, per window: the new turns (role, text) and the unescaped texts under the loss mask."""
    pieces = F.slice(F.split("formatted", OPEN.replace("|", r"\|")), F.col("n_context").cast("int") + 2, F.greatest(F.col("n_turns") - F.col("n_context"), F.lit(0)).cast("int"))
    turn = lambda p: F.struct(read_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(_body(p)).alias("text"))
    read = windows.withColumn("turns", F.transform(pieces, turn))
    loss = F.transform("loss", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int"))))
    return read.select("conv_id", "window", "turns", loss.alias("loss_texts"), F.length("formatted").alias("chars"))


def _body(piece: Column) -> Column:
    """What stands between a piece's first line feed and its closing mark."""
    at = F.instr(piece, "\n")
    return F.substring(piece, at + 1, F.length(piece) - at - len(CLOSE) - 1)


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    read = read_windows(windows)
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    per = read.select("conv_id", "window", F.size("turns").alias("turns"), text.alias("text"), F.array_join("loss_texts", "").alias("loss"), "chars")
    joined = per.groupBy("conv_id").agg(F.sum("turns").cast("long").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "text", "loss"))).alias("parts"), F.sum("chars").cast("long").alias("formatted_chars"))
    whole, loss = F.array_join("parts.text", ""), F.array_join("parts.loss", "")
    return joined.select(
        "conv_id", "n_turns", F.sha2(whole, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars"
    )

