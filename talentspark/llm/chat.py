"""Chat formatting from an event log, with DataFrame functions only.

A log has one row per event: conv_id, msg (number of the message), seq, kind, role, text. ``open`` starts
a message, ``delta`` appends to it, ``edit`` replaces what is there, ``regenerate`` discards it. Events
are sorted by ``seq`` and folded into messages, which are rendered as

    ### role ###
    text</turn>

Inside roles and texts ``\\`` and ``#`` are written with a backslash before them and ``</turn>`` as
``<\\/turn>``, so neither control string can occur there; ``unescape`` gives the text back. The loss mask
covers what assistants say: per turn, the first character within the rendered turn and their number.

Edge cases: a null role or text is empty; a message without deltas is an empty turn; events of equal
``seq`` are ordered by kind, role and text; repeated rows of a conversation are turns of their own; a
null conv_id is a conversation like any other; an empty log gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

OPEN, CLOSE, TURN = "### ", " ###\n", "</turn>\n"
SPEAKER = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"([\\#])", r"\\$1"), F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def event_log(turns: DataFrame) -> DataFrame:
    """The log of conversations given as rows (conv_id, turn, role, text): what an assistant says is
    streamed in two deltas after a discarded draft, other texts are typed in part and then edited."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = turns.select(
        "conv_id", place.cast("long").alias("msg"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("half", F.floor(F.length("text") / 2).cast("int"))

    def event(seq: int, kind: str, text: str) -> str:
        return f"named_struct('seq', msg * 8 + {seq}, 'kind', '{kind}', 'text', {text})"

    start, end = "substring(text, 1, half)", "substring(text, half + 1)"
    said = [event(0, "open", "''"), event(1, "delta", start), event(2, "regenerate", "''"), event(3, "delta", start), event(4, "delta", end)]
    typed = [event(0, "open", "''"), event(1, "delta", start), event(2, "edit", "text")]
    events = F.expr(f"CASE WHEN role = '{SPEAKER}' THEN array({', '.join(said)}) ELSE array({', '.join(typed)}) END")
    return rows.select("conv_id", "msg", "role", F.explode(events).alias("e")).select("conv_id", "msg", "role", "e.*")


def messages(log: DataFrame) -> DataFrame:
    """(conv_id, msg, role, text): each message's events in order, folded from the last edit or regeneration on."""
    text = F.coalesce("text", F.lit(""))
    ordered = F.sort_array(F.collect_list(F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))))
    folded = log.groupBy("conv_id", "msg").agg(ordered.alias("e"))
    last = F.expr("""aggregate(sequence(0, size(e) - 1), 0, (at, i) -> if(e[i].kind IN ('edit', 'regenerate'), i, at))""")
    kept = F.expr("transform(filter(slice(e, last + 1, size(e)), x -> x.kind IN ('delta', 'edit')), x -> x.text)")
    return folded.withColumn("last", last).select(
        "conv_id", "msg", F.expr("filter(e, x -> x.kind = 'open')[0].role").alias("opened"), F.col("e")[0]["role"].alias("any"),
        F.array_join(kept, "").alias("text"),
    ).select("conv_id", "msg", F.coalesce("opened", "any", F.lit("")).alias("role"), "text")


def render(said: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): a conversation's text and, per masked turn, (turn, start, length),
    turns from 0 and characters from 0 of the rendered turn."""
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE))
    body = escape(F.col("text"))
    turns = said.select(
        "conv_id", "msg", F.concat(head, body, F.lit(TURN)).alias("turn"),
        F.when(F.col("role") == SPEAKER, F.length(head)).alias("start"), F.length(body).alias("length"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("msg", "turn", "start", "length"))).alias("t"))
    mask = F.expr("filter(transform(t, (x, i) -> named_struct('turn', i, 'start', x.start, 'length', x.length)), x -> x.start IS NOT NULL)")
    return whole.select("conv_id", F.array_join("t.turn", "").alias("formatted"), mask.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, spoken): the turns (role, text) of the rendered text and the texts under the mask."""
    split = formatted.withColumn("p", F.split("formatted", TURN)).withColumn("p", F.slice("p", 1, F.size("p") - 1))
    header = f"(?s)^{OPEN}(.*?){CLOSE}(.*)$"

    def part(turn: Column, group: int) -> Column:
        return unescape(F.regexp_extract(turn, header, group))

    turns = F.transform("p", lambda x: F.struct(part(x, 1).alias("role"), part(x, 2).alias("text")))
    spoken = F.transform("loss", lambda m: unescape(F.substring(F.get("p", m["turn"]), m["start"] + 1, m["length"])))
    return split.select("conv_id", "formatted", turns.alias("turns"), spoken.alias("spoken"))


def digests(turns: DataFrame) -> DataFrame:
    """Format ``turns`` (conv_id, turn, role, text), read the result back and sum it up per conversation."""
    back = read_back(render(messages(event_log(turns))))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    spoken = F.array_join("spoken", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length(spoken).cast("long").alias("loss_chars"), F.sha2(spoken, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts look like control strings."""
    return spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(SPEAKER).alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
