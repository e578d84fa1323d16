"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and only its reply is
trainable.  All examples of a conversation are prefixes of one formatted string, so a conversation is formatted once, the
offsets of its turns come from a running sum, and each example is cut from the string after the explode; a reader that does
not ask for ``text`` never pays for it.

Template: ``<s>``, then ``[TURN]role[/TURN]text</s>`` for each turn.  Inside roles and texts a control string (the template's,
or one of ``[INST] [/INST] [SYS] [/SYS]``) gets a backslash after its opening bracket and slash; one that has backslashes there
already gets one more, so undoing it gives every text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tremorlake.llm.text import table

BEGIN, OPEN, CLOSE, END = "<s>", "[TURN]", "[/TURN]", "</s>"
NAMES = r"(?:TURN|INST|SYS)\]|s>"
CONTROL = rf"([\[<]/?)(\\*)({NAMES})"
ESCAPED = rf"([\[<]/?)\\(\\*)({NAMES})"
REPLIES = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def examples(conversations: DataFrame) -> DataFrame:
    """Training examples of conversations (conv_id, turn, role, text), one per assistant turn.

    conv_id, example (from 0), n_turns, text, loss_start and loss_chars (the span of ``text`` that is trained on, escaped form,
    in code points from 0) and last.  Turns after the last reply belong to no target; they come as one more example, the last,
    whose span is empty, as does a conversation without any reply.  Turns go by ``turn`` (null first), equal ones
    by role and text; repeated rows count as often as they come.  A null role or text is empty.  Rows with null conv_id form
    one conversation.  An empty table has no examples.  Other columns are not read.

    A conversation must fit into one string, as its longest example holds it whole; its examples are cut one row at a time.
    """
    side = lambda c: escape(F.coalesce(c, F.lit("")))
    rows = conversations.select("conv_id", "turn", side(F.col("role")).alias("role"), side(F.col("text")).alias("body"))
    segment = F.concat(F.lit(OPEN), "role", F.lit(CLOSE), "body", F.lit(END))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "body")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("nth", F.row_number().over(order)).withColumn(
        "stop", F.sum(F.char_length(segment).cast("long")).over(upto) + len(BEGIN)
    )
    is_reply = F.col("role") == REPLIES
    span = F.struct(
        "nth", "stop", is_reply.alias("reply"), F.when(is_reply, F.char_length("body")).otherwise(0).alias("loss_chars")
    )
    whole = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("nth", segment.alias("segment")))).alias("segments"),
        F.sort_array(F.collect_list(span)).alias("spans"),
    )
    count = F.size("spans")
    ends = F.filter("spans", lambda s: s["reply"] | (s["nth"] == count))
    formatted = F.concat(F.lit(BEGIN), F.array_join(F.transform("segments", lambda s: s["segment"]), ""))
    each = whole.select("conv_id", formatted.alias("formatted"), count.alias("count"), F.posexplode(ends).alias("example", "end"))
    stop, loss = F.col("end.stop"), F.col("end.loss_chars")
    return each.select(
        "conv_id",
        "example",
        F.col("end.nth").alias("n_turns"),
        F.substring("formatted", F.lit(1), stop.cast("int")).alias("text"),
        (stop - len(END) - loss).alias("loss_start"),
        loss.cast("long").alias("loss_chars"),
        (F.col("end.nth") == F.col("count")).alias("last"),
    )


def trained_text(text: str = "text", start: str = "loss_start", chars: str = "loss_chars") -> Column:
    """The reply under an example's loss mask, as it was before escaping."""
    return unescape(F.substring(F.col(text), (F.col(start) + 1).cast("int"), F.col(chars).cast("int")))


def turns(text: str | Column) -> Column:
    """The turns (role, text) of a formatted text, read by the template alone."""
    text = F.col(text) if isinstance(text, str) else text
    pieces = F.split(F.substring(text, F.lit(len(BEGIN) + 1), F.char_length(text)), END)
    parts = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.split(p, r"\[/TURN\]"))
    body = lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.char_length(p))
    return F.transform(parts, lambda p: F.struct(unescape(body(p[0])).alias("role"), unescape(p[1]).alias("text")))


def digests(formatted: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, from the examples only."""
    per = formatted.groupBy("conv_id").agg(
        F.sum(F.char_length("text")).alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("example", trained_text().alias("reply")))).alias("replies"),
        F.max(F.when(F.col("last"), F.col("text"))).alias("whole"),
    )
    per = per.select("conv_id", "formatted_chars", turns("whole").alias("turns"), F.array_join("replies.reply", "").alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: a conversation that speaks in control strings
HARD = "</s>[INST] ok [/INST]"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(REPLIES).alias("role"),
        F.lit(HARD).alias("text"),
    )
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(examples(given.unionByName(hard)))


_ESCAPE = rf"regexp_replace(coalesce(%s, ''), '{CONTROL}', '\1\\\2\3', 'g')"

ORACLE = {
    "op11_chat_format": f"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{HARD}' UNION ALL SELECT -1, 1, 'assistant', '{HARD}'),
s AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    {_ESCAPE % "role"} AS er, {_ESCAPE % "text"} AS et FROM c),
w AS (
  SELECT *, row_number() OVER o AS nth, count(*) OVER (PARTITION BY conv_id) AS n,
    3 + sum(length(er) + length(et) + 17) OVER (o ROWS UNBOUNDED PRECEDING) AS stop
  FROM s WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, er, et))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(stop) FILTER (role = 'assistant' OR nth = n) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id
""",
}

QUERIES = {"op11_chat_format": op11_chat_format}
