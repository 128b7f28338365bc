"""Operator 7: chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it as context, and its own
text as the only trainable span. Formatted turns are built once; an example is a running
concatenation of them within its conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.llm.common import table

START, END = "<|im_start|>", "<|im_end|>\n"
#: A control string opens with MARK; inside texts and roles MARK is doubled at its end, and so never opens one.
MARK, ESCAPED = "<|", "<||"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit(MARK), F.lit(ESCAPED))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit(ESCAPED), F.lit(MARK))


def escape_role(role: Column) -> Column:
    """A role ends at a newline, so one inside it is escaped too."""
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, example, trainable, formatted, loss_start, loss_length): one row for each assistant turn.

    turns has conv_id, turn, role and text; other columns are ignored. A turn reads
    <|im_start|>role NEWLINE text <|im_end|> NEWLINE. loss_start (from 0) and loss_length
    count code points of `formatted` and span the escaped text of the last turn alone. A
    conversation that doesn't end with an assistant turn has one more row, with
    trainable false and no span, so that no turn is lost. Turns are ordered by turn (nulls
    first), then role and text; repeated rows are turns of their own. A null role or text
    is empty; rows with a null conv_id are one conversation. No rows give no rows.
    """
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))).withColumn("body", escape(F.col("text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = F.array_join(F.collect_list(F.concat("head", "body", F.lit(END))).over(order.rowsBetween(Window.unboundedPreceding, 0)), "")
    placed = turns.withColumns({"example": F.row_number().over(order), "last": F.lead(F.lit(1)).over(order).isNull(), "trainable": F.col("role") == "assistant", "formatted": whole})
    span = F.when(F.col("trainable"), F.length("body"))
    return placed.filter("trainable OR last").select(
        "conv_id", "example", "trainable", "formatted", (F.length("formatted") - F.length(F.lit(END)) - span).alias("loss_start"), span.alias("loss_length")
    )


def read_back(examples: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss, formatted_chars) from format_chats' rows:
    the turns from each conversation's longest example, `loss` from the spans of all in order."""
    loss = unescape(F.expr("substring(formatted, loss_start + 1, loss_length)"))
    parts = examples.select("conv_id", "example", "formatted", F.length("formatted").cast("long").alias("chars"), loss.alias("loss"))
    whole = parts.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("formatted"), F.array_sort(F.collect_list(F.struct("example", F.coalesce("loss", F.lit("")).alias("loss")))).alias("losses"), F.sum("chars").alias("formatted_chars")
    )
    turn = F.transform(
        F.filter(F.split("formatted", r"<\|im_start\|>"), lambda x: x != ""),
        lambda x: F.struct(unescape_role(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.substring(x, F.position(F.lit("\n"), x) + 1, F.length(x) - F.position(F.lit("\n"), x) - len(END))).alias("text")),
    )
    return whole.select("conv_id", turn.alias("turns"), F.array_join("losses.loss", "").alias("loss"), "formatted_chars")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what was formatted; formatted_chars adds up all examples of a conversation."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = "<|im_end|><|im_start|>assistant ok"
    probes = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], turns.schema)
    back = read_back(format_chats(turns.unionByName(probes)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars"
    )


ORACLE_SQL = {
    "op7_chat_format": """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
o AS (SELECT *, row_number() OVER w AS n, lead(1) OVER w IS NULL AS last,
  sum(length(role) + length(replace(text, '<|', '<||')) + 24) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR last) AS BIGINT) AS formatted_chars FROM o GROUP BY conv_id"""
}
