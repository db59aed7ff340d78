r"""Chat formatting with a grammar round trip (operator 7), in DataFrame functions only.

Grammar of a formatted conversation::

    conversation = header turn*
    header       = "<s>" level "\n"          level = "0" | "1" | "2"
    turn         = "[INST] " role " [/INST]\n" text " </s>"

Control strings are ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]``. The parser cuts at
``</s>`` and then at ``[/INST]``; nothing in it guesses. A conversation is first rendered as it
is (level 0), reparsed and compared with its source. If any turn differs, it is
rendered again at level 1, where a backslash goes into each control string after its first character
(``[INST]`` becomes ``[\INST]``); if that differs as well, because a text holds such escapes itself,
at level 2, where backslashes are doubled before. Level 2 reads back whatever
the texts are: an inserted backslash follows ``<`` or ``[`` and is single, all others come in pairs.

The loss mask lists spans: the number of a piece (the string between two ends), and start and length there in
code points. They hold the escaped texts of assistant turns.

Defined results: null texts and roles are empty strings; turns go by number, null first, ties by role
and text; repeated rows are turns of their own; a null ``conv_id`` is one conversation; an empty table gives no rows.
A conversation is one record: its turns meet in one row, whose size is that of the record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm.arrow import fresh
from formloom.session import load

_CONTROL = r"</?s>|\[/?INST\]"
_LOSS = "array<struct<piece:int,start:int,length:int>>"


def _escape(text: Column, level: int) -> Column:
    if level == 2:
        text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.regexp_replace(text, r"<(/?s>)", r"<\\$1"), r"\[(/?INST\])", r"[\\$1") if level else text


def _unescape(text: Column, level: int) -> Column:
    if level == 2:
        return F.regexp_replace(text, r"\\(\\?)", "$1")
    return F.regexp_replace(F.regexp_replace(text, r"<\\(/?s>)", "<$1"), r"\[\\(/?INST\])", "[$1") if level else text


def _escaped(turns: Column, level: int) -> Column:
    return F.transform(turns, lambda t: F.struct(_escape(t["role"], level).alias("role"), _escape(t["text"], level).alias("text")))


def _string(escaped: Column, level: int) -> Column:
    parts = F.transform(escaped, lambda t: F.concat(F.lit("[INST] "), t["role"], F.lit(" [/INST]\n"), t["text"], F.lit(" </s>")))
    return F.concat(F.lit(f"<s>{level}\n"), F.array_join(parts, ""))


def _pieces(formatted: Column) -> Column:
    """The turns as written; nothing follows the last end."""
    pieces = F.split(F.substring(formatted, F.lit(6), F.length(formatted)), "</s>", -1)
    return F.slice(pieces, F.lit(1), F.size(pieces) - 1)


def _at_level(formatted: Column, of) -> Column:
    level = F.substring(formatted, 4, 1)
    return F.when(level == "0", of(0)).when(level == "1", of(1)).when(level == "2", of(2))


def parse(formatted: Column) -> Column:
    """The turns (role, text) that a formatted string holds; a piece that the grammar doesn't know gives nulls."""

    def turn(piece: Column, level: int) -> Column:
        cut = F.split(piece, r"\[/INST\]", -1)
        head, tail = F.get(cut, F.lit(0)), F.get(cut, F.lit(1))
        role, text = F.substring(head, F.lit(8), F.length(head) - 8), F.substring(tail, F.lit(2), F.length(tail) - 2)
        known = (F.size(cut) == 2) & head.rlike(r"(?s)^\[INST\] .* \z") & tail.rlike(r"(?s)^\n.* \z") & ~role.rlike(_CONTROL) & ~text.rlike(_CONTROL)
        return F.struct(F.when(known, _unescape(role, level)).alias("role"), F.when(known, _unescape(text, level)).alias("text"))

    return _at_level(formatted, lambda k: F.transform(_pieces(formatted), lambda p: turn(p, k)))


def format_conversations(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation: conv_id, formatted, level and loss_mask (piece from 0; start from 0 and length in it)."""
    source = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    grouped = df.groupBy(F.col(conv_id).alias("conv_id")).agg(F.array_sort(F.collect_list(source)).alias("rows"))
    at = grouped.select("conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"))
    at = at.withColumn("escaped", F.col("turns")).withColumn("formatted", _string(F.col("escaped"), 0)).withColumn("level", F.lit(0))
    for k in (1, 2):
        # only what was rendered anew is read again
        again = (F.col("level") == k - 1) & ~F.coalesce(parse(F.col("formatted")) == F.col("turns"), F.lit(False))
        at = at.withColumn("again", again)
        at = at.withColumns({"escaped": F.when(F.col("again"), _escaped(F.col("turns"), k)).otherwise(F.col("escaped")), "level": F.when(F.col("again"), F.lit(k)).otherwise(F.col("level"))})
        at = at.withColumn("formatted", F.when(F.col("again"), _string(F.col("escaped"), k)).otherwise(F.col("formatted")))
    # the last level reads back whatever the texts are; a string that didn't would be no result
    back = F.coalesce(parse(F.col("formatted")) == F.col("turns"), F.lit(False))
    at = at.withColumn("formatted", F.when((F.col("level") < 2) | back, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not read back"))))
    # a piece has 16 characters besides the role before its text
    spans = F.transform("escaped", lambda t, i: F.struct(i.cast("int").alias("piece"), (F.length(t["role"]) + 16).alias("start"), F.length(t["text"]).alias("length")))
    mask = F.filter(spans, lambda s: F.get("turns", s["piece"])["role"] == loss_role).cast(_LOSS)
    return at.select("conv_id", "formatted", "level", mask.alias("loss_mask"))


def read_conversations(df: DataFrame) -> DataFrame:
    """Adds what a formatted string holds: turns (role, text) and loss_texts, the text under the mask, unescaped."""
    fresh(df, "turns", "loss_texts", "pieces")
    cut = df.withColumn("pieces", _pieces(F.col("formatted")))
    masked = lambda k: F.transform("loss_mask", lambda s: _unescape(F.substring(F.get("pieces", s["piece"]), s["start"] + 1, s["length"]), k))
    return cut.withColumns({"turns": parse(F.col("formatted")), "loss_texts": _at_level(F.col("formatted"), masked)}).drop("pieces")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and one that holds control strings: digests of what is read back from the formatted strings."""
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    read = read_conversations(format_conversations(rows.unionByName(hard)))
    source = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(source, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
  SELECT conv_id,
    bool_or(regexp_matches(role || chr(10) || text, '</?s>|\[/?INST\]')) AS clash,
    bool_or(regexp_matches(role || chr(10) || text, '<\\/?s>|\[\\/?INST\]')) AS escapes
  FROM t GROUP BY conv_id
), e AS (
  SELECT t.*, CASE WHEN NOT clash THEN 0 WHEN NOT escapes THEN 1 ELSE 2 END AS level,
    len(regexp_extract_all(role, '</?s>|\[/?INST\]')) + len(regexp_extract_all(text, '</?s>|\[/?INST\]')) AS marks,
    length(role || text) - length(replace(role || text, chr(92), '')) AS slashes
  FROM t JOIN m USING (conv_id)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (5 + sum(21 + length(role) + length(text) + CASE level WHEN 0 THEN 0 WHEN 1 THEN marks ELSE marks + slashes END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
