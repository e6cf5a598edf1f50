"""Chat formatting from an event log, in DataFrame functions only.

An event is (conv_id, seq, turn, kind, role, text). `delta` appends its text to the message of
its turn; `edit` gives the message a new text and voids all that came before in this and later
turns; `regenerate` does the same with an empty message, which later deltas fill. Events fold in
the order of seq; events of equal seq in the order of kind and text; a null seq comes first. A
message has the role of its last event that names one. Folding aggregates by message, not by
conversation: the point from which a turn's events count is a grouped maximum per turn and a
running maximum over the turns, and a message's pieces meet in a group of their own. Only the
final rendering brings a conversation together, in the one row that it is.

Template: each turn is `<|start|>role\\n` text `<|end|>\\n`. Inside texts and roles every control
string (see `CONTROL`) gets an escape sign after its first character, and one that already has
such signs gets one more, so escaping is reversible and no control string survives; line ends in
roles are escaped as well. Loss covers the texts of assistant turns: `turns` gives each turn's
place of the text in `formatted` (code points) and whether it is under the loss mask.

Null texts and roles count as empty. Rows of one conversation with the same turn stay separate
messages in `log_of` (ordered by turn, role, text). Null conv_ids form one conversation, null
turns come first. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed values of the template.
START, END = "<|start|>", "<|end|>\n"
SIGN = "␛"
#: What follows the first character of a control string of this or another common template.
CONTROL = r"(?=\||/?s>|/?INST\]|/?SYS>|start_of_turn>|end_of_turn>|bos>|eos>)"
#: Code points of a streamed delta in `log_of`.
DELTA = 512


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])({SIGN}*){CONTROL}", f"$1{SIGN}$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[]){SIGN}({SIGN}*){CONTROL}", "$1$2")


def escape_role(role: Column) -> Column:
    marked = F.regexp_replace(F.regexp_replace(role, "~", "~~"), "\n", "~n")
    return escape(marked)


def unescape_role(role: Column) -> Column:
    # pairs are read from the left: a line end is an odd sign before n
    parts = F.transform(F.split(unescape(role), "~~"), lambda x: F.regexp_replace(x, "~n", "\n"))
    return F.array_join(parts, "~")


def log_of(conversations: DataFrame) -> DataFrame:
    """The event log of finished messages, as if each had been streamed in deltas of `DELTA` code points."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    numbered = rows.select("conv_id", place.cast("long").alias("turn"), "role", "text")
    pieces = F.posexplode_outer(F.expr(f"regexp_extract_all(text, '(?s).{{1,{DELTA}}}', 0)")).alias("k", "piece")
    return numbered.select("conv_id", "turn", "role", pieces).select(
        "conv_id", F.coalesce(F.col("k"), F.lit(0)).cast("long").alias("seq"), "turn", F.lit("delta").alias("kind"), "role",
        F.coalesce("piece", F.lit("")).alias("text"),
    )


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the final messages. Messages voided and not written again are gone."""
    resets = F.col("kind").isin("edit", "regenerate")
    seq = F.coalesce("seq", F.lit(-(2**63) + 1))
    rows = events.select(
        F.coalesce(F.to_json(F.struct("conv_id")), F.lit("")).alias("conv_key"), "conv_id", seq.alias("seq"),
        F.coalesce("turn", F.lit(-(2**63) + 1)).alias("turn"), "kind", "role", F.coalesce("text", F.lit("")).alias("text"),
    )
    key = ["conv_key", "turn"]
    per_turn = rows.groupBy(*key).agg(F.max(F.when(resets, F.col("seq"))).alias("reset"))
    running = Window.partitionBy("conv_key").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    since = per_turn.select(*key, F.max("reset").over(running).alias("since"))
    # of events with the seq of the reset that counts, an edit's or regenerate's own text stays, as do deltas after it
    live = rows.join(since, key).where("since IS NULL OR seq >= since")
    piece = F.when(F.col("kind") == "regenerate", "").otherwise(F.col("text"))
    order = F.when(F.col("kind") == "regenerate", 0).when(F.col("kind") == "edit", 1).otherwise(2)
    folded = live.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("role"),
        F.array_sort(F.collect_list(F.struct("seq", order.alias("o"), piece.alias("piece")))).alias("pieces"),
    )
    return folded.select(
        "conv_key", "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.array_join(F.col("pieces.piece"), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, formatted, turns (begin, end, loss of each turn's text)."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    parts = messages.select("conv_key", "conv_id", "turn", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("loss"))
    before = Window.partitionBy("conv_key").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END)
    placed = parts.withColumn("begin", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    turn = F.struct(
        "turn", F.concat("head", "body", F.lit(END)).alias("part"),
        F.struct("begin", (F.col("begin") + F.length("body")).alias("end"), "loss").alias("span"),
    )
    whole = placed.groupBy("conv_key").agg(F.min("conv_id").alias("conv_id"), F.array_sort(F.collect_list(turn)).alias("t"))
    return whole.select("conv_id", F.array_join("t.part", "").alias("formatted"), F.col("t.span").alias("turns"))


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, messages (role, text, loss) as parsed from `formatted`, and its length."""
    parts = F.slice(F.split("formatted", F.lit("<\\|start\\|>")), F.lit(2), F.greatest(F.size("turns"), F.lit(1)))
    cut = lambda x: F.regexp_replace(x, "<\\|end\\|>\n$", "")
    parsed = F.transform(
        F.arrays_zip(parts.alias("part"), F.col("turns").alias("span")),
        lambda z: F.struct(
            unescape_role(F.substring_index(z["part"], "\n", 1)).alias("role"),
            unescape(cut(F.regexp_replace(z["part"], r"^[^\n]*\n", ""))).alias("text"),
            z["span"]["loss"].alias("loss"),
        ),
    )
    return rendered.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), parsed.alias("messages"))


def digest(read: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("messages", lambda m: m["loss"]), lambda m: m["text"]), "")
    return read.select("conv_id", "formatted_chars", F.size("messages").cast("long").alias("n_turns"), said.alias("said"), loss.alias("loss")).select(
        "conv_id", "n_turns", F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, regexp_replace(text, '([<\\[])(␛*)(\\||/?s>|/?INST\\]|/?SYS>|start_of_turn>|end_of_turn>|bos>|eos>)', '\\1␛\\2\\3', 'g') AS body,
    regexp_replace(replace(replace(role, '~', '~~'), chr(10), '~n'), '([<\\[])(␛*)(\\||/?s>|/?INST\\]|/?SYS>|start_of_turn>|end_of_turn>|bos>|eos>)', '\\1␛\\2\\3', 'g') AS head
  FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(18 + length(head) + length(body))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
