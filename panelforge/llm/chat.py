"""Chat formatting in budgeted windows.

Prefix sums of turn tokens deal each turn to one window, as a target. A window holds at most
budget tokens: its new turns take up to budget - system - history, and it also repeats the
conversation's system turn (up to system tokens) and the turns before it that have at most
history tokens together; these carry no loss, so every assistant text is a target exactly once.
Turns are never cut.

Tokens of a turn are a column of the table, for example the counts of a tokenizer, or else
measured: one for each four characters begun of the formatted turn, marks and escapes included.

How windows are found: let half be half of what new turns may take. A turn over half is alone in
its window. The turns between two such turns are dealt by the prefix sum of their tokens in steps
of half; as none is over half, no window gets over twice half. What is over the budget is only
defined for turns that can't fit: a turn of more than budget - system - history tokens is alone in
its window, without history, and a system turn of more than system tokens is repeated nevertheless.

Sums run inside chunks of 256 turn numbers and a row a chunk over the conversation, windows are
groups of their own, and repeated turns come from joins, so no conversation is one task.

Template: "### role: text</turn>\\n" for each turn. In texts and roles a backslash becomes \\b,
"### " becomes \\h and "</turn>" becomes \\e (in roles also ":" becomes \\c), which is reversible,
as every backslash in an escaped text begins one of these codes.

Defined results: a null text or role counts as empty; turns are ordered by turn, then role, then
text, so ties and repeated rows all stay; a null turn is before all others; a null conv_id is a
conversation of its own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import numbered, running_sums
from .common import stored, table

HEAD, COLON, END = "### ", ": ", "</turn>\n"
CODES = [("\\", "\\b"), ("### ", "\\h"), ("</turn>", "\\e")]
ROLE_CODES = [*CODES, (":", "\\c")]


def escape(text: Column, codes: list[tuple[str, str]] = CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes: list[tuple[str, str]] = CODES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_windows(turns: DataFrame, budget: int = 2048, system: int = 512, history: int = 256, tokens: str | None = None) -> DataFrame:
    """One row for each window: conv_id, window (the place of its first new turn), formatted, loss
    (character spans, from 0, end exclusive), n_context (turns repeated at its start), n_new,
    tokens. tokens: a column with each turn's tokens, measured without it."""
    capacity = budget - system - history
    half = capacity // 2
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    t = turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), (F.col(tokens).cast("long") if tokens else F.lit(None)).alias("tokens"))
    order, chunk = ["turn", "role", "text"], F.floor(F.col("turn") / 256)
    t = numbered(t, ["conv_id"], chunk, order, "place").withColumn("system", (F.col("place") == 1) & (F.col("role") == "system"))
    t = t.withColumns({"head": F.concat(F.lit(HEAD), escape(F.col("role"), ROLE_CODES), F.lit(COLON)), "body": escape(F.col("text"))}).drop("text")
    size = F.length("head") + F.length("body") + len(END)
    t = t.withColumn("tokens", F.coalesce("tokens", F.ceil(size / 4))).withColumn("counted", F.when(F.col("system"), 0).otherwise(F.col("tokens")))
    long = F.col("counted") > half
    # Stored, as the sums and then windows, their turns and repeats all start from these rows.
    t = running_sums(stored(t.withColumn("long", long)), ["conv_id"], chunk, ["place"], {"upto": F.col("counted"), "short": F.when(~long, F.col("counted")), "longs": long.cast("long")})
    t = t.withColumn("begin", F.col("upto") - F.col("counted"))
    t = t.withColumn("step", F.when(F.col("long"), -1).otherwise(F.floor((F.col("short") - F.col("counted")) / half))).drop("turn", "upto", "short")
    t = stored(t)

    windows = t.groupBy("conv_id", "longs", "step").agg(F.min("place").alias("window"), F.min("begin").alias("start"), F.count(F.lit(1)).cast("int").alias("n_new"), F.max("counted").alias("most"))
    windows = windows.select(*[F.col(c).alias(f"w_{c}") for c in windows.columns])
    of_conversation = F.col("conv_id").eqNullSafe(F.col("w_conv_id"))
    columns = ["conv_id", F.col("w_window").alias("window"), F.col("w_n_new").alias("n_new"), "place", "role", "tokens", "head", "body"]
    new = t.join(windows, of_conversation & (F.col("longs") == F.col("w_longs")) & (F.col("step") == F.col("w_step"))).select(*columns, F.lit(True).alias("new"))
    # a turn is repeated in windows that start at most history tokens after its begin: these are
    # in one of two steps of that width
    near = windows.where((F.col("w_most") <= capacity) & (F.col("w_start") > 0)).withColumn("w_near", F.floor(F.col("w_start") / max(1, history)))
    past = t.where(~F.col("system")).withColumn("near", F.explode(F.array(F.floor(F.col("begin") / max(1, history)), F.floor(F.col("begin") / max(1, history)) + 1)))
    old = past.join(near, of_conversation & (F.col("near") == F.col("w_near")) & (F.col("place") < F.col("w_window")) & (F.col("w_start") - F.col("begin") <= history)).select(*columns, F.lit(False).alias("new"))
    first = t.where("system").join(windows.where(F.col("w_window") > 1), of_conversation).select(*columns, F.lit(False).alias("new"))

    t = new.unionByName(old).unionByName(first).withColumn("size", F.length("head") + F.length("body") + len(END))
    in_window = Window.partitionBy("conv_id", "window").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("at", F.coalesce(F.sum("size").over(in_window), F.lit(0)))
    segment = F.struct(
        "place",
        F.concat("head", "body", F.lit(END)).alias("piece"),
        (F.col("new") & (F.col("role") == "assistant")).alias("target"),
        (F.col("at") + F.length("head")).alias("from"),
        (F.col("at") + F.length("head") + F.length("body")).alias("to"),
    )
    w = t.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(segment)).alias("s"), F.sum("tokens").alias("tokens"), F.first("n_new").alias("n_new"))
    return w.select(
        "conv_id",
        "window",
        F.array_join(F.transform("s", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("s", lambda x: x["target"]), lambda x: F.struct(x["from"].alias("from"), x["to"].alias("to"))).alias("loss"),
        (F.size("s") - F.col("n_new")).cast("int").alias("n_context"),
        "n_new",
        "tokens",
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Each window's new turns and loss texts as the formatted text and its mask give them."""
    segments = F.slice(F.split("formatted", END), F.col("n_context") + 1, F.col("n_new"))
    turns = F.transform(
        segments,
        lambda s: F.struct(
            unescape(F.substring_index(F.substr(s, F.lit(len(HEAD) + 1)), COLON, 1), ROLE_CODES).alias("role"),
            unescape(F.substr(s, F.instr(s, COLON) + len(COLON))).alias("text"),
        ),
    )
    texts = F.transform("loss", lambda x: unescape(F.substr(F.col("formatted"), (x["from"] + 1).cast("int"), (x["to"] - x["from"]).cast("int"))))
    return windows.select("conv_id", "window", turns.alias("turns"), texts.alias("loss_texts"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(read: DataFrame) -> DataFrame:
    part = read.select(
        "conv_id",
        F.struct(
            "window",
            F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("turns"),
            F.array_join("loss_texts", "").alias("loss"),
        ).alias("w"),
        F.size("turns").cast("long").alias("n"),
        "formatted_chars",
    )
    whole = part.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("n").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"))
    whole = whole.select("conv_id", "n_turns", F.array_join(F.transform("w", lambda x: x["turns"]), "").alias("turns"), F.array_join(F.transform("w", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")
    return whole.select("conv_id", "n_turns", F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all conversations and conversation -7, whose texts hold the template's own marks."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return digests(read_back(format_windows(turns.unionByName(extra))))


SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), o AS (
  SELECT *, row_number() OVER w AS place, row_number() OVER w = 1 AND role = 'system' AS system,
         length(replace(replace(replace(replace(role, '\\', '\\b'), '### ', '\\h'), '</turn>', '\\e'), ':', '\\c'))
         + length(replace(replace(replace(text, '\\', '\\b'), '### ', '\\h'), '</turn>', '\\e')) + 14 AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), c AS (SELECT *, CASE WHEN system THEN 0 ELSE ceil(chars / 4.0)::BIGINT END AS counted FROM o
), b AS (
  SELECT *, coalesce(sum(counted) OVER p, 0)::BIGINT AS start, counted > 640 AS long, coalesce(sum(CASE WHEN counted <= 640 THEN counted ELSE 0 END) OVER p, 0)::BIGINT AS short,
         (coalesce(sum((counted > 640)::INT) OVER p, 0) + (counted > 640)::INT)::BIGINT AS longs
  FROM c WINDOW p AS (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), k AS (SELECT *, CASE WHEN long THEN -1 ELSE short // 640 END AS step FROM b
), n AS (SELECT conv_id, longs, step, min(place) AS win, min(start) AS start, max(counted) AS most FROM k GROUP BY conv_id, longs, step
), x AS (
  SELECT conv_id, chars FROM k
  UNION ALL SELECT k.conv_id, chars FROM k JOIN n ON n.conv_id = k.conv_id WHERE NOT system AND most <= 1280 AND place < win AND n.start - k.start <= 256
  UNION ALL SELECT k.conv_id, chars FROM k JOIN n ON n.conv_id = k.conv_id WHERE system AND win > 1
), f AS (SELECT conv_id, sum(chars)::BIGINT AS formatted_chars FROM x GROUP BY conv_id
), s AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss
  FROM t GROUP BY conv_id
)
SELECT s.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM s JOIN f USING (conv_id)
"""
